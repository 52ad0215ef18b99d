"""Profiles and structure: fill rates, majorities, runs, fills, gaps and lookups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cells import blank
from millrace.operators import ordered


#: Values that a sketch of a column tracks, and its candidates beyond those that are asked for.
TRACKED, SPARE = 10_000, 16


def _sketch_bound(rows: int, tracked: int) -> int:
    """How often a value may stand among ``rows`` that a sketch doesn't name: its error is 3.5 rows for
    each place of its map, and a value is named once its lower bound is above that."""
    places = 1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))
    return math.ceil(2 * 3.5 * rows / places)


def most_frequent(df: DataFrame, columns: list[str], n: int = 1, tracked: int = TRACKED) -> DataFrame:
    """column_name, value (as text) and n: of each column the ``n`` most frequent values that aren't
    null, ties to the smaller value.

    A sketch of each column, whose size is fixed, names candidates; those alone are counted, so no
    other value is shuffled. If the counts don't prove that no other value can be among the most
    frequent, as in a column of unique values, that column's values are counted after all."""
    text = df.select(*(F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(columns)))
    wanted = n + SPARE
    tracked = max(tracked, wanted)
    seen = text.agg(*(F.struct(F.count(f"_{i}").alias("rows"), F.expr(f"approx_top_k(_{i}, {wanted}, {tracked})").alias("top")).alias(f"_{i}") for i in range(len(columns)))).first()
    named = [[t["item"] for t in seen[i].top or [] if t["item"] is not None] for i in range(len(columns))]

    def counts(of: list[int], keep) -> DataFrame:
        each = F.array(*(F.struct(F.lit(columns[i]).alias("column_name"), keep(i).alias("value")) for i in of))
        return text.select(F.inline(each)).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))

    found: dict[str, list[tuple[int, str]]] = {c: [] for c in columns}
    some = [i for i in range(len(columns)) if named[i]]
    if some:
        for r in counts(some, lambda i: F.when(F.col(f"_{i}").isin(*named[i]), F.col(f"_{i}"))).collect():  # wanted values a column
            found[r.column_name].append((-r.n, r["value"]))
    out, open_ = [], []
    for i, c in enumerate(columns):
        best, rows = sorted(found[c])[:n], seen[i].rows
        # the last candidate's estimate is above what any value that was cut off can have
        cut = seen[i].top[-1]["count"] if len(named[i]) >= wanted else 0
        if len(best) == n and -best[-1][0] > max(_sketch_bound(rows, tracked), cut) or sum(-k for k, _ in found[c]) == rows:
            out += [(c, v, -k) for k, v in best]
        else:
            open_.append(i)
    sure = df.sparkSession.createDataFrame(out, "column_name string, value string, n long")
    if not open_:
        return sure
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))  # limited before its shuffle
    rest = counts(open_, lambda i: F.col(f"_{i}")).withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
    return sure.unionByName(rest)


def fill_rate(df: DataFrame, columns: list[str], sparse: float = 50.0, assigned: tuple[str, ...] = ()) -> DataFrame:
    """column_name, rows, filled, pct, dominant value (the smallest of the most frequent), its count
    and share of the filled, and status: assigned (filled by another step), no rows, gap (nothing
    filled), sparse (under ``sparse`` percent) or ok. Rows and filled cells are one aggregate for all
    columns; the dominant value is :func:`most_frequent`."""
    filled = df.select(*(F.when(~blank(F.col(c).cast("string")), F.col(c).cast("string")).alias(c) for c in columns))
    sums = filled.agg(F.count("*").alias("rows"), *(F.count(c).alias(f"_filled_{i}") for i, c in enumerate(columns)))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"_filled_{i}").alias("filled")) for i, c in enumerate(columns)))
    top = most_frequent(filled, columns).select("column_name", F.col("value").alias("dominant"), F.col("n").alias("_most"))
    every = sums.select("rows", F.inline(each)).join(top, "column_name", "left").fillna(0, ["_most"])
    pct = F.when(F.col("rows") == 0, 0.0).otherwise(F.round(100.0 * F.col("filled") / F.col("rows"), 1))
    share = F.when(F.col("filled") == 0, 0.0).otherwise(F.round(100.0 * F.col("_most") / F.col("filled"), 1))
    status = F.when(F.col("column_name").isin(*assigned) if assigned else F.lit(False), "assigned").when(F.col("rows") == 0, "no rows").when(F.col("filled") == 0, "gap").when(pct < sparse, "sparse").otherwise("ok")
    return every.select("column_name", "rows", "filled", pct.alias("pct"), "dominant", F.col("_most").alias("dominant_n"), share.alias("dominant_share"), status.alias("status"))


def shape_majority(shapes: DataFrame, reference: DataFrame) -> DataFrame:
    """layer, feature, value, majority and result (MATCH or DIFF): features of a table's layers
    against the most frequent value among the reference's tables; ties go to the smaller value. Both
    have layer, feature and value."""
    counts = reference.groupBy("layer", "feature", "value").agg(F.count("*").alias("n"))
    top = counts.groupBy("layer", "feature").agg(F.max("n").alias("_top"))
    best = counts.join(top, ["layer", "feature"]).where("n = _top").groupBy("layer", "feature").agg(F.min("value").alias("majority"))
    return shapes.join(best, ["layer", "feature"]).select("layer", "feature", "value", "majority", F.when(F.col("value").eqNullSafe(F.col("majority")), "MATCH").otherwise("DIFF").alias("result"))


def bare_decimals(fields: DataFrame, name: str, kind: str) -> DataFrame:
    """Fields of a decimal type without a precision."""
    return fields.where(F.lower(F.trim(kind)).isin("decimal", "numeric")).select(name, kind)


def band_constant(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """The value of each group's cells that aren't blank: the one they share, or else the most
    frequent (ties to the one seen first), with how it was found and in how many cells."""
    filled = df.where(~blank(F.col(value).cast("string")))
    kinds = filled.groupBy(*group).agg(F.countDistinct(value).alias("_k"), F.count("*").alias("cells"))
    best = majority(filled, group, value, position).join(kinds, group)
    return best.select(*group, F.col("majority").alias("value"), F.when(F.col("_k") == 1, "all equal").otherwise("most frequent").alias("how"), "n", "cells")


def majority(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each group; ties go to the value seen first by ``position``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    best = counts.groupBy(*group).agg(F.max(F.struct("n", (-F.col("_first")).alias("_late"), F.col(value).alias("value"))).alias("m"))
    return best.select(*group, F.col("m.value").alias("majority"), F.col("m.n").alias("n"))


def minority_members(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """Rows of groups with several values that don't have the majority's."""
    top = majority(df, group, value, position)
    return df.join(top.drop("n"), group).where(F.col(value) != F.col("majority"))


def stepped_runs(df: DataFrame, group: list[str], order: str, rising: str, constant: str, least: int = 3, hot: int = ordered.HOT) -> DataFrame:
    """Maximal runs of neighbours whose ``rising`` grows by exactly 1 at equal ``constant``: first
    and last of ``order`` and length, of ``least`` at least. A group of more than ``hot`` rows is cut
    into chunks."""
    by = [F.col(order)]
    goes_on = (F.col(rising) == F.col("_rising") + 1) & (F.col(constant) == F.col("_constant"))

    def plain(rows: DataFrame) -> DataFrame:
        """One sort; a run is told at its last row, so runs that are too short are never gathered."""
        w = Window.partitionBy(*group).orderBy(*by)
        above = w.rowsBetween(Window.unboundedPreceding, 0)
        near = rows.withColumns({"_rising": F.lag(rising).over(w), "_constant": F.lag(constant).over(w), "_above": F.lag(order).over(w), "_place": F.row_number().over(w)})
        near = near.withColumn("_begins", ~F.coalesce(goes_on, F.lit(False)))
        # places that are null come first, and a run's first is one that isn't
        first = F.last(F.when(F.col("_begins") | F.col("_above").isNull(), F.col(order)), ignorenulls=True).over(above)
        ends = F.coalesce(F.lead("_begins").over(w), F.lit(True))
        runs = near.withColumns({"first": first, "_from": F.max(F.when(F.col("_begins"), F.col("_place"))).over(above), "_ends": ends}).where("_ends")
        length = (F.col("_place") - F.col("_from") + 1).cast("long")
        return runs.where(length >= least).select(*group, "first", F.col(order).alias("last"), length.alias("length"))

    def large(rows: DataFrame, n: int) -> DataFrame:
        near = ordered.with_previous(rows, group, by, {rising: "_rising", constant: "_constant"}, hot)
        begun = ordered.with_running_sum(near, group, by, F.when(goes_on, 0).otherwise(1), "_run", hot)
        runs = begun.groupBy(*group, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
        return runs.where(F.col("length") >= least).drop("_run")

    return ordered.parted(df, group, hot, plain, large)


def forward_fill(df: DataFrame, group: list[str], order: str, column: str, hot: int = ordered.HOT) -> DataFrame:
    """A blank cell takes the last value above it in its block. A block of more than ``hot`` rows is
    cut into chunks."""
    return ordered.filled(df, group, [F.col(order)], column, F.when(~blank(column), F.col(column)), hot)


def extent(df: DataFrame, group: list[str], order: str, gap: int, hot: int = ordered.HOT) -> DataFrame:
    """For each group of valued positions: the last one before the first ``gap`` empty positions in a
    row (counted from 1), and how many valued ones lie beyond. The gap is the smallest position that
    follows one, a minimum a group; a group of more than ``hot`` rows is cut into chunks."""
    near = ordered.with_previous(df, group, [F.col(order)], {order: "_above"}, hot)
    jump = F.col(order) - F.coalesce("_above", F.lit(0)) > gap
    first = near.groupBy(*group).agg(F.min(F.when(jump, F.col(order))).alias("_gap"))
    marked = df.alias("l").join(first.alias("r"), ordered.same("l", "r", group)).select("l.*", F.coalesce(F.col(f"l.{order}") >= F.col("r._gap"), F.lit(False)).alias("_beyond"))
    return marked.groupBy(*group).agg(F.coalesce(F.max(F.when(~F.col("_beyond"), F.col(order))), F.lit(0)).alias("last"), F.sum(F.col("_beyond").cast("long")).alias("beyond"))


def collapse(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Rows equal on ``keys`` (null and outer space as nothing) become one; their comma-separated
    sources are united, sorted and counted. Rows that name no source stay, with none."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(source), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    tidy = df.select(*(F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) for k in keys), F.explode_outer(parts).alias("_s"))
    united = tidy.groupBy(*keys).agg(F.array_sort(F.collect_set("_s")).alias("_all"))
    return united.select(*keys, F.concat_ws(",", "_all").alias("sources"), F.size("_all").alias("contributors"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """How many rows have each value of ``column``."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def unanimous(df: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """The one value that all rows of a key have, if there are ``least`` rows of it."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("_k"), F.min(value).alias("value"), F.count(value).alias("n")).where((F.col("_k") == 1) & (F.col("n") >= least)).drop("_k")


def only_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and value where a key has exactly one distinct value."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("_k"), F.min(value).alias(value)).where("_k = 1").drop("_k")


def fallback_lookup(df: DataFrame, reference: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``df`` with ``value`` by (group, key), or else by key alone, each only if it is unique."""
    near = only_one(reference, [group, key], value).withColumnRenamed(value, "_near")
    far = only_one(reference, [key], value).withColumnRenamed(value, "_far")
    found = df.join(near, [group, key], "left").join(far, key, "left")
    return found.withColumn(value, F.coalesce("_near", "_far")).withColumn("how", F.when(F.col("_near").isNotNull(), "group").when(F.col("_far").isNotNull(), "key").otherwise("none")).drop("_near", "_far")


def scoped(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids`` (its first column), a join that adds no column."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def scope_ids(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct ids of several tables that aren't blank."""
    out = None
    for df, column in tables:
        one = df.select(F.trim(F.col(column).cast("string")).alias("id")).where("id <> ''")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def scope_counts(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """kept and dropped: how many rows of ``df`` :func:`scoped` keeps, from one join."""
    marked = df.select(key).join(ids.select(F.col(ids.columns[0]).alias(key), F.lit(True).alias("_in")).distinct(), key, "left")
    return marked.agg(F.count("_in").alias("kept"), (F.count("*") - F.count("_in")).alias("dropped"))


def priority_lookup(df: DataFrame, by_group: DataFrame, by_key: DataFrame, by_source: DataFrame, group: str, key: str, sources: str, value: str) -> DataFrame:
    """``df`` with ``value`` and how: by its group, else by its key, else as the one value that all
    of its ``sources`` (an array) which have one agree on. The tables have group, key or source, and
    value; a column that is no single value of its table decides nothing. ``df`` has the column
    _row, a key of its rows."""
    names = {name: only_one(table, [column], value).withColumnRenamed(value, f"_{name}") for name, table, column in (("group", by_group, group), ("key", by_key, key))}
    told = df.select("_row", F.explode(sources).alias("source")).join(only_one(by_source, ["source"], value), "source")
    implied = only_one(told, ["_row"], value).withColumnRenamed(value, "_sources")
    found = df.join(names["group"], group, "left").join(names["key"], key, "left").join(implied, "_row", "left")
    how = F.when(F.col("_group").isNotNull(), "group").when(F.col("_key").isNotNull(), "key").when(F.col("_sources").isNotNull(), "sources").otherwise("none")
    return found.withColumns({value: F.coalesce("_group", "_key", "_sources"), "how": how}).drop("_group", "_key", "_sources")


def names_other(df: DataFrame, text: str, stems: DataFrame, own: str, row: str = "_row", most: int = 3) -> DataFrame:
    """Rows whose text has a run of up to ``most`` words that is another group's stem, and none of
    ``own``'s. ``stems``: stem, words without marks or spaces, and grp. ``row`` is a key of ``df``."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - n + 1, F.lit(1)))
        return F.when(F.size("_words") >= n, F.transform(starts, lambda i: F.array_join(F.slice("_words", i, n), ""))).otherwise(F.array().cast("array<string>"))

    runs = F.flatten(F.array(*map(runs_of, range(1, most + 1))))
    each = df.select(row, words.alias("_words")).select(row, F.explode(F.array_distinct(runs)).alias("stem"))
    seen = each.join(stems, "stem").groupBy(row).agg(F.max((F.col("grp") == own).cast("int")).alias("ours"))
    return df.join(seen.where("ours = 0"), row, "left_semi")


def type_conflicts(fields: DataFrame, name: str, kind: str) -> DataFrame:
    """Names stated with several types."""
    return fields.groupBy(name).agg(F.array_sort(F.collect_set(kind)).alias("types")).where(F.size("types") > 1)


def ranked_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values and their counts; ties by value, null first. Of texts, see
    :func:`most_frequent`."""
    if df.schema[column].dataType.typeName() != "string":
        return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n)
    top = most_frequent(df, [column], n).select(F.col("value").alias(column), "n")
    none = df.agg(F.count_if(F.col(column).isNull()).alias("n")).where("n > 0").select(F.lit(None).cast("string").alias(column), "n")
    return top.unionByName(none).orderBy(F.desc("n"), F.asc(column)).limit(n)
