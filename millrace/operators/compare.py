"""Keyed comparison of two tables: pairing, cell status and score. Everything is one shuffle on the
key and one on its order; repeated keys pair in order, and those of a hot key are numbered in chunks."""

from __future__ import annotations

from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace.functions.cells import any_of, blank, normal_of, status_of, tidy_cell
from millrace.operators.ordered import numbered
from millrace.operators.scratch import new_folder, spool


def pair(expected: DataFrame, actual: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Keys, _n, and l_ (expected) and r_ (actual) columns of ``values``: rows pair one to one by
    key, repeated keys in order, and what is left over stands alone. A row with a blank key never
    pairs and isn't numbered (_n is null), so such rows aren't gathered."""
    sides, lone = [], []
    for name, df in (("l", expected), ("r", actual)):
        alone = any_of([blank(F.col(k).cast("string")) for k in keys])
        own = [F.lit(True).alias(f"in_{name}"), *(F.col(v).alias(f"{name}_{v}") for v in values)]
        sides.append(numbered(df.where(~alone), keys, [F.col(c).asc_nulls_first() for c in order]).select(*keys, "_n", *own))
        lone.append(df.where(alone).select(*keys, F.lit(None).cast("int").alias("_n"), *own))
    met = sides[0].join(sides[1], [*keys, "_n"], "full_outer")
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [met, *lone])
    return every.select(*keys, "_n", *(F.coalesce(f"in_{x}", F.lit(False)).alias(f"in_{x}") for x in "lr"), *(f"{x}_{v}" for x in "lr" for v in values))


def pair_by_position(expected: DataFrame, actual: DataFrame, group: list[str], order: str, values: list[str]) -> DataFrame:
    """Only where a caller asks for it: rows pair by their ordinal in ``order`` within a group."""
    return pair(expected, actual, group, [order], values)


def by_keys(*keys: tuple[str, ...]) -> list[Column]:
    """Phases for :func:`pair_in_phases` from lists of key columns, the first one first; a row with
    a blank in a list takes no part in that phase."""
    return [F.when(~any_of([blank(F.col(c).cast("string")) for c in k]), F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in k)))) for k in keys]


#: Rows of a group's side that a task of :func:`pair_tolerant` holds, and chunks of a side, unless they
#: would hold more.
TOLERANT, CHUNKS = 20_000, 8


def _greedy(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Positions that pair when each of ``left``, in order, takes the first of ``right`` that is left
    and that agrees with it wherever neither has ''. Right rows are listed by the values at the
    places that a left row has, so a row looks up two to the power of its values."""
    used, lists, out = [False] * len(right), {}, []
    for i, mine in enumerate(left):
        places = tuple(k for k, v in enumerate(mine) if v)
        if places not in lists:
            lists[places] = by = {}
            for j in range(len(right) - 1, -1, -1):
                by.setdefault(tuple(right[j][k] for k in places), []).append(j)  # the first one last
        best = None
        for wanted in product(*((mine[k], "") for k in places)):
            own = lists[places].get(wanted, [])
            while own and used[own[-1]]:
                own.pop()
            if own and (best is None or own[-1] < best):
                best = own[-1]
        if best is not None:
            used[best] = True
            out.append((i, best))
    return out


def pair_tolerant(left: DataFrame, right: DataFrame, firm: list[str], loose: list[str], row: str, most: int = TOLERANT) -> DataFrame:
    """l_row and r_row of rows that agree on the ``firm`` keys, and on each ``loose`` one that is
    blank on neither side. In the order of ``row``, each left row takes the first right row that is
    left over. Null firm keys agree with nothing.

    Rows of a group are dealt to chunks in order, and a chunk of left rows meets a chunk of right rows
    in one task. What meets there depends only on the left chunks before it at the same right chunk,
    and on the right chunks before it; so chunks meet along diagonals, all groups at once. A side of
    more than ``most`` rows is cut into chunks of at least as many, CHUNKS of them as long as none
    has more than TOLERANT rows: so rounds don't grow with a group until it is large."""
    sides = []
    for x, df in (("l", left), ("r", right)):
        cell = lambda c: F.coalesce(F.when(~blank(F.col(c).cast("string")), F.col(c).cast("string")), F.lit(""))
        own = df.where(~any_of([F.col(c).isNull() for c in firm])).select(F.col(row).alias(f"{x}_row"), F.to_json(F.struct(*(F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(firm)), F.lit(0).alias("_"))).alias("_g"), F.array(*map(cell, loose)).cast("array<string>").alias("_v"))
        sides.append(spool(numbered(own, ["_g"], [F.col(f"{x}_row")])))
    schema = StructType([StructField(f"{x}_row", df.schema[f"{x}_row"].dataType) for x, df in zip("lr", sides, strict=True)])
    # a group's rows a chunk, and its last chunk, of either side
    size = lambda n: F.greatest(F.lit(most), F.least(F.ceil(F.col(n) / CHUNKS), F.lit(TOLERANT)))
    groups = reduce(lambda a, b: a.join(b, "_g"), (df.groupBy("_g").agg(F.max("_n").alias(f"_{x}")) for x, df in zip("lr", sides, strict=True)))
    groups = groups.select("_g", *(c for x in "lr" for c in (size(f"_{x}").alias(f"_{x}_rows"), F.floor((F.col(f"_{x}") - 1) / size(f"_{x}")).alias(f"_{x}_last"))))
    last = groups.agg(F.max(F.col("_l_last") + F.col("_r_last"))).first()[0]
    place = lambda x: F.floor((F.col("_n") - 1) / F.col(f"_{x}_rows")).cast("int").alias("_c")
    l, r = (spool(df.join(groups, "_g").select(f"{x}_row", "_g", "_v", "_n", place(x), F.col(f"_{y}_last").alias("_last"))) for x, y, df in (("l", "r", sides[0]), ("r", "l", sides[1])))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("_n"), b.sort_values("_n")
        pairs = _greedy(list(map(tuple, a["_v"])), list(map(tuple, b["_v"])))
        return pd.DataFrame({"l_row": a["l_row"].take([i for i, _ in pairs]).to_numpy(), "r_row": b["r_row"].take([j for _, j in pairs]).to_numpy()})

    folder, read = new_folder(l.sparkSession), l.sparkSession.read.schema(schema)
    if last is None:
        return l.sparkSession.createDataFrame([], schema)
    for n in range(last + 1):
        other = F.lit(n) - F.col("_c")
        at = [df.where(other.between(0, F.col("_last"))) for df in (l, r)]
        if n:
            found = read.parquet(*(f"{folder}/round={i}" for i in range(n)))
            at = [df.join(found, f"{x}_row", "left_anti") for x, df in zip("lr", at, strict=True)]
        at = (at[0].withColumn("_d", other), at[1].withColumn("_d", F.col("_c")))
        new = at[0].groupBy("_g", "_d").cogroup(at[1].groupBy("_g", "_d")).applyInPandas(meet, schema)
        if last == 0:
            return new
        new.write.parquet(f"{folder}/round={n}")
    return read.parquet(*(f"{folder}/round={i}" for i in range(last + 1)))


def pair_in_phases(left: DataFrame, right: DataFrame, phases: list[Column], row: str) -> DataFrame:
    """l_row, r_row and phase: each phase pairs, by an expression over a row, what no phase before
    it has paired; rows of one key pair in order of ``row``, and each row is used once."""
    done: list[DataFrame] = []
    for n, key in enumerate(phases, 1):
        sides = []
        for name, df in (("l", left), ("r", right)):
            keyed = df.select(F.col(row), key.alias("_key")).where("_key is not null")
            sides.append(numbered(keyed, ["_key"], [F.col(row)]).withColumnRenamed(row, f"{name}_row"))
        met = sides[0].join(sides[1], ["_key", "_n"]).select("l_row", "r_row", F.lit(n).alias("phase"))
        done.append(met)
        left = left.join(met.select(F.col("l_row").alias(row)), row, "left_anti")
        right = right.join(met.select(F.col("r_row").alias(row)), row, "left_anti")
    return reduce(DataFrame.unionByName, done)


def cells(paired: DataFrame, keys: list[str], values: list[str], tokens: list | None = None) -> DataFrame:
    """A row for each key and compared column: column_name and status; the cells of a row that
    stands alone are missing (it was expected) or extra. tokens: as in :func:`cell_status`. Cells
    become rows first, so the forms are columns and the plan's code doesn't grow with ``values``."""
    each = F.array(*(F.struct(F.lit(v).alias("column_name"), *(F.col(f"{x}_{v}").cast("string").alias(f"_{x}") for x in "lr")) for v in values))
    long = paired.select(*keys, "_n", "in_l", "in_r", F.inline(each))
    long = long.withColumns({f"_t{x}": tidy_cell(F.col(f"_{x}")) for x in "lr"}).withColumns({f"_f{x}": normal_of(F.col(f"_t{x}")) for x in "lr"})
    alone = F.when(~F.col("in_l"), "extra").when(~F.col("in_r"), "missing")
    return long.select(*keys, "_n", "column_name", F.coalesce(alone, status_of(*(F.col(c) for c in ("_l", "_r", "_fl", "_fr")), tokens)).alias("status"))


def score(found: DataFrame) -> DataFrame:
    """Counts of each status, and the percentage of cells that are exact or normalized: 100 where
    nothing was compared."""
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    sums = found.agg(F.count("*").alias("scored"), *map(count, ("exact", "normalized", "mismatch", "missing", "extra")))
    return sums.withColumn("score", F.when(F.col("scored") == 0, 100.0).otherwise(F.round(100.0 * (F.col("exact") + F.col("normalized")) / F.col("scored"), 1)))


def schema_diff(deployed: DataFrame, expected: DataFrame) -> DataFrame:
    """Of (position, name, type) rows, those on one side only: side, position, name and type."""
    both = [d.select("position", "name", "type", F.lit(True).alias(f"has_{s}")) for d, s in ((deployed, "l"), (expected, "r"))]
    joined = both[0].join(both[1], ["position", "name", "type"], "full_outer")
    return joined.where("has_l is null or has_r is null").select(F.when(F.col("has_r").isNull(), "deployed").otherwise("expected").alias("side"), "position", "name", "type")


def column_digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, filled and an order-free digest of the values of each column: sums of two hashes,
    in which repeated values count as often as they stand there."""
    def digest(c: str) -> Column:
        text = F.col(c).cast("string")
        sums = [F.coalesce(F.sum(F.xxhash64(text, F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 2)]
        return F.concat_ws(":", *sums)

    sums = df.agg(*(F.struct(F.count(c).alias("filled"), digest(c).alias("digest")).alias(c) for c in columns))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.filled").alias("filled"), F.col(f"{c}.digest").alias("digest")) for c in columns))))


def structural(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and grade: SAME, WARN (values differ, as many filled) or HARD (not as many)."""
    a, b = (column_digests(d, columns).select("column_name", F.col("filled").alias(f"filled_{s}"), F.col("digest").alias(f"digest_{s}")) for d, s in ((left, "l"), (right, "r")))
    grade = F.when(F.col("filled_l") != F.col("filled_r"), "HARD").when(F.col("digest_l") != F.col("digest_r"), "WARN").otherwise("SAME")
    return a.join(b, "column_name").select("column_name", grade.alias("grade"))
