"""Mandatory fields, rejects, masks at egress, cast audits and check results.

A check never runs a job a column: counts of all columns are one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.cells import any_of, blank, guarded_cast, lost, mask_last


def split_mandatory(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all of ``columns``, and those with a blank one. Without columns, all are good."""
    bad = any_of([blank(c) for c in columns])
    return df.where(~bad), df.where(bad)


def reject_reason(columns: list[str]) -> Column:
    """The blank ones of ``columns`` in their order, joined by commas."""
    return F.concat_ws(",", *(F.when(blank(c), F.lit(c)) for c in columns))


def reject_rows(df: DataFrame, columns: list[str], key: str, keep: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each rejected row and blank column, with the key masked, and the columns
    ``carry``: one pass, no union."""
    failed = F.filter(F.array(*(F.when(blank(c), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    shown = F.coalesce(mask_last(F.when(~blank(key), F.col(key)), keep), F.lit("<null>"))
    return df.select(F.lit("NOT_NULL").alias("error_type"), shown.alias("key_masked"), F.explode(failed).alias("column_name"), *carry)


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, rows and blanks of each column, from one aggregate."""
    counts = df.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(blank(c).cast("long")), F.lit(0)).alias(c) for c in columns))
    return counts.select("rows", F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("column_name", "blanks"))


def cast_losses(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """column_name, to_type and rows_lost of each column that a cast would lose values of."""
    counts = df.agg(*(F.coalesce(F.sum(lost(c, t).cast("long")), F.lit(0)).alias(c) for c, t in types.items()))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("to_type"), F.col(c).alias("rows_lost")) for c, t in types.items()))
    return counts.select(F.inline(each)).where("rows_lost > 0")


class LossyCast(ValueError):
    """A load would have dropped unreadable values."""


def cast_columns(df: DataFrame, types: dict[str, str], check: bool = True) -> DataFrame:
    """The columns of ``types`` cast. With ``check`` a value that can't be read stops the load, with
    the columns and row counts named but no value shown."""
    if check and (found := cast_losses(df, types).collect()):  # a row a column at most
        raise LossyCast("; ".join(f"{r.column_name} as {r.to_type}: {r.rows_lost} rows" for r in found))
    return df.withColumns({c: guarded_cast(c, t) for c, t in types.items()})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.col("_n").alias("n") if "n" not in keys else "_n")


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``, which must be total for a repeatable choice."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def deduplicated(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(:func:`dedup` of ``df``, and rows_before, rows_after and removed): the count comes from the
    groups' sizes, so the rows aren't chosen twice."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after"))
    return dedup(df, keys, order), counts.withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def verdict(passed: Column) -> Column:
    return F.when(passed, "PASS").otherwise("FAIL")


def self_check(df: DataFrame, test_id: str, found: Column, expected: Column, no_data: Column | None = None) -> DataFrame:
    """test_id, result (PASS, FAIL or NO DATA), found and expected, as one row over all of ``df``."""
    row = df.agg(F.count("*").alias("_rows"), found.cast("long").alias("found"), expected.cast("long").alias("expected"))
    empty = F.col("_rows") == 0 if no_data is None else no_data
    return row.select(F.lit(test_id).alias("test_id"), F.when(empty, "NO DATA").otherwise(verdict(F.col("found") == F.col("expected"))).alias("result"), "found", "expected")


def dq_checks(df: DataFrame, required: list[str], keys: list[str], reported: int) -> DataFrame:
    """name, passed and detail: the row count against the reported one, blanks of each required
    column, and groups of duplicate keys. Two aggregates in all."""
    blanks = blank_counts(df, required)
    counted = blanks.select("rows").limit(1).select(F.lit("row_count").alias("name"), (F.col("rows") == reported).alias("passed"), F.concat(F.lit("rows="), F.col("rows")).alias("detail"))
    each = blanks.select(F.concat(F.lit("not_null:"), "column_name").alias("name"), (F.col("blanks") == 0).alias("passed"), F.concat(F.lit("blank="), F.col("blanks")).alias("detail"))
    repeated = duplicate_keys(df, keys).agg(F.count("*").alias("groups")).select(F.lit("unique_key").alias("name"), (F.col("groups") == 0).alias("passed"), F.concat(F.lit("groups="), F.col("groups")).alias("detail"))
    return counted.unionByName(each).unionByName(repeated)


def dq_checks_by(df: DataFrame, by: str, required: list[str], keys: list[str], counts: DataFrame) -> DataFrame:
    """The same checks for each group of ``by``, such as a file: ``by``, name, passed and detail.
    ``counts`` has ``by`` and reported, the rows that each group should have; a group without rows
    has 0. Three aggregates, however many groups there are."""
    sums = df.groupBy(by).agg(F.count("*").alias("rows"), *(F.sum(blank(c).cast("long")).alias(f"_blank_{i}") for i, c in enumerate(required)))
    met = counts.select(by, "reported").join(sums, by, "left").na.fill(0)
    twice = df.groupBy(by, *(k for k in keys if k != by)).agg(F.count("*").alias("_n")).groupBy(by).agg(F.sum((F.col("_n") > 1).cast("long")).alias("groups")) if keys else None
    met = met.join(twice, by, "left").withColumn("groups", F.coalesce("groups", F.lit(0))) if keys else met
    row = lambda name, passed, what, n: F.struct(F.lit(name).alias("name"), passed.alias("passed"), F.concat(F.lit(f"{what}="), n).alias("detail"))
    found = [row("row_count", F.col("rows") == F.col("reported"), "rows", F.col("rows"))]
    found += [row(f"not_null:{c}", F.col(f"_blank_{i}") == 0, "blank", F.col(f"_blank_{i}")) for i, c in enumerate(required)]
    found += [row("unique_key", F.col("groups") == 0, "groups", F.col("groups"))] if keys else []
    return met.select(by, F.inline(F.array(*found)))


def overall(checks: DataFrame, flags: int = 0) -> DataFrame:
    """FAIL if a check failed, PASS_WITH_FLAGS if something is flagged, else PASS."""
    failed = F.coalesce(F.sum((~F.col("passed")).cast("int")), F.lit(0))
    return checks.agg(F.when(failed > 0, "FAIL").when(F.lit(flags) > 0, "PASS_WITH_FLAGS").otherwise("PASS").alias("verdict"), failed.cast("long").alias("failed"))


def key_check(df: DataFrame, test_id: str, keys: list[str]) -> DataFrame:
    """Whether no two rows share a key; NO DATA for an empty table, which has no group at all."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return self_check(groups, test_id, F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)), F.lit(0))


def count_check(spark: SparkSession, view: str, test_id: str, expected: int) -> DataFrame:
    """The rows of a view or table against a bound parameter, as SQL."""
    sql = "SELECT :id AS test_id, CASE WHEN n = 0 THEN 'NO DATA' WHEN n = :expected THEN 'PASS' ELSE 'FAIL' END AS result, n AS found, CAST(:expected AS BIGINT) AS expected FROM (SELECT count(*) AS n FROM IDENTIFIER(:view))"
    return spark.sql(sql, args={"id": test_id, "expected": expected, "view": view})


def load_strategy_check(first: DataFrame, second: DataFrame, after: DataFrame, strategy: str, keys: list[str]) -> DataFrame:
    """The rows that a table must have after a second load: of the second alone (replace), of both
    (add), or one a distinct key of either (upsert)."""
    both = first.select(*keys).unionByName(second.select(*keys))
    rows = {"replace": second, "add": both, "upsert": both.distinct()}
    if strategy not in rows:
        raise ValueError(f"unknown load strategy {strategy!r}")
    sides = after.select(F.lit(1).alias("_found"), F.lit(0).alias("_expected")).unionByName(rows[strategy].select(F.lit(0).alias("_found"), F.lit(1).alias("_expected")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = sides.agg(total("_found").alias("found"), total("_expected").alias("expected"))
    result = F.when(F.col("found") == 0, "NO DATA").otherwise(verdict(F.col("found") == F.col("expected")))
    return found.select(F.lit(f"second_load_{strategy}").alias("test_id"), result.alias("result"), "found", "expected")


def ordered_list(df: DataFrame, group: list[str], value: str, out: str, separator: str = ", ") -> DataFrame:
    """The values of each group in order, as one text."""
    return df.groupBy(*group).agg(F.concat_ws(separator, F.array_sort(F.collect_list(value))).alias(out))


def any_nullable(df: DataFrame, column: str, nullable: str) -> DataFrame:
    """column, nullable (in any region) and state: proposed where the regions disagree, else filled."""
    sums = df.groupBy(column).agg(F.bool_or(nullable).alias("nullable"), F.bool_and(nullable).alias("_all"))
    return sums.select(column, "nullable", F.when(F.col("nullable") == F.col("_all"), "filled").otherwise("proposed").alias("state"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def table_checks(spark: SparkSession, names: list[str]) -> list[tuple[str, bool, int, int]]:
    """name, whether the table exists, and of its columns how many there are and have a comment."""
    out = []
    for name in names:
        there = spark.catalog.tableExists(name)
        columns = spark.catalog.listColumns(name) if there else []
        out.append((name, there, len(columns), sum(bool(c.description) for c in columns)))
    return out
