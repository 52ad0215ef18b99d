"""Upserts as DataFrame algebra: anti-joins, unions and, of several sources, precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateSourceKey(ValueError):
    """Several source rows would update one target row."""


def _same(keys: list[str], null_safe: bool) -> Column:
    pair = (lambda k: F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))) if null_safe else (lambda k: F.col(f"s.{k}") == F.col(f"t.{k}"))
    return reduce(lambda a, b: a & b, map(pair, keys))


def merge(target: DataFrame, source: DataFrame, keys: list[str], created: str | None = None, null_safe: bool = True, check: bool = True) -> DataFrame:
    """Target rows without a source row, and all source rows; a matched one keeps the target's
    ``created``. Without ``null_safe``, rows with a null key never match and are always added.
    ``check``: several source rows for a key that the target has are an error."""
    same = _same(keys, null_safe)
    if check:
        twice = source.groupBy(*keys).count().where("count > 1")
        if not twice.alias("s").join(target.alias("t"), same, "left_semi").isEmpty():
            raise DuplicateSourceKey(", ".join(keys))
    kept = target.alias("t").join(source.select(*keys).alias("s"), same, "left_anti")
    if created is None:
        return kept.unionByName(source)
    old = target.groupBy(*keys).agg(F.min(created).alias("_created")).alias("t")
    fresh = source.alias("s").join(old, same, "left").select(*(F.coalesce("t._created", f"s.{c}").alias(c) if c == created else F.col(f"s.{c}").alias(c) for c in source.columns))
    return kept.unionByName(fresh)


def merge_in_order(target: DataFrame | None, sources: list[DataFrame], keys: list[str], created: str | None = None) -> DataFrame:
    """The target upserted by each source in turn, in one pass: of each key the rows of the last
    source that has it stay, all of them, or the target's if none has, with the ``created`` of the
    first that had it. Null keys are keys. Columns are the target's and those that sources add. The
    rows are aggregated a key before anything is joined."""
    sides = ([] if target is None else [target]) + sources
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("_rank", F.lit(n)) for n, df in enumerate(sides)])
    own = [F.max("_rank").alias("_last"), F.min(F.struct("_rank", F.col(created) if created else F.lit(None).alias("none"))).alias("_first")]
    ends = every.groupBy(*keys).agg(*own).withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)))
    kept = every.join(ends, same & (F.col("_rank") == F.col("_last")))
    if created:
        kept = kept.withColumn(created, F.when(F.col("_rank") > F.col("_first._rank"), F.col(f"_first.{created}")).otherwise(F.col(created)))
    return kept.select(*(c for c in every.columns if c != "_rank"))


def insert_only(target: DataFrame, source: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """The target, and the source rows whose key it lacks; nothing that is there changes."""
    return target.unionByName(source.alias("s").join(target.select(*keys).alias("t"), _same(keys, null_safe), "left_anti"))


def replace_where(target: DataFrame, source: DataFrame, column: str, value: object) -> DataFrame:
    """The target without its rows of ``value``, and the source: a file's rows, or a partition's. A
    blank value, or NA, is no partition and replaces nothing: that is an error."""
    if value is None or str(value).strip().upper() in ("", "NA", "N/A"):
        raise ValueError(f"no value of {column} to replace: {value!r}")
    return target.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(source)


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` in its order; those that ``df`` lacks are null, others are dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields))


def load(target: DataFrame | None, source: DataFrame, option: str, keys: list[str] | None = None, null_safe: bool = False) -> DataFrame:
    """What the table holds after a load by ``option``: overwrite, append, or upsert (merge)."""
    option = {"merge": "upsert"}.get(option.strip().lower(), option.strip().lower())
    if option not in ("overwrite", "append", "upsert"):
        raise ValueError(f"unknown load option {option!r}")
    if option == "upsert" and not keys:
        raise ValueError("an upsert needs a key")
    if target is None or option == "overwrite":
        return source
    return target.unionByName(source) if option == "append" else merge(target, source, keys, null_safe=null_safe)
