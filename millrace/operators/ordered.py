"""Ordinals, fills, neighbours and running sums within keys, of which one may hold most of the rows.

A window takes a key's rows into one task. That is right for keys of a usual size. Rows of hot keys
are dealt by ranges of key and order instead, so a key lies in as many chunks as it needs, in order.
A chunk is worked on by itself, and what it must know of the chunks before it (how many rows, the
last value, the sum) is a row a chunk and key, which a window over those few rows passes on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scratch import spool

#: Rows from which on a key is hot, and rows of a chunk, about.
HOT, CHUNK = 1_000_000, 250_000
#: Rows that a task sorts, about, and parts of all keys by which hot ones are looked for.
TASK, BUCKETS = 2_000_000, 4096


def same(a: str, b: str, keys: list[str]) -> Column:
    """Null keys are keys."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def hot_keys(df: DataFrame, keys: list[str], hot: int) -> tuple[int, DataFrame | None]:
    """The number of rows, and the keys with more than ``hot`` of them with theirs, _rows; None if there
    are none. Rows are counted by parts of the keys first, so not every key is held; only keys of parts
    that are over ``hot`` are counted themselves."""
    if not keys:
        n = df.count()
        return n, df.sparkSession.range(1).select(F.lit(n).alias("_rows")) if n > hot else None
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counts = {r[0]: r[1] for r in df.select(bucket.alias("_bucket")).groupBy("_bucket").count().collect()}
    large = [b for b, n in counts.items() if n > hot]
    if not large:
        return sum(counts.values()), None
    found = spool(df.where(bucket.isin(*large)).groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot))
    return sum(counts.values()), None if found.isEmpty() else found


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` dealt by ``keys`` to so many tasks that each has TASK rows, if the session's number is too
    small for that."""
    tasks = -(-rows // TASK)
    return df.repartition(tasks, *keys) if keys and tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def chunked(df: DataFrame, keys: list[str], order: list[Column], rows: int, chunk: int = CHUNK) -> DataFrame:
    """``df`` (``rows`` of it) with _chunk and _tie: chunks are in the order of ``keys`` and ``order``, and
    rows that ``order`` leaves equal are told apart by _tie. It is written, as neither is repeatable."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(max(2, -(-rows // chunk)), *keys, *order, "_tie")
    return spool(dealt.withColumn("_chunk", F.spark_partition_id()))


def _in_chunk(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy("_chunk", *keys).orderBy(*order, "_tie")


def _carried(cut: DataFrame, keys: list[str], own: dict[str, Column], carry: dict[str, Callable[[Window], Column]]) -> DataFrame:
    """``cut`` with what the chunks before a row's say of its key: ``own`` are aggregates of a chunk
    and key, and ``carry`` combines those of the earlier chunks over a window of a row a chunk."""
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_chunk", *keys).agg(*(c.alias(n) for n, c in own.items()))
    known = sums.select("_chunk", *keys, *(f(before).alias(n) for n, f in carry.items()))
    return cut.alias("l").join(known.alias("r"), (F.col("l._chunk") == F.col("r._chunk")) & same("l", "r", keys), "left").select("l.*", *(f"r.{n}" for n in carry))


def parted(df: DataFrame, keys: list[str], hot: int, plain: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``plain`` of the rows of usual keys and ``large`` (with their number) of those of hot ones."""
    every, found = hot_keys(df, keys, hot)
    if found is None:
        return plain(spread(df, keys, every))
    n = found.agg(F.sum("_rows")).first()[0]
    if not keys:
        return large(df, n)
    mine = same("l", "r", keys)
    rest = df.alias("l").join(found.alias("r"), mine, "left_anti")
    return plain(spread(rest, keys, every - n)).unionByName(large(df.alias("l").join(found.alias("r"), mine, "left_semi"), n))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "_n", hot: int = HOT) -> DataFrame:
    """``df`` with the number of each row within its key, from 1. Rows that ``order`` leaves equal are
    numbered in any order."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def large(rows: DataFrame, n: int) -> DataFrame:
        cut = _carried(chunked(rows, keys, order, n), keys, {"_c": F.count("*")}, {"_earlier": lambda w: F.sum("_c").over(w)})
        at = F.row_number().over(_in_chunk(keys, order)) + F.coalesce("_earlier", F.lit(0))
        return cut.withColumn(name, at.cast("int")).select(*rows.columns, name)

    return parted(df, keys, hot, plain, large)


def filled(df: DataFrame, keys: list[str], order: list[Column], column: str, value: Column, hot: int = HOT) -> DataFrame:
    """``df`` with ``column`` as the last ``value`` that isn't null, of the row's own and those above it."""

    def plain(rows: DataFrame) -> DataFrame:
        above = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(column, F.last(value, ignorenulls=True).over(above))

    def large(rows: DataFrame, n: int) -> DataFrame:
        cut = chunked(rows.withColumn("_value", value), keys, order, n)
        cut = cut.withColumn("_last", F.last("_value", ignorenulls=True).over(_in_chunk(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
        # a chunk's last value is that of its last row, which has the greatest place
        cut = cut.withColumn("_place", F.row_number().over(_in_chunk(keys, order)))
        cut = _carried(cut, keys, {"_end": F.max_by("_last", "_place")}, {"_earlier": lambda w: F.last("_end", ignorenulls=True).over(w)})
        return cut.withColumn(column, F.coalesce("_last", "_earlier")).select(*rows.columns, *([] if column in rows.columns else [column]))

    return parted(df, keys, hot, plain, large)


def with_previous(df: DataFrame, keys: list[str], order: list[Column], columns: dict[str, str], hot: int = HOT) -> DataFrame:
    """``df`` with the values of the row above, null in a key's first: ``columns`` gives the new names."""

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({new: F.lag(c).over(w) for c, new in columns.items()})

    def large(rows: DataFrame, n: int) -> DataFrame:
        cut = chunked(rows, keys, order, n)
        own = F.struct(*(F.col(c) for c in columns))
        cut = cut.withColumns({"_row": own, "_above": F.lag(own).over(_in_chunk(keys, order)), "_place": F.row_number().over(_in_chunk(keys, order))})
        cut = _carried(cut, keys, {"_end": F.max_by("_row", "_place")}, {"_earlier": lambda w: F.last("_end").over(w)})
        above = F.when(F.col("_place") == 1, F.col("_earlier")).otherwise(F.col("_above"))
        return cut.withColumn("_above", above).select(*rows.columns, *(F.col(f"_above.{c}").alias(new) for c, new in columns.items()))

    return parted(df, keys, hot, plain, large)


def with_running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, hot: int = HOT) -> DataFrame:
    """``df`` with the sum of ``value`` over the row and those above it, as a long."""

    def plain(rows: DataFrame) -> DataFrame:
        above = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(value.cast("long")).over(above))

    def large(rows: DataFrame, n: int) -> DataFrame:
        cut = chunked(rows.withColumn("_value", value.cast("long")), keys, order, n)
        cut = cut.withColumn("_sum", F.sum("_value").over(_in_chunk(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
        cut = _carried(cut, keys, {"_whole": F.sum("_value")}, {"_earlier": lambda w: F.sum("_whole").over(w)})
        return cut.withColumn(name, F.col("_sum") + F.coalesce("_earlier", F.lit(0))).select(*rows.columns, name)

    return parted(df, keys, hot, plain, large)
