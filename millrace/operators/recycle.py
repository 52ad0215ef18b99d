"""Rows that miss a reference lookup wait in a recycle table until the reference has them or their
time is up. Every function takes the run's time, so a rerun gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.upsert import insert_only

PENDING, PROCESSED, EXPIRED = "PENDING", "PROCESSED", "EXPIRED"


def reference_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed ids. No hint: the size of a reference is for the planner to find out."""
    return df.select(F.trim(F.col(column).cast("string")).alias("_id")).where("_id is not null").distinct()


def lookup(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose trimmed key is among ``ids``, and the others (a null key is one of those)."""
    same = F.trim(F.col(key).cast("string")) == F.col("_id")
    return df.join(ids, same, "left_semi"), df.join(ids, same, "left_anti")


def send(recycle: DataFrame, unmatched: DataFrame, keys: list[str], run_ts: str) -> DataFrame:
    """Adds unmatched rows as pending. A row that is there already keeps its first-seen time and its
    status, whatever it is."""
    fresh = unmatched.withColumns({"first_seen": F.lit(run_ts).cast("timestamp"), "status": F.lit(PENDING)})
    return insert_only(recycle, fresh, keys)


def marked(recycle: DataFrame, key: str, ids: DataFrame, run_ts: str, days: int) -> DataFrame:
    """The table with _now, the status of each row after the run: pending rows in the window that the
    reference now has are processed; pending rows before the window expire."""
    cutoff = F.lit(run_ts).cast("timestamp") - F.make_interval(days=F.lit(days))
    found = recycle.join(ids, F.trim(F.col(key).cast("string")) == F.col("_id"), "left")
    waiting = F.col("status") == PENDING
    now = F.when(waiting & (F.col("first_seen") < cutoff), EXPIRED).when(waiting & F.col("_id").isNotNull(), PROCESSED).otherwise(F.col("status"))
    return found.withColumn("_now", now).drop("_id")


def settled(marked: DataFrame) -> DataFrame:
    """The table after the run."""
    return marked.withColumn("status", F.col("_now")).drop("_now")


def returned(marked: DataFrame) -> DataFrame:
    """The rows to load."""
    return marked.where((F.col("status") == PENDING) & (F.col("_now") == PROCESSED)).drop("_now", "first_seen", "status")


def retry(recycle: DataFrame, key: str, ids: DataFrame, run_ts: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(recycle table after the run, rows to load); see :func:`marked`."""
    found = marked(recycle, key, ids, run_ts, days)
    return settled(found), returned(found)


def carry_rejects(held: DataFrame, rejects: DataFrame, keys: list[str], run_date: str, days: int) -> DataFrame:
    """The other policy: this run's rejects replace the table, but keep the time at which they were
    first held; what is older than the window drops out."""
    first = held.groupBy(*keys).agg(F.min("recycled_at").alias("_first"))
    now = rejects.join(first, keys, "left").withColumn("recycled_at", F.coalesce("_first", F.lit(run_date).cast("date"))).drop("_first")
    return now.where(F.col("recycled_at") >= F.date_sub(F.lit(run_date).cast("date"), days))


def backlog(held: DataFrame, run_ts: str, days: int) -> DataFrame:
    """Held rejects in the window, to be tried again with a run's own records."""
    return held.where(F.to_date("recycled_at") >= F.date_sub(F.to_date(F.lit(run_ts)), days))


def kept_rejects(rejects: DataFrame, held: DataFrame | None, keys: list[str], run_ts: str) -> DataFrame:
    """The table after a run of that policy: its rejects, each with the time at which it was first
    held: its own, if it was retried, or that of the row it had before, or the run's. Equal rejects
    are rejects each."""
    now = F.lit(run_ts).cast("timestamp")
    mine = rejects if "recycled_at" in rejects.columns else rejects.withColumn("recycled_at", F.lit(None).cast("timestamp"))
    if held is not None:
        first = held.groupBy(*keys).agg(F.min("recycled_at").alias("_first")).alias("h")
        same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys))
        mine = mine.alias("r").join(first, same, "left").select("r.*", "_first").withColumn("recycled_at", F.coalesce("recycled_at", "_first")).drop("_first")
    return mine.withColumn("recycled_at", F.coalesce("recycled_at", now))
