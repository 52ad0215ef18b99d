"""The file path as a stream: files that arrive in a folder load batch by batch through the same
functions, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.quality import split_mandatory
from millrace.plans.contract import Feed
from millrace.plans.ingest import Ingest, Tables, ingest_files
from millrace.sources import files


def stream_stage(spark: SparkSession, feed: Feed, folder: str, checkpoint: str, load: Callable[[DataFrame, DataFrame, int], None]) -> StreamingQuery:
    """Calls ``load`` (good rows, rejected rows, batch number) for each batch of new files, and
    stops when all that is there has been loaded; the checkpoint keeps a file from loading twice."""
    schema = ", ".join(f"`{f.source}` string" for f in feed.fields)
    lines = spark.readStream.schema(schema).option("header", True).option("sep", feed.delimiter).option("enforceSchema", False).csv(folder)
    rows = lines.select(*(F.col(f.source).alias(f.stage) for f in feed.fields), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("src_file_name"))

    def each(batch: DataFrame, number: int) -> None:
        load(*split_mandatory(batch, feed.mandatory), number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(
    spark: SparkSession, feed: Feed, folder: str, checkpoint: str, tables: Tables, run_ts: Callable[[int], str], reference: Callable[[], DataFrame] | None = None, per_batch: int = 1000,
    then: Callable[[int, list[Ingest]], None] | None = None,
) -> StreamingQuery:
    """Whole loads of the files that arrive in ``folder``, ``per_batch`` at most at a time, with drift,
    rejects and recycling; stops when all that is there has been loaded. ``run_ts`` gives a batch's
    time from its number, so a batch that is played again is the same.

    Each batch loads once, whenever the stream is killed: what a table has of a batch, under the
    checkpoint's name and the batch's number, it doesn't take again, and a batch whose files are
    recorded as processed is over. The stream itself reads the files' names only; ``then`` gets each
    batch's results (none, if it was over). Files whose names fit no pattern are left alone.
    """
    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(folder).select("path")

    def each(batch: DataFrame, number: int) -> None:
        fits = [p for p in sorted(r.path for r in batch.collect()) if any(files.name_pattern(x).match(p.rpartition("/")[2]) for x in feed.patterns)]  # per_batch names
        done = ingest_files(spark, feed, fits, tables, run_ts(number), None if reference is None else reference(), batch=(checkpoint, number)) if fits else []
        if then is not None:
            then(number, done)

    return seen.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
