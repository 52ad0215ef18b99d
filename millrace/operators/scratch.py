"""Intermediate tables in the folder that the cluster names. They go when the driver's Python ends."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "/tmp/millrace-checkpoints"
_known: set[str] = set()


def home(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; where the session names none, a local
    one will do if driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or LOCAL_DIR).rstrip('/')}/millrace-tables-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A path of its own, which nobody has written to."""
    if (app := spark.sparkContext.applicationId) not in _known:
        _known.add(app)
        atexit.register(_at_end, spark)
    return f"{home(spark)}/{uuid.uuid4().hex}"


def spool(df: DataFrame) -> DataFrame:
    """``df`` written and read again: lineage ends there, and what isn't repeatable in it is settled."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written here."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        clear(spark)
