"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOCAL_DIR = "/tmp/millrace-checkpoints"
#: Rows that a plan holds as a literal; more are a file.
MOST_LITERAL = 4096
_cleared: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a local one will do if
    driver and executors are one process; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own. What is written there is deleted when the driver's Python ends, or by
    :func:`clear`."""
    if (app := spark.sparkContext.applicationId) not in _cleared:
        _cleared.add(app)
        atexit.register(_at_end, spark)
    return f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost
    executor costs no recomputation. The files live until :func:`clear`."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows that the driver holds, a few for each shard, node or source, as one JSON literal that
    the JVM reads, or as a file, where they are many; no Python runs on the executors for it."""
    if len(rows) > MOST_LITERAL:
        real = [f.dataType.typeName() in ("double", "float") for f in StructType.fromDDL(ddl).fields]
        exact = [tuple(float(x) if r and x is not None else x for r, x in zip(real, row, strict=True)) for row in rows]
        return spool(spark.createDataFrame(exact, StructType.fromDDL(ddl)), "rows")
    names = [f.name for f in StructType.fromDDL(ddl).fields]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in StructType.fromDDL(ddl).fields)}>>")))


def _at_end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        clear(spark)


def clear(spark: SparkSession) -> None:
    """Deletes everything that :func:`spool` and the archives wrote in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def widened(df: DataFrame, keep: tuple[str, ...], ddl: str) -> StructType:
    """The schema of the columns ``keep`` of ``df``, then those of ``ddl``."""
    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(ddl).fields])
