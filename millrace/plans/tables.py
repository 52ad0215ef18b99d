"""Target tables from a feed's lists: schemas of their kinds, and CREATE TABLE IF NOT EXISTS."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from millrace.plans.contract import Feed, spark_type

_AUDIT = "src_file_name string, code string, created timestamp, updated timestamp"


def schemas(feed: Feed) -> dict[str, StructType]:
    """stage (all text), standard (typed), errors, processed and recycle."""
    stage = ", ".join(f"`{f.stage}` string" for f in feed.fields)
    typed = ", ".join(f"`{f.standard}` {spark_type(f.type)}" for f in feed.fields)
    ddl = {
        "stage": f"{stage}, {_AUDIT}",
        "standard": f"{typed}, {_AUDIT}",
        "errors": "error_type string, key_masked string, column_name string, src_file_name string, created timestamp",
        "processed": "src_file_name string, loaded bigint, rejected bigint, recycled bigint, created timestamp, updated timestamp",
        "recycle": f"{stage}, {_AUDIT}, first_seen timestamp, status string",
    }
    return {k: StructType.fromDDL(v) for k, v in ddl.items()}


def create_statement(name: str, schema: StructType, comments: dict[str, str] | None = None) -> str:
    """The statement for a Parquet table; comments go with their columns."""
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" + (f" COMMENT {quoted(comments[f.name])}" if comments and f.name in comments else "") for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"


def create_tables(spark: SparkSession, feed: Feed, database: str, comments: dict[str, str] | None = None) -> list[str]:
    """Makes the feed's five tables, and one for rejected records, where they don't exist, and returns
    their names."""
    names, kinds = [], schemas(feed)
    for kind, schema in (kinds | {"rejects": reject_schema(kinds["standard"])}).items():
        names.append(f"{database}.{feed.name}_{kind}")
        spark.sql(create_statement(names[-1], schema, comments))
    return names


def reject_schema(standard: StructType, kind: DataType | str = "string", extra: str = "reject_reason string") -> StructType:
    """The standard columns, all of one type, as a rejected record may hold anything; then ``extra``."""
    one = StructType.fromDDL(f"x {kind}").fields[0].dataType if isinstance(kind, str) else kind
    return StructType([*(StructField(f.name, one) for f in standard.fields), *StructType.fromDDL(extra).fields])
