"""Deployed tables against the expected ones: the catalogue as one DataFrame, joined with what a
contract states, and a row for each table and check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COLUMNS = "table_name string, position int, column_name string, type string, comment string"
TABLES = "table_name string, comment string"
TAGS = "table_name string, tag string, value string"
TAG_PREFIX = "tag."


def deployed(spark: SparkSession, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, tables and tags (table properties that begin with TAG_PREFIX) of those of ``names`` that
    exist, views too. Metadata is the driver's; each table is looked up once."""
    columns, tables, tags = [], [], []
    for name in names:
        if not spark.catalog.tableExists(name):
            continue
        shown = spark.catalog.getTable(name)
        tables.append((name, shown.description))
        columns += [(name, i, c.name, c.dataType, c.description) for i, c in enumerate(spark.catalog.listColumns(name), 1)]
        if shown.tableType not in ("TEMPORARY", "VIEW"):
            tags += [(name, r.key.removeprefix(TAG_PREFIX), r["value"]) for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r.key.startswith(TAG_PREFIX)]
    return spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(tables, TABLES), spark.createDataFrame(tags, TAGS)


def expected(spark: SparkSession, schemas: dict[str, StructType]) -> DataFrame:
    """COLUMNS of what a contract states."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.metadata.get("comment")) for name, schema in schemas.items() for i, f in enumerate(schema.fields, 1)]
    return spark.createDataFrame(rows, COLUMNS)


def _row(check: str, passed: Column, found: Column, wanted: Column) -> list[Column]:
    return ["table_name", F.lit(check).alias("check"), F.when(passed, "PASS").otherwise("FAIL").alias("result"), found.cast("string").alias("found"), wanted.cast("string").alias("expected")]


def table_checks(there: tuple[DataFrame, DataFrame, DataFrame], columns: DataFrame, comments: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """table_name, check, result (PASS or FAIL), found and expected, a row for each table of ``columns``
    and check: table_exists; columns_match, by position, name and type without case and space, where
    found lists the differences; comments_present, the number of columns with a comment;
    table_comment for tables of ``comments`` (TABLES); and table_tags for those of ``tags`` (TAGS),
    of which others may be there too."""
    own, tables, tagged = there
    names = columns.select("table_name").distinct()
    exists = names.join(tables.select("table_name", F.lit(1).alias("_n")), "table_name", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    out = exists.select(*_row("table_exists", F.col("_n") == 1, F.col("_n"), F.lit(1)))

    key = [F.col("table_name"), F.col("position"), F.lower("column_name").alias("column_name"), F.regexp_replace(F.lower("type"), r"\s", "").alias("type")]
    sides = [df.select(*key, F.lit(True).alias(s)) for df, s in ((own.join(names, "table_name", "left_semi"), "_deployed"), (columns, "_stated"))]
    odd = sides[0].join(sides[1], ["table_name", "position", "column_name", "type"], "full_outer").where("_deployed is null or _stated is null")
    said = F.concat_ws(" ", F.when(F.col("_stated").isNull(), "deployed").otherwise("DDL"), "position", "column_name", "type")
    listed = names.join(odd.select("table_name", said.alias("_d")), "table_name", "left").groupBy("table_name").agg(F.concat_ws(", ", F.array_sort(F.collect_list("_d"))).alias("_d"))
    out = out.unionByName(listed.select(*_row("columns_match", F.col("_d") == "", F.when(F.col("_d") == "", "0 differences").otherwise(F.col("_d")), F.lit("0 differences"))))

    count = lambda df, n: df.groupBy("table_name").agg(F.count("comment").alias(n))
    both = count(columns, "_wanted").join(count(own, "_found"), "table_name", "left").withColumn("_found", F.coalesce("_found", F.lit(0)))
    out = out.unionByName(both.select(*_row("comments_present", F.col("_found") == F.col("_wanted"), F.col("_found"), F.col("_wanted"))))
    if comments is not None:
        met = comments.withColumnRenamed("comment", "_wanted").join(tables.withColumnRenamed("comment", "_found"), "table_name", "left")
        out = out.unionByName(met.select(*_row("table_comment", F.col("_found").eqNullSafe(F.col("_wanted")), F.coalesce("_found", F.lit("(no table comment)")), F.col("_wanted"))))
    if tags is not None:
        text = F.concat_ws(", ", F.array_sort(F.collect_list(F.concat("tag", F.lit(" = "), "value"))))
        met = tags.withColumn("_w", F.lit(1)).join(tagged.withColumn("_f", F.lit(1)), ["table_name", "tag", "value"], "left")
        right = met.groupBy("table_name").agg(F.count_if(F.col("_f").isNull()).alias("_missing"), text.alias("_wanted"))
        right = right.join(tagged.groupBy("table_name").agg(text.alias("_found")), "table_name", "left")
        out = out.unionByName(right.select(*_row("table_tags", F.col("_missing") == 0, F.coalesce("_found", F.lit("")), F.col("_wanted"))))
    return out
