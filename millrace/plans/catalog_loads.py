"""Registered queries of whole runs: many files, reloads, rejects that are tried again, tables of parts
and upserts by precedence."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from millrace.operators import drift, parttable, quality, scratch, upsert
from millrace.operators.rules import Rule
from millrace.plans import ingest
from millrace.plans.catalog import _BLANKED, _FEED, _GOOD, _REF, _REF2, RUN_TS, _delivered, _headed, _landed, _ref, query
from millrace.plans.contract import Feed, Field, Segment

LATER = "2026-01-16 09:00:00"
_MANY = replace(_FEED, patterns=("file=orders_CCYYMMDD.csv",), allow_duplicates=False)


@query(f"""WITH y AS (SELECT ORDER_DATE[1:4] AS y, count(*) AS n, count(*) FILTER (WHERE {_GOOD}) AS good FROM ({_BLANKED}) GROUP BY 1), f AS (SELECT min(y) AS a, max(y) AS b FROM y)
SELECT 'file=orders_' || y || '0101.csv' AS file, CASE WHEN y = a THEN 'SKIPPED_DUPLICATE' WHEN y = b THEN 'DRIFT_FAIL' ELSE 'LOADED' END AS status,
  CASE WHEN y < b THEN good END AS loaded, CASE WHEN y < b THEN n - good END AS rejected, CASE WHEN y < b THEN good ELSE 0 END AS in_stage FROM y, f""")
def ingest_many(table):
    """A file a year in one run: the first was loaded before, the last lacks a column."""
    rows = _headed(table).withColumn("_year", F.substring("o_orderdate", 1, 4))
    first, last = rows.agg(F.min("_year"), F.max("_year")).first()
    spark, root = rows.sparkSession, scratch.new_folder(rows.sparkSession)
    named = rows.withColumn("file", F.concat(F.lit("orders_"), "_year", F.lit("0101.csv")))
    for part, mode in ((named.where(F.col("_year") != last).drop("_year"), "error"), (named.where(F.col("_year") == last).drop("_year", "o_totalprice"), "append")):
        part.repartition("file").write.mode(mode).partitionBy("file").option("header", True).csv(f"{root}/landing")
    tables = ingest.Tables(spark, f"{root}/tables")
    paths = [f"{root}/landing/file=orders_{r[0]}0101.csv" for r in rows.select("_year").distinct().orderBy("_year").collect()]  # a row a file
    ingest.ingest_file(spark, _MANY, paths[0], tables, RUN_TS)
    done = ingest.ingest_files(spark, _MANY, paths, tables, LATER)
    statuses = spark.createDataFrame([(r.file, r.status) for r in done], "file string, status string")
    stage = tables.stage.read().groupBy(F.col("src_file_name").alias("file")).agg(F.count("*").alias("in_stage"))
    log = tables.processed.read().select(F.col("src_file_name").alias("file"), "loaded", "rejected")
    return statuses.join(log, "file", "left").join(stage, "file", "left").select("file", "status", "loaded", "rejected", F.coalesce("in_stage", F.lit(0)).alias("in_stage"))


@query(f"""WITH g AS (SELECT ORDER_KEY AS k, CUST_KEY AS c FROM ({_BLANKED}) WHERE {_GOOD})
SELECT 'stage' AS what, k, '2026-01-15 09:00:00' AS at FROM g WHERE c IN ({_REF2}) OR c IN ({_REF})
UNION ALL SELECT CASE WHEN c IN ({_REF2}) THEN 'PROCESSED' ELSE 'PENDING' END, k, '2026-01-15 09:00:00' FROM g WHERE c NOT IN ({_REF})""")
def ingest_reload(table):
    """A file that is loaded again when the reference knows more: rows that waited and that the file
    has too are one row each."""
    feed = replace(_FEED, reference_key="CUST_KEY")
    tables, path = _landed(_headed(table), "orders_20260115.csv", True)
    more = table("customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").cast("string").alias("_id")).distinct()
    # what came back keeps the time of the run that first read it
    ingest.ingest_file(tables.spark, feed, path, tables, RUN_TS, _ref(table))
    ingest.ingest_file(tables.spark, feed, path, tables, LATER, more)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("at")
    stage = tables.stage.read().select(F.lit("stage").alias("what"), F.col("ORDER_KEY").alias("k"), at("created"))
    return stage.unionByName(tables.recycle.read().select(F.col("status").alias("what"), F.col("ORDER_KEY").alias("k"), at("first_seen")))


@query(f"""WITH b AS (SELECT *, CASE WHEN STATUS = 'O' THEN 'orders_20260101.csv' ELSE 'orders_20260102.csv' END AS f FROM ({_BLANKED})), r AS (SELECT * FROM b WHERE NOT coalesce({_GOOD}, false))
SELECT 'stage' AS what, f AS file, count(*) AS n FROM b WHERE {_GOOD} GROUP BY 2 UNION ALL SELECT 'rejects', f, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'waiting', f, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'counted', f, count(*) FROM r GROUP BY 2""")
def ingest_retry_rejects(table):
    """Two files whose rejects wait for the next run: each stays with its own file."""
    feed, rows = replace(_FEED, retry_rejects=True), _headed(table)
    spark, root = rows.sparkSession, scratch.new_folder(rows.sparkSession)
    tables = ingest.Tables(spark, f"{root}/tables")
    for name, part, ts in (("orders_20260101.csv", rows.where("o_orderstatus = 'O'"), RUN_TS), ("orders_20260102.csv", rows.where("o_orderstatus <> 'O'"), LATER)):
        part.write.option("header", True).csv(f"{root}/landing/{name}")
        ingest.ingest_file(spark, feed, f"{root}/landing/{name}", tables, ts)
    of = lambda what, df: df.groupBy(F.lit(what).alias("what"), F.col("src_file_name").alias("file")).agg(F.count("*").alias("n"))
    counted = tables.processed.read().select(F.lit("counted").alias("what"), F.col("src_file_name").alias("file"), F.col("rejected").alias("n"))
    return of("stage", tables.stage.read()).unionByName(of("rejects", tables.rejects.read())).unionByName(of("waiting", tables.recycle.read())).unionByName(counted)


_PLAIN = Feed(
    "customers", (Field("key", "KEY", "cust_key", "bigint", mandatory=True, key=True), Field("name", "NAME", "name"), Field("segment", "SEGMENT", "segment"), Field("balance", "BALANCE", "balance", "decimal(12,2)")), patterns=("customers.dat",),
    delimiter="|", header=False, footer=True, rules=(Rule("lr_trim", ("NAME",)), Rule("null_check", ("SEGMENT",)), Rule("lr_trim", ("segment",)), Rule("no_such_rule")),
)


@query("""SELECT c_custkey AS cust_key, c_name AS name, c_mktsegment AS segment, c_acctbal::DECIMAL(12,2) AS balance, 'LOADED' AS status FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT NULL, 'rejected', NULL, count(*) FILTER (WHERE c_nationkey = 3), 'no_such_rule: no such rule' FROM customer""")
def ingest_plain(table):
    """A file without a header, whose last record is a footer, with rules on both legs."""
    c = table("customer")
    lines = c.select(F.col("c_custkey").alias("k"), F.concat_ws("|", "c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")), F.when(F.col("c_nationkey") == 3, "").otherwise(F.concat(F.lit(" "), "c_mktsegment")), F.col("c_acctbal").cast("decimal(12,2)")).alias("value"))
    ends = c.agg(F.max("c_custkey").alias("k"), F.concat(F.lit("END|"), F.count("*")).alias("value")).withColumn("k", F.col("k") + 1)
    # a footer is the last record of its file, so the file is written by one task
    tables, path = _landed(lines.unionByName(ends).coalesce(1).sortWithinPartitions("k").select("value"), "customers.dat", False)
    done = ingest.ingest_file(tables.spark, _PLAIN, path, tables, RUN_TS)
    rows = ingest.standard(tables.stage.read(), _PLAIN).select("cust_key", "name", "segment", "balance", F.lit(done.status).alias("status"))
    told = tables.rejects.read().where("reject_reason = 'rule'").agg(F.count("*").cast("decimal(12,2)").alias("balance"))
    return rows.unionByName(told.select(F.lit(None).cast("bigint").alias("cust_key"), F.lit("rejected").alias("name"), F.lit(None).cast("string").alias("segment"), "balance", F.lit("; ".join(done.not_done)).alias("status")))


_POSITIONED = Feed(
    "positioned", _PLAIN.fields[:3], patterns=("customers.txt",), delimiter="|", segments=(Segment("Header", None, (Field("title", "TITLE", "title"),)), Segment("Trailer", "END", (Field("mark", "MARK", "mark"), Field("records", "RECORDS", "records")))), trailer=("Trailer", "RECORDS"),
)


@query("""SELECT 'Detail' AS segment, c_custkey::VARCHAR AS k, c_name AS v FROM customer UNION ALL SELECT 'Header', 'customers by key', NULL UNION ALL SELECT 'Trailer', 'END', count(*)::VARCHAR FROM customer UNION ALL SELECT 'status', 'LOADED', NULL""")
def ingest_by_position(table):
    """A file whose first record is its header and whose trailer is told by its mark."""
    c = table("customer")
    lines = c.select(F.col("c_custkey").alias("k"), F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    ends = c.agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b"), F.count("*").alias("n")).select(F.inline(F.array(F.struct((F.col("a") - 1).alias("k"), F.lit("customers by key").alias("value")), F.struct((F.col("b") + 1).alias("k"), F.concat(F.lit("END|"), "n").alias("value")))))
    tables, path = _landed(lines.unionByName(ends).coalesce(1).sortWithinPartitions("k").select("value"), "customers.txt", False)
    done = ingest.ingest_file(tables.spark, _POSITIONED, path, tables, RUN_TS)
    none = F.lit(None).cast("string").alias("v")
    rows = tables.stage.read().select(F.lit("Detail").alias("segment"), F.col("KEY").alias("k"), F.col("NAME").alias("v"))
    rows = rows.unionByName(tables.of("header").read().select(F.lit("Header").alias("segment"), F.col("TITLE").alias("k"), none))
    rows = rows.unionByName(tables.of("trailer").read().select(F.lit("Trailer").alias("segment"), F.col("MARK").alias("k"), F.col("RECORDS").alias("v")))
    return rows.unionByName(tables.spark.range(1).select(F.lit("status").alias("segment"), F.lit(done.status).alias("k"), none))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'f.dat' ELSE 'o.dat' END AS file, count(*) FILTER (WHERE length(o_orderkey::VARCHAR || '|' || o_orderpriority) < 12) AS short_rows FROM orders GROUP BY 1 HAVING short_rows > 0")
def short_lines(table):
    """Files with lines below a fixed width."""
    lines = table("orders").select(F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("value"), F.when(F.col("o_orderstatus") == "F", "f.dat").otherwise("o.dat").alias("_source_file"))
    return drift.short_lines(lines, 12).select(F.col("_source_file").alias("file"), "short_rows")


@query("SELECT c_custkey, 'new' AS side FROM customer WHERE c_acctbal < 0")
def load_overwrite(table):
    c = table("customer").select("c_custkey", "c_acctbal")
    return upsert.load(c.select("c_custkey", F.lit("old").alias("side")), c.where("c_acctbal < 0").select("c_custkey", F.lit("new").alias("side")), "overwrite")


@query("""WITH c AS (SELECT count(*) FILTER (WHERE c_name IS NULL) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS flags FROM customer)
SELECT CASE WHEN n > 0 THEN 'FAIL' WHEN flags > 0 THEN 'PASS_WITH_FLAGS' ELSE 'PASS' END AS verdict, (n > 0)::BIGINT AS failed FROM c""")
def verdict_with_flags(table):
    """Checks that pass, and rows that are flagged."""
    c = table("customer")
    return quality.overall(quality.blank_counts(c, ["c_name"]).select((F.col("blanks") == 0).alias("passed")), c.where("c_acctbal < 0").count())


@query("""SELECT o_orderpriority AS part, count(*) AS n, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN -o_custkey ELSE o_custkey END)::BIGINT AS total FROM orders WHERE o_orderpriority <> '5-LOW' AND (o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F') GROUP BY 1
UNION ALL SELECT 'folders', 1, 1""")
def table_parts(table):
    """A part a priority, of which one is replaced and one is emptied, then all written again as one."""
    o = table("orders").select(F.col("o_orderpriority").alias("p"), "o_orderkey", "o_custkey", "o_orderstatus")
    parts = parttable.VersionedTable(o.sparkSession, scratch.new_folder(o.sparkSession))
    parts.put(o, "p", [r.p for r in o.select("p").distinct().collect()])  # a row a part
    parts.put(o.where("p = '1-URGENT' and o_orderstatus = 'F'").withColumn("o_custkey", -F.col("o_custkey")), "p", ["1-URGENT"])
    parts.put(o.limit(0), "p", ["5-LOW"])
    parts.compact()
    sums = parts.read().groupBy(F.col("p").alias("part")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))
    folders = len(set(parts.parts(["1-URGENT", "2-HIGH"]).values()))
    return sums.unionByName(o.sparkSession.range(1).select(F.lit("folders").alias("part"), F.lit(folders).cast("bigint").alias("n"), F.lit(len(parts.has(["5-LOW"]))).cast("bigint").alias("total")))


@query("""SELECT o_orderkey AS k, 'target' AS v, 2020 AS born FROM orders WHERE o_orderstatus = 'P' AND NOT (o_orderpriority IN ('1-URGENT', '2-HIGH'))
UNION ALL SELECT o_orderkey, 'first', CASE WHEN o_orderstatus = 'P' THEN 2020 ELSE 2021 END FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, 'second', CASE WHEN o_orderstatus = 'P' THEN 2020 WHEN o_orderpriority = '1-URGENT' THEN 2021 ELSE 2022 END FROM orders WHERE o_orderpriority = '2-HIGH' OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def merge_in_order(table):
    """A target and two sources in one pass: the later one wins, with the year of the first that had it."""
    o = table("orders")
    side = lambda df, v, born: df.select(F.col("o_orderkey").alias("k"), F.lit(v).alias("v"), F.lit(born).alias("born"))
    first, second = o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '2-HIGH' or (o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
    return upsert.merge_in_order(side(o.where("o_orderstatus = 'P'"), "target", 2020), [side(first, "first", 2021), side(second, "second", 2022)], ["k"], "born")


@query(f"""SELECT 'o_custkey' AS column_name, count(*) FILTER (WHERE CUST_KEY IS NOT NULL AND trim(CUST_KEY) <> '' AND TRY_CAST(CUST_KEY AS TINYINT) IS NULL) AS lost FROM ({_BLANKED}) HAVING lost > 0
UNION ALL SELECT 'priority', count(PRIORITY) FROM ({_BLANKED})""")
def gold_cast_audit(table):
    """What a gold plan's types can't hold; a plan with losses stops unless its caller says otherwise."""
    from millrace.plans import gold
    from millrace.plans.contract import Value

    columns = (gold.GoldColumn("o_custkey", "tinyint", Value("CUST_KEY")), gold.GoldColumn("priority", "int", Value("PRIORITY")), gold.GoldColumn("status", "string", Value("STATUS")), gold.GoldColumn("total", "decimal(18,2)", Value("TOTAL")))
    return gold.cast_audit(gold.GoldFeed("orders", columns, (gold.SourceSet("o"),)), {"o": _delivered(table)}).select("column_name", F.col("rows_lost").alias("lost"))


