"""The registered queries for the engine's own operators, with their SQL.

Each applies one operator to whole tables. Blank and repeated values, which the tables lack, are
derived in the query by rules that SQL shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import cells
from millrace.operators import closure, compare, drift, profile, quality, recycle, rules, upsert
from millrace.plans import gold, ingest
from millrace.plans.contract import Feed, Field, Segment, Value
from millrace.sources import files, segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RUN_TS = "2026-01-15 09:00:00"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ORDERS = Feed(
    "orders",
    (
        Field("o_orderkey", "ORDER_KEY", "order_key", "bigint", mandatory=True, key=True),
        Field("o_custkey", "CUST_KEY", "cust_key", "bigint", mandatory=True),
        Field("o_orderstatus", "STATUS", "status", "string"),
        Field("o_totalprice", "TOTAL", "total", "decimal(18,2)"),
        Field("o_orderdate", "ORDER_DATE", "order_date", "date"),
        Field("o_orderpriority", "PRIORITY", "priority", "string", mandatory=True),
    ),
    reference_key="CUST_KEY",
)

#: Orders as a feed delivers them: text, with blank priorities and keys at fixed places.
_BLANKED = """SELECT o_orderkey::VARCHAR AS ORDER_KEY, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_custkey::VARCHAR END AS CUST_KEY,
  o_orderstatus AS STATUS, o_totalprice::DECIMAL(18,2)::VARCHAR AS TOTAL, strftime(o_orderdate, '%Y-%m-%d') AS ORDER_DATE,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS PRIORITY FROM orders"""


def _delivered(table: Callable[[str], DataFrame]) -> DataFrame:
    o = table("orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("ORDER_KEY"), F.when(F.col("o_orderkey") % 11 == 0, "  ").otherwise(F.col("o_custkey").cast("string")).alias("CUST_KEY"),
        F.col("o_orderstatus").alias("STATUS"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("TOTAL"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ORDER_DATE"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("PRIORITY"),
    )


_GOOD = "PRIORITY IS NOT NULL AND trim(PRIORITY) <> '' AND trim(CUST_KEY) <> ''"


@query(f"""SELECT ORDER_KEY::BIGINT AS order_key, CUST_KEY::BIGINT AS cust_key, STATUS AS status, TOTAL::DECIMAL(18,2) AS total,
  ORDER_DATE::DATE AS order_date, PRIORITY AS priority FROM ({_BLANKED}) WHERE {_GOOD}""")
def standard_orders(table):
    good, _ = quality.split_mandatory(_delivered(table), ORDERS.mandatory)
    return ingest.standard(good, ORDERS, check=False)


@query(f"SELECT CASE WHEN {_GOOD} THEN 'good' ELSE 'rejected' END AS part, count(*) AS n FROM ({_BLANKED}) GROUP BY 1")
def orders_not_null_split(table):
    good, bad = quality.split_mandatory(_delivered(table), ORDERS.mandatory)
    return good.select(F.lit("good").alias("part")).unionByName(bad.select(F.lit("rejected").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_orderkey::VARCHAR AS k, l_linenumber AS n, nullif(l_returnflag, 'R') AS mode FROM lineitem),
g AS (SELECT count(*) AS n FROM (SELECT 1 FROM l GROUP BY k, n HAVING count(*) > 1))
SELECT 'row_count' AS name, count(*) = 60000 AS passed, 'rows=' || count(*) AS detail FROM l
UNION ALL SELECT 'not_null:k', count(*) FILTER (WHERE k IS NULL) = 0, 'blank=' || count(*) FILTER (WHERE k IS NULL) FROM l
UNION ALL SELECT 'not_null:mode', count(*) FILTER (WHERE mode IS NULL) = 0, 'blank=' || count(*) FILTER (WHERE mode IS NULL) FROM l
UNION ALL SELECT 'unique_key', n = 0, 'groups=' || n FROM g""")
def dq_checks(table):
    rows = table("lineitem").select(F.col("l_orderkey").cast("string").alias("k"), F.col("l_linenumber").alias("n"), F.nullif("l_returnflag", F.lit("R")).alias("mode"))
    return quality.dq_checks(rows, ["k", "mode"], ["k", "n"], 60000)


@query("""WITH l AS (SELECT nullif(l_returnflag, 'R') AS mode FROM lineitem), f AS (SELECT count(*) FILTER (WHERE mode IS NULL) AS n FROM l)
SELECT CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, (n > 0)::BIGINT AS failed FROM f""")
def verdict_lattice(table):
    rows = table("lineitem").select(F.nullif("l_returnflag", F.lit("R")).alias("mode"))
    blanks = quality.blank_counts(rows, ["mode"])
    return quality.overall(blanks.select((F.col("blanks") == 0).alias("passed")))


@query(f"""SELECT 'NOT_NULL' AS error_type, repeat('*', greatest(length(ORDER_KEY) - 4, 0)::BIGINT) || CASE WHEN length(ORDER_KEY) <= 4 THEN repeat('*', length(ORDER_KEY)::BIGINT) ELSE right(ORDER_KEY, 4) END AS key_masked, c AS column_name
FROM (SELECT *, 'CUST_KEY' AS c FROM ({_BLANKED}) WHERE trim(CUST_KEY) = '' UNION ALL SELECT *, 'PRIORITY' FROM ({_BLANKED}) WHERE PRIORITY IS NULL)""")
def reject_rows(table):
    return quality.reject_rows(_delivered(table), ORDERS.mandatory, "ORDER_KEY")


@query(f"SELECT ORDER_KEY, concat_ws(',', CASE WHEN trim(CUST_KEY) = '' THEN 'CUST_KEY' END, CASE WHEN PRIORITY IS NULL THEN 'PRIORITY' END) AS reason FROM ({_BLANKED}) WHERE NOT ({_GOOD}) OR PRIORITY IS NULL")
def reject_reason(table):
    _, bad = quality.split_mandatory(_delivered(table), ORDERS.mandatory)
    return bad.select("ORDER_KEY", quality.reject_reason(ORDERS.mandatory).alias("reason"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)::BIGINT) ELSE repeat('*', (length(c_name) - 4)::BIGINT) || right(c_name, 4) END AS masked FROM customer")
def mask_last4(table):
    return table("customer").select("c_custkey", cells.mask_last("c_name").alias("masked"))


@query(f"""SELECT count(*) AS rows, 'CUST_KEY' AS column_name, count(*) FILTER (WHERE trim(CUST_KEY) = '') AS blanks FROM ({_BLANKED})
UNION ALL SELECT count(*), 'PRIORITY', count(*) FILTER (WHERE PRIORITY IS NULL) FROM ({_BLANKED})""")
def blank_counts(table):
    return quality.blank_counts(_delivered(table), ["CUST_KEY", "PRIORITY"])


_TYPED = "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'x' || p_size ELSE p_size::VARCHAR END AS a, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2020-01-' || lpad((p_partkey % 40)::VARCHAR, 2, '0') END AS d FROM part"


def _typed(table):
    k = F.col("p_partkey")
    return table("part").select(k.alias("k"), F.when(k % 5 == 0, F.concat(F.lit("x"), F.col("p_size"))).otherwise(F.col("p_size").cast("string")).alias("a"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("2020-01-"), F.lpad((k % 40).cast("string"), 2, "0"))).alias("d"))


@query(f"SELECT k, TRY_CAST(a AS INT) AS a, TRY_CAST(nullif(d, '') AS DATE) AS d FROM ({_TYPED})")
def guarded_cast(table):
    return quality.cast_columns(_typed(table), {"a": "int", "d": "date"}, check=False)


@query(f"""SELECT * FROM (SELECT 'a' AS column_name, 'int' AS to_type, count(*) FILTER (WHERE TRY_CAST(a AS INT) IS NULL) AS rows_lost FROM ({_TYPED})
UNION ALL SELECT 'd', 'date', count(*) FILTER (WHERE d <> '' AND TRY_CAST(d AS DATE) IS NULL) FROM ({_TYPED})) WHERE rows_lost > 0""")
def cast_loss_audit(table):
    return quality.cast_losses(_typed(table), {"a": "int", "d": "date"})


_REF = "SELECT DISTINCT c_custkey::VARCHAR AS id FROM customer WHERE c_mktsegment = 'BUILDING'"


def _ref(table):
    return recycle.reference_ids(table("customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey::VARCHAR IN ({_REF})")
def lookup_matched(table):
    return recycle.lookup(table("orders").select("o_orderkey", "o_custkey"), "o_custkey", _ref(table))[0]


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey::VARCHAR NOT IN ({_REF})")
def lookup_unmatched(table):
    return recycle.lookup(table("orders").select("o_orderkey", "o_custkey"), "o_custkey", _ref(table))[1]


_HELD = f"""SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2026-01-08 08:59:59' ELSE TIMESTAMP '2026-01-08 09:00:00' END AS first_seen,
  CASE WHEN o_orderkey % 5 = 0 THEN 'PROCESSED' ELSE 'PENDING' END AS status FROM orders WHERE o_orderpriority <> '5-LOW' AND o_custkey::VARCHAR NOT IN ({_REF})"""
_REF2 = "SELECT DISTINCT c_custkey::VARCHAR AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


def _held(table):
    missed = recycle.lookup(table("orders").where("o_orderpriority <> '5-LOW'"), "o_custkey", _ref(table))[1]
    seen = F.when(F.col("o_orderkey") % 3 == 0, F.lit("2026-01-08 08:59:59")).otherwise(F.lit("2026-01-08 09:00:00")).cast("timestamp")
    return missed.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), seen.alias("first_seen"), F.when(F.col("o_orderkey") % 5 == 0, "PROCESSED").otherwise("PENDING").alias("status"))


@query(f"""WITH held AS ({_HELD}) SELECT k, c, first_seen::VARCHAR AS first_seen, status FROM held
UNION ALL SELECT DISTINCT o_orderkey, o_custkey, '2026-01-15 09:00:00', 'PENDING' FROM orders WHERE o_custkey::VARCHAR NOT IN ({_REF}) AND o_orderkey NOT IN (SELECT k FROM held)""")
def recycle_send(table):
    missed = recycle.lookup(table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), "c", _ref(table))[1]
    out = recycle.send(_held(table), missed, ["k"], RUN_TS)
    return out.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


@query(f"""SELECT k, c, first_seen::VARCHAR AS first_seen, CASE WHEN status = 'PENDING' AND first_seen < TIMESTAMP '2026-01-08 09:00:00' THEN 'EXPIRED'
  WHEN status = 'PENDING' AND c::VARCHAR IN ({_REF2}) THEN 'PROCESSED' ELSE status END AS status FROM ({_HELD})""")
def recycle_retry(table):
    ids = recycle.reference_ids(table("customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')"), "c_custkey")
    return recycle.retry(_held(table), "c", ids, RUN_TS, 7)[0].withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT k, c FROM ({_HELD}) WHERE status = 'PENDING' AND first_seen >= TIMESTAMP '2026-01-08 09:00:00' AND c::VARCHAR IN ({_REF2})")
def recycle_returned(table):
    ids = recycle.reference_ids(table("customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')"), "c_custkey")
    return recycle.retry(_held(table), "c", ids, RUN_TS, 7)[1]


# The same over the whole table: what an order's status and date say, for every order that missed.

_HELD_WHOLE = f"""SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN month(o_orderdate) <= 6 THEN TIMESTAMP '2026-01-08 08:59:59' ELSE TIMESTAMP '2026-01-08 09:00:00' END AS first_seen,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'PROCESSED' ELSE 'PENDING' END AS status FROM orders WHERE o_orderstatus <> 'O' AND o_custkey::VARCHAR NOT IN ({_REF})"""


def _held_whole(table):
    missed = recycle.lookup(table("orders").where("o_orderstatus <> 'O'"), "o_custkey", _ref(table))[1]
    seen = F.when(F.month("o_orderdate") <= 6, F.lit("2026-01-08 08:59:59")).otherwise(F.lit("2026-01-08 09:00:00")).cast("timestamp")
    return missed.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), seen.alias("first_seen"), F.when(F.col("o_orderpriority") == "1-URGENT", "PROCESSED").otherwise("PENDING").alias("status"))


@query(f"""WITH held AS ({_HELD_WHOLE}) SELECT k, c, first_seen::VARCHAR AS first_seen, status FROM held
UNION ALL SELECT DISTINCT o_orderkey, o_custkey, '2026-01-15 09:00:00', 'PENDING' FROM orders WHERE o_custkey::VARCHAR NOT IN ({_REF}) AND o_orderkey NOT IN (SELECT k FROM held)""")
def recycle_send_whole(table):
    missed = recycle.lookup(table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), "c", _ref(table))[1]
    out = recycle.send(_held_whole(table), missed, ["k"], RUN_TS)
    return out.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


@query(f"""SELECT k, c, first_seen::VARCHAR AS first_seen, CASE WHEN status = 'PENDING' AND first_seen < TIMESTAMP '2026-01-08 09:00:00' THEN 'EXPIRED'
  WHEN status = 'PENDING' AND c::VARCHAR IN ({_REF2}) THEN 'PROCESSED' ELSE status END AS status FROM ({_HELD_WHOLE})""")
def recycle_retry_whole(table):
    ids = recycle.reference_ids(table("customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')"), "c_custkey")
    return recycle.retry(_held_whole(table), "c", ids, RUN_TS, 7)[0].withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT k, c FROM ({_HELD_WHOLE}) WHERE status = 'PENDING' AND first_seen >= TIMESTAMP '2026-01-08 09:00:00' AND c::VARCHAR IN ({_REF2})")
def recycle_returned_whole(table):
    ids = recycle.reference_ids(table("customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')"), "c_custkey")
    return recycle.retry(_held_whole(table), "c", ids, RUN_TS, 7)[1]


@query("""WITH h AS (SELECT c_custkey AS k, DATE '2026-01-01' + (c_custkey % 14)::INT AS at FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT c_custkey AS k, c_name AS v, coalesce(h.at, DATE '2026-01-15') AS recycled_at FROM customer LEFT JOIN h ON c_custkey = h.k WHERE c_custkey % 3 = 0)
SELECT k, v, recycled_at FROM r WHERE recycled_at >= DATE '2026-01-08'""")
def recycle_carry(table):
    c = table("customer")
    held = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 14).cast("int")).alias("recycled_at"))
    rejects = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return recycle.carry_rejects(held, rejects, ["k"], "2026-01-15", 7).select("k", "v", "recycled_at")


# Target: customers as first loaded. Source: those changed in the next load, and new ones.
_T = "SELECT CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey END AS k, c_name AS v, 1 AS created, 'f' || c_nationkey AS file FROM customer WHERE c_custkey % 3 <> 0"
_S = "SELECT c_custkey AS k, upper(c_name) || '!' AS v, 2 AS created, 'f' || c_nationkey AS file FROM customer WHERE c_custkey % 2 = 0"


def _target(table):
    k = F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_custkey"))
    return table("customer").where("c_custkey % 3 <> 0").select(k.alias("k"), F.col("c_name").alias("v"), F.lit(1).alias("created"), F.concat(F.lit("f"), "c_nationkey").alias("file"))


def _source(table):
    return table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.concat(F.upper("c_name"), F.lit("!")).alias("v"), F.lit(2).alias("created"), F.concat(F.lit("f"), "c_nationkey").alias("file"))


@query(f"""WITH t AS ({_T}), s AS ({_S}) SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k IS NOT DISTINCT FROM t.k)
UNION ALL SELECT s.k, s.v, coalesce((SELECT min(t.created) FROM t WHERE t.k IS NOT DISTINCT FROM s.k), s.created), s.file FROM s""")
def upsert_merge(table):
    return upsert.merge(_target(table), _source(table), ["k"], "created")


@query(f"WITH t AS ({_T}), s AS ({_S}) SELECT * FROM t WHERE k IS NULL OR k NOT IN (SELECT k FROM s) UNION ALL SELECT * FROM s")
def upsert_plain(table):
    return upsert.load(_target(table), _source(table), "merge", ["k"])


@query(f"WITH t AS ({_T}), s AS ({_S}) SELECT * FROM t UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k IS NOT DISTINCT FROM s.k)")
def upsert_insert_only(table):
    return upsert.insert_only(_target(table), _source(table), ["k"])


@query(f"WITH t AS ({_T}), s AS ({_S}) SELECT * FROM t WHERE file <> 'f3' UNION ALL SELECT * FROM s WHERE file = 'f3'")
def replace_by_file(table):
    return upsert.replace_where(_target(table), _source(table).where("file = 'f3'"), "file", "f3")


@query(f"WITH t AS ({_T}), s AS ({_S}) SELECT * FROM t UNION ALL SELECT * FROM s")
def load_append(table):
    return upsert.load(_target(table), _source(table), "append")


@query(f"WITH t AS ({_T}) SELECT k, v, created, NULL::VARCHAR AS note FROM t")
def align_columns(table):
    t = _target(table)
    return upsert.align(t, t.select("k", "v", "created", F.lit(None).cast("string").alias("note")))


@query("SELECT s_suppkey, trim(s_name) AS s_name, s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0")
def rules_trim_and_null_check(table):
    s = table("supplier").select("s_suppkey", F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("s_name"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(None)).otherwise(F.col("s_nationkey").cast("string")).alias("n"), "s_nationkey")
    return rules.apply_rules(s, [rules.Rule("lr_trim", ("s_name",)), rules.Rule("null_check", ("n",))]).rows.drop("n")


@query("SELECT k, strftime(TRY_CAST(nullif(d, '') AS DATE), '%d/%m/%Y') AS d FROM (" + _TYPED + ")")
def rules_date_format(table):
    return rules.apply_rules(_typed(table).select("k", "d"), [rules.Rule("date_format", ("d",), {"format": "yyyy-MM-dd", "to": "dd/MM/yyyy"})]).rows


@query("SELECT k, TRY_CAST(nullif(d, '') AS DATE) AS d FROM (" + _TYPED + ")")
def rules_date_conversion(table):
    return rules.apply_rules(_typed(table).select("k", "d"), [rules.Rule("date_conversion", ("d",), {"format": "yyyy-MM-dd"})]).rows


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS n
FROM lineitem) WHERE n = 1""")
def rules_dedup(table):
    rows = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rules.apply_rules(rows, [rules.Rule("dedup", ("l_orderkey", "l_linenumber"))]).rows


@query("SELECT n_nationkey, n_name, 'EAST' AS zone FROM nation")
def rules_custom_columns(table):
    return rules.apply_rules(table("nation").select("n_nationkey", "n_name"), [rules.Rule("add_custom_columns", ("zone",), {"values": ["EAST"]})]).rows


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(table):
    return quality.duplicate_keys(table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'required_populated' AS test_id, CASE WHEN count(*) = 0 THEN 'NO DATA' WHEN count(*) FILTER (WHERE p_name IS NULL OR p_brand IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS result, count(*) FILTER (WHERE p_name IS NULL OR p_brand IS NULL) AS found, 0::BIGINT AS expected FROM part")
def check_required_populated(table):
    missing = F.sum((F.col("p_name").isNull() | F.col("p_brand").isNull()).cast("long"))
    return quality.self_check(table("part"), "required_populated", missing, F.lit(0))


@query("SELECT 'record_count' AS test_id, CASE WHEN count(*) = 0 THEN 'NO DATA' WHEN count(*) = 2000 THEN 'PASS' ELSE 'FAIL' END AS result, count(*) AS found, 2000::BIGINT AS expected FROM part")
def check_record_count(table):
    return quality.self_check(table("part"), "record_count", F.count("*"), F.lit(2000))


@query("""SELECT 'second_load_distinct_keys' AS test_id, CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'PASS' ELSE 'FAIL' END AS result,
count(*) AS found, count(DISTINCT (l_orderkey, l_linenumber)) AS expected FROM lineitem""")
def check_load_strategy(table):
    return quality.self_check(table("lineitem"), "second_load_distinct_keys", F.count("*"), F.count_distinct("l_orderkey", "l_linenumber"))


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def ordered_list(table):
    both = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return quality.ordered_list(both, ["r_name"], "n_name", "nations")


# Gold plans.


def _filled(x):
    return Value(x)


@query("""SELECT o_orderkey AS order_id, c_name AS customer, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS band,
substr(c_name, 1, 4) AS head, (o_orderstatus || '/' || o_orderpriority) AS code, o_totalprice::DECIMAL(18,2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'F'""")
def gold_orders(table):
    band = cells.chain([(F.col("o_totalprice") > 200000, F.lit("large")), (F.col("o_totalprice") > 50000, F.lit("medium"))], F.lit("small"))
    feed = gold.GoldFeed(
        "gold_orders",
        (
            gold.GoldColumn("order_id", "bigint", _filled("o_orderkey")), gold.GoldColumn("customer", "string", _filled("c_name")), gold.GoldColumn("band", "string", _filled(band)),
            gold.GoldColumn("head", "string", _filled(cells.piece(F.col("c_name"), 1, 4))), gold.GoldColumn("code", "string", _filled(cells.joined(F.col("o_orderstatus"), F.lit("/"), F.col("o_orderpriority")))),
            gold.GoldColumn("total", "decimal(18,2)", _filled("o_totalprice")),
        ),
        (gold.SourceSet("orders", (gold.Join("customer", on=(("o_custkey", "c_custkey"),)),), (_filled(cells.one_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])), _filled(F.col("o_orderstatus") == "F"))),),
    )
    return gold.build(feed, {"orders": table("orders"), "customer": table("customer")})


@query("""SELECT n_name AS name, 'nation' AS kind FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' OR r_name IS NULL
UNION ALL SELECT r_name, 'region' FROM region""")
def gold_source_sets(table):
    sets = [("nation", "n_name"), ("region", "r_name")]
    rows = {k: table(k) for k, _ in sets}
    feed = lambda base, name, joins, filters: gold.GoldFeed("places", (gold.GoldColumn("name", "string", _filled(name)), gold.GoldColumn("kind", "string", _filled(f"'{base}'"))), (gold.SourceSet(base, joins, filters),))
    join = (gold.Join("region", "left", on=(("n_regionkey", "r_regionkey"),)),)
    return gold.build(feed("nation", "n_name", join, (_filled("r_name <> 'ASIA' OR r_name IS NULL"),)), rows).unionByName(gold.build(feed("region", "r_name", (), ()), rows))


@query("""SELECT o_orderkey, coalesce(p, 'none') AS a, coalesce(nullif(e, ''), 'empty') AS b, nullif(e, '') IS NULL AS c, e = '' AS d FROM
(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS e FROM orders)""")
def gold_expressions(table):
    k = F.col("o_orderkey")
    p = F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    e = F.when(k % 5 == 0, "").when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    rows = table("orders").select("o_orderkey", p.alias("p"), e.alias("e"))
    c = F.col("e")
    return rows.select("o_orderkey", cells.if_null(F.col("p"), F.lit("none")).alias("a"), cells.if_empty(c, F.lit("empty")).alias("b"), cells.is_empty(c, or_null=True).alias("c"), cells.is_empty(c).alias("d"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1998-01-01' - 365 AND o_orderdate::DATE <= DATE '1998-01-01'")
def gold_filter_window(table):
    return table("orders").where(cells.within_days(F.col("o_orderdate"), F.lit("1998-01-01").cast("date"), 365)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate::DATE <= DATE '1995-06-17' AND l_shipdate::DATE + 30 >= DATE '1995-06-17'")
def gold_filter_in_force(table):
    on = F.lit("1995-06-17").cast("date")
    start = F.to_date("l_shipdate")
    return table("lineitem").where(cells.in_force(start, F.date_add(start, 30), on)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate::DATE < DATE '1995-06-17' AND DATE '1995-06-17' < l_shipdate::DATE + 30")
def gold_filter_between(table):
    start = F.to_date("l_shipdate")
    return table("lineitem").where(cells.strictly_between(start, F.lit("1995-06-17").cast("date"), F.date_add(start, 30))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment, 'east' AS region FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'west' FROM customer")
def gold_region_union(table):
    east = table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    west = table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return gold.region_union([("east", east), ("west", west)])


# Comparison.

_L = "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_acctbal::DECIMAL(12,2)::VARCHAR AS bal FROM customer WHERE c_custkey % 10 <> 0"
_R = """SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN lower(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS seg,
CASE WHEN c_custkey % 5 = 0 THEN '1' || c_acctbal::DECIMAL(12,2)::VARCHAR ELSE c_acctbal::DECIMAL(12,2)::VARCHAR END AS bal FROM customer WHERE c_custkey % 9 <> 0"""


def _sides(table):
    c, k = table("customer"), F.col("c_custkey")
    bal = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    left = c.where(k % 10 != 0).select(k.alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), bal.alias("bal"))
    right = c.where(k % 9 != 0).select(k.alias("k"), F.when(k % 4 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("name"), F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("seg"), F.when(k % 5 == 0, F.concat(F.lit("1"), bal)).otherwise(bal).alias("bal"))
    return left, right


_CELLS = f"""SELECT k, c AS column_name, CASE WHEN NOT in_l THEN 'extra' WHEN NOT in_r THEN 'missing' WHEN a = b THEN 'exact' WHEN lower(a) = lower(b) THEN 'normalized'
  WHEN a = '' THEN 'extra' WHEN b = '' THEN 'missing' ELSE 'mismatch' END AS status FROM (
  SELECT coalesce(l.k, r.k) AS k, l.k IS NOT NULL AS in_l, r.k IS NOT NULL AS in_r, unnest(['name', 'seg', 'bal']) AS c,
    unnest([coalesce(l.name, ''), coalesce(l.seg, ''), coalesce(l.bal, '')]) AS a, unnest([coalesce(r.name, ''), coalesce(r.seg, ''), coalesce(r.bal, '')]) AS b
  FROM ({_L}) l FULL JOIN ({_R}) r ON l.k = r.k)"""


@query(_CELLS)
def diff_cells(table):
    paired = compare.pair(*_sides(table), ["k"], ["name"], ["name", "seg", "bal"])
    return compare.cells(paired, ["k"], ["name", "seg", "bal"]).drop("_n")


@query(f"""SELECT count(*) AS scored, count(*) FILTER (WHERE status = 'exact') AS exact, count(*) FILTER (WHERE status = 'normalized') AS normalized,
count(*) FILTER (WHERE status = 'mismatch') AS mismatch, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'extra') AS extra,
round(100.0 * count(*) FILTER (WHERE status IN ('exact', 'normalized')) / count(*), 1)::DOUBLE AS score FROM ({_CELLS})""")
def diff_score(table):
    paired = compare.pair(*_sides(table), ["k"], ["name"], ["name", "seg", "bal"])
    return compare.score(compare.cells(paired, ["k"], ["name", "seg", "bal"]))


@query("""WITH a AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS n FROM lineitem WHERE l_linenumber <= 3),
b AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS n FROM lineitem WHERE l_linenumber >= 3)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, b.n)::INT AS n, a.p AS l_p, b.p AS r_p FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n""")
def pair_ordered(table):
    rows = table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_linenumber")
    found = compare.pair(rows.where("l_linenumber <= 3"), rows.where("l_linenumber >= 3"), ["k"], ["p", "s"], ["p"])
    return found.select("k", F.col("_n").alias("n"), "l_p", "r_p")


@query("""WITH l AS (SELECT c_custkey AS row, c_name AS name FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT c_custkey + 1000000 AS row, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'old_' || lower(replace(c_name, '#', '__')) END AS name FROM customer WHERE c_custkey % 3 = 0),
e AS (SELECT l.row AS l_row, r.row AS r_row, 1 AS phase FROM l JOIN r USING (name)),
f AS (SELECT l.row AS l_row, r.row AS r_row, 2 AS phase FROM l JOIN r ON regexp_replace(lower(l.name), '[^a-z0-9]+', '_', 'g') = regexp_replace(regexp_replace(lower(r.name), '[^a-z0-9]+', '_', 'g'), '^old_', '')
  WHERE l.row NOT IN (SELECT l_row FROM e) AND r.row NOT IN (SELECT r_row FROM e)) SELECT * FROM e UNION ALL SELECT * FROM f""")
def pair_fuzzy(table):
    c, k = table("customer"), F.col("c_custkey")
    left = c.where(k % 2 == 0).select(k.alias("row"), F.col("c_name").alias("name"))
    right = c.where(k % 3 == 0).select((k + 1000000).alias("row"), F.when(k % 4 == 0, F.col("c_name")).otherwise(F.concat(F.lit("old_"), F.lower(F.replace("c_name", F.lit("#"), F.lit("__"))))).alias("name"))
    return compare.pair_in_phases(left, right, [F.col("name"), cells.normal_name("name", ("old",))], "row")


@query("""WITH d AS (SELECT (row_number() OVER (ORDER BY c) - 1)::INT AS position, c AS name, 'string' AS type FROM (SELECT DISTINCT c_mktsegment AS c FROM customer)),
e AS (SELECT position, CASE WHEN position = 2 THEN lower(name) ELSE name END AS name, CASE WHEN position = 3 THEN 'int' ELSE type END AS type FROM d)
SELECT CASE WHEN e.name IS NULL THEN 'deployed' ELSE 'expected' END AS side, coalesce(d.position, e.position) AS position, coalesce(d.name, e.name) AS name, coalesce(d.type, e.type) AS type
FROM d FULL JOIN e ON d.position = e.position AND d.name = e.name AND d.type = e.type WHERE d.name IS NULL OR e.name IS NULL""")
def schema_full_outer(table):
    names = table("customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("c")).select(F.posexplode("c").alias("position", "name")).withColumn("type", F.lit("string"))
    expected = names.select("position", F.when(F.col("position") == 2, F.lower("name")).otherwise(F.col("name")).alias("name"), F.when(F.col("position") == 3, "int").otherwise(F.col("type")).alias("type"))
    return compare.schema_diff(names, expected)


@query("""SELECT 'c_name' AS column_name, 'SAME' AS grade UNION ALL SELECT 'c_mktsegment', 'HARD' UNION ALL SELECT 'c_nationkey', 'WARN'""")
def structural_compare(table):
    c = table("customer")
    other = c.withColumns({"c_mktsegment": F.when(F.col("c_custkey") % 2 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")), "c_nationkey": F.col("c_nationkey") + 1})
    return compare.structural(c, other, ["c_name", "c_mktsegment", "c_nationkey"])


# Profiles.

_P = "SELECT CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN p_partkey % 3 <> 0 THEN NULL ELSE p_size::VARCHAR END AS size, NULL::VARCHAR AS gone FROM part"


@query(f"""WITH v AS (SELECT unnest(['brand', 'size', 'gone']) AS column_name, unnest([nullif(brand, ''), size, gone]) AS value FROM ({_P})),
n AS (SELECT column_name, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT column_name, value, n FROM n QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) = 1),
s AS (SELECT column_name, count(*) AS rows, count(value) AS filled FROM v GROUP BY 1)
SELECT s.column_name, rows, filled, round(100.0 * filled / rows, 1)::DOUBLE AS pct, value AS dominant, coalesce(n, 0) AS dominant_n, CASE WHEN filled = 0 THEN 0.0 ELSE round(100.0 * n / filled, 1) END::DOUBLE AS dominant_share, CASE WHEN s.column_name = 'size' THEN 'assigned' WHEN filled = 0 THEN 'gap' WHEN round(100.0 * filled / rows, 1) < 50 THEN 'sparse' ELSE 'ok' END AS status FROM s LEFT JOIN t USING (column_name)""")
def fill_rate(table):
    k = F.col("p_partkey")
    rows = table("part").select(F.when(k % 4 == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.when(k % 3 != 0, F.lit(None)).otherwise(F.col("p_size").cast("string")).alias("size"), F.lit(None).cast("string").alias("gone"))
    return profile.fill_rate(rows, ["brand", "size", "gone"], assigned=("size",))


@query("""SELECT c_nationkey, c_mktsegment AS majority, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) = 1""")
def majority_type(table):
    return profile.majority(table("customer"), ["c_nationkey"], "c_mktsegment", "c_custkey")


@query("""WITH m AS (SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) = 1)
SELECT c_custkey, c.c_mktsegment AS c_mktsegment, m.c_mktsegment AS majority FROM customer c JOIN m USING (c_nationkey) WHERE c.c_mktsegment <> m.c_mktsegment""")
def sibling_types(table):
    return profile.minority_members(table("customer").select("c_nationkey", "c_custkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "majority")


@query("""WITH x AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS o, l_linenumber AS r FROM lineitem),
y AS (SELECT *, CASE WHEN r = lag(r) OVER w + 1 THEN 0 ELSE 1 END AS b FROM x WINDOW w AS (PARTITION BY k ORDER BY o)), z AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY o) AS g FROM y)
SELECT k, min(o)::INT AS first, max(o)::INT AS last, count(*) AS length FROM z GROUP BY k, g HAVING count(*) >= 3""")
def stepped_runs(table):
    rows = compare.numbered(table("lineitem").withColumn("one", F.lit(1)), ["l_orderkey"], [F.col("l_partkey"), F.col("l_suppkey")])
    return profile.stepped_runs(rows.select(F.col("l_orderkey").alias("k"), F.col("_n").alias("o"), F.col("l_linenumber").alias("r"), "one"), ["k"], "o", "r", "one")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def ranked_counts(table):
    return profile.ranked_counts(table("lineitem"), "l_returnflag", 3)


@query("SELECT count(*) AS n FROM lineitem")
def row_count(table):
    return quality.row_count(table("lineitem"))


@query("""SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS p FROM orders""")
def forward_fill(table):
    rows = table("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("p"))
    return profile.forward_fill(rows, ["o_custkey"], "o_orderkey", "p")


@query("""WITH x AS (SELECT DISTINCT o_custkey % 50 AS g, (o_orderkey % 400)::BIGINT AS pos FROM orders), y AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY g ORDER BY pos), 0) > 4 AS j FROM x),
z AS (SELECT *, sum(j::INT) OVER (PARTITION BY g ORDER BY pos) > 0 AS beyond FROM y) SELECT g, coalesce(max(pos) FILTER (WHERE NOT beyond), 0) AS last, count(*) FILTER (WHERE beyond) AS beyond FROM z GROUP BY g""")
def extent_gap(table):
    rows = table("orders").select((F.col("o_custkey") % 50).alias("g"), (F.col("o_orderkey") % 400).alias("at")).distinct()
    return profile.extent(rows, ["g"], "at", 4)


@query("""WITH e AS (SELECT c_mktsegment AS seg, trim(unnest(string_split('n' || c_nationkey || ', r' || c_nationkey % 5, ','))) AS s FROM customer)
SELECT seg, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, count(DISTINCT s)::INT AS contributors FROM e GROUP BY 1""")
def collapse_provenance(table):
    rows = table("customer").select(F.col("c_mktsegment").alias("seg"), F.concat(F.lit("n"), "c_nationkey", F.lit(", r"), (F.col("c_nationkey") % 5)).alias("s"))
    return profile.collapse(rows, ["seg"], "s")


@query("SELECT p_brand, min(m) AS value, count(m) AS n FROM (SELECT p_brand, CASE WHEN p_size < 25 AND p_brand < 'Brand#2' THEN 'small' ELSE left(p_brand, 7) END AS m FROM part) GROUP BY 1 HAVING count(DISTINCT m) = 1 AND count(m) >= 2")
def unanimous_pairs(table):
    rows = table("part").select("p_brand", F.when((F.col("p_size") < 25) & (F.col("p_brand") < "Brand#2"), "small").otherwise(F.left("p_brand", F.lit(7))).alias("m"))
    return profile.unanimous(rows, "p_brand", "m", 2)


@query("""WITH ref AS (SELECT s_nationkey AS g, s_suppkey % 40 AS k, left(s_name, 10 + (s_suppkey % 3)::INT) AS v FROM supplier),
a AS (SELECT g, k, min(v) AS v FROM ref GROUP BY 1, 2 HAVING count(DISTINCT v) = 1), b AS (SELECT k, min(v) AS v FROM ref GROUP BY 1 HAVING count(DISTINCT v) = 1)
SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'group' WHEN b.v IS NOT NULL THEN 'key' ELSE 'none' END AS how
FROM customer LEFT JOIN a ON a.g = c_nationkey AND a.k = c_custkey % 60 LEFT JOIN b ON b.k = c_custkey % 60""")
def fallback_lookup(table):
    ref = table("supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 40).alias("k"), F.left("s_name", (10 + F.col("s_suppkey") % 3).cast("int")).alias("v"))
    rows = table("customer").select("c_custkey", F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 60).alias("k"))
    return profile.fallback_lookup(rows, ref, "g", "k", "v").select("c_custkey", "v", "how")


@query("""WITH ids AS (SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT s_suppkey::VARCHAR FROM supplier)
SELECT c_custkey FROM customer WHERE c_custkey::VARCHAR IN (SELECT id FROM ids)""")
def id_scope(table):
    ids = profile.scope_ids([(table("orders").where("o_orderstatus = 'F'"), "o_custkey"), (table("supplier"), "s_suppkey")])
    return profile.scoped(table("customer").select(F.col("c_custkey").cast("string").alias("id")), "id", ids).select(F.col("id").cast("bigint").alias("c_custkey"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer), r(root, node) AS (
SELECT c_custkey, c_custkey FROM customer WHERE c_custkey <> 0 UNION SELECT root, parent FROM r JOIN e ON child = node WHERE parent > 0) SELECT root::VARCHAR AS root, node::VARCHAR AS node FROM r""")
def ancestor_closure(table):
    c = table("customer")
    edges = c.select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 2").alias("parent"))
    return closure.closure(edges, c.select(F.col("c_custkey").alias("node")))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer), r(root, node) AS (
SELECT c_custkey, c_custkey FROM customer WHERE c_custkey <> 0 UNION SELECT root, child FROM r JOIN e ON parent = node WHERE child <> 0)
SELECT root::VARCHAR AS root, count(DISTINCT c_nationkey) AS n_groups FROM r JOIN customer ON node = c_custkey GROUP BY 1""")
def descendant_rollup(table):
    c = table("customer")
    down = c.select(F.expr("c_custkey div 3").alias("child"), F.col("c_custkey").alias("parent"))
    reached = closure.closure(down, c.select(F.col("c_custkey").alias("node")))
    return closure.rollup(reached, c.select(F.col("c_custkey").cast("string").alias("node"), F.col("c_nationkey").alias("grp")))


# Both closures from every customer; customer 0 is one.


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer), r(root, node) AS (
SELECT c_custkey, c_custkey FROM customer UNION SELECT root, parent FROM r JOIN e ON child = node) SELECT root::VARCHAR AS root, node::VARCHAR AS node FROM r""")
def ancestor_closure_whole(table):
    c = table("customer")
    edges = c.select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 2").alias("parent"))
    return closure.closure(edges, c.select(F.col("c_custkey").alias("node")), stop=("-1",))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer), r(root, node) AS (
SELECT c_custkey, c_custkey FROM customer UNION SELECT root, child FROM r JOIN e ON parent = node)
SELECT root::VARCHAR AS root, count(DISTINCT c_nationkey) AS n_groups FROM r JOIN customer ON node = c_custkey GROUP BY 1""")
def descendant_rollup_whole(table):
    c = table("customer")
    down = c.select(F.expr("c_custkey div 3").alias("child"), F.col("c_custkey").alias("parent"))
    reached = closure.closure(down, c.select(F.col("c_custkey").alias("node")), stop=("-1",))
    return closure.rollup(reached, c.select(F.col("c_custkey").cast("string").alias("node"), F.col("c_nationkey").alias("grp")))


@query("SELECT c_custkey, replace(replace(c_name, 'Customer', '<who>'), '000', '<zeros>') AS slotted FROM customer")
def slot_template(table):
    return table("customer").select("c_custkey", cells.slot_template("c_name", {"000": "zeros", "Customer": "who"}).alias("slotted"))


@query("""WITH s AS (SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS stem, n_regionkey::VARCHAR AS grp FROM nation),
x AS (SELECT o_orderkey AS row, a.n_name || ' ' || b.n_name AS t FROM orders JOIN nation a ON a.n_nationkey = o_orderkey % 25 JOIN nation b ON b.n_nationkey = o_custkey % 25),
w AS (SELECT row, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda v: v <> '') AS w FROM x),
g AS (SELECT DISTINCT row, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || w[i + 1] || w[i + 2])))) AS stem FROM w)
SELECT row FROM g JOIN s USING (stem) GROUP BY row HAVING max((grp = '2')::INT) = 0""")
def names_other(table):
    n = table("nation")
    rows = table("orders").select(F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 25).alias("a"), (F.col("o_custkey") % 25).alias("b"))
    named = n.select("n_nationkey", "n_name")
    rows = rows.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select("row", F.concat_ws(" ", "x", "y").alias("t"))
    stems = n.select(F.regexp_replace(F.lower("n_name"), "[^a-z0-9]", "").alias("stem"), F.col("n_regionkey").cast("string").alias("grp"))
    return profile.names_other(rows, "t", stems, "2", "row").select("row")


@query("SELECT c_mktsegment AS name, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (SELECT c_mktsegment, CASE WHEN c_mktsegment > 'C' AND c_custkey % 50 = 0 THEN 'int' ELSE 'string' END AS t FROM customer) GROUP BY 1 HAVING count(DISTINCT t) > 1")
def type_conflicts(table):
    rows = table("customer").select(F.col("c_mktsegment").alias("name"), F.when((F.col("c_mktsegment") > "C") & (F.col("c_custkey") % 50 == 0), "int").otherwise("string").alias("t"))
    return profile.type_conflicts(rows, "name", "t").select("name", F.concat_ws(",", "types").alias("types"))


@query("""WITH a AS (SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS name, 'string' AS kind, length(n_name) AS len, n_nationkey AS pos FROM nation WHERE n_nationkey <> 3),
b AS (SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS name, CASE WHEN n_nationkey = 5 THEN 'int' ELSE 'string' END AS kind, length(n_name) + CASE WHEN n_nationkey = 7 THEN 1 ELSE 0 END AS len, CASE WHEN n_nationkey = 9 THEN 0 ELSE n_nationkey END AS pos FROM nation WHERE n_nationkey <> 11)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN b.name IS NULL THEN 'extra' WHEN a.kind <> b.kind THEN 'type' WHEN a.len <> b.len THEN 'length' ELSE 'position' END AS finding
FROM a FULL JOIN b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.kind <> b.kind OR a.len <> b.len OR a.pos <> b.pos""")
def dictionary_drift(table):
    n, k = table("nation"), F.col("n_nationkey")
    found = n.where(k != 3).select(F.col("n_name").alias("name"), F.lit("string").alias("kind"), F.length("n_name").alias("length"), k.alias("position"))
    stated = n.where(k != 11).select(F.col("n_name").alias("name"), F.when(k == 5, "int").otherwise("string").alias("kind"), (F.length("n_name") + F.when(k == 7, 1).otherwise(0)).alias("length"), F.when(k == 9, 0).otherwise(k).alias("position"))
    return drift.dictionary_drift(found, stated)


@query("SELECT n_regionkey, bool_or(n_nationkey % 4 = 0) AS nullable, CASE WHEN bool_or(n_nationkey % 4 = 0) = bool_and(n_nationkey % 4 = 0) THEN 'filled' ELSE 'proposed' END AS state FROM nation GROUP BY 1")
def region_nullability(table):
    return quality.any_nullable(table("nation").withColumn("open", F.col("n_nationkey") % 4 == 0), "n_regionkey", "open")


# Lines made from a table, as a segmented file has them.

_LINES = "SELECT CASE WHEN o_orderkey % 100 = 0 THEN 'T|' || o_orderkey WHEN o_orderkey % 41 = 0 THEN 'X|1' ELSE 'D|' || o_orderkey || '|' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '|' WHEN o_orderkey % 17 = 0 THEN '' ELSE '|' || o_orderpriority || CASE WHEN o_orderkey % 19 = 0 THEN '|x' ELSE '' END END END AS value FROM orders"


def _lines(table):
    k = F.col("o_orderkey")
    tail = F.when(k % 3 == 0, "|").when(k % 17 == 0, "").otherwise(F.concat(F.lit("|"), "o_orderpriority", F.when(k % 19 == 0, "|x").otherwise("")))
    line = F.when(k % 100 == 0, F.concat(F.lit("T|"), k)).when(k % 41 == 0, "X|1").otherwise(F.concat(F.lit("D|"), k, F.lit("|"), "o_orderstatus", tail))
    return table("orders").select(line.alias("value"), F.lit("f").alias("_source_file"))


@query(f"SELECT CASE left(value, 1) WHEN 'D' THEN 'Detail' WHEN 'T' THEN 'Trailer' ELSE 'unknown' END AS segment, len(string_split(value, '|'))::INT AS fields, count(*) AS n FROM ({_LINES}) GROUP BY 1, 2")
def segment_split(table):
    rows = segments.by_discriminator(_lines(table), "|", {"Detail": "D", "Trailer": "T"})
    return rows.groupBy(F.coalesce("segment", F.lit("unknown")).alias("segment"), F.col("_field_count").alias("fields")).agg(F.count("*").alias("n"))


@query(f"""SELECT CASE left(value, 1) WHEN 'D' THEN 'Detail' WHEN 'T' THEN 'Trailer' END AS segment, count(*) AS records, count(*) FILTER (WHERE len(string_split(value, '|')) < CASE left(value, 1) WHEN 'D' THEN 4 WHEN 'T' THEN 2 END) AS short_rows,
count(*) FILTER (WHERE len(string_split(value, '|')) > CASE left(value, 1) WHEN 'D' THEN 4 WHEN 'T' THEN 2 END) AS long_rows FROM ({_LINES}) GROUP BY 1""")
def segment_drift(table):
    rows = segments.by_discriminator(_lines(table), "|", {"Detail": "D", "Trailer": "T"})
    return segments.field_counts(rows, {"Detail": 4, "Trailer": 2})


@query(f"SELECT count(*) FILTER (WHERE len(string_split(value, '|')) < 4) AS short_rows, count(*) FILTER (WHERE len(string_split(value, '|')) > 4) AS long_rows FROM ({_LINES}) WHERE left(value, 1) = 'D'")
def field_count_drift(table):
    rows = segments.by_discriminator(_lines(table), "|", {"Detail": "D"})
    return drift.field_count_drift(rows.where("segment = 'Detail'"), 4)


@query(f"""WITH d AS (SELECT count(*) AS n FROM ({_LINES}) WHERE left(value, 1) = 'D')
SELECT 'right' AS side, 'trailer_count' AS name, true AS passed, 'trailers=1 stated=' || n || ' details=' || n AS detail FROM d
UNION ALL SELECT 'wrong', 'trailer_count', false, 'trailers=1 stated=' || (n + 1) || ' details=' || n FROM d""")
def trailer_check(table):
    """Details are counted in the file; one trailer states their number, the other one more."""
    details = segments.by_discriminator(_lines(table), "|", {"Detail": "D"}).where("segment = 'Detail'").agg(F.count("*").alias("details"))
    sides = [(side, details.select("details", (F.col("details") + more).cast("string").alias("stated"))) for side, more in (("right", 0), ("wrong", 1))]
    checks = [drift.trailer_check(rows, "stated", F.col("details")).select(F.lit(side).alias("side"), "*") for side, rows in sides]
    return checks[0].unionByName(checks[1])


@query("SELECT rpad(c_custkey::VARCHAR, 8, ' ') AS key, rpad(c_mktsegment, 10, ' ') AS seg, CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE 3 END AS width FROM customer")
def fixed_width_split(table):
    k = F.col("c_custkey")
    line = F.concat(F.lit("D"), F.rpad(k.cast("string"), 8, " "), F.rpad("c_mktsegment", 10, " "), F.when(k % 6 == 0, "~").otherwise(""))
    lines = table("customer").select(line.alias("value"), F.lit("f").alias("_source_file"))
    rows = segments.by_width(lines, {"Detail": [("kind", 1, 1), ("key", 2, 8), ("seg", 10, 10)]}, {"Detail": "D"})
    return segments.part(rows, "Detail", ["kind", "key", "seg"]).select("key", "seg", F.col("_field_count").alias("width"))


@query("""SELECT 'f_' || c_custkey || '_' || c_mktsegment || '.txt' AS name, lower(c_mktsegment) AS code FROM customer""")
def file_codes(table):
    c = table("customer")
    codes = c.select(F.col("c_mktsegment").alias("key"), F.lower("c_mktsegment").alias("code")).distinct()
    return files.keyed_codes(c.select(F.concat(F.lit("f_"), "c_custkey", F.lit("_"), "c_mktsegment", F.lit(".txt")).alias("name")), codes)


# More of the operators above: what a comparison, a profile or a check adds to its plain form.


@query("SELECT 'path' AS column_name, CASE c_custkey % 3 WHEN 1 THEN 'exact' WHEN 0 THEN 'normalized' ELSE 'mismatch' END AS status, count(*) AS n FROM customer GROUP BY 2")
def diff_environments(table):
    """Paths of two environments: alike but for the environment's word, unless a slash is lacking
    behind the scheme."""
    k = F.col("c_custkey")
    a = F.concat(F.lit("s3://dev/"), k)
    b = F.when(k % 3 == 0, F.concat(F.lit("S3://PRD//"), k, F.lit("/"))).when(k % 3 == 1, a).otherwise(F.concat(F.lit("s3:/prd/"), k))
    rows = table("customer").select(k.alias("k"), a.alias("path")), table("customer").select(k.alias("k"), b.alias("path"))
    found = compare.cells(compare.pair(*rows, ["k"], ["path"], ["path"]), ["k"], ["path"], [("env", ["dev", "prd"], [])])
    return found.groupBy("column_name", "status").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_nationkey AS g, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
b AS (SELECT s_nationkey AS g, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT coalesce(a.g, b.g) AS g, coalesce(a.n, b.n)::INT AS n, a.k AS l_k, b.k AS r_k FROM a FULL JOIN b ON a.g = b.g AND a.n = b.n""")
def pair_by_position(table):
    sides = [table(t).select(F.col(f"{p}_nationkey").alias("g"), F.col(key).alias("k")) for t, p, key in (("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"))]
    return compare.pair_by_position(*sides, ["g"], "k", ["k"]).select("g", F.col("_n").alias("n"), "l_k", "r_k")


@query("""WITH l AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, s_nationkey AS nation, s_suppkey % 7 AS part FROM supplier),
r AS (SELECT s_suppkey + 1000000 AS row, CASE WHEN s_suppkey % 6 <> 0 THEN s_name END AS name, s_nationkey AS nation, s_suppkey % 7 AS part FROM supplier WHERE s_suppkey % 5 <> 0),
e AS (SELECT l.row AS l_row, r.row AS r_row, 1 AS phase FROM l JOIN r USING (name)),
ln AS (SELECT row, nation, part, row_number() OVER (PARTITION BY nation, part ORDER BY row) AS n FROM l WHERE row NOT IN (SELECT l_row FROM e)),
rn AS (SELECT row, nation, part, row_number() OVER (PARTITION BY nation, part ORDER BY row) AS n FROM r WHERE row NOT IN (SELECT r_row FROM e))
SELECT * FROM e UNION ALL SELECT ln.row, rn.row, 2 FROM ln JOIN rn USING (nation, part, n)""")
def pair_by_fallback_keys(table):
    k = F.col("s_suppkey")
    left = table("supplier").select(k.alias("row"), F.when(k % 4 != 0, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("nation"), (k % 7).alias("part"))
    right = table("supplier").where(k % 5 != 0).select((k + 1000000).alias("row"), F.when(k % 6 != 0, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("nation"), (k % 7).alias("part"))
    return compare.pair_in_phases(left, right, compare.by_keys(("name",), ("nation", "part")), "row")


@query("""WITH RECURSIVE l AS (SELECT n_nationkey AS row, n_regionkey::VARCHAR AS g, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS v, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation),
r AS (SELECT n_nationkey + 100 AS row, n_regionkey::VARCHAR AS g, CASE WHEN n_nationkey % 2 <> 0 THEN n_name ELSE '' END AS v FROM nation),
c AS (SELECT l.i, l.row, coalesce(list_sort(list(r.row) FILTER (WHERE r.row IS NOT NULL)), []) AS fits FROM l LEFT JOIN r ON l.g = r.g AND (coalesce(l.v, '') = '' OR r.v = '' OR l.v = r.v) GROUP BY l.i, l.row),
step(i, used, l_row, r_row) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL SELECT i, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, row, f FROM (SELECT c.i, c.row, step.used, list_filter(c.fits, lambda x: NOT list_contains(step.used, x))[1] AS f FROM step JOIN c ON c.i = step.i + 1))
SELECT l_row, r_row FROM step WHERE r_row IS NOT NULL""")
def pair_tolerant(table):
    n, k = table("nation"), F.col("n_nationkey")
    left = n.select(k.alias("row"), F.col("n_regionkey").alias("g"), F.when(k % 3 != 0, F.col("n_name")).alias("v"))
    right = n.select((k + 100).alias("row"), F.col("n_regionkey").alias("g"), F.when(k % 2 != 0, F.col("n_name")).otherwise("").alias("v"))
    return compare.pair_tolerant(left, right, ["g"], ["v"], "row")


@query("SELECT 'p_brand' AS column_name, 'SAME' AS grade UNION ALL SELECT 'twice', 'WARN'")
def structural_repeats(table):
    """Values that stand twice each: another pair of values isn't the same column."""
    two = table("part").select("p_brand").unionByName(table("part").select("p_brand"))
    return compare.structural(two.withColumn("twice", F.lit("a")), two.withColumn("twice", F.lit("b")), ["p_brand", "twice"])


@query("""SELECT count(*) AS rows_before, count(DISTINCT (l_orderkey, l_linenumber)) AS rows_after, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed FROM lineitem""")
def dedup_count(table):
    return quality.deduplicated(table("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], [F.col("l_orderkey")])[1]


@query("""SELECT 'unique' AS test_id, CASE WHEN count(*) = 0 THEN 'NO DATA' WHEN sum((n > 1)::INT) = 0 THEN 'PASS' ELSE 'FAIL' END AS result, sum((n > 1)::INT)::BIGINT AS found, 0::BIGINT AS expected FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)
UNION ALL SELECT 'nothing', 'NO DATA', 0, 0""")
def check_key_unique(table):
    orders = table("orders")
    return quality.key_check(orders, "unique", ["o_custkey"]).unionByName(quality.key_check(orders.where("o_orderkey is null"), "nothing", ["o_orderkey"]))


@query("SELECT 'bound' AS test_id, CASE WHEN count(*) = 2000 THEN 'PASS' ELSE 'FAIL' END AS result, count(*) AS found, 2000::BIGINT AS expected FROM part")
def check_bound_count(table):
    part = table("part")
    part.createOrReplaceTempView("millrace_part")
    return quality.count_check(part.sparkSession, "millrace_part", "bound", 2000)


@query("""WITH a AS (SELECT count(*) AS n FROM customer), b AS (SELECT count(*) AS n FROM supplier), u AS (SELECT count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier))
SELECT 'second_load_replace' AS test_id, 'PASS' AS result, b.n AS found, b.n AS expected FROM b UNION ALL SELECT 'second_load_add', 'PASS', a.n + b.n, a.n + b.n FROM a, b
UNION ALL SELECT 'second_load_upsert', CASE WHEN a.n + b.n = u.n THEN 'PASS' ELSE 'FAIL' END, a.n + b.n, u.n FROM a, b, u""")
def check_load_strategies(table):
    a, b = table("customer").select(F.col("c_custkey").alias("k")), table("supplier").select(F.col("s_suppkey").alias("k"))
    both = a.unionByName(b)
    checks = [quality.load_strategy_check(a, b, after, how, ["k"]) for how, after in (("replace", b), ("add", both), ("upsert", both))]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query("""WITH s AS (SELECT c_mktsegment AS layer, 'width' AS feature, (c_nationkey % 4)::VARCHAR AS value FROM customer), t AS (SELECT DISTINCT c_mktsegment AS layer, 'width' AS feature, '1' AS value FROM customer WHERE c_nationkey < 20),
m AS (SELECT layer, feature, value, row_number() OVER (PARTITION BY layer, feature ORDER BY count(*) DESC, value) AS r FROM s GROUP BY 1, 2, 3)
SELECT t.layer, t.feature, t.value, m.value AS majority, CASE WHEN t.value = m.value THEN 'MATCH' ELSE 'DIFF' END AS result FROM t JOIN m ON t.layer = m.layer AND t.feature = m.feature AND r = 1""")
def shape_majority(table):
    c = table("customer").select(F.col("c_mktsegment").alias("layer"), F.lit("width").alias("feature"), (F.col("c_nationkey") % 4).cast("string").alias("value"), "c_nationkey")
    mine = c.where("c_nationkey < 20").select("layer", "feature", F.lit("1").alias("value")).distinct()
    return profile.shape_majority(mine, c.drop("c_nationkey"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'decimal' ELSE ' NUMERIC ' END AS kind FROM nation WHERE n_nationkey % 3 <> 2")
def bare_decimals(table):
    k = F.col("n_nationkey")
    fields = table("nation").select(F.col("n_name").alias("name"), F.when(k % 3 == 0, "decimal").when(k % 3 == 1, " NUMERIC ").otherwise("decimal(10,2)").alias("kind"))
    return profile.bare_decimals(fields, "name", "kind")


@query("""WITH v AS (SELECT p_brand, p_partkey, CASE WHEN p_size < 40 THEN 'std' ELSE nullif(left(p_name, 3), '') END AS m FROM part WHERE p_partkey % 2 = 0 OR p_size < 40), k AS (SELECT p_brand, count(DISTINCT m) AS k, count(m) AS cells FROM v GROUP BY 1),
b AS (SELECT p_brand, m, count(*) AS n, min(p_partkey) AS f FROM v WHERE m IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) = 1)
SELECT p_brand, m AS value, CASE WHEN k = 1 THEN 'all equal' ELSE 'most frequent' END AS how, n, cells FROM b JOIN k USING (p_brand)""")
def band_constant(table):
    m = F.when(F.col("p_size") < 40, "std").when(F.col("p_partkey") % 2 == 0, F.left("p_name", F.lit(3)))
    return profile.band_constant(table("part").select("p_brand", "p_partkey", m.alias("m")), ["p_brand"], "m", "p_partkey")


@query("SELECT count(*) FILTER (WHERE s_suppkey IS NOT NULL) AS kept, count(*) FILTER (WHERE s_suppkey IS NULL) AS dropped FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def scope_counts(table):
    return profile.scope_counts(table("customer").select(F.col("c_custkey").alias("id")), "id", table("supplier").select("s_suppkey"))


@query("""SELECT contributors, count(*) AS n FROM (SELECT p_brand, count(DISTINCT nullif(trim(s), ''))::INT AS contributors FROM (SELECT p_brand, unnest(string_split(CASE WHEN p_brand < 'Brand#3' THEN '' ELSE p_mfgr || ', ' || p_size % 3 END, ',')) AS s FROM
(SELECT p_brand, 'm' || p_partkey % 2 AS p_mfgr, p_size FROM part)) GROUP BY 1) GROUP BY 1""")
def provenance_histogram(table):
    s = F.when(F.col("p_brand") < "Brand#3", "").otherwise(F.concat(F.lit("m"), F.col("p_partkey") % 2, F.lit(", "), F.col("p_size") % 3))
    return profile.histogram(profile.collapse(table("part").select("p_brand", s.alias("s")), ["p_brand"], "s"), "contributors")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS child, s_suppkey // 4 AS parent FROM supplier), r(root, node) AS (SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey <> 0 UNION SELECT root, child FROM r JOIN e ON parent = node WHERE child <> 0),
p AS (SELECT DISTINCT root, s_nationkey AS grp FROM r JOIN supplier ON node = s_suppkey), q AS (SELECT root, count(*) AS n FROM p GROUP BY 1)
SELECT 'groups of a root' AS kind, n AS value, count(*) AS roots FROM q GROUP BY n UNION ALL SELECT 'roots of a group', grp, count(*) FROM p GROUP BY grp""")
def group_histograms(table):
    s = table("supplier")
    down = s.select(F.expr("s_suppkey div 4").alias("child"), F.col("s_suppkey").alias("parent"))
    reached = closure.closure(down, s.select(F.col("s_suppkey").alias("node")))
    a, b = closure.group_histograms(reached, s.select(F.col("s_suppkey").cast("string").alias("node"), F.col("s_nationkey").alias("grp")))
    return a.select(F.lit("groups of a root").alias("kind"), F.col("n_groups").alias("value"), "roots").unionByName(b.select(F.lit("roots of a group").alias("kind"), F.col("grp").cast("bigint").alias("value"), "roots"))


@query("""WITH g AS (SELECT n_nationkey AS grp, 'g' || n_nationkey AS v FROM nation WHERE n_nationkey % 3 = 0), k AS (SELECT c_mktsegment AS key, 'k' || c_mktsegment AS v FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment < 'F'),
s AS (SELECT * FROM (VALUES ('x', 's1'), ('y', 's1'), ('z', 's2'), ('w', 'a'), ('w', 'b')) t(source, v)),
t AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN ['x', 'y'] WHEN 1 THEN ['x', 'z'] WHEN 2 THEN ['z', 'w'] ELSE ['w'] END AS sources FROM customer),
o AS (SELECT source, min(v) AS v FROM s GROUP BY 1 HAVING count(DISTINCT v) = 1), i AS (SELECT c_custkey, min(o.v) AS v FROM (SELECT c_custkey, unnest(sources) AS source FROM t) JOIN o USING (source) GROUP BY 1 HAVING count(DISTINCT o.v) = 1)
SELECT t.c_custkey, coalesce(g.v, k.v, i.v) AS v, CASE WHEN g.v IS NOT NULL THEN 'group' WHEN k.v IS NOT NULL THEN 'key' WHEN i.v IS NOT NULL THEN 'sources' ELSE 'none' END AS how FROM t LEFT JOIN g ON grp = c_nationkey LEFT JOIN k ON key = c_mktsegment LEFT JOIN i ON i.c_custkey = t.c_custkey""")
def priority_lookup(table):
    c = table("customer")
    by_group = table("nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("grp"), F.concat(F.lit("g"), "n_nationkey").alias("v"))
    by_key = c.where("c_mktsegment < 'F'").select(F.col("c_mktsegment").alias("key"), F.concat(F.lit("k"), "c_mktsegment").alias("v")).distinct()
    by_source = c.sparkSession.sql("SELECT * FROM VALUES ('x', 's1'), ('y', 's1'), ('z', 's2'), ('w', 'a'), ('w', 'b') AS t(source, v)")
    k = F.col("c_custkey") % 4
    lists = F.when(k == 0, F.array(F.lit("x"), F.lit("y"))).when(k == 1, F.array(F.lit("x"), F.lit("z"))).when(k == 2, F.array(F.lit("z"), F.lit("w"))).otherwise(F.array(F.lit("w")))
    rows = c.select(F.col("c_custkey").alias("_row"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("key"), lists.alias("sources"))
    return profile.priority_lookup(rows, by_group, by_key, by_source, "grp", "key", "sources", "v").select(F.col("_row").alias("c_custkey"), "v", "how")


@query("""SELECT 'r' || n_regionkey AS segment, CASE WHEN n_regionkey <> 2 THEN regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') END AS name, CASE WHEN n_regionkey = 2 THEN 'scope' ELSE 'missing' END AS finding FROM nation WHERE n_nationkey % 9 = 0 AND n_regionkey <> 2
UNION ALL SELECT 'r2', NULL, 'scope'
UNION ALL SELECT 'r' || n_regionkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g'), 'type' FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 9 <> 0 AND n_nationkey % 7 = 0""")
def dictionary_scope(table):
    """A segment whose dictionary fields are mostly missing is one finding; decimal and number are
    one class of type, and date is another."""
    n, k = table("nation"), F.col("n_nationkey")
    own = n.select(F.concat(F.lit("r"), "n_regionkey").alias("segment"), F.col("n_name").alias("name"), F.length("n_name").alias("length"), k.alias("position"), "n_regionkey")
    found = own.where((F.col("position") % 9 != 0) & (F.col("n_regionkey") != 2)).withColumn("kind", F.lit("decimal(10,2)")).drop("n_regionkey")
    stated = own.withColumn("kind", F.when(F.col("position") % 7 == 0, "date").otherwise("NUMBER")).drop("n_regionkey")
    return drift.dictionary_drift(found, stated, ("segment",), 0.75)


@query("""SELECT s_suppkey, 'east:' || s_suppkey AS id FROM supplier UNION ALL SELECT c_custkey, 'west:' || c_custkey FROM customer""")
def region_ids(table):
    east = table("supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("ID"))
    west = table("customer").select(F.col("c_custkey").alias("S_SUPPKEY"), F.col("c_custkey").cast("string").alias("id"))
    return gold.region_union([("east", east), ("west", west)], ids=("id",)).select("s_suppkey", F.col("ID").alias("id"))


@query("""SELECT n_name, n_regionkey, 'n' || n_nationkey AS code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'""")
def gold_join_using(table):
    """A join on columns of one name, which nobody stated and the caller accepts."""
    tables = {"nation": table("nation").withColumnRenamed("n_regionkey", "regionkey"), "region": table("region").withColumnRenamed("r_regionkey", "regionkey")}
    columns = (gold.GoldColumn("n_name", "string", _filled("n_name")), gold.GoldColumn("n_regionkey", "bigint", _filled("regionkey")), gold.GoldColumn("code", "string", _filled("concat('n', n_nationkey)")))
    feed = gold.GoldFeed("nations", columns, (gold.SourceSet("nation", (gold.Join("region", using=("regionkey",), state="proposed"),), (_filled("r_name like 'A%'"),)),))
    return gold.build(feed, tables, accept_proposed=True)


@query("SELECT n_nationkey AS k, TRY_CAST(n_name AS INT) AS name, TRY_CAST(n_nationkey::VARCHAR AS DECIMAL(10,2)) AS num FROM nation")
def rules_cast(table):
    rows = table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("num"))
    return rules.apply_rules(rows, [rules.Rule("data_type_cast", ("name", "num"), {"types": ("int", "decimal(10,2)"), "check": False}), rules.Rule("no_such_rule")]).rows


@query(f"""SELECT CASE left(value, 1) WHEN 'D' THEN 'Detail' ELSE 'Trailer' END AS segment, CASE WHEN left(value, 1) = 'T' THEN 'EAST' END AS zone, count(*) AS n FROM ({_LINES}) WHERE left(value, 1) IN ('D', 'T')
AND (left(value, 1) = 'T' OR string_split(value, '|')[3] IN ('O', 'F')) GROUP BY 1, 2 UNION ALL SELECT 'missed', NULL, count(*) FROM ({_LINES}) WHERE left(value, 1) = 'D' AND string_split(value, '|')[3] NOT IN ('O', 'F')""")
def rules_by_segment(table):
    """Custom columns on all but the details, tables of their own for those segments, and a lookup."""
    rows = segments.by_discriminator(_lines(table), "|", {"Detail": "D", "Trailer": "T"})
    frames = {s: segments.part(rows, s, ["kind", "key", "status"]) for s in ("Detail", "Trailer")}
    ids = recycle.reference_ids(table("orders").where("o_orderstatus in ('O', 'F')"), "o_orderstatus")
    steps = [rules.Rule("add_custom_columns", ("zone",), {"values": ["EAST"]}), rules.Rule("header_trailer_split"), rules.Rule("referential_check", ("status",))]
    out = rules.apply_to_segments(frames, steps, "Detail", ids)
    assert out.separate == ["Trailer"] and not out.not_done
    parts = [(s, df if "zone" in df.columns else df.withColumn("zone", F.lit(None).cast("string"))) for s, df in out.frames.items()]
    parts.append(("missed", out.missed[0].withColumn("zone", F.lit(None).cast("string"))))
    counts = [df.groupBy(F.lit(s).alias("segment"), "zone").agg(F.count("*").alias("n")) for s, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""WITH h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2026-01-07 23:00:00' ELSE TIMESTAMP '2026-01-08 01:00:00' END AS recycled_at FROM customer WHERE c_acctbal < 0)
SELECT 'backlog' AS what, k, recycled_at::VARCHAR AS at FROM h WHERE recycled_at::DATE >= DATE '2026-01-08'
UNION ALL SELECT 'kept', c_custkey, coalesce(h.recycled_at, TIMESTAMP '2026-01-15 09:00:00')::VARCHAR FROM customer LEFT JOIN h ON c_custkey = h.k WHERE c_mktsegment = 'BUILDING'""")
def recycle_rejects(table):
    c, k = table("customer"), F.col("c_custkey")
    held = c.where("c_acctbal < 0").select(k.alias("k"), F.when(k % 3 == 0, F.lit("2026-01-07 23:00:00")).otherwise(F.lit("2026-01-08 01:00:00")).cast("timestamp").alias("recycled_at"))
    kept = recycle.kept_rejects(c.where("c_mktsegment = 'BUILDING'").select(k.alias("k")), held, ["k"], RUN_TS)
    rows = recycle.backlog(held, RUN_TS, 7).select(F.lit("backlog").alias("what"), "*").unionByName(kept.select(F.lit("kept").alias("what"), "*"))
    return rows.select("what", "k", F.date_format("recycled_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


# Whole loads: files are written from the tables, then admitted, read, checked and upserted.


def _landed(df: DataFrame, name: str, header: bool) -> tuple[ingest.Tables, str]:
    """The feed's tables in a new folder, and the path of a delivered file of that name."""
    root = closure.new_folder(df.sparkSession)
    path = f"{root}/landing/{name}"
    df.write.option("header", header).csv(path) if header else df.write.text(path)
    return ingest.Tables(df.sparkSession, f"{root}/tables"), path


_FEED = Feed("orders", ORDERS.fields, patterns=("orders_CCYYMMDD.csv",))


def _headed(table):
    return _delivered(table).toDF(*(f.source for f in ORDERS.fields))


@query(f"SELECT ORDER_KEY::BIGINT AS order_key, CUST_KEY::BIGINT AS cust_key, STATUS AS status, TOTAL::DECIMAL(18,2) AS total, ORDER_DATE::DATE AS order_date, PRIORITY AS priority, 'orders_20260115.csv' AS src_file_name FROM ({_BLANKED}) WHERE {_GOOD}")
def ingest_delimited(table):
    tables, path = _landed(_headed(table), "orders_20260115.csv", True)
    ingest.ingest_file(tables.spark, _FEED, path, tables, RUN_TS)
    return ingest.standard(tables.stage.read(), _FEED, check=False, loaded=["orders_20260115.csv"]).drop("code", "created", "updated")


@query(f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_GOOD}) AS good FROM ({_BLANKED}))
SELECT 1 AS run, 'read' AS step, n AS rows FROM c UNION ALL SELECT 1, 'rejects', n - good FROM c UNION ALL SELECT 1, 'stage', good FROM c
UNION ALL SELECT 2, 'read', n FROM c UNION ALL SELECT 2, 'rejects', n - good FROM c UNION ALL SELECT 2, 'stage', good FROM c UNION ALL SELECT 3, 'rows in stage', good FROM c UNION ALL SELECT 4, 'dry run', 100""")
def ingest_report(table):
    """The run report of a load, of the same load again, which leaves as many rows, and of a dry run."""
    tables, path = _landed(_headed(table), "orders_20260115.csv", True)
    for ts in (RUN_TS, "2026-01-16 09:00:00"):
        ingest.ingest_file(tables.spark, _FEED, path, tables, ts)
    dry = ingest.Tables(tables.spark, tables.root, dry=True)
    ingest.ingest_file(tables.spark, _FEED, path, dry, RUN_TS)
    steps = tables.report.read().select(F.dense_rank().over(Window.orderBy("run_ts")).alias("run"), "step", "rows")  # a row a step
    stage = tables.stage.read().agg(F.lit(3).alias("run"), F.lit("rows in stage").alias("step"), F.count("*").alias("rows"))
    return steps.unionByName(stage).unionByName(dry.report.read().where("step = 'read'").select(F.lit(4).alias("run"), F.lit("dry run").alias("step"), "rows"))


_KIND = Field("kind", "KIND", "kind")
_SEGMENTED = Feed(
    "segmented", (_KIND, *(f for f in ORDERS.fields)), patterns=("orders_CCYYMMDD.txt",), delimiter="|", detail="D",
    segments=(Segment("Header", "H", (_KIND, Field("file_date", "FILE_DATE", "file_date"))), Segment("Trailer", "T", (_KIND, Field("count", "RECORDS", "records")))), trailer=("Trailer", "RECORDS"),
)


def _segmented(table, more: int) -> DataFrame:
    """Details as lines between a header and a trailer that states their number, or one more."""
    o = _delivered(table)
    line = F.concat_ws("|", F.lit("D"), *(F.coalesce(c, F.lit("")) for c in o.columns))
    details = o.select(line.alias("value"))
    ends = o.agg(F.count("*").alias("n")).select(F.explode(F.array(F.lit("H|20260115"), F.concat(F.lit("T|"), F.col("n") + more))).alias("value"))
    return details.unionByName(ends)


@query(f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_GOOD}) AS good FROM ({_BLANKED}))
SELECT 'right' AS side, 'LOADED' AS status, good AS loaded, n - good AS rejected, n AS stated FROM c UNION ALL SELECT 'wrong', 'LOADED_WITH_DQ_FAILURES', good, n - good, n + 1 FROM c""")
def ingest_segmented(table):
    """A segmented file whose trailer states its details, and one whose trailer doesn't."""
    out = []
    for side, more in (("right", 0), ("wrong", 1)):
        tables, path = _landed(_segmented(table, more), "orders_20260115.txt", False)
        done = ingest.ingest_file(tables.spark, _SEGMENTED, path, tables, RUN_TS)
        trailer = tables.of("trailer").read().select(F.col("RECORDS").cast("bigint").alias("stated"))
        counts = tables.processed.read().select("loaded", "rejected")
        one = counts.withColumns({"side": F.lit(side), "status": F.lit(done.status)}).join(trailer.withColumn("side", F.lit(side)), "side")
        out.append(one.select("side", "status", "loaded", "rejected", "stated"))
    return out[0].unionByName(out[1])


_FIXED = Feed(
    "fixed", (_KIND, Field("key", "CUST", "cust", "bigint", mandatory=True, key=True), Field("seg", "SEG", "seg")), patterns=("customers.dat",), detail="D", places=((1, 1), (2, 8), (10, 10)),
    segments=(Segment("Trailer", "T", (_KIND, Field("count", "RECORDS", "records")), ((1, 1), (2, 18))),), trailer=("Trailer", "RECORDS"),
)


def _fixed_lines(table, more: str) -> DataFrame:
    c = table("customer")
    details = c.select(F.concat(F.lit("D"), F.rpad(F.col("c_custkey").cast("string"), 8, " "), F.rpad("c_mktsegment", 10, " "), F.lit(more)).alias("value"))
    return details.unionByName(c.agg(F.concat(F.lit("T"), F.rpad(F.count("*").cast("string"), 18, " ")).alias("value")))


@query("""SELECT 'LOADED' AS status, c_custkey AS cust, rpad(c_mktsegment, 10, ' ') AS seg FROM customer UNION ALL SELECT 'DRIFT_FAIL', NULL, NULL""")
def ingest_fixed_width(table):
    """A fixed-width file, and one whose lines are too long, of which nothing is loaded."""
    tables, path = _landed(_fixed_lines(table, ""), "customers.dat", False)
    done = ingest.ingest_file(tables.spark, _FIXED, path, tables, RUN_TS)
    rows = ingest.standard(tables.stage.read(), _FIXED, check=False).select(F.lit(done.status).alias("status"), "cust", "seg")
    other, bad = _landed(_fixed_lines(table, "~"), "customers.dat", False)
    failed = ingest.ingest_file(other.spark, _FIXED, bad, other, RUN_TS)
    assert other.stage.read() is None
    return rows.unionByName(rows.sparkSession.range(1).select(F.lit(failed.status).alias("status"), F.lit(None).cast("bigint").alias("cust"), F.lit(None).cast("string").alias("seg")))


from millrace.plans import catalog_fields, catalog_loads  # noqa: E402, F401  they register their queries here
