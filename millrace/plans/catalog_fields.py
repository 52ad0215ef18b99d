"""Registered queries of stated values, types as a relation, hot keys, tolerant pairing, sensitive terms
and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import stated
from millrace.operators import catalogue, compare, drift, ordered, profile, terms
from millrace.plans.catalog import query

# Cells of a table of fields, made from the key, so that every form stands there many times.

_CELLS = {
    "length": ("'12'", "' 013 '", "'13.0'", "'10,2'", "'0'", "NULL", "''", "'x9'"),
    "start": ("'5'", "'9'", "NULL", "'7.00'", "'a'"),
    "finish": ("'14'", "'8'", "'7'"),
}


def _pick(values: tuple[str, ...], key: str) -> str:
    """The SQL of one of several cells, by a key; Spark and DuckDB both read it."""
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


_FIELDS = f"SELECT p_partkey AS k, {', '.join(f'{_pick(v, "p_partkey")} AS {n}' for n, v in _CELLS.items())}, CASE WHEN p_size < 10 THEN p_size END AS span FROM part"
_WHOLE = "TRY_CAST(nullif(regexp_extract({0}, '^\\s*([0-9]+)(\\.0+)?\\s*$', 1), '') AS INT)"



@query(f"""WITH f AS ({_FIELDS}), w AS (SELECT k, {_WHOLE.format('length')} AS own, {_WHOLE.format('start')} AS a, {_WHOLE.format('finish')} AS b, span FROM f)
SELECT k, CASE WHEN own > 0 THEN own WHEN b >= a THEN b - a + 1 ELSE span END AS width, CASE WHEN own > 0 OR b >= a THEN 'filled' WHEN span IS NOT NULL THEN 'proposed' ELSE 'question' END AS state,
  CASE WHEN own > 0 THEN 'length' WHEN b >= a THEN 'places' WHEN span IS NOT NULL THEN 'dictionary' ELSE 'no width is stated' END AS basis FROM w""")
def stated_widths(table):
    rows = table("part").select(F.col("p_partkey").alias("k"), *(F.expr(_pick(v, "p_partkey")).alias(n) for n, v in _CELLS.items()), F.expr("CASE WHEN p_size < 10 THEN p_size END").alias("span"))
    return rows.select("k", stated.width("length", "start", "finish", F.col("span").cast("int")).alias("w")).select("k", F.col("w.value").alias("width"), "w.state", "w.basis")


_LENGTHS = ("'10'", "'10,2'", "'decimal(10, 2)'", "NULL", "'VARCHAR2(30 BYTE)'", "'DATE'", "'see 4.2!'", "' '")
_KINDS = ("'char(9)'", "'numeric ( 7 , 1 )'", "'date'", "NULL", "'timestamp'")


@query(f"""WITH f AS (SELECT p_partkey AS k, trim(coalesce({_pick(_LENGTHS, 'p_partkey')}, '')) AS s, {_pick(_KINDS, 'p_partkey')} AS t FROM part),
m AS (SELECT *, regexp_matches(s, '^\\s*[0-9]+([.,][0-9]+)?\\s*$') AS own, regexp_extract(s, '\\(\\s*([0-9]+(\\s*,\\s*[0-9]+)?)(\\s+(BYTE|CHAR))?\\s*\\)', 1) AS a, regexp_extract(coalesce(t, ''), '\\(\\s*([0-9]+(\\s*,\\s*[0-9]+)?)(\\s+(BYTE|CHAR))?\\s*\\)', 1) AS b FROM f)
SELECT k, CASE WHEN own THEN s WHEN a <> '' THEN replace(a, ' ', '') WHEN b <> '' THEN replace(b, ' ', '') END AS length,
  CASE WHEN own THEN 'filled' WHEN a <> '' OR b <> '' THEN 'proposed' WHEN s = '' OR regexp_matches(s, '^[A-Za-z][A-Za-z0-9 ]*$') THEN 'none' ELSE 'question' END AS state FROM m""")
def stated_lengths(table):
    rows = table("part").select(F.col("p_partkey").alias("k"), F.expr(_pick(_LENGTHS, "p_partkey")).alias("s"), F.expr(_pick(_KINDS, "p_partkey")).alias("t"))
    return rows.select("k", stated.column_length("s", "t").alias("v")).select("k", F.col("v.value").alias("length"), "v.state")


_REGION = ("'VARCHAR (10) NOT NULL,'", "'int'", "'not available'", "NULL", "' Column  Not Found '", "'decimal(5,2) ,'", "'DATE not  null'", "'NOT SUPPLIED,'", "'null'", "'TBD'")


@query(f"""WITH f AS (SELECT p_partkey AS k, trim(rtrim(trim(regexp_replace(coalesce({_pick(_REGION, 'p_partkey')}, ''), '\\s+', ' ', 'g')), ', ')) AS t FROM part)
SELECT k, CASE WHEN upper(t) NOT IN ('NOT AVAILABLE', 'NOT SUPPLIED', 'COLUMN NOT FOUND', 'NULL', '') THEN replace(trim(regexp_replace(t, '(?i)\\s*\\bnot null\\b', '')), ' (', '(') END AS type,
  CASE WHEN upper(t) NOT IN ('NOT AVAILABLE', 'NOT SUPPLIED', 'COLUMN NOT FOUND', 'NULL', '') THEN NOT regexp_matches(t, '(?i)\\bnot null\\b') END AS nullable FROM f""")
def region_types(table):
    rows = table("part").select(F.col("p_partkey").alias("k"), F.expr(_pick(_REGION, "p_partkey")).alias("t"))
    return rows.select("k", stated.region_type("t").alias("v")).select("k", "v.type", "v.nullable")


_STATED = ("'|'", "'Pipe (|)'", "NULL", "'Comma or pipe'", "'TAB delimited'", "'File Data Ingestion'", "'csv, comma delimited'")
_OTHER = ("NULL", "'|'", "','", "NULL", "NULL")
_FORMS = ("'CSV'", "'Fixed width, 120 bytes'", "'text'")
#: What the cells above name.
_NAMED = {"'|'": "'|'", "'Pipe (|)'": "'|'", "NULL": "NULL", "'Comma or pipe'": "NULL", "'TAB delimited'": "chr(9)", "'File Data Ingestion'": "NULL", "'csv, comma delimited'": "','", "','": "','"}


@query(f"""WITH f AS (SELECT p_partkey AS k, {_pick(tuple(_NAMED[x] for x in _STATED), 'p_partkey')} AS a, {_pick(tuple(_NAMED[x] for x in _OTHER), 'p_partkey')} AS b, lower({_pick(_FORMS, 'p_partkey')}) AS form,
  CASE WHEN p_size < 20 THEN 'in.tsv' ELSE 'in.dat' END AS name FROM part)
SELECT k, CASE WHEN a <> b THEN NULL WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, b) WHEN form LIKE 'fixed%' THEN '' WHEN form = 'csv' THEN ',' WHEN name = 'in.tsv' THEN chr(9) END AS delimiter,
  CASE WHEN a <> b THEN 'question' WHEN a IS NOT NULL OR b IS NOT NULL OR form LIKE 'fixed%' THEN 'filled' WHEN form = 'csv' OR name = 'in.tsv' THEN 'proposed' ELSE 'question' END AS state FROM f""")
def delimiters(table):
    rows = table("part").select(F.col("p_partkey").alias("k"), F.expr(_pick(_STATED, "p_partkey")).alias("a"), F.expr(_pick(_OTHER, "p_partkey")).alias("b"), F.expr(_pick(_FORMS, "p_partkey")).alias("form"), F.expr("CASE WHEN p_size < 20 THEN 'in.tsv' ELSE 'in.dat' END").alias("name"))
    return rows.select("k", stated.delimiter_of("a", "b", "form", "name").alias("v")).select("k", F.col("v.value").alias("delimiter"), "v.state")


_TYPES = ("'date'", "'timestamp'", "'int'", "'decimal(10,2)'", "'VARCHAR2(30)'", "'string'", "'boolean'", "'bit'", "'double'", "'money'", "NULL", "'numeric'", "'X(10)'", "'S9(4)'", "'blob'", "'Number (3)'")


@query(f"""WITH classes(c, n) AS (SELECT unnest(range({len(stated.TYPE_CLASSES)})), unnest([{', '.join(str(list(x)) for x in stated.TYPE_CLASSES)}])), members AS (SELECT c, unnest(n) AS n FROM classes),
f AS (SELECT p_partkey AS k, {_pick(_TYPES, 'p_partkey')} AS a, {_pick(_TYPES, '(p_partkey // 16 + p_size)')} AS b FROM part),
t AS (SELECT *, regexp_replace(regexp_replace(lower(coalesce(a, '')), '\\(.*?\\)', '', 'g'), '\\s+', '', 'g') AS x, regexp_replace(regexp_replace(lower(coalesce(b, '')), '\\(.*?\\)', '', 'g'), '\\s+', '', 'g') AS y FROM f)
SELECT k, x = '' OR y = '' OR x = y OR EXISTS (SELECT 1 FROM members p JOIN members q ON p.c = q.c WHERE p.n = x AND q.n = y) AS alike FROM t""")
def type_classes(table):
    """Types of two documents, by classes of which a type may be in two."""
    rows = table("part").select(F.col("p_partkey").alias("k"), F.expr(_pick(_TYPES, "p_partkey")).alias("a"), F.expr(_pick(_TYPES, "(floor(p_partkey / 16) + p_size)")).alias("b"))
    return stated.with_alike(rows, "a", "b", stated.class_table(rows.sparkSession)).select("k", "alike")


@query("""WITH a AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'varchar(9)' ELSE 'date' END AS kind FROM part), b AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN 'String' WHEN p_size % 3 = 1 THEN 'timestamp' END AS kind FROM part)
SELECT 'f' || k AS name, 'type' AS finding FROM a JOIN b USING (k) WHERE (a.kind = 'date' AND b.kind IS NOT NULL) OR (a.kind <> 'date' AND b.kind = 'timestamp')""")
def dictionary_types(table):
    """A date is no timestamp, and a blank type agrees with anything."""
    p = table("part").select(F.concat(F.lit("f"), "p_partkey").alias("name"), F.lit(1).alias("length"), F.lit(1).alias("position"), "p_size")
    found = p.withColumn("kind", F.when(F.col("p_size") % 2 == 0, "varchar(9)").otherwise("date")).drop("p_size")
    said = p.withColumn("kind", F.when(F.col("p_size") % 3 == 0, "String").when(F.col("p_size") % 3 == 1, "timestamp")).drop("p_size")
    return drift.dictionary_drift(found, said)


# Hot keys: a key with far more rows than ``hot`` is worked on in chunks.

HOT = 500


@query("SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey, l_linenumber)::INT AS n FROM lineitem")
def ordinals_of_hot_keys(table):
    rows = table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return ordered.numbered(rows, ["l_returnflag"], [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")], "n", HOT).drop("l_shipdate")


@query("SELECT o_orderkey, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey::VARCHAR END IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS v FROM orders")
def forward_fill_of_one_block(table):
    rows = table("orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey").cast("string")).alias("v"))
    return profile.forward_fill(rows, [], "o_orderkey", "v", HOT)


@query("""WITH x AS (SELECT o_orderstatus AS g, o_orderkey AS pos, o_orderpriority AS z, o_custkey % 3 AS r FROM orders), y AS (SELECT *, CASE WHEN r = lag(r) OVER w + 1 AND z = lag(z) OVER w THEN 0 ELSE 1 END AS b FROM x WINDOW w AS (PARTITION BY g ORDER BY pos)),
q AS (SELECT *, sum(b) OVER (PARTITION BY g ORDER BY pos) AS i FROM y) SELECT g, min(pos) AS first, max(pos) AS last, count(*) AS length FROM q GROUP BY g, i HAVING count(*) >= 3""")
def stepped_runs_of_hot_groups(table):
    rows = table("orders").select(F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("z"), (F.col("o_custkey") % 3).alias("r"))
    return profile.stepped_runs(rows, ["g"], "pos", "r", "z", hot=HOT)


@query("""WITH x AS (SELECT o_orderstatus AS g, o_orderkey AS pos FROM orders), y AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY g ORDER BY pos), 0) > 8 AS j FROM x),
z AS (SELECT *, sum(j::INT) OVER (PARTITION BY g ORDER BY pos) > 0 AS beyond FROM y) SELECT g, coalesce(max(pos) FILTER (WHERE NOT beyond), 0) AS last, count(*) FILTER (WHERE beyond) AS beyond FROM z GROUP BY g""")
def extent_of_hot_groups(table):
    return profile.extent(table("orders").select(F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("pos")), ["g"], "pos", 8, HOT)


_SIDES = """l AS (SELECT s_suppkey AS row, s_nationkey AS g, CASE WHEN s_suppkey % 3 <> 0 THEN 'v' || s_suppkey % 4 ELSE '' END AS v, CASE WHEN s_suppkey % 5 <> 0 THEN 'w' || s_suppkey % 2 ELSE '' END AS w FROM supplier),
r AS (SELECT s_suppkey + 100000 AS row, s_nationkey AS g, CASE WHEN s_suppkey % 2 <> 0 THEN 'v' || s_suppkey % 4 ELSE '' END AS v, CASE WHEN s_suppkey % 7 <> 0 THEN 'w' || s_suppkey % 2 ELSE '' END AS w FROM supplier WHERE s_suppkey % 11 <> 0)"""


@query(f"""WITH RECURSIVE {_SIDES}, o AS (SELECT *, row_number() OVER (ORDER BY row) AS i FROM l), m AS (SELECT o.i, r.row AS r_row FROM o JOIN r ON o.g = r.g AND (o.v = '' OR r.v = '' OR o.v = r.v) AND (o.w = '' OR r.w = '' OR o.w = r.w)),
c AS (SELECT o.i, o.row, coalesce(list_sort(list(m.r_row) FILTER (WHERE m.r_row IS NOT NULL)), []) AS fits FROM o LEFT JOIN m ON m.i = o.i GROUP BY o.i, o.row),
step(i, used, l_row, r_row) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL SELECT c.i, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, c.row, f FROM (SELECT c.i, c.row, step.used, list_filter(c.fits, lambda x: NOT list_contains(step.used, x))[1] AS f FROM step JOIN c ON c.i = step.i + 1) c)
SELECT l_row, r_row FROM step WHERE r_row IS NOT NULL""")
def pair_greedy(table):
    """Each left row in order takes the first right row that is left over; chunks of a few rows, so
    groups meet along diagonals."""
    s, k = table("supplier"), F.col("s_suppkey")
    side = lambda df, n, a, b: df.select((k + n).alias("row"), F.col("s_nationkey").alias("g"), F.when(k % a != 0, F.concat(F.lit("v"), k % 4)).alias("v"), F.when(k % b != 0, F.concat(F.lit("w"), k % 2)).otherwise(" ").alias("w"))
    return compare.pair_tolerant(side(s, 0, 3, 5), side(s.where(k % 11 != 0), 100000, 2, 7), ["g"], ["v", "w"], "row", 10)


_TERMS = r"""t0 AS (SELECT DISTINCT regexp_extract(text, '^\S+\s+\S+') AS term, 'harvested' AS kind FROM documents WHERE source IN ('src1', 'src2')
  UNION SELECT DISTINCT regexp_extract(text, '\S{3,9}$'), 'static' FROM documents WHERE source = 'src3'),
known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{2,}'))) AS w FROM documents WHERE source = 'src4'),
t1 AS (SELECT trim(term) AS term, kind FROM t0),
t AS (SELECT DISTINCT term, kind FROM t1 WHERE kind = 'static' AND length(term) >= 4
  UNION SELECT term, kind FROM (SELECT DISTINCT term, kind, unnest(CASE WHEN len(list_filter(string_split_regex(lower(term), '[^a-z0-9]+'), lambda x: x <> '')) = 0 THEN [NULL] ELSE list_filter(string_split_regex(lower(term), '[^a-z0-9]+'), lambda x: x <> '') END) AS w FROM t1 WHERE kind <> 'static')
    WHERE length(term) >= 6 AND (w IS NULL OR w NOT IN (SELECT w FROM known)) GROUP BY term, kind)"""


@query(rf"""WITH {_TERMS}, q AS (SELECT term, kind, lower(term) AS low, CASE WHEN kind = 'static' THEN regexp_escape(lower(term)) ELSE '\b' || regexp_escape(lower(term)) || '\b' END AS p FROM t),
d AS (SELECT doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL), c AS (SELECT * FROM d JOIN q ON contains(x, low)),
h AS (SELECT *, len(regexp_extract_all(x, p)) AS n FROM c)
SELECT doc_id, term, kind, n::BIGINT AS occurrences, coalesce(list_max(list_transform(list_filter(string_split(x, chr(10)), lambda y: len(regexp_extract_all(y, p)) > 0), lambda y: length(y))), 0)::INT AS longest_line FROM h WHERE n > 0""")
def term_scan(table):
    """Terms from some documents' texts, looked for in all of them: phrases between word boundaries and
    endings anywhere, without those whose words are all known."""
    d = table("documents")
    words = d.where("source in ('src1', 'src2')").select(F.regexp_extract("text", r"^\S+\s+\S+", 0).alias("term"), F.lit("harvested").alias("kind"))
    ends = d.where("source = 'src3'").select(F.regexp_extract("text", r"\S{3,9}$", 0).alias("term"), F.lit("static").alias("kind"))
    known = d.where("source = 'src4'").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("word"))
    kept, _ = terms.kept_terms(words.unionByName(ends), known)
    return terms.term_hits(d.select("doc_id", "text"), "doc_id", "text", kept)


@query("""WITH n AS (SELECT unnest(['customer', 'nation', 'orders', 'region']) AS table_name)
SELECT table_name, 'table_exists' AS "check", CASE WHEN table_name = 'region' THEN 'FAIL' ELSE 'PASS' END AS result, CASE WHEN table_name = 'region' THEN '0' ELSE '1' END AS found, '1' AS expected FROM n
UNION ALL SELECT table_name, 'columns_match', CASE WHEN table_name IN ('customer', 'orders') THEN 'PASS' ELSE 'FAIL' END, CASE table_name WHEN 'customer' THEN '0 differences' WHEN 'orders' THEN '0 differences'
  WHEN 'nation' THEN 'DDL 2 n_name string, deployed 2 n_title string' ELSE 'DDL 1 r_regionkey ' || (SELECT CASE typeof(r_regionkey) WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' END FROM region LIMIT 1) || ', DDL 2 r_name string' END, '0 differences' FROM n
UNION ALL SELECT table_name, 'comments_present', CASE WHEN table_name = 'customer' THEN 'FAIL' ELSE 'PASS' END, '0', CASE WHEN table_name = 'customer' THEN '1' ELSE '0' END FROM n""")
def catalogue_checks(table):
    """Views over the tables against the tables' own schemas: one is missing, one has another column, and
    one lacks a comment."""
    frames = {n: table(n) for n in ("customer", "nation", "orders", "region")}
    spark = frames["nation"].sparkSession
    schemas = {n: df.schema for n, df in frames.items()}
    schemas["region"] = frames["region"].select("r_regionkey", "r_name").schema
    said = catalogue.expected(spark, schemas).withColumn("comment", F.when(F.col("column_name") == "c_name", "who it is"))
    frames["nation"] = frames["nation"].withColumnRenamed("n_name", "n_title")
    for n, df in frames.items():
        if n != "region":
            df.createOrReplaceTempView(f"checked_{n}")
    there = catalogue.deployed(spark, [f"checked_{n}" for n in frames])
    plain = tuple(df.withColumn("table_name", F.replace("table_name", F.lit("checked_"), F.lit(""))) for df in there)
    return catalogue.table_checks(plain, said)
