"""Stated values against plain Python, hot keys in chunks against windows, greedy pairing, terms and the
catalogue against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import stated
from millrace.operators import catalogue, compare, ordered, profile, scratch, terms
from millrace.operators.quality import LossyCast
from millrace.plans import gold, resolve
from millrace.plans.contract import Value
from millrace.sources import files


def column(spark, cells, name="c"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, {name} string").orderBy("i")


def test_tables_and_single_values_settle_alike(spark):
    lengths = ["12", " 013 ", "13.0", "10,2", "10.2", "0", None, "", "x9", "7 8", "1.00"]
    assert [r.w for r in column(spark, lengths).select(stated.whole("c").alias("w")).collect()] == [stated.whole_of(x) for x in lengths] == [12, 13, 13, None, None, 0, None, None, None, None, 1]
    cells = ["VARCHAR (10) NOT NULL,", "int", "not available", None, " Column  Not Found ", "decimal(5,2) ,", "DATE not  null", "NULL", "not null", "TBD", ",", "NOTNULL"]
    assert [tuple(r.v) for r in column(spark, cells).select(stated.region_type("c").alias("v")).collect()] == [resolve.region_type(x) for x in cells]
    pairs = [(a, b) for a in ("10", "10,2", "decimal(10, 2)", None, "VARCHAR2(30 BYTE)", "DATE", "see 4.2!", " ", "3.5 ") for b in ("char(9)", "numeric ( 7 , 1 )", "date", None)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(stated.column_length("a", "b").alias("v")).collect()
    assert [(r.v["value"], r.v.state) for r in got] == [(v.value, v.state) for v in (resolve.column_length(*p) for p in pairs)]
    feeds = [(a, b, f, n) for a in ("|", "Pipe (|)", None, "Comma or pipe", "TAB delimited", "prose", "csv, comma delimited", "\\t", " ; ", "Fixed width, 120 bytes") for b in (None, "|", "x:y") for f in ("CSV", "Fixed width, 9", "", None) for n in ("a.tsv", "a.b", "", "psv")]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(feeds)], "i int, a string, b string, f string, n string").orderBy("i").select(stated.delimiter_of("a", "b", "f", "n").alias("v")).collect()
    assert [(r.v["value"], r.v.state, r.v.basis) for r in got] == [(v.value, v.state, v.basis if v.state != "question" or "no " in v.basis else "two are stated") for v in (files.delimiter_of(a, b, f or "", n) for a, b, f, n in feeds)]


def test_widths_come_from_the_first_that_states_one(spark):
    rows = [("12", "1", "3", 5, 6, 12), ("10,2", "5", "9", 5, 6, 5), ("0", "9", "5", 5, 6, 5), (None, None, None, None, 6, 6), ("13.0", None, None, None, None, 13), (None, "a", "9", None, None, None)]
    got = spark.createDataFrame(rows, "l string, a string, b string, s int, n int, want int").select("want", stated.width("l", "a", "b", F.col("s"), F.col("n")).alias("w")).collect()
    assert [r.w["value"] for r in got] == [r.want for r in got]


def test_types_are_alike_by_any_class_of_both(spark):
    pairs = {("date", "timestamp"): False, ("int", "decimal(10,2)"): False, ("int", "Number (3)"): True, ("numeric", "double"): True, ("VARCHAR2(9)", "string"): True, ("boolean", "bit"): True, ("money", "float"): True, (None, "blob"): True, ("blob", "BLOB (2)"): True, ("blob", "clob"): False, ("S9(4)", "decimal"): True, ("X(2)", "an"): True}
    rows = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, want boolean")
    assert all(r.alike == r.want for r in stated.with_alike(rows, "a", "b", stated.class_table(spark)).collect())
    own = spark.createDataFrame([("blob", 1), ("clob", 1)], "name string, class int")
    assert stated.with_alike(rows.where("b = 'clob'"), "a", "b", own).first().alike


# Hot keys.


def test_chunks_number_fill_and_add_up_as_windows_do(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 40)
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(60), rng.choice([None, 1, 2]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o int, v int, i int")
    by = [F.col("o").desc_nulls_last(), F.col("i")]
    for keys in (["k"], []):
        for name, f in {
            "number": lambda hot, keys=keys: ordered.numbered(df, keys, by, "x", hot), "fill": lambda hot, keys=keys: ordered.filled(df, keys, by, "x", F.col("v"), hot), "sum": lambda hot, keys=keys: ordered.with_running_sum(df, keys, by, F.coalesce("v", F.lit(0)), "x", hot),
            "above": lambda hot, keys=keys: ordered.with_previous(df, keys, by, {"v": "x", "i": "y"}, hot),
        }.items():
            plain, large = ({tuple(r) for r in f(hot).collect()} for hot in (10**9, 30))
            assert plain == large and len(plain) == 700, name
    assert {r["count"] for r in ordered.chunked(df, ["k"], by, 700, 40).groupBy("_chunk").count().collect()} and ordered.numbered(df.limit(0), ["k"], by, hot=1).count() == 0


def test_a_key_of_equal_rows_is_numbered_by_many_tasks(spark):
    df = spark.range(2000).select(F.lit("one").alias("k"), F.lit(5).alias("o"))
    cut = ordered.chunked(df, ["k"], [F.col("o")], 2000, 100)
    sizes = [r["count"] for r in cut.groupBy("_chunk").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 500
    assert sorted(r.n for r in ordered.numbered(df, ["k"], [F.col("o")], "n", hot=10).collect()) == list(range(1, 2001))


def test_profiles_of_hot_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), p, rng.randrange(3), rng.choice(["", None, "x", "y"])) for p in sorted(rng.sample(range(1, 3000), 600))]
    df = spark.createDataFrame(rows, "g string, p int, r int, v string").withColumn("c", F.lit(1))
    for run in (lambda hot: profile.stepped_runs(df, ["g"], "p", "r", "c", 2, hot), lambda hot: profile.forward_fill(df, ["g"], "p", "v", hot), lambda hot: profile.extent(df, ["g"], "p", 14, hot)):
        assert sorted(map(str, run(10**9).collect())) == sorted(map(str, run(50).collect()))


@pytest.mark.parametrize("tracked", [8, 10_000])
def test_the_most_frequent_values_are_exact(spark, tracked):
    """A small sketch proves little, so most columns are counted after all."""
    rng = random.Random(tracked)
    values = {"skewed": [rng.choice(["a"] * 30 + ["b"] * 29 + [f"x{i}" for i in range(40)]) for _ in range(1500)], "unique": [f"u{i}" for i in range(1500)], "few": [rng.choice(["p", "q", None]) for _ in range(1500)], "none": [None] * 1500, "tied": [f"t{i % 30}" for i in range(1500)]}
    df = spark.createDataFrame(list(zip(*values.values(), strict=True)), ", ".join(f"{c} string" for c in values)).repartition(6)
    for n in (1, 3, 50):
        got = {}
        for r in profile.most_frequent(df, list(values), n, tracked).collect():
            got.setdefault(r.column_name, []).append((-r.n, r["value"]))
        for c, own in values.items():
            want = sorted((-k, v) for v, k in collections.Counter(x for x in own if x is not None).items())[:n]
            assert sorted(got.get(c, [])) == want, (c, n)
    for kind in ("int", "string"):
        ranked = [tuple(r) for r in profile.ranked_counts(spark.createDataFrame([(12 - i % 7 if i % 5 else None,) for i in range(400)], "k int").selectExpr(f"cast(k as {kind}) k"), "k", 4).collect()]
        own = collections.Counter(12 - i % 7 if i % 5 else None for i in range(400))
        assert ranked == sorted(((None if k is None else k if kind == "int" else str(k), n) for k, n in own.items()), key=lambda r: (-r[1], r[0] is not None, r[0]))[:4]
    assert profile.most_frequent(df.limit(0), ["few"]).count() == 0


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK", 50)
    df = spark.range(2000).select((F.col("id") % 400).alias("g"), F.col("id").alias("p"), F.floor(F.col("id") / 400).alias("r"), F.lit(1).alias("c"))
    plan = ordered.numbered(df, ["g"], [F.col("p")])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [g" in plan and ", 40" in plan  # 2000 rows by 50
    runs = profile.stepped_runs(df, ["g"], "p", "r", "c")
    assert {tuple(x) for x in runs.collect()} == {(g, g, g + 1600, 5) for g in range(400)}
    assert "Aggregate" not in runs._jdf.queryExecution().optimizedPlan().toString()  # no map with an entry a run


def test_runs_begin_at_a_place_that_is_there(spark):
    df = spark.createDataFrame([("g", None, 1, 0), ("g", 4, 2, 0), ("g", 5, 3, 0), ("g", 6, 9, 0), ("h", 1, 1, None), ("h", 2, 2, None)], "g string, p int, r int, c int")
    for hot in (1, 100):
        assert {tuple(x) for x in profile.stepped_runs(df, ["g"], "p", "r", "c", 1, hot).collect()} == {("g", 4, 5, 3), ("g", 6, 6, 1), ("h", 1, 1, 1), ("h", 2, 2, 1)}


# Greedy pairing.


def greedy(left, right):
    used, out = set(), set()
    for i, g, *own in sorted(left):
        for j, h, *other in sorted(right):
            if j not in used and g is not None and g == h and all(not (a or "").strip() or not (b or "").strip() or a == b for a, b in zip(own, other, strict=True)):
                used.add(j)
                out.add((i, j))
                break
    return out


@pytest.mark.parametrize("most", [2, 7, 1000])
def test_tolerant_pairs_are_those_of_greedy(spark, most):
    rng = random.Random(most)
    side = lambda n, base: [(base + i, rng.choice(["p", "p", "p", "q", None]), rng.choice(["", "a", "b", None]), rng.choice(["", "x", " "])) for i in range(n)]
    left, right = side(25, 0), side(22, 100)
    frames = [spark.createDataFrame(x, "row long, g string, v string, w string") for x in (left, right)]
    got = compare.pair_tolerant(*frames, ["g"], ["v", "w"], "row", most)
    assert {tuple(r) for r in got.collect()} == greedy(left, right)


def test_blank_rows_pair_one_by_one(spark):
    blank = lambda base: spark.range(50).select((F.col("id") + base).alias("row"), F.lit("g").alias("g"), F.lit(None).cast("string").alias("v"))
    for most in (8, 1000):
        assert {tuple(r) for r in compare.pair_tolerant(blank(0), blank(500), ["g"], ["v"], "row", most).collect()} == {(i, 500 + i) for i in range(50)}
    assert compare.pair_tolerant(blank(0), blank(0).limit(0), ["g"], ["v"], "row").count() == 0
    assert compare.pair_tolerant(blank(0), blank(9), [], ["v"], "row").count() == 50


def test_rounds_do_not_grow_with_a_group(spark):
    rng = random.Random(5)
    side = lambda n, base: [(base + i, "g", rng.choice(["", "a", "b"]), rng.choice(["", "x"])) for i in range(n)]
    left, right = side(120, 0), side(100, 1000)
    frames = [spark.createDataFrame(x, "row long, g string, v string, w string") for x in (left, right)]
    spark.sparkContext.setJobGroup("rounds", "pairing")
    got = {tuple(r) for r in compare.pair_tolerant(*frames, ["g"], ["v", "w"], "row", 2).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert got == greedy(left, right) and jobs < 150  # 110 rounds, of which each was several jobs


# Terms.


def test_terms_over_line_ends_and_at_edges(spark):
    texts = ["alpha\nbetas alpha\nbeta", "xalpha betas", "alpha beta", "aa aa aa aa", "my alpha  beta\ralpha beta", "ends in xlpha beta"]
    own = [("alpha\nbeta", "harvested"), ("alpha beta", "harvested"), ("aa aa", "harvested"), ("lpha beta", "static"), ("alpha  betas", "harvested")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {tuple(r) for r in terms.term_hits(df, "id", "text", spark.createDataFrame(own, "term string, kind string")).collect()}
    want = set()
    for i, text in enumerate(texts):
        for term, kind in own:
            p = re.compile(re.escape(term) if kind == "static" else rf"\b{re.escape(term)}\b")
            if n := len(p.findall(text)):
                want.add((i, term, kind, n, max([len(x) for x in text.split("\n") if p.search(x)], default=0)))
    assert got == want and {w[1] for w in want} == {t for t, _ in own[:4]}


def test_terms_are_found_as_by_regular_expressions(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma9", "de.lta", "e", "(zeta)", "ALPHA", "x_alpha", "é"]
    texts = [None, "", "alpha\nbeta alpha beta", "\\E and \\Q", *("".join(rng.choice(words) + rng.choice([" ", "\n", "-", ", ", "  "]) for _ in range(rng.randrange(1, 25))) for _ in range(60))]
    own = [("alpha beta", "harvested"), ("gamma9, e", "harvested"), ("lta ", "static"), ("pha-", "static"), ("(zeta)", "harvested"), ("e e e", "static"), ("beta", "harvested"), ("abc", "static"), ("alpha", "harvested"), ("\\e and", "static"), ("de.lta", "harvested"), ("nowhere at all", "harvested"), (None, "static")]
    kept, dropped = terms.kept_terms(spark.createDataFrame(own, "term string, kind string"), spark.createDataFrame([("ALPHA",), ("at",)], "word string"))
    wanted = {("alpha beta", "harvested"), ("gamma9, e", "harvested"), ("pha-", "static"), ("(zeta)", "harvested"), ("e e e", "static"), ("\\e and", "static"), ("de.lta", "harvested"), ("nowhere at all", "harvested")}
    assert {tuple(r) for r in kept.collect()} == wanted and {r.kind: r.dropped for r in dropped.collect()} == {"harvested": 2, "static": 2}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = set()
    for i, text in enumerate(texts):
        for term, kind in wanted:
            p = re.compile(re.escape(term) if kind == "static" else rf"\b{re.escape(term)}\b", re.IGNORECASE | re.ASCII)
            if n := len(p.findall(text or "")):
                want.add((i, term, kind, n))
    got = terms.term_hits(df, "id", "text", kept)
    assert {tuple(r)[:4] for r in got.collect()} == want and len({t for _, t, *_ in want}) >= 5
    # a text isn't repeated for each of its terms: terms become rows after the last join
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" in plan and plan.index("inline(") < plan.index("Join ")
    clean = {r.id: r.text for r in terms.redacted(df, "id", "text", kept).collect()}
    assert set(clean) == set(range(len(texts))) and clean[0] is None and clean[1] == ""
    assert "[H:" in clean[2] and not [i for i, t in clean.items() if re.search(r"(?i)(?<!\w)alpha beta(?!\w)", t or "", re.ASCII)]


def brute(texts, own):
    out = set()
    for i, text in enumerate(texts):
        for term, kind in own:
            p = re.compile(re.escape(term) if kind == "static" else rf"\b{re.escape(term)}\b", re.IGNORECASE | re.ASCII)
            if n := len(p.findall(text)):
                out.add((i, term, kind, n, max([len(x) for x in text.split("\n") if p.search(x)], default=0)))
    return out


@pytest.mark.parametrize(("task", "key"), [(2_000_000, 8), (7, 2)])
def test_terms_of_common_and_of_space_only_parts(spark, monkeypatch, task, key):
    monkeypatch.setattr(ordered, "TASK", task)  # at 7 rows a task, frequent runs are dealt
    monkeypatch.setattr(terms, "KEY", key, raising=False)
    rng = random.Random(5)
    bits = ["a,", "and", "xand", "ands", "lé", "é.", "lé.lé.", "--", "a--b", "^and", "a$", "\u2028x", "abcabcabcabc", "x.abcabcabc."]
    texts = ["", "\n\n\n\n", " \t", "\tand a,", "a,\nand", "a, \t and", *("".join(rng.choice(bits) + rng.choice([" ", " ", " ", "\n", "\t ", "\r"]) for _ in range(rng.randrange(1, 60))) for _ in range(80))]
    plain = ["and", "AND", "lé", "lé.", "--", "a--", "abcabc", "bcab", "^and", "a$", "abcabcabcab", "x.abcabcabc", "\u2028x"]
    spaced = ["a, and", "A,\nand", "and a,", "lé é", "lé.lé. and", "\tand", "and\t ", "a, \t and", "and and and", "\n\n\n\n", "\t", "abc x.abc", "abcabcabcabc ^and", "and nowhere", "-- --", "-- a"]
    own = [(t, kind) for t in plain + spaced for kind in ("static", "harvested")]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [tuple(r) for r in terms.term_hits(df, "id", "text", spark.createDataFrame([*own, ("", "static"), (None, "static")], "term string, kind string")).collect()]
    want = {(*w[:4], 0 if "\n" in w[1] else w[4]) for w in brute(texts, own)}
    assert len(got) == len(set(got)) and set(got) == want and {w[1] for w in want} == {t for t, _ in own if t != "and nowhere"}
    assert (1, "\n\n\n\n", "static", 1, 0) in want  # a text of nothing but space


def test_texts_are_searched_only_where_two_parts_stand_side_by_side(spark, monkeypatch):
    texts = [f"alpha gamma{i % 7} beta omega." if i % 50 else "alpha beta omega." for i in range(200)]
    own = [("alpha beta", "harvested"), ("ega.", "static"), ("omega", "harvested")]
    kept, spooled = terms.spool, []
    monkeypatch.setattr(terms, "spool", lambda df: spooled.append(kept(df)) or spooled[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {tuple(r) for r in terms.term_hits(df, "id", "text", spark.createDataFrame(own, "term string, kind string")).collect()} == brute(texts, own)
    asked = [x for x in spooled if "id" in x.columns]
    assert len(asked) == 1 and {r.id for r in asked[0].collect()} == {0, 50, 100, 150} == {i for i, t in enumerate(texts) if "alpha beta" in t} and asked[0].count() == 4


# The catalogue.


def test_tables_against_their_contract(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf")
    try:
        spark.sql("CREATE TABLE shelf.good (a INT COMMENT 'first', b DECIMAL(5, 2)) USING parquet COMMENT 'kept' TBLPROPERTIES ('tag.DOMAIN' = 'd', 'tag.SUBDOMAIN' = 's', 'other' = 'x')")
        spark.sql("CREATE TABLE shelf.bad (a BIGINT, c STRING) USING parquet TBLPROPERTIES ('tag.DOMAIN' = 'e')")
        names = ["shelf.good", "shelf.bad", "shelf.none"]
        said = catalogue.expected(spark, {n: StructType.fromDDL("A int COMMENT 'first', b decimal(5,2)") for n in names})
        comments = spark.createDataFrame([("shelf.good", "kept"), ("shelf.bad", "kept")], catalogue.TABLES)
        tags = spark.createDataFrame([(n, t, v) for n in names[:2] for t, v in (("DOMAIN", "d"), ("SUBDOMAIN", "s"))], catalogue.TAGS)
        got = {(r.table_name, r.check): (r.result, r.found) for r in catalogue.table_checks(catalogue.deployed(spark, names), said, comments, tags).collect()}
    finally:
        spark.sql("DROP DATABASE shelf CASCADE")
    assert {k[1]: v for k, v in got.items() if k[0] == "shelf.good"} == {"table_exists": ("PASS", "1"), "columns_match": ("PASS", "0 differences"), "comments_present": ("PASS", "1"), "table_comment": ("PASS", "kept"), "table_tags": ("PASS", "DOMAIN = d, SUBDOMAIN = s")}
    assert {k[1]: v for k, v in got.items() if k[0] == "shelf.bad"} == {"table_exists": ("PASS", "1"), "columns_match": ("FAIL", "DDL 1 a int, DDL 2 b decimal(5,2), deployed 1 a bigint, deployed 2 c string"), "comments_present": ("FAIL", "0"), "table_comment": ("FAIL", "(no table comment)"), "table_tags": ("FAIL", "DOMAIN = e")}
    assert got[("shelf.none", "table_exists")] == ("FAIL", "0") and got[("shelf.none", "columns_match")][0] == "FAIL"


def test_gold_plans_stop_where_a_type_loses_values(spark):
    t = {"p": spark.createDataFrame([("1", "7"), ("x1", "8"), (" ", None)], "k string, v string")}
    feed = gold.GoldFeed("g", (gold.GoldColumn("k", "int", Value("k")), gold.GoldColumn("v", "int", Value("v"))), (gold.SourceSet("p"), gold.SourceSet("p", filters=(Value("v = '7'"),))))
    with pytest.raises(LossyCast, match="^k as int: 1 rows$"):
        gold.build(feed, t)
    assert gold.build(feed, t, check=False).count() == 4
    assert [tuple(r) for r in gold.cast_audit(feed, t).collect()] == [(1, "k", "int", 1)]


def test_scratch_tables_are_cleared(spark):
    df = scratch.spool(spark.range(3))
    assert df.count() == 3
    scratch.clear(spark)
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(df.inputFiles()[0] if False else scratch.home(spark)).count()
