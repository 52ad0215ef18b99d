"""Scans, segments, drift, contracts and whole loads, on small files made here."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.functions import cells
from millrace.operators import closure, compare, drift, profile, quality, rules, upsert
from millrace.plans import gold, ingest, resolve, tables
from millrace.plans.contract import ContractError, Feed, Field, OpenQuestions, Segment, Value, spark_type
from millrace.sources import files, segments
from millrace.streaming.arrivals import stream_stage

SHIPMENTS = Feed(
    "shipments",
    (
        Field("parcel", "PARCEL", "parcel_id", mandatory=True, key=True, sensitive=True),
        Field("depot", "DEPOT", "depot", mandatory=True),
        Field("kilos", "KILOS", "weight", "decimal(9,3)"),
        Field("sent_on", "SENT", "sent", "date"),
    ),
    patterns=("ship-YYYYMMDD-HHMM.csv", "late_*.csv"),
)
TOP = "parcel,depot,kilos,sent_on"
MON, TUE, NEXT = "2024-03-04 06:30:00", "2024-03-05 06:30:00", "2024-03-14 06:30:00"


@pytest.fixture
def drop(tmp_path):
    """Writes a file of lines and returns its path."""

    def write(*lines, name="ship-20240304-0630.csv"):
        path = tmp_path / "landing" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(f"{x}\n" for x in lines))
        return str(path)

    return write


@pytest.fixture
def home(spark, tmp_path):
    return ingest.Tables(spark, str(tmp_path / "tables"))


def load(home, path, ts=MON, feed=SHIPMENTS, **more):
    return ingest.ingest_file(home.spark, feed, path, home, ts, **more)


# Names and addresses.


def test_patterns_of_names():
    fits = lambda pattern, *names: [bool(files.name_pattern(pattern).match(n)) for n in names]
    assert fits("feed_HHMM.dat", "feed_0915.dat", "FEED_2359.DAT", "feed_HHMM.dat", "feed_091.dat") == [True, True, False, False]
    assert fits("x-CCYY.MM.DD*", "x-2024.03.04", "x-2024.03.04.gz", "x-24.03.04") == [True, True, False]
    assert fits("SUMMER_MM", "summer_07", "su07er_07", "summer_07x") == [True, False, False]
    assert fits("YYYYMMDDHHMMSS", "20240304063000", "2024030406300") == [True, False]
    assert fits("MM_MM(1)", "01_02(1)", "01_021") == [True, False]
    for token in files.DATE_TOKENS:
        assert fits(f"a.{token}", "a." + "7" * len(token), "a." + "7" * (len(token) + 1), f"a{token}") == [True, False, False]


def test_admission_and_codes():
    assert files.admit("late_anything.csv", list(SHIPMENTS.patterns)) == "late_*.csv"
    with pytest.raises(files.UnrecognizedFile):
        files.admit("ship-20240304.csv", list(SHIPMENTS.patterns))
    assert files.expand_codes("a_<R>_b", "<R>", ["n", "s", "e"]) == (["a_n_b", "a_s_b", "a_e_b"], False)
    assert files.expand_codes("a_<R>_b", "<R>", []) == (["a_<R>_b"], True) and files.expand_codes("a", "<R>", ["n"]) == (["a"], False)


def test_delimiters_and_addresses():
    assert files.delimiter_of(";", None).get() == ";" and files.delimiter_of(";", ";", "csv").get() == ";"
    assert files.delimiter_of(";", "|").state == "question" and files.delimiter_of(None, None).state == "question"
    assert (files.delimiter_of("Pipe separated", None).value, files.delimiter_of(None, None, "PIPE").value, files.delimiter_of(None, None, "", "a.TSV").state) == ("|", "|", "proposed")
    assert files.delimiter_of(None, None, "fixed width").value == "" and files.delimiter_of(",", "|", "fixed width").state == "question"
    assert files.address("raw", "/a/b", "store.example") == "abfss://raw@store.example/a/b" and files.address("raw", "file:///x", "h") == "file:///x"


def test_discovery_and_archive(spark, drop, tmp_path):
    one, two = drop(TOP), drop(TOP, name="late_1.csv")
    names = lambda pattern, **day: [p.rpartition("/")[2] for p in files.discover(spark, str(tmp_path / "landing"), pattern, **day)]
    assert names("*.csv") == ["late_1.csv", "ship-20240304-0630.csv"] and names("late*") == ["late_1.csv"] and names("*", modified_on="2001-01-01") == []
    moved = files.archive(spark, [one], str(tmp_path / "done"))
    assert moved == [f"file:{tmp_path}/done/ship-20240304-0630.csv"] or moved[0].endswith("/done/ship-20240304-0630.csv")
    drop(TOP)
    with pytest.raises(FileExistsError):
        files.archive(spark, [two, one], str(tmp_path / "done"))
    assert names("*.csv") == ["late_1.csv", "ship-20240304-0630.csv"]


def test_codes_by_the_first_source_that_knows(spark):
    names = spark.createDataFrame([("ohio_7.txt",), ("iowa_ohio.txt",), ("plan42.x",), ("none",)], "name string")
    plans = spark.createDataFrame([("plan42", "P")], "key string, code string")
    states = spark.createDataFrame([("ohio", "O"), ("iowa", "I"), ("plan42", "Q"), ("7", "S")], "key string, code string")
    assert {tuple(r) for r in files.keyed_codes(names, plans, states).collect()} == {("ohio_7.txt", "O"), ("plan42.x", "P")}


def test_table_reads_take_plain_names(spark):
    spark.range(50).createOrReplaceTempView("few")
    assert files.read_table(spark, "few", ["id"], 7).count() == 7
    for bad in (("few; drop", ["id"], 5), ("few", ["id--"], 5), ("few", ["id"], 0), ("few", ["id"], 10_001)):
        with pytest.raises(ValueError):
            files.read_table(spark, *bad)


# Lines and segments.


def test_lines_keep_empty_fields_and_lose_footers(spark, drop):
    lines = files.read_lines(spark, drop("A^1^", "", "B^^", "   ", "END^2", name="x.txt"))
    assert [r.f for r in lines.orderBy("_id").select(files.split_fields("value", "^").alias("f")).collect()] == [["A", "1", ""], ["B", "", ""], ["END", "2"]]
    assert sorted(r.value for r in files.drop_footer(lines).collect()) == ["A^1^", "B^^"]


def test_segments_by_place_over_many_splits(spark, drop):
    """A file is read in several tasks, and its first record is still the header."""
    lines = ["first,row"] + [f"d{i},{'y' * 40}" for i in range(3000)] + ["END,3000", "d-last,z"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = segments.by_position(files.read_lines(spark, drop(*lines, name="many.txt")), ",", "END")
        assert rows.rdd.getNumPartitions() >= 1 and {r.segment: r.n for r in rows.groupBy("segment").agg(F.count("*").alias("n")).collect()} == {"Header": 1, "Detail": 3001, "Trailer": 1}
        assert rows.where("segment = 'Header'").first().value == "first,row"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_segments_by_marker_and_width(spark, drop):
    lines = files.read_lines(spark, drop("H;x", "R;1;2", "R;1", "R;1;2;3", "?;1", name="m.txt"))
    rows = segments.by_discriminator(lines, ";", {"Header": "H", "Detail": "R"})
    counts = {r.segment: (r.records, r.short_rows, r.long_rows) for r in segments.field_counts(rows, {"Header": 2, "Detail": 3}).collect()}
    assert counts == {"Header": (1, 0, 0), "Detail": (3, 1, 1), None: (1, 0, 0)}
    found = drift.segment_drift(segments.field_counts(rows, {"Header": 2, "Detail": 3}).collect())
    assert (found.short_rows, found.long_rows, found.unknown_rows, found.failed) == (1, 1, 1, True)
    assert not drift.segment_drift([]).failed and drift.segment_drift(segments.field_counts(rows.where("segment is null"), {"Header": 2}).collect()).failed
    wide = files.read_lines(spark, drop("Q12ab", "Q12abc", "Q12a", "Zxxxx", name="w.txt"))
    layout = {"Detail": [("kind", 1, 1), ("n", 2, 2), ("t", 4, 2)]}
    for exact, fit in ((True, 1), (False, 2)):
        rows = segments.by_width(wide, layout, {"Detail": "Q"}, exact)
        assert rows.where("_field_count = 3").count() == fit and rows.where("segment is null").count() == 1
    assert segments.part(rows, "Detail", ["kind", "n", "t"]).first().n == "12"
    tested = segments.by_width(wide, {"Odd": [("all", 1, 5)], **layout}, {"Detail": "Q"}, tests={"Odd": "value like 'Z%' or length(value) = 6"})
    assert {r.value: r.segment for r in tested.collect()} == {"Q12ab": "Detail", "Q12abc": "Odd", "Q12a": "Detail", "Zxxxx": "Odd"}
    assert {(r.short_rows) for r in drift.short_lines(wide, 5).collect()} == {1}


def test_first_record_drift():
    found = drift.first_record_drift('"b", a ,"c"', ",", ["a", "b", "d"])
    assert (found.missing, found.extra, found.failed) == (("d",), ("c",), True)
    assert drift.first_record_drift("1|2", "|", ["a", "b", "c"], header=False).missing == ("c",)
    assert not drift.first_record_drift("1|2|3|4", "|", ["a", "b", "c"], header=False).failed


# Loads.


def test_load_twice_by_name(home, drop):
    path = drop(TOP, "P1,north,12.5,2024-03-01", "P2,south,,")
    first = load(home, path)
    assert (first.status, first.counts) == (ingest.LOADED, {"loaded": 2, "rejected": 0, "recycled": 0})
    drop("sent_on,colour,kilos,depot,parcel", "2024-03-01,red,13,north,P1", ",blue,,south,P2")
    again = load(home, path, TUE)
    rows = {r.PARCEL: r for r in home.stage.read().collect()}
    assert again.drift.extra == ("colour",) and sorted(rows) == ["P1", "P2"]
    assert (rows["P1"].KILOS, str(rows["P1"].created), str(rows["P1"].updated)) == ("13", MON, TUE)
    typed = ingest.standard(home.stage.read(), SHIPMENTS).where("parcel_id = 'P1'").first()
    assert (str(typed.weight), str(typed.sent)) == ("13.000", "2024-03-01")
    assert "- status: LOADED" in again.report() and "- drift: extra ('colour',)" in again.report()
    assert {(r.step, r["rows"]) for r in home.report.read().collect()} == {("read", 2), ("rejects", 0), ("stage", 2)}


def test_loads_leave_other_files_alone(home, drop):
    load(home, drop(TOP, "P1,north,1,", "P2,east,2,"))
    before = home.stage.parts()
    load(home, drop(TOP, "P1,west,3,", name="late_a.csv"))
    after = home.stage.parts()
    assert after["ship-20240304-0630.csv"] == before["ship-20240304-0630.csv"] and sorted(after) == ["late_a.csv", "ship-20240304-0630.csv"]
    assert home.stage.read().count() == 3 and home.stage.read(["late_a.csv"]).first().DEPOT == "west"


def test_rejects_keep_the_record_and_mask_the_key(home, drop):
    done = load(home, drop(TOP, "TRACKING-99-XYZ,,4,", ",north,5,", "P3,south,6,"))
    assert done.counts == {"loaded": 1, "rejected": 2, "recycled": 0} and done.status == ingest.LOADED
    assert {(r.column_name, r.key_masked) for r in home.errors.read().collect()} == {("DEPOT", "*" * 11 + "-XYZ"), ("PARCEL", "<null>")}
    assert {(r.KILOS, r.reject_reason) for r in home.rejects.read().collect()} == {("4", "DEPOT"), ("5", "PARCEL")}


def test_nothing_is_written_for_a_bad_layout(home, drop):
    done = load(home, drop("parcel,depot,kilos", "P,n,1"))
    assert done.status == ingest.DRIFT_FAIL and done.drift.missing == ("sent_on",) and home.stage.read() is None and home.processed.read() is None


def test_references_and_their_window(home, drop):
    feed = replace(SHIPMENTS, reference_key="DEPOT", window_days=10)
    known = lambda *x: home.spark.createDataFrame([(i,) for i in x], "_id string")
    first = load(home, drop(TOP, "P1,north,1,", "P2,south,2,", "P3,moon,3,"), feed=feed, reference=known("north"))
    assert first.counts == {"loaded": 1, "rejected": 0, "recycled": 2} and first.status == ingest.LOADED
    load(home, drop(TOP, "P9,north,1,", name="late_b.csv"), NEXT, feed, reference=known("north", "south"))
    assert {r.PARCEL: r.src_file_name for r in home.stage.read().collect()} == {"P1": "ship-20240304-0630.csv", "P2": "ship-20240304-0630.csv", "P9": "late_b.csv"}
    assert {r.PARCEL: r.status for r in home.recycle.read().collect()} == {"P2": "PROCESSED", "P3": "PENDING"}
    load(home, drop(TOP, "P8,north,1,", name="late_c.csv"), "2024-03-14 06:30:01", feed, reference=known("north", "moon"))
    assert {r.PARCEL: r.status for r in home.recycle.read().collect()} == {"P2": "PROCESSED", "P3": "EXPIRED"}


def test_rejects_are_tried_again(home, drop):
    feed = replace(SHIPMENTS, retry_rejects=True, window_days=5)
    load(home, drop(TOP, "P1,,1,", "P2,east,2,"), feed=feed)
    load(home, drop(TOP, "P4,,1,", name="late_d.csv"), TUE, feed)
    assert {(r.PARCEL, str(r.recycled_at)) for r in home.recycle.read().collect()} == {("P1", MON), ("P4", TUE)}
    load(home, drop(TOP, "P5,west,1,", name="late_e.csv"), NEXT, feed)  # both are too old by now
    assert home.recycle.read().count() == 0 and {r.PARCEL for r in home.stage.read().collect()} == {"P2", "P5"} and "recycled_at" not in home.stage.read().columns


def test_duplicates_codes_and_wrong_counts(home, drop):
    feed = replace(SHIPMENTS, allow_duplicates=False, codes=("NE", "SW"))
    path = drop(TOP, "P1,north,1,", "P1,north,2,")
    with pytest.raises(ContractError, match="unknown code"):
        load(home, path, feed=feed, code="XX")
    done = load(home, path, feed=feed, reported=3, code="NE")
    assert done.status == ingest.WITH_FAILURES and sorted(n for n, ok, _ in done.checks if not ok) == ["row_count", "unique_key"]
    assert load(home, path, feed=feed).status == ingest.DUPLICATE and home.stage.read().first().code == "NE"


def test_dry_runs_touch_nothing(spark, drop, tmp_path):
    dry = ingest.Tables(spark, str(tmp_path / "t"), dry=True)
    load(dry, drop(TOP, *(f"P{i},north,1," for i in range(20))), dry_rows=6)
    assert dry.stage.read().count() == 6 and dry.report.read().first().dry_run and ingest.Tables(spark, str(tmp_path / "t")).stage.read() is None


def test_segmented_loads_by_position(home, drop):
    kind = Field("a", "A", "a")
    feed = Feed("s", (kind, Field("b", "B", "b")), delimiter="~", segments=(Segment("Header", None, (kind,)), Segment("Trailer", "Z", (kind, Field("n", "N", "n")))), trailer=("Trailer", "N"))
    done = load(home, drop("title", "x~1", "y~", "Z~2", name="s.txt"), feed=feed)
    assert (done.status, done.counts["loaded"]) == (ingest.LOADED, 2) and home.of("header").read().first().A == "title"
    assert load(home, drop("title", "x~1", "Z~2", name="s.txt"), feed=feed).status == ingest.WITH_FAILURES
    assert load(home, drop("title", "x", "Z~1", name="s2.txt"), feed=feed).status == ingest.DRIFT_FAIL
    with pytest.raises(ContractError):
        replace(feed, trailer=("Trailer", "M"))


def test_stream_loads_a_file_once(spark, tmp_path, drop):
    drop(TOP, "P1,north,1,", "P2,,2,", name="late_s.csv")
    seen = []
    for _ in range(2):
        stream_stage(spark, SHIPMENTS, str(tmp_path / "landing"), str(tmp_path / "state"), lambda good, bad, n: seen.append((n, good.count(), bad.count()))).awaitTermination()
    assert seen == [(0, 1, 1)]


# Tables.


def test_merges_refuse_ambiguous_sources(spark):
    target = spark.createDataFrame([("x", 1)], "k string, v int")
    source = spark.createDataFrame([("x", 2), ("x", 3), ("new", 4), ("new", 5)], "k string, v int")
    with pytest.raises(upsert.DuplicateSourceKey):
        upsert.merge(target, source, ["k"])
    assert upsert.merge(target, source.where("k = 'new'"), ["k"]).count() == 3
    for option, keys in (("sideways", ["k"]), ("upsert", None)):
        with pytest.raises(ValueError):
            upsert.load(target, source, option, keys)
    assert upsert.load(target, source, " OVERWRITE ").count() == 4


def test_partitions_need_a_value(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "part string, v int")
    assert upsert.replace_where(rows, rows.where("part = 'b'").withColumn("v", F.lit(3)), "part", "b").agg(F.sum("v")).first()[0] == 4
    for value in (None, " ", "na", "N/A"):
        with pytest.raises(ValueError):
            upsert.replace_where(rows, rows, "part", value)


def test_target_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS depot")
    try:
        names = tables.create_tables(spark, SHIPMENTS, "depot", {"DEPOT": "where it's kept"})
        assert tables.create_tables(spark, SHIPMENTS, "depot") == names and len(names) == 6
        assert {f.dataType.simpleString() for f in spark.table("depot.shipments_rejects").schema} == {"string"}
        assert spark.table("depot.shipments_standard").schema["weight"].dataType.simpleString() == "decimal(9,3)"
        assert quality.table_checks(spark, ["depot.shipments_stage", "depot.nothing"]) == [("depot.shipments_stage", True, 8, 1), ("depot.nothing", False, 0, 0)]
        wide = tables.reject_schema(spark.table("depot.shipments_standard").schema)
        assert {f.dataType.simpleString() for f in wide} == {"string"} and wide.names[-1] == "reject_reason"
    finally:
        spark.sql("DROP DATABASE depot CASCADE")


# Contracts.


def test_types_and_contradictions():
    assert [spark_type(t) for t in ("BigInt", "numeric( 7 , 0)", "date(DD/MM/YY)", "CHAR(3)", "decimal")] == ["bigint", "decimal(7,0)", "date", "string", "decimal(10,0)"]
    for wrong in (lambda: spark_type("varbinary"), lambda: Feed("f", (Field("a", "X", "a"), Field("b", "X", "b"))), lambda: replace(SHIPMENTS, reference_key="NOWHERE"), lambda: replace(SHIPMENTS, places=((1, 2),))):
        with pytest.raises(ContractError):
            wrong()


def test_statements_settle_values():
    assert resolve.split_list("a, decimal(3,2) ,f(x,(y,z)),,b") == ["a", "decimal(3,2)", "f(x,(y,z))", "b"]
    width = lambda *a, **k: (resolve.width_of(*a, **k).value, resolve.width_of(*a, **k).state)
    assert [width("12"), width("8,3", "5", "9"), width("8,3", spans={"q": 4}, name="q"), width(None, answer=3), width("8,3")] == [(12, "filled"), (5, "filled"), (4, "proposed"), (3, "filled"), (None, "question")]
    assert [resolve.region_type(x) for x in ("varchar(5) NOT NULL,", " int , ", "NOT AVAILABLE", "not null")] == [("varchar(5)", False), ("int", True), (None, None), (None, False)]
    assert [resolve.column_length(*x).value for x in (("6", "char(9)"), ("", "varchar (9)"), (None, "date"))] == ["6", "9", None]
    assert resolve.window_days("keep 9 days", None, "9") == 9 and resolve.window_days() == 7
    with pytest.raises(ContractError):
        resolve.window_days("3", "4 days")
    keys = lambda *a, **k: (resolve.key_of(["A", "b", "c"], *a, **k).value, resolve.key_of(["A", "b", "c"], *a, **k).basis)
    assert keys(["a"]) == (("A",), "marks") and keys([], "b, x", ["c"]) == (("c",), "declared") and keys([], "b , A") == (("b", "A"), "statement") and keys([])[0] is None
    assert resolve.joined_feeds({"My Feed": 1, "x": 2}, {"my_feed": 3, "X": 4}) == {"myfeed": (1, 3), "x": (2, 4)}
    for left, right in (({"a": 1}, {"b": 1}), ({"a": 1, "A ": 2}, {"a": 1})):
        with pytest.raises(ContractError):
            resolve.joined_feeds(left, right)


def test_rules_find_their_leg_and_file():
    rule = rules.Rule
    legs = [resolve.leg_of(r, SHIPMENTS, ("gold.t",)) for r in (rule("lr_trim", ("depot",)), rule("lr_trim", ("DEPOT",)), rule("dedup", ("depot",), {"leg": "standard"}), rule("dedup", ("depot",)), rule("date_format", (), {"table": "gold.t"}))]
    assert legs == ["standard", "stage", "standard", "stage", "standard"]
    same, other = rule("lr_trim", ("a",)), rule("lr_trim", ("b",))
    assert resolve.per_file([same, other, same], 2) == [[same, other], [other, same]] and resolve.per_file([same, same], 3) == [[same, same]] * 3 and resolve.per_file([same], 1) == [[same]]
    assert resolve.dedup_rule(["k"], "") is None and resolve.dedup_rule([], "true duplicates only") == rule("dedup") and resolve.dedup_rule(["k"], "no duplicates") == rule("dedup", ("k",))
    with pytest.raises(OpenQuestions):
        resolve.dedup_rule([], "no duplicates")
    found = resolve.open_cells(replace(SHIPMENTS, fields=SHIPMENTS.fields[1:]), "Merge", {"target": " ", "path": "x"}, "a week")
    assert len(found) == 3
    with pytest.raises(OpenQuestions, match="target: blank"):
        resolve.must_be_closed(found)
    resolve.must_be_closed(resolve.open_cells(SHIPMENTS, "merge", {"path": "x"}, "7"))


def test_rules_report_what_they_cannot_do(spark):
    rows = spark.createDataFrame([(" a ", None), (None, "b")], "x string, y string")
    out = rules.apply_rules(rows, [rules.Rule("lr_trim", ("x",)), rules.Rule("sparkle"), rules.Rule("date_format", ("y",), {"format": "yyyy"}), rules.Rule("null_check", ("y",))])
    assert out.not_done == ["sparkle: no such rule", "date_format: to not stated"] and out.rows.count() == 1 and out.rejected[0].first().x == "a"
    with pytest.raises(ValueError):
        rules.apply_to_segments({"Detail": rows}, [rules.Rule("header_trailer_split")], "Detail")
    assert rules.apply_to_segments({"Detail": rows}, [rules.Rule("referential_check", ("x",))], "Detail").not_done


def test_gold_plans_refuse_what_is_open(spark, tmp_path):
    import json

    t = {n: spark.createDataFrame([(1, 2)], "k int, v int") for n in ("p", "q")}
    column = (gold.GoldColumn("k", "int", Value("k")),)
    plan = lambda *joins, **more: gold.GoldFeed("g", column, (gold.SourceSet("p", joins, **more),))
    for feed in (plan(gold.Join("q")), plan(gold.Join("q", using=("k",), state="proposed")), plan(filters=(Value(None, "question", "only the good ones"),))):
        with pytest.raises(OpenQuestions):
            gold.build(feed, t)
    assert gold.build(plan(gold.Join("q", using=("k",), state="proposed")), t, accept_proposed=True).count() == 1
    row = {"source_table": "p", "source_field": "v", "target_attribute": "amount", "target_format": "decimal(5,1)", "mapping_edits": ""}
    (tmp_path / "_manifest.json").write_text(json.dumps({"tables": [{"target_table": "one", "json_file": "1.json"}, {"target_table": "two", "json_file": "2.json"}]}))
    (tmp_path / "1.json").write_text(json.dumps({"mappings": [row]}))
    (tmp_path / "2.json").write_text(json.dumps({"mappings": [row, {**row, "target_attribute": "other", "mapping_edits": "half of it"}, {**row, "source_table": "q", "selection_criteria": "recent rows"}]}))
    feeds = gold.read_manifest(str(tmp_path))
    assert str(gold.build(feeds["one"], t).first().amount) == "2.0" and len(feeds["two"].questions()) == 3


# Cells, comparisons and profiles.


def test_masks(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", "é", "four", "fives", "0123456789abcdef")], "v string")
    assert [r.m for r in rows.select(cells.mask_last("v").alias("m")).collect()] == [None, "", "*", "****", "*ives", "*" * 12 + "cdef"]
    assert [r.m for r in rows.limit(4).select(cells.mask_last("v", 2).alias("m")).collect()] == [None, "", "*", "**ur"]


def test_lossy_casts_are_counted_and_not_shown(spark):
    rows = spark.createDataFrame([("12", "3.25", "2023-11-30"), (" 8 ", "  ", None), ("twelve", "x", "30.11.2023"), ("4.5", "9", "2023-02-30")], "n string, d string, day string")
    types = {"n": "int", "d": "decimal(4,2)", "day": "date"}
    with pytest.raises(quality.LossyCast) as stopped:
        quality.cast_columns(rows, types)
    assert str(stopped.value) == "n as int: 2 rows; d as decimal(4,2): 1 rows; day as date: 2 rows"
    good = quality.cast_columns(rows.limit(2), types).collect()
    assert [(r.n, r.d and str(r.d), r.day and str(r.day)) for r in good] == [(12, "3.25", "2023-11-30"), (8, None, None)]


def statuses(spark, cases, tokens=None):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, a string").orderBy("i")
    return [r.s for r in rows.select("i", cells.cell_status(F.col("e"), F.col("a"), tokens).alias("s")).orderBy("i").collect()]


def test_cell_statuses(spark):
    """The first cell is the expected one."""
    by = {
        "exact": [("Blue", "Blue"), ("", None), (" ", " ")],
        "normalized": [("Blue", " bLUE "), ("null", ""), (None, "Null"), ("3.1400", "3.14"), ("-2.0", "-2"), ("+1.50", "+1.5"), ("1999-12-31T00:00:00.000", "1999-12-31"), ("1999-12-31 00:00", "1999-12-31"), ("a  b", "A b"), ("c:\\tmp\\\\x\\", "c:/tmp/x"), ("S3://b//k///", "s3://b/k")],
        "extra": [("", "7"), (None, "7"), ("NULL", "7")],
        "missing": [("7", ""), ("7", None), ("7", "NULL")],
        "mismatch": [("Blue", "Red"), ("012", "12"), ("s3://b/k", "s3:/b/k"), ("1.5", "15"), ("/", "x"), ("1999-12-31 00:00:01", "1999-12-31")],
    }
    for status, cases in by.items():
        assert statuses(spark, cases) == [status] * len(cases)


def test_cells_of_two_environments(spark):
    tokens = [("<env>", ["qa", "live"], []), ("<n>", [], ["host[0-9]+"])]
    assert statuses(spark, [("db_qa.host1", "DB_LIVE.host22"), ("qa-1", "live-1"), ("qual", "livel"), ("", "qa")], tokens) == ["normalized", "normalized", "mismatch", "extra"]


def test_comparisons_with_themselves_and_with_errors(spark):
    rows = spark.range(60).select((F.col("id") % 7).cast("string").alias("k"), (F.col("id") * 3).cast("string").alias("v"))
    compared = lambda a, b: compare.cells(compare.pair(a, b, ["k"], ["v"], ["v"]), ["k"], ["v"])
    assert {r.status for r in compared(rows, rows).collect()} == {"exact"} and compare.score(compared(rows, rows).limit(0)).first().score == 100.0
    wrong = rows.withColumn("v", F.when(F.col("v") == "33", "33?").otherwise(F.col("v")))
    assert compare.score(compared(rows, wrong)).first().mismatch == 1
    blank = rows.withColumn("k", F.when(F.col("k") < "3", " ").otherwise(F.col("k")))
    alone = compared(blank, blank).where("_n is null")
    assert {r.status: r["count"] for r in alone.groupBy("status").count().collect()} == {"missing": 27, "extra": 27}


def test_digests_count_repeats(spark):
    column = lambda *x: spark.createDataFrame([(i,) for i in x], "c string")
    grade = lambda a, b: compare.structural(a, b, ["c"]).first().grade
    assert [grade(column("x", "x"), column("y", "y")), grade(column("x", "y", "y"), column("y", "x", "x")), grade(column("p", "q"), column("q", "p")), grade(column("p", None), column("p", "p"))] == ["WARN", "WARN", "SAME", "HARD"]


def test_entry_works_without_the_other_queries():
    """The rest imports and registers its queries where the subpackage is absent."""
    import subprocess
    import sys

    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries() and len(e.queries()) > 70"
    root = __file__.rpartition("/tests/")[0]
    assert subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, check=False).returncode == 0


def test_profiles_of_nothing(spark):
    none = spark.createDataFrame([], "a string")
    assert [(r["rows"], r.status) for r in profile.fill_rate(none, ["a"]).collect()] == [(0, "no rows")]
    rows = spark.createDataFrame([("x", None), (" x", "s2,s1"), ("y", " "), ("y", ",")], "k string, s string")
    assert {tuple(r) for r in profile.collapse(rows, ["k"], "s").collect()} == {("x", "s1,s2", 2), ("y", "", 0)}


def test_closures_take_few_rounds(spark):
    for turn in (("child", "parent"), ("parent", "child")):  # a chain with branches: one parent each, then one child each
        parent = {i: i - 1 if i % 3 else i // 2 for i in range(1, 60)}
        edges = spark.createDataFrame([(str(k), str(v)) for k, v in parent.items()], "child string, parent string").select(*(F.col(a).alias(b) for a, b in zip(turn, ("child", "parent"), strict=True)))
        spark.sparkContext.setJobGroup(f"closure {turn}", "closure")
        got = [tuple(r) for r in closure.closure(edges, spark.createDataFrame([(str(i),) for i in range(60)], "node string"), ("-1",)).collect()]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"closure {turn}"))
        spark.sparkContext.setJobGroup("rest", "rest")
        want = set()
        for i in range(60):
            at = i
            want.add((i, i))
            while at in parent:
                at = parent[at]
                want.add((i, at))
        want = {(str(a), str(b)) if turn[0] == "child" else (str(b), str(a)) for a, b in want}
        assert len(got) == len(want) and set(got) == want and jobs < 60


def test_closures_of_one_parent_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e")], "child string, parent string")
    got = [tuple(r) for r in closure.closure(edges, spark.createDataFrame([("d",), ("e",), ("c",)], "node string")).collect()]
    assert sorted(got) == [("c", "a"), ("c", "b"), ("c", "c"), ("d", "a"), ("d", "b"), ("d", "c"), ("d", "d"), ("e", "e")]


def test_closures_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c.0"), ("c", "a"), ("c", "0"), ("c", ""), ("d", "a"), ("b", "b")], "child string, parent string")
    reach = lambda *x: sorted(r.node for r in closure.closure(edges, spark.createDataFrame([(i,) for i in x], "node string")).where(F.col("root") == x[0]).collect())
    assert reach("a") == ["a", "b", "c"] and reach("d") == ["a", "b", "c", "d"]
