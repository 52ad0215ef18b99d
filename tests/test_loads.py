"""Tables of parts, and runs of many files: what is written, in how many jobs, and what a run leaves
when it is repeated, stopped or given odd files."""

import gzip
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.operators import drift, parttable, recycle, upsert
from millrace.operators.rules import Rule
from millrace.plans import ingest
from millrace.plans.contract import ContractError, Feed, Field, OpenQuestions, Segment
from millrace.sources import files
from millrace.streaming.arrivals import stream_ingest
from tests.test_files import MON, NEXT, SHIPMENTS, TOP, TUE


@pytest.fixture
def drop(tmp_path):
    def write(*lines, name="ship-20240304-0630.csv", end="\n"):
        path = tmp_path / "landing" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(f"{x}{end}" for x in lines))
        return str(path)

    return write


@pytest.fixture
def home(spark, tmp_path):
    return ingest.Tables(spark, str(tmp_path / "tables"))


def jobs(spark, name, run):
    """Spark jobs that a call takes."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def known(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "_id string")


# Tables of parts.


def folders(path):
    return {x for x in os.listdir(path) if x.startswith("p-")}


def rows_of(spark, **parts):
    return spark.createDataFrame([(n, v) for n, vs in parts.items() for v in vs], "n string, v long")


def values(df):
    return {} if df is None else {n: sorted(r.v for r in df.collect() if r.n == n) for n in {r.n for r in df.select("n").distinct().collect()}}


def test_parts_replace_each_other(spark, tmp_path):
    table = parttable.VersionedTable(spark, f"{tmp_path}/t", keep=2)
    assert table.read() is None and table.version() == -1 and table.parts() == {} and table.has(["a"]) == set()
    table.put(rows_of(spark, a=[1, 2], b=[3], c=[4]), "n", ["a", "b", "c", "empty"])
    assert values(table.read()) == {"a": [1, 2], "b": [3], "c": [4]} and len(folders(f"{tmp_path}/t")) == 1
    table.put(rows_of(spark, b=[5, 6]), "n", ["b"])
    assert values(table.read()) == {"a": [1, 2], "b": [5, 6], "c": [4]} and table.has(["b", "empty", "x"]) == {"b", "empty"}
    assert values(table.read(["b"])) == {"b": [5, 6]} and values(table.read(["a", "b"])) == {"a": [1, 2], "b": [5, 6]} and table.read(["x"]) is None
    table.put(rows_of(spark).where("false"), "n", ["a"])  # empty now
    assert values(table.read()) == {"b": [5, 6], "c": [4]}
    assert table.write(rows_of(spark, z=[9])).count() == 1 and list(table.parts()) == [""]


def test_random_commits_against_a_dictionary(spark, tmp_path, monkeypatch):
    """With snapshots and merges every few commits; readers of two objects agree."""
    monkeypatch.setattr(parttable, "SNAPSHOT", 4)
    monkeypatch.setattr(parttable, "MOST_SMALL", 5)
    rng, want = random.Random(3), {}
    table = parttable.VersionedTable(spark, f"{tmp_path}/t")
    for step in range(22):
        own = {rng.choice("abcdefgh"): [step * 10 + k for k in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 4))}
        table.put(rows_of(spark, **own), "n", list(own))
        want |= own
        if step % 5 == 4:
            assert values(parttable.VersionedTable(spark, f"{tmp_path}/t").read()) == want
    assert values(table.read()) == want and {n: values(table.read([n]))[n] for n in want} == want
    assert len(folders(f"{tmp_path}/t")) < 22 and len(os.listdir(f"{tmp_path}/t/_log")) < 40
    table.compact()
    live = set(table.parts().values())
    assert len(live) == 1 and values(table.read()) == want
    table.keep = 1
    table.put(rows_of(spark, a=[0]), "n", ["a"])
    assert table.vacuum(hours=0) is not None and folders(f"{tmp_path}/t") == {*live, table.parts(["a"])["a"]}


def test_lookups_dont_read_the_whole_list(spark, tmp_path, monkeypatch):
    table = parttable.VersionedTable(spark, f"{tmp_path}/t")
    monkeypatch.setattr(parttable, "SNAPSHOT", 1)
    table.put(rows_of(spark, a=[1]), "n", [f"file_{i}.csv" for i in range(5000)] + ["a"])
    read = []
    text = table._text
    monkeypatch.setattr(table, "_text", lambda name, ranges=None: read.append(sum(n for _, n in ranges or [])) or text(name, ranges))
    table.put(rows_of(spark, b=[2]), "n", ["b"])  # the next entry, summed up too
    read.clear()
    assert table.has(["file_77.csv", "nothing"]) == {"file_77.csv"}
    whole = os.path.getsize(f"{tmp_path}/t/_log/s-0000000001")
    assert sum(read) < whole / 10
    assert jobs(spark, "lookup", lambda: table.has(["file_1.csv"])) == 0
    assert jobs(spark, "commit", lambda: table.put(rows_of(spark, b=[3]), "n", ["b"])) == 1


def test_losers_of_a_race_leave_nothing(spark, tmp_path, monkeypatch):
    one, two = (parttable.VersionedTable(spark, f"{tmp_path}/t") for _ in range(2))
    one.write(rows_of(spark, a=[1]))
    stale = two._state
    held = two._state()
    monkeypatch.setattr(two, "_state", lambda *a, **k: held)
    one.write(rows_of(spark, a=[2, 3]))
    before = folders(f"{tmp_path}/t")
    with pytest.raises(parttable.ConcurrentWrite):
        two.put(rows_of(spark, a=[4]), "n", ["a"])
    assert folders(f"{tmp_path}/t") == before and not [x for x in os.listdir(f"{tmp_path}/t/_log") if "draft" in x]
    monkeypatch.setattr(two, "_state", stale)
    assert values(two.read()) == {"a": [2, 3]}


def test_columns_are_added_and_keep_their_types(spark, tmp_path):
    table = parttable.VersionedTable(spark, f"{tmp_path}/t")
    table.put(rows_of(spark, a=[1]), "n", ["a"])
    table.put(rows_of(spark, b=[2]).withColumn("extra", F.lit("x")), "n", ["b"])
    assert {(r.n, r.extra) for r in table.read().collect()} == {("a", None), ("b", "x")}
    with pytest.raises(ValueError, match="v is bigint, not string"):
        table.put(rows_of(spark, c=[3]).withColumn("v", F.lit("text")), "n", ["c"])


def test_a_batch_commits_once(spark, tmp_path):
    table = parttable.VersionedTable(spark, f"{tmp_path}/t")
    assert table.put(rows_of(spark, a=[1]), "n", ["a"], ("s", 0)) and not table.put(rows_of(spark, a=[2]), "n", ["a"], ("s", 0))
    assert values(table.read()) == {"a": [1]} and table.batch("s") == 0 and table.batch("other") == -1


# Precedence.


def test_merge_in_order_is_one_upsert_after_another(spark):
    rng = random.Random(1)
    side = lambda tag, n: [(rng.choice(["a", "b", "c", None]), rng.randrange(4), f"{tag}{i}", f"2024-01-{rng.randrange(10, 28)} 00:00:00") for i in range(n)]
    schema = "k string, j int, v string, created string"
    for case in range(4):
        target, first, second = side("t", 12 * (case > 0)), side("x", 5), side("y", 5 * (case != 2))
        want = target
        for source in (first, second):
            new = {r[:2] for r in source}
            oldest = {}
            for r in want:
                oldest[r[:2]] = min(oldest.get(r[:2], r[3]), r[3])
            want = [r for r in want if r[:2] not in new] + [(*r[:3], oldest.get(r[:2], r[3])) for r in source]
        frames = [spark.createDataFrame(x, schema) for x in (target, first, second)]
        got = upsert.merge_in_order(frames[0] if target else None, frames[1:], ["k", "j"], "created")
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r) for r in got.select("k", "j", "v", "created").collect()), key=key) == sorted(want, key=key)


# Runs of many files.


def test_jobs_dont_follow_the_number_of_files(spark, tmp_path, drop):
    feed = replace(SHIPMENTS, patterns=("*.csv",), reference_key="DEPOT")
    counts = {}
    for n in (3, 200):
        home = ingest.Tables(spark, f"{tmp_path}/t{n}")
        paths = [drop(TOP, f"P{i},north,1,", f"Q{i},,2,", f"R{i},moon,3,", name=f"f{n}_{i}.csv") for i in range(n)]
        done = []
        counts[n] = jobs(spark, f"run{n}", lambda home=home, paths=paths, done=done: done.extend(ingest.ingest_files(spark, feed, paths, home, MON, known(spark, "north"))))
        assert [r.file for r in done] == [os.path.basename(p) for p in paths] and {(r.status, *r.counts.values()) for r in done} == {(ingest.LOADED, 1, 1, 1)}
        assert home.stage.read().count() == home.rejects.read().count() == home.recycle.read().count() == home.processed.read().count() == n
    assert counts[200] <= counts[3] + 4


def test_good_drifted_and_duplicate_files_in_one_run(home, drop):
    feed = replace(SHIPMENTS, patterns=("*.csv",), allow_duplicates=False)
    old = drop(TOP, "P0,north,1,", name="old.csv")
    ingest.ingest_file(home.spark, feed, old, home, MON)
    paths = [drop("kilos,parcel,colour,sent_on,depot", '"4,5",P1,red,,"a ""b"""', "7,,blue,,south", name="turned.csv"), old, drop("parcel,depot", "P2,x", name="short.csv"), drop(TOP, name="empty.csv"), drop(TOP, "P3,north,1,", "P4,north,1,", name="good one+x.csv"), drop(name="nothing.csv")]
    done = {r.file: r for r in ingest.ingest_files(home.spark, feed, paths, home, TUE, reported={"good one+x.csv": 3})}
    assert {n: r.status for n, r in done.items()} == {
        "turned.csv": ingest.LOADED, "old.csv": ingest.DUPLICATE, "short.csv": ingest.DRIFT_FAIL, "empty.csv": ingest.LOADED, "good one+x.csv": ingest.WITH_FAILURES, "nothing.csv": ingest.DRIFT_FAIL,
    }
    assert done["short.csv"].drift.missing == ("kilos", "sent_on") and done["turned.csv"].drift.extra == ("colour",) and done["turned.csv"].counts == {"loaded": 1, "rejected": 1, "recycled": 0}
    got = {(r.src_file_name, r.PARCEL, r.DEPOT, r.KILOS) for r in home.stage.read().collect()}
    assert got == {("old.csv", "P0", "north", "1"), ("turned.csv", "P1", 'a "b"', "4,5"), ("good one+x.csv", "P3", "north", "1"), ("good one+x.csv", "P4", "north", "1")}
    assert home.processed.has(["turned.csv", "empty.csv", "short.csv"]) == {"turned.csv", "empty.csv"}
    with pytest.raises(ContractError, match="two files"):
        ingest.ingest_files(home.spark, feed, [old, old.replace("landing", "./landing")], home, TUE)
    with pytest.raises(files.UnrecognizedFile):
        ingest.ingest_files(home.spark, SHIPMENTS, [old], home, TUE)


def test_a_reload_after_the_reference_learned_a_key_leaves_one_row(home, drop):
    feed = replace(SHIPMENTS, reference_key="DEPOT", window_days=10)
    path = drop(TOP, "P1,north,1,", "P2,south,2,")
    ingest.ingest_file(home.spark, feed, path, home, MON, known(home.spark, "north"))
    drop(TOP, "P1,north,1,", "P2,south,9,")
    done = ingest.ingest_file(home.spark, feed, path, home, TUE, known(home.spark, "north", "south"))
    assert {(r.PARCEL, r.KILOS) for r in home.stage.read().collect()} == {("P1", "1"), ("P2", "9")} and home.stage.read().count() == 2
    assert (done.status, done.reprocessed, done.expired) == (ingest.LOADED, 1, 0) and {r.status for r in home.recycle.read().collect()} == {"PROCESSED"}
    third = ingest.ingest_file(home.spark, feed, path, home, NEXT, known(home.spark, "north", "south"))
    assert third.reprocessed == 0 and home.stage.read().count() == 2 and "- reprocessed 1" in done.report()


def test_waiting_rows_of_many_files_come_back_under_their_own_names(home, drop):
    feed = replace(SHIPMENTS, patterns=("*.csv",), reference_key="DEPOT", window_days=10)
    ingest.ingest_files(home.spark, feed, [drop(TOP, f"P{i},moon,1,", f"Q{i},sun,1,", name=f"a{i}.csv") for i in range(3)], home, MON, known(home.spark, "x"))
    done = ingest.ingest_files(home.spark, feed, [drop(TOP, "P1,moon,5,", name="b.csv")], home, TUE, known(home.spark, "moon"))
    assert {(r.src_file_name, r.PARCEL) for r in home.stage.read().collect()} == {("a0.csv", "P0"), ("a1.csv", "P1"), ("a2.csv", "P2"), ("b.csv", "P1")} and done[0].reprocessed == 3
    late = ingest.ingest_files(home.spark, feed, [drop(TOP, "Z,moon,5,", name="c.csv")], home, "2024-04-04 06:30:00", known(home.spark, "sun", "moon"))
    assert (late[0].reprocessed, late[0].expired) == (0, 3) and home.stage.read().count() == 5


def test_retried_rejects_stay_with_their_files(home, drop):
    feed = replace(SHIPMENTS, patterns=("*.csv",), retry_rejects=True, window_days=5)
    b = drop(TOP, "P1,,1,", "P1,,1,", "P2,east,2,", name="b.csv")
    one = ingest.ingest_file(home.spark, feed, b, home, MON)
    assert one.counts == {"loaded": 1, "rejected": 2, "recycled": 0} and home.recycle.read().count() == 2  # equal rejects are two
    two = ingest.ingest_file(home.spark, feed, drop(TOP, "P5,west,1,", name="c.csv"), home, TUE)
    assert two.counts == {"loaded": 1, "rejected": 0, "recycled": 0} and ("recycle: retried from earlier runs", "recycle", 2) in two.steps
    assert {r.src_file_name for r in home.rejects.read().collect()} == {"b.csv"} == {r.src_file_name for r in home.errors.read().collect()} and home.recycle.read().count() == 2
    again = ingest.ingest_file(home.spark, feed, b, home, TUE)
    assert again.counts == {"loaded": 1, "rejected": 2, "recycled": 0} and home.rejects.read().count() == 2
    assert [str(r.recycled_at) for r in home.recycle.read().collect()] == [MON, MON]
    # a contract that asks for less lets them in, under their own file
    easier = replace(feed, fields=tuple(replace(f, mandatory=f.key) for f in feed.fields))
    ingest.ingest_file(home.spark, easier, drop(TOP, "P6,west,1,", name="d.csv"), home, "2024-03-06 06:30:00")
    assert sorted((r.src_file_name, r.PARCEL) for r in home.stage.read().collect()) == [("b.csv", "P1"), ("b.csv", "P1"), ("b.csv", "P2"), ("c.csv", "P5"), ("d.csv", "P6")] and home.recycle.read().count() == 0


def test_files_without_headers_and_with_footers(home, drop, tmp_path):
    feed = replace(SHIPMENTS, patterns=("*",), header=False, footer=True)
    (tmp_path / "landing").mkdir(exist_ok=True)
    with gzip.open(tmp_path / "landing" / "z.gz", "wt") as f:
        f.write('P1,"north, east",1,\nEND,1\n')
    paths = [drop("P2,south,2,2024-01-01", "P3,south,3,", "END,2", name="plain"), str(tmp_path / "landing" / "z.gz"), drop("P4,south", name="narrow"), drop('P5,"a,b",1,,more', "END", name="wide")]
    done = {r.file: r for r in ingest.ingest_files(home.spark, feed, paths, home, MON)}
    assert {n: (r.status, r.counts["loaded"]) for n, r in done.items()} == {"plain": (ingest.LOADED, 2), "z.gz": (ingest.LOADED, 1), "narrow": (ingest.DRIFT_FAIL, 0), "wide": (ingest.LOADED, 1)}
    assert done["narrow"].drift.missing == ("kilos", "sent_on") and done["wide"].drift.long_rows == 1
    assert {(r.PARCEL, r.DEPOT) for r in home.stage.read().collect()} == {("P2", "south"), ("P3", "south"), ("P1", "north, east"), ("P5", "a,b")}


def test_first_records(spark, drop):
    long = '"' + "x" * 5000 + '"'
    paths = [drop('"a\nb",c', "1,2", name="q.csv"), drop(f"{long},y", name="l.csv"), drop(name="none.csv"), drop("﻿a,b", name="bom.csv")]
    got = files.first_records(spark, paths)
    assert [got[p] for p in paths] == [["a\nb", "c"], ["x" * 5000, "y"], [], ["a", "b"]]
    assert drift.first_record_drift('"b,x", a ,"c"', ",", ["a", "b,x", "d"]).missing == ("d",)


def test_segmented_runs_of_several_files(home, drop):
    kind = Field("a", "A", "a")
    feed = Feed("s", (kind, Field("b", "B", "b")), delimiter="~", segments=(Segment("Header", None, (kind,)), Segment("Trailer", "Z", (kind, Field("n", "N", "n")))), trailer=("Trailer", "N"))
    paths = [drop("top1", "x~1", "y~", "Z~2", name="1.txt"), drop("top2", "x~1", "Z~2", name="2.txt"), drop("top3", "x", "Z~1", name="3.txt"), drop("top4", "v~1", name="4.txt")]
    done = {r.file: r for r in ingest.ingest_files(home.spark, feed, paths, home, MON)}
    assert {n: r.status for n, r in done.items()} == {"1.txt": ingest.LOADED, "2.txt": ingest.WITH_FAILURES, "3.txt": ingest.DRIFT_FAIL, "4.txt": ingest.WITH_FAILURES}
    assert {(r.src_file_name, r.A) for r in home.of("header").read().collect()} == {("1.txt", "top1"), ("2.txt", "top2"), ("4.txt", "top4")} and home.stage.read().count() == 4
    assert [d for n, ok, d in done["4.txt"].checks if n == "trailer_count"] == ["trailers=0 stated=null details=1"]


def test_rules_run_on_their_legs_and_runs_start_closed(home, drop, tmp_path):
    spark = home.spark
    feed = replace(SHIPMENTS, patterns=("*.csv",), rules=(Rule("lr_trim", ("DEPOT",)), Rule("null_check", ("KILOS",)), Rule("add_custom_columns", ("DEPOT",), {"file": "r2*", "values": ("west",)}), Rule("date_format", ("sent",), {"leg": "standard", "format": "yyyy-MM-dd", "to": "dd.MM.yyyy"}), Rule("sparkle")))
    paths = [drop(TOP, "P1, north ,1,2024-03-01", "P2,south,,2024-03-02", name="r1.csv"), drop(TOP, "P3, east,3,", name="r2.csv")]
    spark.sql("CREATE DATABASE IF NOT EXISTS landed")
    try:
        done = ingest.ingest_files(spark, feed, paths, home, MON, archive=str(tmp_path / "archive"), database="landed")
        assert spark.catalog.tableExists("landed.shipments_standard")
    finally:
        spark.sql("DROP DATABASE landed CASCADE")
    assert [r.counts for r in done] == [{"loaded": 1, "rejected": 1, "recycled": 0}, {"loaded": 1, "rejected": 0, "recycled": 0}] and done[0].not_done == ["sparkle: no such rule"]
    assert {(r.PARCEL, r.reject_reason) for r in home.rejects.read().collect()} == {("P2", "rule")} and {r.DEPOT for r in home.stage.read().collect()} == {"north", "west"}
    assert ingest.standard(home.stage.read(), replace(feed, fields=tuple(replace(f, type="string") for f in feed.fields))).where("parcel_id = 'P1'").first().sent == "01.03.2024"
    assert sorted(os.listdir(tmp_path / "archive")) == ["r1.csv", "r2.csv"] and not os.path.exists(paths[0])
    for options in ({"needed": {"target": " "}}, {"retention": "a week"}):
        with pytest.raises(OpenQuestions):
            ingest.ingest_files(spark, replace(feed, options=options), [], home, MON)


# Streams.


def test_a_stream_that_dies_between_write_and_checkpoint_loads_each_row_once(home, drop, tmp_path, monkeypatch):
    spark = home.spark
    feed = replace(SHIPMENTS, patterns=("*.csv",), fields=tuple(replace(f, key=False) for f in SHIPMENTS.fields), reference_key="DEPOT")  # without a key nothing would be merged
    go = lambda then=None: stream_ingest(spark, feed, str(tmp_path / "landing"), str(tmp_path / "state"), home, lambda n: f"2024-03-04 06:30:{n:02d}", lambda: known(spark, "north"), 2, then)
    drop(TOP, "P1,north,1,", "P2,,2,", "P3,moon,3,", name="a.csv")
    drop("no,header", name="b.csv")
    drop(TOP, "x,y,z,", name="ignored.tmp")

    def dies(number, done):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        go(dies).awaitTermination()
    versions = home.stage.version(), home.processed.version()
    # once more after the stage's commit, before the others
    seen = []
    drop(TOP, "P4,north,4,", name="c.csv")
    go(lambda n, done: seen.append((n, [(r.file, r.status) for r in done]))).awaitTermination()
    assert sorted(r.PARCEL for r in home.stage.read().collect()) == ["P1", "P4"] and home.rejects.read().count() == 1 and home.recycle.read().count() == 1
    assert versions[0] == versions[1] == 0 or max(versions) <= 1
    assert ("c.csv", ingest.LOADED) in [x for _, done in seen for x in done]

    drop(TOP, "P5,north,5,", name="d.csv")
    whole = ingest._Run._recorded
    monkeypatch.setattr(ingest._Run, "_recorded", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        go().awaitTermination()
    assert home.stage.read().count() == 3
    monkeypatch.setattr(ingest._Run, "_recorded", whole)
    go().awaitTermination()
    assert sorted(r.PARCEL for r in home.stage.read().collect()) == ["P1", "P4", "P5"] and home.processed.read().count() == 3


def test_kept_rejects_are_not_merged(spark):
    rows = spark.createDataFrame([("f", "a"), ("f", "a"), ("f", None)], "src_file_name string, k string")
    assert recycle.kept_rejects(rows, None, ["src_file_name", "k"], MON).count() == 3


def test_compaction_sorts_in_bounded_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parttable, "TASK_ROWS", 100, raising=False)
    table = parttable.VersionedTable(spark, str(tmp_path / "bounded"))
    for names in (["a", "b"], ["c"]):
        table.put(spark.range(400).select(F.col("id"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("p")), "p", names)
    table.compact()
    (folder,) = set(table.parts().values())
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "bounded" / folder).glob("*.parquet")]
    assert sum(sizes) == 800 and max(sizes) <= 150
    assert {r.p: r["count"] for r in table.read().groupBy("p").count().collect()} == {"a": 200, "b": 200, "c": 400}
