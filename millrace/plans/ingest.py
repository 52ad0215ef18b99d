"""Ingestion of files under a feed's contract, from admission to the report: delimited files, with a
header row or without, segmented ones and fixed-width ones.

Stages of a run: admit, drift, map, split off rejects, rules, recycle, upsert, record, check. All files
of a run are one scan and one plan; drift, counts, checks and statuses are grouped by file, and each
table gets one commit. So the number of jobs follows neither the files nor the columns. Tables
have a part a file, so a run writes what it touches and no more.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.cells import any_of, blank
from millrace.operators import drift as drifts
from millrace.operators import quality, recycle, rules
from millrace.operators.parttable import VersionedTable
from millrace.operators.upsert import merge_in_order
from millrace.plans import resolve
from millrace.plans import tables as targets
from millrace.plans.contract import ContractError, Feed, Field, spark_type
from millrace.sources import files, segments

LOADED, WITH_FAILURES, DRIFT_FAIL, DUPLICATE = "LOADED", "LOADED_WITH_DQ_FAILURES", "DRIFT_FAIL", "SKIPPED_DUPLICATE"
FILE = "src_file_name"
AUDIT = (FILE, "code", "created", "updated")
#: Rows of a run that a dry run reads, and what the names of its tables end in.
DRY_ROWS, DRY_SUFFIX = 100, "_dryrun"


@dataclass
class Ingest:
    """What a run did with a file: steps is one (step, target, rows) each, counts are by kind of row.
    reprocessed and expired are the whole run's: waiting rows, of whichever file."""

    feed: str
    file: str
    status: str
    counts: dict[str, int] = field(default_factory=lambda: {"loaded": 0, "rejected": 0, "recycled": 0})
    drift: drifts.Drift = field(default_factory=drifts.Drift)
    checks: list[tuple[str, bool, str]] = field(default_factory=list)
    steps: list[tuple[str, str, int]] = field(default_factory=list)
    reprocessed: int = 0
    expired: int = 0
    not_done: list[str] = field(default_factory=list)

    def tally(self, step: str, target: str, rows: int) -> None:
        self.steps.append((step, target, rows))

    def report(self) -> str:
        """As Markdown, the same for the same load."""
        lines = [f"# {self.feed}", f"- file: {self.file}", f"- status: {self.status}", "- " + ", ".join(f"{k} {n}" for k, n in self.counts.items())]
        lines += [f"- {k} {n}" for k, n in (("reprocessed", self.reprocessed), ("expired", self.expired)) if n]
        drift = [f"- drift: {k} {v}" for k, v in vars(self.drift).items() if v]
        return "\n".join(lines + drift + [f"- not done: {x}" for x in self.not_done] + [f"- {'pass' if ok else 'FAIL'} {name}: {detail}" for name, ok, detail in self.checks])

    def rows(self, spark: SparkSession, run_ts: str, dry: bool = False) -> DataFrame:
        """The steps as rows of the run report."""
        return report_rows(spark, [self], run_ts, dry)


def report_rows(spark: SparkSession, results: Iterable[Ingest], run_ts: str, dry: bool = False) -> DataFrame:
    made = [(r.feed, *s, r.file, dry) for r in results for s in r.steps]
    return spark.createDataFrame(made, "feed string, step string, target string, rows long, file string, dry_run boolean").withColumn("run_ts", F.lit(run_ts).cast("timestamp"))


class Tables:
    """The feed's tables under one folder; a dry run's have names of their own."""

    KINDS = ("stage", "errors", "rejects", "recycle", "processed", "report")

    def __init__(self, spark: SparkSession, root: str, dry: bool = False):
        self.spark, self.root, self.dry = spark, root, dry
        self.stage, self.errors, self.rejects, self.recycle, self.processed, self.report = (self.of(k) for k in self.KINDS)

    def of(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}{DRY_SUFFIX if self.dry else ''}")


def audited(df: DataFrame, feed: Feed, run_ts: str, code: str | None = None) -> DataFrame:
    """With the audit columns beside the file's name: code and the run's time, twice. A code must be
    one of the feed's."""
    if code is not None and code not in feed.codes:
        raise ContractError(f"{feed.name}: unknown code {code!r}")
    now = F.lit(run_ts).cast("timestamp")
    return df.withColumns({"code": F.lit(code).cast("string"), "created": now, "updated": now})


def mapped(df: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Stage columns, all text, and the file's name."""
    return df.select(*(F.col(f"`{f.source}`").alias(f.stage) for f in fields), *(c for c in (FILE,) if c in df.columns))


def standard(stage: DataFrame, feed: Feed, check: bool = True, loaded: list[str] | None = None, like: DataFrame | None = None) -> DataFrame:
    """Stage rows under standard names and types, after the feed's standard-leg rules; a value that
    would be lost stops the load. ``loaded`` keeps the rows of these files; ``like`` is the target,
    whose other columns are carried from the stage where it has them, and null where not."""
    rows = stage if loaded is None else stage.where(F.col(FILE).isin(*loaded))
    types = {f.stage: spark_type(f.type) for f in feed.fields if spark_type(f.type) != "string"}
    cast = quality.cast_columns(rows, types, check) if types else rows
    own = [F.col(f.stage).alias(f.standard) for f in feed.fields]
    names = {f.standard for f in feed.fields}
    if like is None:
        out = cast.select(*own, *(c for c in stage.columns if c in AUDIT and c not in names))
    else:
        carried = [(F.col(t.name) if t.name in cast.columns else F.lit(None)).cast(t.dataType).alias(t.name) for t in like.schema.fields if t.name not in names]
        out = cast.select(*own, *carried)
    late = [r for r in feed.rules if resolve.leg_of(r, feed) == "standard"]
    return rules.apply_rules(out, late).rows if late else out


@dataclass
class Parsed:
    """detail: the feed's own records under their source names with their file's, those of files that
    drift fails left out; others: those of its other segments; held: what is persisted."""

    detail: DataFrame | None
    others: dict[str, DataFrame]
    drift: dict[str, drifts.Drift]
    held: list[DataFrame]


def _lines_by_segment(spark: SparkSession, feed: Feed, paths: dict[str, str], dry_rows: int | None) -> Parsed:
    lines = files.read_lines(spark, list(paths.values()))
    lines = lines if dry_rows is None else lines.limit(dry_rows)
    markers = {s.name: s.marker for s in feed.segments if s.marker is not None} | ({segments.DETAIL: feed.detail} if feed.detail is not None else {})
    columns = {s.name: s.fields for s in feed.segments} | {segments.DETAIL: feed.fields}
    if feed.places:
        layouts = {n: [(f.source, *p) for f, p in zip(fields, next((s.places for s in feed.segments if s.name == n), feed.places), strict=True)] for n, fields in columns.items()}
        rows = segments.by_width(lines, layouts, markers, feed.exact_width)
    elif feed.detail is None:
        rows = segments.by_position(lines, feed.delimiter, markers[segments.TRAILER])
    else:
        rows = segments.by_discriminator(lines, feed.delimiter, markers)
    rows = rows.withColumn(FILE, files.loaded_name(spark, list(paths.values()))).persist()
    found: dict[str, list] = {n: [] for n in paths}
    for r in segments.field_counts(rows, {n: len(f) for n, f in columns.items()}, (FILE,)).collect():  # a row a file and segment
        found[r[FILE]].append(r)
    drift = {n: drifts.segment_drift(x) for n, x in found.items()}
    failed = [n for n, d in drift.items() if d.failed]
    kept = rows.where(~F.col(FILE).isin(*failed)) if failed else rows
    parts = {n: segments.part(kept, n, [f.source for f in fields]) for n, fields in columns.items()}
    return Parsed(parts.pop(segments.DETAIL), parts, drift, [rows])


def parsed(spark: SparkSession, feed: Feed, paths: dict[str, str], dry_rows: int | None = None) -> Parsed:
    """The records of all files, read by one scan, or one for each different header row."""
    if feed.segments or feed.places:
        return _lines_by_segment(spark, feed, paths, dry_rows)
    names = [f.source for f in feed.fields]
    heads = files.first_records(spark, list(paths.values()), feed.delimiter)
    of = (lambda p: drifts.header_drift(heads[p], names)) if feed.header else (lambda p: drifts.record_drift(heads[p], names))
    drift = {n: of(p) for n, p in paths.items()}
    good = [p for n, p in paths.items() if not drift[n].failed]
    if not good:
        return Parsed(None, {}, drift, [])
    if feed.header:
        frames = files.read_headed(spark, {p: heads[p] for p in good}, feed.delimiter, feed.multi_line)
    else:
        frames = [files.read_unheaded(spark, good, names, feed.delimiter, feed.multi_line)]
    out = None
    for df in frames:
        df = files.drop_footer(df) if feed.footer else df
        df = df.select(*(F.col(f"`{c}`") for c in names), files.loaded_name(spark, good).alias(FILE))
        out = df if out is None else out.unionByName(df)
    return Parsed(out if dry_rows is None else out.limit(dry_rows), {}, drift, [])


def _in(names: Iterable[str]) -> Column:
    return F.col(FILE).isin(*names)


def ingest_file(spark: SparkSession, feed: Feed, path: str, tables: Tables, run_ts: str, reference: DataFrame | None = None, reported: int | None = None, code: str | None = None, dry_rows: int = DRY_ROWS) -> Ingest:
    """:func:`ingest_files` of one file."""
    name = path.rstrip("/").rpartition("/")[2]
    return ingest_files(spark, feed, [path], tables, run_ts, reference, None if reported is None else {name: reported}, code, dry_rows)[0]


def ingest_files(
    spark: SparkSession, feed: Feed, paths: list[str], tables: Tables, run_ts: str, reference: DataFrame | None = None, reported: dict[str, int] | None = None, code: str | None = None,
    dry_rows: int = DRY_ROWS, archive: str | None = None, database: str | None = None, batch: tuple[str, int] | None = None,
) -> list[Ingest]:
    """Loads files, in the order of ``paths``; a file that drift fails, or that was loaded and may not
    be again, doesn't stop the others. Loading a file again, also after a run that stopped anywhere,
    leaves the same rows, with a later update time; but a feed without a key needs a ``batch`` for
    that, as rows that come back to other files are merged by key. What misses the ``reference`` waits in the recycle table; what waited and is there now
    loads before the run's own rows, which win over it, under its own file's name. Rejected records are
    kept whole beside the masked errors. Into ``tables`` of a dry run go the first ``dry_rows``
    records. ``reported``: rows that each file should have. ``archive``: a folder that loaded files
    move to. ``database``: the feed's target tables are made there where they don't exist.
    ``batch``: a stream and the number of its batch, which loads once."""
    resolve.must_be_closed(resolve.open_cells(feed, feed.options.get("load", ""), feed.options.get("needed", {}), feed.options.get("retention")))
    named: dict[str, str] = {}
    for p in paths:
        name = p.rstrip("/").rpartition("/")[2]
        files.admit(name, list(feed.patterns))
        if name in named:
            raise ContractError(f"{feed.name}: two files are named {name!r}")
        named[name] = p
    if batch and tables.processed.batch(batch[0]) >= batch[1]:
        return []
    if database and not tables.dry:
        targets.create_tables(spark, feed, database)
    again = set() if feed.allow_duplicates else tables.processed.has(list(named))
    results = {n: Ingest(feed.name, n, DUPLICATE) for n in named if n in again}
    todo = {n: p for n, p in named.items() if n not in again}
    held: list[DataFrame] = []
    try:
        if todo:
            found = parsed(spark, feed, todo, dry_rows if tables.dry else None)
            held += found.held
            results |= {n: Ingest(feed.name, n, DRIFT_FAIL if d.failed else LOADED, drift=d) for n, d in found.drift.items()}
            own = {n: results[n] for n in todo if results[n].status == LOADED}
            if own:
                _Run(feed, tables, run_ts, own, code, batch, held).load(found, reference, reported or {})
                if archive and not tables.dry:
                    files.archive(spark, [named[n] for n in own], archive)
    finally:
        for df in held:
            df.unpersist()
    return [results[n] for n in named]


@dataclass
class _Run:
    """The load of the files that may load: own. What it persists is added to held."""

    feed: Feed
    tables: Tables
    run_ts: str
    own: dict[str, Ingest]
    code: str | None
    batch: tuple[str, int] | None
    held: list[DataFrame]

    def keep(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist())
        return df

    def by_file(self, df: DataFrame) -> dict[str, int]:
        return {r[FILE]: r["count"] for r in df.groupBy(FILE).count().collect()}  # a row a file

    def tally(self, step: str, target: str, rows: dict[str, int]) -> None:
        for n, r in self.own.items():
            r.tally(step, target, rows.get(n, 0))

    def load(self, found: Parsed, reference: DataFrame | None, reported: dict[str, int]) -> None:
        feed, tables, names = self.feed, self.tables, list(self.own)
        rows = self.keep(audited(mapped(found.detail, feed.fields), feed, self.run_ts, self.code))
        bad = any_of([blank(c) for c in feed.mandatory])
        counts = {r[FILE]: r for r in rows.groupBy(FILE).agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("bad")).collect()}
        in_file = {n: r["n"] for n, r in counts.items()}
        rejected = {n: r.bad for n, r in counts.items()}
        self.tally("read", "", in_file)
        for r in self.own.values():
            r.steps[-1] = ("read", r.file, in_file.get(r.file, 0))
        good, refused = quality.split_mandatory(rows, feed.mandatory)
        others = {s.name: mapped(found.others[s.name], s.fields) for s in feed.segments if s.name in found.others}
        good, missed, others = self._ruled(good, others, reference)
        refused = refused.withColumn("reject_reason", quality.reject_reason(feed.mandatory)) if feed.mandatory else None
        if missed is not None:
            missed = self.keep(missed.withColumn("reject_reason", F.lit("rule")))
            for n, k in self.by_file(missed).items():
                rejected[n] = rejected.get(n, 0) + k
            refused = missed if refused is None else refused.unionByName(missed, allowMissingColumns=True)
        if refused is not None:
            tables.rejects.put(refused, FILE, names)
            self.tally("rejects", "rejects", rejected)
            if feed.keys and feed.mandatory:
                masked = quality.reject_rows(refused.where(bad), feed.mandatory, feed.keys[0], carry=(FILE,))
                tables.errors.put(masked.withColumn("created", F.lit(self.run_ts).cast("timestamp")), FILE, names)
        kept = None
        if feed.retry_rejects:
            good, kept = self._retried(good, refused)
        back, waiting, marked, recycled, due = None, None, None, {}, {}
        if reference is not None and feed.reference_key:
            good, waiting, marked, back, due = self._reference(good, reference)
            recycled = self.by_file(waiting)
        for n, r in self.own.items():
            r.counts = {"loaded": in_file.get(n, 0) - rejected.get(n, 0) - recycled.get(n, 0), "rejected": rejected.get(n, 0), "recycled": recycled.get(n, 0)}
        loaded = {n: r.counts["loaded"] for n, r in self.own.items()}
        expected = self._staged(good, back, due, loaded)
        if waiting is not None:
            self._recycled(waiting, marked, recycled, due)
        if kept is not None:
            tables.recycle.write(kept)
            self.tally("recycle: kept for the next run", "recycle", rejected)
        self.tally("stage", "stage", loaded)
        for s in feed.segments:
            if s.name in others:
                tables.of(s.name.lower()).put(audited(others[s.name], feed, self.run_ts, self.code), FILE, names)
        self._checked(others, expected | reported, in_file)
        self._recorded()

    def _ruled(self, good: DataFrame, others: dict[str, DataFrame], reference: DataFrame | None) -> tuple[DataFrame, DataFrame | None, dict[str, DataFrame]]:
        """The stage-leg rules over all segments; also what they reject. A rule with the option file, a
        pattern of names, is for the records of those files alone."""
        frames, missed = {**others, segments.DETAIL: good}, None
        for rule in (r for r in self.feed.rules if resolve.leg_of(r, self.feed) == "stage"):
            mine = [n for n in self.own if files.name_pattern(rule.options.get("file", "*")).match(n)]
            if not mine:
                continue
            part = frames if len(mine) == len(self.own) else {s: df.where(_in(mine)) for s, df in frames.items()}
            out = rules.apply_to_segments(part, [rule], segments.DETAIL, reference)
            if part is not frames:
                out.frames = {s: df.unionByName(frames[s].where(~_in(mine)), allowMissingColumns=True) for s, df in out.frames.items()}
            frames = out.frames
            for n in mine:
                self.own[n].not_done += out.not_done
            for df in out.missed:
                missed = df if missed is None else missed.unionByName(df, allowMissingColumns=True)
        return frames.pop(segments.DETAIL), missed, frames

    def _retried(self, good: DataFrame, refused: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Rejects that earlier runs held are tried again under their own files' names; those of the
        run's own files are read again anyway. Also what is held after the run: what is rejected now,
        or still."""
        held, mine = self.tables.recycle.read(), refused.drop("reject_reason") if refused is not None else good.limit(0)
        if held is not None:
            retried = self.keep(recycle.backlog(held, self.run_ts, self.feed.window_days).where(~_in(self.own)))
            n = retried.count()
            for r in self.own.values():
                r.tally("recycle: retried from earlier runs", "recycle", n)
            better, still = quality.split_mandatory(retried, self.feed.mandatory)
            good = good.unionByName(better.drop("recycled_at"), allowMissingColumns=True)
            mine = mine.unionByName(still, allowMissingColumns=True)
        return good, recycle.kept_rejects(mine, held, [FILE, *self.feed.keys], self.run_ts)

    def _reference(self, good: DataFrame, reference: DataFrame) -> tuple:
        """(rows that the reference has, rows that wait now, the recycle table's rows with what
        becomes of them, those of them that may load, their numbers by file)."""
        held, marked, back, due = self.tables.recycle.read(), None, None, {}
        if held is not None:
            marked = self.keep(recycle.marked(held, self.feed.reference_key, reference, self.run_ts, self.feed.window_days))
            changes = marked.where("_now <> status").groupBy(FILE).agg(F.count_if(F.col("_now") == recycle.PROCESSED).alias("back"), F.count_if(F.col("_now") == recycle.EXPIRED).alias("gone"))
            due = {r[FILE]: (r.back, r.gone) for r in changes.collect()}  # a row a file
            back = recycle.returned(marked)
            for r in self.own.values():
                r.reprocessed, r.expired = sum(b for b, _ in due.values()), sum(g for _, g in due.values())
                r.tally("recycle: reprocessed", "recycle", r.reprocessed)
                r.tally("recycle: expired", "recycle", r.expired)
        good, waiting = recycle.lookup(good, self.feed.reference_key, reference)
        return good, self.keep(waiting), marked, back, due

    def _staged(self, good: DataFrame, back: DataFrame | None, due: dict[str, tuple[int, int]], loaded: dict[str, int]) -> dict[str, int]:
        """Upserts the run's rows over those that waited, over those that are there; returns the rows
        that each of the run's files should have if it was loaded for the first time."""
        feed, stage = self.feed, self.tables.stage
        touched = set(self.own) | {n for n, (k, _) in due.items() if k}
        if feed.retry_rejects:
            touched |= {r[FILE] for r in good.select(FILE).distinct().collect()}  # a row a file
        touched, expected = sorted(touched), dict(loaded)
        old, keys = stage.read(touched), [FILE, *feed.keys]
        if not feed.keys:  # a file's rows are replaced as a whole, and other files' rows that come back are added
            parts = [df for df in (good, None if back is None else back.where(~_in(self.own)), None if old is None else old.where(~_in(self.own))) if df is not None]
            fresh = parts[0]
            for df in parts[1:]:
                fresh = fresh.unionByName(df, allowMissingColumns=True)
        else:
            fresh = merge_in_order(old, [df for df in (back, good) if df is not None], keys, "created")
            if back is not None and any(n in due and due[n][0] for n in self.own):
                for n, k in self.by_file(back.where(_in(self.own)).join(good.select(*keys).distinct(), keys, "left_anti")).items():
                    expected[n] += k
        stage.put(fresh, FILE, touched, self.batch)
        return expected

    def _recycled(self, waiting: DataFrame, marked: DataFrame | None, recycled: dict[str, int], due: dict[str, tuple[int, int]]) -> None:
        """After the stage, so a run that stops between the two is repeated whole."""
        touched = sorted({*due, *recycled})
        if marked is None:
            after = waiting.limit(0).withColumns({"first_seen": F.lit(self.run_ts).cast("timestamp"), "status": F.lit(recycle.PENDING)})
        else:
            after = recycle.settled(marked.where(_in(touched)))
        if touched:
            self.tables.recycle.put(recycle.send(after, waiting, [FILE, *self.feed.keys], self.run_ts), FILE, touched, self.batch)

    def _checked(self, others: dict[str, DataFrame], expected: dict[str, int], in_file: dict[str, int]) -> None:
        feed, spark, names = self.feed, self.tables.spark, list(self.own)
        rows = spark.createDataFrame([(n, expected.get(n, 0), in_file.get(n, 0)) for n in names], f"{FILE} string, reported long, details long")
        checks = quality.dq_checks_by(self.tables.stage.read(names), FILE, feed.mandatory or [feed.fields[0].stage], feed.keys, rows)
        if feed.trailer:
            segment, column = feed.trailer
            checks = checks.unionByName(drifts.trailer_checks_by(others[segment], FILE, column, rows))
        for r in checks.collect():  # a row a file and check
            self.own[r[FILE]].checks.append((r["name"], r.passed, r.detail))
        for r in self.own.values():
            r.status = LOADED if all(ok for _, ok, _ in r.checks) else WITH_FAILURES

    def _recorded(self) -> None:
        spark, names, now = self.tables.spark, list(self.own), F.lit(self.run_ts).cast("timestamp")
        made = [(n, r.counts["loaded"], r.counts["rejected"], r.counts["recycled"]) for n, r in self.own.items()]
        log = spark.createDataFrame(made, f"{FILE} string, loaded long, rejected long, recycled long").withColumns({"created": now, "updated": now})
        report = report_rows(spark, self.own.values(), self.run_ts, self.tables.dry)
        part = F.concat_ws(" ", "file", F.lit(self.run_ts))
        self.tables.report.put(report.withColumn("_of", part), "_of", [f"{n} {self.run_ts}" for n in names])
        self.tables.processed.put(merge_in_order(self.tables.processed.read(names), [log], [FILE], "created"), FILE, names, self.batch)
