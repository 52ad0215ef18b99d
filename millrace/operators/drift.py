"""Schema drift: what must stop a file before anything is written, and what is set aside."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import stated


class DriftFail(ValueError):
    """A file lacks what its contract states."""


@dataclass(frozen=True)
class Drift:
    missing: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    short_rows: int = 0
    long_rows: int = 0
    unknown_rows: int = 0

    @property
    def failed(self) -> bool:
        return bool(self.missing or self.short_rows or self.unknown_rows)


def header_drift(found: list[str], expected: list[str]) -> Drift:
    """Missing columns fail the file, extra ones are dropped and reported, order is free."""
    names = [c.strip().strip('"') for c in found]
    return Drift(tuple(c for c in expected if c not in names), tuple(c for c in names if c not in expected and not c.startswith("_")))


def record_drift(found: list[str], expected: list[str]) -> Drift:
    """The same for a file without a header, from the number of its first record's fields."""
    return Drift(tuple(expected[len(found) :]), long_rows=int(len(found) > len(expected)))


def first_record_drift(first: str, delimiter: str, expected: list[str], header: bool = True) -> Drift:
    """Either of the two, from a file's first record; quoted fields may hold the delimiter."""
    found = next(csv.reader([first], delimiter=delimiter, skipinitialspace=True), [])
    return header_drift(found, expected) if header else record_drift(found, expected)


def field_count_drift(rows: DataFrame, expected: int, column: str = "_field_count") -> DataFrame:
    """short_rows and long_rows, 0 for no rows."""
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    return rows.agg(count(F.col(column) < expected).alias("short_rows"), count(F.col(column) > expected).alias("long_rows"))


def segment_drift(counts: list) -> Drift:
    """From the rows of ``segments.field_counts``: short records of any segment, and records of no
    known one, fail the file; long ones are set aside and counted."""
    known = [r for r in counts if r.segment is not None]
    return Drift(short_rows=sum(r.short_rows for r in known), long_rows=sum(r.long_rows for r in known), unknown_rows=sum(r.records for r in counts if r.segment is None))


def short_lines(lines: DataFrame, width: int, by: str = "_source_file") -> DataFrame:
    """Files with lines shorter than ``width``, and how many."""
    return lines.where(F.length("value") < width).groupBy(by).agg(F.count("*").alias("short_rows"))


def trailer_checks_by(trailers: DataFrame, by: str, count: str, details: DataFrame) -> DataFrame:
    """:func:`trailer_check` for each group of ``by``, such as a file; ``details`` has ``by`` and
    details, its number of detail rows. A group without a trailer fails."""
    found = trailers.groupBy(by).agg(F.count("*").alias("n"), F.max(F.trim(count).try_cast("bigint")).alias("stated"))
    met = details.select(by, "details").join(found, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.select(by, *_trailer_row())


def _trailer_row() -> list[Column]:
    passed = (F.col("n") == 1) & F.coalesce(F.col("stated") == F.col("details"), F.lit(False))
    said = F.concat(F.lit("trailers="), "n", F.lit(" stated="), F.coalesce(F.col("stated").cast("string"), F.lit("null")), F.lit(" details="), F.coalesce(F.col("details").cast("string"), F.lit("null")))
    return [F.lit("trailer_count").alias("name"), passed.alias("passed"), said.alias("detail")]


def trailer_check(trailers: DataFrame, count: str, details: int | Column) -> DataFrame:
    """One trailer, with a readable count that equals the detail rows; ``details`` may be a column of
    ``trailers`` that is the same in all of them."""
    wanted = F.lit(details).cast("bigint") if isinstance(details, int) else F.max(details)
    row = trailers.agg(F.count("*").alias("n"), F.max(F.trim(count).try_cast("bigint")).alias("stated"), wanted.alias("details"))
    return row.select(*_trailer_row())


def dictionary_drift(found: DataFrame, dictionary: DataFrame, key: tuple[str, ...] = (), scope: float | None = None, classes: DataFrame | None = None) -> DataFrame:
    """``key``, name and finding (missing, extra, type, length or position) of fields that differ from
    the dictionary; both have name, kind, length and position, and the columns of ``key``, such as a
    segment. Names compare without case and marks, types by ``classes`` (name and class; by default
    the usual ones). With ``scope``, where a larger share of a key's dictionary fields is missing,
    the one finding ``scope`` stands for all."""
    if not key:
        one = [d.withColumn("_all", F.lit(1)) for d in (found, dictionary)]
        return dictionary_drift(*one, ("_all",), scope, classes).drop("_all")
    tidy = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    a, b = (d.select(*key, tidy.alias("name"), *(F.col(c).alias(f"{c}_{s}") for c in ("kind", "length", "position")), F.lit(True).alias(f"in_{s}")) for d, s in ((found, "l"), (dictionary, "r")))
    differs = lambda c: ~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))
    met = stated.with_alike(a.join(b, [*key, "name"], "full_outer"), "kind_l", "kind_r", stated.class_table(found.sparkSession) if classes is None else classes)
    finding = F.when(F.col("in_l").isNull(), "missing").when(F.col("in_r").isNull(), "extra").when(~F.col("alike"), "type").when(differs("length"), "length").when(differs("position"), "position")
    met = met.select(*key, "name", finding.alias("finding"), F.col("in_r").isNotNull().alias("_stated"))
    if scope is not None:
        share = met.groupBy(*key).agg((F.sum((F.col("finding") == "missing").cast("int")) / F.greatest(F.sum(F.col("_stated").cast("int")), F.lit(1))).alias("_share"))
        wide = share.where(F.coalesce("_share", F.lit(0.0)) > scope).drop("_share")
        flags = wide.select(*key, F.lit(None).cast("string").alias("name"), F.lit("scope").alias("finding"))
        rest = met.join(wide, list(key), "left_anti")
        return rest.where("finding is not null").select(*key, "name", "finding").unionByName(flags)
    return met.where("finding is not null").drop("_stated")
