"""Record types in one file: by a discriminator, by position in the file, or by fixed width. Each
gives one frame with the column ``segment``, null where a record is of no known type, so a file's
records are told apart, counted and written in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.files import slice_fields, split_fields

HEADER, DETAIL, TRAILER = "Header", "Detail", "Trailer"


def _in_fields(lines: DataFrame, delimiter: str) -> DataFrame:
    return lines.withColumn("fields", split_fields("value", delimiter)).withColumn("_field_count", F.size("fields"))


def _named(of: Column, values: dict[str, str]) -> Column:
    """The segment whose marker a record begins with."""
    pairs = [x for segment, marker in values.items() for x in (F.lit(marker), F.lit(segment))]
    return F.try_element_at(F.create_map(*pairs), F.trim(of))


def by_discriminator(lines: DataFrame, delimiter: str, values: dict[str, str]) -> DataFrame:
    """``lines`` with fields, _field_count and segment, by the first field."""
    rows = _in_fields(lines, delimiter)
    return rows.withColumn("segment", _named(F.get("fields", F.lit(0)), values))


def by_position(lines: DataFrame, delimiter: str, marker: str) -> DataFrame:
    """A record whose first field is the marker is a trailer, wherever it stands; of the others, a
    file's first record is its header and the rest are details. The first record is a minimum over
    block and row, a row a file, so a file may be read in any number of splits."""
    rows = _in_fields(lines, delimiter)
    top = rows.groupBy("_source_file").agg(F.min(F.struct("_block", "_id")).alias("_top"))
    ends = F.trim(F.get("fields", F.lit(0))) == marker
    begins = F.struct("_block", "_id") == F.col("_top")
    segment = F.when(F.coalesce(ends, F.lit(False)), TRAILER).when(begins, HEADER).otherwise(DETAIL)
    return rows.join(top, "_source_file").withColumn("segment", segment).drop("_top")


def by_width(lines: DataFrame, layouts: dict[str, list[tuple[str, int, int]]], values: dict[str, str], exact: bool = True, tests: dict[str, str] | None = None) -> DataFrame:
    """``lines`` with segment, _field_count, the number of the segment's fields, or -1 for a line of
    another length (of a shorter one, if not ``exact``), and fields, as the layout cuts them. A
    segment is told by what stands at the first field of its layout, or by an SQL expression over
    value in ``tests``; of several that hold, the first in ``layouts`` counts."""
    segment, count, fields = F.lit(None).cast("string"), F.lit(-1), F.lit(None).cast("array<string>")
    for name, layout in reversed(layouts.items()):
        _, start, length = layout[0]
        mine = F.expr(tests[name]) if tests and name in tests else F.trim(F.substring("value", start, length)) == values[name]
        width = max(s + n - 1 for _, s, n in layout)
        right = F.length("value") == width if exact else F.length("value") >= width
        segment = F.when(mine, name).otherwise(segment)
        count = F.when(mine, F.when(right, len(layout)).otherwise(-1)).otherwise(count)
        fields = F.when(mine, F.array(*slice_fields("value", layout))).otherwise(fields)
    return lines.select("*", segment.alias("segment"), count.alias("_field_count"), fields.alias("fields"))


def part(rows: DataFrame, segment: str, columns: list[str]) -> DataFrame:
    """A segment's records, their fields by position under their names; one past the end is null,
    further ones are dropped."""
    own = rows.where(F.col("segment") == segment)
    return own.select("_source_file", *(c for c in ("src_file_name",) if c in rows.columns), *(F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)), "_field_count")


def field_counts(rows: DataFrame, expected: dict[str, int], by: tuple[str, ...] = ()) -> DataFrame:
    """segment, records, short_rows and long_rows of each segment, and of null, the unknown ones:
    one aggregate for all files, whose name ``by`` may add. A count of -1, a line of another length,
    is short."""
    wanted = F.try_element_at(F.create_map(*(x for s, n in expected.items() for x in (F.lit(s), F.lit(n)))), "segment")
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    return rows.groupBy(*by, "segment").agg(F.count("*").alias("records"), count(F.col("_field_count") < wanted).alias("short_rows"), count(F.col("_field_count") > wanted).alias("long_rows"))
