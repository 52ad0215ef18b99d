"""Document fingerprints: canonical exact digests.

A text's canonical form is compatibility-normalised, case-folded, with white space folded to single
spaces. Its 128-bit xxhash groups equal forms; inside a group of more than one row the forms' bytes
are compared, and a group that holds different forms is numbered apart.

Few texts share a digest, and only those move for the comparison: a bitmap of bounded size marks the
digests seen twice, and tasks send on just the forms it marks. Beyond that bound, more forms than
need to move, and the result is the same.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernels, store

#: Bits in the map of repeated digests, as a power of two: some for each of them, 8 MB at most.
LEAST_BITS, MOST_BITS = 16, 26


def canonical(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _marks(digests: DataFrame) -> tuple[np.ndarray, int]:
    """One bit for each digest prefix, set where a digest stands in more than one row, and the
    prefixes' bits."""
    again = store.spool(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * again.count()).bit_length()))
    prefix = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % (1 << bits)
    words = again.select(prefix.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("mask"))
    out = np.zeros(1 << bits - 5, np.uint32)
    for part in words.toLocalIterator():  # at most 2 ** (MOST_BITS - 5) rows
        out[part.word] = part.mask
    return out, bits


def collisions(df: DataFrame, digests: DataFrame, text: str) -> DataFrame:
    """digest, form and number (from 0) of each canonical form in a group that holds several: the
    byte comparison. Copies collapse before the shuffle."""
    marks, bits = _marks(digests)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "_text"):
                found = {}
                for t in part.column("_text").to_pylist():
                    form = canonical(t or "")
                    d = digest(form)
                    bit = int(d[:8], 16) % (1 << bits)
                    if marks[bit >> 5] >> (bit & 31) & 1:
                        found[form] = d
                yield pa.RecordBatch.from_arrays([pa.array(found.values(), pa.string()), pa.array(found.keys(), pa.string())], ["digest", "form"])

    groups = kernels.in_tasks(df.select(F.col(text).alias("_text")), forms, "digest string, form string").groupBy("digest").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("digest")
    groups = store.spool(groups, "collisions")
    if groups.isEmpty():
        return groups.select("digest", F.lit("").alias("form"), F.lit(0).alias("number")).limit(0)
    apart = kernels.in_tasks(df.select(F.col(text).alias("_text")), forms, "digest string, form string").join(groups, "digest").distinct()
    return apart.select("digest", "form", (F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1).alias("number"))


def _numbered(df: DataFrame, apart: DataFrame, digest_col: str, form_col: str, out: str) -> DataFrame:
    known = apart.select(F.col("digest").alias(digest_col), F.col("form").alias(form_col), F.col("number").alias("_number"))
    name = F.when(F.coalesce("_number", F.lit(0)) > 0, F.concat(F.col(digest_col), F.lit("-"), F.col("_number"))).otherwise(F.col(digest_col))
    return df.join(known, [digest_col, form_col], "left").withColumn(out, name).drop("_number")


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fingerprint: equal for two rows exactly if their texts have the
    same canonical form. Null reads as empty. Repeated rows and ties get equal fingerprints, an
    empty table gives an empty one, and other columns are dropped, so none can clash."""
    schema = store.widened(df, keep, "digest string, form string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "_text"):
                forms = [canonical(t or "") for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(map(digest, forms), pa.string()), pa.array(forms, pa.string())], schema.names)

    made = kernels.in_tasks(df.select(*keep, F.col(text).alias("_text")), run, schema)
    digests = store.spool(made.select(*keep, "digest"), "digests")
    apart = collisions(df, digests, text)
    if apart.isEmpty():
        return digests.withColumnRenamed("digest", "fingerprint")
    return _numbered(made, apart, "digest", "form", "fingerprint").select(*keep, "fingerprint")


def _edited(own: str, behind: str) -> str:
    k = len(own) // 3
    return own[: len(own) - k] + behind[:k]


def _compared(row_id: object, own: str, form: str, behind: str, next_form: str) -> tuple:
    new = _edited(own, behind)
    new_form = canonical(new)
    return row_id, len(own), hashlib.sha256(new.encode()).hexdigest(), digest(form), digest(new_form), float(form == new_form), float(form == next_form)


EDITS = "doc_id bigint, n_chars bigint, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double"


def edits(df: DataFrame, text: str = "text") -> DataFrame:
    """Compares each text with an edited one, in which its last third gives way to the start of
    the next document by descending doc_id, and with the next document itself.

    One range shuffle brings neighbours together; a task streams through its sorted rows. The last
    row of a partition waits for the first of the next one, and those few rows are joined after.
    Null doc_ids come last, equal ones by a hash of the text and the text. An only row is its own
    next one. Null reads as empty; an empty table gives an empty one.
    """
    spark = df.sparkSession
    keys = (F.col("doc_id").desc_nulls_last(), F.col("_hash"), F.col("_text"))
    rows = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    rows = rows.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys).select("doc_id", "_text")
    names = [*(f.split()[0] for f in EDITS.split(", ")), "part", "first_text", "last_text"]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, before, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for part in kernels.slices(batch, "_text"):
                out = []
                for row_id, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    form = canonical(own)
                    if before is None:
                        first = own
                    else:
                        out.append((*_compared(*before, own, form), here, None, None))
                    before = (row_id, own, form)
                yield batch_of(out)
        if before is not None:
            yield batch_of([(before[0], None, None, None, None, None, None, here, first, before[1])])

    made = store.spool(kernels.in_tasks(rows, run, f"{EDITS}, part int, first_text string, last_text string"), "edits")
    ends = made.where("last_text is not null")
    parts = sorted(r.part for r in ends.select("part").collect())  # one a partition
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    pairs = ends.select("doc_id", "part", "last_text").join(follows, "part").join(heads, "next_part").select("doc_id", "last_text", "next_text")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield batch_of([(*_compared(i, own, canonical(own), behind, canonical(behind)), 0, None, None) for i, own, behind in rows]).select(names[:7])

    return made.where("last_text is null").select(*names[:7]).unionByName(kernels.in_tasks(pairs, join, EDITS))
