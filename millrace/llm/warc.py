"""WARC archives with a shared Zstandard dictionary, on any file system that Spark writes to.

An archive starts with a skippable frame that holds the dictionary; every record after it is a
frame of its own. The dictionary is built from a bounded sample of the records to be archived.

Spark's text writer commits the archives, so those of lost or repeated attempts are never seen, and
a task's archive is a file. The writer ends each row with a separator; here that is the content of
another skippable frame, whose head ends the row before. So a file is a plain sequence of Zstandard
frames, and Spark's text reader, given the same separator, reads it record by record and in splits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import kernels, store

# Magic numbers of the dictionary's frame and of the separator's.
DICTIONARY_MAGIC, SEPARATOR_MAGIC = 0x184D2A5D, 0x184D2A5E
#: ASCII, and long and odd enough not to stand in a compressed record by chance; where a page holds
#: it, see :func:`frames_of` and :func:`_dictionary`.
SEPARATOR = "\n~millrace:4f1c9a70d2e85b36:record~\n"
_CLOSED = struct.pack("<II", SEPARATOR_MAGIC, len(SEPARATOR))
#: Bytes of the dictionary; expected records to build it from, and the bytes of a page from which on
#: it isn't among them.
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 20
LEVEL = 3
#: Writes whose archives may be read together; each has a dictionary.
MOST_WRITES = 256
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 0

RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None, url: str, digest: str, copy: int) -> str:
    """The id of a page's record. Rows may share a page_id, and be equal in everything; copy tells
    those apart, from 1."""
    own = hashlib.sha256(f"{digest} {copy} {url}".encode()).hexdigest()[:32]
    return f"<urn:page:{page_id}:{own}>"


def record(page_id: int | None, url: str, payload: bytes, copy: int, revisit: bool, refers_to: int | None, first_url: str | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, only its length and digest, and the id of
    the response, which is the first copy of its row."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = payload_digest(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}",
        f"WARC-Target-URI: {_field(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, first_url or '', digest, 1)}", f"WARC-Refers-To-Target-URI: {_field(first_url or '')}"]
    block = http if revisit else http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, copy, revisit, refers_to and first_url of each row. Copies collapse to
    the smallest before any shuffle, and the payloads' join can be split where a group is large."""
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    whole = whole.withColumn("wide", F.sha2("payload", 256))
    own = ["page_id", "url", "wide"]
    keys = store.spool(whole.select(*own, F.length("payload").alias("n")), "page-keys")
    if keys.groupBy(*own).count().where("count > 1").isEmpty():
        whole = whole.withColumn("copy", F.lit(1))
    else:  # rows that are equal in everything differ by a number
        whole = whole.groupBy(*own).agg(F.first("payload").alias("payload"), F.count("*").cast("int").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = keys.where(F.col("n") >= REVISIT_BYTES).groupBy("wide").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("first").isNotNull() & (~order.eqNullSafe(F.col("first")) | (F.col("copy") > 1))
    return whole.join(first, "wide", "left").select("page_id", "url", "payload", "copy", again.alias("revisit"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("first_url"))


def _dictionary(pages: DataFrame) -> bytes:
    """A dictionary from about SAMPLE_ROWS whole records of pages below SAMPLE_BYTES, chosen by a
    hash and in its order, so reruns build the same one; nothing if they are too few."""
    n = pages.count()
    if not n:
        return b""
    chosen = F.xxhash64("page_id", F.lit(11))
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    below = F.pmod(chosen, F.lit(1 << 31)) < int((1 << 31) * min(1.0, SAMPLE_ROWS / n))
    rows = pages.where(below & (F.octet_length(html) < SAMPLE_BYTES)).select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.cast("binary").alias("payload"), chosen.alias("k"))
    # rows that share a page_id are chosen together; their number is bounded all the same
    rows = rows.orderBy("k", "url", "payload").limit(2 * SAMPLE_ROWS).collect()
    samples = [record(r.page_id, r.url, bytes(r.payload), 1, False, None, None) for r in rows]
    # a dictionary is stored as it is, so no sample with the separator may get into it
    samples = [s for s in samples if SEPARATOR.encode() not in s]
    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""
    return b"" if SEPARATOR.encode() in made else made  # pieces of samples may have met to form it


def frames_of(codec: zstandard.ZstdCompressor, whole: bytes) -> bytes:
    """A record as one frame; or, where its compressed bytes would show the separator, as several,
    of which none holds a whole one."""
    mark = SEPARATOR.encode()
    frame = codec.compress(whole)
    if mark not in frame:
        return frame
    cut, at, parts = len(mark) // 2, 0, []
    while (found := whole.find(mark, at)) >= 0:
        parts.append(whole[at : found + cut])
        at = found + cut
    frame = b"".join(codec.compress(p) for p in (*parts, whole[at:]))
    if mark in frame:
        raise ValueError("a compressed record shows the separator by chance")
    return frame


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html; null html: empty payload) to
    archives under ``path``, a folder that doesn't exist, on any file system that Spark knows.

    Of records with equal payloads the one with the smallest page_id is the response (null is
    largest, then url decides, then any of the equal rows) and the others revisit it. An empty
    table writes no archive. A very long payload is a record as any other. Other columns are
    ignored.
    """
    marked, made = _marked(pages), _dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(made) if made else None, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(made)) + made + _CLOSED
        for batch in batches:
            for part in kernels.slices(batch, "payload"):
                frames = [head] if head and made else []
                for row in part.to_pylist():
                    frames.append(frames_of(codec, record(**row)) + _CLOSED)
                head = b""
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    frames = kernels.in_tasks(marked, run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).text(path)


def records_of(source: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, one at a time, as any reader of Zstandard
    frames with a leading dictionary does."""
    head = source.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", head)[1]))
    else:
        source.seek(0)
    yield from _parsed(io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True)))


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode().partition(": ")
            headers[key] = value
        block = stream.read(int(headers["Content-Length"]))
        if len(block) < int(headers["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{headers['WARC-Record-ID']} is cut off")
        yield headers, block


def page_of(uri: str | None) -> int | None:
    """The page_id in a record's id."""
    found = re.match(r"<urn:page:(-?[0-9]+):", uri or "")
    return int(found[1]) if found else None


def checked(headers: dict[str, str], block: bytes) -> dict:
    """The row of a record; a response's payload is digested again and must match its header."""
    kind, digest, n = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if (payload_digest(payload), len(payload)) != (digest, n):
            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
    return {"page_id": page_of(headers["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": page_of(headers.get("WARC-Refers-To"))}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: page_id, payload_bytes, payload_digest,
    record_type and refers_to. Archives of several writes may lie there together: a frame names its
    dictionary by number. A damaged record stops the read. Without archives, no records."""
    rows = spark.read.schema("value string").option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("frame"))
    leading = F.substring("frame", 1, 4) == F.lit(struct.pack("<I", DICTIONARY_MAGIC))
    # each archive begins with the dictionary of its write, and one write makes one
    held = [bytes(r.frame)[8 : -len(_CLOSED)] for r in rows.where(leading).distinct().limit(MOST_WRITES + 1).collect()]
    if len(held) > MOST_WRITES:
        raise ValueError(f"archives of more than {MOST_WRITES} writes under {path}")
    numbered = {zstandard.ZstdCompressionDict(d).dict_id(): d for d in held}
    if len(numbered) < len(held):
        raise ValueError(f"two dictionaries under {path} have one number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = {n: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)) for n, d in numbered.items()} | {0: zstandard.ZstdDecompressor()}
        for batch in batches:
            for part in kernels.slices(batch, "frame"):
                out = []
                for frame in part.column("frame").to_pylist():
                    codec = codecs[zstandard.get_frame_parameters(frame).dict_id]
                    found = [checked(*x) for x in _parsed(io.BufferedReader(codec.stream_reader(frame.removesuffix(_CLOSED), read_across_frames=True)))]
                    if len(found) != 1:
                        raise ValueError(f"a frame is cut off: it holds {len(found)} records")
                    out += found
                yield pa.RecordBatch.from_pylist(out, _RECORD)

    return kernels.in_tasks(rows.where(~leading), run, RECORDS)
