"""Vectorised text work inside a task, on the bytes of an Arrow column.

Texts are UTF-8, and every class used here treats non-ASCII characters alike, so bytes from 0x80
on always belong to a word and a byte mask finds the same words as a regular expression over
characters. Work is cut into slices of about ``SLICE`` bytes, so memory doesn't follow the batch.

Words are told apart by their bytes: a slice's distinct words are numbered by Arrow's dictionary
encoding, which compares them, and only those few are hashed, by xxhash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE = 1 << 20
#: Bytes of a batch that goes to Python, where the session has left Spark's own limit as it is.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)

#: Words that white space separates: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of letters and digits, after A-Z are lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``size`` bytes of text each; a longer text goes alone."""
    _, offsets = texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def rows_at_once(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    """Runs of ``n`` rows, the last one of what is left."""
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each text (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word of :func:`words`, equal for equal bytes alone, and the distinct words."""
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    flat = np.ascontiguousarray(data[table[data]])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(flat)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _first(counts: np.ndarray) -> np.ndarray:
    """Where each of the runs of ``counts`` items begins."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each lower-cased text the distinct ``width``-word shingles by two 64-bit hashes, sorted by
    the first; a text of fewer words is one shingle, one of none has none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, SPACED)
    ids, known = distinct(data, starts, ends, SPACED)
    flat, edges = texts(known)
    whole, edges = flat.tobytes(), edges.tolist()
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]), "<u8").reshape(-1, 2)
    h = np.ascontiguousarray(digests.T).take(ids, axis=1)
    with np.errstate(over="ignore"):
        s = np.zeros((2, max(0, len(ids) - width + 1)), U64)
        for k in range(width if s.shape[1] else 0):
            s = s * _BASE + h[:, k : k + s.shape[1]]
        s = mix(s)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                own, at = np.unique(s[0, a : b - width + 1], return_index=True)
                out.append((own, s[1, a + at]))
            elif b > a:
                x = np.full(2, b - a, U64)
                for k in range(a, b):
                    x = x * _BASE + h[:, k]
                x = mix(x)
                out.append((x[:1], x[1:]))
            else:
                out.append((np.zeros(0, U64), np.zeros(0, U64)))
    return out


def exact_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each lower-cased text the distinct ``width``-word shingles as sorted numbers: within one
    call, two are the same exactly if their words are the same, byte by byte."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, SPACED)
    ids, known = distinct(data, starts, ends, SPACED)
    base = len(known) + 1
    packed, span = ids, base
    for k in range(1, width if len(ids) >= width else 1):
        if span * base >= 1 << 62:
            values, packed = np.unique(packed, return_inverse=True)
            span = len(values)
        packed, span = packed[:-1] * base + ids[k:], span * base
    counts = np.diff(first)
    runs = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(text)) - _first(runs)[text] + first[text]
    values, rank = np.unique(packed[at] if len(at) else at, return_inverse=True)
    key = np.unique(text * max(1, len(values)) + rank)
    owner = key // max(1, len(values))
    edges = np.searchsorted(owner, np.arange(len(counts) + 1))
    whole: dict[bytes, int] = {}  # of shorter texts
    out = []
    for i, n in enumerate(counts.tolist()):
        if 0 < n < width:
            out.append(np.array([-1 - whole.setdefault(ids[first[i] : first[i + 1]].tobytes(), len(whole))]))
        else:
            out.append(key[edges[i] : edges[i + 1]] - i * len(values))
    return out


def release() -> None:
    """Gives memory that is no longer used back to the system; an idle worker keeps none."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of BATCH_BYTES, unless the session says otherwise;
    a task's worker gives its memory back when it ends."""
    conf = df.sparkSession.conf
    if conf.get(_LIMIT).rstrip("b") == str(64 << 20):
        conf.set(_LIMIT, str(BATCH_BYTES))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(held, schema)
