"""Near-duplicates by MinHash: one-permutation sketches with optimal densification, banded buckets
and star-shaped candidate edges, each link confirmed on the words of the full shingle sets.

Texts with equal sets are one class and need no candidates. A bucket's classes are compared with its
first centre alone, so a bucket of n classes makes n - 1 pairs. A star can miss a link between two
of its points; so where a bucket's classes are then not all in one component, those outside its
largest component go on: in small buckets with all the others pair by pair, in large ones with
further centres, and what that leaves open with all the others in blocks, from which only true links
come out. No link between components of a bucket is lost, however large the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels, store

WIDTH = 5
#: Links need this share of the union, in percent, where the caller names no other.
LEAST = 80
#: Bands and values in each, by similarity: two texts just that similar share no band with
#: probability (1 - 0.85 ** 7) ** 36, less than 1e-6, or (1 - 0.8 ** 5) ** 40, about 1e-7.
BANDING = {85: (36, 7), 80: (40, 5)}
#: For other similarities: the most bands while that allows several values, and the chance of a miss.
MOST_BANDS, MISS = 40, 1e-6
#: Centres of a bucket; classes in a bucket whose remaining pairs are taken one by one; expected
#: shingles on each side of a block in larger ones, and the least that a class counts for; columns
#: of a block's matrix at a time.
STARS = 4
SMALL = 16
BLOCK = 1 << 17
LEAST_WEIGHT = 128
COLUMNS = 4096
#: Bytes of a pair's first text in a slice.
PAIRS = kernels.SLICE // 4

_U = np.uint64


@cache
def banding(similarity: int) -> tuple[int, int]:
    """Bands and values in each that find pairs of ``similarity`` percent."""
    if not 1 <= similarity <= 100:
        raise ValueError(f"similarity is a percentage, not {similarity}")
    if similarity in BANDING:
        return BANDING[similarity]
    need = lambda rows: max(1, math.ceil(math.log(MISS) / math.log1p(-((similarity / 100) ** rows)))) if similarity < 100 else 1
    rows = max((r for r in range(1, 33) if need(r) <= MOST_BANDS), default=1)
    return need(rows), rows


@cache
def _probes(bins: int) -> np.ndarray:
    """For each bin, the order in which an empty one asks the others for a value."""
    return np.stack([np.random.default_rng([5, i]).permutation(bins) for i in range(bins)])


def sketch(own: np.ndarray, similarity: int = LEAST) -> np.ndarray:
    """The smallest hash in each of the bins that the leading bits of the sorted distinct hashes
    choose; an empty bin takes that of the first bin with one in its own fixed random order."""
    bins = math.prod(banding(similarity))
    at = ((own >> _U(32)) * _U(bins)) >> _U(32)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    values, full = np.zeros(bins, _U), np.zeros(bins, bool)
    values[at[first].astype(np.int64)], full[at[first].astype(np.int64)] = own[first], True
    if empty := bins - int(full.sum()):
        bare = np.flatnonzero(~full)
        probes = _probes(bins)[bare]
        values[bare] = values[probes[np.arange(empty), full[probes].argmax(1)]]
    return values


def bands(own: np.ndarray, similarity: int = LEAST) -> np.ndarray:
    """A 64-bit key of each band of a set's sketch, the band's number included."""
    n_bands, n_rows = banding(similarity)
    with np.errstate(over="ignore"):
        rows = kernels.mix(sketch(own, similarity)).reshape(n_bands, n_rows)
        key = np.arange(1, n_bands + 1, dtype=_U)
        for k in range(n_rows):
            key = key * _U(0x9E3779B97F4A7C15) + rows[:, k]
        return kernels.mix(key)


def _whole(own: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """128 bits that stand for a set, from both hashes of its shingles."""
    with np.errstate(over="ignore"):
        pair = [kernels.mix(h + _U(len(h))).sum(dtype=_U) for h in own]
    return tuple(int(x.astype(np.int64)) for x in pair)


def row_key() -> Column:
    """32 bytes that stand for a row's doc_id and text; rows equal in both share them."""
    return F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256))


def signatures(docs: DataFrame, similarity: int = LEAST) -> DataFrame:
    """row, doc_id, n_shingles, set_a, set_b (that stand for the set) and bands, of each whole text."""
    names = ["row", "doc_id", "n_shingles", "set_a", "set_b", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                sets = kernels.shingles(*kernels.texts(part.column("text")), WIDTH)
                whole = [_whole(s) for s in sets]
                keys = [bands(s, similarity).view(np.int64) if len(s) else np.zeros(0, np.int64) for s, _ in sets]
                ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
                columns = [part.column("row"), part.column("doc_id"), pa.array([len(s) for s, _ in sets], pa.int64()), *(pa.array([w[k] for w in whole], pa.int64()) for k in (0, 1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kernels.in_tasks(own, run, "row binary, doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _shared(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= similarity * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: int = LEAST) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose full sets share ``similarity`` percent of their
    union. The sets are compared word by word, not by their hashes. texts: node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text_a", PAIRS):
                n = part.num_rows
                sets = kernels.exact_sets(*kernels.texts(pa.concat_arrays([part.column("text_a"), part.column("text_b")])), WIDTH)
                keep = [_shared(sets[i], sets[n + i], similarity) for i in range(n)]
                yield part.select(["a", "b"]).filter(pa.array(keep))

    named = [texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b")]
    return kernels.in_tasks(pairs.join(named[0], "a").join(named[1], "b").select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of the nodes of ``edges`` (a, b): labels
    sink along the edges and then along themselves, until none changes."""
    both = store.spool(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = store.spool(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"))
        sunk = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "low").alias("low"))
        root = sunk.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        fresh = store.spool(sunk.join(root, "low").select("node", F.col("label").alias("was"), F.least("low", "lower").alias("label")), "labels")
        labels = fresh.select("node", "label")
        if fresh.where("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _alike(n: str, m: str, similarity: int) -> Column:
    """Sizes that sets must have to share ``similarity`` percent of their union."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * similarity


# Centres are the nodes with the smallest value of a bijection of 64 bits, a rotation that puts the
# busy low bits of ids first and a difference, so that value is all that an aggregation has to keep.


def _turned(c: Column, by: int) -> Column:
    return F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by))


def _seed(k: int) -> Column:
    return F.lit(int(np.random.default_rng([6, k]).integers(-(2**63), 2**63)))


def _place(node: Column, k: int) -> Column:
    """The node's place in the ``k``-th order."""
    return _turned(node, 44 + 4 * k).bitwiseXOR(_seed(k))


def _node_at(place: Column, k: int) -> Column:
    """The node whose place that is."""
    return _turned(place.bitwiseXOR(_seed(k)), 20 - 4 * k)


def _linked(left: list[np.ndarray], right: list[np.ndarray], similarity: int = LEAST) -> np.ndarray:
    """Which sets of the two lists are linked: an exact count of what they share, as a product of
    membership matrices over a slice of the shingles at a time."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    every = [(np.repeat(np.arange(len(side)), n), np.concatenate(side)) for side, n in zip((left, right), sizes, strict=True)]
    common = np.intersect1d(every[0][1], every[1][1])
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(common), COLUMNS):
        part, sides = common[low : low + COLUMNS], []
        for (rows, values), n in zip(every, sizes, strict=True):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            member = np.zeros((len(n), len(part)), np.float32)
            member[rows[hit], at[hit]] = 1
            sides.append(member)
        shared += sides[0] @ sides[1].T
    both = shared.astype(np.int64)
    return (both > 0) & (100 * both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both))


def _placed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The buckets whose classes are in several components of the links ``found``: their rows, with
    component and rest, whether that isn't the bucket's largest."""
    label = components(found)
    placed = buckets.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    # written first, so a large bucket's share of the join can be split
    top = store.spool(sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.component").alias("top")), "largest")
    return store.spool(placed.join(top, "key").withColumn("rest", F.col("component") != F.col("top")).drop("top"), "open")


def _in_blocks(members: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Links between the components of the large buckets ``members`` that suffice to join them.

    Classes are dealt by the order of magnitude of their sets, as links join only neighbouring ones,
    and in each by a hash to blocks of about BLOCK shingles, so a task's memory doesn't follow the
    bucket. A block gives one link for each two components in it."""
    level = F.floor(F.log(F.col("n_shingles")) / math.log(100 / similarity) + 1e-9).cast("int") if similarity < 100 else F.col("n_shingles").cast("int")
    weight = F.greatest("n_shingles", F.lit(LEAST_WEIGHT))
    rows = members.select("key", "node", "component", "rest", level.alias("level"), weight.alias("weight"))
    one = rows.where("rest").withColumn("side", F.lit(0))
    two = rows.withColumn("side", F.lit(1)).withColumn("level", F.explode(F.array(*(F.col("level") + d for d in (-1, 0, 1)))))
    sides = one.unionByName(two)
    parts = lambda k: F.ceil(F.sum(F.when(F.col("side") == k, F.col("weight"))) / BLOCK).cast("int")
    grid = store.spool(sides.groupBy("key", "level").agg(parts(0).alias("tall"), parts(1).alias("wide")).where("tall is not null and wide is not null"), "grid")
    dealt = sides.join(grid, ["key", "level"])
    at = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    own = F.when(F.col("side") == 0, at("tall", 1)).otherwise(at("wide", 2))
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("wide")).otherwise(F.col("tall")) - 1))
    cells = dealt.select("key", "level", "node", "component", "side", own.alias("own"), across.alias("across"))
    cells = cells.select("key", "level", "node", "component", "side", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("across")).alias("i"), F.when(F.col("side") == 0, F.col("across")).otherwise(F.col("own")).alias("j"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        halves = [pdf[pdf["side"] == k].reset_index(drop=True) for k in (0, 1)]
        if not len(halves[0]) or not len(halves[1]):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        n = len(halves[0])
        sets = kernels.exact_sets(*kernels.texts(pa.array(pd.concat([h["text"] for h in halves]), pa.string())), WIDTH)
        parts = [h["component"].to_numpy() for h in halves]
        x, y = np.nonzero(_linked(sets[:n], sets[n:], similarity) & (parts[0][:, None] != parts[1][None, :]))
        if len(x):
            _, first = np.unique(np.stack([parts[0][x], parts[1][y]]), axis=1, return_index=True)
            x, y = x[first], y[first]
        return pd.DataFrame({"a": halves[0]["node"].to_numpy()[x], "b": halves[1]["node"].to_numpy()[y]})

    return cells.join(texts, "node").groupBy("key", "level", "i", "j").applyInPandas(cell, "a bigint, b bigint")


def classes(sig: DataFrame) -> DataFrame:
    """node, set_a, set_b, doc_id (the smallest), row, n_shingles and bands of each class of equal
    sets; copies collapse before the shuffle. node: doc_id, or, where that is null or another
    class's as well, a negative number from the set."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n_shingles", "bands")
    reps = store.spool(sig.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(own).alias("m")).select("set_a", "set_b", "m.doc_id", "m.row", "m.n_shingles", "m.bands"), "classes")
    odd = store.spool(reps.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_odd"), F.lit(True).alias("_is_odd")), "odd")
    if odd.isEmpty():
        return reps.withColumn("node", F.col("doc_id"))
    spare = F.xxhash64("set_a", "set_b").bitwiseOR(F.lit(-(1 << 63)))
    return reps.join(odd, F.col("doc_id").eqNullSafe(F.col("_odd")), "left").withColumn("node", F.when(F.col("_is_odd"), spare).otherwise(F.col("doc_id"))).drop("_odd", "_is_odd")


def links(docs: DataFrame, reps: DataFrame, similarity: int = LEAST) -> DataFrame:
    """Links (a, b) between classes that suffice for the components, and then some."""
    banded = reps.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("in_bucket"), *(F.min(_place(F.col("node"), k)).alias(f"c{k}") for k in range(STARS))).where("in_bucket > 1")
    # written first, so a large bucket's share of the join can be split
    buckets = store.spool(banded.join(store.spool(shared, "centres"), "key"), "buckets")
    wanted = reps.select("node", "row").join(buckets.select("node").distinct(), "node", "left_semi")
    texts = docs.select(row_key().alias("row"), "text").join(wanted, "row").dropDuplicates(["row"]).select("node", "text")
    texts = store.spool(texts, "candidates")

    def stars(rows: DataFrame, orders: range) -> DataFrame:
        points = rows.select("node", F.explode(F.array(*(_node_at(F.col(f"c{k}"), k) for k in orders))).alias("centre")).where("centre <> node")
        return points.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()

    first = store.spool(stars(buckets, range(1)), "stars")
    found = store.spool(confirmed(first, texts, similarity), "links")
    open_ = _placed(buckets, found)
    if open_.isEmpty():
        return found
    few = open_.where(F.col("in_bucket") <= SMALL)
    other = few.select("key", F.col("node").alias("other"), F.col("n_shingles").alias("n_other"), F.col("component").alias("c_other"))
    pairs = few.join(other, "key").where((F.col("component") < F.col("c_other")) & _alike("n_shingles", "n_other", similarity))
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    many = open_.where(F.col("in_bucket") > SMALL)
    more = pairs.unionByName(stars(many.where("rest"), range(1, STARS))).distinct().join(first, ["a", "b"], "left_anti")
    found = found.unionByName(store.spool(confirmed(store.spool(more, "pairs"), texts, similarity), "links"))
    if many.isEmpty():
        return found
    left = _placed(many.drop("component", "rest"), found)
    return found if left.isEmpty() else found.unionByName(store.spool(_in_blocks(left, texts, similarity), "links"))


def _grouped(docs: DataFrame, similarity: int) -> DataFrame:
    """row, doc_id, n_shingles and component (null without shingles) of each row of ``docs``, and
    least: the smallest doc_id and the smallest row with it in the component."""
    sig = store.spool(signatures(docs, similarity), "signatures")
    reps = classes(sig)
    label = components(links(docs, reps, similarity))
    joined = reps.select("node", "set_a", "set_b", "doc_id", "row").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = store.spool(joined, "components")
    least = joined.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    of_set = joined.select("set_a", "set_b", "component").join(least, "component")
    return sig.select("row", "doc_id", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b"], "left").drop("set_a", "set_b")


def near_duplicates(docs: DataFrame, similarity: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (whether
    that is the document itself) of each row of ``docs``. Links need ``similarity`` percent of the
    union of two sets shared.

    A-Z are lower-cased, words are separated by white space. A text of fewer than WIDTH words is one
    shingle; null and empty texts have none and are linked with nothing. Rows of equal texts are
    linked; ties and repeated rows share a component, and rows that share its smallest doc_id are
    all kept. Rows that share a doc_id but no set are nodes of their own. A row with a null doc_id
    links others as any does, but has a null component_id itself, and is kept: :func:`deduplicate`
    tells such rows apart. Whole texts of any length are read. An empty table gives an empty one.
    Other columns are ignored.
    """
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return _grouped(docs, similarity).select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, similarity: int = LEAST) -> DataFrame:
    """``docs`` with one row of each group at ``similarity`` percent, that with the smallest doc_id
    (null is largest; then any one); all columns stay. Rows are told apart by doc_id and text, and
    of rows that are equal in both one stays. Rows without words all stay. An empty table gives an
    empty one."""
    name = "_row"
    while name in docs.columns:
        name = f"_{name}"
    rows = store.spool(_grouped(docs, similarity).where("n_shingles > 0").groupBy("row").agg(F.count("*").alias("n"), F.first("least").alias("least")), "rows")
    gone = rows.where(F.col("row") != F.col("least.row")).select(F.col("row").alias(name))
    twice = rows.where((F.col("row") == F.col("least.row")) & (F.col("n") > 1)).select(F.col("row").alias(name))
    out = docs.withColumn(name, row_key()).join(gone, name, "left_anti")
    if not twice.isEmpty():
        out = out.join(twice, name, "left_anti").unionByName(out.join(twice, name, "left_semi").dropDuplicates([name]))
    return out.select(*docs.columns)
