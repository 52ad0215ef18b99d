"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, walked best bin first.

The tree is fitted on a bounded sample of the vectors, and every vector is filed under the leaf that
it descends to. A query walks the tree through a priority queue: the node whose centre is nearest to
it comes next, be it a leaf, which is visited, or not, and then its children queue up. How many
leaves a query visits is calibrated: for a bounded sample of vectors the true neighbours are found by
a scan of the whole index, their leaves are looked up in the sample's own walks, and visits are
widened until they hold TARGET of those neighbours. When that takes all leaves, the search is exact.

Equal vectors are one class with its smallest ids, so a very common vector is filed and asked for
once. Leaves are packed into cells of about CELL classes, a larger one has several, and a task
holds one cell at a time and streams the queries past it, so no leaf and no number of queries is too
large for a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernels, store

#: Vectors that the tree is fitted on, at most, and that visits are calibrated on, at most.
SAMPLE, CALIBRATION = 1 << 15, 256
#: Share of the calibration's true neighbours that the visited leaves must hold.
TARGET = 0.975
#: Children of a node, sampled vectors that a leaf has at most, rounds of k-means a node.
BRANCH, LEAF, ROUNDS = 8, 128, 8
#: Classes of a cell, about; query classes that one copy of a cell serves, about; queries at a time.
CELL, ASKING, AT_ONCE = 4096, 1 << 17, 128
#: More than the error of a cosine by matrix product; pairs whose cosine is recomputed at a time.
SLACK, PAIRS = 1e-9, 1 << 14
#: Classes and queries as one table: the cell (and copy of it), whose row it is, and its leaves there.
SHAPE = "place long, asks boolean, id long, ids array<long>, leaves array<int>, v array<double>"


def takes_part(vector: str) -> Column:
    """Not null, not zero, and no component null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column without nulls; shorter ones end in zeros. Each row is divided by a power
    of two, which loses nothing and keeps squares in range."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    if len(out):
        out = np.ldexp(out, -np.frexp(np.abs(out).max(1, initial=0))[1][:, None])
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


class Tree:
    """Nodes in the order in which they were made: centre (of length 1), children as a range of
    nodes (none: a leaf), and the number of the leaf."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 1):
        rng = np.random.default_rng(seed)
        rows = unit(sample)
        self.centres, self.children, self.leaf = [unit(rows.sum(0, keepdims=True))[0]], [(0, 0)], [-1]
        todo = [(0, np.arange(len(rows)))]
        self.leaves = 0
        while todo:
            node, own = todo.pop()
            centres, label = self._split(rows[own], branch, rng) if len(own) > leaf else (np.zeros((0, 0)), own)
            if len(centres) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            first = len(self.centres)
            self.children[node] = (first, first + len(centres))
            for k, centre in enumerate(centres):
                self.centres.append(centre)
                self.children.append((0, 0))
                self.leaf.append(-1)
                todo.append((first + k, own[label == k]))
        self.matrix = np.array(self.centres)

    @staticmethod
    def _split(rows: np.ndarray, branch: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Centres and labels by spherical k-means; centres without rows are dropped."""
        centres = rows[np.sort(rng.choice(len(rows), min(branch, len(rows)), replace=False))]
        for _ in range(ROUNDS):
            label = (rows @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, rows)
            centres = unit(sums[np.bincount(label, minlength=len(centres)) > 0])
        label = (rows @ centres.T).argmax(1)
        held, label = np.unique(label, return_inverse=True)
        return centres[held], label

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest child, ties to the first."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            first, end = self.children[node]
            if first == end:
                out[own] = self.leaf[node]
                continue
            label = (rows[own] @ self.matrix[first:end].T).argmax(1)
            todo += [(first + k, own[label == k]) for k in np.unique(label).tolist()]
        return out

    def walks(self, rows: np.ndarray, visits: int) -> Iterator[list[int]]:
        """The first ``visits`` leaves of each row (of length 1), best bin first."""
        for near in rows @ self.matrix.T:
            near = near.tolist()
            queue, found = [(-near[0], 0)], []
            while queue and len(found) < visits:
                _, node = heapq.heappop(queue)
                first, end = self.children[node]
                if first == end:
                    found.append(self.leaf[node])
                for child in range(first, end):
                    heapq.heappush(queue, (-near[child], child))
            yield found


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """v and its ``keep`` smallest ids, one row for each different vector."""
    own = Window.partitionBy("v").orderBy("id")  # limited before the shuffle, so common vectors aren't gathered
    few = vectors.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("first_id", F.array_min("ids"))


def _sample(classes: DataFrame, of: int, n: int, salt: int) -> DataFrame:
    """``n`` of the ``of`` classes, those with the smallest hashes; nearly all others are passed over
    before anything is sorted or moved."""
    hashed = F.xxhash64("first_id", F.lit(salt))
    below = int((1 << 31) * min(1.0, (2 * n + 50) / of))
    return classes.where(F.pmod(hashed, F.lit(1 << 31)) < below).orderBy(F.pmod(hashed, F.lit(1 << 31)), "first_id").limit(n)


def _fit(classes: DataFrame, of: int, dims: int, sample: int) -> Tree:
    rows = _sample(classes.select("first_id", "v"), of, sample, 1).select("v").toArrow()
    return Tree(matrix(rows.column("v").combine_chunks(), dims))


def _filed(classes: DataFrame, tree: Tree, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.file(unit(matrix(b.column("v"), dims)))
            yield b.append_column("leaf", pa.array(leaf))

    return kernels.in_tasks(classes, run, store.widened(classes, ("v", "ids", "first_id"), "leaf int"))


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each of ``rows``, by score, then id."""
    order = np.lexsort((ids, -scores, rows))
    first = np.searchsorted(rows[order], rows[order], "left")
    return order[np.arange(len(order)) - first < k]


def calibrate(filed: DataFrame, of: int, tree: Tree, dims: int, k: int, target: float = TARGET, n: int = CALIBRATION) -> int:
    """The leaves to visit: enough to hold ``target`` of the true neighbours of a sample."""
    asked = _sample(filed.select("first_id", "v"), of, n, 2).toArrow()
    ids = asked.column("first_id").to_numpy()
    rows = unit(matrix(asked.column("v").combine_chunks(), dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for b in batches:
            for part in kernels.rows_at_once(b, CELL):
                mine, leaf = part.column("first_id").to_numpy(), part.column("leaf").to_numpy()
                near = rows @ unit(matrix(part.column("v"), dims)).T
                near[ids[:, None] == mine] = -2
                top = np.argpartition(-near, min(k, len(mine)) - 1, axis=1)[:, :k]
                q = np.repeat(np.arange(len(ids)), top.shape[1])
                top = top.ravel()
                new = [q, near[q, top], mine[top], leaf[top]]
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
                kept = [x[at] for at in [_best(kept[0], kept[1], kept[2], k)] for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["q", "near", "id", "leaf"])

    found = kernels.in_tasks(filed.select("v", "first_id", "leaf"), run, "q long, near double, id long, leaf int").where("near > -1.5")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))
    true = found.withColumn("n", rank).where(F.col("n") <= k).select("q", "leaf").collect()  # k a sampled vector
    order = [{leaf: i + 1 for i, leaf in enumerate(w)} for w in tree.walks(rows, tree.leaves)]
    needed = sorted(order[r.q][r.leaf] for r in true)
    visits = 1
    while needed and np.searchsorted(needed, visits, "right") < target * len(needed):
        visits += 1
    return visits


def _cells(filed: DataFrame, cell: int) -> list[tuple[int, int]]:
    """For each leaf that holds classes, its first cell and how many it has."""
    counts = {r.leaf: r["count"] for r in filed.groupBy("leaf").count().collect()}  # a row a leaf of the tree
    out, at, room = {}, -1, 0
    for leaf in sorted(counts):
        n = counts[leaf]
        if n > cell:
            parts = -(-n // cell)
            out[leaf] = (at + 1, parts)
            at, room = at + parts, 0
        else:
            if n > room:
                at, room = at + 1, cell
            out[leaf], room = (at, 1), room - n
    return [out.get(leaf, (0, 0)) for leaf in range(max(out, default=-1) + 1)]


def _asking(asked: DataFrame, tree: Tree, dims: int, visits: int, cells: list[tuple[int, int]], copies: int) -> DataFrame:
    """A row for each query class and cell that it visits, with the leaves that it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in kernels.rows_at_once(b, AT_ONCE):
                ids = part.column("id").to_numpy()
                at, place, leaves = [], [], []
                for i, walk in enumerate(tree.walks(unit(matrix(part.column("v"), dims)), visits)):
                    mine: dict[int, list[int]] = {}
                    for leaf in walk:
                        first, n = cells[leaf] if leaf < len(cells) else (0, 0)
                        for c in range(first, first + n):
                            mine.setdefault(c, []).append(leaf)
                    at += [i] * len(mine)
                    place += [c * copies + int(ids[i]) % copies for c in mine]
                    leaves += mine.values()
                n = len(at)
                made = {"place": pa.array(place, pa.int64()), "asks": pa.array([True] * n), "id": part.column("id").take(pa.array(at, pa.int64())), "ids": pa.nulls(n, pa.list_(pa.int64())), "leaves": pa.array(leaves, pa.list_(pa.int32())), "v": part.column("v").take(pa.array(at, pa.int64()))}
                yield pa.RecordBatch.from_pydict(made)

    return kernels.in_tasks(asked, run, SHAPE)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Slices of the sorted rows that share place and asks."""
    for b in batches:
        if not b.num_rows:
            continue
        place, asks = b.column("place").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for first, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            yield int(place[first]), bool(asks[first]), b.slice(first, end - first)


def _scan(dims: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest classes of each query in each cell; a cell's classes come before its queries."""
    at, held = None, []
    ready = None
    for place, asks, rows in _runs(batches):
        if place != at:
            at, held, ready = place, [], None
        if not asks:
            held.append(rows)
        elif held:
            if ready is None:
                ids = np.concatenate([r.column("id").to_numpy() for r in held])
                x = np.concatenate([matrix(r.column("v"), dims) for r in held])
                leaf = np.concatenate([r.column("leaves").flatten().to_numpy() for r in held])
                known, leaf = np.unique(leaf, return_inverse=True)
                ready = ids, x, unit(x), np.sqrt((x * x).sum(1)), known, leaf, pa.concat_arrays([r.column("ids") for r in held])
            for part in kernels.rows_at_once(rows, AT_ONCE):
                yield _nearest(part, dims, k, *ready)


def _nearest(part: pa.RecordBatch, dims: int, k: int, ids: np.ndarray, x: np.ndarray, unit_x: np.ndarray, length: np.ndarray, known: np.ndarray, leaf: np.ndarray, copies: pa.Array) -> pa.RecordBatch:
    q = matrix(part.column("v"), dims)
    own = np.sqrt((q * q).sum(1))
    asked = part.column("leaves")
    visits = np.zeros((len(q), len(known)), bool)
    row = np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy(zero_copy_only=False))
    wanted = asked.flatten().to_numpy()
    spot = np.searchsorted(known, wanted).clip(max=len(known) - 1)
    there = known[spot] == wanted
    visits[row[there], spot[there]] = True
    near = unit(q) @ unit_x.T
    near[~visits[:, leaf]] = -np.inf
    least = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
    # the product's last bits depend on where a row stands, so what may be among the k best is computed alike
    a, b = np.nonzero((near >= (least - SLACK)[:, None]) & np.isfinite(near))
    score = np.zeros(len(a))
    for first in range(0, len(a), PAIRS):
        i, j = a[first : first + PAIRS], b[first : first + PAIRS]
        score[first : first + PAIRS] = (q[i] * x[j]).sum(1) / (own[i] * length[j])
    best = _best(a, score, ids[b], k)
    return pa.RecordBatch.from_arrays([part.column("id").take(pa.array(a[best])), pa.array(ids[b[best]]), copies.take(pa.array(b[best])), pa.array(score[best])], ["asked", "first_id", "ids", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, target: float = TARGET, sample: int = SAMPLE, cell: int = CELL, asking: int = ASKING) -> DataFrame:
    """query_id, rank (from 1), id and score (the cosine of the original vectors, in double
    precision) of the ``k`` nearest found of ``vectors`` (id, v) to each of ``queries`` (query_id,
    v), nearest first, ties to the smaller id; all of them, if there are fewer.

    A row with the query's own id is no hit. Vectors that are null, zero, or hold null or non-finite
    components take no part on either side, nor do null ids. Shorter vectors count as ending in
    zeros. Repeated rows count once, other columns are ignored, and empty tables give an empty
    result.
    """
    spark = vectors.sparkSession
    v = F.col("v").cast("array<double>").alias("v")
    sound = vectors.where(takes_part("v") & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), v)
    asked = queries.where(takes_part("v") & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), v).distinct()
    asked = store.spool(asked, "asked")
    classes = store.spool(_classes(sound, k + 1), "classes")  # the query itself may be among them
    n_classes, widest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(widest or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    one = store.spool(asked.groupBy("v").agg(F.min("query_id").alias("id")), "questions")
    n_asked = one.count()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not n_asked or not n_classes:
        return empty
    tree = _fit(classes, n_classes, dims, sample)
    filed = store.spool(_filed(classes, tree, dims), "filed")
    visits = calibrate(filed, n_classes, tree, dims, k, target)
    cells = _cells(filed, cell)
    copies = -(-n_asked // asking)
    table = store.small_table(spark, [(leaf, first, n) for leaf, (first, n) in enumerate(cells)], "leaf int, first int, n int")
    held = filed.join(F.broadcast(table), "leaf").withColumn("_cell", F.col("first") + F.pmod(F.xxhash64("first_id"), F.col("n")))
    held = held.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 1 else held.withColumn("_copy", F.lit(0))
    held = held.select((F.col("_cell") * copies + F.col("_copy")).cast("long").alias("place"), F.lit(False).alias("asks"), F.col("first_id").alias("id"), "ids", F.array("leaf").alias("leaves"), "v")
    rows = held.unionByName(_asking(one.select("id", "v"), tree, dims, visits, cells, copies))
    rows = rows.repartition("place").sortWithinPartitions("place", "asks", "id")
    found = kernels.in_tasks(rows, lambda batches: _scan(dims, k + 1, batches), "asked long, first_id long, ids array<long>, score double")
    # each class holds an id at least, so the k + 1 nearest ids lie in the k + 1 nearest classes
    nearest = Window.partitionBy("asked").orderBy(F.desc("score"), "first_id")
    best = store.spool(found.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1), "nearest")
    hits = best.groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("hits")).join(one.withColumnRenamed("id", "asked"), "asked")
    every = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct((-h["score"]).alias("far"), i.alias("id")))))
    mine = asked.join(hits.select("v", F.slice(F.array_sort(every), 1, 2 * k + 2).alias("hits")), "v")
    ranked = mine.select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.far")).alias("score"))
