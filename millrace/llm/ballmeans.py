"""Exact k-means by balls. A cluster is the ball around its centroid that holds its members. A
centroid can win a member over only if it is a neighbour: at most twice the ball's radius away. And it
can win only members that are at least half as far from their own centroid as the two centroids are
from each other. So a ball's members split into a stable core, which no neighbour reaches, and
annuli, of which the nth is compared with the n nearest neighbours alone.

Vectors are whole numbers and every comparison is exact, so the clusters are those of comparing all
with all. A round is one pass over the table, which also adds up the next centroids, task by task;
only sums a cluster and task are shuffled, and a row a cluster comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm import kernels, store

#: Whole numbers of this size, and so many of them, keep four times a squared distance in 64 bits.
MOST, MOST_DIMS = 1 << 25, 512
#: Rows that a task compares at a time.
AT_ONCE = 8192
ROUND = "id long, x array<int>, cluster int, distance long, members long, sums array<long>"


@dataclass(frozen=True)
class Balls:
    """Centroids and, for each, its neighbours, the nearest first, with the squared distance to them.
    Without radii (before the first assignment) there are none, and all is compared."""

    centroids: np.ndarray
    neighbours: tuple[tuple[tuple[int, int], ...], ...] | None

    @classmethod
    def of(cls, centroids: list[list[int]], radii: list[int] | None) -> Balls:
        """``radii``: whole numbers that no member's distance exceeds; -1 for an empty ball."""
        c = np.array(centroids, np.int64).reshape(len(centroids), -1)
        if radii is None:
            return cls(c, None)
        apart = ((c[:, None] - c[None]) ** 2).sum(2).tolist()
        return cls(c, tuple(tuple(sorted((apart[i][j], j) for j in range(len(c)) if j != i and apart[i][j] <= 4 * r * r)) if r >= 0 else () for i, r in enumerate(radii)))

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, which was in the ball ``own``, and its squared distance;
        of equally near ones the smallest number."""
        if self.neighbours is None:
            best = np.full(len(x), np.iinfo(np.int64).max)
            to = np.zeros(len(x), np.int64)
            for j, c in enumerate(self.centroids):
                far = ((x - c) ** 2).sum(1)
                nearer = far < best
                best[nearer], to[nearer] = far[nearer], j
            return to, best
        to, best = own.copy(), ((x - self.centroids[own]) ** 2).sum(1)
        inner = best.copy()  # distance to the old ball's centre, which decides the annulus
        for i in np.unique(own).tolist():
            left = np.flatnonzero(own == i)
            for apart, j in self.neighbours[i]:
                left = left[4 * inner[left] >= apart]  # the core and the annuli that j can't reach are done
                if not len(left):
                    break
                far = ((x[left] - self.centroids[j]) ** 2).sum(1)
                won = (far < best[left]) | ((far == best[left]) & (j < to[left]))
                best[left[won]], to[left[won]] = far[won], j
        return to, best


def whole(vector: str, dims: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector has exactly ``dims`` components, none null or not finite, and its whole
    numbers floor(scale * x). One beyond MOST is an error, as distances would leave 64 bits."""
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} components, not {MOST_DIMS} at most")
    sound = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= MOST)
    made = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return F.coalesce(sound, F.lit(False)), F.when(wide, F.raise_error(F.lit(f"a component beyond {MOST} / {scale}")).cast("array<int>")).otherwise(made)


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _round(df: DataFrame, balls: Balls) -> DataFrame:
    """Rows with their cluster and distance, and among them (with members, and without x) the sum,
    number, largest and added distance of a cluster's rows in a task."""
    k, dims = balls.centroids.shape
    schema = StructType.fromDDL(ROUND)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for part in kernels.rows_at_once(b, AT_ONCE):
                x, own = _numbers(part.column("x"), dims), part.column("cluster").to_numpy().astype(np.int64)
                to, far = balls.assign(x, own)
                for j in np.unique(to).tolist():
                    sums[j] += x[to == j].sum(0)
                count += np.bincount(to, minlength=k)
                n = len(x)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("x"), pa.array(to, pa.int32()), pa.array(far), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names)
        some = np.flatnonzero(count)
        n = len(some)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(some, pa.int32()), pa.nulls(n, pa.int64()), pa.array(count[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names)

    return kernels.in_tasks(df.select("id", "x", "cluster"), run, schema)


def _sums(made: DataFrame) -> dict[int, tuple[int, dict[int, int]]]:
    """Number and componentwise sums of each cluster that has members: k times dims rows."""
    each = made.where("members is not null").select("cluster", "members", F.posexplode("sums").alias("at", "part"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in each.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"), F.sum("members").alias("n")).collect():
        out.setdefault(r.cluster, (r.n, {}))[1][r["at"]] = int(r["sum"])
    return out


def _radii(made: DataFrame, old: list[list[int]], new: list[list[int]]) -> list[int]:
    """No member is farther from the moved centroid than the old radius and the move together."""
    up = lambda square: math.isqrt(square) + (math.isqrt(square) ** 2 < square)
    far = {r.cluster: r.far for r in made.where("members is null").groupBy("cluster").agg(F.max("distance").alias("far")).collect()}
    return [up(far[j]) + up(sum((a - b) ** 2 for a, b in zip(old[j], new[j], strict=True))) if j in far else -1 for j in range(len(old))]


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The ``k`` rows of (id, x) whose ``seed``:id has the smallest sha256, in that order; ids that
    repeat follow each other by their vectors, rows without an id come last."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r.x for r in vectors.select(drawn.alias("drawn"), "x").orderBy(F.col("drawn").asc_nulls_last(), "x").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every row of ``vectors`` (id, x: whole numbers, all of one length),
    and the last centroids: after ``rounds`` rounds of assigning all rows to the nearest centroid and
    moving each centroid to the floor of its rows' mean, and an assignment to what came out.

    Fewer than ``k`` rows make fewer clusters; a centroid that loses all its rows stays. Repeated
    rows and ids count as often as they stand there, a null id too. An empty table gives no rows.
    """
    rows = store.spool(vectors.select(F.col("id").cast("long").alias("id"), "x", F.lit(0).alias("cluster")), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select("id", "cluster", F.lit(0).cast("long").alias("distance")), []
    radii = None
    for n in range(rounds + 1):
        made = store.spool(_round(rows, Balls.of(centroids, radii)), "round")
        rows = made.where("members is null")
        if n < rounds:
            moved = _sums(made)
            new = [[moved[j][1][a] // moved[j][0] for a in range(len(c))] if j in moved else c for j, c in enumerate(centroids)]
            radii, centroids = _radii(made, centroids, new), new
    return rows.select("id", "cluster", "distance"), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(df: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``df`` of :func:`cluster` with cluster_inertia, inertia and centroid_sha256: the sums of its
    cluster's and of all distances, and its centroid's digest. The sums are k rows."""
    spark = df.sparkSession
    sums = {r.cluster: r.sum for r in df.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    total = sum(sums.values())
    table = store.small_table(spark, [(j, sums.get(j, 0), total, digest(c)) for j, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return df.join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
