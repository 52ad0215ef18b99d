"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents lie in blocks by a hash, which is the source's permutation. Its target fixes
how many blocks are drawn: all of them some times, and then the first ones once more, up to the
block at which the drawn words come nearest to the target. Those exact quotas are split among the
output shards by a tree: a node draws its left half's quotas from the multivariate hypergeometric
distribution and leaves the rest to its right half. Shards take consecutive, disjoint runs of each
source's drawn blocks, and shuffle their rows locally.

The driver holds a row a source and the tree's first SUBTREES nodes; tasks grow the rest, and the
drawn blocks are a table that documents are joined with. Sources are a vocabulary, not data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels, store
from millrace.llm.ranks import weighted_cuts

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
#: Words in a block, and in an output shard; shards and blocks of a source at least. A source misses
#: its target by half a block at most, or half of its largest document.
BLOCK_WORDS = 20_000
SHARD_WORDS = 2_000_000
LEAST_SHARDS = 16
LEAST_BLOCKS = 4096
#: Shards below which the driver splits no further, at most so many nodes.
SUBTREES = 1024
HASH_BITS = 62
#: Blocks that are drawn from at once, at most: numpy's distribution ends at 10**9.
AT_ONCE = 500_000_000

Node = tuple[int, int, np.ndarray, np.ndarray]


@dataclass
class Plan:
    """rows: a row a source, _source, source_no, source_size, target and _blocks. drawn: source_no,
    block and draws, an array of struct<copy, shard>, of each block that is drawn. quotas: the
    drawn blocks of each source, by source_no."""

    rows: DataFrame
    drawn: DataFrame
    quotas: list[int]
    n_shards: int
    seed: int


def words_of(text: str = "text") -> Column:
    """Number of words, runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares ``share`` times all sizes by weight; no target is above ``cap`` times its size, and
    what that leaves is shared again."""
    total, capped = share * sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        left = max(0.0, total - sum(cap * sizes[i] for i in capped))
        unit = left / sum(weights[i] for i in rest) if rest else 0.0
        over = {i for i in rest if unit * weights[i] > cap * sizes[i]}
        if not over:
            return [float(cap * sizes[i]) if i in capped else unit * weights[i] for i in range(len(sizes))]
        capped |= over


def drawn(own: np.ndarray, n: int, rng: np.random.Generator, at_once: int = AT_ONCE) -> np.ndarray:
    """How many of ``n`` blocks come from each source, of which there are ``own``. More than
    ``at_once`` are cut into strata of equal shares of every source, each of which gives its share
    of ``n``; so sums stay exact whatever their size."""
    strata = -(-sum(own.tolist()) // at_once) or 1
    share = lambda k, j: k * (j + 1) // strata - k * j // strata
    parts = [np.array([share(k, j) for k in own.tolist()], np.int64) for j in range(strata)]
    # a stratum's share of n may be more than it has only by rounding; what is left over goes on
    out, owed = np.zeros_like(own), 0
    for j, part in enumerate(parts):
        want = share(n, j) + owed
        take = min(want, int(part.sum()))
        out, owed = out + rng.multivariate_hypergeometric(part, take, method="marginals"), want - take
    return out


def children(node: Node, seed: int) -> tuple[Node, Node]:
    """The halves of a node: shards ``low`` to ``high``, the blocks drawn from each source, and
    where each source's run begins among its drawn blocks."""
    low, high, own, start = node
    mid = low + (high - low) // 2
    total = sum(own.tolist())
    left = drawn(own, total * (mid - low) // (high - low) if total > AT_ONCE else round(total * (mid - low) / (high - low)), np.random.default_rng([seed, low, high]))
    return (low, mid, left, start), (mid, high, own - left, start + left)


def grown(root: Node, seed: int, leaf: int = 1) -> list[Node]:
    """The nodes of ``leaf`` shards at most below ``root``, in the order of their shards."""
    done, todo = [], [root]
    while todo:
        node = todo.pop()
        if node[1] - node[0] <= leaf:
            done.append(node)
        else:
            todo += reversed(children(node, seed))
    return done


def split(blocks: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """The blocks of each shard (rows) and source (columns); columns add up to ``blocks``."""
    quotas = blocks.astype(np.int64)
    return np.array([own for *_, own, _ in grown((0, n_shards, quotas, np.zeros_like(quotas)), seed)])


def _permuted(seed: int) -> Column:
    return F.xxhash64("doc_id", F.lit(seed)).bitwiseAND((1 << HASH_BITS) - 1)


def _block(at: Column, blocks: Column) -> Column:
    """The hash's leading part picks the block."""
    return F.floor(blocks * (F.shiftright(at, HASH_BITS - 31) / F.lit(float(1 << 31)))).cast("long")


def _runs(spark, quotas: np.ndarray, n_shards: int, seed: int) -> DataFrame:
    """shard, source_no, start and n of each run of drawn blocks that isn't empty."""
    leaf = -(-n_shards // SUBTREES)
    tops = grown((0, n_shards, quotas, np.zeros_like(quotas)), seed, leaf)
    nodes = store.small_table(spark, [(low, high, own.tolist(), start.tolist()) for low, high, own, start in tops], "low int, high int, own array<long>, start array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for low, _, own, start in grown((row["low"], row["high"], np.array(row["own"], np.int64), np.array(row["start"], np.int64)), seed):
                    k = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), low), pa.int32()), pa.array(k, pa.int32()), pa.array(start[k]), pa.array(own[k])], ["shard", "source_no", "start", "n"])

    return kernels.in_tasks(nodes.repartition("low") if leaf > 1 else nodes, run, "shard int, source_no int, start long, n long")


def plan_mix(docs: DataFrame, size: str, seed: int = 1) -> Plan:
    """From doc_id, source and ``size`` of all documents: the targets (sources by code point, null
    last, weigh WEIGHTS in turn) and the blocks that each shard draws. ``docs`` is read three times
    or so, so it should be a narrow table."""
    spark = docs.sparkSession
    stats = docs.groupBy("source").agg(F.coalesce(F.sum(size), F.lit(0)).alias("size")).collect()
    stats.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in stats]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    passes = [min(CAP, int(g // s)) if s else 0 for g, s in zip(goal, sizes, strict=True)]
    rest = {i: g - p * s for i, (g, p, s) in enumerate(zip(goal, passes, sizes, strict=True)) if s and g > p * s}
    blocks = [max(LEAST_BLOCKS, -(-s // BLOCK_WORDS)) for s in sizes]
    rows = store.small_table(spark, [(r.source, i, sizes[i], goal[i], blocks[i]) for i, r in enumerate(stats)], "_source string, source_no int, source_size long, target double, _blocks long")
    cuts = {}
    if rest:
        kinds = docs.select(F.col("source").alias("_own"), _permuted(seed).alias("_at"), F.col(size).alias("weight")).join(rows, F.col("_own").eqNullSafe(F.col("_source")))
        cuts = weighted_cuts(kinds.select(F.col("source_no").alias("grp"), _block(F.col("_at"), F.col("_blocks")).alias("at"), "weight"), rest)
    quotas = np.array([p * b + min(b, cuts.get(i, 0)) for i, (p, b) in enumerate(zip(passes, blocks, strict=True))], np.int64)
    n_shards = max(LEAST_SHARDS, round(sum(goal) / SHARD_WORDS))
    runs = _runs(spark, quotas, n_shards, seed).join(rows.select("source_no", "_blocks"), "source_no")
    each = runs.select("source_no", "shard", "_blocks", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("_at"))
    draws = F.sort_array(F.collect_list(F.struct(F.expr("_at div _blocks").cast("int").alias("copy"), "shard")))
    drawn = each.groupBy("source_no", F.expr("_at % _blocks").alias("block")).agg(draws.alias("draws"))
    return Plan(rows, store.spool(drawn, "drawn"), quotas.tolist(), n_shards, seed)


RESULTS = ("source_size", "target", "copies", "copy", "shard", "place")


def placed(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` (doc_id, source and more) with source_size, target and draws: copy (from 0) and
    shard of each time that the shards draw the row's block; null if none does. Null sources are a
    source of their own. Rows that share a doc_id and a source are drawn alike. Columns of ``docs``
    that are named like a result of :func:`draw` are replaced."""
    own = docs.drop(*(c for c in (*RESULTS, "draws", "source_no", "block") if c in docs.columns)).withColumn("_at", _permuted(plan.seed))
    own = own.join(plan.rows, F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", _block(F.col("_at"), F.col("_blocks")))
    return own.join(plan.drawn, ["source_no", "block"], "left").drop("_source", "_blocks", "source_no", "block")


def draw(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` with source_size, target, copies, copy, shard and place (its order in the shard), a
    row for each copy, CAP at most.

    The sources' taken words differ from the targets by half a block's at most, or by half of a
    document's where blocks have one. Null text or one without words weighs nothing, but is drawn
    with its block. An empty table gives an empty one. See :func:`placed` for the other cases.
    """
    out = placed(docs, plan).withColumn("copies", F.size("draws")).withColumn("_draw", F.explode("draws"))
    out = out.withColumns({"copy": F.col("_draw.copy"), "shard": F.col("_draw.shard")})
    return out.withColumn("place", F.xxhash64(F.lit(plan.seed + 1), "_at", "copy")).drop("draws", "_draw", "_at")


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mixed documents: ``docs``' columns, shard and place; each shard is one partition's run
    of rows, shuffled. Texts are read once for their sizes and once to be moved. See :func:`draw`
    for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""
    sized = store.spool(docs.select("doc_id", "source", words_of().alias("_words")), "sizes")
    mine = {c: f"_own_{c}" for c in docs.columns if c in (*RESULTS, "draws", "source_no", "block")}
    drawn = draw(docs.withColumnsRenamed(mine), plan_mix(sized, "_words", seed))
    extra = [c for c in ("shard", "place") if c not in docs.columns]
    return drawn.repartition("shard").sortWithinPartitions("shard", "place").select(*(F.col(mine.get(c, c)).alias(c) for c in docs.columns), *extra)
