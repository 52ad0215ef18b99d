"""Sharding by a k-d tree over metadata.

A node is split along the dimension in which its rows reach widest, against the whole table's
extent, at the weighted median of a distributed histogram; a node of several shards gives each
side its share of the bytes. DataFrame functions only; the driver holds the tree, a row a node.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import store
from millrace.llm.ranks import weighted_cuts

#: The low bits of a coordinate spread rows of one value, so a hot value can be split anywhere.
TIE_BITS = 30
#: Rows in a chunk of a shard, within which rows are numbered by one task.
CHUNK_ROWS = 2000
#: Levels after which the rows' nodes are written, so lineage and joins stay short.
LEVELS = 3


@dataclass
class Tree:
    """levels: for each, node -> (dimension, cut, left child, right child); leaves: node -> shard."""

    dims: tuple[str, ...]
    levels: list[dict[int, tuple[int, int, int, int]]] = field(default_factory=list)
    leaves: dict[int, int] = field(default_factory=dict)


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of a text, none for null, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _coordinates(df: DataFrame, dims: tuple[str, ...], key: tuple[str, ...]) -> Column:
    """array<long>: numbers as they are, from 0 to 2**32 - 1, other values and null by their CRC, so
    the width of such a dimension is that of the CRCs of its values; the low bits are a hash of
    ``key``."""
    kinds = dict(df.dtypes)
    tie = F.xxhash64(*key).bitwiseAND((1 << TIE_BITS) - 1)

    def one(c: str) -> Column:
        number = kinds[c] in ("tinyint", "smallint", "int", "bigint")
        value = F.greatest(F.least(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit((1 << 32) - 1)), F.lit(0)) if number else F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.shiftleft(value, TIE_BITS).bitwiseOR(tie)

    return F.array(*(one(c) for c in dims))


def _descend(df: DataFrame, level: dict[int, tuple[int, int, int, int]]) -> DataFrame:
    """Moves rows of the level's nodes to their children; a join with a row a node."""
    splits = store.small_table(df.sparkSession, [(n, *x) for n, x in level.items()], "_node int, _dim int, _cut long, _left int, _right int")
    side = F.when(F.get("_at", F.col("_dim")) < F.col("_cut"), F.col("_left")).otherwise(F.col("_right"))
    return df.join(splits, "_node", "left").withColumn("_node", F.when(F.col("_dim").isNull(), F.col("_node")).otherwise(side)).drop("_dim", "_cut", "_left", "_right")


def build_tree(df: DataFrame, dims: tuple[str, ...], key: tuple[str, ...], size: str, n_shards: int | None = None, target_bytes: int | None = None) -> Tree:
    """A tree with ``n_shards`` leaves, or as many as leave ``target_bytes`` to each at most on
    average. An empty table, or one shard, gives the tree of one leaf."""
    rows = store.spool(df.select(_coordinates(df, dims, key).alias("_at"), F.col(size).alias("_size"), F.lit(1).alias("_node")), "kd")
    ends = [f(F.get("_at", F.lit(k))).alias(f"{f.__name__}{k}") for k in range(len(dims)) for f in (F.min, F.max)]
    if n_shards is None:
        n_shards = max(1, -(-(rows.agg(F.sum("_size")).first()[0] or 0) // target_bytes))
    tree, weigh, nodes, fresh = Tree(dims), {}, {1: n_shards}, 2
    root: list[int] = []
    while any(k > 1 for k in nodes.values()):
        wide = rows.groupBy("_node").agg(F.sum("_size").alias("bytes"), *ends).collect()
        extents = {r["_node"]: [(r[f"max{k}"] or 0) - (r[f"min{k}"] or 0) for k in range(len(dims))] for r in wide}
        weigh = {r["_node"]: r.bytes for r in wide}
        root = root or extents.get(1, [0] * len(dims))
        dim = {n: max(range(len(dims)), key=lambda k: (extents.get(n, root)[k] / max(1, root[k]), -k)) for n, k in nodes.items() if k > 1}
        pick = store.small_table(df.sparkSession, list(dim.items()), "_node int, _dim int")
        split = rows.join(pick, "_node").select(F.col("_node").alias("grp"), F.get("_at", F.col("_dim")).alias("at"), F.col("_size").alias("weight"))
        cuts = weighted_cuts(split, {n: weigh.get(n, 0) * (nodes[n] // 2) / nodes[n] for n in dim})
        level = {}
        for n in sorted(dim):
            level[n] = (dim[n], cuts[n], fresh, fresh + 1)
            nodes[fresh], nodes[fresh + 1] = nodes[n] // 2, nodes[n] - nodes[n] // 2
            del nodes[n]
            fresh += 2
        tree.levels.append(level)
        rows = _descend(rows, level)
        if len(tree.levels) % LEVELS == 0:
            rows = store.spool(rows, "kd")

    def leaves(n: int) -> list[int]:
        for level in tree.levels:
            if n in level:
                return leaves(level[n][2]) + leaves(level[n][3])
        return [n]

    tree.leaves = {n: i for i, n in enumerate(leaves(1))}
    return tree


def assign(df: DataFrame, tree: Tree, key: tuple[str, ...]) -> DataFrame:
    """``df`` with the column ``shard``: a pass without a shuffle. Nulls and other values count as
    they did for the tree; rows that are equal in a dimension and in ``key`` go together. A column
    named shard, _at or _node is replaced."""
    out = df.drop("shard", "_node").withColumn("_at", _coordinates(df, tree.dims, key)).withColumn("_node", F.lit(1))
    for level in tree.levels:
        out = _descend(out, level)
    shards = store.small_table(df.sparkSession, list(tree.leaves.items()), "_node int, shard int")
    return out.join(shards, "_node").drop("_at", "_node")


def slots(df: DataFrame, n_rows: int, n_shards: int, key: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (with shard) with the column ``slot``, gapless from 0 in each shard. Rows are numbered
    in chunks of a shard, and the chunks' counts are summed up. Rows that are equal in ``key`` and
    ``ties`` are numbered in any order; a hot key is one chunk's rows. Columns named _chunk, _own,
    _n and _start are replaced."""
    chunks = max(1, n_rows // (n_shards * CHUNK_ROWS))
    rows = df.withColumn("_chunk", F.pmod(F.xxhash64(key, *ties), F.lit(chunks)).cast("int"))
    counts = rows.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("shard", "_chunk").orderBy(key, *ties)
    return rows.withColumn("_own", F.row_number().over(own)).join(starts, ["shard", "_chunk"]).withColumn("slot", (F.col("_start") + F.col("_own") - 1).cast("long")).drop("_chunk", "_own", "_start")


def shard_documents(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang", "size"), n_shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of ``docs``; shards of near equal bytes.

    dims may name columns of ``docs`` or ``size``. Sizes differ from the mean by about the rows at
    the cuts, however hot a value is, as ties are split by a hash of doc_id and text; only rows that
    share both stay together. So groups of equal texts are no unit: a large one is dealt over several
    shards like other rows, as near equal sizes ask for. Null text: size 1 and the CRC of no bytes. Null metadata
    counts as '' or 0. Repeated rows each get a slot. An empty table gives an empty one. A column
    of ``docs`` that is named like a result is only used if ``dims`` names it.
    """
    own = [c for c in dims if c != "size"]
    rows = store.spool(docs.select("doc_id", *own, size_of().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")), "sizes")
    key = ("doc_id", "text_crc32")
    tree = build_tree(rows, dims, key, "size", n_shards, target_bytes)
    placed = assign(rows, tree, key).select("doc_id", "size", "text_crc32", "shard")
    return slots(placed, rows.count(), len(tree.leaves), "doc_id", ("text_crc32",))


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("source", "lang"), target_bytes: int = 1 << 30) -> DataFrame:
    """Writes ``docs`` as Parquet, a folder for each shard of about ``target_bytes`` of text, and
    returns it as read back, with the column shard. Nulls, ties and repeated rows are as in
    :func:`shard_documents`; a text longer than the target is a shard's row as any other; an empty
    table writes one empty shard's schema. A column of ``docs`` named shard is replaced."""
    sized = docs.drop("shard").withColumns({"_size": size_of(), "_crc": F.crc32(F.coalesce("text", F.lit("")))})
    key = ("doc_id", "_crc")
    tree = build_tree(sized, dims, key, "_size", None, target_bytes)
    assign(sized, tree, key).drop("_size", "_crc").repartition("shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(docs.drop("shard").withColumn("shard", F.lit(0)).schema).parquet(path)
