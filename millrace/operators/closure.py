"""Closures over parent-child rows: by doubled steps where each node has one parent or each one child,
and else by repeated joins of only the newest pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.scratch import new_folder, spool


def closure(edges: DataFrame, start: DataFrame, stop: tuple[str, ...] = ("0", "-1")) -> DataFrame:
    """root and node: every node of ``start`` (node) with all that it reaches over ``edges`` (child,
    parent), itself included. Ids compare as text, 8.0 as 8; ``stop`` values are no nodes; cycles end
    as no pair is visited twice."""
    tidy = lambda c: F.regexp_replace(F.trim(F.col(c).cast("string")), r"\.0+$", "")
    steps = edges.select(tidy("child").alias("node"), tidy("parent").alias("next")).where(~F.col("next").isin(*stop) & (F.col("next") != "") & (F.col("node") != F.col("next"))).distinct()
    roots = start.select(tidy("node").alias("root")).where(~F.col("root").isin(*stop)).distinct().withColumn("node", F.col("root"))
    steps = spool(steps)
    powers = _powers(steps) if any(steps.groupBy(c).count().where("count > 1").isEmpty() for c in ("node", "next")) else None
    return _by_rounds(steps, roots) if powers is None else _doubled(powers, roots)


def _powers(steps: DataFrame) -> list[DataFrame] | None:
    """Steps of length 1, 2, 4 and so on, each as (node, next), until there are none; None where a cycle
    goes on for ever. As ``steps`` has a node, or a next, only once, so have they all."""
    out, most = [steps], steps.count()
    while not out[-1].isEmpty():
        if 2 ** (len(out) - 1) > most:  # longer than any way without a cycle
            return None
        once = out[-1]
        out.append(spool(once.select("node", F.col("next").alias("_via")).join(once.select(F.col("node").alias("_via"), "next"), "_via").select("node", "next")))
    return out[:-1]


def _doubled(powers: list[DataFrame], roots: DataFrame) -> DataFrame:
    """All pairs less than 2, 4, 8 steps apart and so on. Without cycles there is one way from a root to
    a node, so no pair comes twice, and each is written once."""
    folder = new_folder(roots.sparkSession)
    roots.write.parquet(f"{folder}/round=0")
    read = roots.sparkSession.read.schema(roots.schema)
    for n, far in enumerate(powers, 1):
        near = read.parquet(*(f"{folder}/round={i}" for i in range(n)))
        near.join(far, "node").select("root", F.col("next").alias("node")).write.parquet(f"{folder}/round={n}")
    return read.parquet(*(f"{folder}/round={i}" for i in range(len(powers) + 1)))


def _by_rounds(steps: DataFrame, roots: DataFrame) -> DataFrame:
    folder = new_folder(roots.sparkSession)

    def round_of(df: DataFrame, n: int) -> DataFrame:
        """Writes a round's new pairs only: the loop's lineage ends there."""
        df.write.parquet(f"{folder}/round={n}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/round={n}")

    fresh = round_of(roots, 0)
    rounds = [fresh]
    while not fresh.isEmpty():
        met = fresh.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        # all rounds so far, read as one table
        seen = fresh.sparkSession.read.schema(fresh.schema).parquet(*(f"{folder}/round={n}" for n in range(len(rounds))))
        fresh = round_of(met.join(seen, ["root", "node"], "left_anti"), len(rounds))
        rounds.append(fresh)
    return fresh.sparkSession.read.schema(fresh.schema).parquet(*(f"{folder}/round={n}" for n in range(len(rounds))))


def rollup(reached: DataFrame, owned: DataFrame) -> DataFrame:
    """Number of distinct groups of each root: its own and those of all that it reaches. ``owned``:
    node and grp."""
    return reached.join(owned, "node").groupBy("root").agg(F.countDistinct("grp").alias("n_groups"))


def group_histograms(reached: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(how many roots reach each number of groups, how many roots reach each group)."""
    pairs = reached.join(owned, "node").select("root", "grp").distinct()
    per_root = pairs.groupBy("root").agg(F.count("*").alias("n_groups"))
    return per_root.groupBy("n_groups").agg(F.count("*").alias("roots")), pairs.groupBy("grp").agg(F.count("*").alias("roots"))
