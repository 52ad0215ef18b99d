"""Distributed weighted quantiles, one a group, by refining histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import store

#: Bins a group and round; a round narrows the range to one bin's own smallest and largest value.
BINS = 1024


def weighted_cuts(df: DataFrame, targets: dict[int, float]) -> dict[int, int]:
    """For each group in ``targets``, the value below which its rows weigh as near to its target
    as can be.

    ``df`` has grp (int), at (long, not negative) and weight (long, not negative). A round is one
    aggregation to BINS rows a group at most, of which the one with the target comes to the driver.
    Rows that share a value stay together; ties between two values go to the lower.
    """
    spark = df.sparkSession
    ranges = df.groupBy("grp").agg(F.min("at").alias("low"), F.max("at").alias("high")).collect()
    open_ = {r.grp: (r.low, r.high, 0.0) for r in ranges if r.grp in targets}
    cuts = {g: 0 for g in targets}
    while open_:
        state = store.small_table(spark, [(g, low, high, before, float(targets[g])) for g, (low, high, before) in open_.items()], "grp int, low long, high long, before double, target double")
        binned = df.join(state, "grp").where("at between low and high").groupBy("grp", "low", "before", "target", F.expr("(at - low) div ((high - low) div %d + 1)" % BINS).alias("bin")).agg(F.sum("weight").alias("own"), F.min("at").alias("first"), F.max("at").alias("last"))
        so_far = Window.partitionBy("grp").orderBy("bin")
        run = binned.withColumn("until", F.col("before") + F.sum("own").over(so_far))
        # the first bin that reaches the target, or else the last one
        ranked = run.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy((F.col("until") < F.col("target")).cast("int"), F.when(F.col("until") < F.col("target"), -F.col("bin")).otherwise(F.col("bin")))))
        for r in ranked.where("n = 1").collect():
            if r["first"] == r["last"]:
                left = r.until - r.own
                cuts[r.grp] = r["first"] if targets[r.grp] - left <= r.until - targets[r.grp] else r["last"] + 1
                del open_[r.grp]
            else:
                open_[r.grp] = (r["first"], r["last"], r.until - r.own)
    return cuts
