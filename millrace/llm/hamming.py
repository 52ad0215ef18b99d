"""Exact top-k search among binary codes by incremental multi-index hashing.

A code is cut into segments of a few bits less than the number of codes has, so a value that a query
asks for is shared by FEW codes or so, each indexed by its value. Radius by radius, a query asks every
segment for the values at that distance from its own; whoever answers is verified by the full Hamming
distance. Once all m segments have been asked up to radius r, a code not yet seen differs by r + 1 or
more in each, so by m * (r + 1) in all: a query whose kth distance is less is finished, and only the
others go on. A code that is farther than a query's kth so far never leaves the join that verifies it.

Equal codes are one class, of which the k smallest ids are enough, so a very common code costs no
more than another.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import store

WORD = 64
#: Bits of a segment at least and at most; codes that share a segment's value, about; values of a
#: segment that a query's first round may ask for.
LEAST_WIDTH, MOST_WIDTH = 8, 16
FEW = 8
FIRST_ASKED = 200


def words_for(df: DataFrame, vector: str) -> int:
    """64-bit words that the signs of the longest ``vector`` of ``df`` take, 1 at least."""
    return max(1, -(-(df.agg(F.max(F.size(vector))).first()[0] or 0) // WORD))


def sign_code(vector: str, n_words: int = 1) -> Column:
    """array<long> of ``n_words`` words, a bit for each component that is greater than 0, the first
    in the lowest bit of the first word. Null, missing and short ones are 0 there. A vector that
    is longer than the words stops the query, as a code of its beginning would find wrong hits."""
    bit = lambda k: F.when(F.coalesce(F.get(vector, F.lit(k)), F.lit(0.0)) > 0, F.lit(1 << k % WORD if k % WORD < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = F.array(*(reduce(Column.bitwiseOR, (bit(w * WORD + k) for k in range(WORD))) for w in range(n_words)))
    longer = F.coalesce(F.size(vector), F.lit(0)) > n_words * WORD
    return F.when(longer, F.raise_error(F.lit(f"a vector has more than {n_words * WORD} components")).cast("array<long>")).otherwise(code)


class Layout:
    """The segments of codes of ``n_words`` words, about log2 of ``n_codes`` / FEW bits wide; none
    reaches over a word's end, so it is cut out of one. Wider ones would need radii at which the
    values to ask for outnumber the codes that they save."""

    def __init__(self, n_words: int, n_codes: int):
        width = min(MOST_WIDTH, max(LEAST_WIDTH, round(math.log2(n_codes / FEW + 1))))
        per_word = round(WORD / width)
        edges = [WORD * k // per_word for k in range(per_word + 1)]
        self.n_words = n_words
        #: word, first bit and width of each
        self.segments = [(w, a, b - a) for w in range(n_words) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.widest = max(n for *_, n in self.segments)

    def words(self, prefix: str) -> list[str]:
        return [f"{prefix}{w}" for w in range(self.n_words)]

    def value(self, prefix: str, k: int) -> Column:
        word, first, n = self.segments[k]
        return F.shiftrightunsigned(f"{prefix}{word}", first).bitwiseAND((1 << n) - 1).cast("int")

    def split(self, df: DataFrame, prefix: str) -> DataFrame:
        """``df`` with a row for each segment: segment, value and width."""
        rows = F.array(*(F.struct(F.lit(k).alias("segment"), self.value(prefix, k).alias("value"), F.lit(n).alias("width")) for k, (*_, n) in enumerate(self.segments)))
        return df.withColumn("_s", F.explode(rows)).select("*", "_s.segment", "_s.value", "_s.width").drop("_s")

    def distance(self) -> Column:
        """Of the words asked and the words code."""
        return reduce(add, (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(self.words("asked"), self.words("code"), strict=True)))

    def apart(self) -> Column:
        """The distance in each segment, as an array."""
        return F.array(*(F.bit_count(self.value("asked", k).bitwiseXOR(self.value("code", k))) for k in range(len(self.segments))))


def masks(width: int, radii: range) -> list[int]:
    """The differences of ``width`` bits at a distance in ``radii``."""
    return [sum(1 << b for b in bits) for radius in radii if radius <= width for bits in combinations(range(width), radius)]


def _answers(open_: DataFrame, index: DataFrame, layout: Layout, radii: range) -> DataFrame:
    """The classes whose nearest segment is at one of ``radii`` (of several, the first one answers)
    and that are within the query's bound."""
    widths = sorted({n for *_, n in layout.segments})
    every = reduce(lambda c, n: c.when(F.col("width") == n, F.from_json(F.lit(json.dumps(masks(n, radii))), "array<int>")), widths, F)
    asked = layout.split(open_, "asked").withColumn("mask", F.explode(every))
    asked = asked.select("query_id", *layout.words("asked"), "bound", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    # the planner can't see how many values a query asks for, so it must not broadcast them
    found = asked.hint("merge").join(index, ["segment", "value"]).withColumn("distance", layout.distance()).where(F.col("distance") <= F.col("bound"))
    nearest = (F.array_min("_far") >= radii.start) & (F.array_position("_far", F.array_min("_far")) == F.col("segment") + 1)
    return found.withColumn("_far", layout.apart()).where(nearest).select("query_id", *layout.words("asked"), *layout.words("code"), "first_id", "distance")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, same: bool = False, n_words: int = 1) -> DataFrame:
    """query_id, rank (from 1), id and distance of the ``k`` nearest of ``codes`` (id, code) to each
    of ``queries`` (query_id, code), by distance, then id; fewer if there are fewer. A code is a
    long, or an array of ``n_words`` longs.

    A row with the query's own id is a hit only with ``same``. Null codes and ids take no part.
    Repeated rows are hits of their own; repeated queries count once. Empty tables give an empty
    result. Other columns are ignored.
    """

    def parts(df: DataFrame, name: str, prefix: str) -> DataFrame:
        words = [F.col("code")] if df.schema["code"].dataType.typeName() != "array" else [F.get("code", F.lit(w)) for w in range(n_words)]
        return df.select(F.col(name), *(c.alias(f"{prefix}{w}") for w, c in enumerate(words))).dropna()

    code, asked = [f"code{w}" for w in range(n_words)], [f"asked{w}" for w in range(n_words)]
    own = Window.partitionBy(*code).orderBy("id")
    limit = k if same else k + 1  # the query itself may be among them
    held = parts(codes, "id", "code").withColumn("n", F.row_number().over(own)).where(F.col("n") <= limit).groupBy(*code).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    held = store.spool(held.withColumn("first_id", F.array_min("ids")), "codes")
    layout = Layout(n_words, held.count())
    n_segments = len(layout.segments)
    index = store.spool(layout.split(held.select(*code, "first_id"), "code").drop("width"), "segments")
    open_ = store.spool(parts(queries, "query_id", "asked").distinct().withColumn("bound", F.lit(WORD * n_words)), "queries")
    first = max(r for r in range(layout.widest + 1) if len(masks(layout.widest, range(r + 1))) <= FIRST_ASKED)
    best, done = None, []
    for radii in [range(first + 1), *(range(r, r + 1) for r in range(first + 1, layout.widest + 1))]:
        found = _answers(open_, index, layout, radii)
        if best is not None:
            found = found.unionByName(best.join(open_.select("query_id", *asked), ["query_id", *asked], "left_semi"))
        # each class holds an id at least, so the k nearest hits lie in the k nearest classes
        near = Window.partitionBy("query_id", *asked).orderBy("distance", "first_id")
        best = store.spool(found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= limit).drop("n"), "nearest")
        hits = best.join(held.select(*code, "ids"), code).select("query_id", *asked, "distance", F.explode("ids").alias("id"))
        hits = hits if same else hits.where("id <> query_id")
        ranked = Window.partitionBy("query_id", *asked).orderBy("distance", "id")
        hits = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        covered = n_segments * radii.stop
        kth = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(Window.partitionBy("query_id", *asked))
        hits = store.spool(hits.withColumn("kth", kth).withColumn("sure", F.coalesce(F.col("kth") < covered, F.lit(False)) | F.lit(radii.stop > layout.widest)), "hits")
        done.append(hits.where("sure").select("query_id", "rank", "id", "distance"))
        ends = hits.groupBy("query_id", *asked).agg(F.max("kth").alias("kth"), F.max("sure").alias("sure"))
        left = open_.join(ends, ["query_id", *asked], "left").where("not coalesce(sure, false)")
        open_ = store.spool(left.select("query_id", *asked, F.coalesce("kth", "bound").alias("bound")), "queries")
        if radii.stop > layout.widest or open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
