"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte 2- and 3-grams (A-Z lower-cased).
The model learns on the driver, by stochastic gradient descent, from a bounded sample of labelled
rows that tasks have already reduced to bucket counts. For prediction the embeddings and the
softmax weights fold into one score per bucket and language, so a text costs two table look-ups
a byte and language.

A softmax is sure of some language even where it knows none. So a text is rejected for either of
two reasons: the calibrated probability of its language is low, or few of its n-grams are ones that
the model has learned from. Both bounds are quantiles of rows that neither the weights nor the
temperature have seen, widened by a factor, so each rejects REJECT_RATE of texts like those at most.
A text in two known languages is a known one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernels, store

UNKNOWN = "und"
GRAMS = (2, 3)
BITS = 15
#: Labelled rows a language to learn from at most: three fifths for the weights, a fifth for the
#: temperature, a fifth for the bounds. Languages at most. So many times as many rows as are wanted
#: are looked at in the first place, so that there are enough of them.
ROWS_PER_LANGUAGE = 1000
MOST_LANGUAGES = 1000
SPARE = 1.5
#: Share of texts in known languages that each bound may reject, and the factor by which the odds of
#: the probability fall, and the share of unknown n-grams grows, from that quantile to the bound: a
#: quantile of some hundred rows is itself uncertain.
REJECT_RATE = 0.001
SLACK = 2.0
#: Rows with an n-gram's bucket from which on it is a known one.
SEEN = 2


@dataclass(frozen=True)
class Model:
    """languages: the learned values in order; table: score of each language and bucket; bias: of
    each language; temperature: of the calibrated softmax; known: whether each bucket is known;
    least and least_known: the probability, and the share of known n-grams, to accept."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    known: np.ndarray
    least: float
    least_known: float


def _buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size, the bucket of the n-gram that starts at each byte."""
    x, out = kernels.LOWER[data].astype(np.uint32), []
    gram = x
    for k, n in enumerate(range(2, max(GRAMS) + 1)):
        gram = (gram[:-1] << np.uint32(8)) | x[n - 1 :] if len(gram) else gram
        if n in GRAMS:
            out.append(((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(GRAMS.index(n) << BITS))
    return out


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    low = data | np.uint8(32)
    sums = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            data, offsets = kernels.texts(part.column("text"))
            grams, ids, counts = _buckets(data), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(GRAMS, grams, strict=True)])
                i, c = np.unique(own, return_counts=True)
                ids.append(i.astype(np.int32).tobytes())
                counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "key", "ids", "counts"])


def _drawn(known: DataFrame, below: dict[str, int], rows: int) -> list:
    """Of each language in ``below``, the ``rows`` rows with the smallest keys under its bound, as
    bucket counts; no more than those are shuffled or come to the driver from a task."""
    # a row a language, as the model on the driver has; so the texts needn't move to be drawn
    share = F.broadcast(store.small_table(known.sparkSession, list(below.items()), "lang string, below long"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    own = known.join(share, "lang").where("key < below").withColumn("_n", first).where(F.col("_n") <= rows)
    return kernels.in_tasks(own.select("text", "lang", "key"), _reduced, "lang string, key long, ids binary, counts binary").collect()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_PER_LANGUAGE, dim: int = 16, epochs: int = 8, rate: float = 20.0, seed: int = 7) -> Model:
    """Learns from ``rows`` rows a language at most, those with the smallest hashes of ``key`` and
    text, or all, if there are fewer; so ids may be null or shared. Rows without a text or a
    language are not used; without any, the model knows no language. Repeated rows count as often
    as they stand there. More than MOST_LANGUAGES values of ``lang`` are an error: that is no
    language column."""
    spark = labelled.sparkSession
    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(key).cast("string"), text, F.lit(seed)), F.lit(1 << 31)).alias("key")).where("text is not null and lang is not null")
    counts = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} values")
    if not counts:
        return Model((), np.zeros((0, len(GRAMS) << BITS), np.float32), np.zeros(0), 1.0, np.zeros(len(GRAMS) << BITS, bool), 0.0, 0.0)
    drawn = _drawn(known, {k: min(1 << 31, int((1 << 31) * SPARE * rows / n)) for k, n in counts.items()}, rows)
    if few := {k: 1 << 31 for k, n in counts.items() if sum(r.lang == k for r in drawn) < min(n, rows)}:  # copies share a hash
        drawn = [r for r in drawn if r.lang not in few] + _drawn(known, few, rows)
    drawn.sort(key=lambda r: (r.key, r.lang, bytes(r.ids), bytes(r.counts)))

    languages = tuple(sorted(counts))
    rng, width = np.random.default_rng(seed), len(GRAMS) << BITS
    embed = rng.uniform(-1, 1, (width, dim)) / dim
    weights, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    cases = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.int32), languages.index(r.lang)) for r in drawn if r.ids]
    cases = [(ids, n / n.sum(), own) for ids, n, own in cases]
    fit, warm, held = [c for i, c in enumerate(cases) if i % 5 > 1], cases[::5], cases[1::5]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            ids, shares, own = fit[i]
            mean = shares @ embed[ids]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[own] -= 1
            back = weights @ p
            weights -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.001 * p
            embed[ids] -= step * np.outer(shares, back)
    seen = np.zeros(width, np.int64)
    for ids, *_ in fit:
        seen[ids] += 1

    def logits_of(part: list) -> np.ndarray:
        return np.array([s @ embed[i] @ weights + bias for i, s, _ in part]).reshape(-1, len(languages))

    own, raw = np.array([c[2] for c in warm], int), logits_of(warm)
    doubt = 1 / (len(warm) + 2)  # of any label, else separable rows would be fitted by certainty

    def loss(t: float) -> float:
        p = np.clip(_softmax(raw / t)[np.arange(len(own)), own], 1e-12, 1 - 1e-12)
        return float(-((1 - doubt) * np.log(p) + doubt * np.log1p(-p)).sum())

    temperature = min((0.01 * 1.25**k for k in range(41)), key=loss) if warm else 1.0
    least = least_known = 0.0
    if held:
        p = float(np.quantile(_softmax(logits_of(held) / temperature).max(1), REJECT_RATE, method="lower"))
        least = p / (p + SLACK * (1 - p))
        least_known = 1 - SLACK * (1 - float(np.quantile([s @ (seen[i] >= SEEN) for i, s, _ in held], REJECT_RATE, method="lower")))
    return Model(languages, np.ascontiguousarray((embed @ weights).T.astype(np.float32)), bias, float(temperature), seen >= SEEN, least, least_known)


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probability of each language for each text, and its share of known n-grams."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    n_grams, known = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for n, gram in zip(GRAMS, _buckets(data), strict=True):
        a = np.minimum(offsets[:-1], len(gram))
        b = np.maximum(a, np.minimum(offsets[1:] - n + 1, len(gram)))
        n_grams += b - a
        for k, values in enumerate((model.known, *model.table)):
            sums = np.concatenate([[0.0], np.cumsum(values.take(gram), dtype=np.float64)])
            own = sums[b] - sums[a]
            if k:
                total[:, k - 1] += own
            else:
                known += own
    n_grams = np.maximum(n_grams, 1)
    return _softmax((total / n_grams[:, None] + model.bias) / model.temperature), known / n_grams


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred, score (0 to 1) and rejected, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text under a model
    that knows no language; both are rejected, and so is a text whose calibrated score is under
    ``model.least`` or whose share of known n-grams is under ``model.least_known``. A text of one
    byte has no n-gram and is judged by the bias alone. Ties go to the first language. Texts of
    any length are read whole. Repeated rows get a result each; an empty table gives an empty one;
    other columns are dropped, so none can clash.
    """
    schema = store.widened(df, keep, "lang_pred string, score double, rejected boolean")

    # a kept text travels once
    own, sent = (text, ()) if text in keep else ("_text", (F.col(text).alias("_text"),))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, own):
                data, offsets = kernels.texts(part.column(own))
                if model.languages:
                    (p, known), sure = _scores(model, data, offsets), _letters(data, offsets)
                    best = p.argmax(1)
                    score = np.where(sure, p[np.arange(len(p)), best], 0.0)
                    names = [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
                    out = ~sure | (score < model.least) | (known < model.least_known) & (np.diff(offsets) > 1)
                else:
                    names, score, out = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score), pa.array(out)], schema.names)

    return kernels.in_tasks(df.select(*keep, *sent), run, schema)


def held_out(key: str = "doc_id") -> Column:
    """The fifth of the documents that nothing is learned from; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose language is rejected, null texts and those without letters
    among them; all columns stay, whatever their names. See :func:`predict` for the other cases."""
    names = tuple(f"_{i}" for i in range(len(docs.columns)))  # none of them clashes with the result's
    found = predict(docs.toDF(*names), model, names[docs.columns.index("text")], names)
    return found.where("not rejected").select(*names).toDF(*docs.columns)
