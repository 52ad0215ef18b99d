"""A corpus pipeline over ``documents``: language ID, near-duplicates, personal data, mixing and
tokens. Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.

Null and empty texts go with the first stage, which knows no language for them; a later stage that
is given some leaves them as they are. Texts of any length are worked on whole. Repeated rows count
as rows until near_dedup keeps one of them. An empty table gives an empty one. All stages but the
last keep every column, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, mixing, neardup, pii, store

#: Percent of the shared five-word shingles from which on the corpus holds one of two documents.
SIMILARITY = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier, trained on their own labels, accepts."""
    return langid.keep_known(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs, SIMILARITY)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in the mix's order within a shard."""
    return mixing.mix(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them, a row for each drawn copy."""
    coded = bpe.encode_documents(docs, keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Language models, sketches and merges are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
