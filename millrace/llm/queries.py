"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ballmeans, bpe, fingerprint, hamming, infill, langid, licenses, mixing, nearest, neardup, pii, sharding, store, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken adds up what the shards draw of a document; shards lists where to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_of().alias("size"))
    sized = store.spool(docs, "sizes")
    placed = mixing.placed(sized, mixing.plan_mix(sized, "size"))
    shards = F.coalesce(F.col("draws.shard"), F.array().cast("array<int>"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size(shards)).cast("long").alias("taken"), shards.alias("shards"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["first_word"])
    sure = F.filter("spans", lambda x: x["covered"] >= licenses.COVERED)

    def joined(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(sure).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["covered"])), F.lit(0.0)).alias("score"),
    )


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), similarity=85)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_dir(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (5 * (k // 4) + 1)::INT, 5))::INT >> (5 * (3 - k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


def op8_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors, by the signs of all components."""
    vectors = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    n_words = hamming.words_for(vectors, "embedding")
    codes = vectors.select(F.col("vec_id").alias("id"), hamming.sign_code("embedding", n_words).alias("code"))
    return hamming.top_k(codes, codes.where("id % 100 = 0").withColumnRenamed("id", "query_id"), k=10, n_words=n_words)


OP8_SQL = """
WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id,
    list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: ((p[1] > 0) <> (p[2] > 0))::INT))::INT AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM d)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
"""


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of edited texts are compared with their own document's alone, byte by byte, so
    only those of whole documents can need numbers that tell colliding forms apart."""
    docs = _table(spark, sf_dir, "documents")
    made = fingerprint.edits(docs)
    apart = fingerprint.collisions(docs, made, "text")
    out = made.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
    if apart.isEmpty():
        return out
    return out.drop("fingerprint").join(fingerprint.fingerprints(docs), "doc_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(count(k) for k in pii.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors, by cosine."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = nearest.search(vectors, vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id"), k=5)
    return found.withColumnRenamed("id", "vec_id")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infill(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = F.sha2(infill.restore("output", "form"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), restored.alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(x, k, 8))::BIGINT) AS h FROM d),
n AS (SELECT *, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
    WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(list_filter(u, lambda s, i: i <= a), '') AS pre, array_to_string(list_filter(u, lambda s, i: i > a AND i <= b), '') AS mid,
  array_to_string(list_filter(u, lambda s, i: i > b), '') AS suf FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound, numbers = ballmeans.whole("embedding", 64, 64)
    vectors = _table(spark, sf_dir, "embeddings").where(sound).select(F.col("vec_id").alias("id"), numbers.alias("x"))
    return ballmeans.with_inertia(*ballmeans.cluster(vectors, k=16, rounds=3)).withColumnRenamed("id", "vec_id")


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    """Each round compares all with all."""
    steps = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c FROM kept QUALIFY k < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS (SELECT vec_id, x, min({k} * d + k) // {k} AS d, min({k} * d + k) % {k} AS k FROM (SELECT vec_id, x, k, "
            f"list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{n}) GROUP BY vec_id, x)"
        )
        steps.append(
            f"m{n} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (SELECT k, pos, sum(v) AS s, count(*) AS n "
            f"FROM (SELECT k, unnest(x) AS v, unnest(range(64)) AS pos FROM a{n}) GROUP BY k, pos) GROUP BY k)"
        )
        steps.append(f"c{n + 1} AS (SELECT c{n}.k, coalesce(m{n}.c, c{n}.c)::BIGINT[] AS c FROM c{n} LEFT JOIN m{n} USING (k))")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, "
        f"(sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_neardup": op4_neardup,
    "op5_bpe": op5_bpe,
    "op6_langid": op6_langid,
    "op7_warc": op7_warc,
    "op8_hamming": op8_hamming,
    "op9_fingerprint": op9_fingerprint,
    "op10_pii": op10_pii,
    "op11_nearest": op11_nearest,
    "op12_infill": op12_infill,
    "op13_clusters": op13_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": OP7_SQL,
    "op8_hamming": OP8_SQL,
    "op12_infill": OP12_SQL,
    "op13_clusters": _op13_sql(),
}
