"""Nearest neighbours and clusters against brute force, fill-in-the-middle against its definition,
and the cases that sampling, archives and mixing got wrong before."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ballmeans, hamming, infill, langid, mixing, nearest, queries, store, warc

VECTORS = "vec_id long, embedding array<float>, score string, cluster string"


@pytest.fixture
def put(spark, tmp_path):
    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def cloud(n, dims=64, groups=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return (centres[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, dims))).astype(np.float32)


ODD = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [1.0, None] + [0.0] * 62]


def vectors_frame(spark, rows, first_id=0):
    return spark.createDataFrame([(first_id + i if not isinstance(r, tuple) else r[0], (r[1] if isinstance(r, tuple) else r), "clash", "clash") for i, r in enumerate(rows)], VECTORS)


def true_neighbours(ids, v, k, asked):
    out = {}
    length = np.sqrt((v * v).sum(1))
    for q in asked:
        i = ids.index(q)
        s = (v * v[i]).sum(1) / (length * length[i])
        out[q] = [(ids[j], s[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


# Nearest neighbours.


def test_nearest_recall_and_exact_scores(spark, put):
    v = cloud(3000)
    got = queries.op11_nearest(spark, put(vectors_frame(spark, v.tolist() + ODD), "embeddings")).collect()
    want = true_neighbours(list(range(3000)), v.astype(float), 5, range(0, 3000, 50))
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want) and all([r.rank for r in x] == [1, 2, 3, 4, 5] for x in by.values())
    hits = 0
    for q, found in by.items():
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {i for i, _ in want[q]})
        for r in found:
            a, b = v[q].astype(float), v[r.vec_id].astype(float)
            assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-14
    assert hits >= 0.9 * 5 * len(want)


def test_nearest_is_exact_when_all_leaves_are_visited(spark):
    v = cloud(700, dims=8, seed=3)
    v[100:400] = v[7]  # copies, scaled copies
    v[400:450] = v[8] * np.float32(2) ** np.arange(-25, 25, dtype=np.float32)[:, None]
    vectors = vectors_frame(spark, v.tolist()).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vectors.where("id % 10 = 0 or id in (7, 8, 401)").withColumnRenamed("id", "query_id")
    # small cells and copies of them, so a leaf has several and queries meet in different ones
    got = nearest.search(vectors, asked, k=6, target=1.0, sample=300, cell=16, asking=5).collect()
    want = true_neighbours(list(range(700)), v.astype(float), 6, [r.query_id for r in asked.collect()])
    sure = {q for q in want if True}
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.id, r.score))
    assert set(found) == sure
    # calibration on a sample holds all of its neighbours, so nearly all of the others' too
    same = sum([i for i, _ in found[q]] == [i for i, _ in want[q]] for q in want)
    assert same >= 0.95 * len(want)
    assert [i for i, _ in found[7]] == [100, 101, 102, 103, 104, 105] and [i for i, _ in found[100]][0] == 7
    assert [i for i, _ in found[8]] == [400, 401, 402, 403, 404, 405]


def test_nearest_odd_tables(spark):
    two = vectors_frame(spark, [(0, [1.0, 0.0]), (1, [1.0]), (2, [0.0, 2.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = two.withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in nearest.search(two, asked, k=5).collect()}
    # one component counts as two, the second of which is 0
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 0.0), (1, 1): (0, 1.0), (1, 2): (2, 0.0), (2, 1): (0, 0.0), (2, 2): (1, 0.0)}
    assert nearest.search(two.limit(0), asked).count() == 0 and nearest.search(two, asked.limit(0)).count() == 0
    assert nearest.search(two.where("id = 2"), asked.where("query_id = 2")).count() == 0


def test_tree_files_rows_under_their_own_leaf_and_walks_all():
    rows = nearest.unit(cloud(2000, dims=16).astype(float))
    tree = nearest.Tree(rows, branch=4, leaf=40)
    leaf = tree.file(rows)
    assert tree.leaves > 20 and set(leaf.tolist()) == set(range(tree.leaves)) and np.bincount(leaf).max() <= 40
    for walk in tree.walks(rows[:20], tree.leaves):
        assert sorted(walk) == list(range(tree.leaves))
    first = [w[0] for w in tree.walks(rows, 1)]
    assert np.mean(np.array(first) == leaf) > 0.6
    assert nearest.Tree(np.ones((500, 3)), leaf=40).leaves == 1  # equal rows can't be split


# Clusters.


def lloyd(ids, x, k=16, rounds=3):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), x[i].tolist()))[:k]
    c = [x[i].tolist() for i in order]
    for n in range(rounds + 1):
        d = np.array([((x - np.array(m)) ** 2).sum(1) for m in c])
        to = d.argmin(0)
        if n < rounds:
            c = [[int(s) // int((to == j).sum()) for s in x[to == j].sum(0)] if (to == j).any() else c[j] for j in range(len(c))]
    return to, d.min(0), c


@pytest.mark.parametrize("spread", [1.0, 40.0])
def test_clusters_are_those_of_lloyd(spark, put, spread):
    v = cloud(900, seed=4) * np.float32(spread)
    v[300:600] = v[5]
    got = {r.vec_id: r for r in queries.op13_clusters(spark, put(vectors_frame(spark, v.tolist() + [*ODD, [1.0] * 63, [1.0] * 65]), "embeddings")).collect()}
    x = np.floor(64 * v.astype(float)).astype(np.int64)
    zero = len(v) + 2  # the zero vector is one like any other here
    ids, x = [*range(900), zero], np.vstack([x, np.zeros((1, 64), np.int64)])
    to, far, c = lloyd(ids, x)
    assert set(got) == set(ids)
    for i, j, d in zip(ids, to.tolist(), far.tolist(), strict=True):
        assert (got[i].cluster, got[i].distance, got[i].cluster_inertia, got[i].inertia) == (j, d, far[to == j].sum(), far.sum())
        assert got[i].centroid_sha256 == hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()


def test_balls_compare_no_more_than_they_need():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(-3, 4, (200, 5)) + 100 * np.array(m) for m in ((0, 0, 0, 0, 0), (1, 0, 0, 0, 0), (0, 9, 0, 0, 0))])
    c = [[0, 0, 0, 0, 0], [100, 0, 0, 0, 0], [0, 900, 0, 0, 0]]
    own = np.repeat([0, 1, 2], 200)
    balls = ballmeans.Balls.of(c, [60, 60, 60])
    assert [[j for _, j in n] for n in balls.neighbours] == [[1], [0], []]  # 900 away is no neighbour
    for centroids in (c, [[0] * 5, [4, 0, 0, 0, 0], [4, 0, 0, 0, 0]]):  # ties go to the smaller number
        radius = [int(np.ceil(np.sqrt(((x[own == j] - centroids[j]) ** 2).sum(1).max()))) for j in range(3)]
        to, far = ballmeans.Balls.of(centroids, radius).assign(x, own)
        all_ = np.array([((x - np.array(m)) ** 2).sum(1) for m in centroids])
        assert (to == all_.argmin(0)).all() and (far == all_.min(0)).all()


def test_clusters_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, x array<int>")
    found, centroids = ballmeans.cluster(make([(1, [0]), (2, [10]), (None, [11]), (2, [10])]), k=2, rounds=2)
    assert sorted((r.id or 0, r.distance) for r in found.collect()) == [(0, 1), (1, 0), (2, 0), (2, 0)] and sorted(centroids) == [[0], [10]]
    assert ballmeans.with_inertia(*ballmeans.cluster(make([]), k=2)).count() == 0
    wide = vectors_frame(spark, [[1e7] + [0.0] * 63])
    with pytest.raises(Exception, match="beyond"):
        wide.select(ballmeans.whole("embedding", 64, 64)[1]).collect()


# Fill in the middle.


def fim(doc_id, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, len(u), "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h[3] % 100 < 80
    return (doc_id, len(u), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_infill_of_odd_texts(spark, put):
    rng = random.Random(3)
    texts = [None, "", " ", "\n \t", "one", " one", "one ", "a<P>b", "<S", "<", "M>", "é \U0001f600\U0001f601 x  ", "x" * 50_000, "word " * 40_000, "\x0b\x0c a\x1c b c", "  a"]
    texts += ["".join(rng.choice("ab <>PSM\n\U0001f600") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one two three"), (3, "one two three"), (None, "a b c d"), (-7, "a b c d e")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, form string, n long")
    got = [tuple(r) for r in queries.op12_infill(spark, put(docs, "documents")).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((fim(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert infill.infill(docs.limit(0)).count() == 0


def test_infill_units_add_up(spark):
    texts = ["a\U0001f600b \U0001f601 c  ", "One. Two!  Three\n\nfour", "  x", "\n", ""]
    want = {
        "character": lambda t: list(t),
        "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
        "word": lambda t: re.findall(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", t),
        "token": lambda t: re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t),
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for grammar in infill.GRAMMARS:
        for r in df.select("text", infill.units("text", grammar).alias("u")).collect():
            assert "".join(r.u) == r.text and all(r.u)
            if grammar in want:
                assert r.u == want[grammar](r.text)


@pytest.mark.parametrize("grammar", ["line", "character", "sentence"])
def test_infill_restores_any_grammar(spark, grammar):
    docs = spark.createDataFrame([(i, f"line {i}. of\ntext <{i}> \U0001f600\n" * (i % 4)) for i in range(80)], "doc_id long, text string")
    for r in infill.infill(docs, grammar, share=100).select("*", infill.restore("output", "form").alias("back"), F.coalesce("prefix", F.lit("")).alias("p")).join(docs, "doc_id").collect():
        assert r.back == r.text and r.text.startswith(r.p)


# Binary codes.


def test_codes_that_share_a_segment_everywhere(spark):
    """One segment has the same value in all codes, so it tells nothing apart; the others must."""
    rng = random.Random(9)
    codes = [(i, (rng.getrandbits(47) << 16) | 0xBEEF) for i in range(700)]
    df = spark.createDataFrame(codes, "id long, code long")
    got = {}
    for r in hamming.top_k(df, df.where("id % 70 = 0").withColumnRenamed("id", "query_id"), k=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    for q, own in codes[::70]:
        near = sorted(((own ^ c).bit_count(), i) for i, c in codes if i != q)[:4]
        assert sorted(got[q]) == [(n + 1, i, d) for n, (d, i) in enumerate(near)]


# What failed before.


def test_quotas_beyond_a_billion_blocks_are_split():
    own = np.array([2_000_000_000, 5, 0, 900_000_000, 7_000_000_000_000], np.int64)
    parts = mixing.split(own, 13, 3)
    assert (parts.sum(0) == own).all() and (parts >= 0).all()
    share = own.sum() / 13
    assert (abs(parts.sum(1) - share) < 1e-3 * share).all()


def test_strata_draw_what_is_asked():
    rng = np.random.default_rng(1)
    for own, n in (([7, 0, 30, 1], 19), ([1, 1, 1], 1), ([100, 3], 51)):
        got = mixing.drawn(np.array(own, np.int64), n, rng, at_once=10)
        assert got.sum() == n and (got <= own).all() and (got >= 0).all()


def test_language_sample_of_shared_and_null_ids(spark):
    rng = random.Random(2)
    text = lambda words: " ".join(rng.choice(words) for _ in range(30))
    english, german = "the of and to in that is was for with".split(), "der die und das ist nicht ein zu mit auf".split()
    rows = [(None if i % 2 else 1, text(w), lang) for i in range(1500) for w, lang in ((english, "en"), (german, "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = [r.lang for r in langid._drawn(docs.select("text", "lang", F.lit(3).cast("long").alias("key")), {"en": 9, "de": 9}, 100)]
    assert sorted(sample) == ["de"] * 100 + ["en"] * 100  # though all of them share a key
    for seed in range(3):
        model = langid.train(docs, rows=100, seed=seed)
        got = langid.predict(docs.select("doc_id", "text", F.col("lang").alias("true")), model, keep=("true",)).collect()
        assert np.mean([r.lang_pred == r.true for r in got]) > 0.99


def test_language_sample_of_copies_is_never_empty(spark):
    docs = spark.createDataFrame([(5, "same words again", "en")] * 600 + [(6, "andere worte hier", "de")] * 600, "doc_id long, text string, lang string")
    for seed in range(4):
        assert langid.train(docs, rows=10, seed=seed).languages == ("de", "en")
        got = {r.text: r.lang_pred for r in langid.predict(docs.distinct(), langid.train(docs, rows=10, seed=seed), keep=("text",)).collect()}
        assert got == {"same words again": "en", "andere worte hier": "de"}


def test_folded_scores_are_averages_of_embeddings():
    """The table gives what averaging n-gram scores one by one gives."""
    rng = np.random.default_rng(1)
    model = langid.Model(("a", "b"), rng.normal(size=(2, len(langid.GRAMS) << langid.BITS)).astype(np.float32), np.array([0.1, -0.2]), 1.5, np.ones(len(langid.GRAMS) << langid.BITS, bool), 0.0, 0.0)
    texts = [b"Hello there", b"x", b"", "grün ist schön".encode()]
    offsets = np.cumsum([0, *map(len, texts)])
    got, _ = langid._scores(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, p in zip(texts, got, strict=True):
        t = t.lower()
        ids = [i for n, at in zip(langid.GRAMS, range(9)) for k in range(len(t) - n + 1) for i in [((int.from_bytes(t[k : k + n], "big") * 2654435761) % (1 << 32) >> (32 - langid.BITS)) + (at << langid.BITS)]]
        logits = model.bias + (model.table[:, ids].astype(float).mean(1) if ids else 0)
        e = np.exp((logits - logits.max()) / model.temperature)
        assert np.allclose(p, e / e.sum())


def test_small_tables_are_files_where_they_are_many(spark, monkeypatch):
    rows = [(i, f"n{i}", [i, None], i) for i in range(50)] + [(None, None, None, None)]
    plans = []
    for most in (10, 1000):
        monkeypatch.setattr(store, "MOST_LITERAL", most)
        df = store.small_table(spark, rows, "a long, b string, c array<long>, d double")
        plans.append({str(r) for r in df.collect()})
    assert plans[0] == plans[1] and len(plans[0]) == 51


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_with_the_separator_are_read_back(spark, tmp_path):
    mark = warc.SEPARATOR
    rng = random.Random(1)
    junk = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    odd = [mark, mark * 3, f"<p>{mark}</p>" + junk(300), junk(40) + mark, mark[: len(mark) // 2] * 2, mark[:-1], warc._CLOSED.decode("latin1") + mark]
    rows = [(i, f"http://a/{i}", f"<html>{'plain text ' * 20}{i}</html>") for i in range(40)] + [(100 + i, "u", h) for i, h in enumerate(odd)] + [(200 + i, mark, mark + str(i % 3)) for i in range(60)]
    warc.write_archives(pages_frame(spark, rows), f"{tmp_path}/a")
    got = {r.page_id: r for r in warc.read_archives(spark, f"{tmp_path}/a").collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(html.encode()), warc.payload_digest(html.encode()))


def test_no_dictionary_holds_the_separator(spark):
    rows = [(i, "u", f"{warc.SEPARATOR} some {i} text that repeats {i * i}" * 5) for i in range(60)] + [(1000 + i, "u", f"other words {i} of a page {i * 7}" * 9) for i in range(60)]
    made = warc._dictionary(pages_frame(spark, rows))
    assert made and warc.SEPARATOR.encode() not in made


def test_archives_of_two_writes_are_read_together(spark, tmp_path):
    for k, word in enumerate(("alpha beta gamma", "delta epsilon zeta")):
        rows = [(1000 * k + i, f"http://{word[:3]}/{i}", f"<b>{word} {i}</b>" * 30) for i in range(50)]
        warc.write_archives(pages_frame(spark, rows).coalesce(1), f"{tmp_path}/w{k}")
    found = warc.read_archives(spark, f"{tmp_path}/w*")
    assert sorted(r.page_id for r in found.collect()) == [*range(50), *range(1000, 1050)]
