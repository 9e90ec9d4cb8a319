import math

import pytest
from pyspark.sql import functions as F

from lekhya.operators import metrics, relevance, retrieval

# rank histograms with one relevant document a query, and published values at K = 1, 3, 5, 7, 10
HISTOGRAMS = {
    "dense": ({1: 38, 2: 3, 3: 3, 4: 3, 7: 1, 8: 2}, [0.345455, 0.368182, 0.375, 0.376299, 0.378571], [0.345455, 0.376298, 0.388044, 0.391074, 0.39681]),
    "sparse": ({1: 36, 2: 3, 3: 3, 5: 1, 6: 3, 8: 1, 10: 1}, [0.327273, 0.35, 0.351818, 0.356364, 0.358409], [0.327273, 0.358118, 0.361633, 0.371348, 0.376844]),
    "hybrid": ({1: 40, 2: 3, 3: 2, 4: 1, 6: 1, 7: 2, 9: 1}, [0.363636, 0.383333, 0.385606, 0.389719, 0.390729], [0.363636, 0.389934, 0.39385, 0.403149, 0.405885]),
}


def test_published_metrics(spark):
    run, qrels = [], []
    for method, (hist, _, _) in HISTOGRAMS.items():
        ranks = [r for r, n in hist.items() for _ in range(n)]
        ranks += [99] * (110 - len(ranks))
        for q, rank in enumerate(ranks):
            docs = [f"x{i}" for i in range(1, 12)]
            if rank <= 10:
                docs[rank - 1] = "gold"
            run += [(method, f"{method}{q}", d, 1.0 - i / 100, i) for i, d in enumerate(docs)]
            qrels.append((f"{method}{q}", "gold", 1))
    report = metrics.evaluate(spark.createDataFrame(run, "method string, qid string, docid string, score double, ord int"), spark.createDataFrame(qrels, "qid string, docid string, rel int"))
    got = {(r.method, r.K): r for r in report.collect()}
    for method, (hist, mrr, ndcg) in HISTOGRAMS.items():
        for k, m, n in zip(metrics.K_VALUES, mrr, ndcg):
            r = got[method, k]
            hits = sum(c for rank, c in hist.items() if rank <= k)
            assert r.MRR == r.MAP == pytest.approx(m, abs=1e-6) and r.NDCG == pytest.approx(n, abs=3e-6)
            assert r.Recall == r.HitRate == pytest.approx(hits / 110, abs=1e-6) and r.Precision == pytest.approx(hits / 110 / k, abs=1e-6)
    assert metrics.tidy(report).count() == 3 * 5 * 6


def test_metrics_by_hand(spark):
    run = [("m", "q1", d, s, i) for i, (d, s) in enumerate([("a", 3.0), ("x", 2.0), ("b", 1.0)])] + [("m", "q2", "x", 1.0, 0), ("m", "q3", "b", 2.0, 0), ("m", "q3", "a", 1.0, 1), ("m", "none", "a", 1.0, 0)]
    run += [("m", "q4", "z", 1.0, 1), ("m", "q4", "y", 1.0, 0)]  # equal scores: order of the corpus
    qrels = [("q1", "a", 1), ("q1", "b", 1), ("q2", "a", 1), ("q3", "a", 2), ("q3", "b", 1), ("q4", "y", 1)]
    per = metrics.per_query(spark.createDataFrame(run, "method string, qid string, docid string, score double, ord int"), spark.createDataFrame(qrels, "qid string, docid string, rel int"), (1, 3))
    got = {(r.qid, r.K): r for r in per.collect()}
    assert {q for q, _ in got} == {"q1", "q2", "q3", "q4"}
    r = got["q1", 3]
    assert (r.MRR, r.Recall, r.HitRate) == (1, 1, 1) and r.Precision == pytest.approx(2 / 3) and r.MAP == pytest.approx(5 / 6) and r.NDCG == pytest.approx(0.919721, abs=1e-6)
    assert tuple(got["q2", 3])[3:] == (0.0,) * 6
    assert got["q3", 3].NDCG == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert got["q4", 1].MRR == 1.0


def test_sparse_and_fusion(spark):
    corpus = spark.createDataFrame([("d1", {10: 0.5, 11: 0.2}), ("d2", {12: 0.9}), ("d3", {}), ("d4", None)], "docid string, weights map<int,float>")
    queries = spark.createDataFrame([("q", {10: 1.0, 12: 0.5}), ("none", {}), ("null", None)], "qid string, qweights map<int,float>")
    scores = {r.docid: round(r.score, 6) for r in retrieval.sparse_search(corpus, queries, 9).collect()}
    assert scores == {"d1": 0.5, "d2": 0.45}
    zeros = retrieval.sparse_search(corpus, queries, 9, zeros=True).collect()
    assert {(r.qid, r.docid): round(r.score, 6) for r in zeros} == {("q", "d1"): 0.5, ("q", "d2"): 0.45, ("q", "d3"): 0.0, ("q", "d4"): 0.0}
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, docid string, rank int")
    b = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "qid string, docid string, rank int")
    for pair in ([a, b], [b, a]):
        got = {r.docid: r.score for r in retrieval.rrf(pair, 10).collect()}
        assert got == pytest.approx({"b": 1 / 62 + 1 / 61, "a": 1 / 61, "c": 1 / 62})
    both = spark.createDataFrame([("a", [0.8, 0.0], {1: 0.5}), ("b", [0.2, 0.0], None), ("c", None, {1: 9.0})], "docid string, vector array<float>, weights map<int,float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0], {1: 1.0})], "qid string, qvec array<float>, qweights map<int,float>")
    assert {r.docid: r.score for r in retrieval.weighted_search(both, asked, 5).collect()} == pytest.approx({"a": 0.95, "b": 0.2})


@pytest.mark.parametrize("queries_of_slice,block", [(10_000, 4_000_000), (3, 4_000_000), (1, 7), (4, 1)])
def test_slices_give_the_same_as_brute_force(spark, monkeypatch, queries_of_slice, block):
    import random

    monkeypatch.setattr(retrieval, "SLICE_QUERIES", queries_of_slice)
    monkeypatch.setattr(retrieval, "BLOCK_SCORES", block)
    rnd = random.Random(5)
    docs = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)], {w: float(rnd.randint(1, 3)) for w in rnd.sample("abcdef", rnd.randint(0, 4))}) for i in range(40)]
    asked = [(f"q{i}", *docs[3 * i][1:]) for i in range(10)]
    ddf = spark.createDataFrame(docs, "docid bigint, vector array<double>, weights map<string,double>").repartition(3)
    qdf = spark.createDataFrame(asked, "qid string, qvec array<double>, qweights map<string,double>")

    def best(score):
        out = set()
        for q, v, w in asked:
            scored = [(-s, i) for i, x, y in docs if (s := score(v, w, x, y)) is not None]
            out |= {(q, i, r, -s) for r, (s, i) in enumerate(sorted(scored)[:4], 1)}
        return out

    def inner(v, w, x, y):
        return sum(a * b for a, b in zip(v, x))

    def shared(v, w, x, y):
        return sum(n * y[t] for t, n in w.items() if t in y) if w.keys() & y.keys() else None

    def rows(df):
        return {(r.qid, r.docid, r["rank"], r.score) for r in df.collect()}

    assert rows(retrieval.dense_search(ddf, qdf, 4, retrieval.dot)) == best(inner)
    assert rows(retrieval.sparse_search(ddf, qdf, 4)) == best(shared)
    assert rows(retrieval.weighted_search(ddf, qdf, 4, weights=(1.0, 0.5))) == best(lambda *a: inner(*a) + 0.5 * (shared(*a) or 0.0))
    plan = retrieval.sparse_search(ddf, qdf, 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_task_returns_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_SCORES", 8)
    docs = spark.createDataFrame([(i, [float(i % 7), 1.0], {"a": float(i % 5 + 1)}) for i in range(40)], "docid bigint, vector array<double>, weights map<string,double>").coalesce(1)
    asked = spark.createDataFrame([(q, [1.0, 0.0], {"a": 1.0}) for q in range(4)], "qid bigint, qvec array<double>, qweights map<string,double>")
    for mode in ("dense", "sparse", "weighted"):
        assert retrieval.candidates(docs, asked, 3, mode, retrieval.dot).count() == 4 * 3


@pytest.mark.parametrize("unit", [1.0, 0.5])
def test_memory_of_common_words(unit):
    """Products of shared words are not all held at once: here they are 60 a score."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def maps(n):
        return pa.array([[(f"w{i}", unit * (i % 3 + 1)) for i in range(60)]] * n, pa.map_(pa.string(), pa.float64()))

    asked = retrieval.Asked(pa.array(range(2000)), None, maps(2000), False)
    found = asked.found(maps(400))
    tracemalloc.start()
    got = asked.sparse(found, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == 60 * 14 / 3 * unit**2).all() and got.shape == (400, 2000) and peak < 100e6
    assert np.isnan(asked.sparse(asked.found(pa.array([[("x", 1.0)]], pa.map_(pa.string(), pa.float64()))), False)).all()


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("threshold", [None, 2.0])
def test_best_of_blocks(monkeypatch, ordered, threshold):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "WAITING", 5)
    monkeypatch.setattr(retrieval, "BLOCK_PRODUCTS", 20)
    rnd = np.random.default_rng(7)
    ids = np.array([f"d{i:03}" for i in (range(200) if ordered else rnd.permutation(200))])
    scores = rnd.integers(0, 6, (200, 3)).astype(float)
    scores[rnd.random((200, 3)) < 0.3] = np.nan
    best = retrieval.Best(3, 4, threshold)
    for at in range(0, 200, 10):
        order = np.argsort(ids[at : at + 10])
        best.add(pa.array(ids[at : at + 10][order]), scores[at : at + 10][order])
    q, s, d = best.rank()
    want = [sorted((-x, i) for x, i in zip(scores[:, c], ids) if not np.isnan(x) and (threshold is None or x >= threshold))[:4] for c in range(3)]
    assert list(zip(q.tolist(), (-s).tolist(), d.to_pylist())) == [(c, *w) for c in range(3) for w in want[c]]


def test_text_counts_as_bags(spark):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else " ".join("abcdefg"[(i * j) % 7] for j in range(i % 6))) for i in range(60)], "docid int, text string")
    asked = retrieval.bags(df.filter("docid % 4 = 1")).select(F.col("docid").alias("qid"), F.col("weights").alias("qweights"))
    want = {(r.qid, r.docid, r["rank"], r.score) for r in retrieval.sparse_search(retrieval.bags(df), asked, 5).collect()}
    assert want and {(r.qid, r.docid, r["rank"], r.score) for r in retrieval.sparse_search(df, asked, 5).collect()} == want


def test_hybrid_counts_words_where_it_scores(spark):
    """A second Python process for the words would take as much memory again."""
    df = spark.createDataFrame([(i, " ".join("abcdefg"[(i * j) % 7] for j in range(i % 6))) for i in range(60)], "docid bigint, text string")
    vectors = df.select("docid", F.array(F.col("docid") % 7, F.lit(1.0)).alias("vector"))
    asked = retrieval.bags(df.filter("docid % 4 = 1")).join(vectors, "docid").select(F.col("docid").alias("qid"), F.col("weights").alias("qweights"), F.col("vector").alias("qvec"))
    want = {(r.qid, r.docid, r["rank"], r.score) for r in retrieval.hybrid_search(vectors, retrieval.bags(df), asked, 3, digits=6).collect()}
    got = retrieval.hybrid_search(vectors, df, asked, 3, digits=6)
    assert want and {(r.qid, r.docid, r["rank"], r.score) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_bags(spark):
    df = spark.createDataFrame([(1, "a b  a\nc"), (2, ""), (3, None), (4, " ")], "docid int, text string")
    assert {r.docid: r.weights for r in retrieval.bags(df).collect()} == {1: {"a": 1.0, "b": 1.0, "a\nc": 1.0}, 2: {}, 3: None, 4: {}}
    assert retrieval.bags(df.limit(0)).count() == 0


def test_dense_and_types(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2), ("c", [1.0, 0.0], 2), ("z", None, 2)], "docid string, vector array<float>, label int")
    queries = spark.createDataFrame([("q", [1.0, 0.0], {1: 1.0})], "qid string, qvec array<float>, qweights map<int,float>")
    assert [(r.docid, r.rank) for r in retrieval.dense_search(corpus, queries, 2).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    assert [r.docid for r in retrieval.dense_search(corpus, queries, 5, where=F.col("label") == 2).orderBy("rank").collect()] == ["c", "b"]
    assert [r.docid for r in retrieval.dense_search(corpus, queries, 5, threshold=0.5).orderBy("rank").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        retrieval.search("other", corpus, corpus, queries, 3)


def test_rerank_keeps_ties(spark):
    rows = [("q", "d1", "x y", "x", 0.9, 1), ("q", "d2", "x y", "x", None, 2), ("q", "d3", "x y", "x y", 0.1, 3), ("q", "d4", "x y", None, 0.0, 4)]
    got = retrieval.rerank(spark.createDataFrame(rows, "qid string, docid string, query string, text string, score double, rank int"), 3).orderBy("rank").collect()
    assert [(r.docid, r.rank, r.original_score) for r in got] == [("d3", 1, 0.1), ("d1", 2, 0.9), ("d2", 3, 0.0)]


CHUNK = "id string, act_slug string, ord int, type string, hierarchy struct<sec int, sec_title string>, text string"


def test_relevance(spark):
    body = "निवेदन दर्ता गर्न कार्यालय समक्ष दस्तुर तिर्नु पर्छ"
    rows = [("1", "a", 1, "section", (1, None), body), ("2", "a", 2, "section", (1, "परिभाषा"), body), ("3", "a", 3, "section", None, "दर्ता कार्यालय निवेद"[:19]), ("4", "a", 4, "preamble", (1, ""), body), ("5", "a", 5, None, (1, ""), "यो दर्ता मात्र भएको हो भनी लेखिएको"), ("6", "a", 6, "section", None, None)]
    df = spark.createDataFrame(rows, CHUNK)
    assert {r.id: r.ner_score for r in relevance.scored(df).collect()} == {"1": 4, "2": 0, "3": 0, "4": 0, "5": 1, "6": 0}
    kept = relevance.relevant(df).collect()
    assert [r.id for r in kept] == ["1"] and kept[0].ner_matched_groups["fee"] == ["दस्तुर"]
    assert tuple(relevance.statistics(df).collect()[0]) == (6, 1, 5, 83.3)
    assert tuple(relevance.statistics(df.limit(0)).collect()[0]) == (0, 0, 0, 0.0)


def test_windows(spark):
    secs = [1, 1, 1, 1, 2, None, None, 2, 2]
    df = spark.createDataFrame([(str(i), "a", i, "section", (s, None), f"t{i}") for i, s in enumerate(secs)], CHUNK)
    got = relevance.context_windows(df).orderBy("ord").collect()
    assert [r.merged_ids or [r.id] for r in got] == [["0", "1", "2"], ["3"], ["4"], ["5"], ["6"], ["7", "8"]]
    assert got[0].text == "t0\n\nt1\n\nt2" and got[1].merged_ids is None
    assert relevance.context_windows(df, 1).count() == 9


def test_windows_over_buckets(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    secs = [rnd.choice([1, 1, 1, 2, None]) for _ in range(300)]
    rows = [(str(i), "ab"[i % 7 == 0], 3 * i, "section", (s, None), f"t{i}") for i, s in enumerate(secs)]
    want = []
    for act in "ab":
        group = []
        for r in [r for r in rows if r[1] == act]:
            if group and r[4][0] is not None and r[4][0] == group[0][4][0] and len(group) < 3:
                group.append(r)
            else:
                group = [r]
                want.append(group)
    for width in (1, 10, 100_000):
        monkeypatch.setattr(relevance, "BUCKET", width)
        got = relevance.context_windows(spark.createDataFrame(rows, CHUNK)).collect()
        assert sorted((r.act_slug, r.ord, r.text) for r in got) == sorted((g[0][1], g[0][2], "\n\n".join(x[5] for x in g)) for g in want)


def test_second_stage_moves_no_texts(spark, monkeypatch):
    pool = [(f"q{i % 5}", i, None if i % 4 == 0 else i / 10, i // 5 + 1) for i in range(50)] + [("gone", 1, 1.0, 1), ("q1", 999, 1.0, 99), ("q2", None, 1.0, 99)]
    pool = spark.createDataFrame(pool, "qid string, docid bigint, score double, rank int")
    texts = [(i, None if i == 7 else " ".join("abcdefg"[(i * j) % 7] for j in range(i % 6))) for i in range(49)] + [(3, "a b"), (None, "a")]
    texts = spark.createDataFrame(texts, "docid bigint, text string").repartition(3)
    queries = spark.createDataFrame([("q0", "a b"), ("q1", "c"), ("q2", None), ("q3", "a d g"), ("q3", "e"), (None, "a"), ("q9", "b")], "qid string, query string")

    def rows(df):
        return sorted((r.qid, r.docid, r["rank"], round(r.rerank_score, 9), r.original_score) for r in df.collect())

    # all of them, so that a repeated id leaves no tie open
    want = rows(retrieval.rerank(pool.join(texts, "docid").join(queries, "qid"), 99))
    assert len(want) == 52
    keep = [x[:2] + x[3:] for x in want]
    for pairs, size, block in ((500_000, 16_000_000, 1_000), (20, 16_000_000, 2), (500_000, 5, 1)):
        for name, value in (("SLICE_PAIRS", pairs), ("SLICE_TEXT", size), ("BLOCK_PAIRS", block)):
            monkeypatch.setattr(retrieval, name, value)
        got = retrieval.second_stage(pool, queries, texts, 99)
        assert sorted(x[:2] + x[3:] for x in rows(got)) == sorted(keep)
        best = {x for x in rows(retrieval.second_stage(pool, queries.filter("qid <> 'q3'"), texts.filter("text IS NULL OR text <> 'a b'"), 2))}
        assert best == set(rows(retrieval.rerank(pool.join(texts.filter("text IS NULL OR text <> 'a b'"), "docid").join(queries.filter("qid <> 'q3'"), "qid"), 2)))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_two_stage_joins_no_texts(spark):
    df = spark.createDataFrame([(i, " ".join("abcdefg"[(i * j) % 7] for j in range(i % 6))) for i in range(60)], "docid bigint, text string")
    vectors = df.select("docid", F.array(F.col("docid") % 7, F.lit(1.0)).alias("vector"))
    asked = retrieval.bags(df.filter("docid % 4 = 1")).join(vectors, "docid").select(F.col("docid").alias("qid"), F.col("text").alias("query"), F.col("weights").alias("qweights"), F.col("vector").alias("qvec"))

    def rows(got):
        return {(r.qid, r.docid, r["rank"], r.rerank_score, r.original_score) for r in got.collect()}

    pool = retrieval.hybrid_search(vectors, retrieval.bags(df), asked, 3 * retrieval.RERANK_POOL, digits=6)
    want = rows(retrieval.rerank(pool.join(df, "docid").join(asked.select("qid", "query"), "qid"), 3))
    got = retrieval.two_stage("hybrid", vectors, df, asked, df, 3, retrieval.overlap_scorer, digits=6)
    assert want and rows(got) == want and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
