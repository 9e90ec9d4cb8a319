import json

import pytest
from pyspark.sql import functions as F

from lekhya.operators import entities as E
from lekhya.operators import ocr, store, training
from lekhya.plans import pipelines
from lekhya.streaming import ingest


def answer(spark, raw):
    return spark.createDataFrame([(raw,)], "x string").select(E.parse_answer(F.col("x")).alias("y")).collect()[0].y


def test_answers(spark):
    got = answer(spark, '```json\n{"office": {"name": "विभाग"}, "steps": [],}\n```')
    assert got.office == "विभाग" and got.steps == [] and got.documents_required == [] and got.price is None
    assert answer(spark, '{"price": 5}') is None and answer(spark, '{"price": {"a": 1}}') is None and answer(spark, "{bad") is None and answer(spark, None) is None and answer(spark, "[1]") is None
    assert answer(spark, '{"documents_required": null, "extra": 1}').documents_required == []
    assert answer(spark, '{"documents_required": ["क", "प्रमाणपत्र", 5], "steps": ["एक", "दुई शब्द"]}').documents_required == ["प्रमाणपत्र"]
    assert answer(spark, '{"office": {"office": "बोर्ड"}}').office == "बोर्ड" and answer(spark, '{"office": {}}').office is None and answer(spark, '{"office": 3}') is None


def test_cleaning(spark):
    df = spark.createDataFrame([(["क", "उपदफा (१)", "दफा १३ को पत्र", "नवीकरण", " दर्ता प्रमाणपत्र ", None], ["एक दुई तीन", "एक दुई तीन चार"])], "d array<string>, s array<string>")
    got = df.select(E.clean_documents(F.col("d")).alias("d"), E.clean_steps(F.col("s")).alias("s")).collect()[0]
    assert got.d == ["दर्ता प्रमाणपत्र"] and got.s == ["एक दुई तीन चार"]
    rows = [("तीस दिनभित्र", "जरिवाना रु. ५००", "बमोजिम"), ("तीन", "रु. ५००", "क"), (None, None, None), ("", "", "कृषि विभाग")]
    got = spark.createDataFrame(rows, "t string, p string, o string").select(E.clean_duration(F.col("t")).alias("t"), E.clean_price(F.col("p")).alias("p"), E.clean_office(F.col("o")).alias("o")).collect()
    assert [tuple(r) for r in got] == [("तीस दिनभित्र", None, None), (None, "रु. ५००", None), (None, None, None), (None, None, "कृषि विभाग")]


def test_fees(spark):
    cases = {"रु. १०,०००": [("रु. १०,०००", 10000)], "रु. ५०० रुपैयाँ": [("रु. ५००", 500), ("५०० रुपैयाँ", 500)], "पाँच हजार रुपैयाँ": [("पाँच हजार रुपैयाँ", None)], " ": [], None: [], "गुरु ५": [("रु ५", 5)]}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", E.parse_fees(F.col("x")).alias("f")).collect()
    assert {r.x: [(f.amount_raw, f.amount_npr) for f in r.f] for r in got} == cases


def test_pipeline_to_workflows(spark):
    chunk = "act_slug string, ord bigint, id string, type string, hierarchy struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>, text string, provisos array<string>, explanations array<string>, refs array<struct<type string, id string, text string>>, stats struct<characters int, tokens int>"
    body = "निवेदन दर्ता गर्न कार्यालय समक्ष दस्तुर तिर्नु पर्छ"
    rows = [("a", i, f"a-{i}", "section", (1, "क", i // 2, "उद्योग (दर्ता)", None, None), body, None, None, None, None) for i in range(4)] + [("a", 9, "a-9", "section", None, "छोटो", None, None, None, None)]
    df = spark.createDataFrame(rows, chunk)
    reply = json.dumps({"office": "उद्योग विभाग", "documents_required": ["निवेदन पत्र", "निवेदन पत्र", "नक्सा"], "steps": ["एक दुई तीन चार"], "price": "रु. ५००", "duration_days": "७ दिन"})
    got = pipelines.entity_results(df, lambda _: reply, use_windowing=True)
    assert got["entities"].count() == 2 and tuple(got["counts"].collect()[0]) == ("a", 4, 2)
    w = got["workflows"].collect()
    assert len(w) == 1 and w[0].task_name == "उद्योग दर्ता" and w[0].all_documents == ["निवेदन पत्र", "नक्सा"] and w[0].description == "उद्योग (दर्ता"
    assert [o.name for o in w[0].offices] == ["उद्योग विभाग"] and [f.amount_npr for f in w[0].all_fees] == [500] and w[0].prerequisites is None

    def broken(_):
        raise RuntimeError

    assert pipelines.entity_results(df, broken)["entities"].count() == 0


def test_store_search_and_stream(spark, tmp_path):
    chunk = "act_source string, ord bigint, id string, type string, hierarchy struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>, text string, provisos array<string>, explanations array<string>, refs array<struct<type string, id string, text string>>, stats struct<characters int, tokens int>"
    rows = [("s", i, f"id{i % 3}", "section", None, f"word{i} common", None, None, None, (5, 1)) for i in range(5)]
    df = spark.createDataFrame(rows, chunk)
    encoder, c = store.hashed_words(16), store.Collection(spark, str(tmp_path / "c"), "acts")
    assert c.info()["status"] == "absent"
    with pytest.raises(ValueError):
        pipelines.search(c, spark.createDataFrame([("q", "word4")], "qid string, query string"), encoder, 16)
    assert pipelines.ingest(df, c, encoder, 16) == 3
    assert pipelines.ingest(df.filter("ord = 4"), c, encoder, 16) == 3  # the same keys again
    asked = spark.createDataFrame([("q", "word4 common")], "qid string, query string")
    for kind in ("dense", "sparse", "hybrid"):
        hits = pipelines.search(c, asked, encoder, 16, kind, 2).orderBy("rank").collect()
        assert hits[0].text == "word4 common" and hits[0].chunk_id == "id1"
    assert pipelines.search(c, asked, encoder, 16, "sparse", 2, act="other").count() == 0
    from lekhya.operators.retrieval import overlap_scorer

    assert pipelines.search(c, asked, encoder, 16, "hybrid", 1, scorer=overlap_scorer).collect()[0].text == "word4 common"
    src = str(tmp_path / "in")
    df.withColumn("id", F.concat("id", F.lit("-new"))).write.parquet(src)
    q = ingest.upsert_stream(ingest.chunk_stream(spark, src, df.schema), c, encoder, 16, "act_source", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert c.info()["points"] == 6
    c.delete()
    assert c.info()["points"] == 0


def test_evaluate_pipeline(spark):
    corpus = spark.createDataFrame([("a", "x y", [1.0, 0.0], {1: 1.0}, 0), ("b", "z", [0.0, 1.0], {2: 1.0}, 1)], "docid string, text string, vector array<float>, weights map<int,float>, ord int")
    queries = spark.createDataFrame([("q", "x", [1.0, 0.0], {1: 1.0})], "qid string, query string, qvec array<float>, qweights map<int,float>")
    qrels = spark.createDataFrame([("q", "a", 1)], "qid string, docid string, rel int")
    from lekhya.operators.retrieval import overlap_scorer

    got = pipelines.evaluate(corpus, queries, qrels, (1,), scorer=overlap_scorer).collect()
    assert {(r.method, r.MRR) for r in got} == {("dense", 1.0), ("sparse", 1.0), ("hybrid", 1.0), ("reranked", 1.0)}


def test_otsu(spark):
    px = [("i", v) for v in [10] * 5 + [12] * 5 + [200] * 5 + [210] * 5] + [("flat", 7)] * 3
    got = {r.image: r.threshold for r in ocr.otsu(ocr.histogram(spark.createDataFrame(px, "image string, level int"))).collect()}
    assert got == {"i": 12, "flat": 128}
    out = ocr.binarised(spark.createDataFrame(px, "image string, level int"), spark.createDataFrame([("i", 12)], "image string, threshold int"))
    assert {r.level for r in out.collect()} == {0, 255}


def test_training(spark):
    rows = [(i, f"id{i}", f"act{i % 2}", (1, None, i % 5, "शीर्षक", None, None), "\"दफा\" भन्नाले यो सम्झनु पर्छ", None) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_row_id bigint, id string, act_slug string, hierarchy struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>, text string, refs array<struct<type string, id string, text string>>")
    assert training.definition_queries(df).count() == 80 and training.title_queries(df).count() == 80
    by = {r[0]: r for r in rows}
    for r in training.negatives(df).filter("hard").collect():
        a, b = by[r.chunk_row_id], by[r.negative_id]
        assert a[2] == b[2] and a[3][2] != b[3][2]
    assert {r.split for r in training.triples(df).collect()} <= {"train", "dev"}


CHUNK = "chunk_row_id bigint, id string, act_slug string, hierarchy struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>, text string, refs array<struct<type string, id string, text string>>"


@pytest.mark.parametrize("ring", [100_000, 7])
def test_negatives_are_all_there(spark, monkeypatch, ring):
    """Every chunk has 5 negatives, or all that exist, 3 of them hard if there are."""
    monkeypatch.setattr(training, "RING", ring)
    # a section that dominates its chapter, a chapter of one section, one of few rows, no chapter, no act
    places = [("a", 1, 1)] * 60 + [("a", 1, 2)] * 2 + [("a", 2, 3)] * 9 + [("b", 1, 1), ("b", 1, 2)] + [("c", None, i) for i in range(8)] + [(None, None, None)]

    def check(places):
        rows = [(i, f"id{i}", a, (c, None, s, "शीर्षक", None, None), f"text {i}", None) for i, (a, c, s) in enumerate(places)]
        df = spark.createDataFrame(rows, CHUNK)
        got = {i: [] for i in range(len(rows))}
        for r in training.negatives(df).collect():
            got[r.chunk_row_id].append((r.negative_id, r.hard))
        for i, (act, ch, sec) in enumerate(places):
            hard = {j for j, (a, c, s) in enumerate(places) if (a, c) == (act, ch) and s != sec}
            acts = {j for j, (a, _, _) in enumerate(places) if a != act}
            chs = {j for j, (a, c, _) in enumerate(places) if a == act and c != ch}
            ids = [j for j, _ in got[i]]
            assert len(ids) == len(set(ids)) == min(5, len(hard | acts | chs)), (i, ids)
            assert {j for j, h in got[i] if h} <= hard and {j for j, h in got[i] if not h} <= acts | chs
            assert sum(h for _, h in got[i]) >= min(3, len(hard)), (i, got[i])
        want = [min(5, len(ids)) for _, ids in sorted(got.items())]
        assert [r.n for r in training.triples(df).groupBy("meta.chunk_id").agg(F.max(F.size("neg")).alias("n")).orderBy(F.expr("int(substring(chunk_id, 3))")).collect()] == want

    check(places)
    check([("a", 1, 1)] * 30 + [("a", 1, 2)] * 4 + [("a", 2, 3)])
    check([("a", 1, 1)] * 3 + [("a", 1, 2)])
