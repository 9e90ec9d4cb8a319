import json

import numpy as np
import pytest

from lekhya import cli
from lekhya.config import Settings
from lekhya.operators import entities, ocr
from lekhya.sources import readers, writers

PAGES = ["कम्पनी ऐन, २०६३\nपरिच्छेद-१\nप्रारम्भिक\n१. दर्ता: निवेदन दर्ता गर्न कार्यालय समक्ष दस्तुर तिर्नु पर्छ।", "२. नवीकरण: नवीकरण शुल्क कार्यालयमा बुझाउनु पर्छ।\n 12 \n"]


def fake_ocr(data):
    return PAGES


def fake_model(text):
    return json.dumps({"office": "उद्योग विभाग", "steps": ["एक दुई तीन चार"]})


def test_from_files_to_answers(spark, tmp_path, capsys, monkeypatch):
    folder = {n: str(tmp_path / n) for n in ("pdf", "json", "col", "out")}
    (tmp_path / "pdf").mkdir()
    assert cli.main(["extract", "--input", folder["pdf"], "--output", folder["json"], "--ocr", "tests.test_cli:fake_ocr"], spark) == 0
    (tmp_path / "pdf" / "Company Act.pdf").write_bytes(b"%PDF")
    pages = readers.pages(readers.pdf_files(spark, folder["pdf"]), fake_ocr)
    from lekhya.plans import pipelines

    acts, chunks = pipelines.extract(pages)
    assert acts.collect()[0].act_metadata.bs_year == 2063
    nested = writers.nested_chunks(chunks).join(acts, "doc").collect()[0]
    assert [c.id for c in nested.chunks] == ["company_act-2063-ch1-sec1", "company_act-2063-ch1-sec2"]
    (tmp_path / "json").mkdir()
    body = {"act_metadata": {"title": "t"}, "chunks": [{"id": c.id, "type": c.type, "hierarchy": c.hierarchy.asDict(), "text": c.text} for c in nested.chunks]}
    (tmp_path / "json" / "company_dataset.json").write_text(json.dumps(body, ensure_ascii=False, indent=2), encoding="utf-8")
    assert cli.main(["ingest", "--input", folder["json"], "--collections", folder["col"], "--recreate"], spark) == 0
    assert "2 points" in capsys.readouterr().out
    for more in ([], ["--no-rerank", "--type", "sparse"], ["--act", "company_dataset"]):
        assert cli.main(["search", "-q", "नवीकरण शुल्क", "--top-k", "1", "--collections", folder["col"], *more], spark) == 0
        assert "नवीकरण" in capsys.readouterr().out
    cli.main(["search", "--collections", folder["col"]], spark, iter(["top 1", "type dense", "rerank off", "", "नवीकरण शुल्क", "q", "x"]))
    assert len(capsys.readouterr().out.strip().split("\n")) == 1
    assert cli.main(["entities", "-i", folder["json"], "--filter-only"], spark) == 0
    assert cli.main(["entities", "-i", folder["json"], "-o", folder["out"], "-p", "tests.test_cli:fake_model"], spark) == 0
    assert spark.read.json(folder["out"] + "/entities").count() == 2
    (tmp_path / "gold.json").write_text(json.dumps([{"query": "नवीकरण शुल्क", "relevant_part_in_doc": nested.chunks[1].id}, {"query": "x", "relevant_part_in_doc": "no"}]))
    report = str(tmp_path / "report.json")
    assert cli.main(["evaluate", "-i", folder["json"], "--gold", str(tmp_path / "gold.json"), "-o", report, "--k", "1", "2"], spark) == 0
    assert "1 gold queries" in capsys.readouterr().out
    results = json.load(open(report))["results"]
    assert set(results) == {"dense", "sparse", "hybrid", "reranked"} and all(r["MRR@2"] >= 0.5 for r in results.values()) and results["sparse"]["MRR@1"] == 1.0
    monkeypatch.setenv("LEKHYA_DATASET_DIR", folder["json"])
    monkeypatch.setenv("LEKHYA_COLLECTION_DIR", folder["col"] + "2")
    assert cli.main(["run"], spark) == 0 and "points" not in capsys.readouterr().out
    monkeypatch.setenv("LEKHYA_RUN_INGEST", "true")
    monkeypatch.setenv("LEKHYA_RECREATE", "true")
    assert cli.main(["run"], spark) == 0 and "2 points" in capsys.readouterr().out
    (tmp_path / "json" / "bad_dataset.json").write_text("{}")
    with pytest.raises(Exception, match="no chunks"):
        cli.dataset_chunks(spark, folder["json"]).collect()


def test_report_and_gold(spark, tmp_path):
    rows = [("m", k, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5) for k in (1, 3)]
    path = str(tmp_path / "r.json")
    writers.write_report(spark.createDataFrame(rows, "method string, K int, MRR double, NDCG double, Recall double, Precision double, MAP double, HitRate double"), path, {"k": "1"})
    assert readers.report(spark, path).count() == 12
    (tmp_path / "g.json").write_text(json.dumps([{"query": "क", "relevant_part_in_doc": "d1"}, {"query": "ख", "relevant_part_in_doc": "no"}]))
    from lekhya.operators import metrics

    gold = readers.gold(spark, str(tmp_path / "g.json"))
    corpus = spark.createDataFrame([("d1",)], "docid string")
    assert [(r.qid, r.query) for r in metrics.matched_gold(gold, corpus).collect()] == [("q_0", "क")] and metrics.skipped_gold(gold, corpus).count() == 1


def test_images():
    rnd = np.random.default_rng(1)
    page = np.where(rnd.random((60, 40, 1)) < 0.2, 30, 220) * np.ones((1, 1, 3))
    g = ocr.grey(page.astype(np.uint8))
    assert g.shape == (60, 40) and set(np.unique(g)) == {30, 220} and set(np.unique(ocr.stretched(g))) == {0, 255}
    assert ocr.without_head(g).shape == (56, 40) and set(np.unique(ocr.prepared(page.astype(np.uint8)))) <= {0, 255}
    flat = np.full((5, 5), 9, np.uint8)
    assert ocr.otsu_level(flat) == 128 and (ocr.stretched(flat) == flat).all() and (ocr.sharpened(flat) == flat).all()
    assert ocr.recogniser(lambda d: [page.astype(np.uint8)], lambda im: str(im.shape))(b"") == ["(56, 40)"]


def test_otsu_in_sql_and_numpy_agree(spark):
    rnd = np.random.default_rng(2)
    im = np.clip(np.concatenate([rnd.normal(60, 12, 400), rnd.normal(170, 20, 300)]), 0, 255).astype(np.uint8)
    px = spark.createDataFrame([("i", int(v)) for v in im], "image string, level int")
    assert ocr.otsu(ocr.histogram(px)).collect()[0].threshold == ocr.otsu_level(im)


def test_settings(monkeypatch):
    monkeypatch.setenv("LEKHYA_TOP_K", "9")
    monkeypatch.setenv("LEKHYA_RERANK", "off")
    s = Settings.from_env()
    assert (s.top_k, s.rerank, s.search_type) == (9, False, "hybrid")
    assert entities.resolve_model("a", ["b", "a:7b"]) == "a:7b" and entities.resolve_model("x", ["b"]) == "b" and entities.resolve_model(None, []) is None


def test_models(monkeypatch):
    import http.server
    import threading

    from lekhya.sources import models

    class Service(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer({"models": [{"name": "a:7b"}, {"name": "b"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert asked["format"] == "json" and asked["messages"][0]["content"] == models.CONTRACT
            self.answer({"message": {"content": asked["model"] + asked["messages"][1]["content"]}})

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    ask, policy = models.chosen("auto", host, "a")
    assert ask("x") == "a:7bx" and policy is models.LOCAL and models.chosen("local", host, None)[0]("y") == "a:7by"
    server.shutdown()
    server.server_close()
    assert models.installed_models(host) == [] and models.chosen("auto", host, "a", fake_model) == (fake_model, models.HOSTED)
    for bad in (("other", None), ("hosted", None), ("local", None)):
        with pytest.raises(ValueError):
            models.chosen(bad[0], host, bad[1])
    assert models.overloaded(Exception("HTTP 503")) and not models.overloaded(Exception("401"))
    assert [models.LOCAL.wait(a) for a in (1, 2)] == [2, 4] and [models.HOSTED.wait(a) for a in (1, 2)] == [3, 9]
    assert models.device()[0] in ("cpu", "cuda", "mps")


def test_errors_that_are_not_tried_again(spark, tmp_path):
    log = tmp_path / "log"

    def failing(text):
        with open(log, "a") as f:
            f.write(text)
        raise ValueError("429" if text == "a" else "401")

    from lekhya.sources.models import overloaded

    df = spark.createDataFrame([("a",), ("b",), (" ",)], "text string").coalesce(1)
    assert [r.answer for r in entities.answers(df, failing, retries=3, wait=lambda a: 0, again=overloaded).collect()] == [None, None]
    assert sorted(log.read_text()) == ["a", "a", "a", "b"]
