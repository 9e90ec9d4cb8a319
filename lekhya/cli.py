"""Command line: extract, ingest, search, entities, evaluate and run; ``python -m lekhya.cli -h``."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekhya.config import Settings
from lekhya.io import materialise
from lekhya.operators import metrics, relevance, store
from lekhya.operators.retrieval import SEARCH_TYPES, overlap_scorer
from lekhya.plans import pipelines
from lekhya.sources import models, readers, writers


def loaded(name: str) -> Callable:
    """The object that "module:attribute" names, for injected models."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    s = Settings.from_env()
    p = argparse.ArgumentParser(prog="lekhya")
    p.add_argument("--encoder", help="module:function that makes vectors")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract", help="pages of PDF files to dataset files")
    x.add_argument("--input", default=s.input_dir)
    x.add_argument("--output", default=s.dataset_dir)
    x.add_argument("--ocr", required=True, help="module:function from the bytes of a file to its pages' texts")
    i = sub.add_parser("ingest", help="dataset files into a collection")
    i.add_argument("--input", default=s.dataset_dir)
    i.add_argument("--collections", default=s.collection_dir)
    i.add_argument("--recreate", action="store_true", default=s.recreate)
    q = sub.add_parser("search", help="search a collection; without -q questions are read line by line")
    q.add_argument("-q", "--query")
    q.add_argument("--type", choices=SEARCH_TYPES, default=s.search_type)
    q.add_argument("--top-k", type=int, default=s.top_k)
    q.add_argument("--act")
    q.add_argument("--no-rerank", action="store_true", default=not s.rerank)
    q.add_argument("--collections", default=s.collection_dir)
    e = sub.add_parser("entities", help="entities and workflows of dataset files")
    e.add_argument("-i", "--input", default=s.dataset_dir)
    e.add_argument("-o", "--output", default="entity_results")
    e.add_argument("-p", "--provider", default=s.provider, help="auto, local, hosted, or module:function that answers a text with JSON")
    e.add_argument("--hosted", help="module:function that asks a hosted model")
    e.add_argument("--host", default=s.model_host)
    e.add_argument("--model", default=s.model or None)
    e.add_argument("--retries", type=int)
    e.add_argument("--filter-only", action="store_true")
    e.add_argument("--use-windowing", action="store_true", default=s.use_windowing)
    e.add_argument("--batch-size", type=int, default=s.batch_size)
    v = sub.add_parser("evaluate", help="ranking quality of the searches over dataset files and a gold file")
    v.add_argument("-i", "--input", default=s.dataset_dir)
    v.add_argument("--gold", required=True)
    v.add_argument("-o", "--output", default="evaluation.json")
    v.add_argument("--k", type=int, nargs="+", default=list(metrics.K_VALUES))
    v.add_argument("--pool", type=int, default=100)
    v.add_argument("--no-rerank", action="store_true", default=not s.rerank)
    r = sub.add_parser("run", help="extract, then ingest, as the variables LEKHYA_RUN_EXTRACT and LEKHYA_RUN_INGEST say")
    r.add_argument("--ocr")
    return p


def extractor_of(a: argparse.Namespace) -> tuple[Callable, dict]:
    """(extractor, its policy) of the options of the command ``entities``."""
    if ":" in a.provider:
        asked, policy = loaded(a.provider), models.LOCAL
    else:
        asked, policy = models.chosen(a.provider, a.host, a.model, loaded(a.hosted) if a.hosted else None)
    return asked, {"retries": a.retries or policy.retries, "wait": policy.wait, "again": policy.again, "delay": policy.delay}


def evaluated(spark: SparkSession, a: argparse.Namespace, encoder: store.Encoder, dim: int) -> DataFrame:
    """The report of the searches: raw texts, gold queries whose document is there."""
    chunks = dataset_chunks(spark, a.input)
    placed = chunks.select(F.col("id").alias("docid"), F.coalesce("text", F.lit("")).alias("text"), F.struct("act_slug", "ord").alias("ord")).filter("docid IS NOT NULL")
    # acts are files, in the order of their names
    acts = placed.select("ord.act_slug").distinct().withColumn("_n", F.row_number().over(W.orderBy("act_slug")).cast("bigint"))
    rows = metrics.last_text(placed).select("docid", "text", "ord.act_slug", F.col("ord.ord").alias("_ord"))
    numbered = materialise(rows.join(acts, "act_slug").select("docid", "text", (F.col("_n") * 2**32 + F.col("_ord")).alias("ord")))
    corpus = store.embed(numbered, "text", encoder, dim).withColumnRenamed("sparse", "weights")
    gold = metrics.matched_gold(readers.gold(spark, a.gold), numbered)
    skipped = metrics.skipped_gold(readers.gold(spark, a.gold), numbered).count()
    if skipped:
        print(skipped, "gold queries without a document are left out")
    queries = store.embed(gold.select("qid", "query"), "query", encoder, dim).select("qid", "query", F.col("vector").alias("qvec"), F.col("sparse").alias("qweights"))
    qrels = gold.select("qid", "docid", F.lit(1).alias("rel"))
    return pipelines.evaluate(materialise(corpus), materialise(queries), qrels, tuple(a.k), a.pool, None if a.no_rerank else overlap_scorer)


def commands(lines: Iterator[str], state: dict) -> Iterator[str]:
    """Questions of an interactive session; settings lines change ``state``.

    "top N", "type T", "rerank on|off", and exit, quit or q to end.
    """
    for line in lines:
        words = line.split()
        if not words:
            continue
        if words[0].lower() in ("exit", "quit", "q") and len(words) == 1:
            return
        if words[0] == "top" and len(words) == 2 and words[1].isdigit():
            state["top_k"] = int(words[1])
        elif words[0] == "type" and len(words) == 2 and words[1] in SEARCH_TYPES:
            state["type"] = words[1]
        elif words[0] == "rerank" and words[1:] in (["on"], ["off"]):
            state["rerank"] = words[1] == "on"
        else:
            yield line.strip()


def dataset_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = readers.chunks(readers.datasets(spark, folder))
    return rows.withColumn("act_slug", F.regexp_replace("act_source", "_dataset$", ""))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, lines: Iterator[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "run":
        s, done = Settings.from_env(), 0
        front = ["--encoder", a.encoder] if a.encoder else []
        for wanted, rest in ((s.run_extract, ["extract", "--ocr", a.ocr or ""]), (s.run_ingest, ["ingest"])):
            done = done or (main([*front, *rest], spark) if wanted else 0)
        return done
    spark = spark or SparkSession.builder.appName("lekhya").getOrCreate()
    dim = Settings.from_env().dim
    encoder = loaded(a.encoder) if a.encoder else store.hashed_words(dim)
    if a.command == "extract":
        files = readers.pdf_files(spark, a.input)
        if files.isEmpty():
            print("no PDF files in", a.input)
            return 0
        acts, chunks = pipelines.extract(readers.pages(files, loaded(a.ocr)))
        sets = writers.nested_chunks(chunks).join(acts, "doc").select(F.col("doc").alias("act_source"), "act_metadata", "chunks")
        writers.write_datasets(sets, a.output)
    elif a.command == "ingest":
        collection = store.Collection(spark, a.collections, Settings.from_env().collection)
        print(pipelines.ingest(dataset_chunks(spark, a.input), collection, encoder, dim, recreate=a.recreate), "points")
    elif a.command == "search":
        collection = store.Collection(spark, a.collections, Settings.from_env().collection)
        state = {"type": a.type, "top_k": a.top_k, "rerank": not a.no_rerank}
        for text in [a.query] if a.query else commands(lines or iter(sys.stdin), state):
            asked = spark.createDataFrame([("q", text)], "qid string, query string")
            hits = pipelines.search(collection, asked, encoder, dim, state["type"], state["top_k"], a.act, overlap_scorer if state["rerank"] else None)
            print(writers.show(hits, state["top_k"]) or "nothing found")
    elif a.command == "evaluate":
        report = evaluated(spark, a, encoder, dim)
        writers.write_report(report, a.output, {"pool": str(a.pool), "k": str(a.k)})
        report.orderBy("method", "K").show(100, False)
    else:
        chunks = dataset_chunks(spark, a.input)
        if a.filter_only:
            relevance.statistics(chunks).show()
            relevance.histogram(chunks).orderBy("ner_score").show()
            return 0
        asked, policy = extractor_of(a)
        got = pipelines.entity_results(chunks, asked, a.use_windowing, limit=a.batch_size, policy=policy)
        writers.write_results(got["entities"], f"{a.output}/entities")
        writers.write_results(got["workflows"], f"{a.output}/workflows")
        got["counts"].show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
