"""The pipelines: extract, ingest, search, entities, evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekhya.io import materialise
from lekhya.operators import entities, hierarchy, metadata, metrics, relevance, retrieval, store
from lekhya.rules import NEPALI, RulePack


def extract(pages: DataFrame, rules: RulePack = NEPALI) -> tuple[DataFrame, DataFrame]:
    """Pages(doc, page_no, text) to (acts with act_metadata, chunks).

    Every page is recognised once; the facts come from the first two.
    """
    front = hierarchy.pages_to_text(pages.filter("page_no <= 2"), rules)
    acts = metadata.extract(front, "text", rules).select("doc", "act_metadata")
    docs = hierarchy.pages_to_text(pages, rules).join(acts, "doc").select("doc", F.col("doc").alias("slug"), F.col("act_metadata.bs_year").alias("bs_year"), "text")
    return acts, hierarchy.parse(docs, rules)


def ingest(chunks: DataFrame, collection: store.Collection, encoder: store.Encoder, dim: int, act_source: str = "act_source", recreate: bool = False) -> int:
    """Chunks into a collection; returns its number of points."""
    if recreate:
        collection.delete()
    collection.ensure()
    return collection.upsert(store.points(chunks, act_source, encoder, dim))


def search(collection: store.Collection, queries: DataFrame, encoder: store.Encoder, dim: int, kind: str = "hybrid", k: int = 5,
           act: str | None = None, scorer: retrieval.PairScorer | None = None) -> DataFrame:
    """queries(qid, query) against a collection; hits with display fields."""
    points = collection.read()
    if points is None:
        raise ValueError(f"no collection {collection.name}")
    asked = store.embed(queries, "query", encoder, dim).select("qid", "query", F.col("vector").alias("qvec"), F.col("sparse").alias("qweights"))
    base = points.select(F.col("point_id").alias("docid"), "vector", F.col("sparse").alias("weights"), F.col("payload.act_source").alias("act_source"), F.col("payload.text").alias("text"))
    where: Column | None = None if act is None else F.col("act_source") == act
    found = retrieval.two_stage(kind, base.select("docid", "vector", "act_source"), base.select("docid", "weights", "act_source"), asked, base, k, scorer, where)
    if scorer is not None:
        found = found.withColumnRenamed("rerank_score", "score")
    return store.hits(found.select("qid", "docid", "score", "rank"), points)


def entity_results(chunks: DataFrame, extractor: entities.Extractor, use_windowing: bool = False, window: int = 3, limit: int | None = None,
                   rules: RulePack = NEPALI, policy: dict | None = None) -> dict[str, DataFrame]:
    """Filter, window, ask, parse, clean and aggregate the chunks of acts.

    ``policy`` holds retries, wait, again and delay of ``entities.answers``.

    ``limit`` takes so many chunks of each act, in order, before the filter.
    """
    if limit is not None:
        chunks = chunks.withColumn("_n", F.row_number().over(W.partitionBy("act_slug").orderBy("ord"))).filter(F.col("_n") <= limit).drop("_n")
    passed = relevance.relevant(chunks, rules)
    asked = relevance.context_windows(passed, window) if use_windowing else passed
    # written once: nothing may ask the model again
    answered = materialise(entities.answers(asked, extractor, **(policy or {})))
    found = materialise(entities.entities_of(answered, rules))
    counts = passed.groupBy("act_slug").agg(F.count("*").alias("total_chunks_filtered")).join(asked.groupBy("act_slug").agg(F.count("*").alias("total_chunks_processed")), "act_slug")
    return {"entities": found, "workflows": entities.workflows(found, rules=rules), "counts": counts}


def evaluate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = metrics.K_VALUES, pool: int = 100,
             scorer: retrieval.PairScorer | None = None) -> DataFrame:
    """corpus(docid, text, vector, weights, ord) and queries(qid, query, qvec, qweights) to a report.

    Dense by inner product, sparse with zeros, their weighted sum, and the
    second stage over the best ``pool`` of it if a scorer is given.  Equal
    scores stand in the order of the corpus.
    """
    most = max(k_values)
    # the place in the corpus is the id while ranks are made
    docs, texts = corpus.select(F.col("ord").alias("docid"), "vector", "weights"), corpus.select(F.col("ord").alias("docid"), "text")
    ids = corpus.select("ord", "docid")
    runs = {
        "dense": retrieval.dense_search(docs, queries, most, retrieval.dot), "sparse": retrieval.sparse_search(docs, queries, most, zeros=True),
        "hybrid": retrieval.weighted_search(docs, queries, most),
    }
    if scorer is not None:
        best = retrieval.weighted_search(docs, queries, pool).join(texts, "docid").join(queries.select("qid", "query"), "qid")
        runs["reranked"] = retrieval.rerank(best, most, scorer, normalise=False).withColumnRenamed("rerank_score", "score")
    rows = [r.select("qid", F.col("docid").alias("ord"), "score", "rank").withColumn("method", F.lit(name)) for name, r in runs.items()]
    run = rows[0]
    for r in rows[1:]:
        run = run.unionByName(r)
    judged = metrics.judged_run(run.join(ids, "ord").drop("ord"), qrels)
    return metrics.means(metrics.of_judged(judged, metrics.gains_of(qrels), k_values))
