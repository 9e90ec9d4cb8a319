"""Ranking quality: MRR, NDCG, Recall, Precision, MAP and HitRate at K.

A run is (method, qid, docid, score[, ord]), the judgements (qid, docid, rel).
Every query is ranked once; all K come from conditional sums over the ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekhya.io import numbered

K_VALUES = (1, 3, 5, 7, 10)
METRICS = ("MRR", "NDCG", "Recall", "Precision", "MAP", "HitRate")


def ranked(run: DataFrame, tie: str = "ord") -> DataFrame:
    """``run`` with 1-based ``rank`` per method and query; ties in order of ``tie``."""
    by = [F.desc("score"), *([F.col(tie)] if tie in run.columns else []), F.col("docid")]
    return run.withColumn("rank", F.row_number().over(W.partitionBy("method", "qid").orderBy(*by)))


def gains_of(qrels: DataFrame) -> DataFrame:
    """(qid, rel, n): how many documents are judged so, of judgements (qid, docid, rel)."""
    return qrels.groupBy("qid", "rel").agg(F.count("*").alias("n"))


def ideal(gains: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(qid, n_rel, idcg_k...) per query of the judgements, from their counts (qid, rel, n)."""
    most = max(k_values)
    # of the judgements only the best are put in order
    best = gains.select("qid", "rel", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(most)).cast("int"))).alias("_i"))
    best = best.withColumn("_pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "_i"))).filter(F.col("_pos") <= most)
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("_pos") + 1)
    sums = best.groupBy("qid").agg(*[F.sum(F.when(F.col("_pos") <= k, gain).otherwise(0.0)).alias(f"idcg_{k}") for k in k_values])
    return gains.groupBy("qid").agg(F.sum(F.when(F.col("rel") > 0, F.col("n")).otherwise(0)).alias("n_rel")).join(sums, "qid")


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` with ``rel``, 0 where nothing is said."""
    return run.join(qrels.select("qid", "docid", "rel"), ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(method, qid, K, metric columns) for queries of both run and judgements."""
    top = ranked(run).filter(F.col("rank") <= max(k_values))
    return of_judged(judged_run(top, qrels), gains_of(qrels), k_values)


def of_judged(judged: DataFrame, gains: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """As ``per_query`` for a run with ``rank`` and ``rel``, and the counts (qid, rel, n) of the judgements."""
    hit = F.col("rel") > 0
    w = W.partitionBy("method", "qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    judged = judged.withColumn("_hits", F.sum(hit.cast("int")).over(w))
    aggs = []
    for k in k_values:
        inside = F.col("rank") <= k
        aggs += [
            F.min(F.when(inside & hit, F.col("rank"))).alias(f"first_{k}"),
            F.sum(F.when(inside, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.sum((inside & hit).cast("int")).alias(f"hits_{k}"),
            F.sum(F.when(inside & hit, F.col("_hits") / F.col("rank")).otherwise(0.0)).alias(f"ap_{k}"),
        ]
    wide = judged.groupBy("method", "qid").agg(*aggs).join(ideal(gains, k_values), "qid")
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("K"),
                F.coalesce(1.0 / F.col(f"first_{k}"), F.lit(0.0)).alias("MRR"),
                F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0).alias("NDCG"),
                F.when(F.col("n_rel") > 0, F.col(f"hits_{k}") / F.col("n_rel")).otherwise(0.0).alias("Recall"),
                (F.col(f"hits_{k}") / F.lit(k)).alias("Precision"),
                F.when(F.col("n_rel") > 0, F.col(f"ap_{k}") / F.least("n_rel", F.lit(k))).otherwise(0.0).alias("MAP"),
                (F.col(f"hits_{k}") > 0).cast("double").alias("HitRate"),
            )
            for k in k_values
        ]
    )
    return wide.select("method", "qid", F.explode(rows).alias("m")).select("method", "qid", "m.*")


def evaluate(run: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(method, K, metric columns): the means over queries, to six places."""
    return means(per_query(run, qrels, k_values))


def means(per: DataFrame) -> DataFrame:
    """(method, K, metric columns) of rows per query."""
    return per.groupBy("method", "K").agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def tidy(report: DataFrame) -> DataFrame:
    """(method, metric, K, value) of a report, for plots."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return report.select("method", "K", F.explode(pairs).alias("p")).select("method", "p.metric", "K", "p.value")


def matched_gold(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """Gold rows (query, docid) whose document is in the corpus, with ``qid``.

    The numbering runs over matched rows only, in the order of ``ord``.
    """
    found = gold.join(corpus.select("docid").distinct(), "docid", "left_semi")
    return numbered(found, [], "ord", "_n").withColumn("qid", F.concat(F.lit("q_"), F.col("_n").cast("string"))).drop("_n")


def skipped_gold(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """Gold rows whose document is not in the corpus."""
    return gold.join(corpus.select("docid").distinct(), "docid", "left_anti")


def last_text(corpus: DataFrame) -> DataFrame:
    """One row per document id: the text of its last row, at its first place."""
    return corpus.groupBy("docid").agg(F.max_by("text", "ord").alias("text"), F.min("ord").alias("ord"))
