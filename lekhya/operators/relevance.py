"""Which chunks are worth extracting from: keyword scores, filter, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekhya.functions.text import alternation, contains_any
from lekhya.rules import NEPALI, RulePack

#: Width of a bucket of the order of chunks.
BUCKET = 65_536


def eligible(text: Column, kind: Column, title: Column, rules: RulePack = NEPALI) -> Column:
    """Long enough, not of a skipped type, not under a skipped title."""
    ok = F.length(F.coalesce(text, F.lit(""))) >= rules.min_length
    ok = ok & ~contains_any(F.coalesce(title, F.lit("")), rules.skip_titles)
    return ok & ~F.coalesce(kind.isin(*rules.skip_types), F.lit(False)) if rules.skip_types else ok


def score(text: Column, kind: Column, title: Column, rules: RulePack = NEPALI) -> Column:
    """One point for every keyword group with a hit; 0 for chunks not eligible."""
    total = F.lit(0)
    for needles in rules.keyword_groups.values():
        total = total + contains_any(text, needles).cast("int")
    return F.when(eligible(text, kind, title, rules), total).otherwise(F.lit(0))


def matched(text: Column, rules: RulePack = NEPALI) -> Column:
    """{group: distinct keywords, sorted} of the groups with a hit.

    At each place the first keyword of the group's order counts.
    """
    entries = F.array(
        *[
            F.struct(F.lit(group).alias("key"), F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(alternation(needles)), F.lit(0)))).alias("value"))
            for group, needles in rules.keyword_groups.items()
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def scored(chunks: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """``chunks`` with ``ner_score``; null texts score 0."""
    return chunks.withColumn("ner_score", F.coalesce(score(F.col("text"), F.col("type"), F.col("hierarchy.sec_title"), rules), F.lit(0)))


def relevant(chunks: DataFrame, rules: RulePack = NEPALI, min_score: int | None = None) -> DataFrame:
    """The chunks of sufficient score, with score and matched keywords."""
    keep = scored(chunks, rules).filter(F.col("ner_score") >= (rules.min_score if min_score is None else min_score))
    return keep.withColumn("ner_matched_groups", matched(F.col("text"), rules))


def histogram(chunks: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """(ner_score, n) over all chunks."""
    return scored(chunks, rules).groupBy("ner_score").agg(F.count("*").alias("n"))


def statistics(chunks: DataFrame, rules: RulePack = NEPALI, min_score: int | None = None) -> DataFrame:
    """One row: total, passed, rejected and the share rejected in per cent."""
    least = rules.min_score if min_score is None else min_score
    got = scored(chunks, rules).agg(F.count("*").alias("total"), F.coalesce(F.sum((F.col("ner_score") >= least).cast("bigint")), F.lit(0)).alias("passed"))
    rate = F.when(F.col("total") > 0, F.round((F.col("total") - F.col("passed")) / F.col("total") * 100, 1)).otherwise(F.lit(0.0))
    return got.select("total", "passed", (F.col("total") - F.col("passed")).alias("rejected"), rate.alias("filter_rate_pct"))


def context_windows(chunks: DataFrame, size: int = 3, partition: str = "act_slug", order: str = "ord") -> DataFrame:
    """Runs of up to ``size`` neighbouring chunks of one section as one chunk.

    Only the section number is compared, within one act; a chunk without a
    section stays alone.  The merged chunk has the id, type and hierarchy of
    its first, the texts joined by a blank line, and the ids of all in
    ``merged_ids`` (null for a single chunk).  ``order`` is an integer.

    The order is cut into buckets, and what a bucket must know of those before
    it (their number of rows, the last section, the last beginning of a run)
    is carried over, so an act that holds most chunks is many small windows.
    """
    if size <= 1:
        return chunks.withColumn("merged_ids", F.lit(None).cast("array<string>"))
    keys = [partition, "_b"]
    inside, over = W.partitionBy(*keys).orderBy(order), W.partitionBy(partition).orderBy("_b")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    sec = F.col("hierarchy.sec")
    t = chunks.withColumn("_b", F.floor(F.col(order) / BUCKET))
    t = t.withColumn("_n", F.row_number().over(inside)).withColumn("_prev", F.lag(sec).over(inside))
    sums = t.groupBy(*keys).agg(F.count("*").alias("_rows"), F.max_by(F.struct(sec.alias("s")), order).alias("_last"))
    carried = sums.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.lag("_last").over(over)["s"].alias("_carried"))
    t = t.join(carried, keys).withColumn("_at", F.col("_offset") + F.col("_n"))
    begins = F.coalesce(sec != F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev")), F.lit(True))
    t = t.withColumn("_begin", F.when(begins, F.col("_at")))
    runs = t.groupBy(*keys).agg(F.max("_begin").alias("_begun")).select(*keys, F.last("_begun", ignorenulls=True).over(before).alias("_begun"))
    t = t.withColumn("_own", F.last("_begin", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))).join(runs, keys)
    t = t.withColumn("_start", F.coalesce("_own", "_begun"))
    t = t.withColumn("_window", F.col("_start") + F.floor((F.col("_at") - F.col("_start")) / size) * size)
    rest = [c for c in chunks.columns if c not in (partition, "text")]
    # at most ``size`` rows a group
    parts = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("id", F.lit("")).alias("i"))))
    got = t.groupBy(partition, "_window").agg(parts.alias("_parts"), F.min_by(F.struct("text", *rest), "_at").alias("_first"))
    many = F.size("_parts") > 1
    return got.select(
        partition, *[F.col(f"_first.{c}").alias(c) for c in rest],
        F.when(many, F.array_join(F.transform("_parts", lambda x: x["t"]), "\n\n")).otherwise(F.col("_first.text")).alias("text"),
        F.when(many, F.transform("_parts", lambda x: x["i"])).alias("merged_ids"),
    )
