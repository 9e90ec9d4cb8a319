"""Sources combined to target shares of tokens, interleaved by Pfair scheduling.

A mix is as large as its tightest source allows: each source gives its share,
no document more often than the source's ``max_repeats``.  A source's documents
stand in hash order, pass after pass, and are cut into blocks of equal tokens.
Block k of a source of weight w is released at floor(k / w) and due at
ceil((k + 1) / w); the earliest deadline among the released goes first, so at
every slot each source is less than one block from its share.

The weights of a mix are whole parts of one denominator D, ``SLOTS`` or more by
the number of sources, to which the shares are rounded by largest remainder.
So the schedule repeats every D slots at most, whatever the shares: one period
is worked out and every block finds its slot in it by its number, at any size
of corpus.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.io import materialise, small_rows, table
from lekhya.llm.tokens import DEFAULT_RANKS, token_counts

#: Tokens of a block; a document belongs to the block in which it starts.
BLOCK_TOKENS = 4096
#: Slots of a period, which shares are rounded to; a source of a mix has at least one.
SLOTS, SLOTS_PER_SOURCE = 10_000, 16
MAX_TARGETS = 10_000
#: Documents of a bucket of the running sum, on average.
BUCKET_DOCS = 50_000


def pfair_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period of ``sum(weights)`` slots.

    Source s gets ``weights[s]`` of them.  Earliest deadline first among the
    released blocks; equal deadlines go to the heavier, then the first by name.
    """
    period = sum(weights.values())
    out: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s, 0) for s, w in sorted(weights.items()) if w > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), -weights[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        out[s].append(slot)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
    return out


def whole_weights(shares: dict[str, float]) -> dict[str, int]:
    """Positive shares as whole weights without a common divisor.

    Their sum is at most max(SLOTS, SLOTS_PER_SOURCE * sources) before
    division; what rounding down leaves goes to the largest remainders, equal
    ones by name, and every source keeps one.
    """
    total = sum(map(Fraction, shares.values()))
    slots = max(SLOTS, SLOTS_PER_SOURCE * len(shares))
    exact = {s: Fraction(x) * slots / total for s, x in shares.items()}
    # a share written in decimals is meant as written
    exact = {s: x.limit_denominator(SLOTS) for s, x in exact.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, slots - sum(out.values()))]:
        out[s] += 1
    shrink = gcd(*out.values())
    return {s: w // shrink for s, w in out.items()}


def plan(targets: list[tuple[str, str, float, int]], sizes: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """Rows (mix, source, target, weight, period, quota, size) per usable source, and its slots.

    The slots are rows (mix, source, number of the block in a period, slot).
    Sources without tokens, without a positive share or without a repeat are
    left out, and the shares of the others grow in proportion; of a source that
    a mix names twice the last row counts.
    """
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for mix, source, share, repeats in targets:
        mixes.setdefault(mix, {})
        if sizes.get(source, 0) > 0 and 0 < share < float("inf") and repeats > 0:
            mixes[mix][source] = (share, repeats)
    rows, slots = [], []
    for mix, sources in sorted(mixes.items()):
        if not sources:
            continue
        weights = whole_weights({s: share for s, (share, _) in sources.items()})
        period = sum(weights.values())
        total = min(Fraction(sizes[s] * repeats * period, weights[s]) for s, (_, repeats) in sources.items())
        for s, at in sorted(pfair_period(weights).items()):
            rows.append((mix, s, sources[s][0], weights[s], period, int(total * weights[s] / period), sizes[s]))
            slots += [(mix, s, k, slot) for k, slot in enumerate(at)]
    return rows, slots


PLAN = T.StructType(
    [
        T.StructField("mix_name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.DoubleType()),
        T.StructField("weight", T.IntegerType()), T.StructField("period", T.IntegerType()), T.StructField("quota", T.LongType()),
        T.StructField("size", T.LongType()),
    ]
)


def offsets(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source, n_tokens, buckets)`` with the tokens before each in its source.

    The order is by hash.  Sums of hash buckets run first, then each bucket
    alone, so a source that holds most of the corpus is many small windows.
    """
    place = F.col("_h") / F.lit(2.0**64) + F.lit(0.5)
    h = docs.withColumn("_h", F.xxhash64("doc_id")).withColumn("_bucket", F.least(F.floor(place * F.col("buckets")), F.col("buckets") - 1).cast("bigint"))
    sums = h.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.withColumn(
        "_before", F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_sum")
    inside = W.partitionBy("source", "_bucket").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    return (
        h.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(before, ["source", "_bucket"])
        .select("doc_id", "source", "n_tokens", (F.col("_before") + F.col("_in")).alias("start"))
    )


def sized(docs: DataFrame, targets: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with a text of the sources in ``targets``.

    A text that is not empty has a token.
    """
    names = small_rows(targets.select("source").dropna().distinct(), MAX_TARGETS)
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r[0],) for r in names], "source string"))
    usable = docs.filter("text IS NOT NULL AND text <> ''").join(wanted, "source", "left_semi")
    return token_counts(usable.select(F.struct("doc_id", "source").alias("k"), "text"), "k", "text", ranks_path).select("k.*", "n_tokens")


def mix(counted: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rows of the mixes, their plan) from counted documents and targets.

    A mix row is (mix_name, slot, start, doc_id, source, repeat_no, n_tokens);
    a mix is read in order of slot and start.  ``counted`` is used twice.
    """
    rows_of = counted.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n")).join(
        F.broadcast(targets.select("source").distinct()), "source", "left_semi"
    )
    sizes = small_rows(rows_of, MAX_TARGETS)
    rows, slots = plan(
        [tuple(r) for r in small_rows(targets.select("mix_name", "source", "target_share", "max_repeats").dropna(), MAX_TARGETS)],
        {r["source"]: int(r["size"]) for r in sizes},
    )
    spark = counted.sparkSession
    planned = spark.createDataFrame(rows, PLAN)
    cut = spark.createDataFrame([(r["source"], 1 + r["n"] // BUCKET_DOCS) for r in sizes], "source string, buckets bigint")
    taken = offsets(counted.join(F.broadcast(cut), "source")).join(F.broadcast(planned), "source")
    passes = F.sequence(F.lit(0), F.expr("CAST((quota - 1) DIV size AS INT)"))
    used = (
        taken.filter("quota > 0").withColumn("repeat_no", F.explode(passes))
        .withColumn("start", F.col("repeat_no") * F.col("size") + F.col("start"))
        .filter("start < quota")
        .withColumn("_block", F.floor(F.col("start") / F.lit(block_tokens)).cast("bigint"))
        .withColumn("_k", (F.col("_block") % F.col("weight")).cast("int"))
    )
    # one period of every mix: SLOTS rows, more only with more sources than a small list has
    at = F.broadcast(spark.createDataFrame(slots, "mix_name string, source string, _k int, _slot int"))
    slotted = used.join(at, ["mix_name", "source", "_k"]).withColumn("slot", F.expr("(_block DIV weight) * period + _slot"))
    return slotted.select("mix_name", "slot", "start", "doc_id", "source", "repeat_no", "n_tokens"), planned


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mix(materialise(sized(table(spark, sf_dir, "documents"), targets)), targets)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix with their slots."""
    return _mixed(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source of every mix.

    Sources that a mix names but that have no documents reach 0.
    """
    used, _ = _mixed(spark, sf_dir)
    got = used.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_documents"), (F.max("repeat_no") + 1).alias("n_repeats"))
    whole = got.withColumn("share", F.col("tokens") / F.sum("tokens").over(W.partitionBy("mix_name")))
    asked = table(spark, sf_dir, "mix_targets").filter("source IS NOT NULL")
    return asked.join(whole, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", F.coalesce("share", F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"), "max_repeats",
    )
