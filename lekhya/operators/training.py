"""Training triples for an embedding model from chunks: queries, positives, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekhya.functions.chunks import breadcrumb
from lekhya.io import materialise
from lekhya.rules import NEPALI, RulePack

#: Queries of a definition and of a title; {} is the term or title.
DEFINITION_TEMPLATES = ("{} भन्नाले के बुझिन्छ?", "{} को परिभाषा के हो?")
TITLE_TEMPLATES = ("{} सम्बन्धी व्यवस्था के छ?", "{} बारे कानूनले के भन्छ?")
NEGATIVES = 5
DEV_PERCENT = 5
#: Rows of a part of a section, on average, and the shards in which acts are counted.
RING, SHARDS = 100_000, 1024


def _filled(templates: tuple[str, ...], value: Column) -> Column:
    return F.array(*[F.concat(*[p for part in t.split("{}") for p in (F.lit(part), value)][:-1]) for t in templates])


def definition_queries(chunks: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """(chunk_row_id, query) of every term defined in a text."""
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit("(?U)" + rules.definition), F.lit(1)))
    t = chunks.select("chunk_row_id", F.explode(terms).alias("term"))
    return t.select("chunk_row_id", F.explode(_filled(DEFINITION_TEMPLATES, F.col("term"))).alias("query"))


def title_queries(chunks: DataFrame) -> DataFrame:
    """(chunk_row_id, query) of section titles."""
    titled = chunks.filter(F.coalesce("hierarchy.sec_title", F.lit("")) != "")
    return titled.select("chunk_row_id", F.explode(_filled(TITLE_TEMPLATES, F.col("hierarchy.sec_title"))).alias("query"))


def reference_queries(chunks: DataFrame) -> DataFrame:
    """(chunk_row_id, query) of the reference texts in a chunk."""
    return chunks.select("chunk_row_id", F.explode(F.array_distinct(F.transform("refs", lambda r: r["text"]))).alias("query")).filter("query <> ''")


def positive_text(hierarchy: Column, text: Column, rules: RulePack = NEPALI) -> Column:
    """The text with its path before it."""
    return F.concat_ws(" | ", breadcrumb(hierarchy, rules), text)


def _before(amount: str, keys: list[str], order: list[str]) -> Column:
    """The sum of ``amount`` in the rows before this one."""
    return F.coalesce(F.sum(amount).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def placed(chunks: DataFrame, seed: int = 0) -> DataFrame:
    """(chunk_row_id, place, sec_0, sec_n, ch_0, ch_n, act_0, act_n, total).

    One order of all chunks, from 0, in which acts, their chapters and the
    sections of these are runs; ``x_0`` is the first place and ``x_n`` the size
    of a chunk's own run.  Runs are counted first and only counts are summed;
    large sections are numbered in parts of about RING rows.
    """
    act, ch, sec = ["act_slug"], ["act_slug", "ch"], ["act_slug", "ch", "sec"]
    keyed = chunks.select(
        "chunk_row_id", F.coalesce("act_slug", F.lit("")).alias("act_slug"), F.coalesce("hierarchy.ch", F.lit(-1)).alias("ch"),
        F.coalesce("hierarchy.sec", F.lit(-1)).alias("sec"), F.xxhash64(F.lit(seed), "chunk_row_id").alias("h"),
    )
    # at most one of RING rows is a large section
    large = keyed.groupBy(*sec).agg(F.ceil(F.count("*") / RING).alias("parts")).filter("parts > 1")
    keyed = keyed.join(F.broadcast(large), sec, "left").withColumn("part", F.pmod("h", F.coalesce("parts", F.lit(1)))).drop("h", "parts")
    parts = materialise(keyed.groupBy(*sec, "part").agg(F.count("*").alias("part_n")))
    secs = parts.groupBy(*sec).agg(F.sum("part_n").alias("sec_n"))
    chs = secs.groupBy(*ch).agg(F.sum("sec_n").alias("ch_n"))
    acts = chs.groupBy(*act).agg(F.sum("ch_n").alias("act_n")).withColumn("shard", F.pmod(F.xxhash64("act_slug"), F.lit(SHARDS)))
    shards = acts.groupBy("shard").agg(F.sum("act_n").alias("n")).withColumns({"shard_0": _before("n", [], ["shard"]), "total": F.sum("n").over(W.partitionBy())})
    acts = acts.withColumn("in_shard", _before("act_n", ["shard"], act)).join(F.broadcast(shards.drop("n")), "shard").withColumn("act_0", F.col("shard_0") + F.col("in_shard"))
    chs = chs.withColumn("in_act", _before("ch_n", act, ["ch"])).join(acts.select("act_slug", "act_0", "act_n", "total"), act).withColumn("ch_0", F.col("act_0") + F.col("in_act"))
    secs = secs.withColumn("in_ch", _before("sec_n", ch, ["sec"])).join(chs, ch).withColumn("sec_0", F.col("ch_0") + F.col("in_ch"))
    runs = parts.withColumn("in_sec", _before("part_n", sec, ["part"])).join(secs, sec)
    inside = F.row_number().over(W.partitionBy(*sec, "part").orderBy("chunk_row_id")) - 1
    place = F.col("sec_0") + F.col("in_sec") + F.col("_in")
    return keyed.withColumn("_in", inside).join(runs, [*sec, "part"]).select("chunk_row_id", place.alias("place"), "sec_0", "sec_n", "ch_0", "ch_n", "act_0", "act_n", "total")


def negatives(chunks: DataFrame, seed: int = 0, n: int = NEGATIVES) -> DataFrame:
    """(chunk_row_id, negative_id, hard) for every chunk: n, or all where fewer exist.

    Half of them, at least, are hard: of the same act and chapter but another
    section; the rest come from other acts.  What a chapter has too few of is
    filled from other acts, what these lack from other chapters of the act and
    then by more hard ones.  The choice follows hashes: the candidates are the
    places outside a run in the order of ``placed``, cut into as many pieces as
    are wanted, and a hash picks a place in each; no pairs are formed.
    """
    rows = materialise(placed(chunks, seed))
    zero, wanted = F.lit(0).cast("bigint"), F.lit(n).cast("bigint")
    counted = (
        rows.withColumn("_first", F.least(F.lit((n + 1) // 2).cast("bigint"), F.col("ch_n") - F.col("sec_n")))
        .withColumn("_acts", F.least(wanted - F.col("_first"), F.col("total") - F.col("act_n")))
        .withColumn("_chs", F.least(wanted - F.col("_first") - F.col("_acts"), F.col("act_n") - F.col("ch_n")))
        .withColumn("_hard", F.least(wanted - F.col("_acts") - F.col("_chs"), F.col("ch_n") - F.col("sec_n")))
    )

    def picks(k: str, inner: str, start: Column, size: Column, hard: bool) -> Column:
        """k places of the run of ``size`` rows at ``start`` that are not in the run ``inner``."""
        count, free = F.col(k), size - F.col(f"{inner}_n")

        def pick(j: Column) -> Column:
            low, high = F.floor(j * free / count), F.floor((j + 1) * free / count)
            at = low + F.pmod(F.xxhash64(F.lit(seed), F.lit(inner), "chunk_row_id", j), high - low)
            after = F.col(f"{inner}_0") + F.col(f"{inner}_n") - start
            return F.struct((start + F.pmod(after + at, size)).alias("place"), F.lit(hard).alias("hard"))

        return F.when(count > 0, F.transform(F.sequence(zero, count - 1), pick)).otherwise(F.array().cast("array<struct<place:bigint,hard:boolean>>"))

    wishes = F.concat(
        picks("_hard", "sec", F.col("ch_0"), F.col("ch_n"), True), picks("_acts", "act", zero, F.col("total"), False),
        picks("_chs", "ch", F.col("act_0"), F.col("act_n"), False),
    )
    asked = counted.select("chunk_row_id", F.explode(wishes).alias("p")).select("chunk_row_id", "p.place", "p.hard")
    return asked.join(rows.select("place", F.col("chunk_row_id").alias("negative_id")), "place").select("chunk_row_id", "negative_id", "hard")


def split_of(key: Column, seed: int = 0, dev_percent: int = DEV_PERCENT) -> Column:
    """"dev" for about ``dev_percent`` of the keys, by hash, else "train"."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(100)) < dev_percent, "dev").otherwise("train")


def triples(chunks: DataFrame, seed: int = 0, rules: RulePack = NEPALI) -> DataFrame:
    """(query, pos, neg, meta, split) of the definition and title queries."""
    queries = definition_queries(chunks, rules).unionByName(title_queries(chunks))
    texts = chunks.select("chunk_row_id", "id", positive_text(F.col("hierarchy"), F.col("text"), rules).alias("positive"))
    neg = negatives(chunks, seed).join(texts.select(F.col("chunk_row_id").alias("negative_id"), F.col("positive").alias("negative")), "negative_id")
    lists = neg.groupBy("chunk_row_id").agg(F.array_sort(F.collect_set("negative")).alias("neg"))
    got = queries.join(texts, "chunk_row_id").join(lists, "chunk_row_id", "left")
    return got.select(
        "query", F.array("positive").alias("pos"), F.coalesce("neg", F.array().cast("array<string>")).alias("neg"),
        F.struct(F.lit("chunks").alias("source"), F.col("id").alias("chunk_id")).alias("meta"), split_of(F.col("query"), seed).alias("split"),
    )


def mined_negatives(hits: DataFrame, positives: DataFrame) -> DataFrame:
    """Search hits (qid, docid, rank) that are not among the positives (qid, docid)."""
    return hits.join(positives.select("qid", "docid"), ["qid", "docid"], "left_anti")
