"""References whose target does not exist at the time of the reference.

Two passes of the same idea, an as-of match of a sorted integer against the
start of the preceding contiguous run, with a report beyond the run's end:

1. ``missing_keys``: the parents' integer keys per group are compressed into
   runs of consecutive numbers; a referenced number behind a run's end was
   never there.  A key of text is the text before its last number and that
   number, so numbered ids are runs as well.
2. ``orphans``: a parent's life is a run of instants from its loading to its
   deletion, its start and end being microseconds as integers; a reference
   whose instant lies behind the end of the runs that began before it finds no
   living parent.

Hot keys: groups are cut into stretches of SPAN numbers.  Both sides of the
match in time are reduced to distinct instants of a key before they meet, and
the match works in buckets of a day with the last state of earlier days carried
over.  A key of more than HOT_ROWS references is cut into tenths of a second
below the day, which hold 100,000 instants at most, so that no window depends
on the number of rows, were all of them loaded at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekhya.io import materialise, table

#: Instants per bucket of the as-of match: one day of microseconds, and a tenth of a second for hot keys.
DAY, TENTH = 86_400_000_000, 100_000
#: Rows of a key from which it is hot, and numbers of a stretch of a group.
HOT_ROWS, SPAN = 100_000, 65_536
#: The end of a run that is still going on.
OPEN = 2**62


def micros(name: str) -> Column:
    """A timestamp column of either kind as an integer, in the session's zone."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def integer_runs(parents: DataFrame, group: list[str], key: str) -> DataFrame:
    """Distinct integers of ``key`` per group as runs (run_start, run_end)."""
    w = W.partitionBy(*group).orderBy(key)
    return (
        parents.select(*group, key).dropna(subset=[key]).distinct()
        .withColumn("_island", F.col(key) - F.row_number().over(w))
        .groupBy(*group, "_island")
        .agg(F.min(key).alias("run_start"), F.max(key).alias("run_end"))
        .drop("_island")
    )


def missing_keys(refs: DataFrame, runs: DataFrame, group: list[str], key: str) -> DataFrame:
    """Distinct (group, key) of ``refs`` behind the end of the preceding run."""
    asked = refs.select(*group, key).dropna(subset=[key]).distinct()
    both = asked.select(*group, F.col(key).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_end")).unionByName(
        runs.select(*group, F.col("run_start").alias("_at"), F.lit(0).alias("_side"), F.col("run_end").cast("bigint").alias("_end"))
    )
    w = W.partitionBy(*group).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    matched = both.withColumn("_end", F.last("_end", ignorenulls=True).over(w)).filter("_side = 1")
    return matched.filter(F.col("_end").isNull() | (F.col("_at") > F.col("_end"))).select(*group, F.col("_at").alias(key))


def running_end(events: DataFrame, keys: list[str], widths: tuple[int, ...]) -> DataFrame:
    """``events(keys, _at, _side, _end)`` with ``_end``: the greatest up to each, runs (side 0) before references.

    Instants fall into buckets of the first width, these into buckets of the
    next; each level is a window over buckets with the state carried over.
    """
    if not widths:
        w = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
        return events.withColumn("_end", F.max("_end").over(w))
    b = f"_b{len(widths)}"
    cut = events.withColumn(b, F.floor(F.col("_at") / F.lit(widths[0])).cast("bigint"))
    ends = cut.groupBy(*keys, b).agg(F.max("_end").alias("_own"))
    w = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    before = ends.select(*keys, b, F.max("_own").over(w).alias("_before"))
    inside = running_end(cut, [*keys, b], widths[1:]).filter("_side = 1")
    joined = inside.join(before, [*keys, b])
    return joined.select(*[c for c in events.columns if c != "_end"], F.greatest("_end", "_before").alias("_end"))


def asof_end(left: DataFrame, runs: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``left`` with ``run_end``: the latest end among runs begun at or before ``at``.

    ``runs`` has ``keys``, run_start and run_end as integers.  Rows with a null
    key or instant get a null end.  ``left`` is used twice.
    """
    begun = runs.groupBy(*keys, F.col("run_start").alias("_at")).agg(F.max("run_end").alias("_end")).select(*keys, "_at", F.lit(0).alias("_side"), "_end")
    asked = left.select(*keys, F.col(at).alias("_at")).dropna().groupBy(*keys, "_at").agg(F.count("*").alias("_n"))
    asked = materialise(asked)
    events = asked.select(*keys, "_at", F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_end")).unionByName(begun)
    hot = asked.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS).select(*keys)
    if hot.isEmpty():
        ended = running_end(events, keys, (DAY,))
    else:
        hot = materialise(hot)
        cool = running_end(events.join(hot, keys, "left_anti"), keys, (DAY,))
        ended = cool.unionByName(running_end(events.join(hot, keys, "left_semi"), keys, (DAY, TENTH)))
    found = ended.filter("_side = 1").select(*keys, F.col("_at").alias(at), F.col("_end").alias("run_end"))
    return left.join(found, [*keys, at], "left").select(*left.columns, "run_end")


def lives(chunks: DataFrame, deletions: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every chunk row with the run of instants it lives.

    The end is the first deletion of the id at or after the loading; it is
    found by the same day buckets, looking forward on negated instants.
    """
    # first deletion >= loaded  ==  as-of match on the negated axis
    gone = deletions.select(F.col("chunk_id").alias("id"), (-micros("deleted_at")).alias("run_start")).dropna().distinct()
    gone = gone.withColumn("run_end", F.col("run_start"))
    rows = (
        chunks.filter(F.col("loaded_at").isNotNull())
        .select("id", *[c for c in keep if c != "id"], micros("loaded_at").alias("_loaded"))
        .withColumn("_neg", -F.col("_loaded"))
    )
    deleted = gone.select("id").distinct()
    never = rows.join(deleted, "id", "left_anti").withColumn("run_end", F.lit(OPEN))
    dated = asof_end(rows.join(deleted, "id", "left_semi"), gone, ["id"], "_neg").withColumn("run_end", F.coalesce(-F.col("run_end"), F.lit(OPEN)))
    out = [*keep, F.col("_loaded").alias("run_start"), "run_end"]
    return never.select(*out).unionByName(dated.select(*out))


#: A target key: a group, as 128 bits of hash, and a number in it.
GROUP = ["g1", "g2"]
KEY = [*GROUP, "num"]
#: The text before the last number of an id, and that number without leading zeros.
_NUMBERED = r"(?s)^(.*?)([1-9][0-9]{0,17})?$"


def _key(kind: str | Column, owner: Column, scope: Column | None = None, num: Column | None = None, name: Column | None = None) -> Column:
    """struct<g1, g2, num>; parts that a kind does not use are empty."""
    number = (F.lit(-1) if num is None else F.coalesce(num, F.lit(-1))).cast("bigint")
    parts = (
        F.lit(kind) if isinstance(kind, str) else kind, owner, F.coalesce(F.lit(-1) if scope is None else scope.cast("bigint"), F.lit(-1).cast("bigint")).cast("bigint"),
        F.lit("") if name is None else name, F.floor(number / F.lit(SPAN)).cast("bigint"),
    )
    return F.struct(F.xxhash64(*parts).alias("g1"), F.xxhash64(F.lit(1), *parts).alias("g2"), number.alias("num"))


def _id_key(ident: Column) -> Column:
    tail = F.regexp_extract(ident, _NUMBERED, 2)
    return _key("id", F.regexp_extract(ident, _NUMBERED, 1), num=F.when(tail != "", tail.cast("bigint")))


def parent_keys(chunks: DataFrame, deletions: DataFrame) -> DataFrame:
    """Every key that a chunk row can be the target of, with its runs of life.

    Rows of equal key and end are one run from the earliest start, so reloads
    of a chunk, or a chapter of a million chunks, are a handful of rows.
    """
    h = chunks.select(
        "id", "loaded_at", "act_slug", F.col("hierarchy.ch").alias("ch"), F.col("hierarchy.sec").alias("sec"),
        F.col("hierarchy.sub").alias("sub"), F.col("hierarchy.clause").alias("clause"),
        F.coalesce(F.col("type").startswith("anusuchi"), F.lit(False)).alias("annex"),
    )
    lived = lives(h, deletions, ["id", "act_slug", "ch", "sec", "sub", "clause", "annex"])
    c = F.col
    act = c("act_slug").isNotNull()
    keys = F.array(
        F.when(c("id").isNotNull(), _id_key(c("id"))),
        F.when(act & c("sec").isNotNull(), _key("sec", c("act_slug"), num=c("sec"))),
        F.when(act & c("ch").isNotNull() & ~c("annex"), _key("ch", c("act_slug"), num=c("ch"))),
        F.when(act & c("sub").isNotNull(), _key("sub", c("act_slug"), c("sec"), c("sub"))),
        F.when(act & c("clause").isNotNull(), _key("cl", c("act_slug"), c("sec"), name=c("clause"))),
    )
    exploded = lived.select(F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k"), "run_start", "run_end").select("k.*", "run_start", "run_end")
    return exploded.groupBy(*KEY, "run_end").agg(F.min("run_start").alias("run_start"))


def references(chunks: DataFrame, entities: DataFrame, acts: DataFrame) -> DataFrame:
    """(src_table, src_id, ref_pos, at, target key) of every reference with an id.

    A malformed id, or a prefix of no act, has a null key: it leads nowhere.
    """
    rx = r"^(.*)-(sec|ch|sub|cl)([^-]+)$"
    refs = chunks.select(
        "chunk_row_id", "loaded_at", F.col("hierarchy.sec").alias("sec"), F.posexplode("refs").alias("ref_pos", "r")
    ).select("chunk_row_id", "loaded_at", "sec", "ref_pos", F.col("r.id").alias("rid")).filter("rid IS NOT NULL")
    parts = refs.select(
        "*", F.regexp_extract("rid", rx, 1).alias("prefix"), F.regexp_extract("rid", rx, 2).alias("kind"), F.regexp_extract("rid", rx, 3).alias("tail")
    )
    num = F.when(F.col("kind").isin("sec", "ch", "sub"), F.expr("try_cast(tail AS bigint)"))
    known = acts.select(
        F.concat_ws("-", "act_slug", F.coalesce(F.col("bs_year").cast("string"), F.lit("None"))).alias("prefix"), "act_slug"
    ).filter("act_slug IS NOT NULL").distinct()
    inner = F.when(F.col("kind").isin("sub", "cl"), F.col("sec"))
    led = F.col("act_slug").isNotNull() & (F.col("kind").eqNullSafe("cl") | F.col("num").isNotNull())
    clause = F.when(F.col("kind") == "cl", F.col("tail")).otherwise(F.lit(""))
    chunk_refs = parts.withColumn("num", num).join(known, "prefix", "left").select(
        F.lit("chunks").alias("src_table"), F.col("chunk_row_id").alias("src_id"), F.col("ref_pos").cast("int").alias("ref_pos"), micros("loaded_at").alias("at"),
        F.when(led, _key(F.col("kind"), F.col("act_slug"), inner, F.col("num"), clause)).alias("k"),
    )
    ents = entities.filter("chunk_id IS NOT NULL").select(
        F.lit("entities").alias("src_table"), F.col("entity_id").alias("src_id"), F.lit(0).alias("ref_pos"), micros("extracted_at").alias("at"), _id_key(F.col("chunk_id")).alias("k")
    )
    return chunk_refs.unionByName(ents).select("src_table", "src_id", "ref_pos", "at", "k.*")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a living target, with a reason.

    ``never``: no such key at any time; ``dead``: there, but not at the
    reference's instant (deleted before, or loaded later).  A null instant has
    no living target.  Repeated references are reported each.
    """
    nowhere = refs.filter("g1 IS NULL").withColumn("reason", F.lit("never"))
    led = refs.filter("g1 IS NOT NULL")
    never = missing_keys(led, integer_runs(parents, GROUP, "num"), GROUP, "num").withColumn("_never", F.lit(True))
    marked = led.join(never, KEY, "left")
    gone = marked.filter("_never").withColumn("reason", F.lit("never"))
    there = asof_end(marked.filter("_never IS NULL").drop("_never"), parents, KEY, "at")
    dead = there.filter(F.col("at").isNull() | F.col("run_end").isNull() | (F.col("run_end") <= F.col("at")))
    cols = ["src_table", "src_id", "ref_pos", "at", "reason"]
    return nowhere.select(*cols).unionByName(gone.select(*cols)).unionByName(dead.withColumn("reason", F.lit("dead")).select(*cols))


def _orphans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    refs = references(chunks, table(spark, sf_dir, "entities"), table(spark, sf_dir, "acts"))
    # references and keys are read by both passes
    return orphans(materialise(refs), materialise(parent_keys(chunks, table(spark, sf_dir, "chunk_deletions"))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference that leads to no chunk living at its time."""
    return _orphans_of(spark, sf_dir).select("src_table", "src_id", F.col("ref_pos").cast("int").alias("ref_pos"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return _orphans_of(spark, sf_dir).groupBy("src_table", month.alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
