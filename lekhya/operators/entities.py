"""Extraction answers to entities, entities to workflows.

The model that answers is injected; parsing, validation, cleaning and
aggregation are columns.  Answers are parsed as VARIANT, so that a number in
the place of a text is seen as what it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.functions.chunks import clause_ref
from lekhya.functions.text import contains_any, strip, to_int, word_count
from lekhya.io import numbered
from lekhya.rules import NEPALI, RulePack

TEXT_FIELDS = ("office", "price", "duration_days", "prerequisites")
LIST_FIELDS = ("documents_required", "steps")
FEE = "struct<type string, amount_raw string, amount_npr bigint>"
OFFICE = "struct<name string, level string>"
NONE = "array<string>"


# --- answers ---------------------------------------------------------------

#: Words that a step must have to be kept.
MIN_STEP_WORDS = 4


def unfenced(content: Column) -> Column:
    """The JSON of an answer: no code fence, no commas before a closing bracket."""
    out = strip(content)
    out = F.when(out.startswith("```json"), F.substring(out, 8, 2**31 - 1)).otherwise(out)
    out = F.when(out.startswith("```"), F.substring(out, 4, 2**31 - 1)).otherwise(out)
    out = F.when(out.endswith("```"), F.left(out, F.length(out) - 3)).otherwise(out)
    return F.regexp_replace(strip(out), r"(?U),\s*([}\]])", "$1")


def _kind(v: Column, path: str) -> Column:
    """Type of a field: STRING, OBJECT, ..., VOID for null, null for absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _list(v: Column, path: str, keep: Callable[[Column], Column]) -> Column:
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.filter(texts, lambda t: t.isNotNull() & keep(t))


def parse_answer(content: Column) -> Column:
    """The fields of an answer as text; see ``parse_variant``."""
    return parse_variant(F.try_parse_json(unfenced(content)))


def parse_variant(v: Column) -> Column:
    """struct of the six fields of a parsed answer, or null if it is not valid.

    Invalid are: no JSON object, or a text field that is neither text nor null.
    The office may be an object with a name.  Documents of two characters or
    less and steps of one word are left out; a list that is none is empty.
    """
    office_kind = _kind(v, "$.office")
    filled = lambda x: F.when(x != "", x)
    inner = F.coalesce(filled(F.try_variant_get(v, "$.office.name", "string")), filled(F.try_variant_get(v, "$.office.office", "string")))
    office = F.when(F.coalesce(office_kind.startswith("OBJECT"), F.lit(False)), inner).otherwise(F.try_variant_get(v, "$.office", "string"))
    valid = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    for name in TEXT_FIELDS:
        kind = _kind(v, f"$.{name}")
        ok = F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
        valid = valid & (ok | F.coalesce(kind.startswith("OBJECT"), F.lit(False)) if name == "office" else ok)
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    return F.when(
        valid,
        F.struct(
            office.alias("office"), _list(v, "$.documents_required", lambda t: F.length(strip(t)) > 2).alias("documents_required"),
            _list(v, "$.steps", lambda t: word_count(t) >= 2).alias("steps"), text("price").alias("price"),
            text("duration_days").alias("duration_days"), text("prerequisites").alias("prerequisites"),
        ),
    )


# --- cleaning --------------------------------------------------------------


def _any(col: Column, patterns: tuple[str, ...]) -> Column:
    return col.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def clean_office(office: Column, rules: RulePack = NEPALI) -> Column:
    t = strip(office)
    return F.when(~_any(t, rules.office_rejects) & (F.length(t) >= 3), t)


def clean_documents(docs: Column, rules: RulePack = NEPALI) -> Column:
    kept = F.transform(F.coalesce(docs, F.array().cast(NONE)), strip)
    return F.filter(kept, lambda d: (F.length(d) > 2) & ~_any(d, rules.document_rejects) & ~d.isin(*rules.service_names))


def clean_steps(steps: Column) -> Column:
    return F.filter(F.transform(F.coalesce(steps, F.array().cast(NONE)), strip), lambda s: word_count(s) >= MIN_STEP_WORDS)


def clean_duration(duration: Column, rules: RulePack = NEPALI) -> Column:
    t = strip(duration)
    return F.when(contains_any(t, rules.time_words), t)


def clean_price(price: Column, rules: RulePack = NEPALI) -> Column:
    t = strip(price)
    return F.when(contains_any(t, rules.fee_words) & ~contains_any(t, rules.penalty_words), t)


def clean_prerequisites(text: Column) -> Column:
    t = strip(text)
    return F.when(F.length(t) >= 10, t)


def parse_fees(raw: Column, rules: RulePack = NEPALI) -> Column:
    """array<FEE> of a price text.

    First every amount after the currency, then every amount before it; an
    amount between two of them comes out twice.  A text without an amount is
    one fee without a number, null and blank texts give none.
    """

    def of(pattern: str) -> Column:
        whole, number = (F.regexp_extract_all(raw, F.lit("(?U)" + pattern), F.lit(i)) for i in (0, 1))
        return F.transform(
            F.arrays_zip(whole.alias("w"), number.alias("n")),
            lambda m: F.struct(F.lit(None).cast("string").alias("type"), m["w"].alias("amount_raw"), to_int(m["n"], "bigint").alias("amount_npr")),
        )

    fees = F.concat(of(rules.currency_before), of(rules.currency_after))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("type"), strip(raw).alias("amount_raw"), F.lit(None).cast("bigint").alias("amount_npr")))
    empty = F.array().cast(f"array<{FEE}>")
    return F.when(F.coalesce(strip(raw), F.lit("")) == "", empty).when(F.size(fees) > 0, fees).otherwise(bare)


def parse_office(raw: Column, rules: RulePack = NEPALI) -> Column:
    """struct<name, level>; null for null and blank names."""
    t = strip(raw)
    level = (
        F.when(contains_any(t, rules.province_words), rules.levels["province"])
        .when(contains_any(t, rules.local_words), rules.levels["local"]).otherwise(rules.levels["centre"])
    )
    return F.when(F.coalesce(t, F.lit("")) != "", F.struct(t.alias("name"), level.alias("level")))


def has_entities(e: Column) -> Column:
    """Is any field of a cleaned answer filled?"""
    full = F.lit(False)
    for name in TEXT_FIELDS:
        full = full | (F.coalesce(e[name], F.lit("")) != "")
    for name in LIST_FIELDS:
        full = full | (F.size(F.coalesce(e[name], F.array().cast(NONE))) > 0)
    return full


def cleaned(answer: Column, rules: RulePack = NEPALI) -> Column:
    """The answer with every field cleaned; null stays null."""
    return F.when(
        answer.isNotNull(),
        F.struct(
            clean_office(answer["office"], rules).alias("office"), clean_documents(answer["documents_required"], rules).alias("documents_required"),
            clean_steps(answer["steps"]).alias("steps"), clean_price(answer["price"], rules).alias("price"),
            clean_duration(answer["duration_days"], rules).alias("duration_days"), clean_prerequisites(answer["prerequisites"]).alias("prerequisites"),
        ),
    )


# --- extraction ------------------------------------------------------------

Extractor = Callable[[str], str | None]


def no_model(text: str) -> str | None:
    """The default extractor: nothing is extracted."""
    return None


def resolve_model(wanted: str | None, installed: list[str]) -> str | None:
    """The installed model that is meant: the same name, else a longer one, else the first."""
    if wanted in installed:
        return wanted
    longer = [m for m in installed if wanted and m.startswith(wanted)]
    return (longer or installed or [None])[0]


def answers(chunks: DataFrame, extractor: Extractor = no_model, retries: int = 5, wait: Callable[[int], float] | None = None,
            delay: float = 0.0, again: Callable[[Exception], bool] | None = None) -> DataFrame:
    """``chunks`` with ``answer``: what the extractor says to each text.

    Blank texts are not asked.  A call is made ``retries`` times at most, with
    ``wait(attempt)`` seconds between, as long as ``again(error)`` holds (any
    error by default); then the answer is null.  A task waits ``delay`` seconds
    after every call.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import time

        def one(text: str | None) -> str | None:
            for attempt in range(1, retries + 1):
                try:
                    got = extractor(text)
                    if delay:
                        time.sleep(delay)
                    return got
                except Exception as error:  # noqa: BLE001 - ``again`` tells which failures of a model pass
                    if again is not None and not again(error):
                        break
                    if attempt < retries and wait is not None:
                        time.sleep(wait(attempt))
            return None

        for s in batches:
            yield s.map(one)

    return chunks.filter(strip(F.coalesce("text", F.lit(""))) != "").withColumn("answer", ask("text"))


def entities_of(answered: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """Entities of chunks with ``answer``: valid, cleaned and not empty."""
    e = F.col("_e")
    # step by step: each is used many times by the next
    parsed = answered.withColumn("_v", F.try_parse_json(unfenced(F.col("answer")))).withColumn("_p", parse_variant(F.col("_v")))
    got = parsed.withColumn("_e", cleaned(F.col("_p"), rules)).filter(e.isNotNull() & has_entities(e))
    keep = [c for c in ("act_slug", "ord") if c in answered.columns]
    return got.select(
        *keep, F.coalesce("id", F.lit("unknown")).alias("chunk_id"), clause_ref(F.col("hierarchy"), F.col("type")).alias("clause_ref"),
        parse_office(e["office"], rules).alias("office"), e["documents_required"].alias("documents_required"), e["steps"].alias("steps"),
        parse_fees(e["price"], rules).alias("price_fees"), e["duration_days"].alias("duration"), e["prerequisites"].alias("prerequisites"),
    )


# --- workflows -------------------------------------------------------------


def task_name(ref: Column, steps: Column, documents: Column, rules: RulePack = NEPALI) -> Column:
    """The task of the first rule that the path, steps and documents match."""
    text = F.concat_ws(" ", ref, steps, documents)
    out = None
    for pattern, name in rules.task_rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.lit(rules.default_task) if out is None else out.otherwise(rules.default_task)


def distinct_texts(items: Column) -> Column:
    """Stripped, not empty, each once, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != "")))


def _first_by(items: Column, key: Callable[[Column], Column], keep_empty: bool) -> Column:
    """Items whose key did not occur before; with an empty key all or none."""
    keys = F.transform(items, lambda x: F.coalesce(key(x), F.lit("")))
    numbered = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.coalesce(key(x), F.lit("")).alias("k")))
    kept = F.filter(numbered, lambda s: ((s["k"] == "") & F.lit(keep_empty)) | (F.array_position(keys, s["k"]) == s["i"] + 1))
    return F.transform(kept, lambda s: s["x"])


def distinct_fees(fees: Column) -> Column:
    """Each raw amount once; fees without one are all kept."""
    return _first_by(fees, lambda f: f["amount_raw"], True)


def distinct_offices(offices: Column) -> Column:
    """Each name once, with the level of its first occurrence."""
    return _first_by(offices, lambda o: o["name"], False)


def workflows(entities: DataFrame, group: str = "act_slug", order: str = "ord", rules: RulePack = NEPALI) -> DataFrame:
    """Entities of each act and task as one workflow.

    Lists are concatenated in order of the entities and each item kept once;
    the description is the first section title in a path.  Entities are reduced
    to distinct items per group before they are put in order, so a task that
    holds a third of all entities is no larger than its distinct items.
    """
    e = entities.withColumn("task_name", task_name(F.col("clause_ref"), F.col("steps"), F.col("documents_required"), rules))
    keys = [group, "task_name"]

    def texts(column: Column, name: str) -> DataFrame:
        rows = e.select(*keys, F.col(order).alias("_o"), F.posexplode(column).alias("_p", "_x")).select(*keys, "_o", "_p", strip(F.col("_x")).alias("_x"))
        first = rows.filter("_x IS NOT NULL AND _x <> ''").groupBy(*keys, "_x").agg(F.min(F.struct("_o", "_p")).alias("_at"))
        return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(name))

    def items(column: Column, key: Callable[[Column], Column], name: str, keep_empty: bool) -> DataFrame:
        rows = e.select(*keys, F.col(order).alias("_o"), F.posexplode(column).alias("_p", "_x")).withColumn("_k", F.coalesce(key(F.col("_x")), F.lit("")))
        rows = rows.withColumn("_u", F.when((F.col("_k") == "") & F.lit(keep_empty), F.struct("_o", "_p")))
        first = rows.filter((F.col("_k") != "") | F.lit(keep_empty)).groupBy(*keys, "_k", "_u").agg(
            F.min_by("_x", F.struct("_o", "_p")).alias("_x"), F.min(F.struct("_o", "_p")).alias("_at")
        )
        return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(name))

    title = F.regexp_extract("clause_ref", r"sec[0-9]+\s*\((.*?)\)", 1)
    has_title = F.col("clause_ref").rlike(r"sec[0-9]+\s*\((.*?)\)")
    one = lambda c: F.array(F.col(c))
    base = e.groupBy(*keys).agg(F.min_by(F.when(has_title, title), F.when(has_title, F.col(order))).alias("description"), F.min(order).alias("first_ord"), F.count("*").alias("n_entities"))
    out = base
    parts = [
        items(F.filter(one("office"), lambda o: o.isNotNull()), lambda o: o["name"], "offices", False),
        texts(F.col("documents_required"), "all_documents"), texts(F.col("steps"), "all_steps"),
        items(F.col("price_fees"), lambda f: f["amount_raw"], "all_fees", True),
        texts(one("duration"), "durations"), texts(one("prerequisites"), "prerequisites"),
    ]
    for p in parts:
        out = out.join(p, keys, "left")
    return out


def source_clauses(entities: DataFrame, group: str = "act_slug", order: str = "ord", rules: RulePack = NEPALI) -> DataFrame:
    """(act, task, position, chunk_id): what each workflow comes from, as rows."""
    e = entities.withColumn("task_name", task_name(F.col("clause_ref"), F.col("steps"), F.col("documents_required"), rules))
    return numbered(e, [group, "task_name"], order, "position").select(group, "task_name", "position", "chunk_id")
