"""Facts on the front pages of an act: title, year, type, dates, amendments.

The front matter is a short list of lines, so everything is a function of one
array column; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.functions.text import strip, to_int
from lekhya.rules import DIGIT, NEPALI, RulePack

UNKNOWN_TITLE = "Unknown Act"


def front_lines(text: Column) -> Column:
    """The stripped lines that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


def _found(text: Column, pattern: str) -> Column:
    got = F.regexp_extract(text, "(?U)" + pattern, 1)
    return F.when(got != "", got)


def year_in(text: Column) -> Column:
    """The first run of four digits as a number."""
    return to_int(_found(text, f"({DIGIT}{{4}})"))


def doc_type(line: Column, rules: RulePack = NEPALI) -> Column:
    """The type of the first keyword, in the pack's order, that the line contains.

    A keyword inside a longer one comes first where it stands first.
    """
    out = None
    for word, kind in rules.doc_types:
        out = F.when(line.contains(word), kind) if out is None else out.when(line.contains(word), kind)
    return out


def title_struct(lines: Column, rules: RulePack = NEPALI) -> Column:
    """struct<title, bs_year, type>."""
    named = F.get(F.filter(F.slice(lines, 1, 10), lambda x: x.contains(rules.title_word) & x.rlike(f"{DIGIT}{{4}}")), F.lit(0))
    other = F.get(
        F.filter(F.transform(F.slice(lines, 1, 15), lambda x, i: F.struct(x.alias("line"), i.alias("i"), doc_type(x, rules).alias("type"))), lambda x: x["type"].isNotNull()),
        F.lit(0),
    )
    alone = F.get(F.filter(F.transform(F.slice(lines, other["i"] + 2, 3), lambda x: to_int(_found(x, f"^[^0-9०-९]*({DIGIT}{{4}})[^0-9०-९]*$"))), lambda y: y.isNotNull()), F.lit(0))
    return (
        F.when(named.isNotNull(), F.struct(named.alias("title"), year_in(named).alias("bs_year"), F.lit("act").alias("type")))
        .when(other.isNotNull(), F.struct(other["line"].alias("title"), F.coalesce(year_in(other["line"]), alone).alias("bs_year"), other["type"].alias("type")))
        .otherwise(F.struct(F.lit(UNKNOWN_TITLE).alias("title"), F.lit(None).cast("int").alias("bs_year"), F.lit("act").alias("type")))
    )


def date_of(lines: Column, field: str, rules: RulePack = NEPALI) -> Column:
    """The first value at a label of ``field`` among the first 20 lines.

    It stands on the label's line or one of the next two; spaces are removed.
    """
    labels = "|".join(p for p, f in rules.date_labels if f == field)
    here = F.transform(
        F.slice(lines, 1, 20),
        lambda x, i: F.when(
            x.rlike("(?U)" + labels),
            F.coalesce(_found(x, rules.date_value), _found(F.get(lines, i + 1), rules.date_value), _found(F.get(lines, i + 2), rules.date_value)),
        ),
    )
    return F.replace(F.get(F.filter(here, lambda v: v.isNotNull()), F.lit(0)), F.lit(" "), F.lit(""))


def amended_refs(lines: Column, rules: RulePack = NEPALI) -> Column:
    """array<struct<ref, date>> of the list after the amendment phrase.

    An entry begins at a number; other lines continue it; the list ends at a
    structural line.  Lines with the phrase are never part of it.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("done"), none.alias("cur"), none.alias("out"))
    stop = "|".join(rules.amendment_stop)

    def flush(s: Column) -> Column:
        return F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(F.array_join(s["cur"], " ")))).otherwise(s["out"])

    def state(on: Column, done: Column, cur: Column, out: Column) -> Column:
        return F.struct(on.alias("on"), done.alias("done"), cur.alias("cur"), out.alias("out"))

    def step(s: Column, line: Column) -> Column:
        return (
            F.when(s["done"], s)
            .when(line.contains(rules.amendment), state(F.lit(True), s["done"], s["cur"], s["out"]))
            .when(~s["on"], s)
            .when(line.rlike(rf"(?U)^{DIGIT}+\.\s"), state(s["on"], s["done"], F.array(line), flush(s)))
            .when(line.rlike(stop), state(s["on"], F.lit(True), s["cur"], s["out"]))
            .otherwise(state(s["on"], s["done"], F.concat(s["cur"], F.array(line)), s["out"]))
        )

    def entry(full: Column) -> Column:
        date = F.regexp_extract(full, "(?U)" + rules.date_value, 1)
        name = F.when(date != "", F.regexp_extract(full, "(?sU)^(.*?)" + rules.date_value, 1)).otherwise(full)
        ref = strip(F.regexp_replace(name, rf"(?U)^{DIGIT}+\.\s*", ""))
        return F.struct(ref.alias("ref"), F.replace(date, F.lit(" "), F.lit("")).alias("date"))

    return F.transform(F.aggregate(lines, start, step, flush), entry)


def extract(docs: DataFrame, text: str = "text", rules: RulePack = NEPALI) -> DataFrame:
    """``docs`` with ``act_metadata`` from the front text; null texts are unknown acts."""
    d = docs.withColumn("_l", front_lines(F.col(text)))
    d = d.withColumn("_t", title_struct(F.col("_l"), rules)).withColumn("_c", date_of(F.col("_l"), "date_commenced", rules))
    d = d.withColumn("_p", date_of(F.col("_l"), "date_published", rules))
    year = F.coalesce(F.col("_t.bs_year"), year_in(F.coalesce("_c", "_p")))
    meta = F.struct(
        F.col("_t.title").alias("title"), F.lit("").alias("number"), year.alias("bs_year"), F.col("_p").alias("date_published"),
        F.col("_c").alias("date_commenced"), F.col("_t.type").alias("type"), F.lit("").alias("source"), F.lit("ne").alias("lang"),
        amended_refs(F.col("_l"), rules).alias("amended_refs"),
    )
    return d.withColumn("act_metadata", meta).drop("_l", "_t", "_c", "_p")
