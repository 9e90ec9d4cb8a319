"""Text of an act to the table of its chunks.

The structure of an act is a nesting of islands of lines: a chapter or annex
opens an island of chapters, inside it a section one of sections, and so on.
Every line is classified by patterns, running counts of the openers number the
islands, and a value holds exactly inside its island.  All windows are per
document, so documents are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekhya.functions.text import clean, literal, slug_prefix, strip, to_int, token_estimate
from lekhya.rules import DIGIT, NEPALI, RulePack

_J = "(?dU)"  # Java: only \n ends a line, classes are Unicode's


def pages_to_text(pages: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """pages(doc, page_no, text) cleaned page by page and joined in order: (doc, text)."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", clean(F.col("text"), rules).alias("t"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(rows, lambda p: p["t"]), "\n").alias("text"))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, pos, line) of the lines of ``docs(doc, text)`` that are not blank."""
    rows = docs.select("doc", F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    return rows.select("doc", "pos", strip(F.col("raw")).alias("line")).filter("line <> ''")


def content(lines: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """The lines from where the content begins, with ``plain``: not to be classified.

    Content begins at a structural word, a gazette word (that line is plain), a
    number unless an amendment list has begun, or after ``front_lines`` lines.
    Lines that begin with the amendment phrase never begin it.
    """
    w = W.partitionBy("doc").orderBy("pos")
    line = F.col("line")
    amends = line.startswith(rules.amendment)
    word = F.lit(False)
    for s in rules.starts:
        word = word | line.startswith(s)
    for s in rules.start_contains:
        word = word | line.contains(s)
    numbered = line.rlike(rf"^{DIGIT}+\.|^\({DIGIT}+\)")
    marked = lines.withColumn("_n", F.row_number().over(w)).withColumn(
        "_seen", F.coalesce(F.max(amends.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    )
    gazette = line.isin(*rules.gazette_words) & ~word
    begins = ~amends & (word | gazette | (numbered & ~F.col("_seen")) | (F.col("_n") > rules.front_lines))
    found = marked.withColumn("_start", F.min(F.when(begins, F.col("pos"))).over(W.partitionBy("doc")))
    return found.filter("pos >= _start").select("doc", "pos", "line", ((F.col("pos") == F.col("_start")) & gazette).alias("plain"))


def _group(pattern: str, group: int) -> Column:
    return F.regexp_extract("line", _J + pattern, group)


def blocks(lines: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """One row per block of lines with the values of its islands.

    (doc, block, text, annex, ch, ch_title, sec, sec_title, sub, clause)
    """
    line, free = F.col("line"), ~F.col("plain")
    w = W.partitionBy("doc").orderBy("pos")
    t = lines.withColumn("a", free & line.rlike(_J + rules.annex))
    t = t.withColumn("c", free & ~F.col("a") & line.rlike(_J + rules.chapter))
    t = t.withColumn("ch_island", F.sum((F.col("a") | F.col("c")).cast("int")).over(w))
    island = W.partitionBy("doc", "ch_island")
    t = t.withColumn("in_chapter", F.max("c").over(island))
    may_title = free & F.col("in_chapter") & ~F.col("c") & ~line.rlike(rf"^{DIGIT}+\.")
    t = t.withColumn("t", may_title & (F.sum(may_title.cast("int")).over(island.orderBy("pos")) == 1))
    open_ = free & ~F.col("a") & ~F.col("c") & ~F.col("t")
    t = t.withColumn("s", open_ & line.rlike(_J + rules.section))
    t = t.withColumn("u", open_ & ~F.col("s") & line.rlike(_J + rules.subsection))
    t = t.withColumn("k", open_ & ~F.col("s") & ~F.col("u") & line.rlike(_J + rules.clause))
    chapter = F.col("a") | F.col("c")
    t = t.withColumn("sec_island", F.sum((chapter | F.col("s")).cast("int")).over(w))
    t = t.withColumn("sub_island", F.sum((chapter | F.col("s") | F.col("u")).cast("int")).over(w))
    t = t.withColumn("block", F.sum((chapter | F.col("s") | F.col("u") | F.col("k")).cast("int")).over(w))

    def held(value: Column, flag: Column, over: str) -> Column:
        return F.max(F.when(flag, value)).over(W.partitionBy("doc", over))

    annex_no = F.when(_group(rules.annex, 1) == "", F.lit(1)).otherwise(to_int(_group(rules.annex, 1)))
    annex_clause = F.when(_group(rules.annex, 2) != "", _group(rules.annex, 2))
    t = (
        t.withColumn("ch", held(F.when(F.col("a"), annex_no).otherwise(to_int(_group(rules.chapter, 1))), chapter, "ch_island"))
        .withColumn("annex", F.max("a").over(island))
        .withColumn("title_block", held(F.col("block"), F.col("t") | F.col("a"), "ch_island"))
        .withColumn("title", held(line, F.col("t") | F.col("a"), "ch_island"))
        .withColumn("sec", held(to_int(_group(rules.section, 1)), F.col("s"), "sec_island"))
        .withColumn("sec_title", held(strip(_group(rules.section, 2)), F.col("s"), "sec_island"))
        .withColumn("sub", held(to_int(_group(rules.subsection, 1)), F.col("u"), "sub_island"))
        .withColumn("clause", held(F.when(F.col("a"), annex_clause).otherwise(_group(rules.clause, 1)), F.col("a") | F.col("k"), "block"))
    )
    body = F.array_sort(F.collect_list(F.when(~F.col("c") & ~F.col("t"), F.struct("pos", "line"))))
    # all lines of a block share its values
    one = [F.first(x).alias(x) for x in ("annex", "ch", "title", "title_block", "sec", "sec_title", "sub", "clause")]
    return (
        t.groupBy("doc", "block").agg(F.array_join(F.transform(body, lambda x: x["line"]), " ").alias("text"), *one)
        .withColumn("ch_title", F.when(F.col("block") >= F.col("title_block"), F.col("title")))
        .drop("title", "title_block")
    )


def extract_references(text: Column, prefix: Column, rules: RulePack = NEPALI) -> Column:
    """array<struct<type, id, text>> of the references in a text; null if none.

    Only the first number after a keyword counts.  A clause is of type
    subsection, as in the data the ids come from.
    """
    pattern = F.lit("(?U)" + rules.reference)
    found = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(i)).alias(n) for i, n in enumerate(("whole", "word", "value"))])
    codes = F.create_map(*[F.lit(x) for pair in rules.reference_codes.items() for x in pair])

    def one(r: Column) -> Column:
        code = codes[r["word"]]
        value = F.regexp_replace(r["value"], r"(?U)[()\s]", "")
        tail = F.when(code == "cl", value).otherwise(F.coalesce(to_int(value).cast("string"), value))
        kind = F.when(code == "sec", "section").when(code == "ch", "chapter").otherwise("subsection")
        return F.struct(kind.alias("type"), F.concat(prefix, F.lit("-"), code, tail).alias("id"), r["whole"].alias("text"))

    return F.when(F.size(found) > 0, F.transform(found, one))


def chunks_of(found: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """Blocks with column ``prefix`` as chunks, numbered in order per document."""
    c = F.col
    text = strip(c("text"))
    numbered = F.concat(F.lit(rf"{_J}^{DIGIT}+\.\s*"), literal(c("sec_title")), F.lit(r"[:ः]?\s*"))
    text = F.when(F.coalesce(c("sec_title"), F.lit("")) != "", strip(F.regexp_replace(text, numbered, F.lit("")))).otherwise(text)
    text = F.when(c("sub").isNotNull(), F.regexp_replace(text, rf"{_J}^\({DIGIT}+\)\s*", "")).otherwise(text)
    text = F.when(c("clause").isNotNull(), F.regexp_replace(text, rf"{_J}^\([{rules.clause_class}]\)\s*", "")).otherwise(text)
    body = found.withColumn("_t", text).filter(strip(c("_t")) != "")

    def cut(of: str, mark: str, kept: str) -> DataFrame:
        parts = F.split(c(of), mark)
        has = c(of).contains(mark)
        return body.withColumn(kept, F.when(has, F.array(F.concat(F.lit(mark.strip() + " "), strip(parts[1]))))).withColumn(of, F.when(has, strip(parts[0])).otherwise(c(of)))

    body = cut("_t", rules.proviso, "provisos")
    body = cut("_t", rules.explanation, "explanations")
    kind = F.when(c("clause").isNotNull(), "clause").when(c("sub").isNotNull(), "subsection").otherwise("section")
    bare = c("sec").isNull() & c("sub").isNull() & c("clause").isNull()
    kind = F.when(c("annex") & bare, "anusuchi").when(c("annex"), F.concat(F.lit("anusuchi_"), kind)).otherwise(kind)
    ident = F.concat_ws(
        "-", c("prefix"),
        F.when(c("annex"), F.concat(F.lit("anusuchi"), F.coalesce(c("ch").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("ch"), c("ch").cast("string"))),
        F.concat(F.lit("sec"), c("sec").cast("string")), F.concat(F.lit("sub"), c("sub").cast("string")), F.concat(F.lit("cl"), c("clause")),
    )
    filled = lambda x: F.when(c(x) != "", c(x))
    hierarchy = F.struct(c("ch"), filled("ch_title").alias("ch_title"), c("sec"), filled("sec_title").alias("sec_title"), c("sub"), c("clause"))
    stats = F.struct(F.length("_t").alias("characters"), token_estimate(c("_t")).alias("tokens"))
    order = F.row_number().over(W.partitionBy("doc").orderBy("block"))
    return body.select(
        "doc", order.cast("bigint").alias("ord"), ident.alias("id"), kind.alias("type"), hierarchy.alias("hierarchy"), c("_t").alias("text"),
        "provisos", "explanations", extract_references(c("_t"), c("prefix"), rules).alias("refs"), stats.alias("stats"),
    )


def parse(docs: DataFrame, rules: RulePack = NEPALI) -> DataFrame:
    """Chunks of ``docs(doc, slug, bs_year, text)``; null texts give none."""
    keys = docs.select("doc", slug_prefix(F.col("slug"), F.col("bs_year")).alias("prefix"))
    found = blocks(content(lines_of(docs.filter("text IS NOT NULL")), rules), rules)
    return chunks_of(found.filter(strip(F.col("text")) != "").join(keys, "doc"), rules)
