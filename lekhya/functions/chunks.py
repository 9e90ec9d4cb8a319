"""Texts composed from a chunk's columns: embedding text, breadcrumbs, payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekhya.functions.text import uuid5
from lekhya.rules import NEPALI, RulePack

HIERARCHY = "struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>"
REF = "struct<type string, id string, text string>"
STATS = "struct<characters int, tokens int>"
METADATA = (
    "struct<title string, number string, bs_year int, date_published string, date_commenced string, type string, source string, "
    "lang string, amended_refs array<struct<ref string, date string>>>"
)
CHUNK = (
    f"struct<id string, type string, hierarchy {HIERARCHY}, text string, provisos array<string>, explanations array<string>, "
    f"refs array<{REF}>, stats {STATS}>"
)
#: One document of the dataset files.
DATASET = f"act_metadata {METADATA}, chunks array<{CHUNK}>"


def _h(hierarchy: Column, name: str) -> Column:
    return hierarchy[name]


def embedding_text(hierarchy: Column, text: Column, provisos: Column, explanations: Column, rules: RulePack = NEPALI) -> Column:
    """Labelled titles, number and clause, then text, provisos and explanations.

    Parts that are null are left out; an empty text is kept.
    """
    w, h = rules.labels, hierarchy
    return F.concat_ws(
        " | ",
        F.concat(F.lit(f"{w['ch']}: "), h["ch_title"]), F.concat(F.lit(f"{w['sec']}: "), h["sec_title"]),
        F.concat(F.lit(f"{w['sub']}: ("), h["sub"].cast("string"), F.lit(")")), F.concat(F.lit(f"{w['clause']}: ("), h["clause"], F.lit(")")),
        F.coalesce(text, F.lit("")), provisos, explanations,
    )


def breadcrumb(hierarchy: Column, rules: RulePack = NEPALI) -> Column:
    """The path for display; a dash if there is none, a question mark for a missing number."""
    w, h = rules.labels, hierarchy
    number = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    path = F.concat_ws(
        " → ",
        F.concat(F.lit(f"{w['ch']} "), number(h["ch"]), F.lit(": "), h["ch_title"]),
        F.concat(F.lit(f"{w['sec']} "), number(h["sec"]), F.lit(": "), h["sec_title"]),
        F.concat(F.lit(f"{w['sub']} ("), h["sub"].cast("string"), F.lit(")")),
        F.concat(F.lit(f"{w['clause']} ("), h["clause"], F.lit(")")),
    )
    return F.when(path == "", F.lit("—")).otherwise(path)


def clause_ref(hierarchy: Column, kind: Column) -> Column:
    """The compact path "ch1 (title) › sec2 (title) › sub3 › clक [type]".

    Titles are cut to 30 characters; "(root)" stands for an empty path.
    """
    h = hierarchy

    def short(title: Column) -> Column:
        cut = F.concat(F.regexp_replace(F.substring(title, 1, 30), r"(?U)\s+$", ""), F.when(F.length(title) > 30, "...").otherwise(""))
        return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" ("), cut, F.lit(")"))).otherwise(F.lit(""))

    head = F.when(F.coalesce(kind.contains("anusuchi"), F.lit(False)), "anusuchi").otherwise("ch")
    path = F.concat_ws(
        " › ",
        F.concat(head, h["ch"].cast("string"), short(h["ch_title"])), F.concat(F.lit("sec"), h["sec"].cast("string"), short(h["sec_title"])),
        F.concat(F.lit("sub"), h["sub"].cast("string")), F.concat(F.lit("cl"), h["clause"]),
    )
    return F.concat(F.when(path == "", F.lit("(root)")).otherwise(path), F.lit(" ["), F.coalesce(kind, F.lit("")), F.lit("]"))


def preview(text: Column, size: int = 300) -> Column:
    """The first ``size`` characters, with dots if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def point_id(chunk_id: Column) -> Column:
    """The key of a chunk in a collection, from its id alone."""
    return uuid5(chunk_id)
