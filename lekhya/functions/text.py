"""Text as column expressions: cleaning, numbers, words, keys.

All of it runs inside the JVM.  Patterns use explicit digit classes; white
space is Unicode's, as Java understands it with ``(?U)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekhya.rules import NEPALI, RulePack

DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
#: The namespace of URLs for name-based UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def clean(col: Column, rules: RulePack = NEPALI) -> Column:
    """A page without site address, amendment footnotes and page numbers.

    Null gives an empty text.  A line of digits takes the blank lines around it
    along; runs of spaces become one, three or more line ends two.
    """
    out = F.coalesce(col, F.lit(""))
    if rules.site:
        out = F.regexp_replace(out, "(?i)" + rules.site, "")
    if rules.footnote:
        out = F.regexp_replace(out, "(?U)" + rules.footnote, "")
    out = F.regexp_replace(out, r"(?mdU)^\s*[0-9०-९]+\s*$", "")
    out = F.regexp_replace(out, " +", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def to_int(col: Column, kind: str = "int") -> Column:
    """All digits of either script as one number; null without a digit.

    Everything else is dropped, a decimal point too: "५०.५०" gives 5050.
    """
    digits = F.translate(F.regexp_replace(col, "[^0-9०-९]", ""), DEVANAGARI_DIGITS, ASCII_DIGITS)
    return F.when(digits != "", digits.try_cast(kind))


def words(col: Column) -> Column:
    """The runs of non-space characters."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def token_estimate(col: Column) -> Column:
    """One and a half tokens a word, rounded down."""
    return F.floor(word_count(col) * F.lit(1.5)).cast("int")


def slug(col: Column) -> Column:
    """A file's name as a key: lower case letters and digits joined by "_"."""
    base = F.regexp_replace(F.regexp_extract(col, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def slug_prefix(slug_col: Column, year: Column) -> Column:
    """``slug-year``, with the word None for a missing year."""
    return F.concat(slug_col, F.lit("-"), F.coalesce(year.cast("string"), F.lit("None")))


def literal(col: Column) -> Column:
    """A text as a pattern that matches just that text."""
    return F.regexp_replace(col, r"([\\\[\](){}.*+?^$|/-])", r"\\$1")


def contains_any(col: Column, needles: tuple[str, ...]) -> Column:
    """Does the text contain one of the needles?  False for none."""
    out = F.lit(False)
    for n in needles:
        out = out | col.contains(n)
    return out


def alternation(needles: tuple[str, ...]) -> str:
    """A pattern that matches the first of the needles, in their order."""
    return "|".join(re.escape(n) for n in needles)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a text, as RFC 4122 defines it."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant,
        F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
