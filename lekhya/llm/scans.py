"""Text of scanned pages: noise found and repaired.

Three kinds of evidence, all of the whole corpus:

- lines: running heads are lines that stand between the two parts of a sentence
  in many values, whatever their numbers; gazette heads, titles with a year,
  page numbers and breaks inside sentences show in the shape of lines alone;
- characters: specks, and digits or marks inside words of another script;
- words: every word has an anagram hash, the sum of its characters' values, so
  a confusion of characters is one fixed difference of hashes.  The confusions
  of a corpus are learned: words less one character, or two, meet by hash, and
  a replacement counts that turns many frequent words into rare ones and hardly
  any into another frequent one.  Then rare words join frequent ones by hash
  plus difference in SQL, the spelling is verified, and corrections are ranked
  by the frequency of what they lead to.

Wrongly decoded and look-alike text is set right first, so it counts as noise
only if something else is wrong with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekhya.io import materialise, table
from lekhya.llm import encoding
from lekhya.llm.columns import any_of, column, counts, matches, split
from lekhya.llm.visual import SUSPECT_RE2, unify

# What a scanner reads instead of what is printed, beside what the corpus shows.
CONFUSIONS = (
    ("क", "फ"), ("ल", "न"), ("म", "भ"), ("भ", "म"), ("य", "थ"), ("थ", "य"), ("प", "ष"), ("ष", "प"), ("व", "ब"), ("ब", "व"), ("द", "ह"),
    ("ध", "घ"), ("घ", "ध"), ("ट", "ठ"), ("ठ", "ट"), ("ङ", "ड"), ("ड", "ङ"), ("ग", "ठा"), ("ण", "गा"), ("ख", "रव"), ("ि", "ा"), ("्", "ा"),
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("d", "cl"), ("u", "ii"), ("g", "q"), ("h", "b"), ("m", "rn"), ("n", "ri"), ("w", "vv"),
)
#: A correction must lead to a word seen this often, and so many times oftener than the rare one.
MIN_COUNT, MIN_RATIO = 6, 10
#: A confusion is learned from so many frequent words, if it leads to another
#: word of at least PEER_COUNT in no more than one of PEER_PART of them.
MIN_SUPPORT, PEER_COUNT, PEER_PART = 5, 4, 10
#: A running head stands inside a sentence in so many values, and in half of those that have it.
MIN_HEADS = 5
#: Words beyond this length are no words; the sum of their values could overflow.
MIN_WORD, MAX_WORD = 2, 60
#: Corrections up to this number are broadcast to the tasks, more are joined.
SMALL_LIST = 200_000
#: Characters between words, for RE2.
SEPARATORS = r"(?:\s|।|[,;:()\[\]{}“”\"'’‘.?!–—/|~^_¢»«¬·•*`¥-])+"

#: The same but for the hyphen, and a word with a hyphen inside.
_BUT_HYPHEN = SEPARATORS.replace("-])+", "])+")
_COMPOUND = r"^[^\d-]+-[^\d-]+$"

KEYS = ["chunk_row_id", "field", "item_pos"]
_D = "[ऀ-ॣॱ-ॿ]"  # a letter or sign of Devanagari
_N = "[०-९]"
_ITEM = r"[(\[]?(?:[a-z]|[ivx]+|[ऀ-ह]|[0-9०-९]{1,3}|\ufffd{1,2})[)\].]\s"
#: Noise that shows in the characters of a unified value, for RE2.
SIGNS = {
    # specks alone or at a word
    "speck": r"[~^_¢»«¬·•¥*`|\\]|\s[.:;,'°]{1,3}(?:\s|$)",
    # a mark or sign in place of another: danda, digits, letters inside words of the other script
    "mark": rf"{_D}[!l](?:[^A-Za-z]|$)|{_D}[0-9A-Za-z$&@%]{_D}|{_D}[0-9A-Z](?:[\s।,.)]|$)|(?:^|[\s(“])[0-9A-Z]{_D}\S",
    "digit": rf"{_N}[A-Za-z0-9]|[A-Za-z0-9]{_N}|{_N}[।/.,-][A-Zl](?:[^a-z]|$)|(?:^|[^A-Za-z])[A-Zl][।/]{_N}|{_N}!{_N}",
    "latin": r"[A-Za-z][0-9!][a-z]|(?:^|[^A-Za-z0-9])[015](?:[a-mo-qu-z][a-z]|s[a-su-z]|n[a-ce-z]|r[a-ce-z]|t[a-gi-z])"
    r"|[a-z]{2}[015!](?:[^A-Za-z0-9]|$)|\b(?:t0|n0|0f|0n|0r|1n|1f|1s|i5|a5|1t)\b",
}
#: Noise that shows in the lines of a value, for Python.
LINES = {
    # a break inside a sentence or word: no end before it, no list item after it
    "break": rf"[^\s।.?!:;”\"\ufffd][ \t\r]*\n\s*(?!{_ITEM})\S",
    "hyphen": r"[\wऀ-ॿ][-­¬][ \t\r]*\n",
    # lines that hold nothing but a page number
    "page": r"(?mi)^[ \t\r]*[-–—\[(|<]*[ \t]*(?:p\.|page|पृष्ठ|पाना(?:[ ]*नं\.?)?|पेज)?[ \t]*[0-9०-९]{1,4}(?:[ ]*(?:of|/|मध्ये)[ ]*[0-9०-९]{1,4})?[ \t]*\|?[ \t]*(?:पृष्ठ|page)?[ \t]*[-–—\])>]*[ \t\r]*$",
    # running heads and feet: the gazette, or an act with its year, alone on a line
    "head": r"(?mi)^[ \t\r]*(?:[0-9०-९]{1,4}\s+)?(?:\(?खण्ड\s+[०-९]+\)?,?\s+)?(?:नेपाल\s+)?(?:राजपत्र|gazette)[ ,][^\n]{0,60}$",
    "title": r"(?i)(?:^|\n)[ \t\r]*(?:[0-9०-९]{1,4}\s+)?[^।.?!\n:]{2,60},[ ]*(?:२०|20|१९)[0-9०-९]{2}(?:[ .…]+[0-9०-९]{1,4})?[ \t\r]*(?:\n|$)",
}
_LINES = {k: re.compile(v) for k, v in LINES.items()}


def bad_lines(text: str) -> bool:
    """Does any noise show in the lines?"""
    return any(p.search(text) for p in _LINES.values())


# --- values ----------------------------------------------------------------


def scan_values(chunks: DataFrame) -> DataFrame:
    """(chunk_row_id, field, item_pos, value) of text and provisos, no nulls or blanks."""
    provisos = chunks.select("chunk_row_id", F.posexplode("provisos").alias("item_pos", "value")).select(
        "chunk_row_id", F.lit("provisos").alias("field"), "item_pos", "value"
    )
    text = chunks.select("chunk_row_id", F.lit("text").alias("field"), F.lit(0).alias("item_pos"), F.col("text").alias("value"))
    return text.unionByName(provisos).filter(F.col("value").rlike(r"\S"))


ODD_RE2 = f"{encoding.GARBLED_RE2}|{SUSPECT_RE2}"
SCHEMA = "chunk_row_id bigint, field string, item_pos int, value string, word string, n bigint, noisy boolean"


def mended(value: pa.Array, odd: pa.Array, repair: encoding.Repairer) -> pa.Array:
    """A column with wrong encodings undone and look-alikes unified in the odd values."""
    new = [unify(repair(t)[0]) if encoding.maybe_garbled(t) else unify(t) for t in value.filter(odd).to_pylist()]
    return pc.replace_with_mask(value, odd, pa.array(new, pa.string()))


def shaped(value: pa.Array) -> pa.Array:
    """Which values of a mended column show noise in characters or lines."""
    lines = matches(value, "\n")
    bad = [bad_lines(t) for t in value.filter(lines).to_pylist()]
    return pc.or_(any_of(value, list(SIGNS.values())), pc.replace_with_mask(lines, lines, pa.array(bad, pa.bool_())))


_ITEM_START, _SENTENCE_END, _MASK = re.compile(_ITEM), re.compile(r"[।.?!:;”\"-]\W*$"), re.compile("[0-9०-९]+")


def masked(line: str) -> str:
    """The line as far as running heads repeat: without its numbers and wide spaces."""
    return _MASK.sub("#", " ".join(line.split()))


def line_marks(text: str) -> dict[str, bool]:
    """Masked inner lines of a text, each with whether it stands inside a sentence anywhere."""
    lines = [x for x in (x.strip() for x in text.split("\n")) if x]
    out: dict[str, bool] = {}
    for before, line, after in zip(lines, lines[1:], [*lines[2:], ""]):
        if not _ITEM_START.match(line + " "):
            inside = bool(after) and not _SENTENCE_END.search(before) and not _ITEM_START.match(after)
            key = masked(line)
            out[key] = out.get(key, False) or inside
    return out


def scan(values: DataFrame, models: encoding.Models) -> DataFrame:
    """One pass over all values: what is noisy by shape, and the words of all.

    Rows with a word are its count in a batch; rows with ``noisy`` have the key
    of a value of noisy shape, or the key and text of an odd value of good shape
    after mending, changed by it or not, which need not be mended again; the
    others have a key and a masked inner line, with n = 1 if it stands inside a
    sentence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = encoding.Repairer(models)
        for b in batches:
            old = column(b, "value")
            odd = matches(old, ODD_RE2)
            value = mended(old, odd, repair)
            bad = shaped(value)
            new = pc.and_(odd, pc.invert(bad))
            keep = pc.or_(bad, new)
            keys = [column(b, c).filter(keep) for c in ("chunk_row_id", "field", "item_pos")]
            text = pc.if_else(new, value, pa.scalar(None, pa.string())).filter(keep)
            # words with a hyphen inside are evidence for hyphens at a line's end
            hyphens = value.filter(matches(value, r"[^\s\d]-[^\s\d]"))
            compounds = split(hyphens, _BUT_HYPHEN)[1]
            words = pa.concat_arrays([split(value, SEPARATORS)[1], compounds.filter(matches(compounds, _COMPOUND))])
            word, n = counts(words)
            split_up = matches(value, "\n")
            at = [column(b, c).filter(split_up).to_pylist() for c in ("chunk_row_id", "field", "item_pos")]
            marks = [(*key, line, int(inside)) for *key, text in zip(*at, value.filter(split_up).to_pylist()) for line, inside in line_marks(text).items()]
            cols = list(zip(*marks)) if marks else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string()))), pa.nulls(len(marks), pa.string()),
                    pa.array(cols[4], pa.int64()), pa.nulls(len(marks), pa.bool_()),
                ],
                ["chunk_row_id", "field", "item_pos", "value", "word", "n", "noisy"],
            )
            m, k = len(keys[0]), len(word)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.concat_arrays([x, pa.nulls(k, x.type)]) for x in keys), pa.concat_arrays([text, pa.nulls(k, pa.string())]),
                    pa.concat_arrays([pa.nulls(m, pa.string()), word]), pa.concat_arrays([pa.nulls(m, pa.int64()), n]),
                    pa.concat_arrays([bad.filter(keep), pa.nulls(k, pa.bool_())]),
                ],
                ["chunk_row_id", "field", "item_pos", "value", "word", "n", "noisy"],
            )

    return values.select("chunk_row_id", "field", "item_pos", "value").mapInArrow(run, SCHEMA)


# --- words -----------------------------------------------------------------


def value_of(ch: Column) -> Column:
    """The fixed value of a character, below 2**55."""
    return F.pmod(F.xxhash64(ch), F.lit(36028797018963913))


def anagram_hash(word: Column) -> Column:
    """The sum of the values of a word's characters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", F.lit(0)).otherwise(value_of(c)))


def line_rows(scanned: DataFrame) -> DataFrame:
    """(key, line, n) of the masked inner lines of all values."""
    return scanned.filter("noisy IS NULL AND word IS NULL").select(*KEYS, F.col("value").alias("line"), "n")


def running_heads(lines: DataFrame) -> DataFrame:
    """(line) of the masked lines that repeat inside sentences."""
    seen = lines.groupBy("line").agg(F.sum("n").alias("inside"), F.count("*").alias("n_values"))
    return seen.filter((F.col("inside") >= MIN_HEADS) & (2 * F.col("inside") >= F.col("n_values"))).select("line")


def word_counts(scanned: DataFrame) -> DataFrame:
    """Counts of the words of all values: letters of one script, no digits."""
    counted = scanned.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("word").rlike(r"^(?:[ऀ-ॣॱ-ॿ‌‍]+|[A-Za-zÀ-ž]+)$") & F.length("word").between(MIN_WORD, MAX_WORD))


def _parts(words: DataFrame, size: int) -> DataFrame:
    """Every word with ``seen``, each run of ``size`` characters, its place ``at`` and the hash of the ``rest``."""
    spots = F.when(F.length("word") >= size, F.sequence(F.lit(1), F.length("word") - size + 1))
    placed = words.select("word", "n", anagram_hash(F.col("word")).alias("h"), F.explode(spots).alias("at"))
    seen = placed.withColumn("seen", F.substring(F.col("word"), F.col("at"), F.lit(size)))
    return seen.select("word", "n", "at", "seen", (F.col("h") - anagram_hash(F.col("seen"))).alias("rest"))


def confusions(counts: DataFrame) -> DataFrame:
    """(printed, seen) of the confusions that the words of a corpus show.

    One printed character is read as another, or as two.  Words meet by the
    hash of what is left of them and its place; the anagrams among them are
    told apart by spelling.
    """
    frequent = _parts(counts.filter(F.col("n") >= MIN_COUNT), 1).select(
        F.col("word").alias("correction"), F.col("n").alias("n_correction"), "at", F.col("seen").alias("printed"), "rest"
    )
    pairs = _parts(counts, 1).unionByName(_parts(counts, 2)).join(frequent, ["rest", "at"])
    end = F.col("at") + 1
    made = F.concat(F.substring(F.col("correction"), F.lit(1), F.col("at") - 1), F.col("seen"), F.substring(F.col("correction"), end, F.lit(MAX_WORD)))
    rare = F.col("n_correction") >= MIN_RATIO * F.col("n")
    met = pairs.filter((F.col("printed") != F.col("seen")) & (made == F.col("word"))).groupBy("printed", "seen", "correction").agg(
        F.max(rare.cast("int")).alias("rare"), F.max((~rare & (F.col("n") >= PEER_COUNT)).cast("int")).alias("peer")
    )
    sums = met.groupBy("printed", "seen").agg(F.sum("rare").alias("support"), F.sum("peer").alias("peers"))
    return sums.filter((F.col("support") >= MIN_SUPPORT) & (PEER_PART * F.col("peers") <= F.col("support"))).select("printed", "seen")


def corrections(counts: DataFrame) -> DataFrame:
    """(word, correction, n, n_correction), the best correction of each rare word.

    Frequent words are expanded by the confusions that they can suffer; rare
    words meet them by anagram hash, and a correction stands if one replacement
    turns it into the rare word.  Ranked by frequency, then by spelling.
    ``counts`` is used several times.
    """
    spark = counts.sparkSession
    fixed = spark.createDataFrame([(r, w) for r, w in CONFUSIONS], "printed string, seen string")
    pairs = confusions(counts).unionByName(fixed).distinct().withColumn("delta", anagram_hash(F.col("seen")) - anagram_hash(F.col("printed")))
    frequent = counts.filter(F.col("n") >= MIN_COUNT).select(F.col("word").alias("correction"), F.col("n").alias("n_correction"))
    # every confusion is of one printed character
    spelled = frequent.withColumn("printed", F.explode(F.array_distinct(F.split("correction", ""))))
    shifted = spelled.join(pairs, "printed").withColumn("h", anagram_hash(F.col("correction")) + F.col("delta"))
    rare = counts.withColumn("h", anagram_hash(F.col("word")))
    spots = F.sequence(F.lit(1), F.length("correction"))
    size = F.length("printed")
    made = F.exists(
        spots,
        lambda i: (F.substring(F.col("correction"), i, size) == F.col("printed"))
        & (F.concat(F.substring(F.col("correction"), F.lit(1), i - 1), F.col("seen"), F.substring(F.col("correction"), i + size, F.lit(MAX_WORD))) == F.col("word")),
    )
    near = rare.join(shifted, "h").filter((F.col("n_correction") >= MIN_RATIO * F.col("n")) & made)
    best = W.partitionBy("word").orderBy(F.desc("n_correction"), "correction")
    return near.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("word", "correction", "n", "n_correction")


def misread(values: DataFrame, words: list[str]) -> DataFrame:
    """Keys of the values of (chunk_row_id, field, item_pos, value) with one of few words.

    Odd values are left out: the scan found their noise or gives their text.
    The words are broadcast once.
    """
    shared = values.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for b in batches:
            b = b.filter(pc.invert(matches(column(b, "value"), ODD_RE2)))
            at, word = split(column(b, "value"), SEPARATORS)
            hit = pc.unique(at.filter(pc.is_in(word, value_set=known)))
            yield b.select(["chunk_row_id", "field", "item_pos"]).take(hit)

    return values.select("chunk_row_id", "field", "item_pos", "value").mapInArrow(run, "chunk_row_id bigint, field string, item_pos int")


def misread_joined(values: DataFrame, fixes: DataFrame) -> DataFrame:
    """As ``misread`` for corrections of any number: the words are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, word = split(column(b, "value"), SEPARATORS)
            keys = b.select(["chunk_row_id", "field", "item_pos"]).take(at)
            yield pa.RecordBatch.from_arrays([*keys.columns, word], ["chunk_row_id", "field", "item_pos", "word"])

    words = values.select("chunk_row_id", "field", "item_pos", "value").mapInArrow(run, "chunk_row_id bigint, field string, item_pos int, word string")
    return words.join(fixes.select("word"), "word", "left_semi").drop("word").distinct()


# --- repair ----------------------------------------------------------------

_IN_WORD = {"2": "र", "1": "न", "¥": "स", "0": "०", "Z": "२", "l": "।", "!": "।"}
_IN_LATIN = {"0": "o", "1": "l", "5": "s", "!": "i"}
_DIGIT = {"0": "०", "Z": "२", "l": "१", "Y": "४", "C": "८", "O": "०", "o": "०", "S": "५", "|": "।", "!": "।"}


def edge_line(line: str) -> bool:
    """A page number or a running head or foot."""
    return bool(line.strip()) and any(_LINES[k].fullmatch(line) for k in ("page", "head", "title"))


def _kept_lines(text: str, heads: frozenset = frozenset()) -> list[str]:
    """The lines without page numbers, running heads and lone dashes; ``heads`` are masked inner lines."""
    lines = [x.rstrip("\r \t") for x in text.split("\n")]
    if len(lines) > 1:
        lines = [x for i, x in enumerate(lines) if not edge_line(x) and not re.fullmatch(r"[\s\-–—|\[\]]+", x) and not (i and masked(x) in heads)]
    return lines


_HEAD_PART, _TAIL_PART = re.compile(r"[^\s-]*(?=-$)"), re.compile(r"[^\s।,.;:-]*")


def broken_words(text: str, heads: frozenset = frozenset()) -> list[tuple[str, str]]:
    """(first, second) part of every word that a hyphen breaks at a line's end."""
    lines = [x.strip(" \t") for x in _kept_lines(text, heads)]
    lines = [x for x in lines if x]
    return [(_HEAD_PART.search(a).group(), _TAIL_PART.match(b).group()) for a, b in zip(lines, lines[1:]) if re.search(r"[\wऀ-ॿ]-$", a)]


def repair_text(text: str, fixes: dict[str, str], compounds: frozenset = frozenset(), heads: frozenset = frozenset()) -> str:
    """Continuous paragraphs without scan noise.

    ``fixes`` are corrections of words; a word of ``compounds`` keeps the
    hyphen that stands at a line's end, any other loses it; lines that are
    ``heads`` when masked go.
    """
    lines = _kept_lines(text, heads)
    out = ""
    blank = False
    for line in lines:
        line = line.strip(" \t")
        if not line:
            blank = True
            continue
        if not out:
            out = line
        elif re.match(_ITEM, line) or (re.search(r"[।.?!:;”\"|]\W*$", out) and (blank or re.search(r":-?$", line) or re.search(r"[:-]$", out))):
            out += ("\n\n" if blank else "\n") + line
        elif re.search(r"[\wऀ-ॿ][-­¬]$", out):
            keep = out[-1] == "-" and f"{_HEAD_PART.search(out).group()}-{_TAIL_PART.match(line).group()}" in compounds
            out = (out if keep else out[:-1]) + line
        else:
            out += " " + line
        blank = False
    out = re.sub(rf"(?<={_D})[|!l](?=\s|$|[”\"])|(?<={_D})[|!](?={_D})", "।", out)
    out = re.sub(rf"(?<={_N})[|!](?={_N})", "।", out)
    out = re.sub(rf"(?<={_D})[21¥](?={_D})|(?<={_D})[21¥](?=[\s।,])|(?<![\S])[21¥](?={_D})", lambda m: _IN_WORD[m.group()], out)
    out = re.sub(rf"(?:(?<={_N})|(?<={_N}[।,]))[A-Zlo0](?![a-z])|(?<![A-Za-z0-9])[A-Zl0](?={_N})", lambda m: _DIGIT.get(m.group(), m.group()), out)
    out = re.sub(r"(?<=[A-Za-z])[015!](?=[a-z])|\b[015](?!st|nd|rd|th)(?=[a-z]{2})|(?<=[a-z]{2})[015!](?![A-Za-z0-9])", lambda m: _IN_LATIN[m.group()], out)
    out = re.sub(r"(?<=\s)[.:;,'°]{1,3}(?=\s|$)", "", out)
    out = re.sub(r"[ \t]*[~^_¢»«¬·•*`|\\]+(?=\s|$)|[~^_¢»«¬·•*`|\\]+", "", out)
    out = re.sub(r"[^\s।,;:()\[\]“”\"'’‘.?!–—/-]+", lambda m: fixes.get(m.group(), m.group()), out)
    return re.sub(r"[ \t]{2,}", " ", out).strip()


def noisy(values: DataFrame, scanned: DataFrame, fixes: DataFrame) -> DataFrame:
    """Keys of the values with noise, each once.

    ``scanned`` and ``fixes`` are written tables.  Few corrections go to the
    tasks as a set, more are joined.
    """
    lines = line_rows(scanned)
    headed = lines.join(running_heads(lines), "line", "left_semi").select(*KEYS)
    formed = scanned.filter("noisy").select(*KEYS).unionByName(headed)
    good = scanned.filter("NOT noisy").select(*KEYS, "value")
    if fixes.count() <= SMALL_LIST:
        words = sorted(r[0] for r in fixes.select("word").collect())
        worded = misread(values, words).unionByName(misread_joined(good, fixes))
    else:
        worded = misread_joined(values, fixes).join(good.select(*KEYS), KEYS, "left_anti").unionByName(misread_joined(good, fixes))
    return formed.unionByName(worded).distinct()


def _scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, encoding.Models]:
    chunks = table(spark, sf_dir, "chunks")
    values, models = scan_values(chunks), encoding.models_of(chunks)
    return values, materialise(scan(values, models)), models


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with scan noise."""
    values, scanned, _ = _scanned(spark, sf_dir)
    return noisy(values, scanned, materialise(corrections(materialise(word_counts(scanned)))))


def p4_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked corrections of misread words."""
    return corrections(materialise(word_counts(_scanned(spark, sf_dir)[1])))


def p4_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusions of characters that the corpus shows."""
    return confusions(materialise(word_counts(_scanned(spark, sf_dir)[1])))


def p4_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running heads and feet that the corpus shows, their numbers masked."""
    return running_heads(line_rows(_scanned(spark, sf_dir)[1]))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy values as continuous paragraphs.

    A value takes its corrections along as a map, so that the repair needs
    nothing but the row.
    """
    values, scanned, models = _scanned(spark, sf_dir)
    fixes = materialise(corrections(materialise(word_counts(scanned))))
    bad = values.join(noisy(values, scanned, fixes), KEYS)

    @F.pandas_udf("string")
    def mend(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        repair = encoding.Repairer(models)
        for s in batches:
            yield s.map(lambda t: unify(repair(t)[0]) if encoding.maybe_garbled(t) else unify(t))

    def some(x: object) -> frozenset:
        return frozenset() if x is None else frozenset(x)

    @F.pandas_udf("array<struct<head:string,tail:string>>")
    def broken(s: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([[{"head": h, "tail": e} for h, e in broken_words(t, some(x))] for t, x in zip(s, heads)], dtype=object)

    @F.pandas_udf("string")
    def smooth(text: pd.Series, fix: pd.Series, keep: pd.Series, heads: pd.Series) -> pd.Series:
        rows = zip(text, fix, keep, heads)
        return pd.Series([repair_text(t, dict(f) if f is not None else {}, some(k), some(h)) for t, f, k, h in rows], dtype=object)

    lines = line_rows(scanned)
    heads = lines.join(running_heads(lines), "line", "left_semi").groupBy(*KEYS).agg(F.collect_set("line").alias("heads"))
    plain = materialise(bad.withColumn("value", mend("value")).join(heads, KEYS, "left"))
    words = plain.select(*KEYS, F.explode(F.array_distinct(F.split("value", r"[\s।,;:()\[\]{}“”\"'’‘.?!–—/|~^_¢»«¬·•*`¥-]+"))).alias("word"))
    maps = words.join(fixes.select("word", "correction"), "word").groupBy(*KEYS).agg(F.map_from_entries(F.collect_set(F.struct("word", "correction"))).alias("fixes"))
    # a hyphen stays where the corpus has the compound oftener than the joined word
    pairs = plain.select(*KEYS, F.explode(broken("value", "heads")).alias("p"))
    forms = pairs.select(*KEYS, F.concat_ws("-", "p.head", "p.tail").alias("compound"), F.concat("p.head", "p.tail").alias("joined"))
    seen = scanned.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    both = forms.join(seen.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound").join(
        seen.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left"
    )
    kept = both.filter(F.col("n_compound") > F.coalesce("n_joined", F.lit(0))).groupBy(*KEYS).agg(F.collect_set("compound").alias("compounds"))
    whole = plain.join(maps, KEYS, "left").join(kept, KEYS, "left")
    return whole.withColumn("repaired", smooth("value", "fixes", "compounds", "heads")).select(*KEYS, "repaired")
