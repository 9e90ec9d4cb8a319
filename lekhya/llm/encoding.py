"""Text decoded with a wrong encoding: find it and restore it.

Every candidate chain of wrong decodings is undone and the result compressed
with a zstandard dictionary of each language.  The chain with the minimum
description length, its own cost included, is taken; if none beats the text as
it is, the text stays unchanged.

A shorter text is no proof by itself, as two bytes of a Russian or French word
may happen to be one character of UTF-8.  So a chain decodes whole runs of
characters only, to scripts that fit, from characters that do not stand like
this in correct text; letters of the script it read from that it leaves in
other places count against it.  A replacement character is evidence of its own:
the hypothesis of a loss explains it at the cost of one step, the text as it is
must spell it as a character that no language has.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.io import table, written
from lekhya.llm.columns import column, counts, matches, split

#: Encodings that text may have been read in by mistake.
CODECS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1254", "iso8859_15", "koi8_r", "cp866")
#: What a step of a chain adds to the description length, in bytes, and a letter
#: of the script a step read from that it left unexplained.
STEP_COST, UNEXPLAINED_COST = 1, 2
#: Chains go on from texts in which at least this part of the most characters were decoded.
NEAR = 0.9
#: What a character that no language has adds, besides its compressed form.
ALIEN_COST = 4
#: The size of a dictionary, and the characters of a piece in which longer clauses count.
DICT_BYTES, PIECE = 65_536, 300
#: Clauses of a language that a dictionary is trained on, more than it can hold; about how
#: many copies of them, in proportion to their counts in all texts, and copies in a line.
CLAUSES, COPIES, LINE = 8_192, 20_000, 5
#: Between clauses, for RE2.
CLAUSE_ENDS = r"[ ]*[।.;:\n]+[ ]*"
#: No text is sampled and nothing reads this; tests that set it show that it has no effect.
SAMPLE = None
#: How many times likelier than the next a character must be to fill a gap.
FAR_LIKELIER = 4
#: A value without this has no wrongly decoded part; the same in Java and Python.
_PLAIN = "\\x00-\\x7F\\u0900-\\u0DFF"
_SIGNS = "\\u2013\\u2014\\u2018\\u2019\\u201C\\u201D\\u200B-\\u200F\\u2007\\u2009\\u202F\\u2060\\u3000\\uFEFF\\uFF01-\\uFF5E"
GARBLED = f"[^{_PLAIN}{_SIGNS}][^{_PLAIN}]|\\uFFFD"
_GARBLED = re.compile(GARBLED)
#: The same for RE2.
GARBLED_RE2 = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", GARBLED)
LOST = "�"
#: The script that tells the languages apart, for RE2.
DEVANAGARI_RE2 = r"[\x{0900}-\x{097F}]"
#: Filled gaps that a worker remembers.
FILLS = 100_000
#: What may fill a gap: Devanagari, and punctuation and signs of three bytes.
_FILLS = re.compile("[\u0900-\u097F\u2000-\u2FFF]")


def maybe_garbled(text: str | None) -> bool:
    return text is not None and _GARBLED.search(text) is not None


def _table(codec: str) -> dict[int, int]:
    """Character to byte; bytes without a character stand for themselves.

    Characters that the codec cannot give are mapped out of the byte range, so
    that nothing else looks like a byte.
    """
    out = {c: 0xFFFF for c in range(0x80, 0x100)}
    for b in range(0xFF, 0x7F, -1):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    if codec.startswith(("cp125", "iso8859")):  # readers often let control bytes through
        out |= {b: b for b in range(0x80, 0xA0)}
    return out


def _undefined(codec: str) -> tuple[int, ...]:
    out = []
    for b in range(0x80, 0xC0):
        try:
            bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out.append(b)
    return tuple(out) or tuple(range(0x80, 0xA0))


TABLES = {c: _table(c) for c in CODECS}
UNDEFINED = {c: _undefined(c) for c in CODECS}
_TAIL = "[\x80-\xbf]"
_WHOLE = (
    f"[\xc2-\xdf]{_TAIL}|\xe0[\xa0-\xbf]{_TAIL}|[\xe1-\xec\xee\xef]{_TAIL}{{2}}|\xed[\x80-\x9f]{_TAIL}"
    f"|\xf0[\x90-\xbf]{_TAIL}{{2}}|[\xf1-\xf3]{_TAIL}{{3}}"
)
#: Runs of whole UTF-8 characters, or one of Devanagari or of punctuation and signs that lost a byte.
_SEQUENCES = re.compile(f"(?P<whole>(?:{_WHOLE})+)|(?P<lost>(?:\\xe0[\\xa4\\xa5]|\\xe2{_TAIL})\\ufffd?(?!{_TAIL}))")


_RUN = re.compile("[\x80-\xff\ufffd]+")
#: Letters of the language and its signs, which a decoding may give anywhere.
_OWN = re.compile("[\u0900-\u097F\u2000-\u2BFF\uFEFF]+")
#: Western letters, and signs that a text read wrongly twice has in between.
_WESTERN = re.compile("[\u0080-\u017F\u0192\u02C6-\u02DD]+")
#: Characters that a run must spell to be believed without a mark of garbling.
MIN_LETTERS = 3
#: The part of a run that must be whole characters if not all is.
MIN_PART = 0.5


@lru_cache(maxsize=4096)
def script(ch: str) -> str:
    """The script of a letter beyond ASCII, by its name; empty for all else."""
    return unicodedata.name(ch, "").partition(" ")[0] if ch > "\x7f" and unicodedata.category(ch)[0] in "LM" else ""


def _decoded(m: re.Match) -> str:
    return m.group().encode("latin-1").decode()


def odd(text: str, a: int, b: int) -> bool:
    """Do the characters of ``text[a:b]`` stand as they do not in correct text?

    A symbol, a number or a control character at a letter or another of its
    kind; a small letter before a capital; letters of two scripts side by side;
    a bracket or quotation mark between two letters.
    """
    for i in range(a, b):
        c = text[i]
        kind = unicodedata.category(c)
        before = text[i - 1] if i else " "
        after = text[i + 1] if i + 1 < len(text) else " "
        if kind[0] in "SC" or kind in ("No", "Zs") or c in "ªº§¶•†‡…‰":
            if c == LOST or kind == "Cc" or any(a <= j < b and not text[j].isspace() and unicodedata.category(text[j]) not in ("Nd", "Pd") for j in (i - 1, i + 1)):
                return True
        elif kind[0] == "L":
            if before > "\x7f" and a < i and unicodedata.category(before)[0] == "L" and (script(before) != script(c) or (before.islower() and c.isupper())):
                return True
        elif kind in ("Pi", "Pf", "Ps", "Pe", "Po") and c not in "’·" and before.isalpha() and after.isalpha():
            return True
    return False


def plausible(text: str, raw: str, a: int, b: int, spots: list[re.Match], decoded: list[str]) -> bool:
    """May the run ``text[a:b]`` be the characters ``decoded`` that its bytes ``spots`` spell?

    The language's own letters and signs need a mark of garbling or several
    characters, and most of the run; western letters and those of other scripts
    the whole run; others, moreover, a mark and letters of one script alone.
    """
    covered = sum(m.end() - m.start() for m in spots)
    whole, got = covered == b - a, "".join(decoded)
    if _OWN.fullmatch(got):
        return (whole or covered >= MIN_PART * (b - a)) and (len(got) >= MIN_LETTERS or raw.startswith("\xe2\x80", spots[0].start()) or odd(text, a, b))
    foreign = [c for c in got if not _OWN.match(c) and not _WESTERN.match(c)]
    if not whole:
        return not foreign and _OWN.search(got) is not None and covered >= MIN_PART * (b - a) and odd(text, a, b)
    if not foreign:
        # other letters before a quotation mark may be the end of a quotation
        return raw[a] in "\xc2\xc3" or len(got) >= MIN_LETTERS or odd(text, a, b)
    scripts = {script(c) for c in foreign}
    return len(scripts) == 1 and "" not in scripts and odd(text, a, b)


@dataclass(frozen=True)
class Models:
    """Per-language dictionaries and counts of character pairs, both of all clean texts."""

    dictionaries: tuple[bytes, ...] = ()
    pairs: dict = field(default_factory=dict)


def _by_language(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The texts with Devanagari, and the others."""
    own = matches(texts, DEVANAGARI_RE2)
    return texts.filter(own), texts.filter(pc.invert(own))


def _clauses_in(texts: pa.Array) -> Iterator[tuple[str, int]]:
    """(clause, how often) of the clauses of the texts; long ones count in pieces, so a clause may come again."""
    clauses, n = counts(split(texts, CLAUSE_ENDS)[1])
    for c, k in zip(clauses.to_pylist(), n.to_pylist()):
        for i in range(0, len(c), PIECE):
            yield c[i : i + PIECE], k


def composed(clauses: dict[str, int]) -> list[str]:
    """Lines of the clauses, each as often as its count demands and at least once, evenly mixed."""
    total, copies = max(sum(clauses.values()), COPIES), []
    for c, n in clauses.items():
        k = -(-n * COPIES // total)
        copies += [((2 * j + 1) / (2 * k), c) for j in range(k)]
    mixed = [" " + w for _, w in sorted(copies)]
    return ["".join(mixed[i : i + LINE]) for i in range(0, len(mixed), LINE)]


def dictionary(clauses: dict[str, int]) -> bytes:
    """The dictionary of a language with these counts of clauses; of few clauses, these themselves."""
    data = [t.encode() for t in composed(clauses)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, data, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(data)[-DICT_BYTES:]


def train(texts: list[list[str]]) -> Models:
    """The models of the texts of each language, as ``models_of`` has them for a table."""
    dicts, pairs = [], Counter()
    for part in texts:
        clauses: Counter = Counter()
        for w, n in _clauses_in(pa.array(part, pa.string())):
            clauses[w] += n
        for t in part:
            pairs.update(t[i : i + 2] for i in range(len(t) - 1) if t[i] > "ࣿ")
        best = sorted(clauses, key=lambda w: (-(clauses[w] - 1) * (len(w.encode()) + 1), w))[:CLAUSES]
        dicts.append(dictionary({w: clauses[w] for w in best}))
    return Models(tuple(d for d in dicts if d), dict(pairs))


def _pairs_in(texts: list[str]) -> Iterator[tuple[str, int]]:
    """(pair, how often) of the character pairs of the texts whose first is beyond U+08FF."""
    between = 0xD800  # no text has a surrogate
    codes = np.frombuffer(chr(between).join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, at = np.flatnonzero(np.bincount(codes)), np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    at[known] = np.arange(len(known))
    first, second = codes[:-1], codes[1:]
    use = (first > 0x8FF) & (first != between) & (second != between)
    both = at[first[use]] * len(known) + at[second[use]]
    if len(known) <= 2048:
        n = np.bincount(both)
        both = np.flatnonzero(n)
        n = n[both]
    else:
        both, n = np.unique(both, return_counts=True)
    for x, k in zip(both.tolist(), n.tolist()):
        yield chr(known[x // len(known)]) + chr(known[x % len(known)]), k


def text_counts(chunks: DataFrame) -> DataFrame:
    """(kind, item, n): how often each character pair and each clause occurs in all clean texts.

    Kind 0 are clauses of texts with Devanagari, 1 clauses of the others, 2 pairs.
    Only pairs that can fill a gap are kept, so the alphabet bounds them: one
    of the two is of Devanagari or a sign.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = column(b, "text")
            clean = text.filter(pc.invert(matches(text, GARBLED_RE2)))
            found = [(kind, c, n) for kind, part in enumerate(_by_language(clean)) for c, n in _clauses_in(part)]
            found += [(2, p, n) for p, n in _pairs_in(clean.to_pylist()) if _FILLS.search(p)]
            cols = list(zip(*found)) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64()))], ["kind", "item", "n"])

    counted = chunks.select("text").filter("text IS NOT NULL").mapInArrow(run, "kind int, item string, n bigint")
    return counted.groupBy("kind", "item").agg(F.sum("n").alias("n"))


def models_of(chunks: DataFrame) -> Models:
    """Dictionaries and pairs, from the counts of all clean texts.

    Clauses are ranked by the bytes that all of their occurrences but the first
    take, counted over the whole table; more than a dictionary can hold are taken.
    """
    with written(text_counts(chunks)) as counted:
        pairs = {r["item"]: r["n"] for r in counted.filter("kind = 2").collect()}
        repeated, dicts = (F.col("n") - 1) * (F.octet_length("item") + 1), []
        for kind in (0, 1):
            best = counted.filter(F.col("kind") == kind).orderBy(repeated.desc(), "item").limit(CLAUSES).collect()
            dicts.append(dictionary({r["item"]: r["n"] for r in best}))
    return Models(tuple(d for d in dicts if d), pairs)


class Repairer:
    """Callable: text -> (restored text, was it found, chain of codecs)."""

    def __init__(self, models: Models) -> None:
        self.pairs = models.pairs
        self.filled: dict[tuple, str] = {}
        self.coders = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False)
            for d in models.dictionaries
        ] or [zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)]

    def length(self, text: str) -> int:
        """Description length in bytes under the better language."""
        data = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(data)) for c in self.coders)

    def _fill(self, part: str, before: str, after: str, codec: str) -> str:
        """The character of a sequence that lost a byte, if one is by far the likeliest."""
        key = (part, before, after, UNDEFINED[codec] if LOST in part else ())
        if key not in self.filled:
            if len(self.filled) >= FILLS:
                self.filled.clear()
            self.filled[key] = self._likeliest(part, before, after, codec)
        return self.filled[key]

    def _likeliest(self, part: str, before: str, after: str, codec: str) -> str:
        scores, lead, tail = [(1, LOST)], ord(part[0]), ord(part[1])
        for x in UNDEFINED[codec] if LOST in part else range(0x80, 0xA0):
            for data in ((lead, tail, x), (lead, x, tail)) if lead == 0xE2 else ((lead, tail, x),):
                ch = bytes(data).decode()
                scores.append(((1 + self.pairs.get(before + ch, 0)) * (1 + self.pairs.get(ch + after, 0)), ch))
        (first, ch), (second, _) = sorted(scores, reverse=True)[:2]
        return ch if first >= FAR_LIKELIER * second else LOST

    def undo(self, text: str, codec: str, raw: str | None = None) -> tuple[str, int, int]:
        """``text`` with the runs that ``codec`` explains decoded, its unexplained letters, and how many of its characters were."""
        raw = text.translate(TABLES[codec]) if raw is None else raw
        if not _SEQUENCES.search(raw):
            return text, 0, 0
        out, at, last, done = [], 0, "", 0
        read: set[str] = set()
        left: list[str] = []
        for run in _RUN.finditer(raw):
            a, b = run.span()
            spots = list(_SEQUENCES.finditer(raw, a, b))
            decoded = [_decoded(m) if m.lastgroup == "whole" else "\u0900" if m.group()[0] == "\xe0" else "\u2013" for m in spots]
            if not spots or not plausible(text, raw, a, b, spots, decoded):
                left.append(text[a:b])
                continue
            for i, m in enumerate(spots):
                start, end = m.span()
                if start > at:
                    out.append(text[at:start])
                    last = out[-1][-1]
                    if start > a:
                        left.append(text[max(a, at) : start])
                if m.lastgroup == "whole":
                    out.append(decoded[i])
                else:
                    # what follows, decoded, if it is whole
                    nxt = i + 1 < len(spots) and spots[i + 1].start() == end
                    after = text[end : end + 1] if not nxt else decoded[i + 1][:1] if spots[i + 1].lastgroup == "whole" else ""
                    ch = self._fill(m.group(), last, after, codec)
                    # a sign that nothing speaks for stays as it was
                    out.append(text[start:end] if ch == LOST and m.group()[0] == "\xe2" else ch)
                last, at = out[-1][-1], end
                done += end - start
                read.update(map(script, set(text[start:end])))
            left.append(text[at:b])
        read.discard("")
        return "".join([*out, text[at:]]), sum(script(c) in read for part in left for c in part) if read else 0, done

    def candidates(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(description length, text, chain) of every decoding of every text of a chain, each text once.

        Each step tries every codec.  Chains go on from the texts in which most
        was decoded; other codecs read the rest in later steps.  Decoding makes
        a text shorter, so chains end by themselves.
        """
        seen, level, step = {text}, [(text, "", 0)], 0
        while level:
            step += 1
            made = []
            for t, chain, unexplained in level:
                raws: dict[tuple[str, tuple], str] = {}
                for codec in CODECS:
                    # codecs that read the same bytes are one
                    raw = t.translate(TABLES[codec])
                    if raws.setdefault((raw, UNDEFINED[codec] if LOST in t else ()), codec) != codec:
                        continue
                    got, more, done = self.undo(t, codec, raw)
                    if done and got not in seen:
                        seen.add(got)
                        name = f"{chain}>{codec}" if chain else codec
                        yield self.length(got) + STEP_COST * step + UNEXPLAINED_COST * (unexplained + more), got, name
                        made.append((done, got, name, unexplained + more))
            most = max((m[0] for m in made), default=0)
            level = [m[1:] for m in made if m[0] >= NEAR * most and maybe_garbled(m[1])]

    def __call__(self, text: str) -> tuple[str, bool, str]:
        """(restored text, was it found, chain of codecs)."""
        if not maybe_garbled(text):
            return text, False, ""
        best = None
        for cost, got, chain in self.candidates(text):
            best = best or (self.length(text), text, "")
            if cost < best[0]:
                best = (cost, got, chain)
        if best is not None and best[2]:
            return best[1], True, best[2]
        lost = text.count(LOST)
        if lost:
            bare = text.replace(LOST, "")
            return text, self.length(bare) + STEP_COST < self.length(text) + ALIEN_COST * lost, ""
        return text, False, ""


def encoded_values(chunks: DataFrame) -> DataFrame:
    """(chunk_row_id, field, value) of text, ch_title and sec_title, without nulls."""
    fields = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in (("text", "text"), ("ch_title", "hierarchy.ch_title"), ("sec_title", "hierarchy.sec_title"))]
    )
    return chunks.select("chunk_row_id", F.explode(fields).alias("f")).select("chunk_row_id", "f.field", "f.value").filter("value IS NOT NULL")


def restored(chunks: DataFrame) -> DataFrame:
    """The wrongly decoded values with what they become and by which chain.

    A column kernel leaves the values that hold characters of a wrong decoding;
    every other value is unchanged by definition.  ``recovered`` is false where
    lost characters remain.
    """
    models = models_of(chunks)
    schema = "chunk_row_id bigint, field string, restored string, chain string, recovered boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repairer(models)
        for b in batches:
            value = column(b, "value")
            b = b.filter(matches(value, GARBLED_RE2))
            rows = []
            for key, name, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                got, found, chain = repair(text)
                if found:
                    rows.append((key, name, got, chain, bool(chain) and LOST not in got))
            cols = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["chunk_row_id", "field", "restored", "chain", "recovered"])

    return encoded_values(chunks).mapInArrow(scan, schema)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with text decoded in a wrong encoding."""
    return restored(table(spark, sf_dir, "chunks")).select("chunk_row_id", "field")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored values and the chain of each."""
    return restored(table(spark, sf_dir, "chunks"))
