"""One consistent form for text that looks the same in other characters.

The operator works on tokens.  A vocabulary of plainly spelled tokens of the
whole corpus is put into tries, sharded by what words look like; a weighted
edit automaton walks a trie, at no cost for look-alikes, ignorable characters
and vowel compositions, at a small cost for letters that look alike only in
some fonts or to one of several letters, and every suspicious token takes the
cheapest, then most frequent spelling within the budget.  Tokens that reach
none are normalised by table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.io import materialise, table
from lekhya.llm import encoding
from lekhya.llm.columns import column, counts, matches, split

# Characters that look like plain ones.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοικναερτυχ"
GREEK_LATIN = "ABEZHIKMNOPTYXoikvaeptux"
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеіјорсухѕһԁԛԝӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaeijopcyxshdqwl"
LATIN_OF = dict(zip(GREEK + CYRILLIC, GREEK_LATIN + CYRILLIC_LATIN))
#: Letters that look like these in some fonts, or like a second letter.
WEAK_OF = {"Ι": "l", "І": "l", "ӏ": "I", "υ": "v", "η": "n", "ω": "w", "п": "n", "г": "r", "к": "k", "м": "m", "т": "t"}
#: Costs of the automaton, and the budget of a token with letters of two scripts;
#: whole foreign words get none, so that they stay what they are.
WEAK, EDIT, BUDGET = 0.25, 1.0, 0.5
#: Plain letters that one foreign letter can stand for are one in the key of the shards.
CLASSES = ("Iv", "lu")
#: Digits of other Indic scripts that stand for Devanagari ones.
INDIC_ZEROS = "০੦૦୦"
DIGIT_OF = {chr(ord(z) + i): chr(0x966 + i) for z in INDIC_ZEROS for i in range(10)}
VOWELS = {
    "ाे": "ो", "ाै": "ौ", "ेा": "ो", "ैा": "ौ", "अा": "आ", "अाे": "ओ", "अाै": "औ", "अो": "ओ", "अौ": "औ",
    "आे": "ओ", "आै": "औ", "एे": "ऐ", "ाॅ": "ॉ", "अॉ": "ऑ", "अॅ": "ऍ",
}
SPACES = "               　"
INVISIBLE = "­​‎‏⁠⁡⁢⁣⁤﻿"
JOINERS = "‌‍"
VIRAMA = "्"

_VOWEL = re.compile("|".join(sorted(VOWELS, key=len, reverse=True)))
_LOOSE_JOINER = re.compile(f"(?<!{VIRAMA})[{JOINERS}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
_WIDE = re.compile("[！-～￠-￦ﬀ-ﬆ]")
_LETTERS = re.compile(r"[A-Za-zÀ-ɏͰ-Ͽἀ-῿Ѐ-ԯ]+")
_CLASS = (
    f"{SPACES}{INVISIBLE}̀-ͯͰ-ϿЀ-ԯ！-～￠-￦ﬀ-ﬆ"
    "০-৯੦-੯૦-૯୦-୯"
)
_VOWEL_PAIRS = "ा[ेैॅ]|[ेै]ा|अ[ाोौॉॅ]|आ[ेै]|एे"
#: What a value must contain to be looked at, for Python and for RE2.
_SUSPECT = re.compile(f"[{_CLASS}]|(?<!{VIRAMA})[{JOINERS}]|{_VOWEL_PAIRS}")
SUSPECT_RE2 = f"[{_CLASS}]|(?:^|[^{VIRAMA}])[{JOINERS}]|{_VOWEL_PAIRS}"
#: Between the words of the vocabulary.
SEPARATORS = r"(?:\s|।|[,;:()\[\]“”\"'’‘.!?–—|/-])+"
#: Suspicious spellings of a shard, on average; its trie has only words that look like them.
SHARD_TOKENS = 50_000


def script_of(ch: str) -> str:
    o = ord(ch)
    return "greek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "cyrillic" if 0x400 <= o < 0x530 else "latin"


def _one_script(m: re.Match) -> str:
    word = m.group()
    if len(word) == 1 or len({script_of(c) for c in word}) == 1:
        return word
    return "".join(LATIN_OF.get(c, c) for c in word)


def unify(text: str) -> str:
    """The table: ordinary width and spaces, NFC, one vowel sign, one script."""
    if not _SUSPECT.search(text):
        return text
    text = _SPACE.sub(" ", _LOOSE_JOINER.sub("", _INVISIBLE.sub("", text)))
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = unicodedata.normalize("NFC", text)
    text = _VOWEL.sub(lambda m: VOWELS[m.group()], text)
    text = "".join(DIGIT_OF.get(c, c) for c in text)
    return _LETTERS.sub(_one_script, text)


def skeleton(token: str) -> str:
    """The image under all zero-cost edits: equal skeletons look alike."""
    token = _LOOSE_JOINER.sub("", _INVISIBLE.sub("", token))
    token = unicodedata.normalize("NFC", _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), token))
    token = _VOWEL.sub(lambda m: VOWELS[m.group()], token)
    return "".join(LATIN_OF.get(c, DIGIT_OF.get(c, c)) for c in token)


def look(token: str) -> str:
    """The key under which tokens meet the words that they may look like."""
    weak = "".join(WEAK_OF.get(c, c) if c not in LATIN_OF else c for c in token)
    return skeleton(weak).translate(str.maketrans(*CLASSES))


def budget_of(token: str) -> float:
    """BUDGET for a token with letters of two scripts or other suspicious characters, 0 for a foreign word."""
    letters = [c for c in token if _LETTERS.match(c)]
    return BUDGET if any(c.isascii() for c in letters) and any(script_of(c) != "latin" for c in letters) else 0.0


class Trie:
    """Spellings with counts, walked by a weighted edit automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = (count + node.get("", (0, word))[0], word)

    def search(self, token: str, budget: float = 0) -> tuple[float, str] | None:
        """(cost, spelling) of the cheapest, then most frequent, then first spelling.

        Look-alikes, ignorable characters and vowel compositions cost nothing,
        weak look-alikes WEAK, any other insertion, deletion or substitution EDIT.
        """
        best: tuple[float, int, str] | None = None
        stack, seen = [(0, self.root, 0.0)], {}
        while stack:
            i, node, cost = stack.pop()
            key = (i, id(node))
            if cost > budget or seen.get(key, budget + 1) <= cost:
                continue
            seen[key] = cost
            if i == len(token):
                if "" in node:
                    count, word = node[""]
                    rank = (cost, -count, word)
                    best = rank if best is None else min(best, rank)
            else:
                ch = token[i]
                loose = ch in JOINERS and (i == 0 or token[i - 1] != VIRAMA)
                stack.append((i + 1, node, cost if loose or ch in INVISIBLE else cost + EDIT))
                for n in (3, 2):
                    to = VOWELS.get(token[i : i + n]) if i + n <= len(token) else None
                    if to in node:
                        stack.append((i + n, node[to], cost))
                same = {ch, LATIN_OF.get(ch, ch), DIGIT_OF.get(ch, ch), unicodedata.normalize("NFKC", ch) if _WIDE.match(ch) else ch}
                pair = unicodedata.normalize("NFC", token[i : i + 2]) if i + 2 <= len(token) else ""
                for edge, child in node.items():
                    if edge == "":
                        continue
                    if edge == pair:
                        stack.append((i + 2, child, cost))
                    if edge in same:
                        stack.append((i + 1, child, cost))
                    elif WEAK_OF.get(ch) == edge:
                        stack.append((i + 1, child, cost + WEAK))
                    elif cost + EDIT <= budget:
                        stack.append((i + 1, child, cost + EDIT))
            if cost + EDIT <= budget:
                stack.extend((i, child, cost + EDIT) for edge, child in node.items() if edge != "")
        return None if best is None else (best[0], best[2])


def token_parts(token: str) -> list[str]:
    """Pieces between marks that belong to no word, as the vocabulary has them."""
    return re.findall(r"[^\s।,;:()\[\]“”\"'’‘.!?–—|/-]+", token)


def canonical_tokens(suspects: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, canonical) for distinct ``suspects(token)``.

    ``vocabulary(token, n)`` holds plain spellings with counts.  Both sides
    meet by what they look like, so a shard's trie has only words that some
    suspect may mean.
    """
    key = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else look(x)), "string")
    asked = suspects.select("token").dropna().distinct().withColumn("look", key("token"))
    shards = asked.count() // SHARD_TOKENS + 1
    looks = asked.select("look").distinct()
    known = vocabulary.select(F.col("token").alias("word"), F.col("n").alias("n_word"), F.translate("token", *CLASSES).alias("look")).join(looks, "look", "left_semi")

    def shard(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(shards)).cast("int")

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for word, n in zip(right["word"], right["n_word"]):
            trie.add(word, int(n))
        out = []
        for token in left["token"]:
            got = trie.search(token, budget_of(token))
            out.append((token, got[1] if got else unify(token)))
        return pd.DataFrame(out, columns=["token", "canonical"])

    return (
        asked.withColumn("shard", shard("look")).groupBy("shard")
        .cogroup(known.withColumn("word_shard", shard("look")).groupBy("word_shard"))
        .applyInPandas(walk, "token string, canonical string")
    )


def visual_values(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(src_table, src_id, item_pos, value) of the three fields, without nulls."""
    docs = entities.select("entity_id", F.posexplode("documents_required").alias("pos", "value"))
    return (
        chunks.select(F.lit("chunks").alias("src_table"), F.col("chunk_row_id").alias("src_id"), F.lit(0).alias("item_pos"), F.col("text").alias("value"))
        .unionByName(entities.select(F.lit("entities.office").alias("src_table"), F.col("entity_id").alias("src_id"), F.lit(0).alias("item_pos"), F.col("office.name").alias("value")))
        .unionByName(docs.select(F.lit("entities.documents_required").alias("src_table"), F.col("entity_id").alias("src_id"), F.col("pos").alias("item_pos"), "value"))
        .filter("value IS NOT NULL")
    )


def scan_tokens(values: DataFrame, models: encoding.Models) -> DataFrame:
    """One pass over the values: suspicious tokens, and counts of plain ones.

    Rows (src_table, src_id, item_pos, token, n): with a key the token is a
    suspicious piece of that value, spaces of other kinds being the token ' ';
    without a key it is a plain spelling of the vocabulary, n times in a batch.
    Wrongly decoded values have no tokens.
    """
    schema = "src_table string, src_id bigint, item_pos int, token string, n bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = encoding.Repairer(models)
        for b in batches:
            value = column(b, "value")
            odd = matches(value, SUSPECT_RE2)
            rows, read = [], []
            picked = b.filter(odd)
            for src, key, pos, text in zip(*(picked.column(i).to_pylist() for i in range(4))):
                if encoding.maybe_garbled(text) and repair(text)[1]:
                    continue
                read.append(_SPACE.sub(" ", text))
                if _SPACE.search(text):
                    rows.append((src, key, pos, " "))
                for token in re.split(rf"[\s{SPACES}]+", text):
                    if _SUSPECT.search(token):
                        parts = [p for p in token_parts(token) if _SUSPECT.search(p)]
                        rows.extend((src, key, pos, p) for p in parts or [token])
            words = split(pa.concat_arrays([value.filter(pc.invert(odd)), pa.array(read, pa.string())]), SEPARATORS)[1]
            word, n = counts(words)
            if read:
                plain = pc.invert(matches(word, SUSPECT_RE2))
                word, n = word.filter(plain), n.filter(plain)
            keys = list(zip(*rows)) if rows else [()] * 4
            none = len(word)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*keys[0], *[None] * none], pa.string()), pa.array([*keys[1], *[None] * none], pa.int64()),
                    pa.array([*keys[2], *[None] * none], pa.int32()), pa.concat_arrays([pa.array(keys[3], pa.string()), word]),
                    pa.concat_arrays([pa.nulls(len(rows), pa.int64()), n]),
                ],
                ["src_table", "src_id", "item_pos", "token", "n"],
            )

    return values.select("src_table", "src_id", "item_pos", "value").mapInArrow(scan, schema)


def unified(values: DataFrame, models: encoding.Models) -> DataFrame:
    """The suspicious tokens of every value with their canonical spelling."""
    scanned = materialise(scan_tokens(values, models))
    tokens = scanned.filter("src_table IS NOT NULL").drop("n")
    vocabulary = scanned.filter("src_table IS NULL AND length(token) > 1").groupBy("token").agg(F.sum("n").alias("n"))
    words = tokens.filter("token <> ' '")
    canon = canonical_tokens(words, vocabulary)
    return words.join(canon, "token").unionByName(
        tokens.filter("token = ' '").select("token", "src_table", "src_id", "item_pos", F.lit("").alias("canonical"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with characters that should be unified."""
    chunks = table(spark, sf_dir, "chunks")
    values = visual_values(chunks, table(spark, sf_dir, "entities"))
    got = unified(values, encoding.models_of(chunks))
    return got.filter("token <> canonical").select("src_table", "src_id", "item_pos").distinct()


_PIECE = re.compile(r"[^\s।,;:()\[\]“”\"'’‘.!?–—|/-]+")


def respelled(text: str, spelling: dict[str, str]) -> str:
    """The text with its tokens spelled as told, and ordinary spaces."""

    def one(m: re.Match) -> str:
        token = m.group()
        return spelling[token] if token in spelling else _PIECE.sub(lambda p: spelling.get(p.group(), p.group()), token)

    return re.sub(r"\S+", one, _SPACE.sub(" ", text))


def unified_values(values: DataFrame, models: encoding.Models) -> DataFrame:
    """(src_table, src_id, item_pos, unified) of every affected value.

    A value takes its spellings along as a map, so that it is written anew from
    nothing but the row.  Repeated keys give a row each.
    """
    keys = ["src_table", "src_id", "item_pos"]
    found = unified(values, models).filter("token <> canonical")
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("token", "canonical"))).alias("spelling"))

    @F.pandas_udf("string")
    def write(text: pd.Series, spelling: pd.Series) -> pd.Series:
        return pd.Series([respelled(t, dict(s)) for t, s in zip(text, spelling)])

    return values.join(maps, keys).select(*keys, write("value", "spelling").alias("unified"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected values in their one consistent form."""
    chunks = table(spark, sf_dir, "chunks")
    return unified_values(visual_values(chunks, table(spark, sf_dir, "entities")), encoding.models_of(chunks))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected tokens: how often each spelling occurs and what it becomes."""
    chunks = table(spark, sf_dir, "chunks")
    values = visual_values(chunks, table(spark, sf_dir, "entities"))
    got = unified(values, encoding.models_of(chunks)).filter("token <> canonical")
    return got.groupBy("token", "canonical").agg(F.count("*").alias("n_values"))
