"""Freely typed names to the entries of a canonical list.

Every spelling of an entry (name, translation, order of kind and place, short
form) is a key of a BK-tree under the Levenshtein metric; the triangle
inequality prunes the search, which returns every key within the radius.  Each
form of a name (as written, then with less and less around it) asks the tree;
the entry of the fewest slips wins, then that of the fuller form.

Distinct names are counted on the map side and matched once.  A small list is
one tree held by every worker; a large one is cut into shards, every shard
answers every bucket of names, and the shard winners are merged.  The answers
join back by name; names that hold a thousandth of all rows or more, so at most
a thousand, are broadcast and their rows never shuffled.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.io import materialise, small_rows, table
from lekhya.llm.visual import INVISIBLE, JOINERS, LATIN_OF, SPACES, unify

#: A reference list up to this many entries is one tree in every worker.
SMALL_LIST = 20_000
#: Edits within which a key is a candidate: a swap of neighbours is two.
RADIUS = 2
#: Two slips count in keys this long, if so many characters lie from the first to the last.
TWO_SLIPS, APART = 16, 9
UNKNOWN = -1
#: Names of a bucket that meets a shard, on average.
BUCKET_NAMES = 50_000
#: A name with this part of all rows is hot.
HOT_PART = 1000

# Words around an office's name, and short forms of its words.
HONORIFICS = ("श्री", "the")
TAILS = (
    "को केन्द्रीय कार्यालय", "को मुख्य कार्यालय", "को कार्यालय", "मुख्य कार्यालय", "केन्द्रीय कार्यालय", "दर्ता शाखा", "दर्ता फाँट",
    "शाखा", "फाँट", "मार्फत", "मार्फत्", "समक्ष", "अन्तर्गत", "जिल्ला", "head office", "registration desk", "registration section",
    "registration branch", "desk", "branch", "section",
)
ENDINGS = ("द्वारा", "बाट", "लाई", "सँग", "देखि", "सम्म", "को", "का", "की", "मा", "ले")
SHORT_WORDS = {
    "न.पा.": "नगरपालिका", "गा.पा.": "गाउँपालिका", "जि.प्र.का.": "जिल्ला प्रशासन कार्यालय", "आ.रा.का.": "आन्तरिक राजस्व कार्यालय",
    "प्र.उ.का.": "प्रदेश उद्योग कार्यालय", "मा.पो.का.": "मालपोत कार्यालय", "मा.का.": "मालपोत कार्यालय",
    "का.": "कार्यालय", "वि.": "विभाग", "मन्त्रा.": "मन्त्रालय",
}
ENGLISH_WORDS = ("office", "ministry", "department", "municipality", "authority", "board", "administration", "district", "provincial", "revenue")
ENGLISH_SHORT = {"dept": "department", "govt": "government", "mun": "municipality", "off": "office", "min": "ministry", "auth": "authority", "bd": "board", "rm": "rural municipality"}
#: Spelling classes: vowel length, nasals, sibilants, b and v, geminates.
_FOLD = str.maketrans({"ी": "ि", "ू": "ु", "ई": "इ", "ऊ": "उ", "ँ": None, "ं": None, "श": "स", "ष": "स", "ण": "न", "ञ": "न", "ङ": "न", "व": "ब", "़": None})
_GEMINATE = re.compile("([क-ह])्(?=\\1)|द्(?=ध)|च्(?=छ)|ट्(?=ठ)|त्(?=थ)|क्(?=ख)")
_EDGE = " \t\n।.,;:-–—|\"'“”‘’`_*•"


def plain(name: str) -> str:
    """One form of characters, case, spaces and short words; a JSON object's name."""
    text = name.strip()
    if text.startswith("{"):
        try:
            got = json.loads(text)
            text = str(got.get("name") or "") if isinstance(got, dict) else text
        except ValueError:
            m = re.search(r'"name"\s*:\s*"([^"]*)', text)
            text = m.group(1) if m else text
    text = re.sub(f"[{INVISIBLE}{JOINERS}]", "", unify(unicodedata.normalize("NFKC", text)))
    if re.search("[A-Za-z]", text):
        text = "".join(LATIN_OF.get(c, c) for c in text)
    text = re.sub(rf"[\s{SPACES}]+", " ", text).lower().strip(_EDGE.replace(".", ""))
    for short, full in SHORT_WORDS.items():
        if short in text:
            text = re.sub(rf"(?<![ऀ-ॿ.]){re.escape(short)}", full + " ", text)
    if re.search("[a-z]", text):
        text = re.sub(r"\b([a-z]+)\.(?=\s|,|$)", lambda m: _long_word(m.group(1)), text)
    return text.strip(_EDGE)


def _long_word(word: str) -> str:
    if word in ENGLISH_SHORT:
        return ENGLISH_SHORT[word]
    full = [w for w in ENGLISH_WORDS if len(word) > 2 and w.startswith(word)]
    return full[0] if len(full) == 1 else word + "."


def keys_of(text: str) -> list[str]:
    """The tree's keys: folded spelling without spaces and marks.

    The second keeps doubled consonants, so that a slip inside one is one slip.
    """
    bare = re.sub(r"[^0-9a-zऀ-ॿ]+", "", text).translate(_FOLD)
    return list(dict.fromkeys((_GEMINATE.sub("", bare), bare)))


def forms(name: str) -> list[str]:
    """The name, then the name with less and less around it, as keys."""
    text = plain(name)
    out = [text]
    bare = re.sub(r"\s*\([^)]*\)?\s*", " ", text).strip(_EDGE)
    if bare != text:
        out += [bare, *(x.strip(_EDGE) for x in re.findall(r"\(([^)]*)", text))]
    for start in list(out):
        for _ in range(4):
            cut = start
            for h in HONORIFICS:
                cut = cut.removeprefix(h + " ").strip(_EDGE)
            for tail in TAILS:
                if cut.endswith(tail) and len(cut) > len(tail) + 2:
                    cut = cut[: -len(tail)].strip(_EDGE)
                    break
            else:
                for end in ENDINGS:
                    if cut.endswith(end) and len(cut) > len(end) + 3:
                        if cut != start:
                            out.append(cut)
                        cut = cut[: -len(end)].strip(_EDGE)
                        break
            if cut == start:
                break
            out.append(cut)
            start = cut
    return [k for k in dict.fromkeys(k for x in out for k in keys_of(x)) if k]


def entry_keys(name: str | None, name_en: str | None) -> Iterator[str]:
    """Keys of one entry: both languages, and place before kind."""
    for text in (name, name_en):
        if not text or not text.strip():
            continue
        base = plain(text)
        yield from keys_of(base)
        kind, comma, place = (x.strip() for x in base.partition(","))
        if comma:
            for x in ("", "स्थित", "को", "मा रहेको"):
                yield from keys_of(place + x + kind)
            if place.isascii():
                yield from keys_of(f"{kind} of {place}")
                yield from keys_of(f"{kind} at {place}")


def short_key(text: str) -> str:
    return re.sub(r"[^0-9a-zऀ-ॿ]+", "", text.lower())


def edits(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, bit-parallel (Myers 1999)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | 1 << i
    top, mask = 1 << (len(a) - 1), (1 << len(a)) - 1
    pv, mv, score = mask, 0, len(a)
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return score


def one_slip(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and len(x) > 1 and x[2:] == y[2:])


def slips(a: str, b: str, distance: int) -> int | None:
    """Slips of the pen between keys of that distance: 0, 1, 2 or None for no match.

    Two must lie apart in long keys, as they do by accident; two side by side
    make another name, of another place for instance.
    """
    if distance < 2:
        return distance if distance == 0 or min(len(a), len(b)) > 3 else None
    if one_slip(a, b):
        return 1 if min(len(a), len(b)) > 3 else None
    if min(len(a), len(b)) < TWO_SLIPS:
        return None
    start = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), 0)
    end = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), 0)
    return 2 if max(len(a), len(b)) - start - end >= APART else None


class BKTree:
    """Keys under a true metric; each key holds the ids that it names."""

    def __init__(self, items: Iterable[tuple[str, int]] = ()) -> None:
        self.root: list | None = None
        for key, ident in items:
            self.add(key, ident)

    def add(self, key: str, ident: int) -> None:
        if self.root is None:
            self.root = [key, {ident}, {}]
            return
        node = self.root
        while True:
            d = edits(key, node[0])
            if d == 0:
                node[1].add(ident)
                return
            if d not in node[2]:
                node[2][d] = [key, {ident}, {}]
                return
            node = node[2][d]

    def within(self, key: str, radius: int) -> list[tuple[int, str, set[int]]]:
        """Every (distance, key, ids) not farther than ``radius``."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = edits(key, node[0])
            if d <= radius:
                out.append((d, node[0], node[1]))
            stack.extend(child for at, child in node[2].items() if d - radius <= at <= d + radius)
        return out


class Matcher:
    """The tree over all spellings of some entries, short forms among them.

    ``within`` gives every entry within the threshold, ``winners`` the nearest.
    Both are dicts id -> (slips, rank); the rank is that of the form that hit,
    names before short forms.  Several winners name no particular entry.
    """

    def __init__(self, entries: list[tuple[int, str | None, str | None, str | None]]) -> None:
        self.tree, self.short = BKTree(), BKTree()
        for ident, name, name_en, abbr in entries:
            for key in dict.fromkeys(entry_keys(name, name_en)):
                self.tree.add(key, ident)
            if abbr and abbr.strip():
                self.short.add(short_key(abbr), ident)

    def _ask(self, keys: list[str], radius: int, stop: bool) -> dict[int, tuple[int, int]]:
        """The entries within ``radius`` of the forms; ``stop`` ends at the first form that hits."""
        best: dict[int, tuple[int, int]] = {}
        for rank, key in enumerate(keys):
            # a slip in a short form is another short form
            for at, (tree, r) in enumerate(((self.tree, radius), (self.short, 0))):
                for d, known, ids in tree.within(key, r):
                    n = slips(key, known, d)
                    for i in ids if n is not None else ():
                        best[i] = min(best.get(i, (9, 0)), (n, 2 * rank + at))
                if best and stop:
                    return best
        return best

    def within(self, name: str) -> dict[int, tuple[int, int]]:
        return self._ask(forms(name), RADIUS, False)

    def winners(self, name: str) -> dict[int, tuple[int, int]]:
        keys = forms(name)
        # what is written as in the list needs no wider search
        got = self._ask(keys, 0, True) or self._ask(keys, RADIUS, False)
        least = min(got.values(), default=None)
        return {i: x for i, x in got.items() if x == least}

    def __call__(self, name: str) -> int | None:
        """The entry meant, -1 if several are as near, None if nothing is near."""
        got = self.winners(name)
        return None if not got else next(iter(got)) if len(got) == 1 else UNKNOWN


def _entries(reference: DataFrame) -> DataFrame:
    return reference.select("office_id", "name", "name_en", "abbr").filter("office_id IS NOT NULL")


def _named(column: str) -> Column:
    return F.col(column).rlike(r"\S")


NEAR = "_name string, office_id int, slips int, rank int"


def _answers(names: Iterable[str], find: Matcher, every: bool) -> pd.DataFrame:
    rows = [(n, i, *x) for n in names for i, x in (find.within(n) if every else find.winners(n)).items()]
    return pd.DataFrame(rows, columns=["_name", "office_id", "slips", "rank"]).astype({"office_id": "int32", "slips": "int32", "rank": "int32"})


def near_small(names: DataFrame, reference: DataFrame, every: bool = False) -> DataFrame:
    """(_name, office_id, slips, rank) for distinct ``names(_name)``: the winners, or every entry within the threshold.

    One tree per worker; the list is checked to have at most SMALL_LIST rows.
    """
    entries = [tuple(r) for r in small_rows(_entries(reference), SMALL_LIST)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Matcher(entries)
        for b in batches:
            yield _answers(b["_name"], find, every)

    return names.select("_name").mapInPandas(run, NEAR)


def near_sharded(names: DataFrame, reference: DataFrame, shards: int, buckets: int = 1, every: bool = False) -> DataFrame:
    """As ``near_small`` for lists of any size: every bucket of names meets every shard of the list."""
    asked = names.select(
        "_name", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.pmod(F.xxhash64("_name"), F.lit(buckets)).cast("int").alias("_bucket")
    )
    refs = _entries(reference).select(
        "*", F.pmod(F.xxhash64("office_id"), F.lit(shards)).cast("int").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket")
    )

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text = right[["name", "name_en", "abbr"]].astype(object).where(lambda x: x.notna(), None)
        find = Matcher(list(zip(right["office_id"].astype(int), text["name"], text["name_en"], text["abbr"])))
        return _answers(left["_name"], find, every)

    keys = ["_shard", "_bucket"]
    return asked.groupBy(*keys).cogroup(refs.groupBy(*keys)).applyInPandas(answer, NEAR)


def merged(near: DataFrame, out: str) -> DataFrame:
    """(_name, out): the winner among the winners of all shards, -1 if several are as near."""
    alike = near.groupBy("_name", "slips", "rank").agg(F.min("office_id").alias("_lo"), F.max("office_id").alias("_hi"))
    one = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.lit(UNKNOWN))
    return alike.groupBy("_name").agg(F.min_by(one, F.struct("slips", "rank")).alias(out))


def near(names: DataFrame, reference: DataFrame, n_names: int, every: bool = False) -> DataFrame:
    """``near_small`` where the list is small, else ``near_sharded``."""
    n = _entries(reference).count()
    if n <= SMALL_LIST:
        # each distinct name is work for the tree, so few rows still fill the cores
        tasks = names.sparkSession.sparkContext.defaultParallelism
        return near_small(names.repartition(max(tasks, n_names // BUCKET_NAMES + 1), "_name"), reference, every)
    return near_sharded(names, reference, -(-n // SMALL_LIST), n_names // BUCKET_NAMES + 1, every)


def counted_names(values: DataFrame, column: str) -> DataFrame:
    """(_name, _n) of the distinct names that are not null or blank."""
    return values.filter(_named(column)).groupBy(F.col(column).alias("_name")).agg(F.count("*").alias("_n"))


def map_names(values: DataFrame, reference: DataFrame, column: str, out: str = "office_id") -> DataFrame:
    """``values`` with the id meant by ``column``; an existing column ``out`` is replaced.

    Null and blank names get null, names that fit no entry, or several, get -1.
    Equal names get equal ids; ties of distance and form are -1.
    """
    names = materialise(counted_names(values, column))
    n_names, total = names.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).collect()[0]
    answers = merged(near(names, reference, n_names), "_id")
    known = materialise(names.join(answers, "_name", "left").select("_name", (F.col("_n") * HOT_PART >= total).alias("_hot"), F.coalesce("_id", F.lit(UNKNOWN)).alias("_id")))
    rows = values.drop(out) if out != column else values
    hot, rest = (known.filter(c).select("_name", "_id") for c in ("_hot", "NOT _hot"))
    kept = rows.join(F.broadcast(hot), F.col(column) == F.col("_name"), "left").withColumnRenamed("_id", "_hot_id").drop("_name")
    cold = kept.filter(F.col("_hot_id").isNull() & _named(column)).join(rest, F.col(column) == F.col("_name")).drop("_name", "_hot_id")
    blank = ~F.coalesce(_named(column), F.lit(False))
    done = kept.filter(F.col("_hot_id").isNotNull() | blank).withColumnRenamed("_hot_id", "_id")
    return done.select(*rows.columns, F.col("_id").alias(out)).unionByName(cold.select(*rows.columns, F.col("_id").alias(out)))


def office_values(entities: DataFrame, ner_outputs: DataFrame) -> DataFrame:
    """(src_table, src_id, name) of every office name that is not null or blank."""
    return (
        entities.select(F.lit("entities").alias("src_table"), F.col("entity_id").alias("src_id"), F.col("office.name").alias("name"))
        .unionByName(ner_outputs.select(F.lit("ner_outputs").alias("src_table"), F.col("output_id").alias("src_id"), F.col("office").alias("name")))
        .filter(F.col("name").rlike(r"\S"))
    )


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office_values(table(spark, sf_dir, "entities"), table(spark, sf_dir, "ner_outputs"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_names(_values(spark, sf_dir), table(spark, sf_dir, "offices"), "name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The office meant by every name, -1 where the list does not hold it."""
    return _mapped(spark, sf_dir).select("src_table", "src_id", "office_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are not on the list, with how often they occur."""
    return _mapped(spark, sf_dir).filter(F.col("office_id") == UNKNOWN).groupBy("src_table", "name").agg(F.count("*").alias("n_values"))


def p1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every office within the threshold of each distinct name, with its slips and the rank of the form that hit."""
    names = materialise(counted_names(_values(spark, sf_dir), "name"))
    return near(names, table(spark, sf_dir, "offices"), names.count(), every=True).withColumnRenamed("_name", "name")
