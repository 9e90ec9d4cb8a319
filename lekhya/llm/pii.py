"""Personal information in free text, replaced by typed placeholders.

Patterns propose spans, validators of the numbers (Luhn, ISO 7064 mod 97) and
the words around adjust their score, and spans of sufficient score become
[EMAIL], [PHONE], [ID], [ADDRESS] or [NAME]; all other characters stay.  Every
document is worked on alone in the task that read it, in time linear in its
length: a span is judged by a window of words around it.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.io import small_rows, table

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
MAX_PARTS = 100_000
#: Score from which a proposed span is taken.
ACCEPT = 1.0
#: Characters before a span in which its words are looked for.
NEAR = 80
#: Scores of numbers: shapes of identity numbers, words before, check digits.
SHAPE, ID_WORD, VALID, INVALID, OTHER_WORD = 0.5, 0.6, 0.6, -0.6, -0.6

_ASCII = {0x966 + i: str(i) for i in range(10)} | {0xFF10 + i: str(i) for i in range(10)} | {0xFF20: "@", 0xFF0E: "."}
#: Before these a token goes on, or it belongs to an address of mail.
_INSIDE = "@._+-" + "".join(chr(c) for c in range(0x900, 0x97F) if not chr(c).isalpha() and not chr(c).isdigit() and c not in (0x964, 0x965))
_FOREIGN = re.compile("[०-९０-９＠．]+")
#: Enough digits for any number of a person.
_SIX = re.compile(r"\d[\d\-/ .()]{4,}\d")
#: A digit run with single separators, its plus, bracket or letters, its extension.
_NUMBER = re.compile(r"(?<![\w/.])(?:\+|\(|[A-Z]{1,2}(?=\d))?\d(?:[\d\-/ .()]{5,20})\d(?:\s?(?:ext|x)\.?\s?\d{1,5})?(?![\w/])")
#: Numbers of cards, plain or in groups; account numbers that start with a country and two check digits.
_CARD = re.compile(r"[1-9](?<![\w/.+-].)(?:\d{12,18}|\d{3}([ -])(?:\d{4}\1){2,3}\d{1,4}|\d{3}([ -])\d{6}\2\d{5})(?![\w/]|[.-]\d)")
_ACCOUNT = re.compile(r"[A-Z](?<![\w/.+-].)[A-Z]\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)")
# a plain "at" also stands before places: no box or initials after it
_EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9_])?\s?(?:@|\(at\)|\[at\]|\{at\}| at (?!\s?P\.\s?O\b)(?=\s?(?:[A-Za-z0-9-]+(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?| dot ))+[A-Za-z]{2}))\s?"
    r"[A-Za-z0-9-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?| dot )[A-Za-z0-9-]+)+",
    re.I,
)
#: What every match of _EMAIL holds, in lower case.
_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}| at \s?[a-z0-9-]+(?:\.| dot |\s?[(\[{]dot[)\]}])")

# Words before a number that say what it is.
ID_WORDS = re.compile(
    r"(?:ना\s*\.\s*प्र\s*\.\s*(?:प\s*\.\s*)?नं|नागरिकता|राहदानी|पासपोर्ट|परिचय\s*-?\s*पत्र|स्थायी\s+लेखा|प्यान|करदाता|मतदाता|"
    r"\bcitizenship|\bpassport|\bidentity|\bID\b|\bPAN\b|\btax\b|\bNID\b|\bcard\b)[^\d\n।]{0,28}$",
    re.I,
)
OTHER_NUMBER_WORDS = re.compile(
    r"(?:(?<![ऀ-ॿ])(?:लगत|मुद्दा|चलानी|दर्ता|फाइल|मिति|रकम|रु|संख्या|ऐन|नियमावली|खण्ड)|"
    r"\b(?:count|case|file|letter|invoice|dated?|total|decision|id=|act|reg(?:istration)?)\b)[^\d\n।]{0,14}$",
    re.I,
)
PHONE_WORDS = re.compile(r"(?:फोन|मोबाइल|मो\.|सम्पर्क|टेलिफोन|tel|phone|mobile|call|contact|fax|फ्याक्स)[^\d\n।+(]{0,20}[+(]?$", re.I)
STREET_NE = "मार्ग|टोल|गल्ली|चोक|सडक|पथ|बाटो|लेन"
STREET_EN = "Street|Road|Lane|Marg|Tole|Chowk|Avenue|Path|Square|Sadak|Galli"
_ADDRESS = [
    (re.compile(r"घर\s*(?:नं|न|नम्बर)\s*\.?\s*\d+[\d/]*"), 1.0),
    (re.compile(r"(?:पो(?:ष्ट|स्ट)?\s*\.?\s*(?:ब|बक्स|ब\.)\s*\.?\s*(?:नं)?\s*\.?\s*)\d+"), 1.0),
    (re.compile(rf"(?<![ऀ-ॿ])[ऀ-ॿ]{{3,}}\s+(?:{STREET_NE})(?![ऀ-ॿ])"), 0.5),
    (re.compile(rf"(?<![ऀ-ॿ])[ऀ-ॿ]{{3,}}\s+(?:{STREET_NE})\s*,?\s*\d+[\d/]*(?![\d।]*\s*(?:वटा|ओटा|जना))"), 1.0),
    (re.compile(r"\bP\.?\s?O\.?\s?B(?:ox|\.)\s*(?:No\.?\s*)?\d+", re.I), 1.0),
    (re.compile(r"\b(?:house|flat|apartment|apt\.?|plot)\s*(?:no\.?|number|#)?\s*[A-Z]?-?\d+[\d/]*\b", re.I), 1.0),
    (re.compile(rf"\b\d+(?:/\d+)?,?\s+[A-Z][a-zA-Z]+\s+(?:{STREET_EN})\b", re.I), 1.0),
    (re.compile(rf"\b[A-Z][a-zA-Z]{{2,}}\s+(?:{STREET_EN})\b"), 0.5),
]
#: What every match of _ADDRESS holds, in lower case.
_ADDRESS_HINTS = re.compile(
    "|".join([STREET_NE, r"घर\s*न", r"पो(?:ष्ट|स्ट)?\s*\.?\s*ब", r"p\.?\s?o\.?\s?b", "house", "flat", "apartment", "apt", "plot", STREET_EN.lower()])
)
ADDRESS_WORDS = re.compile(r"निवासी|बस्ने|ठेगाना|मा पर्छ|वडा|address|living at|resid|ward|stands at|complaint of", re.I)
TITLES = re.compile(r"(?:श्रीमती|सुश्री|श्री|डा\.|प्रा\.|इ\.|अधिवक्ता|\b(?:Mr|Mrs|Ms|Dr|Prof|Er|Adv)\.?)\s+$")
NAME_WORDS = re.compile(
    r"(?:निवासी|निवेदक|भवदीय|हस्ताक्षर|तयार गर्ने|बुझिलिने|विपक्षी|साक्षी|सञ्चालक|बैठकमा|तामेल गर्दा|टिप्पणी|नाम|म|र|signed|prepared by|received by|"
    r"respondent|applicant|present at the meeting were|\band|run by|served on|according to|faithfully|name of|name and address|complaint of|\bI)[\s:,)\-]*(?:ठेगाना[\s:\-]*)?$",
    re.I,
)
NAME_AFTER = re.compile(r"(?:..)?\s*(?:को नाममा|ले दिएको|ले |लाई |बाट |उपस्थित|was |drafted|and (?:Mr|Ms|Dr)|,? ?ID|\s?[-(<,]\s?[+(]?\d|\s?[-(<,]\s?(?:ना\.|घर|<))", re.S)
MIDDLES = {"कुमार", "बहादुर", "माया", "प्रसाद", "देवी", "कुमारी", "राज", "लाल", "kumar", "bahadur", "maya", "prasad", "devi", "kumari", "raj", "lal"}
CASES = ("द्वारा", "बाट", "लाई", "सँग", "हरू", "को", "का", "की", "मा", "ले")
_TOKEN = re.compile(r"[ऀ-ॿ‌‍]+|[A-Za-z]+(?:['’]s)?")
_IN_TOKEN = re.compile(r"[ऀ-ॿ‌‍A-Za-z'’]")
#: Ordinary sentence words that stand next to names but are no part of them.
ORGANISATION = re.compile(r"^(?:विभाग|मन्त्रालय|बोर्ड|प्राधिकरण|कार्यालय|समिति|शाखा|बैंक|कम्पनी|कार्यक्रम|केन्द्र|आयोग|प्रवर्द्धन)|^(?:office|board|ministry|department|committee|bank|authority|company|branch|programme|program|road|street|marg|tole|chowk|lane)$", re.I)


def luhn(digits: str) -> bool:
    """Luhn check of a run of ASCII digits; false for fewer than two."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return len(digits) > 1 and total % 10 == 0


def mod97(digits: str) -> bool:
    """ISO 7064 mod 97-10: the number leaves 1."""
    return len(digits) > 2 and int(digits) % 97 == 1


def account(text: str) -> bool:
    """ISO 13616: the first four go to the end, letters are 10 to 35, mod 97 holds."""
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and mod97("".join(str(int(c, 36)) for c in bare[4:] + bare[:4]))


@dataclass(frozen=True)
class Parts:
    """What the list of name parts tells: whole parts and their pieces."""

    given: frozenset
    surname: frozenset
    given_pieces: tuple
    surname_pieces: tuple
    ordinary: frozenset


def _pieces(words: set[str], least: int = 3) -> tuple[frozenset, frozenset]:
    """Beginnings and endings that at least ``least`` parts share, each way."""
    begin: dict[str, set[str]] = {}
    end: dict[str, set[str]] = {}
    for w in words:
        for i in range(2, len(w) - 1):
            begin.setdefault(w[:i], set()).add(w[i:])
            end.setdefault(w[i:], set()).add(w[:i])
    first = {b for b, es in begin.items() if len(es) >= least and len(b) >= 2}
    last = {e for e, bs in end.items() if len(bs) >= least and len(e) >= 2}
    # a beginning counts with the longest form that explains its words
    first = {b for b in first if not any(b != c and c.startswith(b) and len(begin[c]) == len(begin[b]) for c in first)}
    last = {e for e in last if not any(e != c and c.endswith(e) and len(end[c]) == len(end[e]) for c in last)}
    return frozenset(first), frozenset(last)


def learn(rows: list[tuple[str, str, str]]) -> Parts:
    """Parts from rows (name_part, script, role)."""
    given = {p.strip().lower() for p, _, role in rows if p and role == "given"}
    surname = {p.strip().lower() for p, _, role in rows if p and role == "surname"}
    gp, sp = _pieces(given), _pieces(surname)

    def made(w: str, pieces: tuple) -> bool:
        return any(w[:i] in pieces[0] and w[i:] in pieces[1] for i in range(2, len(w)))

    ordinary = frozenset(w for w in given if not made(w, gp)) | frozenset(w for w in surname if not made(w, sp))
    return Parts(frozenset(given), frozenset(surname), gp, sp, ordinary)


class Finder:
    """Spans of personal information in a text."""

    def __init__(self, parts: Parts) -> None:
        self.parts = parts
        self.memo: dict[str, tuple[float, float]] = {}
        # a beginning shorter than three letters says nothing by itself
        heads = {p for p in parts.surname_pieces[0] if len(p) >= 3}
        whole = {w for w in parts.surname if not w.startswith(tuple(heads))}
        starts = {c for w in heads | whole for c in (w, w.title(), w.upper()) if not c[0].islower()}
        self.anchor = re.compile("|".join(map(re.escape, sorted(starts, key=len, reverse=True)))) if starts else None

    # -- names ---------------------------------------------------------------

    def weigh(self, token: str) -> tuple[float, float]:
        """How much a token looks like a given name and like a surname."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[token] = max((self._weigh(t) for t in self._stems(token.lower())), key=sum)
        return got

    @staticmethod
    def _stems(token: str) -> Iterator[str]:
        yield token
        if token.endswith(("'s", "’s")):
            yield token[:-2]
        for c in CASES:
            if token.endswith(c) and len(token) > len(c) + 2:
                yield token[: -len(c)]

    def _weigh(self, w: str) -> tuple[float, float]:
        p, out = self.parts, []
        for whole, (first, last) in ((p.given, p.given_pieces), (p.surname, p.surname_pieces)):
            score = 0.0
            if w in whole:
                score = 0.4 if w in p.ordinary else 1.0
            else:
                for i in range(2, len(w)):
                    if w[:i] in first and (w[i:] in last):
                        score = 0.9
                        break
                    if w[:i] in first and len(w[:i]) >= 3 and 3 <= len(w[i:]) <= 6:
                        score = max(score, 0.5)
                    if w[i:] in last and len(w[i:]) >= 3 and 2 <= i <= 6:
                        score = max(score, 0.3)
            out.append(score)
        return out[0], out[1]

    def names(self, line: str) -> Iterator[tuple[int, int, float]]:
        for hit in self.anchor.finditer(line) if self.anchor else ():
            if hit.start() and (line[hit.start() - 1].isalpha() or line[hit.start() - 1] in _INSIDE):
                continue
            m = _TOKEN.match(line, hit.start())
            tok = m.group()
            s = self.weigh(tok)[1]
            if s < 0.5 or (tok[0].isascii() and not tok[0].isupper()):
                continue
            a, b = m.span()
            begin = max(0, a - 60)
            while begin > 0 and _IN_TOKEN.match(line, begin - 1):  # not inside a word
                begin -= 1
            tokens = [(t.start(), t.end(), t.group()) for t in _TOKEN.finditer(line, begin, min(len(line), b + 60))]
            k = next(i for i, t in enumerate(tokens) if t[0] == a)
            best = (0.0, 0, a, b)
            for step in (-1, -2, 1, 2):
                j = k + step
                if not 0 <= j < len(tokens):
                    continue
                x, y, other = tokens[j]
                lo, hi = min(a, x), max(b, y)
                gap = line[min(b, y) : max(a, x)]
                g = self.weigh(other)[0]
                if abs(step) == 2:
                    mid = tokens[k + step // 2][2]
                    if not (mid.lower() in MIDDLES or (len(mid) == 1 and mid.isupper())) or gap.replace(mid, "", 1).strip(" ."):
                        continue
                elif gap == ", " and step == 1 and g >= 0.4:
                    pass  # surname first
                elif gap.strip(" .") or "  " in gap or ("." in gap and len(other) > 1):
                    continue
                if ORGANISATION.search(other) or (other[0].isascii() and not other[0].isupper()):
                    continue
                if len(other) == 1 and other.isupper() and "." in gap and step < 0:
                    g = 0.6
                before, after = line[max(0, lo - 40) : lo], line[hi : hi + 14]
                context = 0.3 * bool(TITLES.search(before) or NAME_WORDS.search(before) or (step < 0 and NAME_AFTER.match(line[b - 2 : b + 14])) or NAME_AFTER.match(after))
                # an ordinary or unknown word counts as a name where the rest is sure
                score = s + (g if g else 0.2 * (s >= 0.9 or context > 0)) + context
                best = max(best, (round(score, 3), hi - lo, lo, hi))  # the longer of equals
            title = TITLES.search(line, max(0, a - NEAR), a)
            if title and s >= 0.9 and best[0] < ACCEPT:
                best = (1.2, b - a, a, b)
            if best[0] >= ACCEPT:
                lo, hi = best[2], best[3]
                last = line[lo:hi]
                for c in CASES:
                    if last.endswith(c) and self._weigh(last.split()[-1].lower()) == (0.0, 0.0):
                        hi -= len(c)
                        break
                yield lo, hi, best[0]

    # -- numbers -------------------------------------------------------------

    @staticmethod
    def identity(bare: str, digits: str) -> float:
        """The score of a number as an identity number, by its shape and its check digits alone.

        Runs and groups of card length have check digits that must hold; 10
        digits in threes or plain may have Luhn's, plain 11 and 12 those of mod
        97.  Where no scheme is known for a shape, words must speak for it.
        """
        if 13 <= len(digits) <= 19 and re.fullmatch(r"\d+|\d{4}(?:[ -]\d{1,4})+", bare):
            return SHAPE + (VALID if luhn(digits) or mod97(digits) else INVALID)
        if re.fullmatch(r"\d{2}-\d{2}-\d{2}-\d{5}", bare):
            return SHAPE + VALID  # the one fixed format whose groups say what they are
        if re.fullmatch(r"\d{3}-\d{3}-\d{3}-\d|\d{10}", bare):
            return SHAPE + VALID * luhn(digits)
        if re.fullmatch(r"\d{11,12}", bare):
            return SHAPE + VALID * mod97(digits)
        return SHAPE if 6 <= len(digits) <= 16 else 0.0

    def numbers(self, line: str) -> Iterator[tuple[int, int, str]]:
        for m in _NUMBER.finditer(line):
            text, near = m.group(), (line, max(0, m.start() - NEAR), m.start())
            if text[0] == "(" and ")" not in text:
                text = text[1:]
            bare = re.sub(r"\s?(?:ext|x)\.?.*$", "", text)
            digits = re.sub(r"\D", "", bare)
            if ID_WORDS.search(*near):
                end = re.match(r"[A-Z]{0,2}\d[\d/-]*", text)
                if end and len(digits) <= 16:
                    bare = end.group().rstrip("/-")
                    digits = re.sub(r"\D", "", bare)
                    if self.identity(bare, digits) + ID_WORD >= ACCEPT:
                        yield m.start(), m.start() + end.end(), "ID"
                continue
            phone_word, other = PHONE_WORDS.search(*near), OTHER_NUMBER_WORDS.search(*near)
            score = 0.0
            if re.fullmatch(r"(?:\+|00)977[\s-]?\d[\d\s-]{6,13}", bare) and 10 <= len(digits) <= 15:
                score = 1.2
            elif re.fullmatch(r"9\d{9}|9\d{2}[- ]\d{3}[- ]\d{4}|9\d{3}\.\d{3}\.\d{3}|9\d{3}-\d{6}|9\d{4}[- ]\d{5}", bare):
                score = 1.0
            elif re.fullmatch(r"0\d{1,2}-\d{6,7}|\(0\d{1,2}\)\s?-?\d{6,7}|0\d{1,2} \d{6,7}", bare):
                score = 1.0
            elif re.fullmatch(r"[\d\s().-]+", bare) and 7 <= len(digits) <= 12 and phone_word:
                score = 0.9
            if phone_word:
                score += 0.4
            if other:
                score += OTHER_WORD
            if score >= ACCEPT:
                yield m.end() - len(text), m.end(), "PHONE"
            elif len(digits) <= 12 and bare == text and not phone_word and self.identity(bare, digits) + OTHER_WORD * bool(other) >= ACCEPT:
                yield m.start(), m.end(), "ID"

    def checked(self, line: str) -> Iterator[tuple[int, int, str]]:
        """Numbers of card length whose check digits hold, with or without a word before."""
        for m in _CARD.finditer(line):
            digits = re.sub(r"\D", "", m.group())
            other = OTHER_NUMBER_WORDS.search(line, max(0, m.start() - NEAR), m.start())
            if 13 <= len(digits) <= 19 and SHAPE + (VALID if luhn(digits) or mod97(digits) else INVALID) + OTHER_WORD * bool(other) >= ACCEPT:
                yield m.start(), m.end(), "ID"

    def accounts(self, line: str) -> Iterator[tuple[int, int, str]]:
        """Account numbers with a country: mod 97 must hold."""
        for m in _ACCOUNT.finditer(line):
            # in groups the last may be the next word
            for end in (m.end(), m.start() + m.group().rfind(" ")):
                if end > m.start() and account(line[m.start() : end]):
                    yield m.start(), end, "ID"
                    break

    # -- all -----------------------------------------------------------------

    def addresses(self, line: str) -> Iterator[tuple[int, int, float]]:
        for pattern, score in _ADDRESS:
            for m in pattern.finditer(line):
                if score < ACCEPT:
                    near = line[max(0, m.start() - 40) : m.end() + 25]
                    digits = re.search(r"\d", line[max(0, m.start() - 28) : m.end() + 24])
                    if not (ADDRESS_WORDS.search(near) and (digits or re.search("निवासी|बस्ने|ठेगाना|living at|address", near, re.I))):
                        continue
                yield m.start(), m.end(), 1.0

    def line(self, plain: str, hints: set[str]) -> list[tuple[int, int, str]]:
        """Disjoint spans, in order, of one line in ASCII digits; ``hints`` says what it may hold."""
        spans: list[tuple[int, int, str]] = []  # disjoint and in order

        def take(a: int, b: int, kind: str) -> None:
            i = bisect(spans, (a,))
            if (i == 0 or spans[i - 1][1] <= a) and (i == len(spans) or b <= spans[i][0]):
                spans.insert(i, (a, b, kind))

        if "at" in hints:
            for m in _EMAIL.finditer(plain):
                take(m.start(), m.end(), "EMAIL")
        for x in self.accounts(plain):
            take(*x)
        if _SIX.search(plain):
            for x in self.checked(plain):
                take(*x)
            for x in self.numbers(plain):
                take(*x)
        for a, b, _ in self.names(plain):
            take(a, b, "NAME")
        for a, b, _ in self.addresses(plain) if "address" in hints else ():
            take(a, b, "ADDRESS")
        return spans

    def lines(self, text: str) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
        """(number from 1, line, spans) of every line."""
        plain = _FOREIGN.sub(lambda m: m.group().translate(_ASCII), text)
        lines, low = plain.split("\n"), plain.casefold()
        marks = {"at": _AT, "address": _ADDRESS_HINTS}
        hints = {k for k, mark in marks.items() if mark.search(low)}
        for n, (line, p) in enumerate(zip(text.split("\n"), lines), 1):
            here = hints
            if hints and len(lines) > 1:
                low = p.casefold()
                here = {k for k in hints if marks[k].search(low)}
            yield n, line, self.line(p, here)

    def redact(self, text: str) -> str:
        out = []
        for _, line, spans in self.lines(text):
            at, done = 0, []
            for a, b, kind in spans:
                done += [line[at:a], f"[{kind}]"]
                at = b
            out.append("".join([*done, line[at:]]))
        return "\n".join(out)


def parts_of(name_parts: DataFrame) -> Parts:
    """The fixed list of name parts, checked to be small."""
    return learn([tuple(r) for r in small_rows(name_parts.select("name_part", "script", "role").dropna(), MAX_PARTS)])


def found(docs: DataFrame, parts: Parts) -> DataFrame:
    """(doc_id, line_no, kind), each once; null and empty texts give no row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(parts)
        for b in batches:
            rows = [
                (doc, n, kind)
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for n, _, spans in find.lines(text)
                for kind in dict.fromkeys(k for _, _, k in spans)
            ]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()))], ["doc_id", "line_no", "kind"])

    return docs.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''").mapInArrow(scan, "doc_id bigint, line_no int, kind string")


def redact(docs: DataFrame, parts: Parts, text: str = "text", out: str = "redacted") -> DataFrame:
    """``docs`` with column ``out``: the text with typed placeholders; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Finder(parts)
        for s in batches:
            yield s.map(lambda t: None if t is None else find.redact(t))

    return docs.withColumn(out, run(F.col(text)))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and kinds of personal information."""
    return found(table(spark, sf_dir, "documents"), parts_of(table(spark, sf_dir, "name_parts")))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal information replaced."""
    docs = redact(table(spark, sf_dir, "documents").select("doc_id", "text"), parts_of(table(spark, sf_dir, "name_parts")))
    return docs.select("doc_id", "redacted")


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per kind."""
    return p10_found(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_documents"))
