"""A grammar for quantities in Nepali and English text.

A quantity is an amount and a vector of exponents over the base dimensions of
the units table.  Numbers may be digits of either script, number words, fraction
words ("saadhe saat", "one and a half") and scale words; units may stand before
or after the number, combined units add up.  Units multiply ("man-day"), divide
("rupees per day", "km/h") and take powers ("sq m", "m^2"): vectors add, subtract
and scale.  A unit with an offset is converted by scale and offset where it
stands alone, by scale within products.  What is counted ("per application")
has no dimension.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from fractions import Fraction

#: Dimensions that come first in every vector; others of the table follow by name.
DIMENSIONS = ("money", "time")
SCALE = "scale"

# Numerals of Nepali and English, spelled as in writing.
NEPALI_NUMBERS = (
    "शून्य एक दुई तीन चार पाँच छ सात आठ नौ दश एघार बाह्र तेह्र चौध पन्ध्र सोह्र सत्र अठार उन्नाइस "
    "बीस एक्काइस बाइस तेइस चौबीस पच्चीस छब्बीस सत्ताइस अट्ठाइस उनन्तीस "
    "तीस एकतीस बत्तीस तेत्तीस चौंतीस पैंतीस छत्तीस सैंतीस अठतीस उनन्चालीस "
    "चालीस एकचालीस बयालीस त्रिचालीस चवालीस पैंतालीस छयालीस सच्चालीस अठचालीस उनन्चास "
    "पचास एकाउन्न बाउन्न त्रिपन्न चवन्न पचपन्न छपन्न सन्ताउन्न अन्ठाउन्न उनन्साठी "
    "साठी एकसट्ठी बयसट्ठी त्रिसट्ठी चौंसट्ठी पैंसट्ठी छयसट्ठी सतसट्ठी अठसट्ठी उनन्सत्तरी "
    "सत्तरी एकहत्तर बहत्तर त्रिहत्तर चौहत्तर पचहत्तर छयहत्तर सतहत्तर अठहत्तर उनासी "
    "असी एकासी बयासी त्रियासी चौरासी पचासी छयासी सतासी अठासी उनान्नब्बे "
    "नब्बे एकानब्बे बयानब्बे त्रियानब्बे चौरानब्बे पन्चानब्बे छयानब्बे सन्तानब्बे अन्ठानब्बे उनान्सय"
).split()
ENGLISH_NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen"
).split()
ENGLISH_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
EXTRA_NUMBERS = {"दस": 10, "बिस": 20, "चौबिस": 24, "एकाइस": 21, "सय": None}
#: code of the units table -> words; hundred is no unit there, so it has its value here.
SCALE_WORDS = {
    "thousand": ("हजार", "हज़ार", "thousand", "k"),
    "lakh": ("लाख", "lakh", "lakhs", "lac", "lacs"),
    "million": ("मिलियन", "million", "mn"),
    "crore": ("करोड", "करोड़", "crore", "crores"),
}
HUNDRED_WORDS = ("सय", "hundred", "hundreds")
UNIT_WORDS = {
    "npr": ("रुपैयाँ", "रूपैयाँ", "रुपियाँ", "रुपिया", "रुपयाँ", "रु", "रू", "rs", "nrs", "npr", "rupees", "rupee"),
    "paisa": ("पैसा", "paisa", "paise"),
    "inr": ("भारु", "inr", "ic"),
    "usd": ("डलर", "usd", "us$", "$", "dollar", "dollars"),
    "eur": ("युरो", "यूरो", "eur", "euro", "euros", "€"),
    "day": ("दिन", "day", "days", "d"),
    "week": ("हप्ता", "साता", "week", "weeks", "wk", "wks"),
    "month": ("महिना", "month", "months", "mo", "mos", "mth", "mths"),
    "year": ("वर्ष", "बर्ष", "साल", "year", "years", "yr", "yrs"),
    "working_day": ("कार्यदिन", "workday", "workdays", "workingday", "businessday"),
    "hour": ("घन्टा", "घण्टा", "hour", "hours", "hr", "hrs"),
}
#: Words and signs between units, and before or after one for its power.
PER_WORDS = ("per", "प्रति", "/")
TIMES_WORDS = ("*", "·", "×")
POWER_WORDS = {"sq": 2, "square": 2, "वर्ग": 2, "cu": 3, "cubic": 3, "घन": 3}
#: Words of a range: no definite quantity if numbers stand on both sides.
RANGE_WORDS = ("to", "or", "between", "देखि", "वा")
#: Words that turn the following unit into another one.
UNIT_PHRASES = (
    (r"भा\s*\.\s*रु\s*\.?", " भारु "),
    (r"भारतीय\s+रु(?:पैयाँ|पियाँ|पिया|पयाँ)?(?![ऀ-ॿ])\.?", " भारु "),
    (r"indian\s+rupees?", " inr "),
    (r"i\.?c\.(?=\s|$|\d)", " inr "),
    (r"(?:अमेरिकी|us|american)\s+(?:डलर|dollars?)", " usd "),
    (r"us\s*\$", " usd "),
    (r"कार्य\s*[- ]?\s*दिन", " कार्यदिन "),
    (r"(?:working|business)\s*[- ]?\s*days?", " workday "),
)
SUFFIXES = ("भित्रै", "भित्र", "सम्म", "सम्मको", "भित्रको", "को", "मा", "पछि", "अगावै", "भर", "जति")
#: A value with one of these states a share or points to another place.
BLOCKERS = re.compile(
    r"%|प्रतिशत|per\s*cent|percent|बमोजिम|अनुसार|अनुसूची|दफा|तोकि|prescribed|schedule|\bsection\b|according|turnover|"
    r"\bper annum\b|\d\s*[-–—~]\s*\d"
)
HALF, QUARTER = Fraction(1, 2), Fraction(1, 4)
ADDERS = {"साढे": HALF, "साढ": HALF, "सवा": QUARTER, "पौने": -QUARTER}
FRACTIONS = {"आधा": HALF, "डेढ": 3 * HALF, "अढाई": 5 * HALF, "half": HALF, "quarter": QUARTER}
_DIGITS = {ord(c): str(i) for zero in "०૦０٠" for i, c in enumerate(chr(ord(zero) + k) for k in range(10))}
_IGNORED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x200E, 0x2060, 0xFEFF, 0xAD])
_FOLD = str.maketrans({"ी": "ि", "ू": "ु", "ँ": None, "ं": None, "श": "स", "ष": "स", "ण": "न", "व": "ब"})
_ISO = re.compile(r"p(?=\d|t\d)(?:(\d+)y)?(?:(\d+)m)?(?:(\d+)w)?(?:(\d+)d)?(?:t(?:(\d+)h)?(?:0+m)?(?:0+s)?)?")
_TOKEN = re.compile(r"\d[\d,]*(?:\.\d+)?|[ऀ-ॣॱ-ॿ]+|°?[a-z]+|[$€]|[^\s]")


def plain(text: str) -> str:
    """Lower case, compatibility width, ASCII digits, no invisible characters."""
    text = text.translate(_IGNORED).replace("²", "^2").replace("³", "^3")
    text = unicodedata.normalize("NFKC", text).translate(_DIGITS)
    return text.replace("ाे", "ो").replace("ाै", "ौ").lower().strip()


def fold(word: str) -> str:
    """Spelling classes of vowel length, nasals and sibilants are one."""
    return word.translate(_FOLD)


@dataclass(frozen=True)
class Unit:
    """A vector of exponents, and how an amount becomes canonical: amount * factor + offset."""

    vector: tuple[int, ...]
    factor: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)

    def __mul__(self, other: Unit) -> Unit:
        return Unit(tuple(a + b for a, b in zip(self.vector, other.vector)), self.factor * other.factor)

    def __pow__(self, n: int) -> Unit:
        return self if n == 1 else Unit(tuple(n * a for a in self.vector), self.factor**n)

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def canonical(self, amount: Fraction) -> Fraction:
        return amount * self.factor + self.offset


def exponents(dimension: str) -> dict[str, int]:
    """{base: exponent} of an expression like "length^2" or "money/time"."""
    out: dict[str, int] = {}
    for sign, name, power in re.findall(r"([*/]?)\s*([^\s*/^]+)(?:\^(-?\d+))?", dimension):
        out[name] = out.get(name, 0) + (-1 if sign == "/" else 1) * int(power or 1)
    return out


class Grammar:
    """The grammar over one ``units`` table: rows of (code, dimension, factor[, offset]).

    A dimension may be a product of powers, "length^2" or "length/time".  A code
    without words of its own is its own word.
    """

    def __init__(self, units: list[tuple]) -> None:
        rows = {code: (dim, *(Fraction(x).limit_denominator(10**6) for x in (factor, *offset))) for code, dim, factor, *offset in units}
        bases = {b for dim, *_ in rows.values() if dim != SCALE for b in exponents(dim)}
        self.bases = (*DIMENSIONS, *sorted(bases - set(DIMENSIONS)))
        self.one = Unit((0,) * len(self.bases))
        known = rows
        self.number: dict[str, Fraction] = {}
        for i, w in enumerate(NEPALI_NUMBERS):
            self.number[fold(w)] = Fraction(i)
        self.number |= {fold(w): Fraction(n) for w, n in EXTRA_NUMBERS.items() if n is not None}
        self.number |= {w: Fraction(i) for i, w in enumerate(ENGLISH_NUMBERS)}
        self.number |= {w: Fraction(10 * i) for i, w in enumerate(ENGLISH_TENS, 2)}
        self.scale = {fold(w): Fraction(100) for w in HUNDRED_WORDS}
        self.scale |= {fold(w): known[c][1] for c, ws in SCALE_WORDS.items() if c in known for w in ws}
        self.unit: dict[str, Unit] = {}
        for code, (dim, *conversion) in rows.items():
            if dim != SCALE:
                e = exponents(dim)
                unit = Unit(tuple(e.get(b, 0) for b in self.bases), *conversion)
                self.unit |= {fold(w): unit for w in UNIT_WORDS.get(code, (code.lower(),))}
        self.power = {fold(w): n for w, n in POWER_WORDS.items()}
        self.adder = {fold(w): x for w, x in ADDERS.items()}
        self.fraction = {fold(w): x for w, x in FRACTIONS.items()}

    def dimension(self, vector: tuple[int, ...]) -> str:
        """The vector as an expression: "money", "money/time", "length^2"; "1" for no dimension."""
        up = [b + (f"^{n}" if n > 1 else "") for b, n in zip(self.bases, vector) if n > 0]
        down = ["/" + b + (f"^{-n}" if n < -1 else "") for b, n in zip(self.bases, vector) if n < 0]
        return ("*".join(up) or "1") + "".join(down)

    def _word(self, token: str) -> str:
        """The folded word, without a grammatical ending if only then it is known."""
        word = fold(token)
        tables = (self.number, self.scale, self.unit, self.adder, self.fraction)
        if any(word in t for t in tables):
            return word
        for s in SUFFIXES:
            s = fold(s)
            if word.endswith(s) and any(word[: -len(s)] in t for t in tables):
                return word[: -len(s)]
        return word

    def _iso(self, text: str) -> tuple[tuple[int, ...], Fraction] | None:
        m = _ISO.fullmatch(text)
        if not m or not any(m.groups()):
            return None
        total = Fraction(0)
        for n, word in zip(m.groups(), ("year", "month", "week", "day", "hour")):
            if n:
                if word not in self.unit:
                    return None
                total += int(n) * self.unit[word].factor
        return self.unit["day"].vector, total

    def _power(self, words: list[str], i: int) -> tuple[Unit, int] | None:
        """(unit with its power, place after it) if one stands at ``i``."""
        n = 1
        if words[i] in self.power and i + 1 < len(words):
            n, i = self.power[words[i]], i + 1
            i += words[i] == "."
        if i >= len(words) or words[i] not in self.unit:
            return None
        unit, i = self.unit[words[i]], i + 1
        if i + 1 < len(words) and words[i] == "^":
            sign = -1 if words[i + 1] == "-" and i + 2 < len(words) else 1
            at = i + (2 if sign > 0 else 3)
            if words[at - 1].isdigit() and len(words[at - 1]) < 3:
                n, i = sign * int(words[at - 1]), at
        return unit**n, i

    def _product(self, words: list[str], i: int) -> tuple[Unit, int] | None:
        """(product of units, place after it) at ``i``: units with signs of multiplication or a hyphen between."""
        got = self._power(words, i)
        if got is None:
            return None
        unit, i = got
        while i + 1 < len(words) and words[i] in (*TIMES_WORDS, "-") and (more := self._power(words, i + 1)):
            unit, i = unit * more[0], more[1]
        return unit, i

    def _divisor(self, words: list[str], i: int) -> tuple[Unit, int] | None:
        """(what is divided by, place after it) if words[i] divides."""
        if words[i] not in PER_WORDS or i + 1 >= len(words):
            return None
        got = self._product(words, i + 1)
        if got is None and words[i] != "/" and words[i + 1][0].isalpha():
            return self.one, i + 2  # per application, per person: a count
        return got

    def parse(self, value: str | None, bare: str | None = None) -> tuple[tuple[int, ...], Fraction] | None:
        """(exponent vector, amount in canonical units) of the one quantity in ``value``.

        None for null, blank, shares, references, ranges, and texts without a
        number or unit.  ``bare`` names the unit of a number without a unit.
        """
        if value is None:
            return None
        text = plain(value)
        if iso := self._iso(text):
            return iso
        inner = re.sub(r"\([^)]*\)", " ", text)
        text = inner if inner.strip() else text.strip("() ")
        for pattern, to in UNIT_PHRASES:
            text = re.sub(pattern, to, text)
        if not text.strip() or BLOCKERS.search(text):
            return None
        terms: list[tuple[Unit, Fraction]] = []
        total: Fraction | None = None
        cur: Fraction | None = None
        adder: Fraction | None = None
        before: Unit | None = None
        closed: Unit | None = None
        divisor: Unit | None = None
        ranged = seen = False

        def number() -> Fraction | None:
            return None if total is None and cur is None else (total or Fraction(0)) + (cur or 0)

        words = [t if t[0].isdigit() else self._word(t) for t in _TOKEN.findall(text)]
        i = 0
        while i < len(words):
            word, at = words[i], i
            i += 1
            if word[0].isdigit() or word in self.number or word in self.adder or word in self.fraction:
                if ranged:
                    return None
                seen = True
            if word[0].isdigit():
                n = Fraction(word.replace(",", ""))
                if cur is not None:
                    return None
                cur, adder, closed = n + (adder or 0), None, None
            elif word in self.number:
                n = self.number[word]
                if cur is None:
                    cur = n + (adder or 0)
                elif (cur % 100 == 0 and n < 100) or (cur < 100 and cur % 10 == 0 and n < 10):
                    cur += n
                else:
                    return None
                adder, closed = None, None
            elif word in self.adder:
                adder, closed = self.adder[word], None
            elif word in self.fraction:
                cur, closed = (cur or Fraction(0)) + self.fraction[word], None
            elif word in self.scale:
                if cur is None and adder is None:
                    continue
                cur = (cur if cur is not None else 1 + (adder or 0)) * self.scale[word]
                adder = None
                if self.scale[word] > 100:
                    total, cur = (total or Fraction(0)) + cur, None
            elif word in RANGE_WORDS:
                ranged = seen or word == "between"
            elif (got := self._divisor(words, at)) and (seen or before is not None):
                # the quantity goes on after it
                divisor = got[0] if divisor is None else divisor * got[0]
                i = got[1]
            elif got := self._product(words, at):
                unit, i = got
                n = number()
                if n is None:
                    if closed is None or closed.vector != unit.vector:
                        before = unit
                else:
                    terms.append((unit, n))
                    total = cur = before = None
                    closed = unit
        n = number()
        if n is not None:
            if before is not None:
                terms.append((before, n))
            elif not terms and bare is not None and re.fullmatch(r"\d[\d,]*(?:\.\d+)?", text.strip()):
                terms.append((self.unit[fold(bare)], n))
            elif terms:
                return None
        if not terms or len({u.vector for u, _ in terms}) != 1 or (len(terms) > 1 and any(u.offset for u, _ in terms)):
            return None
        unit, amount = terms[0][0], sum((u.canonical(x) for u, x in terms), Fraction(0))
        if divisor is None or divisor == self.one:
            return unit.vector, amount
        bare_amount = sum((x * u.factor for u, x in terms), Fraction(0))
        return (unit / divisor).vector, bare_amount / divisor.factor


def whole(amount: Fraction) -> int:
    """The nearest whole number, halves upward."""
    return int((amount + HALF).__floor__())
