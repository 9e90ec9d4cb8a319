import pytest
from hypothesis import given
from hypothesis import strategies as st

from lekhya.llm import encoding as E

NE = [f"दफा {i} बमोजिम निवेदन दर्ता गर्न कार्यालय समक्ष दस्तुर तिर्नु पर्छ र अनुमति लिनु पर्नेछ।" for i in range(200)]
EN = [f"Subject to section {i}, the office shall decide on the application within {i} days of payment." for i in range(200)]
R = E.Repairer(E.train([NE, EN]))


def misread(text, *codecs):
    for c in codecs:
        to = {b: bytes([b]).decode(c, "replace") for b in range(256)}
        text = "".join(chr(b) if to[b] == "�" else to[b] for b in text.encode())
    return text


@pytest.mark.parametrize("codec", ["cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "iso8859_15"])
def test_round_trip(codec):
    text = "निवेदन दर्ता गर्न कार्यालय समक्ष दस्तुर"
    got, found, _ = R(misread(text, codec))
    assert found and got == text
    got, found, _ = R("कार्यालय " + misread("समक्ष दस्तुर", codec) + " तिर्नु पर्छ")
    assert found and got == "कार्यालय समक्ष दस्तुर तिर्नु पर्छ"


def test_chains_and_short():
    assert R(misread("दस्तुर तिर्नु", "cp1252", "cp1252"))[0] == "दस्तुर तिर्नु"
    assert R("Offences â€“ penalties")[:2] == ("Offences – penalties", True) and R("rÃ©sumÃ©")[0] == "résumé"


@pytest.mark.parametrize("text", ["", "plain", "café São Århult", "Amounts in £ or €", "the word “Сделано” beside", "α and β", "गर्‍यो", "“क” – ‘ख’", "x" * 100_000])
def test_unchanged(text):
    assert R(text) == (text, False, "")


def test_lost_bytes():
    got, found, _ = R(misread("दर्ता गर्न कार्यालय", "cp1252").replace("\x8d", "�"))
    assert found and "दर" in got
    assert R("अड्�ाउ")[1]


@given(st.text(max_size=60))
def test_never_fails(text):
    got, found, chain = R(text)
    assert found or got == text


def test_values(spark):
    rows = [(1, misread("दर्ता गर्न", "cp1252"), (1, misread("दस्तुर", "cp1251"), 1, None, None, None), "x"), (2, None, None, None), (3, "", (1, "ठीक", None, "ठीक", None, None), None)]
    df = spark.createDataFrame(rows, "chunk_row_id bigint, text string, hierarchy struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>, field string")
    got = sorted((r.chunk_row_id, r.field) for r in E.restored(df).collect())
    assert got == [(1, "ch_title"), (1, "text")] and E.restored(df.limit(0)).count() == 0


def test_pairs_of_all_texts(spark, monkeypatch):
    """Every clean text counts, and all of it; a pair seen only late fills a gap."""
    monkeypatch.setattr(E, "SAMPLE", 2)
    texts = [f"दफा {i} बमोजिम क{chr(0x905 + i)}ख\n – “ञ” (क)" for i in range(40)] + ["क" * 2500 + "ञट" * 50, None, "", "abc", misread("दर्ता झ", "cp1252")]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "chunk_row_id bigint, text string, hierarchy struct<ch_title: string, sec_title: string>")
    pairs = E.models_of(df).pairs
    want = {}
    for t in texts[:-4]:
        for a, b in zip(t, t[1:]):
            if a > "\u08ff":
                want[a + b] = want.get(a + b, 0) + 1
    assert pairs == want and pairs["ञट"] == 50


def test_gap_filled_by_rare_evidence(spark, monkeypatch):
    monkeypatch.setattr(E, "SAMPLE", 1)
    rows = [(i, f"दफा {i} बमोजिम निवेदन दर्ता गर्न कार्यालय समक्ष दस्तुर तिर्नु पर्छ।", None) for i in range(30)] + [(i, "क" * 2500 + " १५ऍ७ " * 20, None) for i in range(30, 33)]
    df = spark.createDataFrame(rows, "chunk_row_id bigint, text string, hierarchy struct<ch_title: string, sec_title: string>")
    text = misread("१५ऍ७ निवेदन दर्ता", "cp1252").replace("\x8d", "�")
    assert E.LOST in text and E.Repairer(E.models_of(df))(text)[0] == "१५ऍ७ निवेदन दर्ता"


CORRECT = [
    "Привет мир, это проверка", "В реке рек нет, время идёт; «Ёлка» – №5", "класс В» и Ві", "Він їде до Києва. Її ґанок, «Єдність» — 5 °C", "Сказав: „Так“ – і ні",
    "Größe – “Übung”", "Straße, Äpfel, öffentliche Prüfung: „Über“ – ‚Ämter‘", "café–été", "L’été à Paris : « voilà » – œuvre, où, çà, 20 €, n° 5", "« à », «à» et “É”",
    "Αθήνα, Ελλάδα – καλημέρα κόσμε", "α+β=γ, Δx ≤ π", "Zażółć gęślą jaźń „Łódź” – Óź", "Čeština: žluťoučký kůň, „Ďábel“", "İstanbul’da çağ, ığdır – şoför", "São Paulo é à beira; coração “Ê”",
    "El Niño “¿Qué?” – ¡Olé! 3½ º", "Åse på Ålesund “BLÅ” – Ø, æ", "北京市の住所。東京都、한국어", "price: £5, ¥600, €7 ± 2 µm × 3", "שלום עולם – مرحبا", "Tiếng Việt: phở, Đà Nẵng “Ấ”",
    "résumé “naïve” coöperation", "दफा ५ – “कानून” café Größe Привет",
]


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_of_other_languages_stays(text):
    assert R(text) == (text, False, "") and R(text * 20) == (text * 20, False, "")


@pytest.mark.parametrize("text", ["Größe und Übung der Straße", "Привет, это проверка", "café où l’été", "Αθήνα και Ελλάδα"])
def test_garbled_text_of_other_languages_is_restored(text):
    assert R(misread(text, "cp1252"))[:2] == (text, True)


def test_chains_have_no_bound():
    text = "दस्तुर तिर्नु पर्छ"
    assert R(misread(text, "cp1252", "cp1252", "cp1252", "cp1252"))[0] == text


def test_every_candidate_is_compressed():
    seen = []

    class Spy(E.Repairer):
        def length(self, text):
            seen.append(text)
            return super().length(text)

    spy = Spy(E.train([NE, EN]))
    text = misread("निवेदन दर्ता", "cp1252")
    spy(text)
    assert {t for _, t, _ in spy.candidates(text)} <= set(seen)


LATE = ("अभिलेख तथा प्रतिवेदन राख्नु पर्नेछ।", "छिमेकीको मञ्जुरीनामा र सञ्चालकको निवेदन", "A café or canteen attached to a haulage business, résumé and communiqué")


def late_corpus():
    """3,000 texts of two languages without the words of LATE, and 600 with them behind these."""
    early = [f"The office shall keep register {i} of fees and notices." for i in range(1500)] + [f"दफा {i} मा उल्लेख भए बमोजिम हुनेछ।" for i in range(1500)]
    return early + [LATE[i % 3] for i in range(600)]


def late_garbled():
    """A value of a late word that lost its control characters, and what it was."""
    before, word = "दफा मा उल्लेख भए बमोजिम ", "मञ्जुरीनामा"
    return before + "".join(c for c in misread(word, "cp1252") if not "\x80" <= c < "\xa0"), before + word


def test_dictionaries_of_all_texts(spark):
    schema = "chunk_row_id bigint, text string, hierarchy struct<ch_title: string, sec_title: string>"
    texts = late_corpus()
    models = E.models_of(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], schema).repartition(7))
    assert models.dictionaries == E.train([[t for t in texts if t > "ऀ"], [t for t in texts if t < "ऀ"]]).dictionaries
    for word, which in (("अभिलेख", 0), ("मञ्जुरीनामा", 0), ("canteen", 1), ("communiqué", 1)):
        assert word.encode() in models.dictionaries[which]
    turned = spark.createDataFrame([(-i, t, None) for i, t in enumerate(texts)], schema)
    assert E.models_of(turned) == models and E.models_of(turned.limit(0)) == E.Models()


def test_clauses_count_whole():
    texts = ["क" * 750 + "। क; ख ग.", "क ।ख ग\nx", ""]
    got = {}
    for c, n in E._clauses_in(E.pa.array(texts)):
        got[c] = got.get(c, 0) + n
    assert {c: n for c, n in got.items() if c} == {"क" * 300: 2, "क" * 150: 1, "क": 2, "ख ग": 2, "x": 1}
    assert sorted(" ".join(E.composed({"क": 3, "ख": 1})).split()) == ["क"] * 3 + ["ख"]
    many = "".join(E.composed({"क": 900_000, "ख": 300_000, "ग": 1})).split()
    assert abs(many.count("क") / many.count("ख") - 3) < 0.001 and many.count("ग") == 1


def test_restored_by_the_words_of_all_texts(spark):
    garbled, meant = late_garbled()
    rows = [(i, t, None) for i, t in enumerate(late_corpus())] + [(9000, garbled, (None, garbled))]
    df = spark.createDataFrame(rows, "chunk_row_id bigint, text string, hierarchy struct<ch_title: string, sec_title: string>")
    got = {(r.chunk_row_id, r.field): (r.restored, r.chain, r.recovered) for r in E.restored(df).collect()}
    assert got == {(9000, "text"): (meant, "cp1252", True), (9000, "sec_title"): (meant, "cp1252", True)}
