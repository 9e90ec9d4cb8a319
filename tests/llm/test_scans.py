import pyarrow as pa
import pytest

from lekhya.llm import encoding, scans as S
from tests.llm.test_encoding import late_corpus, late_garbled


def shape(text):
    return S.shaped(pa.array([text]))[0].as_py()


@pytest.mark.parametrize(
    "text",
    [
        "व्यव-\nस्था हुनेछ।", "गरिने¬\nछ।", "सकिनेछ\nर हुनेछ।", "हुनेछ।\n\n- १५ -\n\nअर्को छ।", "Page 3\nText goes on here.", "हुनेछ।\n७२ | पृष्ठ\nअर्को।", "राजपत्र, खण्ड ७७, अतिरिक्ताङ्क ३१\nहुनेछ।", "हुनेछ।\nवातावरण ऐन, २०३७\nअर्को।",
        "हुनेछ|", "हुनेछl", "हुनेछ! अर्को", "ग2्नु", "दिइ1ेछ", "मना¥िब", "काम ^ श्रम", "~भएको", "भएको .: छ", "Z०५६ मा", "२५,0०० रु", "२०७५|२।२६", "deci5ion", "Tour!sm", "p0int", "The firm shall\nkeep it.",
    ],
)
def test_noise_of_shape(text):
    assert shape(text) is True


@pytest.mark.parametrize(
    "text",
    ["", "हुनेछ।", "हुनेछ।\n\nअर्को हुनेछ।", "देहाय बमोजिमको कागजात:-\n(क) निवेदन\n(ख) नक्सा", "Namely:-\n(a) Lease (two copies)\n(b) Form", "भू-संरक्षण र PAN दर्ता १०,००० रु. २०७५।२।२६", "Rs. 25,000 for 1st and 5th year, é £ €", "वातावरण ऐन, २०३७ बमोजिम", "x" * 50_000],
)
def test_no_noise_of_shape(text):
    assert shape(text) is False


CHUNK = "chunk_row_id bigint, text string, provisos array<string>, hierarchy struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>"


def test_words(spark):
    good = [(i, "निषेध गरिएको चुक्ता सम्बन्धी public Tourism", None, None) for i in range(60)]
    bad = [(100, "निषेघ गरिएको", ["ठीक", "चुफ्ता छ", None], None), (101, "piiblic", None, None), (102, "अर्कै शब्द", [], None), (103, None, None, None), (104, "  ", None, None), (105, "उद्याेग", None, None)]
    df = spark.createDataFrame(good + bad, CHUNK)
    values = S.scan_values(df)
    scanned = S.materialise(S.scan(values, encoding.Models()))
    fixes = S.materialise(S.corrections(S.word_counts(scanned)))
    assert {(r.word, r.correction) for r in fixes.collect()} == {("निषेघ", "निषेध"), ("चुफ्ता", "चुक्ता"), ("piiblic", "public")}
    want = {(100, "text", 0), (100, "provisos", 1), (101, "text", 0)}
    assert {tuple(r) for r in S.noisy(values, scanned, fixes).collect()} == want
    assert {tuple(r) for r in S.misread_joined(values, fixes).collect()} == want  # the way of large lists
    empty = S.scan_values(df.limit(0))
    assert S.scan(empty, encoding.Models()).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_words_of_odd_values_that_mending_leaves(spark, monkeypatch, most):
    monkeypatch.setattr(S, "SMALL_LIST", most)
    good = [(i, "निषेध गरिएको", None, None) for i in range(60)]
    odd = [(100, "α β निषेघ गरिएको", None, None), (101, "α β निषेध गरिएको", None, None), (102, "निषेध π", ["π को निषेघ"], None)]
    values = S.scan_values(spark.createDataFrame(good + odd, CHUNK))
    scanned = S.materialise(S.scan(values, encoding.Models()))
    fixes = S.materialise(S.corrections(S.word_counts(scanned)))
    assert {r.word for r in fixes.collect()} == {"निषेघ"}
    assert {tuple(r) for r in S.noisy(values, scanned, fixes).collect()} == {(100, "text", 0), (102, "provisos", 0)}


def test_anagram_hash(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("abc",), ("cab",), ("abd",), ("",)], "w string").select("w", S.anagram_hash(F.col("w")).alias("h")).collect()
    h = {r.w: r.h for r in rows}
    assert h["abc"] == h["cab"] != h["abd"] and h[""] == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("विकास व्यव-\nस्था_ \n३८\nतोकिए बमोजिम हुनेछ।", "विकास व्यवस्था तोकिए बमोजिम हुनेछ।"), ("The firm shall \np. 30\nkeep it for 5 years.", "The firm shall keep it for 5 years."), ("ग2्नु पर्नेछ|", "गर्नु पर्नेछ।"),
        ("कागजात:-\n(क) निवेदन\n(ख) नक्सा", "कागजात:-\n(क) निवेदन\n(ख) नक्सा"), ("एक हुनेछ।\n\n- १५ -\n\nअर्को हुनेछ।", "एक हुनेछ।\n\nअर्को हुनेछ।"), ("Tour!sm p0int of Rs. 25,000", "Tourism point of Rs. 25,000"), ("निषेघ छ", "निषेध छ"),
    ],
)
def test_repair(text, want):
    assert S.repair_text(text, {"निषेघ": "निषेध"}) == want


def test_hyphens_by_evidence(spark):
    text = "आर्थिक-\nसामाजिक व्यव-\nस्था हुनेछ।"
    assert S.broken_words(text) == [("आर्थिक", "सामाजिक"), ("व्यव", "स्था")]
    assert S.repair_text(text, {}) == "आर्थिकसामाजिक व्यवस्था हुनेछ।"
    assert S.repair_text(text, {}, frozenset({"आर्थिक-सामाजिक"})) == "आर्थिक-सामाजिक व्यवस्था हुनेछ।"
    df = spark.createDataFrame([(1, "आर्थिक-सामाजिक व्यवस्था र आर्थिक-सामाजिक", None, None), (2, text, None, None)], CHUNK)
    seen = {r.word: r.n for r in S.scan(S.scan_values(df), encoding.Models()).filter("word IS NOT NULL").groupBy("word").sum("n").toDF("word", "n").collect()}
    assert seen["आर्थिक-सामाजिक"] == 2 and seen["व्यवस्था"] == 1 and seen["सामाजिक"] == 3


def learned(counts):
    """Brute force over all pairs of words."""
    support, peers = {}, {}
    for f, n_f in counts.items():
        for w, n in counts.items():
            for i in range(len(f)):
                for size in (1, 2):
                    seen = w[i : i + size]
                    if n_f >= S.MIN_COUNT and len(seen) == size and seen != f[i] and f[:i] + seen + f[i + 1 :] == w:
                        if n_f >= S.MIN_RATIO * n:
                            support.setdefault((f[i], seen), set()).add(f)
                        elif n >= S.PEER_COUNT:
                            peers.setdefault((f[i], seen), set()).add(f)
    return {k for k, v in support.items() if len(v) >= S.MIN_SUPPORT and S.PEER_PART * len(peers.get(k, ())) <= len(v)}


def test_confusions_are_learned(spark):
    words = ["stone", "store", "monkey", "money", "notes", "novel", "oval", "total", "motor", "solid"]
    counts = {w: 40 + i for i, w in enumerate(words)} | {w.replace("o", "ö"): 1 for w in words[:6]} | {w.replace("l", "lj"): 2 for w in words if "l" in w} | {w.replace("m", "rn"): 1 for w in words if "m" in w} | {"stane": 39, "ston": 3}
    got = {(r.printed, r.seen) for r in S.confusions(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    assert got == learned(counts) and ("o", "ö") in got and ("o", "a") not in got
    fixes = {r.word: r.correction for r in S.corrections(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    assert fixes["stöne"] == "stone" and "stane" not in fixes
    assert S.confusions(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_running_heads_by_repetition(spark):
    head = [(i, f"यो काम {i} जनाले\nसरकारी प्रकाशन {i}\nगर्नु पर्छ।", None, None) for i in range(S.MIN_HEADS)]
    rest = [(50, "एक हुन्छ।\nसरकारी प्रकाशन ९", None, None), (51, "एक हुन्छ।\nअर्को लाइन", [None], None), (52, None, [None, ""], None)]
    values = S.scan_values(spark.createDataFrame(head + rest, CHUNK))
    scanned = S.materialise(S.scan(values, encoding.Models()))
    assert [r.line for r in S.running_heads(S.line_rows(scanned)).collect()] == ["सरकारी प्रकाशन #"]
    got = S.noisy(values, scanned, S.corrections(S.materialise(S.word_counts(scanned)))).collect()
    assert sorted(r.chunk_row_id for r in got) == [*range(S.MIN_HEADS), 50]
    assert S.repair_text(rest[0][1], {}, heads=frozenset(["सरकारी प्रकाशन #"])) == "एक हुन्छ।"


def test_mending_knows_the_words_of_all_texts(spark):
    garbled, meant = late_garbled()
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate([*late_corpus(), garbled])], CHUNK)
    scanned = S.scan(S.scan_values(df.filter(f"chunk_row_id = {len(late_corpus())}")), encoding.models_of(df)).collect()
    assert {r.word for r in scanned if r.word} == set(meant.split()) and [r.value for r in scanned if r.noisy is False] == [meant]
