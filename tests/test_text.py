import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekhya.functions import chunks, text, vectors


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).collect()[0].y


def test_clean(spark):
    cases = {None: "", "": "", "a\n\n 12 \n\nb": "a\n\nb", "a   b": "a b", "x\n\n\n\ny": "x\n\ny", "WWW.LawCommission.gov.np text": "text", "\n a \t": "a"}
    for raw, want in cases.items():
        assert one(spark, raw, text.clean) == want
    note = "क। आर्थिक तथा व्यावसायिक कार्य सम्बन्धी केही नेपाल ऐनलाई संशोधन गर्ने ऐन, २०८१ द्वारा थप। ख"
    assert one(spark, note, text.clean) == "क। ख"


def test_numbers(spark):
    for raw, want in {"२०६३": 2063, "(१)": 1, "abc": None, "12-34": 1234, "५०.५०": 5050, "१०,०००": 10000, "9" * 30: None, None: None}.items():
        assert one(spark, raw, text.to_int) == want


def test_slugs(spark):
    for raw, want in {"comapy_act.pdf": "comapy_act", "A  b-C.pdf": "a_b_c", "कम्पनी.pdf": "", "dir/x.y.pdf": "x_y"}.items():
        assert one(spark, raw, text.slug) == want


def test_uuid5(spark):
    names = ["क-२", "a", "", "https://example.org/x", "é" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "x string").select("x", text.uuid5(F.col("x")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.x)) for r in rows)
    assert text and one(spark, "क-२", text.uuid5) == "2efcac95-01c7-5a69-b583-353a7f505115"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_literal_pattern(spark, values):
    values = [v for v in values if "\x00" not in v and not any(0xD800 <= ord(c) < 0xE000 for c in v)] or ["a.b"]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", F.rlike(F.col("x"), F.concat(F.lit("(?s)^"), text.literal(F.col("x")), F.lit("\\z"))).alias("ok")).collect()
    assert all(r.ok for r in rows)


def test_composed(spark):
    h = "struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>"
    rows = [(((2, "उद्योग दर्ता", 3, "दर्ता गराउनु पर्ने", 6, None)), "subsection"), ((None,) * 6, "section"), ((None, "क", None, None, None, None), None), ((1, "x" * 31, None, None, None, None), "anusuchi")]
    got = spark.createDataFrame(rows, f"h {h}, t string").select(chunks.clause_ref(F.col("h"), F.col("t")).alias("r"), chunks.breadcrumb(F.col("h")).alias("b")).collect()
    assert [r.r for r in got] == ["ch2 (उद्योग दर्ता) › sec3 (दर्ता गराउनु पर्ने) › sub6 [subsection]", "(root) [section]", "(root) []", f"anusuchi1 ({'x' * 30}...) [anusuchi]"]
    assert [r.b for r in got][:3] == ["परिच्छेद 2: उद्योग दर्ता → दफा 3: दर्ता गराउनु पर्ने → उपदफा (6)", "—", "परिच्छेद ?: क"]
    e = spark.createDataFrame([((1, "क", None, None, 2, "ख"), "", ["तर ग"], None)], f"h {h}, t string, p array<string>, e array<string>")
    assert e.select(chunks.embedding_text(F.col("h"), F.col("t"), F.col("p"), F.col("e")).alias("x")).collect()[0].x == "परिच्छेद: क | उपदफा: (2) | खण्ड: (ख) |  | तर ग"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.d, r.c) for r in got] == [(25.0, 1.0), (0.0, None), (None, None), (None, None)]
