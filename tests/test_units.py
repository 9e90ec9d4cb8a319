from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lekhya.functions.quantity import NEPALI_NUMBERS, Grammar, whole
from lekhya.operators import units

UNITS = [
    ("npr", "money", 1.0), ("paisa", "money", 0.01), ("inr", "money", 1.6), ("usd", "money", 135.0), ("eur", "money", 150.0), ("thousand", "scale", 1e3),
    ("lakh", "scale", 1e5), ("million", "scale", 1e6), ("crore", "scale", 1e7), ("day", "time", 1.0), ("week", "time", 7.0), ("month", "time", 30.0),
    ("year", "time", 365.0), ("working_day", "time", 1.4), ("hour", "time", 1 / 24),
]
G = Grammar(UNITS)


@pytest.mark.parametrize(
    "text,amount",
    [
        ("रु. १०,०००", 10000), ("Rs. 1,00,000/-", 100000), ("५ लाख ५० हजार रुपैयाँ", 550000), ("साढे सात हजार रुपैयाँ", 7500), ("सवा लाख रुपैयाँ", 125000),
        ("डेढ हजार रुपैयाँ", 1500), ("रु. १.५ करोड", 15000000), ("भा.रु. १००", 160), ("US$ 1,000", 135000), ("अमेरिकी डलर ५०", 6750), ("५,००० पैसा मात्र", 50),
        ("Rs. 2K", 2000), ("Rs. 5 lakh 50 thousand", 550000), ("रु. २,५००।-", 2500), ("पच्चीस सय रुपैयाँ", 2500), ("दुई हजार पाँच सय रुपैयाँ", 2500),
        ("NPR 1250000.00", 1250000), ("रु. ५०० रुपैयाँ", 500), ("रू. ५०,०००", 50000), ("50 euro", 7500), ("रु. ५०० प्रति निवेदन", 500),
    ],
)
def test_money(text, amount):
    vector, got = G.parse(text)
    assert vector == (1, 0) and whole(got) == amount


@pytest.mark.parametrize(
    "text,days",
    [
        ("३० (तीस) दिन", 30), ("साढे तीन महिना भित्रै", 105), ("one and a half months", 45), ("२ महिना १० दिनसम्म", 70), ("5 business days", 7), ("१० कार्य दिनभित्र", 14),
        ("७२ घण्टा", 3), ("एक वर्ष छ महिना भित्र", 545), ("आधा महिना", 15), ("P1Y6M", 545), ("PT72H", 3), ("P2W", 14), ("3 yr 6 mo", 1275), ("दुई साता भित्र", 14), ("two months and ten days", 70),
    ],
)
def test_time(text, days):
    vector, got = G.parse(text)
    assert vector == (0, 1) and whole(got) == days


@pytest.mark.parametrize("text", [None, "", "  ", "दस्तुर", "रु.", "२ प्रतिशत", "2% of turnover", "अनुसूची-३ बमोजिम", "दफा ३० बमोजिमको अवधि", "monthly", "कार्य दिन", "प्रत्येक वर्ष", "null", "-", "५-७ दिन", "हजार रुपैयाँ", "x" * 100_000])
def test_no_quantity(text):
    assert G.parse(text, "दिन") is None


def test_bare_numbers():
    assert G.parse("30.0", "दिन") == ((0, 1), Fraction(30)) and G.parse(" ६० ", "दिन") == ((0, 1), Fraction(60))
    assert G.parse("30") is None


@given(st.integers(1, 99), st.sampled_from(["सय", "हजार", "लाख", "करोड"]))
def test_number_words(n, scale):
    factor = {"सय": 100, "हजार": 1000, "लाख": 10**5, "करोड": 10**7}[scale]
    assert G.parse(f"{NEPALI_NUMBERS[n]} {scale} रुपैयाँ") == ((1, 0), Fraction(n * factor))


MORE = Grammar([*UNITS, ("m", "length", 1.0, 0.0), ("km", "length", 1000.0), ("kg", "mass", 1.0), ("acre", "length^2", 4046.8564), ("celsius", "temperature", 1.0, 273.15), ("knot", "length/time", 44448.0)])


@pytest.mark.parametrize(
    "text,dimension,amount",
    [
        ("Rs. 500 per day", "money/time", 500), ("रु. ७०० प्रति हप्ता", "money/time", 100), ("500 rupees / hour", "money/time", 12000), ("रु. ५०० प्रति निवेदन", "money", 500), ("3 sq km", "length^2", 3_000_000), ("20 m^2", "length^2", 20),
        ("20 m² ", "length^2", 20), ("2 acre", "length^2", 8094), ("5 cubic m", "length^3", 5), ("12 km/hour", "length/time", 288_000), ("2 knot", "length/time", 88_896), ("10 m^-1", "1/length", 10), ("27 celsius", "temperature", 300),
        ("6 kg*m", "length*mass", 6), ("4 kg-day", "time*mass", 4), ("10 celsius per day", "temperature/time", 10), ("9 kg per m^2", "mass/length^2", 9), ("Rs. 500 payable to the office", "money", 500), ("Pay to the desk Rs. 20 or nothing", "money", 20),
    ],
)
def test_products_quotients_powers_offsets(text, dimension, amount):
    vector, got = MORE.parse(text)
    assert (MORE.dimension(vector), whole(got)) == (dimension, amount)


@pytest.mark.parametrize("text", ["Rs. 5 to 7", "Rs. 500 or Rs. 600", "between Rs. 5 and Rs. 6", "५ देखि ७ दिन", "5 m 3 kg", "2 celsius 3 celsius"])
def test_no_definite_quantity(text):
    assert MORE.parse(text) is None


def test_vectors_form_a_group():
    u, v = MORE.unit["km"], MORE.unit["day"]
    assert (u / v) * v == u and u**2 / u == u and (u * v).vector == tuple(a + b for a, b in zip(u.vector, v.vector)) and u**-1 * u == MORE.one


def test_the_parser_runs_once(spark):
    table = spark.createDataFrame(UNITS, "code string, dimension string, factor double")
    df = spark.createDataFrame([(1, "7", "time", "दिन")], "k int, text string, dimension string, bare string")
    assert units.normalise(df, table, "text", "dimension", "bare")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_normalise(spark):
    table = spark.createDataFrame([*UNITS, (None, None, None)], "code string, dimension string, factor double")
    rows = [(1, "रु. ५००", "money", None, "x"), (1, "रु. ५००", "money", None, "x"), (2, None, "money", None, None), (3, "३ दिन", "money", None, ""), (4, "7", "time", "दिन", None)]
    df = spark.createDataFrame(rows, "k int, text string, dimension string, bare string, amount string")
    got = units.normalise(df, table, "text", "dimension", "bare")
    assert sorted((r.k, r.amount) for r in got.collect()) == [(1, 500), (1, 500), (4, 7)]
    assert units.normalise(df.limit(0), table, "text", "dimension", "bare").count() == 0
    with pytest.raises(ValueError):
        from lekhya.io import small_rows

        small_rows(table, 3)
