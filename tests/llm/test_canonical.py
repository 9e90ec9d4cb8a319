import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lekhya.llm import canonical as C

OFFICES = [
    (1, "वन विभाग", "Department of Forest", "DoF"), (2, "मालपोत कार्यालय, नेमरामा", "Land Revenue Office, Nemrama", None), (3, "मालपोत कार्यालय, केलगाछी", "Land Revenue Office, Kelgachhi", None),
    (4, "हाङवाटो नगरपालिका", "Hangwato Municipality", None), (5, "कम्पनी दर्ता रजिष्ट्रारको कार्यालय", "Office of the Registrar of Companies", "OoRoC"), (6, "बौद्धिक सम्पत्ति प्रवर्द्धन बोर्ड", "Intellectual Property Promotion Board", "IPPB"),
]
M = C.Matcher(OFFICES)


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abcक", max_size=12), st.text("abcक", max_size=12))
def test_edits_is_levenshtein(a, b):
    assert C.edits(a, b) == slow(a, b)


def test_tree_finds_all_within():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    tree = C.BKTree((w, i) for i, w in enumerate(words))
    for q in words[:40] + ["", "zzzz"]:
        assert {k for _, k, _ in tree.within(q, 2)} == {w for w in words if slow(q, w) <= 2}


@pytest.mark.parametrize(
    "name,office",
    [
        ("वन विभाग", 1), ("श्री वन विभागमा", 1), ("वन वभिाग", 1), ("वनविभाग", 1), ("D.o.F.", 1), ("the department of forest", 1), ("Dept. of Forest", 1), ('{"name": "वन विभाग", "level": "केन्द्र"}', 1),
        ("मालपोत कार्यालय, नेमरामा", 2), ("नेमरामाको मालपोत कार्यालय", 2), ("मालपोत कार्यालय, नेमरामा समक्ष", 2), ("नेमरामास्थित मालपोत कार्यालय", 2), ("Land Revenue Off., Nemrama", 2), ("मालपोत कार्यालय ,केलगाछी (दर्ता शाखा)", 3),
        ("हाङवाटो न.पा.", 4), ("हाङवाटो नगरपालिकाको कार्यालय", 4), ("HANGWATO MUNICIPALITY", 4), ("कम्पनी दर्ता रजिष्ट्रारको कार्यालयबाट", 5), ("बौद्धिक सम्पत्ति प्रवरद््धन बोर्ड", 6), ("ippb", 6),
        ("वन मन्त्रालय", None), ("मालपोत कार्यालय, बिनगाछी", None), ("मालपोत कार्यालय", None), ("कार्यालय", None), ("N/A", None), ("तोकिएको अधिकारी", None), ("x" * 5000, None), ("विभाग", None),
    ],
)
def test_names(name, office):
    assert M(name) == office


def sharded(df, ref, column, shards, buckets=1):
    names = C.counted_names(df, column)
    return {r["_name"]: r.id for r in C.merged(C.near_sharded(names, ref, shards, buckets), "id").collect()}


def test_operators_agree(spark):
    ref = spark.createDataFrame([*OFFICES, (None, "x", None, None)], "office_id int, name string, name_en string, abbr string")
    names = ["वन विभाग", None, "", "  ", "वन वभिाग", "नाम", "वन विभाग", "मालपोत कार्यालय, नेमरामा"]
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(names)], "k int, name string, office_id string")
    small = {r.k: r.office_id for r in C.map_names(df, ref, "name").collect()}
    assert small == {0: 1, 1: None, 2: None, 3: None, 4: 1, 5: -1, 6: 1, 7: 2}
    assert sharded(df, ref, "name", 3, 2) == {"वन विभाग": 1, "वन वभिाग": 1, "मालपोत कार्यालय, नेमरामा": 2}
    assert C.map_names(df.limit(0), ref, "name").count() == 0 and C.map_names(df, ref.limit(0), "name").filter("office_id = -1").count() == 5


def test_large_lists_are_sharded_with_the_same_answers(spark, monkeypatch):
    """Beyond SMALL_LIST shards answer; the full form goes before a stripped one in another shard."""
    ref = spark.createDataFrame([*OFFICES, *((100 + i, f"{w} (गोलचौर)", None, None) for i, w in enumerate(["वन विभाग", "वन विभाग शाखा"]))], "office_id int, name string, name_en string, abbr string")
    names = ["वन विभाग", "वन विभाग (गोलचौर)", "वन विभाग शाखा (गोलचौर)", "वन वभिाग", "नाम", None, " "]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    small = {r.k: r.office_id for r in C.map_names(df, ref, "name").collect()}
    monkeypatch.setattr(C, "SMALL_LIST", 1)
    monkeypatch.setattr(C, "BUCKET_NAMES", 2)
    assert {r.k: r.office_id for r in C.map_names(df, ref, "name").collect()} == small and small[1] == 100 and small[0] == 1


def test_hot_names_and_others_are_whole(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_PART", 2)
    ref = spark.createDataFrame(OFFICES, "office_id int, name string, name_en string, abbr string")
    names = ["वन विभाग"] * 30 + ["नाम"] * 5 + ["ippb"] * 5 + [None] * 3
    got = C.map_names(spark.createDataFrame(list(enumerate(names)), "k int, name string"), ref, "name")
    assert sorted((r.k, r.name, r.office_id) for r in got.collect()) == [(i, n, {"वन विभाग": 1, "नाम": -1, "ippb": 6, None: None}[n]) for i, n in enumerate(names)]


def test_two_slips_apart():
    m = C.Matcher([(1, "x", "Department of Industry", None), (2, "y", "Land Revenue Office, Kelgachhi", None)])
    assert m("Departmnt of Indstry") == 1 and m("Land Revenue Office, Kolgachho") is None and m("Land Revenue Office, Kelgachi") == 2
    assert m.within("Departmnt of Indstry") == {1: (2, 0)}


def test_every_entry_within_the_threshold():
    rnd = random.Random(3)
    entries = [(i, "".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 6))), None, None) for i in range(300)]
    m = C.Matcher(entries)
    for _, q, *_ in entries[:40]:
        want = {i for i, w, *_ in entries if C.slips(C.keys_of(q)[0], C.keys_of(w)[0], slow(q, w)) is not None and slow(q, w) <= 2}
        assert set(m.within(q)) == want
