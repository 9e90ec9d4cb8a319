import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lekhya.llm import mixing, tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.DEFAULT_RANKS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(T.DEFAULT_RANKS), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def own(text):
    return [i for ids in T.encode_words(T.words_of(text), T.DEFAULT_RANKS) for i in ids]


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("ab 'st\n\t  क्ा१é😀.,<|>"), st.characters(exclude_categories=("Cs", "Cn"), max_codepoint=0xFFFF)), max_size=40))
def test_equals_library(reference, text):
    assert "".join(T.words_of(text)) == text
    assert own(text) == reference(text)


def test_long_and_special(reference):
    for text in ("<|endoftext|>", "it's we'll  x", " \n \n x", "कार्यालय " * 3000, "a" * 3000):
        assert own(text) == reference(text)


def test_operator(spark, reference):
    texts = ["कार्यालय दर्ता", None, "", " ", "the end", "the end", "x\ny  z"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, word string")
    for blocks in (1, 3):
        got = {r.doc_id: list(r.ids) for r in T.encode(df, "doc_id", "text", blocks=blocks).collect()}
        assert got == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in T.token_counts(df, "doc_id", "text").collect()} == {i: len(reference(t)) if t else 0 for i, t in enumerate(texts)}
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0


@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 40), min_size=1))
def test_less_than_one_block_off(weights):
    slots = mixing.pfair_period(weights)
    period = sum(weights.values())
    assert sorted(x for s in slots.values() for x in s) == list(range(period))
    for s, w in weights.items():
        done = 0
        for t in range(period):
            done += t in slots[s]
            assert abs(done - (t + 1) * w / period) < 1
    assert {s: len(x) for s, x in slots.items()} == weights


def test_mix(spark):
    rows = [(i, "big" if i % 3 else "small", 10) for i in range(300)] + [(1000, "other", 5)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame(
        [("m", "big", 0.5, 1), ("m", "small", 0.4, 3), ("m", "none", 0.1, 9), ("z", "none", 1.0, 1), (None, "big", 1.0, 1), ("n", "other", 1.0, 2)],
        "mix_name string, source string, target_share double, max_repeats int",
    )
    used, plan = mixing.mix(counted, targets, block_tokens=50)
    rows = used.orderBy("mix_name", "slot", "start").collect()
    m = [r for r in rows if r.mix_name == "m"]
    size = {s: sum(r.n_tokens for r in m if r.source == s) for s in ("big", "small")}
    total = sum(size.values())
    assert abs(size["big"] / total - 5 / 9) < 0.01 and {r.mix_name for r in rows} == {"m", "n"}
    assert max(r.repeat_no for r in m if r.source == "big") == 0 and max(r.repeat_no for r in m if r.source == "small") <= 2
    assert len({(r.mix_name, r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    run = 0
    for done, r in enumerate(m):  # never more than one block and one document from the share
        run += r.n_tokens * (r.source == "big")
        assert abs(run - sum(x.n_tokens for x in m[: done + 1]) * 5 / 9) < 2 * 50 + 10
    assert sum(r.n_tokens for r in rows if r.mix_name == "n") == 10  # twice the only document


def test_offsets_equal_brute_force(spark):
    rows = [(i, "a" if i % 2 else "b", i % 7 + 1) for i in range(200)]
    got = mixing.offsets(spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, source string, n_tokens bigint, buckets bigint")).collect()
    for s in "ab":
        part = sorted((r.start, r.n_tokens) for r in got if r.source == s)
        at = 0
        for start, n in part:
            assert start == at
            at += n


def test_any_shares_have_a_short_period():
    shares = {"a": 0.12345, "b": 0.23457, "c": 0.34567, "d": 0.29631}
    rows, slots = mixing.plan([("m", s, x, 2) for s, x in shares.items()], dict.fromkeys(shares, 10**12))
    period = rows[0][4]
    assert period <= mixing.SLOTS and sorted(x[3] for x in slots) == list(range(period))
    assert all(abs(w / period - shares[s]) <= 1 / mixing.SLOTS for _, s, _, w, *_ in rows)
    many = {f"s{i}": 1e-9 if i else 1.0 for i in range(2000)}
    weights = mixing.whole_weights(many)
    assert min(weights.values()) >= 1 and sum(weights.values()) <= mixing.SLOTS_PER_SOURCE * 2000 + 2000
    assert mixing.whole_weights({"x": 0.2, "y": 0.3, "z": 0.5}) == {"x": 2, "y": 3, "z": 5}


def test_sized_counts_each_text_once(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "", "s"), (3, None, "s"), (4, "c", "t"), (5, "d", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = mixing.sized(docs, targets)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.n_tokens) for r in got.collect()] == [(1, 2)] and plan.count("ArrowEvalPython") == 1


def test_equal_rows_and_blocks_by_bytes(spark, monkeypatch, reference):
    monkeypatch.setattr(T, "BLOCK_BYTES", 64)
    monkeypatch.setattr(T, "TASK_BYTES", 128)
    rows = [(7, "नेपाल the act")] * 50 + [(7, "other")] * 2 + [(None, "x y"), (None, "x y"), (8, "long " * 500), (9, ""), (9, None), (9, None)]
    got = T.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    assert "Exchange hashpartitioning(_block" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got.collect()) == sorted((str(k), reference(t) if t else []) for k, t in rows)
