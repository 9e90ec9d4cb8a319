import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lekhya.operators import orphans

CHUNK = (
    "chunk_row_id bigint, act_slug string, id string, type string, hierarchy struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>, "
    "refs array<struct<type string, id string, text string>>, loaded_at timestamp_ntz, extra string"
)
T0 = dt.datetime(2024, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def brute(chunks, deletions, entities, acts):
    """The statement of the problem, row by row."""
    prefix = {f"{s}-{'None' if y is None else y}": s for s, y in acts}

    def live(row, t):
        return row["t"] is not None and t is not None and row["t"] <= t and not any(i == row["id"] and row["t"] <= d <= t for i, d in deletions)

    out = set()
    for c in chunks:
        for pos, rid in enumerate(c["refs"]):
            if rid is None:
                continue
            head, _, tail = rid.rpartition("-")
            kind = next((k for k in ("sec", "ch", "sub", "cl") if tail.startswith(k)), None)
            value = tail[len(kind) :] if kind else None

            def hit(x):
                if kind is None or prefix.get(head) is None or x["act"] != prefix[head]:
                    return False
                if kind == "sec":
                    return str(x["sec"]) == value
                if kind == "ch":
                    return str(x["ch"]) == value and not x["type"].startswith("anusuchi")
                return (str(x["sub"]) == value if kind == "sub" else x["clause"] == value) and x["sec"] == c["sec"]

            if not any(hit(x) and live(x, c["t"]) for x in chunks):
                out.add(("chunks", c["row"], pos))
    for key, ref, t in entities:
        if ref is not None and not any(x["id"] == ref and live(x, t) for x in chunks):
            out.add(("entities", key, 0))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    acts = [("a", 2050), ("b", None), ("a-b", 2050)]
    chunks = []
    for i in range(120):
        act = rnd.choice(["a", "a", "a", "b", "a-b"])
        sec = rnd.choice([None, 1, 2, 3, 5])
        chunks.append(
            {
                "row": i, "act": act, "id": f"{act}-{rnd.randint(1, 12)}", "type": rnd.choice(["section", "clause", "anusuchi_clause"]), "ch": rnd.choice([None, 1, 2]),
                "sec": sec, "sub": rnd.choice([None, 1, 2]), "clause": rnd.choice([None, "क", "ख"]), "t": at(rnd.choice([None, *range(0, 120, 3)])),
                "refs": [rnd.choice([None, "a-2050-sec1", "a-2050-sec4", "b-None-ch1", "a-2050-ch3", "a-2050-sub1", "a-2050-clक", "-sec1", "x", "a-b-2050-sec2"]) for _ in range(rnd.randint(0, 3))],
            }
        )
    deletions = [(rnd.choice(chunks)["id"], at(rnd.randint(0, 130))) for _ in range(25)]
    entities = [(i, rnd.choice([None, "unknown", *[c["id"] for c in chunks]]), at(rnd.randint(0, 130))) for i in range(60)]
    cdf = spark.createDataFrame(
        [(c["row"], c["act"], c["id"], c["type"], (c["ch"], None, c["sec"], None, c["sub"], c["clause"]), [("t", r, "") for r in c["refs"]], c["t"], "x") for c in chunks], CHUNK
    )
    ddf = spark.createDataFrame([(i, d) for i, d in deletions], "chunk_id string, deleted_at timestamp_ntz")
    edf = spark.createDataFrame(entities, "entity_id bigint, chunk_id string, extracted_at timestamp_ntz")
    adf = spark.createDataFrame(acts, "act_slug string, bs_year int")
    got = orphans.orphans(orphans.references(cdf, edf, adf), orphans.parent_keys(cdf, ddf))
    found = [(r.src_table, r.src_id, r.ref_pos) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(chunks, deletions, entities, acts)


def test_integer_runs(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 3, 7, 8, None)] + [("b", 5)], "g string, n bigint")
    runs = orphans.integer_runs(df, ["g"], "n")
    assert sorted((r.g, r.run_start, r.run_end) for r in runs.collect()) == [("a", 1, 3), ("a", 7, 8), ("b", 5, 5)]
    refs = spark.createDataFrame([("a", x) for x in (0, 2, 4, 8, 9)] + [("c", 1)], "g string, n bigint")
    gone = orphans.missing_keys(refs, runs, ["g"], "n")
    assert sorted((r.g, r.n) for r in gone.collect()) == [("a", 0), ("a", 4), ("a", 9), ("c", 1)]


def test_asof_over_days(spark):
    day = orphans.DAY
    runs = spark.createDataFrame([("k", 10, 20), ("k", 5, 3 * day), ("k", day, day + 1)], "k string, run_start bigint, run_end bigint")
    left = spark.createDataFrame([("k", 4, 1), ("k", 5, 2), ("k", 2 * day, 3), ("k", 9 * day, 4), ("z", 5, 5), (None, 5, 6), ("k", None, 7)], "k string, t bigint, id int")
    got = {r.id: r.run_end for r in orphans.asof_end(left, runs, ["k"], "t").collect()}
    assert got == {1: None, 2: 3 * day, 3: 3 * day, 4: 3 * day, 5: None, 6: None, 7: None}


@pytest.mark.parametrize("width", [1, 10**5, 10**9, 10**12])
def test_a_hot_key_in_one_day_or_many(spark, monkeypatch, width):
    """One key holds nearly all rows; tenths of a second below the day give the same ends."""
    monkeypatch.setattr(orphans, "HOT_ROWS", 20)
    rnd = random.Random(width)
    runs = [("hot", (s := rnd.randrange(0, 60 * width)), s + rnd.randrange(0, 9 * width)) for _ in range(60)] + [("cool", 3, 5)]
    left = [("hot", rnd.randrange(0, 70 * width), i) for i in range(150)] + [("hot", 5, 200 + i) for i in range(30)] + [("cool", 4, 900)]
    rdf, ldf = spark.createDataFrame(runs, "k string, run_start bigint, run_end bigint"), spark.createDataFrame(left, "k string, t bigint, id int")
    got = {r.id: r.run_end for r in orphans.asof_end(ldf, rdf, ["k"], "t").collect()}
    assert got == {i: max((e for k2, s, e in runs if k2 == k and s <= t), default=None) for k, t, i in left}


def test_keys_of_text_are_runs_of_numbers(spark):
    ids = ["doc1", "doc2", "doc10", "doc007", "doc", "7", "", "a\nb3", "x99999999999999999999"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", orphans._id_key(F.col("id")).alias("k")).collect()
    assert len({(r.k.g1, r.k.g2, r.k.num) for r in rows}) == len(ids)
    by = {r.id: r.k for r in rows}
    assert by["doc1"].g1 == by["doc2"].g1 == by["doc10"].g1 != by["doc007"].g1 and by["doc10"].num == 10 and by["doc"].num == -1


def test_empty_tables(spark):
    cdf = spark.createDataFrame([], CHUNK)
    ddf = spark.createDataFrame([], "chunk_id string, deleted_at timestamp_ntz")
    edf = spark.createDataFrame([(1, "x", T0)], "entity_id bigint, chunk_id string, extracted_at timestamp_ntz")
    adf = spark.createDataFrame([], "act_slug string, bs_year int")
    got = orphans.orphans(orphans.references(cdf, edf, adf), orphans.parent_keys(cdf, ddf)).select("src_table", F.col("src_id")).collect()
    assert [tuple(r) for r in got] == [("entities", 1)]
