import os

import pytest

from lekhya.llm import queries

DATA = "/root/testdata/sf0.001"
#: Columns of every query, and those that tell its rows apart.
KEYS = {
    "p1_found": (["src_table", "src_id", "office_id"], ["src_table", "src_id"]), "p1_unmatched": (["src_table", "name", "n_values"], ["src_table", "name"]),
    "p1_candidates": (["name", "office_id", "slips", "rank"], ["name", "office_id"]),
    "p4_found": (["chunk_row_id", "field", "item_pos"], ["chunk_row_id", "field", "item_pos"]), "p4_corrections": (["word", "correction", "n", "n_correction"], ["word"]),
    "p4_confusions": (["printed", "seen"], ["printed", "seen"]), "p4_heads": (["line"], ["line"]),
    "p4_repaired": (["chunk_row_id", "field", "item_pos", "repaired"], ["chunk_row_id", "field", "item_pos"]),
    "p5_found": (["src_table", "src_id", "item_pos"], ["src_table", "src_id", "item_pos"]), "p5_unified": (["token", "canonical", "n_values"], ["token"]),
    "p5_values": (["src_table", "src_id", "item_pos", "unified"], ["src_table", "src_id", "item_pos"]),
    "p7_found": (["chunk_row_id", "field"], ["chunk_row_id", "field"]), "p7_restored": (["chunk_row_id", "field", "restored", "chain", "recovered"], ["chunk_row_id", "field"]),
    "p8_ids": (["doc_id", "ids"], ["doc_id"]), "p8_counts": (["doc_id", "n_tokens"], ["doc_id"]),
    "p9_mix": (["mix_name", "slot", "start", "doc_id", "source", "repeat_no", "n_tokens"], ["mix_name", "doc_id", "repeat_no"]),
    "p9_report": (["mix_name", "source", "target_share", "reached_share", "tokens", "n_documents", "n_repeats", "max_repeats"], ["mix_name", "source"]),
    "p10_found": (["doc_id", "line_no", "kind"], ["doc_id", "line_no", "kind"]), "p10_redacted": (["doc_id", "redacted"], ["doc_id"]), "p10_report": (["kind", "n_lines", "n_documents"], ["kind"]),
}
#: Queries of what a small corpus may not show.
MAY_BE_EMPTY = {"p4_confusions", "p4_heads"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return {n: q(spark, DATA).collect() for n, q in queries.queries().items()}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_rows_are_told_apart(rows, spark, name):
    columns, keys = KEYS[name]
    assert rows[name] or name in MAY_BE_EMPTY
    assert all(r.__fields__ == columns for r in rows[name])
    assert len({tuple(r[k] for k in keys) for r in rows[name]}) == len(rows[name])


def test_queries_agree(rows):
    assert set(rows) == set(KEYS)
    named = {(r.src_table, r.src_id): r.office_id for r in rows["p1_found"]}
    assert sum(r.n_values for r in rows["p1_unmatched"]) == sum(o == -1 for o in named.values())
    assert {tuple(r) for r in rows["p4_found"]} == {tuple(r)[:3] for r in rows["p4_repaired"]}
    assert {tuple(r) for r in rows["p5_found"]} == {tuple(r)[:3] for r in rows["p5_values"]}
    assert {tuple(r) for r in rows["p7_found"]} == {tuple(r)[:2] for r in rows["p7_restored"]} and all(r.recovered <= bool(r.chain) for r in rows["p7_restored"])
    assert {r.doc_id: len(r.ids) for r in rows["p8_ids"]} == {r.doc_id: r.n_tokens for r in rows["p8_counts"]}
    assert sum(r.n_lines for r in rows["p10_report"]) == len(rows["p10_found"]) and {r.kind for r in rows["p10_found"]} <= {"EMAIL", "PHONE", "ID", "ADDRESS", "NAME"}
    for mix in {r.mix_name for r in rows["p9_report"]}:
        report = [r for r in rows["p9_report"] if r.mix_name == mix]
        assert abs(sum(r.reached_share for r in report) - 1) < 1e-9 and all(r.n_repeats <= r.max_repeats for r in report)
        assert sum(r.tokens for r in report) == sum(r.n_tokens for r in rows["p9_mix"] if r.mix_name == mix)
