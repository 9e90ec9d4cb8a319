import json

from lekhya.operators import nested


def rows(payload):
    return [(r[0], r[2], r[3]) for r in nested.payload_rows(1, payload) if r[0] == "all_fees"]


def flows(*fees, **more):
    return {"act_slug": "a", "workflows": [{"task_name": "t", "all_fees": f} for f in fees], **more}


def test_shapes_of_lists():
    fee = {"amount_raw": "५०० रुपैयाँ"}
    assert rows(json.dumps(flows([fee, None, fee]))) == [("all_fees", 0, 0), ("all_fees", 0, 2)]
    assert rows(json.dumps(flows(fee))) == [("all_fees", 0, 0)]  # a lone object
    assert rows(json.dumps(flows(json.dumps([fee, fee])))) == [("all_fees", 0, 0), ("all_fees", 0, 1)]  # text that holds a list
    assert rows(json.dumps({"act_slug": "a", "workflows": {"all_fees": [fee]}})) == [("all_fees", 0, 0)]
    assert rows(json.dumps(flows(None, [], [fee]))) == [("all_fees", 2, 0)]
    assert rows(json.dumps({"workflows": [None, {"all_fees": [fee]}]})) == [("all_fees", 1, 0)]


def test_text_around_and_damage():
    whole = json.dumps(flows([{"amount_raw": "1"}]))
    assert rows("```json\n" + whole + "\n```") == [("all_fees", 0, 0)]
    assert rows("Result {see below}: " + whole + " as asked") == [("all_fees", 0, 0)]
    assert rows(whole[:-5]) == [] and rows(None) == [] and rows("") == [] and rows("[]") == [] and rows("{") == []


def test_merkle_identities():
    a = {"x": 1, "y": {"b": None, "c": [1, {"d": "e"}]}}
    b = {"y": {"c": [1, {"d": "e"}]}, "x": 1}
    assert nested.merkle(a)[0] == nested.merkle(b)[0]
    assert nested.merkle([1, 2])[0] != nested.merkle([2, 1])[0]
    assert nested.merkle({"x": "1"})[0] != nested.merkle({"x": 1})[0]


SCHEMA = (
    "chunk_row_id bigint, hierarchy struct<ch int, ch_title string, sec int, sec_title string, sub int, clause string>, "
    "refs array<struct<type string, id string, text string>>, child string, pos1 int"
)


def test_chunk_bridge(spark):
    h = (1, "t", None, None, 3, "क")
    data = [(1, h, [("section", "i", "x"), None, ("section", "i", "x")], "clash", 9), (2, None, None, None, None), (3, (None,) * 6, [], None, None)]
    got = nested.chunk_bridge(spark.createDataFrame(data, SCHEMA))
    out = sorted((r.child, r.root_id, r.pos1, r.pos2) for r in got.collect() if not r.child.startswith("chunks"))
    assert out == [("hierarchy", 1, 1, 0), ("hierarchy", 1, 3, 0), ("hierarchy", 1, 4, 0), ("refs", 1, 0, 0), ("refs", 1, 2, 0)]
    kinds = sorted((r.child, r.root_id) for r in got.collect() if r.child.startswith("chunks"))
    assert kinds == [("chunks", 1), ("chunks", 2), ("chunks", 3), ("chunks.hierarchy", 1), ("chunks.hierarchy", 3), ("chunks.refs", 1), ("chunks.refs", 3)]
    stored = {r.child_hash: r.n_occurrences for r in nested.objects(got.filter("child = 'refs'")).collect()}
    assert list(stored.values()) == [2]  # the same reference twice is stored once
    assert nested.chunk_bridge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payload_bridge(spark):
    whole = json.dumps(flows([{"amount_raw": "1"}]))
    data = [(2**60 + 1, whole, "x"), (None, whole, None), (3, None, None), (4, whole[:-3], None), (5, whole, None), (5, whole, None)]
    df = spark.createDataFrame(data, "result_id bigint, payload string, child string")
    got = sorted((str(r.root_id), r.child) for r in nested.payload_bridge(df).filter("child = 'all_fees'").collect())
    assert got == sorted([(str(2**60 + 1), "all_fees"), ("None", "all_fees"), ("5", "all_fees"), ("5", "all_fees")])
    assert nested.payload_bridge(df.limit(0)).count() == 0


def bare(x):
    """Without nulls in objects, whole numbers as integers: what identities keep."""
    if isinstance(x, dict):
        return {k: bare(v) for k, v in x.items() if v is not None}
    return [bare(v) for v in x] if isinstance(x, list) else nested._number(x)


def test_numbers_and_escapes():
    assert nested.merkle({"a": 1})[0] == nested.merkle({"a": 1.0})[0] != nested.merkle({"a": 1.5})[0]
    assert nested.merkle(["\x1f\\u001f"])[1] == '["\\u001F\\\\u001f"]'


def test_payloads_can_be_put_together():
    record = flows([{"amount_raw": "१", "more": {"deep": [1, [2.0, {"x": None}], "s"]}}, None, "fee"], {"amount_raw": "lone"}, entities=[{"a": []}, {"a": []}], n=None, t={"#": "no hash"})
    rows = list(nested.payload_rows(1, json.dumps(record)))
    store = {r[6]: r[7] for r in rows}
    want = bare(nested.listed(record))
    assert nested.put_together(rows[0][6], store) == want
    paths = [r[4] for r in rows]
    assert len(paths) == len(set(paths)) and all(r[5] in store for r in rows if r[4] != "$")
    assert {(r[2], r[3]) for r in rows if r[0] == "all_fees"} == {(0, 0), (0, 2), (1, 0)}


def test_chunks_can_be_put_together(spark):
    h = (1, "t\x1f\"", None, None, 3, "क")
    data = [(1, h, [("section", "i", "x/y"), None], "clash", 9), (2, None, None, None, None), (3, (None,) * 6, [], None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    rows = nested.chunk_bridge(df).collect()
    store = {r.child_hash: r.canonical for r in rows}
    roots = {r.root_id: nested.put_together(r.child_hash, store) for r in rows if r.child == "chunks"}
    level = lambda name, no, **more: {"level": name, "no": no, **more}
    assert roots == {
        1: {"child": "clash", "pos1": 9, "refs": [{"type": "section", "id": "i", "text": "x/y"}, None], "hierarchy": {"ch": level("ch", "1", title=h[1]), "sub": level("sub", "3"), "clause": level("clause", "क")}},
        2: {}, 3: {"refs": [], "hierarchy": {}},
    }
    for r in rows:  # both walks have one canonical form
        assert nested._json(json.loads(r.canonical)) == r.canonical and nested._hash(r.canonical) == r.child_hash
