"""Nested records as flat tables linked by Merkle identities.

Every object and list below a record, and the record itself, is canonicalised
(keys sorted, nulls left out, 1.0 as 1, text as JSON) and hashed bottom-up: in
the canonical form of a parent a child stands as ``{"#": hash}``.  Equal hashes
are equal objects, which are stored once; a bridge row (kind, root, ordinals,
path, parent hash, child hash) keeps every occurrence, so records can be put
together again (``put_together``) but for keys that held null.

Typed columns are hashed by Spark expressions; JSON text of unknown shape is
walked in the Arrow worker of its task, to the same canonical form.  The bridge
needs no shuffle; only the store of distinct objects is a ``groupBy`` on the
hash, which combines on the map side, so an object held by a third of all
records costs one row per task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.io import table

BRIDGE = "child string, root_id bigint, pos1 int, pos2 int, path string, parent_hash string, child_hash string, canonical string"
LEVELS = (("ch", "ch_title"), ("sec", "sec_title"), ("sub", None), ("clause", None))
REFS = "array<struct<type:string,id:string,text:string>>"
_NODE = "struct<child_hash:string,canonical:string>"


def _canonical(fields: list[tuple[str, Column]]) -> Column:
    """JSON of the fields in the order of their names, nulls left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]) if fields else F.struct())


def _node(canonical: Column) -> Column:
    return F.struct(F.sha2(canonical, 256).alias("child_hash"), canonical.alias("canonical"))


def _link(node: Column) -> Column:
    """What stands for an object in its parent; null for a null object."""
    return F.when(node.isNotNull(), F.struct(node["child_hash"].alias("#")))


def _row(child: str, pos1: Column, path: Column, parent: Column | None, node: Column) -> Column:
    over = F.lit(None).cast("string") if parent is None else parent["child_hash"]
    return F.when(
        node.isNotNull(),
        F.struct(
            F.lit(child).alias("child"), pos1.cast("int").alias("pos1"), F.lit(0).alias("pos2"), path.alias("path"),
            over.alias("parent_hash"), node["child_hash"].alias("child_hash"), node["canonical"].alias("canonical"),
        ),
    )


def _plain_json(column: str, kind: T.DataType) -> Column:
    """The canonical form of a struct or list of plain values."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), _canonical([(f.name, c[f.name]) for f in kind.fields]))
    return F.to_json(c)


def chunk_bridge(chunks: DataFrame, key: str = "chunk_row_id") -> DataFrame:
    """Bridge rows of chunk rows: kinds ``hierarchy`` and ``refs`` for levels and references.

    The others are ``chunks`` for the record, ``chunks.hierarchy`` and
    ``chunks.refs`` for what holds the levels and references, and
    ``chunks.<column>`` for every other list or struct.  Positions: levels 1 to
    4 for ch, sec, sub, clause; the element's index for refs; else 0.  A null
    hierarchy, null refs and null elements give no row, but null elements keep
    their position.  Any columns may stand beside hierarchy and refs.
    """
    types = {f.name: f.dataType for f in chunks.schema.fields}
    nested = [n for n, t in types.items() if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) and n not in ("hierarchy", "refs", key)]
    scalars = [n for n in types if n not in (*nested, "hierarchy", "refs", key)]
    levels = F.array(
        *[
            F.when(
                F.col(f"hierarchy.{name}").isNotNull(),
                _node(_canonical([("level", F.lit(name)), ("no", F.col(f"hierarchy.{name}").cast("string")), *([("title", F.col(f"hierarchy.{title}"))] if title else [])])),
            ).cast(_NODE)
            for name, title in LEVELS
        ]
    )
    elements = F.transform("refs", lambda r: F.when(r.isNotNull(), _node(_canonical([("id", r["id"]), ("text", r["text"]), ("type", r["type"])]))).cast(_NODE))
    leaves = chunks.select(
        F.col(key).alias("_root"), F.struct(*[F.col(f"`{n}`") for n in scalars]).alias("_own") if scalars else F.lit(None).alias("_own"),
        *[F.when(F.col(f"`{n}`").isNotNull(), _node(_plain_json(n, types[n]))).alias(f"_n{i}") for i, n in enumerate(nested)],
        F.when(F.col("hierarchy").isNotNull(), levels).alias("_levels"), elements.alias("_refs"),
    )
    held = leaves.select(
        "*", F.when(F.col("_levels").isNotNull(), _node(_canonical([(name, _link(F.col("_levels")[i])) for i, (name, _) in enumerate(LEVELS)]))).alias("_hier"),
        F.when(F.col("_refs").isNotNull(), _node(F.to_json(F.transform("_refs", _link)))).alias("_list"),
    )
    kids = [("hierarchy", "_hier"), ("refs", "_list"), *((n, f"_n{i}") for i, n in enumerate(nested))]
    root = _canonical([*((n, F.col("_own")[n]) for n in scalars), *((n, _link(F.col(c))) for n, c in kids)])
    whole = held.withColumn("_me", _node(root))
    me, at = F.col("_me"), F.lit
    rows = F.concat(
        F.array(_row("chunks", at(0), at("$"), None, me), *[_row(f"chunks.{n}", at(0), at(f"$.{n}"), me, F.col(c)) for n, c in kids]),
        F.array(*[_row("hierarchy", at(i + 1), at(f"$.hierarchy.{name}"), F.col("_hier"), F.col("_levels")[i]) for i, (name, _) in enumerate(LEVELS)]),
        F.coalesce(
            F.transform("_refs", lambda r, i: _row("refs", i, F.concat(at("$.refs["), i.cast("string"), at("]")), F.col("_list"), r)),
            F.array().cast("array<struct<child:string,pos1:int,pos2:int,path:string,parent_hash:string,child_hash:string,canonical:string>>"),
        ),
    )
    flat = whole.select(F.col("_root").alias("root_id"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("k"))
    return flat.select("k.child", "root_id", "k.pos1", "k.pos2", "k.path", "k.parent_hash", "k.child_hash", "k.canonical")


# --- JSON of unknown shape -------------------------------------------------

_DECODER = json.JSONDecoder()
_TOP = {"workflows", "entities", "act_slug"}


def load_payload(text: str | None) -> dict | None:
    """The record in ``text``, which may stand in a fence or among prose.

    None if there is none or its JSON is incomplete.
    """
    at = -1 if text is None else text.find("{")
    while at >= 0:
        try:
            got, _ = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            got = None
        if isinstance(got, dict) and _TOP & got.keys():
            return got
        if got is None and re.match(r'\{\s*"(?:%s|act_title)"' % "|".join(_TOP), text[at : at + 200]):
            return None
        at = text.find("{", at + 1)
    return None


def as_list(value: object) -> list:
    """A list of children: a lone object is one, JSON text is what it holds."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return []
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


_ESCAPE = re.compile(r"\\(?:u[0-9a-f]{4}|.)")


def _number(value: object) -> object:
    """One form of equal numbers: 1.0 and -0.0 are whole."""
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _json(body: object) -> str:
    text = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    # hexadecimal digits as in the JSON of Spark
    return _ESCAPE.sub(lambda m: m.group() if m.group()[1] != "u" else "\\u" + m.group()[2:].upper(), text) if "\\u" in text else text


def _hash(canonical: str) -> str:
    return hashlib.sha256(canonical.encode("utf-8", "surrogatepass")).hexdigest()


class Node:
    """An object or list with its hash, canonical form and children (key or index, Node)."""

    __slots__ = ("kids", "canonical", "hash")

    def __init__(self, value: dict | list) -> None:
        named = isinstance(value, dict)
        pairs = sorted((k, v) for k, v in value.items() if v is not None) if named else list(enumerate(value))
        nodes = {k: Node(v) for k, v in pairs if isinstance(v, (dict, list))}
        body = [(k, {"#": nodes[k].hash} if k in nodes else _number(v)) for k, v in pairs]
        self.kids = list(nodes.items())
        self.canonical = _json(dict(body) if named else [v for _, v in body])
        self.hash = _hash(self.canonical)


def merkle(value: object) -> tuple[str, str]:
    """(hash, canonical form) of a JSON value; children stand as their hashes."""
    if isinstance(value, (dict, list)):
        node = Node(value)
        return node.hash, node.canonical
    canonical = _json(_number(value))
    return _hash(canonical), canonical


def put_together(link: str, store: dict[str, str]) -> object:
    """The object of that hash, from canonical forms by hash."""

    def inside(value: object) -> object:
        if isinstance(value, dict):
            return put_together(value["#"], store) if value.keys() == {"#"} else {k: inside(v) for k, v in value.items()}
        return [inside(v) for v in value] if isinstance(value, list) else value

    top = json.loads(store[link])
    return {k: inside(v) for k, v in top.items()} if isinstance(top, dict) else inside(top)


def listed(record: dict) -> dict:
    """The record with its workflows, and their fees, as lists."""
    flows = [f if not isinstance(f, dict) or f.get("all_fees") is None else {**f, "all_fees": as_list(f["all_fees"])} for f in as_list(record.get("workflows"))]
    return {**record, "workflows": flows} if record.get("workflows") is not None else record


def payload_rows(root: int, payload: str | None) -> Iterator[tuple]:
    """Bridge rows of a payload: of the record and of every object and list in it.

    Kinds ``workflows`` and ``all_fees`` are the elements of these lists, with
    the positions of the workflow and of the fee; what is no object there is
    one of its own.  The others are ``ner_results`` for the record and the path
    without ordinals, with the index in the nearest list.
    """
    record = load_payload(payload)
    if record is None:
        return
    try:
        top = Node(listed(record))
    except RecursionError:
        return
    yield "ner_results", root, 0, 0, "$", None, top.hash, top.canonical
    stack = [(top, "$", "", 0, 0)]
    while stack:
        node, path, kind, flow, pos = stack.pop()
        in_list = node.canonical[0] == "["
        for k, kid in node.kids:
            below = f"{path}[{k}]" if in_list else f"{path}.{k}"
            name = f"{kind}[]" if in_list else f"{kind}.{k}" if kind else k
            at = (k, 0) if name == "workflows[]" else (flow, k if in_list else pos)
            child = {"workflows[]": "workflows", "workflows[].all_fees[]": "all_fees"}.get(name, f"ner_results.{name}")
            yield child, root, *at, below, node.hash, kid.hash, kid.canonical
            stack.append((kid, below, name, *at))
        if kind in ("workflows", "workflows[].all_fees") and in_list:
            # elements that are no objects are children all the same
            for i, value in enumerate(json.loads(node.canonical)):
                if value is not None and not isinstance(value, dict):
                    ident, canonical = merkle(value)
                    yield ("workflows", root, i, 0) + (f"{path}[{i}]", node.hash, ident, canonical) if kind == "workflows" else ("all_fees", root, flow, i, f"{path}[{i}]", node.hash, ident, canonical)


def payload_bridge(results: DataFrame) -> DataFrame:
    """Bridge rows of ``ner_results.payload``; damaged and null ones give none."""

    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BRIDGE.split(", ")]
        for b in batches:
            rows = [r for root, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in payload_rows(root, text)]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return results.select("result_id", "payload").filter("payload IS NOT NULL").mapInArrow(walk, BRIDGE)


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bridge rows of chunks and ner_results."""
    return chunk_bridge(table(spark, sf_dir, "chunks")).unionByName(payload_bridge(table(spark, sf_dir, "ner_results")))


def objects(rows: DataFrame) -> DataFrame:
    """Each distinct object once, with the number of its occurrences.

    The canonical form follows from the hash; as a key it keeps the aggregation
    in hash tables.
    """
    return rows.groupBy("child", "child_hash", "canonical").agg(F.count("*").alias("n_occurrences"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per child record of hierarchy, refs and all_fees."""
    return bridge(spark, sf_dir).filter(F.col("child").isin("hierarchy", "refs", "all_fees")).select("child", "root_id", "pos1", "pos2")


def p2_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge: every occurrence of every object, linked to its parent."""
    return bridge(spark, sf_dir).drop("canonical")


def p2_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store: every distinct object once."""
    return objects(bridge(spark, sf_dir))


def p2_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of references, rebuilt from bridge and canonical objects."""
    ref = F.from_json("canonical", "id string, text string, type string")
    return (
        chunk_bridge(table(spark, sf_dir, "chunks")).filter("child = 'refs'")
        .select(F.col("root_id").alias("chunk_row_id"), F.col("pos1").alias("ref_pos"), ref.alias("r"))
        .select("chunk_row_id", "ref_pos", F.col("r.type").alias("ref_type"), F.col("r.id").alias("ref_id"), F.col("r.text").alias("ref_text"))
    )


def p2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of levels, rebuilt from bridge and canonical objects."""
    level = F.from_json("canonical", "level string, no string, title string")
    return (
        chunk_bridge(table(spark, sf_dir, "chunks")).filter("child = 'hierarchy'")
        .select(F.col("root_id").alias("chunk_row_id"), F.col("pos1").alias("level_pos"), level.alias("l"))
        .select("chunk_row_id", "level_pos", "l.level", F.col("l.no").alias("level_no"), "l.title")
    )


def p2_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of fees, rebuilt from bridge and canonical objects."""
    fee = F.from_json("canonical", "type string, amount_raw string, amount_npr string")
    return (
        payload_bridge(table(spark, sf_dir, "ner_results")).filter("child = 'all_fees'")
        .select(F.col("root_id").alias("result_id"), F.col("pos1").alias("flow_pos"), F.col("pos2").alias("fee_pos"), fee.alias("f"))
        .select("result_id", "flow_pos", "fee_pos", F.col("f.type").alias("fee_type"), F.col("f.amount_raw").alias("amount_raw"), F.col("f.amount_npr").alias("amount_npr"))
    )
