"""Token ids of the whole corpus by a byte-level BPE vocabulary.

Text falls into words (a run of non-space with the one space before it, or a
run of white space), words into pieces by the tokenizer's pattern; merges never
cross pieces.  The distinct words of the corpus are encoded once, by replaying
the merges over a slice of the vocabulary: an inverted index from token pair to
the positions where it stands applies every merge in rank order and touches
only the neighbours of what it merged.  Documents then look their words up.

Documents are blocked by the bytes of their texts; a block carries its own
distinct words through the corpus-level dictionary and meets its part of it
again by block, so neither a hot word nor the dictionary's size lands in one
task, and nothing unbounded is broadcast.  Equal rows are counted before they
are moved.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.io import materialise, table

#: Ranks of the tokenizer: lines of base64 token and rank.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Text of a block and of a task, on average; beyond MAX_TASKS tasks these grow.
BLOCK_BYTES, TASK_BYTES, MAX_TASKS = 1 << 20, 8 << 20, 100_000
#: White space of Unicode, which the tokenizer's pattern means by \\s.
_WS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def words_of(text: str) -> list[str]:
    """The words of a text; joined they are the text.

    The last white space of a run goes with the next word if it is a plain
    space, else it is a word of its own, as in the tokenizer's pattern.
    """
    return _WORD.findall(text)


@lru_cache(maxsize=1)
def _pieces():
    import regex

    ws = _WS.replace("\\x0b", "\\v")
    return regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def replay(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of every piece, by replaying the merges over all pieces at once.

    All pieces lie in one array of tokens with links to their neighbours.  The
    index leads from a pair to its positions; a heap gives the pair of lowest
    rank; merging at a position changes only the pairs to its left and right.
    """
    tok: list[bytes] = [bytes([b]) for p in pieces for b in p]
    n = len(tok)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    starts, at = [], 0
    for p in pieces:
        starts.append(at)
        if p:
            prv[at] = -1
            at += len(p)
            nxt[at - 1] = -1
    where: dict[bytes, set[int]] = defaultdict(set)
    heap: list[tuple[int, bytes]] = []

    def note(i: int) -> None:
        j = nxt[i]
        if j >= 0:
            pair = tok[i] + tok[j]
            rank = ranks.get(pair)
            if rank is not None:
                spots = where[pair]
                if not spots:
                    heapq.heappush(heap, (rank, pair))
                spots.add(i)

    for i in range(n):
        note(i)
    alive = [True] * n
    while heap:
        _, pair = heapq.heappop(heap)
        for i in sorted(where.pop(pair, ())):
            j = nxt[i] if alive[i] else -1
            if j < 0 or tok[i] + tok[j] != pair:
                continue
            alive[j] = False
            k = nxt[j]
            tok[i], nxt[i] = pair, k
            if k >= 0:
                prv[k] = i
            note(i)
            if prv[i] >= 0:
                note(prv[i])
    out = []
    for p, i in zip(pieces, starts):
        ids = []
        while p and i >= 0:
            ids.append(ranks[tok[i]])
            i = nxt[i]
        out.append(ids)
    return out


def encode_words(words: list[str], path: str) -> list[list[int]]:
    """Ids of each word; the pieces of all words share one replay."""
    find, ranks = _pieces(), load_ranks(path)
    parts = [[p.encode("utf-8", "surrogatepass") for p in find.findall(w)] for w in words]
    distinct = list({p for ps in parts for p in ps})
    ids = dict(zip(distinct, replay(distinct, ranks)))
    return [[x for p in ps for x in ids[p]] for ps in parts]


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts; they are not collected, only summed."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).collect()[0][0]


def combined(b: pa.RecordBatch) -> pa.RecordBatch:
    """A batch (_block, _key, _text) with ``_n``, equal rows as one."""
    n = pa.array(np.ones(b.num_rows, np.int32))
    if len(b.column(1).unique()) < b.num_rows:
        t = pa.Table.from_batches([b.append_column("_n", n)]).group_by(b.schema.names).aggregate([("_n", "sum")]).combine_chunks()
        return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in b.schema.names), t.column("_n_sum").combine_chunks().cast(pa.int32())], [*b.schema.names, "_n"])
    return b.append_column("_n", n)


def encode(docs: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS, blocks: int | None = None) -> DataFrame:
    """(key, ids) of every row; null and empty texts have an empty list.

    Equal rows give a row each.  ``ranks_path`` must exist on every worker.
    ``blocks`` is the number of blocks, by default that of BLOCK_BYTES in all
    texts; the tasks that move texts grow in number with the texts too.
    """
    size = text_bytes(docs, text)
    blocks = blocks or size // BLOCK_BYTES + 1
    tasks = min(MAX_TASKS, max(docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES + 1))
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    block = F.pmod(F.xxhash64("_key", "_text"), F.lit(blocks)).cast("int")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, set[str]] = {}
            for blk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(blk, set()).update(words_of(t))
            rows = [(blk, w) for blk, ws in by.items() for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["_block", "word"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(combined, batches)

    full = src.filter("_text IS NOT NULL AND _text <> ''")
    uses = materialise(full.select(block.alias("_block"), "_text").mapInArrow(distinct_words, "_block int, word string").distinct())

    def replay_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for b in batches for w in b.column(0).to_pylist()]
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(encode_words(part, ranks_path), pa.list_(pa.int32()))], ["word", "ids"])

    dictionary = uses.select("word").distinct().mapInArrow(replay_slice, "word string, ids array<int>")
    known = uses.join(dictionary, "word").select("_block", "word", "ids")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.column("word").to_pylist()
        at = {w: i for i, w in enumerate(words)}
        ids = right.column("ids").combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.chunk(0) if ids.num_chunks else pa.array([], pa.list_(pa.int32()))
        flat, offs = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        offs = offs - offs[0] if len(offs) else np.zeros(1, np.int64)
        size = np.diff(offs)
        lens, pieces = [], []
        for t in left.column("_text").to_pylist():
            idx = np.fromiter((at[w] for w in words_of(t)), np.int64) if t else np.zeros(0, np.int64)
            n = size[idx]
            total = int(n.sum())
            lens.append(total)
            # positions in the flat ids of all tokens of all words in order
            begin = np.repeat(offs[idx] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(idx) else offs[:0], n)
            pieces.append(flat[begin + np.arange(total)])
        offsets = pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32())
        values = pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int32), pa.int32())
        return pa.table({"_key": left.column("_key").cast(pa.int64()), "_n": left.column("_n"), "ids": pa.ListArray.from_arrays(offsets, values)})

    kind = docs.schema[key].dataType.simpleString()
    texts = full.select(block.alias("_block"), "_key", "_text").mapInArrow(combine, f"_block int, _key {kind}, _text string, _n int")
    lists = (
        texts.repartition(tasks, "_block").groupBy("_block")
        .cogroup(known.repartition(tasks, "_block").groupBy("_block")).applyInArrow(assemble, "_key bigint, _n int, ids array<int>")
        .withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).select("_key", "ids")
    )
    empty = src.filter("_text IS NULL OR _text = ''").select(F.col("_key").cast("bigint"), F.array().cast("array<int>").alias("ids"))
    return lists.unionByName(empty).withColumnRenamed("_key", key)


def token_counts(docs: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, n_tokens) of every row, without building the lists.

    Every task encodes its distinct words and counts; nothing is shuffled.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for s in batches:
            split = [words_of(t) if t else [] for t in s]
            new = list({w for ws in split for w in ws if w not in known})
            if len(known) > 1_000_000:
                known, new = {}, list({w for ws in split for w in ws})
            known.update(zip(new, map(len, encode_words(new, ranks_path))))
            yield pd.Series([sum(known[w] for w in ws) for ws in split], dtype="int64")

    return docs.withColumn("n_tokens", count(F.col(text))).select(key, "n_tokens")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
