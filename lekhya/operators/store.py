"""A collection of points: embedding, keyed upsert, counts, deletion.

A collection is a folder, on any file system that Spark reads, of parquet
buckets by hash of the point and of pointers: the one of the greatest number
names the version of every bucket.  An upsert reads and writes only the buckets
that its points fall into and then adds a pointer, so readers never see half of
it and a failed job leaves the old version in place.  Buckets that neither the
current nor the last pointer names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions.chunks import embedding_text, point_id
from lekhya.functions.vectors import checked
from lekhya.io import remove, written
from lekhya.rules import NEPALI, RulePack

#: texts -> (dense vectors, {token: weight} of each)
Encoder = Callable[[list[str]], tuple[list[list[float]], list[dict[int, float]]]]


#: Buckets of a new collection.
BUCKETS = 64


def hashed_words(dim: int = 64, tokens: int = 1 << 20) -> Encoder:
    """The default encoder: signed hashing of words, term counts as weights."""
    import zlib

    def encode(texts: list[str]) -> tuple[list[list[float]], list[dict[int, float]]]:
        dense, sparse = [], []
        for t in texts:
            v, s = [0.0] * dim, {}
            for w in t.split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
                s[h % tokens] = s.get(h % tokens, 0.0) + 1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            dense.append([x / size for x in v])
            sparse.append(s)
        return dense, sparse

    return encode


def embed(df: DataFrame, text: str, encoder: Encoder, dim: int) -> DataFrame:
    """``df`` with ``vector`` and ``sparse`` of column ``text``, batch by batch."""

    @F.pandas_udf("vector array<float>, sparse map<int,float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            dense, sparse = encoder([t or "" for t in s])
            yield pd.DataFrame({"vector": dense, "sparse": sparse})

    got = df.withColumn("_v", run(F.col(text)))
    return got.withColumn("vector", checked(F.col("_v.vector"), dim)).withColumn("sparse", F.col("_v.sparse")).drop("_v")


def points(chunks: DataFrame, act_source: str, encoder: Encoder, dim: int, rules: RulePack = NEPALI) -> DataFrame:
    """(point_id, vector, sparse, payload, ord) of chunks."""
    text = embedding_text(F.col("hierarchy"), F.col("text"), F.col("provisos"), F.col("explanations"), rules)
    got = embed(chunks.withColumn("_text", text), "_text", encoder, dim)
    payload = F.struct(
        F.col("id").alias("chunk_id"), F.col(act_source).alias("act_source"), "type", "hierarchy", "text", "provisos", "explanations", "refs", "stats"
    )
    return got.select(point_id(F.col("id")).alias("point_id"), "vector", "sparse", payload.alias("payload"), "ord")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one of the greatest order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upserted(old: DataFrame | None, new: DataFrame, key: str = "point_id", order: str = "ord") -> DataFrame:
    """``old`` with the rows of ``new`` in the place of rows of equal key."""
    latest = last_wins(new, key, order)
    return latest if old is None else old.join(latest.select(key), key, "left_anti").unionByName(latest)


@dataclass(frozen=True)
class Collection:
    """A named collection below ``root``, a folder that all workers share."""

    spark: SparkSession
    root: str
    name: str
    buckets: int = BUCKETS

    @property
    def _dir(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    def _fs(self, path: str) -> tuple:
        """(file system, path) of the cluster's configuration."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf), where

    def _pointers(self) -> list[int]:
        fs, where = self._fs(f"{self._dir}/pointers")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []

    def _pointer(self, number: int) -> dict:
        """{"buckets": number of buckets, "paths": {bucket: folder}}; an absent one is empty."""
        fs, where = self._fs(f"{self._dir}/pointers/{number:012d}")
        if number < 1 or not fs.exists(where):
            return {"buckets": self.buckets, "paths": {}}
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def ensure(self) -> None:
        """Create the collection if it is absent."""
        fs, where = self._fs(f"{self._dir}/pointers")
        fs.mkdirs(where)

    def read(self) -> DataFrame | None:
        at = self._pointers()
        return self._read(self._pointer(at[-1])["paths"].values()) if at else None

    def _read(self, folders) -> DataFrame | None:
        paths = [f"{self._dir}/{f}" for f in folders]
        return self.spark.read.parquet(*sorted(paths)) if paths else None

    def upsert(self, new: DataFrame) -> int:
        """Replace and add the points of ``new``; returns the collection's number of points."""
        self.ensure()
        at = self._pointers()
        number = at[-1] if at else 0
        old = self._pointer(number)
        paths = old["paths"]
        bucket = F.pmod(F.xxhash64("point_id"), F.lit(old["buckets"])).cast("int")
        with written(last_wins(new, "point_id", "ord")) as latest:
            touched = sorted(r[0] for r in latest.select(bucket.alias("b")).distinct().collect())  # no more than there are buckets
            if touched:
                before = self._read([paths[str(b)] for b in touched if str(b) in paths])
                folder = f"v{number + 1:012d}-{uuid.uuid4().hex[:8]}"
                rows = latest if before is None else before.join(latest.select("point_id"), "point_id", "left_anti").unionByName(latest)
                rows.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self._dir}/{folder}")
                paths = paths | {str(b): f"{folder}/bucket={b}" for b in touched}
        self._point(number + 1, {"buckets": old["buckets"], "paths": paths})
        self._sweep(set(paths.values()) | set(old["paths"].values()), self._pointer(number - 1)["paths"].values(), at[:-1])
        got = self._read(paths.values())
        return 0 if got is None else got.count()

    def _point(self, number: int, pointer: dict) -> None:
        """Add a pointer; it appears whole under its name or not at all."""
        fs, where = self._fs(f"{self._dir}/pointers/{number:012d}")
        temporary = self._fs(f"{self._dir}/pointers/_{uuid.uuid4().hex}")[1]
        stream = fs.create(temporary)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        if not fs.rename(temporary, where):
            raise RuntimeError(f"another upsert wrote version {number} of {self.name}")

    def _sweep(self, kept: set[str], earlier, numbers: list[int]) -> None:
        """Remove folders that only earlier pointers name, and these pointers."""
        for folder in set(earlier) - kept:
            remove(self.spark, f"{self._dir}/{folder}")
        for n in numbers:
            remove(self.spark, f"{self._dir}/pointers/{n:012d}")

    def delete(self) -> None:
        """Remove the collection; an absent one is no error."""
        remove(self.spark, self._dir)

    def info(self) -> dict:
        got = self.read()
        return {"name": self.name, "points": 0 if got is None else got.count(), "status": "absent" if got is None else "ready"}


def hits(found: DataFrame, collection: DataFrame) -> DataFrame:
    """Search results (qid, docid, score, rank) with the payload's display fields."""
    p = collection.select(F.col("point_id").alias("docid"), "payload")
    return found.join(p, "docid").select(
        "qid", "rank", "score", "payload.chunk_id", "payload.act_source", "payload.type", "payload.hierarchy", "payload.text", "payload.stats"
    )
