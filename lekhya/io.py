"""Table access and lineage cutting shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster's ``spark.checkpoint.dir`` is used as it is.  Without it a
    temporary folder serves where all tasks run in this one process (tests);
    on a cluster it is an error.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if not have:
        have = spark.conf.get("spark.checkpoint.dir", None)
        if not have and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = have or tempfile.mkdtemp(prefix="lekhya-")
        sc.setCheckpointDir(have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_folder(spark: SparkSession) -> str:
    """Where this application writes its tables, below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lekhya-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on the file system that it names; an absent one is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove_written(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; results that read them are gone then."""
    remove(spark, written_folder(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet below the shared checkpoint folder and read it.

    Cuts the lineage like a checkpoint, but compressed and columnar, so later
    steps read only the columns they use.
    """
    path = f"{written_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``materialise`` for the time of a block; the table is removed behind it."""
    path = f"{written_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.parquet(path)
    finally:
        remove(df.sparkSession, path)


def materialise_all(parts: Iterable[DataFrame]) -> DataFrame:
    """As ``materialise`` for the union of parts, one after the other: only one is worked on at a time."""
    path = None
    for df in parts:
        path = path or f"{written_folder(df.sparkSession)}/{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, keys: list[str], order: str, out: str, width: int = 65_536) -> DataFrame:
    """``df`` with ``out``: the position, from 0, by the integer ``order`` within ``keys``.

    Buckets of the order are counted first and numbered alone, so a key that
    holds most rows is many small windows.
    """
    t = df.withColumn("_bucket", F.floor(F.col(order) / width))
    over = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = t.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    before = sums.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(over), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(order))
    return t.withColumn("_in", inside).join(before, [*keys, "_bucket"]).withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("int")).drop("_bucket", "_in", "_before")


def small_rows(df: DataFrame, most: int) -> list:
    """All rows of a table that must be small; raises beyond ``most`` rows.

    The bound is checked before anything is broadcast, so a fixed reference
    list that grew past its documented size is an error and not a slow job.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"reference table has more than {most} rows")
    return rows


def text_column(df: DataFrame, name: str):
    """Column ``name`` of ``df``, or a null string where the column is absent."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
