"""Streaming ingest: arriving chunks are upserted into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lekhya.operators.store import Collection, Encoder, points


def chunk_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Chunks of parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def upsert_stream(stream: DataFrame, collection: Collection, encoder: Encoder, dim: int, act_source: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes points and is upserted.

    Keys come from the chunk ids, so a batch that runs again after a failure
    writes the same points.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.upsert(points(batch, act_source, encoder, dim))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
