"""Readers: PDF files, dataset files, corpora, gold queries and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions.chunks import DATASET
from lekhya.functions.text import slug

#: bytes of a PDF -> texts of its pages
OcrFunction = Callable[[bytes], list[str]]


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the PDF files of a folder; empty if there are none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def pages(files: DataFrame, ocr: OcrFunction) -> DataFrame:
    """(doc, page_no, text): one row per page, numbered from 1; a file is one task's row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, n, text) for path, data in zip(b["path"], b["content"]) for n, text in enumerate(ocr(bytes(data)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    got = files.select("path", "content").mapInPandas(run, "path string, page_no int, text string")
    return got.select(slug(F.col("path")).alias("doc"), "page_no", "text")


def datasets(spark: SparkSession, folder: str, pattern: str = "*_dataset.json") -> DataFrame:
    """(act_source, act_metadata, chunks) of dataset files, by explicit schema.

    A file without chunks is an error when it is read.
    """
    got = spark.read.schema(DATASET).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1)
    missing = F.raise_error(F.concat(F.lit("no chunks in "), F.input_file_name()))
    return got.select(stem.alias("act_source"), "act_metadata", F.when(F.col("chunks").isNotNull(), F.col("chunks")).otherwise(missing).alias("chunks"))


def chunks(sets: DataFrame) -> DataFrame:
    """The chunks of datasets as rows, with act_source and their position ``ord``."""
    rows = sets.select("act_source", F.posexplode("chunks").alias("ord", "c"))
    return rows.select("act_source", F.col("ord").cast("bigint").alias("ord"), "c.*")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(ord, query, docid) of a gold file: a JSON list of queries."""
    got = spark.read.schema("query string, relevant_part_in_doc string").option("multiLine", True).json(path)
    return got.select(F.monotonically_increasing_id().alias("ord"), "query", F.col("relevant_part_in_doc").alias("docid"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """(method, metric, K, value) of a written report."""
    got = spark.read.schema("timestamp string, config map<string,string>, results map<string,map<string,double>>").option("multiLine", True).json(path)
    rows = got.select(F.explode("results").alias("method", "values")).select("method", F.explode("values").alias("name", "value"))
    parts = F.split("name", "@")
    return rows.select("method", parts[0].alias("metric"), parts[1].cast("int").alias("K"), "value")
