"""Readers of documents, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """A Parquet table of pages, with only the two columns read."""
    return spark.read.parquet(path).select(id_col, html)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of UTF-8 files, a document each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html binary) of files in any encoding."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("html"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (doc_id, seq, chunk, is_last) rows from a growing folder of Parquet files."""
    return spark.readStream.schema("doc_id long, seq int, chunk binary, is_last boolean").parquet(path)
