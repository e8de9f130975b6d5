"""Uploaded files as rows, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_uploads(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """filename, content and length of the files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")


def stream_uploads(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")
