"""The cache of parsed documents: content-addressed rows in Parquet, by variant and shard."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.assemble import PROCESSING_VERSION


def cache_variant(backend: str, models: dict[str, str] | None = None) -> str:
    """The name of a way of parsing: the backend, a hash of its models, the version of the processing."""
    mark = f"-{hashlib.sha256(json.dumps(models, sort_keys=True).encode()).hexdigest()[:8]}" if models else ""
    return f"{backend}{mark}-p{PROCESSING_VERSION}"


def hits_and_misses(uploads: DataFrame, cached: DataFrame, variant: str, force_ocr: bool = False) -> tuple[DataFrame, DataFrame]:
    """(uploads in the cache, the others) by sha256; forced reading never uses the cache."""
    if force_ocr:
        return uploads.limit(0), uploads
    keys = cached.filter(F.col("variant") == variant).select("sha256").distinct()
    return uploads.join(keys, "sha256", "left_semi"), uploads.join(keys, "sha256", "left_anti")


def served(hits: DataFrame, cached: DataFrame, variant: str) -> DataFrame:
    """Cached documents under the id and name they are asked for, marked as from the cache."""
    rows = cached.filter(F.col("variant") == variant).drop("document_id", "filename", "variant", "shard")
    return hits.select("sha256", "document_id", "filename").join(rows, "sha256").withColumn("from_cache", F.lit(True))


def put(documents: DataFrame, path: str, variant: str) -> None:
    """Appends documents (sha256, ...) that the cache doesn't hold yet."""
    new = documents.dropDuplicates(["sha256"]).withColumn("variant", F.lit(variant)).withColumn("shard", F.substring("sha256", 1, 2))
    old = get(documents.sparkSession, path)
    if old is not None:
        new = new.join(old.select("sha256", "variant"), ["sha256", "variant"], "left_anti")
    new.write.mode("append").partitionBy("variant", "shard").parquet(path)


def get(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache's rows; None if there is none or it can't be read, which counts as a miss."""
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - an unreadable cache is a miss
        return None
