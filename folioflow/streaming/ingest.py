"""Incremental ingestion: uploads admitted, the new ones appended, each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators import validate
from folioflow.sources import cache


def admitted(uploads: DataFrame, max_mb: int = 25, max_pages: int = 500) -> DataFrame:
    """Uploads with the columns admission needs, and its result."""
    ready = uploads
    for column, kind in (("content_type", "string"), ("given_id", "string"), ("options", "string"), ("page_count", "int")):
        if column not in ready.columns:
            ready = ready.withColumn(column, F.lit(None).cast(kind))
    return validate.reject_code(ready, max_mb, max_pages)


def ingest(uploads: DataFrame, store: str, checkpoint: str, variant: str, parse: Callable[[DataFrame], DataFrame] | None = None, rejects: str | None = None) -> StreamingQuery:
    """A query that parses and stores what the store doesn't hold, and appends rejects beside it.

    A batch that is run again finds its documents in the store, so each is stored once.
    """

    def batch(rows: DataFrame, _: int) -> None:
        checked = admitted(rows)
        good = checked.filter("reject is null").dropDuplicates(["sha256"])
        cache.put(parse(good) if parse else good, store, variant)
        if rejects:
            validate.error_bodies(checked).write.mode("append").json(rejects)

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
