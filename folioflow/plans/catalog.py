"""Every core query by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.operators import units
from folioflow.plans import evaluation, printed, runs, structure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {"p1_found": units.found, "p1_amounts": units.all_amounts, **printed.QUERIES, **structure.QUERIES, **evaluation.QUERIES, **runs.QUERIES}
ORACLES: dict[str, str] = {**printed.ORACLES, **structure.ORACLES, **evaluation.ORACLES, **runs.ORACLES}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["chunk_metadata"](spark, sf_dir)
