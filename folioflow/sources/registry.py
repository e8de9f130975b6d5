"""Readers of raw frames by name: the extension point for layout models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession, str], dict[str, DataFrame]]
_readers: dict[str, Reader] = {}


class BackendUnavailable(LookupError):
    """No reader of that name, or one whose library is missing."""


def register(name: str, reader: Reader) -> None:
    _readers[name] = reader


def available() -> list[str]:
    return sorted(_readers)


def get(name: str) -> Reader:
    if name not in _readers:
        raise BackendUnavailable(f"no backend {name!r}; there are: {', '.join(available()) or 'none'}")
    return _readers[name]


def reset() -> None:
    _readers.clear()
    register("parquet", _parquet)


def _parquet(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from folioflow.operators.assemble import raw_frames

    return raw_frames(spark, path)


reset()
