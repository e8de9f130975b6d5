"""Cutting oversized items at natural boundaries, with an overlap, range by range.

No task needs a whole item.  An item is laid out in ranges, each with a halo of
the characters before it.  The lengths of the ranges are summed up front (for a
file they are counted by the workers and stitched by a prefix sum), so each
range knows its place and the item's length n.  The pieces of an item get even
targets k*n/m; the range that owns a target looks for the best boundary in the
window before it and, in its halo, for the previous cut and the start of the
overlap.  So pieces are emitted by offset, independently of each other.

With limit L, overlap O, window W = (L-O)/4 and tolerance T = O/4 the targets
are at most L-O-T-W apart, so a piece with its overlap never exceeds L.

Edge cases: null text gives no piece, an empty text one empty piece, an item
without a limit (or at most as long) one whole piece; without any boundary the
cut is at the target; the overlap is O, give or take T, so that it starts at a
word or row where possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.session import distinct_rows, table

#: Characters of a range, at two levels, so that slicing a long text takes about n^1.5 steps.
OUTER, INNER = 1 << 22, 1 << 14
#: Fixed: natural boundaries from best to worst; a cut comes right after the last match in its window.
TEXT_LEVELS = (
    r"\n[ \t\r]*\n\s*",
    r"[.!?…][\"'”’)\]]*\s*\n\s*",
    r"[.!?…][\"'”’)\]]*\s+|[。！？]",
    r"\n\s*",
    r"[,;:]\s+|[，；：、]",
    r"\s+",
)
TABLE_LEVELS = (r"\n", r"\|\s*", r"\s+")


def _last(window: Column, levels: tuple[str, ...], otherwise: Column) -> Column:
    """Characters of the window up to the end of its last boundary of the best level."""
    found = [F.nullif(F.length(F.regexp_extract(window, f"(?s)^.*(?:{level})", 0)), F.lit(0)) for level in levels]
    return F.coalesce(*found, otherwise)


def _sub(content: Column, start: Column, size: Column) -> Column:
    return content.substr((start + 1).cast("int"), size.cast("int"))


def _ranges(df: DataFrame, size: int) -> DataFrame:
    """Each row's body cut into ranges of at most ``size``, each with up to ``max_chars`` before it as a halo."""
    body = F.length("content") - F.col("halo")
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(body - 1, F.lit(0)).cast("bigint"), F.lit(size).cast("bigint")))
    cut = df.select("*", at.alias("at"))
    halo = F.least(F.col("halo") + F.col("at"), F.coalesce(F.col("max_chars"), F.lit(0)).cast("bigint"))
    size_col = F.when(F.col("max_chars").isNull(), F.lit((1 << 31) - 1)).otherwise(halo + size)
    return cut.select(
        *[c for c in df.columns if c not in ("content", "base", "halo")],
        _sub(F.col("content"), F.col("halo") + F.col("at") - halo, size_col).alias("content"),
        (F.col("base") + F.col("at")).alias("base"),
        halo.cast("bigint").alias("halo"),
    )


def _pieces(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces whose target lies in each range: keys, piece, n_pieces, piece_start, piece_end, piece_text."""
    limit, n = F.col("max_chars"), F.col("n")
    overlap = F.least(F.col("overlap_chars"), F.expr("max_chars div 2"))
    with_window = ranges.withColumn("o", overlap).withColumn("w", F.greatest(F.expr("(max_chars - o) div 4"), F.lit(0))).withColumn("tol", F.expr("o div 4"))
    step = F.greatest(limit - F.col("o") - F.col("tol") - F.col("w"), F.lit(1))
    m = F.when(limit.isNull() | (n <= limit), F.lit(1)).otherwise(F.ceil(n / step)).cast("bigint")
    known = with_window.withColumn("m", m)
    end = F.col("base") + F.length("content") - F.col("halo")
    # targets floor(k*n/m) in (base, end]; an item of length 0 has its one piece in its one range
    low, high = F.expr("base * m div greatest(n, 1)"), (end * F.col("m") / F.greatest(n, F.lit(1))).cast("bigint") + 1
    k = F.explode(F.sequence(F.greatest(low, F.lit(1)), F.least(F.greatest(high, F.lit(1)), F.col("m"))))
    of = known.withColumn("end", end).select("*", k.alias("k")).withColumn("target", F.expr("k * n div m")).withColumn("before", F.expr("(k - 1) * n div m"))
    of = of.filter("(target > base and target <= end) or n = 0")
    shift = F.col("halo") - F.col("base")

    def best(at: Column, size: Column, otherwise: Column) -> Column:
        window = _sub(F.col("content"), at + shift, size)
        return F.when(F.col("is_table"), _last(window, TABLE_LEVELS, otherwise)).otherwise(_last(window, TEXT_LEVELS, otherwise))

    cut = of.withColumn("cut", F.when(F.col("k") == F.col("m"), n).otherwise(F.col("target") - F.col("w") + best(F.col("target") - F.col("w"), F.col("w"), F.col("w"))))
    cut = cut.withColumn("last", F.when(F.col("k") == 1, 0).otherwise(F.col("before") - F.col("w") + best(F.col("before") - F.col("w"), F.col("w"), F.col("w"))))
    around = F.greatest(F.col("last") - F.col("o") - F.col("tol"), F.lit(0))
    start = F.when((F.col("k") == 1) | (F.col("o") <= 0), F.col("last")).otherwise(around + best(around, 2 * F.col("tol"), F.col("tol")))
    return cut.withColumn("from", F.least(start, F.col("last"))).select(
        *keys,
        (F.col("k") - 1).cast("int").alias("piece"),
        F.col("m").cast("int").alias("n_pieces"),
        F.col("from").cast("bigint").alias("piece_start"),
        F.col("cut").cast("bigint").alias("piece_end"),
        _sub(F.col("content"), F.col("from") + shift, F.col("cut") - F.col("from")).alias("piece_text"),
    )


def split_texts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of the rows of ``items``: keys, text, is_table, max_chars (null: no limit), overlap_chars. No shuffle."""
    start = items.filter("text is not null").select(
        *keys,
        "is_table",
        F.col("max_chars").cast("bigint").alias("max_chars"),
        F.coalesce(F.col("overlap_chars"), F.lit(0)).cast("bigint").alias("overlap_chars"),
        F.length("text").cast("bigint").alias("n"),
        F.col("text").alias("content"),
        F.lit(0).cast("bigint").alias("base"),
        F.lit(0).cast("bigint").alias("halo"),
    )
    return _pieces(_ranges(_ranges(start, OUTER), INNER), keys)


def split_files(spark: SparkSession, paths: list[str], max_chars: int, overlap_chars: int, range_bytes: int = 1 << 22, is_table: bool = False) -> DataFrame:
    """Pieces of UTF-8 files (absolute paths or URIs) on a file system all workers share, read by byte ranges; no worker holds a file.

    A first pass counts the code points of each range, a prefix sum per file
    stitches them, a second pass reads each range with its halo and cuts it.
    """
    sizes = [(p, _opened(p).size()) for p in paths]
    files = spark.createDataFrame(sizes, "path string, bytes bigint")
    spans = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))).alias("at"))
    spans = spans.repartition(max(1, min(spans.count(), 4096)), "path", "at")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            count = []
            for path, at in zip(frame["path"], frame["at"]):
                with _opened(path) as f:
                    data = f.read_at(min(range_bytes, f.size() - at), at) if f.size() > at else b""
                count.append(len(data) - _continuations(data))
            yield frame.assign(points=count)

    by_path = Window.partitionBy("path").orderBy("at")
    stitched = (
        spans.mapInPandas(counted, "path string, bytes bigint, at bigint, points bigint")
        .withColumn("base", F.coalesce(F.sum("points").over(by_path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n", F.sum("points").over(Window.partitionBy("path")))
    )

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content, halo = [], []
            for path, at in zip(frame["path"], frame["at"]):
                first = max(0, at - 4 * max_chars - 4)
                with _opened(path) as f:
                    data = f.read_at(min(at - first + range_bytes + 4, f.size() - first), first) if f.size() > first else b""
                own = at - first
                while own < len(data) and data[own] & 0xC0 == 0x80:  # a character begun before belongs there
                    own += 1
                stop = min(at - first + range_bytes, len(data))
                while stop < len(data) and data[stop] & 0xC0 == 0x80:
                    stop += 1
                before = data[:own].decode("utf-8", "ignore")[-max_chars:]
                content.append(before + data[own:stop].decode("utf-8", "ignore"))
                halo.append(len(before))
            yield frame[["path", "n", "base"]].assign(content=content, halo=halo)

    ranges = stitched.mapInPandas(read, "path string, n bigint, base bigint, content string, halo bigint").select(
        "path", "n", "base", "content", "halo", F.lit(is_table).alias("is_table"), F.lit(max_chars).cast("bigint").alias("max_chars"), F.lit(overlap_chars).cast("bigint").alias("overlap_chars")
    )
    return _pieces(_ranges(ranges, INNER), ["path"])


def _opened(path: str):
    """A file of any file system that a path or URI can name, open for reads at a place."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _continuations(data: bytes) -> int:
    """Bytes that continue a character, so that a range's other bytes are its code points."""
    return int(((np.frombuffer(data, np.uint8) & 0xC0) == 0x80).sum())


def block_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by their type and tables by their markdown, with the limits of chunk_limits; one row per block_key."""
    blocks = distinct_rows(table(spark, sf_dir, "raw_blocks").select("block_key", "type", "text", "ingested_at"), ["block_key"]).filter("type is null or type <> 'table'")
    tables = distinct_rows(table(spark, sf_dir, "raw_tables").select("block_key", "markdown", "ingested_at"), ["block_key"])
    items = blocks.select("block_key", "type", "text").unionByName(tables.select("block_key", F.lit("table").alias("type"), F.col("markdown").alias("text")))
    # four rows, a fixed table; a type named twice has its smaller limit
    limits = table(spark, sf_dir, "chunk_limits").groupBy(F.col("block_type").alias("type")).agg(F.min("max_chars").alias("max_chars"), F.min_by("overlap_chars", "max_chars").alias("overlap_chars"))
    return items.join(F.broadcast(limits), "type", "left").withColumn("is_table", F.coalesce(F.col("type") == "table", F.lit(False)))
