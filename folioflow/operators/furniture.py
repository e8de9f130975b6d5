"""Repeated page furniture: lines of the top or bottom band that come back on enough pages are relabelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import furniture_key, strip

#: Fixed: share of the page's height that is a band; least pages, share of pages and longest text of furniture.
BAND, LEAST_PAGES, SHARE, LONGEST = 0.12, 2, 0.25, 120


def band(y0: Column, y1: Column, height: Column) -> Column:
    """top or bottom, by the centre; null without a box or a height, or in between."""
    centre = (y0 + y1) / 2
    return F.when(height.isNull() | (height <= 0), None).when(centre <= BAND * height, "top").when(centre >= height * (1 - BAND), "bottom")


def _banded(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    heights = pages.select("doc_id", "page_number", "height")
    joined = blocks.join(heights, ["doc_id", "page_number"], "left")
    return joined.withColumn("band", band(F.col("bbox.y0"), F.col("bbox.y1"), F.col("height"))).withColumn("furniture_key", furniture_key(F.col("text")))


def find_furniture(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, band, furniture_key and n_pages of lines on at least a quarter of the pages, two at least.

    Pages without blocks count as pages; a document of one page has none.
    """
    counts = pages.groupBy("doc_id").agg(F.countDistinct("page_number").alias("doc_pages")).filter("doc_pages >= 2")
    short = _banded(blocks, pages).filter(F.col("band").isNotNull() & (strip(F.col("text")) != "") & (F.length(strip(F.col("text"))) <= LONGEST))
    # partial aggregation to distinct pages first, so a key on every page is no hot group
    once = short.select("doc_id", "band", "furniture_key", "page_number").distinct()
    found = once.groupBy("doc_id", "band", "furniture_key").agg(F.count("*").alias("n_pages"))
    return found.join(counts, "doc_id").filter(F.col("n_pages") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(SHARE * F.col("doc_pages")))).drop("doc_pages")


def reclassify(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The blocks with furniture typed page_header or page_footer by band; tables never change."""
    keys = find_furniture(blocks, pages).select("doc_id", "band", "furniture_key", F.lit(True).alias("repeats"))
    marked = _banded(blocks, pages).join(keys, ["doc_id", "band", "furniture_key"], "left")
    changes = F.col("repeats") & ~F.col("type").isin("page_header", "page_footer", "table")
    new = F.when(changes & (F.col("band") == "top"), "page_header").when(changes, "page_footer").otherwise(F.col("type"))
    return marked.withColumn("type", new).select(*blocks.columns)
