"""Running values along a document without gathering it: windows over pages, then over one small row a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_number"]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their number within the document, from 0, by page and ``order``."""
    on_page = Window.partitionBy(*PAGE).orderBy(*order)
    earlier = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    pages = df.groupBy(*PAGE).count().withColumn("_base", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    own = df.withColumn("_own", F.row_number().over(on_page) - 1)
    return own.join(pages, PAGE).withColumn(name, (F.col("_own") + F.col("_base")).cast("int")).drop("_own", "_base")


def latest(df: DataFrame, order: str, values: dict[str, Column], itself: bool = False, following: bool = False) -> DataFrame:
    """The rows with the last non-null of each of ``values`` before them in the document, by page and ``order``.

    ``itself`` counts the row's own value too; ``following`` looks for the first
    one after the row instead.
    """
    if not values:
        return df
    place, page = (F.desc(order), F.desc("page_number")) if following else (F.col(order), F.col("page_number"))
    on_page = Window.partitionBy(*PAGE).orderBy(place).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    other_pages = Window.partitionBy("doc_id").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if following else F.max_by
    lasts = df.groupBy(*PAGE).agg(*[pick(v, F.when(v.isNotNull(), F.col(order))).alias(f"_{n}") for n, v in values.items()])
    carried = lasts.select(*PAGE, *[F.last(f"_{n}", ignorenulls=True).over(other_pages).alias(f"_{n}") for n in values])
    own = df.select("*", *[F.last(v, ignorenulls=True).over(on_page).alias(n) for n, v in values.items()])
    joined = own.join(carried, PAGE)
    return joined.withColumns({n: F.coalesce(n, f"_{n}") for n in values}).drop(*[f"_{n}" for n in values])
