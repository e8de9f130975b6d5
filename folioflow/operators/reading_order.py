"""Reading order within a page: columns detected by geometry, then a sort with computed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: widest share of a column block, least blocks for columns, least share of blocks on a side.
WIDEST, LEAST_BLOCKS, LEAST_SIDE = 0.6, 4, 0.25
FURNITURE = ("page_header", "page_footer")


def column_counts(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number and columns (1 or 2) of each page, from one aggregate over its body blocks."""
    body = blocks.filter(~F.col("type").isin(*FURNITURE)).join(pages.select("doc_id", "page_number", "width"), ["doc_id", "page_number"])
    box, width = F.col("bbox"), F.col("width")
    counts = (width > 0) & box.isNotNull() & ((box["x1"] - box["x0"]) <= WIDEST * width)
    left = counts & ((box["x0"] + box["x1"]) / 2 < width / 2)
    right = counts & ~left
    sums = body.groupBy("doc_id", "page_number").agg(
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.max(F.when(left, box["x1"])).alias("left_end"), F.min(F.when(right, box["x0"])).alias("right_start")
    )
    total = F.col("n_left") + F.col("n_right")
    two = (total >= LEAST_BLOCKS) & (F.col("n_left") >= LEAST_SIDE * total) & (F.col("n_right") >= LEAST_SIDE * total) & (F.col("left_end") <= F.col("right_start"))
    known = sums.select("doc_id", "page_number", F.when(two, 2).otherwise(1).alias("columns"))
    return pages.select("doc_id", "page_number").join(known, ["doc_id", "page_number"], "left").withColumn("columns", F.coalesce("columns", F.lit(1)))


def order_blocks(blocks: DataFrame, pages: DataFrame, rtl: bool = False) -> DataFrame:
    """The blocks with order_index, block_id and columns: the body in reading order, then furniture as it came.

    order_index is null for furniture.  Blocks without a box come first, ties
    keep their order.
    """
    placed = blocks.join(pages.select("doc_id", "page_number", "width"), ["doc_id", "page_number"], "left").join(column_counts(blocks, pages), ["doc_id", "page_number"], "left")
    box, width = F.col("bbox"), F.col("width")
    centre = F.coalesce((box["x0"] + box["x1"]) / 2, F.lit(0.0))
    side = F.when(centre < width / 2, 0).otherwise(1)
    side = 1 - side if rtl else side
    wide = (box["x1"] - box["x0"]) > WIDEST * width
    column = F.when(F.coalesce(F.col("columns"), F.lit(1)) < 2, 0).when(box.isNull() | wide, 0).otherwise(side)
    furniture = F.col("type").isin(*FURNITURE)
    keyed = placed.withColumn("_f", furniture.cast("int")).withColumn("_c", F.when(furniture, 0).otherwise(column))
    keyed = keyed.withColumn("_y", F.when(furniture, 0.0).otherwise(F.coalesce(box["y0"], F.lit(0.0)))).withColumn("_x", F.when(furniture, 0.0).otherwise(centre))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("_f", "_c", "_y", "_x", "block_ord")) - 1
    out = keyed.withColumn("emit_index", rank).withColumn("block_id", F.format_string("p%04d_b%03d", "page_number", rank))
    return out.withColumn("order_index", F.when(~furniture, F.col("emit_index"))).select(*blocks.columns, "columns", "emit_index", "order_index", "block_id")


def reading_order(ordered: DataFrame) -> DataFrame:
    """doc_id, page_number and the array of body block ids in order."""
    body = ordered.filter("order_index is not null")
    return body.groupBy("doc_id", "page_number").agg(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "block_id"))), lambda x: x["block_id"]).alias("reading_order"))
