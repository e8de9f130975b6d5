"""Fonts of blocks, measured from the glyphs inside them: a bucketed spatial join and a mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: height of a bucket of glyphs, growth of a box, share of bold glyphs of a bold block, least bold weight.
BUCKET, GROWTH, BOLD_SHARE, BOLD_WEIGHT = 12.0, 1.5, 0.6, 600


def probe(boxes: DataFrame, glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, font_size, is_bold and n_glyphs of each box (doc_id, page_number, x0, y0, x1, y1).

    A glyph is in one bucket of its centre's height, a box in the few it spans,
    so the join is on equality and no pair comes twice.  The mode's ties go to
    the larger size; a box without glyphs is unmeasured.
    """
    inked = glyphs.filter(~F.col("char").rlike(r"(?U)^\s*$")).select("doc_id", "page_number", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("font_size").alias("size"), (F.col("font_weight") >= BOLD_WEIGHT).alias("bold"))
    inked = inked.withColumn("bucket", F.floor(F.col("cy") / BUCKET))
    grown = boxes.select(*keys, "doc_id", "page_number", (F.col("x0") - GROWTH).alias("gx0"), (F.col("y0") - GROWTH).alias("gy0"), (F.col("x1") + GROWTH).alias("gx1"), (F.col("y1") + GROWTH).alias("gy1")) if not {"doc_id", "page_number"} & set(keys) else boxes.select(*dict.fromkeys([*keys, "doc_id", "page_number"]), (F.col("x0") - GROWTH).alias("gx0"), (F.col("y0") - GROWTH).alias("gy0"), (F.col("x1") + GROWTH).alias("gx1"), (F.col("y1") + GROWTH).alias("gy1"))
    spans = grown.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("gy0") / BUCKET), F.floor(F.col("gy1") / BUCKET))))
    hits = spans.join(inked, ["doc_id", "page_number", "bucket"]).filter("cx between gx0 and gx1 and cy between gy0 and gy1")
    by_size = hits.groupBy(*keys, "size").agg(F.count("*").alias("n"), F.count_if("bold").alias("n_bold"))
    found = by_size.groupBy(*keys).agg(F.round(F.max_by("size", F.struct("n", "size")), 2).alias("font_size"), (F.sum("n_bold") >= BOLD_SHARE * F.sum("n")).alias("is_bold"), F.sum("n").alias("n_glyphs"))
    out = boxes.select(*keys).join(found, keys, "left")
    return out.select(*keys, "font_size", F.coalesce("is_bold", F.lit(False)).alias("is_bold"), F.coalesce("n_glyphs", F.lit(0)).cast("bigint").alias("n_glyphs"))
