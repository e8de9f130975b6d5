"""Lines and blocks from glyphs, for documents with a text layer and no layout model."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import strip

#: Fixed: distance of centres within a line, gap that is a space, gap that ends a block, height of the bands,
#: longest text of a running line, size of a heading against the body's.
LINE, SPACE, BLOCK, EDGE, RUNNING, HEADING = 0.4, 0.45, 0.75, 0.07, 60, 1.15
PAGE = ["doc_id", "page_number"]


def group_lines(glyphs: DataFrame) -> DataFrame:
    """The glyphs with line_no: a new line where the centre leaves that of the line's first glyph.

    The first glyph stands for the line, not the one before, so this is a fold
    over a page's inked glyphs in order; a page is the group.  A space belongs to
    the first line whose box it stands in; other blanks belong to none.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(cy=(page["y0"] + page["y1"]) / 2)
        ink = page[[bool(c.strip()) for c in page["char"]]].sort_values(["cy", "x0", "ord"], kind="stable")
        numbers, first = [], 0.0
        for cy, size in zip(ink["cy"], ink["font_size"]):
            if not numbers or abs(cy - first) > LINE * max(size, 1.0):
                numbers.append(numbers[-1] + 1 if numbers else 0)
                first = cy
            else:
                numbers.append(numbers[-1])
        ink = ink.assign(line_no=numbers)
        boxes = ink.groupby("line_no").agg(x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"))
        spaces = page[page["char"] == " "]
        of = []
        for x, y in zip(spaces["x0"], spaces["y0"]):
            at = boxes.index[(boxes["y0"] - 1.0 <= y) & (y <= boxes["y1"] + 1.0) & (boxes["x0"] <= x) & (x <= boxes["x1"])]
            of.append(at[0] if len(at) else -1)
        spaces = spaces.assign(line_no=of)
        return pd.concat([ink, spaces[spaces["line_no"] >= 0]])[[*columns, "line_no"]]

    columns = glyphs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in glyphs.dtypes) + ", line_no int"
    return glyphs.filter("char is not null and y0 is not null and y1 is not null and x0 is not null").groupBy(*PAGE).applyInPandas(fold, schema)


def line_rows(lined: DataFrame) -> DataFrame:
    """PAGE, line_no, text, font_size (the mode, ties to the larger), box and glyphs of each line.

    The text's own spaces are kept; one is added only between two inked glyphs
    whose gap is wide against the size of the one before.
    """
    blank = F.col("char") == " "
    cy = (F.col("y0") + F.col("y1")) / 2
    order = Window.partitionBy(*PAGE, "line_no").orderBy("x0", blank, cy, "ord")
    before = F.lag(F.struct("x1", "font_size", blank.alias("blank"))).over(order)
    wide = ~blank & ~before["blank"] & (F.col("x0") - before["x1"] > SPACE * F.greatest(before["font_size"], F.lit(1.0)))
    spaced = lined.withColumn("_piece", F.when(wide, F.concat(F.lit(" "), "char")).otherwise(F.col("char"))).withColumn("_k", F.row_number().over(order))
    inked = lined.filter(~blank)
    sizes = inked.groupBy(*PAGE, "line_no", "font_size").count().groupBy(*PAGE, "line_no").agg(F.max_by("font_size", F.struct("count", "font_size")).alias("font_size"))
    boxes = inked.groupBy(*PAGE, "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_glyphs"))
    texts = spaced.groupBy(*PAGE, "line_no").agg(strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_piece"))), lambda x: x["_piece"]), "")).alias("text"))
    return texts.join(boxes, [*PAGE, "line_no"]).join(sizes, [*PAGE, "line_no"])


def body_size(lines: DataFrame) -> DataFrame:
    """PAGE and body_size: the median of the lines' sizes, each weighing as much as its text is long."""
    weighed = lines.select(*PAGE, "font_size", F.greatest(F.length("text"), F.lit(1)).alias("n"))
    return weighed.groupBy(*PAGE).agg(F.expr("percentile(font_size, 0.5, n)").alias("body_size"))


def classify(text: Column, y0: Column, y1: Column, size: Column, height: Column, body: Column) -> Column:
    """Running lines by place and length, headings by size, else text."""
    centre = (y0 + y1) / 2
    short = F.length(text) <= RUNNING
    return F.when(short & (centre <= EDGE * height), "page_header").when(short & (centre >= (1 - EDGE) * height), "page_footer").when((body > 0) & (size >= HEADING * body), "section_header").otherwise("text")


def merge_blocks(lines: DataFrame) -> DataFrame:
    """PAGE, block_no, type, text, font_size, is_bold and box: text lines that follow each other closely are one block.

    ``lines`` has PAGE, line_no, type, text, font_size and box; any other type
    stands alone, blank lines count for nothing.
    """
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    before = F.lag(F.struct("type", "y1", "font_size")).over(order)
    near = (F.col("type") == "text") & (before["type"] == "text") & (F.col("y0") - before["y1"] <= BLOCK * F.greatest(before["font_size"], F.lit(1.0)))
    inked = lines.filter(strip(F.col("text")) != "")
    islands = inked.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("block_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    blocks = islands.groupBy(*PAGE, "block_no").agg(
        F.min_by("type", "line_no").alias("type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_lines"),
        F.round(F.median("font_size"), 2).alias("font_size"), *[F.round(f(c), 2).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    return blocks.withColumn("is_bold", F.col("type") == "section_header")


def build_blocks(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of pages from their glyphs; pages without any have none."""
    lines = line_rows(group_lines(glyphs))
    sized = lines.join(body_size(lines), PAGE).join(pages.select(*PAGE, "height"), PAGE)
    return merge_blocks(sized.withColumn("type", classify(F.col("text"), F.col("y0"), F.col("y1"), F.col("font_size"), F.col("height"), F.col("body_size"))))


def failed_pages(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """The pages with extraction_source failed where there is no glyph, and a warning."""
    inked = glyphs.select(*PAGE).distinct().withColumn("_g", F.lit(True))
    joined = pages.drop("extraction_source").join(inked, PAGE, "left")
    return joined.withColumn("extraction_source", F.when(F.col("_g"), "text_layer").otherwise("failed")).withColumn("warning", F.when(F.col("_g").isNull(), "SCANNED_PAGE_OCR_FALLBACK")).drop("_g")
