"""Projections from a layout model's output to the raw layer: labels, boxes, spans, header extents, page sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import strip

#: Fixed: labels of a layout model and their block types; any other is text.
LABELS = {
    "title": "title", "section_header": "section_header", "text": "text", "paragraph": "text", "reference": "text", "code": "text", "list_item": "list_item", "table": "table",
    "document_index": "table", "caption": "caption", "footnote": "footnote", "picture": "figure", "chart": "figure", "formula": "formula", "page_header": "page_header", "page_footer": "page_footer",
}


def map_label(label: Column) -> Column:
    """The block type of a label, whatever its case; text for an unknown or missing one."""
    pairs = [F.lit(x) for pair in LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(label)), F.lit("text"))


def is_bottom_left(origin: Column) -> Column:
    """Whether a coordinate origin is at the bottom; a missing one is at the top."""
    return F.coalesce(F.startswith(F.upper(origin), F.lit("BOTTOM")), F.lit(False))


def to_box(left: Column, top: Column, right: Column, bottom: Column, origin: Column, source_height: Column, scale_x: Column, scale_y: Column) -> Column:
    """A box in points from the top left: flipped in its own space, then scaled, corners ordered, rounded; null if unusable."""
    flip = is_bottom_left(origin)
    y_a = F.when(flip, source_height - top).otherwise(top) * scale_y
    y_b = F.when(flip, source_height - bottom).otherwise(bottom) * scale_y
    x_a, x_b = left * scale_x, right * scale_x
    usable = left.isNotNull() & top.isNotNull() & right.isNotNull() & bottom.isNotNull()
    box = F.struct(F.round(F.least(x_a, x_b), 2).alias("x0"), F.round(F.least(y_a, y_b), 2).alias("y0"), F.round(F.greatest(x_a, x_b), 2).alias("x1"), F.round(F.greatest(y_a, y_b), 2).alias("y1"))
    return F.when(usable, box)


def page_scale(pdf_size: Column, model_size: Column) -> Column:
    """The factor from a model's page size to the document's, 1 where either is missing or not positive."""
    return F.when((pdf_size > 0) & (model_size > 0), pdf_size / model_size).otherwise(1.0)


def span(start: Column, end: Column, stated: Column) -> Column:
    """Cells spanned: by offsets if they are in order, else as stated, else one."""
    return F.when(end - start > 0, end - start).when(stated > 0, stated).otherwise(1)


def header_extent(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, header_rows and header_cols: the leading rows (columns) in which every cell that starts there is a header."""
    flag = F.coalesce("is_header", F.lit(False))
    by_row = cells.groupBy(*keys, F.col("row_idx").alias("n")).agg(F.every(flag).alias("all"))
    by_col = cells.groupBy(*keys, F.col("col_idx").alias("n")).agg(F.every(flag).alias("all"))

    def leading(flags: DataFrame, size: str, name: str) -> DataFrame:
        every = tables.filter(F.col(size) > 0).select(*keys, F.explode(F.sequence(F.lit(0), F.col(size))).alias("n"))
        # the place after the last one always ends the run
        joined = every.join(flags, [*keys, "n"], "left").filter(~F.coalesce("all", F.lit(False)))
        return joined.groupBy(*keys).agg(F.min("n").alias(name))

    rows, cols = leading(by_row, "n_rows", "header_rows"), leading(by_col, "n_cols", "header_cols")
    sized = tables.select(*keys, "n_rows", "n_cols")
    out = sized.join(rows, keys, "left").join(cols, keys, "left")
    return out.select(*keys, F.least(F.coalesce("header_rows", F.lit(0)), "n_rows").alias("header_rows"), F.least(F.coalesce("header_cols", F.lit(0)), "n_cols").alias("header_cols"))


def table_size(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows and n_cols from the largest end offsets of the cells, for grids that state none."""
    ends = cells.select(*keys, (F.col("row_idx") + F.greatest("row_span", F.lit(1))).alias("r"), (F.col("col_idx") + F.greatest("col_span", F.lit(1))).alias("c"))
    return ends.groupBy(*keys).agg(F.max("r").alias("n_rows"), F.max("c").alias("n_cols"))


def page_sources(pages: DataFrame, blocks: DataFrame, glyphs: DataFrame, force_ocr: bool = False, ocr_enabled: bool = True) -> DataFrame:
    """The pages with extraction_source and the warnings of how it came about.

    Every page of the document is kept, also those the model dropped.
    """
    inked = glyphs.groupBy("doc_id", "page_number").agg(F.count("*").alias("_glyphs"))
    held = blocks.groupBy("doc_id", "page_number").agg(F.count("*").alias("_blocks"))
    joined = pages.join(inked, ["doc_id", "page_number"], "left").join(held, ["doc_id", "page_number"], "left")
    has_text = F.coalesce("_glyphs", F.lit(0)) > 0
    source = F.when(F.lit(force_ocr), "ocr").when(has_text, "text_layer").when(F.lit(ocr_enabled), "ocr").otherwise("failed")
    named = joined.withColumn("extraction_source", source)
    empty = F.coalesce("_blocks", F.lit(0)) == 0
    warnings = F.array_compact(F.array(F.when(~has_text & ~F.lit(force_ocr) & F.lit(ocr_enabled), "SCANNED_PAGE_OCR_FALLBACK"), F.when(F.col("extraction_source") == "failed", "PAGE_EXTRACTION_FAILED"), F.when(empty & (F.col("extraction_source") != "failed"), "PAGE_EXTRACTION_FAILED")))
    return named.withColumn("warnings", warnings).drop("_glyphs", "_blocks")


def page_confidence(raw: Column) -> Column:
    """A page's confidence to four places; null if it is no number from 0 to 1."""
    return F.when(raw.between(0, 1) & ~F.isnan(raw), F.round(raw, 4))


def low_confidence(confidence: Column, threshold: float = 0.75) -> Column:
    """Whether a measured confidence is below the threshold."""
    return F.coalesce(confidence < threshold, F.lit(False))


def unplaced_warning(items: DataFrame) -> DataFrame:
    """One warning per document that counts the items without a page; documents without any have none."""
    lost = items.filter("page_number is null or page_number <= 0").groupBy("doc_id").agg(F.count("*").alias("n"))
    return lost.select("doc_id", F.lit("PAGE_EXTRACTION_FAILED").alias("code"), F.concat(F.col("n").cast("string"), F.lit(" items without a page")).alias("message"), F.lit(None).cast("int").alias("page"))


def measured(blocks: DataFrame, fonts: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks with fonts measured from glyphs where there are any; tables keep theirs."""
    probe = fonts.select(*keys, F.col("font_size").alias("_size"), F.col("is_bold").alias("_bold"), F.col("n_glyphs").alias("_n"))
    use = (F.col("type") != "table") & (F.coalesce("_n", F.lit(0)) > 0)
    joined = blocks.join(probe, keys, "left")
    return joined.withColumn("font_size", F.when(use, F.col("_size")).otherwise(F.col("font_size"))).withColumn("is_bold", F.when(use, F.col("_bold")).otherwise(F.col("is_bold"))).drop("_size", "_bold", "_n")


#: Fixed: conditions a finished document may warn of; a backend's other codes are dropped.
WARNINGS = ("SCANNED_PAGE_OCR_FALLBACK", "PAGE_EXTRACTION_FAILED", "LOW_OCR_CONFIDENCE", "TABLE_STRUCTURE_UNCERTAIN", "NO_HEADINGS_DETECTED")


def known_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.filter(F.col("code").isin(*WARNINGS))


def caption(text: Column) -> Column:
    """A caption without white space around it, null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def raw_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of a model's grid that have a place, in order of it: keys, cell_no, cell_ord, row_idx, col_idx, text, spans, is_header.

    ``cells`` has start and end offsets, the spans stated, and whether a cell
    heads its column or its row.
    """
    order = Window.partitionBy(*keys).orderBy("row_idx", "col_idx", "cell_ord")
    placed = cells.filter("row_idx is not null and col_idx is not null").withColumn("cell_no", F.row_number().over(order) - 1)
    header = F.coalesce("column_header", F.lit(False)) | F.coalesce("row_header", F.lit(False))
    return placed.select(
        *keys, "cell_no", "cell_ord", "row_idx", "col_idx", F.coalesce("text", F.lit("")).alias("text"), span(F.col("row_idx"), F.col("row_end"), F.col("row_span")).alias("row_span"),
        span(F.col("col_idx"), F.col("col_end"), F.col("col_span")).alias("col_span"), header.alias("is_header"),
    )


def raw_tables(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, n_cols and caption; a grid that states no size has that of its cells' ends."""
    ends = cells.groupBy(*keys).agg(F.max("row_end").alias("_r"), F.max("col_end").alias("_c"))
    unstated = (F.coalesce("n_rows", F.lit(0)) == 0) | (F.coalesce("n_cols", F.lit(0)) == 0)
    sized = tables.join(ends, keys, "left")
    rows, cols = (F.when(unstated, F.coalesce(e, F.lit(0))).otherwise(F.col(n)) for e, n in (("_r", "n_rows"), ("_c", "n_cols")))
    return sized.select(*keys, rows.alias("n_rows"), cols.alias("n_cols"), caption(F.col("caption")).alias("caption"))


def walk_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings) of a model's items: doc_id, page_number, item_ord, label, text, has_grid, n_rows, n_cols.

    Items without a page become one warning a document; an item with a grid is a
    table without text, warned of if it has no rows or columns; other items
    without text are dropped unless they are figures.
    """
    paged = items.filter("page_number > 0")
    grid = F.coalesce("has_grid", F.lit(False))
    kind = F.when(grid, "table").otherwise(map_label(F.col("label")))
    text = F.when(grid, "").otherwise(strip(F.coalesce("text", F.lit(""))))
    typed = paged.withColumn("type", kind).withColumn("text", text)
    blocks = typed.filter("type in ('table', 'figure') or text <> ''").select("doc_id", "page_number", "item_ord", "type", "text")
    empty = typed.filter(grid & ((F.coalesce("n_rows", F.lit(0)) == 0) | (F.coalesce("n_cols", F.lit(0)) == 0)))
    uncertain = empty.select("doc_id", F.lit("TABLE_STRUCTURE_UNCERTAIN").alias("code"), F.lit("a table without rows or columns").alias("message"), F.col("page_number").alias("page"))
    return blocks, unplaced_warning(items).unionByName(uncertain)
