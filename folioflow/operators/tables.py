"""Tables from raw cells: grids, flattened headers, markdown, lookups, values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.finance import parse_values
from folioflow.functions.text import strip

KEYS = ["doc_id", "page_number", "block_ord"]


def grid(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """KEYS, row_idx, col_idx and text for every place of every table; places no cell starts at are empty.

    Of cells at one place the last wins; cells outside the table are dropped.
    """
    row, col = F.col("row_idx"), F.col("col_idx")
    text = cells.groupBy(*KEYS, "row_idx", "col_idx").agg(F.max_by(strip(F.coalesce("text", F.lit(""))), "cell_ord").alias("text"))
    sized = tables.filter("n_rows > 0 and n_cols > 0")
    rows = sized.select(*KEYS, "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_idx"))
    places = rows.select(*KEYS, row, F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_idx"))
    return places.join(text, [*KEYS, "row_idx", "col_idx"], "left").select(*KEYS, row, col, F.coalesce("text", F.lit("")).alias("text"))


def _joined(order: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct(F.col(order), F.col("text")))))
    return F.array_join(F.transform(pairs, lambda x: x["text"]), " ")


def column_headers(tables: DataFrame, dense: DataFrame) -> DataFrame:
    """KEYS, col_idx and label: the header rows' texts of each column, the first row's if there are none."""
    used = F.greatest(F.coalesce("header_rows", F.lit(0)), F.lit(1))
    head = dense.join(tables.select(*KEYS, used.alias("h")), KEYS).filter("row_idx < h")
    return head.groupBy(*KEYS, "col_idx").agg(_joined("row_idx").alias("label"))


def row_headers(tables: DataFrame, dense: DataFrame) -> DataFrame:
    """KEYS, row_idx and label of each body row: the texts of its header columns, the first column's if there are none."""
    used = tables.select(*KEYS, F.greatest(F.coalesce("header_cols", F.lit(0)), F.lit(1)).alias("h"), F.coalesce("header_rows", F.lit(0)).alias("from_row"))
    head = dense.join(used, KEYS).filter("row_idx >= from_row and col_idx < h")
    return head.groupBy(*KEYS, "row_idx").agg(_joined("col_idx").alias("label"))


def markdown(tables: DataFrame, dense: DataFrame) -> DataFrame:
    """KEYS and the table as markdown; without header rows the header line is blank."""
    cell = F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    lines = dense.groupBy(*KEYS, "row_idx").agg(F.sort_array(F.collect_list(F.struct("col_idx", cell.alias("t")))).alias("cs"))
    lines = lines.select(*KEYS, "row_idx", F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda c: c["t"]), " | "), F.lit(" |")).alias("line"))
    sheets = lines.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("row_idx", "line"))).alias("ls"))
    heads = tables.select(*KEYS, "n_cols", F.coalesce("header_rows", F.lit(0)).alias("h"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n_cols")), " | "), F.lit(" |"))
    blank = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(""), F.col("n_cols")), " | "), F.lit(" |"))
    text = F.transform("ls", lambda x: x["line"])
    head = F.when(F.col("h") > 0, F.slice(text, F.lit(1), F.col("h"))).otherwise(F.array(blank))
    body = F.slice(text, F.col("h") + 1, F.greatest(F.size("ls") - F.col("h"), F.lit(0)))
    return sheets.join(heads, KEYS).select(*KEYS, F.array_join(F.concat(head, F.array(rule), body), "\n").alias("markdown"))


def cell_at(cells: DataFrame, points: DataFrame) -> DataFrame:
    """The points (KEYS, r, c) with the cell whose span holds them, the first if several do."""
    inside = "row_idx <= r and r < row_idx + row_span and col_idx <= c and c < col_idx + col_span"
    hits = points.join(cells, KEYS).filter(inside).groupBy(*KEYS, "r", "c").agg(F.min_by("cell_key", "cell_ord").alias("cell_key"))
    return points.join(hits, [*KEYS, "r", "c"], "left")


def label_lookup(rows: DataFrame, columns: DataFrame, dense: DataFrame) -> DataFrame:
    """KEYS, row_label, col_label and text: each figure by its two labels, the first place a pair of labels has."""
    first_row = rows.groupBy(*KEYS, "label").agg(F.min("row_idx").alias("row_idx")).withColumnRenamed("label", "row_label")
    first_col = columns.filter("col_idx > 0").groupBy(*KEYS, "label").agg(F.min("col_idx").alias("col_idx")).withColumnRenamed("label", "col_label")
    return dense.join(first_row, [*KEYS, "row_idx"]).join(first_col, [*KEYS, "col_idx"]).select(*KEYS, "row_label", "col_label", "text")


def cell_values(cells: DataFrame, units: DataFrame) -> DataFrame:
    """The cells with their value under the table's scale and currency (KEYS, scale, currency); null for headers."""
    joined = cells.join(units.select(*KEYS, F.col("scale").alias("_s"), F.col("currency").alias("_c")), KEYS, "left")
    return parse_values(joined, F.when(~F.coalesce("is_header", F.lit(False)), F.col("text")), F.col("_s"), F.col("_c")).drop("_s", "_c")


def scale_sources(tables: DataFrame, cells: DataFrame, ordered: DataFrame, window: int = 5) -> DataFrame:
    """KEYS, source, src_ord and text of everything a table's magnitude can be declared in.

    Captions; header cells, then flattened column labels; cells of the first
    column; and up to ``window`` blocks before the table in reading order,
    nearest first, blanks using up the window.
    """
    none = F.coalesce("is_header", F.lit(False))
    dense = grid(tables, cells)
    captions = tables.filter(strip(F.coalesce("caption", F.lit(""))) != "").select(*KEYS, F.lit("caption").alias("source"), F.lit(0).alias("src_ord"), F.col("caption").alias("text"))
    headers = cells.filter(none).select(*KEYS, F.lit("header").alias("source"), F.col("cell_ord").alias("src_ord"), "text")
    labels = column_headers(tables, dense).select(*KEYS, F.lit("header").alias("source"), (F.col("col_idx") + 1_000_000).alias("src_ord"), F.col("label").alias("text"))
    stems = cells.filter("col_idx = 0").select(*KEYS, F.lit("row_stem").alias("source"), F.col("cell_ord").alias("src_ord"), "text")
    at = ordered.filter("type = 'table'").select(*KEYS, F.col("emit_index").alias("at"))
    near = at.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(window)))).withColumn("emit_index", F.col("at") - F.col("offset"))
    said = ordered.select("doc_id", "page_number", "emit_index", "text")
    before = near.join(said, ["doc_id", "page_number", "emit_index"]).select(*KEYS, F.lit("preceding_text").alias("source"), F.col("offset").alias("src_ord"), "text")
    return captions.unionByName(headers).unionByName(labels).unionByName(stems).unionByName(before).filter(strip(F.coalesce("text", F.lit(""))) != "")


def body_texts(cells: DataFrame) -> DataFrame:
    """KEYS, source (body_cell), src_ord and text of the cells beside the headers and the first column."""
    body = cells.filter(~F.coalesce("is_header", F.lit(False)) & (F.col("col_idx") > 0) & (strip(F.coalesce("text", F.lit(""))) != ""))
    return body.select(*KEYS, F.lit("body_cell").alias("source"), F.col("cell_ord").alias("src_ord"), "text")
