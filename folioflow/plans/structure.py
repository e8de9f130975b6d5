"""Queries over the raw page tables: furniture, order, headings, sections, tables, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import NUMBERING, numbering_depth, strip
from folioflow.operators import assemble, furniture, headings, mapping, reading_order, report, scale, tables
from folioflow.session import saved

K = tables.KEYS
# SQL -------------------------------------------------------------------------
#: White space and digits of any script, as the SQL engine's patterns write them.
WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


_RAW = """
    pages AS (SELECT DISTINCT ON (doc_id, page_number) * EXCLUDE (ingested_at) FROM raw_pages),
    blocks AS (SELECT DISTINCT ON (block_key) * EXCLUDE (ingested_at) FROM raw_blocks),
    tabs AS (SELECT DISTINCT ON (block_key) * EXCLUDE (ingested_at) FROM raw_tables),
    cells AS (SELECT DISTINCT ON (cell_key) * EXCLUDE (ingested_at) FROM raw_cells)"""
_FURNITURE = rf"""{_RAW},
    banded AS (
        SELECT b.*, height, CASE WHEN height <= 0 THEN NULL WHEN (bbox.y0 + bbox.y1) / 2 <= 0.12 * height THEN 'top' WHEN (bbox.y0 + bbox.y1) / 2 >= height * (1 - 0.12) THEN 'bottom' END AS band,
            replace(lower(trim(regexp_replace(regexp_replace(text, '\p{{Nd}}+', '#', 'g'), '{WS}+', ' ', 'g'))), 'ß', 'ss') AS furniture_key, {_strip("text")} AS bare
        FROM blocks b LEFT JOIN pages USING (doc_id, page_number)
    ), furniture AS (
        SELECT doc_id, band, furniture_key, count(DISTINCT page_number) AS n_pages
        FROM banded JOIN (SELECT doc_id, count(DISTINCT page_number) AS n FROM pages GROUP BY doc_id) c USING (doc_id)
        WHERE band IS NOT NULL AND bare <> '' AND length(bare) <= 120 AND n >= 2 GROUP BY doc_id, band, furniture_key, n HAVING count(DISTINCT page_number) >= greatest(2, ceil(0.25 * n))
    )"""
_RELABELLED = f"""{_FURNITURE},
    relabelled AS (
        SELECT b.* EXCLUDE (type), CASE WHEN f.n_pages IS NOT NULL AND type NOT IN ('page_header', 'page_footer', 'table') THEN CASE b.band WHEN 'top' THEN 'page_header' ELSE 'page_footer' END ELSE type END AS type
        FROM banded b LEFT JOIN furniture f ON b.doc_id = f.doc_id AND b.band = f.band AND b.furniture_key = f.furniture_key
    )"""


def _order_sql(rtl: bool) -> str:
    side = "1 - " if rtl else ""
    return f"""{_RELABELLED},
    sided AS (
        SELECT r.*, width, type IN ('page_header', 'page_footer') AS furn, (bbox.x0 + bbox.x1) / 2 AS cx, bbox.x1 - bbox.x0 > 0.6 * width AS wide FROM relabelled r LEFT JOIN (SELECT doc_id, page_number, width FROM pages) USING (doc_id, page_number)
    ), counted AS (
        SELECT doc_id, page_number, count(*) FILTER (cx < width / 2) AS l, count(*) FILTER (cx >= width / 2) AS r, max(bbox.x1) FILTER (cx < width / 2) AS le, min(bbox.x0) FILTER (cx >= width / 2) AS rs
        FROM sided WHERE NOT furn AND bbox IS NOT NULL AND NOT wide AND width > 0 GROUP BY doc_id, page_number
    ), columns_of AS (
        SELECT doc_id, page_number, CASE WHEN l + r >= 4 AND l >= 0.25 * (l + r) AND r >= 0.25 * (l + r) AND le <= rs THEN 2 ELSE 1 END AS columns FROM pages LEFT JOIN counted USING (doc_id, page_number)
    ), ordered AS (
        SELECT s.*, columns, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY furn,
            CASE WHEN furn OR columns < 2 OR bbox IS NULL OR wide THEN 0 ELSE {side}(CASE WHEN cx < width / 2 THEN 0 ELSE 1 END) END,
            CASE WHEN furn THEN 0 ELSE coalesce(bbox.y0, 0) END, CASE WHEN furn THEN 0 ELSE coalesce(cx, 0) END, block_ord) - 1 AS emit_index
        FROM sided s LEFT JOIN columns_of USING (doc_id, page_number)
    ), placed AS (SELECT *, CASE WHEN NOT furn THEN emit_index END AS order_index, format('p{{:04d}}_b{{:03d}}', page_number, emit_index) AS block_id FROM ordered)"""


_ORDERED = _order_sql(False)
_DEPTH = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)^{WS}*" + pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", WS) + f"') THEN {depth}" for pattern, depth in NUMBERING) + " END"
_HEADS = f"""{_ORDERED},
    heads AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, emit_index) - 1 AS i, {_DEPTH} AS depth FROM placed
        WHERE type IN ('title', 'section_header') AND {_strip("text")} <> ''
    ), sizes AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS k FROM (SELECT DISTINCT doc_id, font_size FROM heads WHERE font_size IS NOT NULL)),
    ranks AS (
        SELECT doc_id, k, font_size, font_size AS rep, 1 AS size_rank FROM sizes WHERE k = 1
        UNION ALL
        SELECT s.doc_id, s.k, s.font_size, CASE WHEN r.rep - s.font_size > 0.6 THEN s.font_size ELSE r.rep END, CASE WHEN r.rep - s.font_size > 0.6 THEN r.size_rank + 1 ELSE r.size_rank END
        FROM ranks r JOIN sizes s ON s.doc_id = r.doc_id AND s.k = r.k + 1
    ), own AS (
        SELECT h.*, CASE WHEN type = 'title' THEN 1 WHEN h.font_size IS NOT NULL THEN size_rank + coalesce(depth - 1, 0) END AS own_level FROM heads h LEFT JOIN ranks r ON h.doc_id = r.doc_id AND h.font_size = r.font_size
    ), levels AS (
        SELECT *, coalesce(last_value(own_level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 1)::INT AS level FROM own
    ), parents AS (
        SELECT l.*, (SELECT max(p.i) FROM levels p WHERE p.doc_id = l.doc_id AND p.i < l.i AND p.level < l.level) AS parent FROM levels l
    ), paths AS (
        SELECT doc_id, i, {_strip("text")} AS path FROM parents WHERE parent IS NULL
        UNION ALL SELECT p.doc_id, p.i, q.path || ' > ' || {_strip("p.text")} FROM parents p JOIN paths q ON p.doc_id = q.doc_id AND p.parent = q.i
    )"""
_SECTIONED = f"""{_HEADS},
    sectioned AS (
        SELECT p.*, last_value(s.section_id IGNORE NULLS) OVER (PARTITION BY p.doc_id ORDER BY p.page_number, p.emit_index ROWS UNBOUNDED PRECEDING) AS section_id
        FROM placed p LEFT JOIN (SELECT doc_id, block_id, format('s{{:03d}}', i) AS section_id FROM levels) s ON p.doc_id = s.doc_id AND p.block_id = s.block_id
    )"""
_GRID = f"""{_RAW},
    starts AS (SELECT doc_id, page_number, block_ord, row_idx, col_idx, arg_max({_strip("coalesce(text, '')")}, cell_ord) AS text FROM cells GROUP BY ALL),
    grid AS (
        SELECT t.doc_id, t.page_number, t.block_ord, r.r::INT AS row_idx, c.c::INT AS col_idx, coalesce(s.text, '') AS text
        FROM tabs t, LATERAL (SELECT unnest(range(n_rows)) AS r) r, LATERAL (SELECT unnest(range(n_cols)) AS c) c
        LEFT JOIN starts s ON s.doc_id = t.doc_id AND s.page_number = t.page_number AND s.block_ord = t.block_ord AND s.row_idx = r.r AND s.col_idx = c.c
    )"""


# queries ---------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return assemble.raw_frames(spark, sf_dir)


def _ordered(spark: SparkSession, sf_dir: str, rtl: bool = False) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return reading_order.order_blocks(furniture.reclassify(raw["blocks"], raw["pages"]), raw["pages"], rtl)


def furniture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return furniture.find_furniture(raw["blocks"], raw["pages"])


def furniture_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return furniture.reclassify(raw["blocks"], raw["pages"]).select("block_key", "type")


def reading_order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return reading_order.column_counts(furniture.reclassify(raw["blocks"], raw["pages"]), raw["pages"])


def reading_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("block_key", F.col("emit_index").cast("bigint"), F.col("order_index").cast("bigint"), "block_id")


def reading_order_rtl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, True).select("block_key", F.col("order_index").cast("bigint"))


def reading_order_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_order.reading_order(_ordered(spark, sf_dir)).select("doc_id", "page_number", F.array_join("reading_order", ",").alias("reading_order"))


def _heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # read by several steps, of which only headings need a text
    text = F.when(F.col("type").isin(*headings.HEADINGS), F.col("text"))
    ordered = saved(_ordered(spark, sf_dir).select("block_key", "doc_id", "page_number", "block_ord", "type", text.alias("text"), "font_size", "emit_index", "order_index", "block_id"))
    return ordered, headings.assign_levels(headings.heading_rows(ordered))


def heading_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.heading_rows(_ordered(spark, sf_dir)).select("block_key", numbering_depth(F.col("text")).alias("depth"))


def heading_size_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.size_ranks(headings.heading_rows(_ordered(spark, sf_dir)))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir)[1].select("doc_id", F.col("i").cast("bigint"), "block_key", "level")


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = headings.build_sections(_heads(spark, sf_dir)[1])
    return sections.select("doc_id", "section_id", "title", "level", "parent_section_id", F.array_join("path", " > ").alias("path"), "heading_block_id", "page_start")


def section_of_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, levels = _heads(spark, sf_dir)
    return headings.section_of_blocks(ordered, headings.build_sections(levels)).select("block_key", "section_id")


def section_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, levels = _heads(spark, sf_dir)
    sections = headings.build_sections(levels)
    return headings.section_pages(sections, headings.section_of_blocks(ordered, sections)).select("doc_id", "section_id", "page_start", "page_end")


def no_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, levels = _heads(spark, sf_dir)
    return headings.without_headings(ordered, headings.build_sections(levels))


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return tables.grid(raw["tables"], raw["cells"])


def table_column_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return tables.column_headers(raw["tables"], tables.grid(raw["tables"], raw["cells"]))


def table_row_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return tables.row_headers(raw["tables"], tables.grid(raw["tables"], raw["cells"]))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return tables.markdown(raw["tables"], tables.grid(raw["tables"], raw["cells"]))


def table_cell_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell at the last place of every table."""
    raw = _raw(spark, sf_dir)
    points = raw["tables"].select(*K, (F.col("n_rows") - 1).alias("r"), (F.col("n_cols") - 1).alias("c"))
    return tables.cell_at(raw["cells"].select(*K, "row_idx", "col_idx", "row_span", "col_span", "cell_ord", "cell_key"), points)


def table_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    dense = tables.grid(raw["tables"], raw["cells"])
    return tables.label_lookup(tables.row_headers(raw["tables"], dense), tables.column_headers(raw["tables"], dense), dense)


def table_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    units = scale.detect_scale(tables.scale_sources(raw["tables"], raw["cells"], _ordered(spark, sf_dir)), K)
    return raw["tables"].select(*K).join(units, K, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def scale_preceding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    said = tables.scale_sources(raw["tables"], raw["cells"], _ordered(spark, sf_dir)).filter("source = 'preceding_text'")
    return said.groupBy(*K).agg(F.count("*").alias("texts"), F.min("src_ord").cast("bigint").alias("nearest"))


def magnitude_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    sources = tables.scale_sources(raw["tables"], raw["cells"], _ordered(spark, sf_dir))
    return report.magnitude_locations(raw["tables"], sources.unionByName(tables.body_texts(raw["cells"])), K)


def header_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return mapping.header_extent(raw["cells"], raw["tables"], K)


def table_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.table_size(_raw(spark, sf_dir)["cells"], K)


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)["blocks"]
    label = F.when(F.col("block_ord") % 5 == 0, F.upper("type")).when(F.col("block_ord") % 5 == 1, F.lit("Picture")).when(F.col("block_ord") % 5 == 2, F.lit("unheard_of")).when(F.col("block_ord") % 5 == 3, F.lit(None)).otherwise(F.lit("document_index"))
    return raw.groupBy(label.alias("label"), mapping.map_label(label).alias("block_type")).agg(F.count("*").alias("blocks"))


def bbox_flip_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as a model with its origin at the bottom and half the size would give them."""
    b = _raw(spark, sf_dir)["blocks"]
    origin = F.when(F.col("block_ord") % 2 == 0, "BottomLeft").otherwise("TOPLEFT")
    box = mapping.to_box(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1"), F.col("bbox.y1"), origin, F.lit(792.0), F.lit(2.0), F.lit(2.0))
    return b.select("block_key", box.alias("box")).select("block_key", "box.*")


def cell_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _raw(spark, sf_dir)["cells"]
    end = F.col("row_idx") + F.col("row_span") - F.col("col_idx") % 3
    return c.select("cell_key", mapping.span(F.col("row_idx"), end, F.col("col_span") - F.col("row_idx") % 2).alias("span"))


def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _raw(spark, sf_dir)["pages"]
    raw = F.when(F.col("page_number") % 7 == 3, F.lit(1.5)).otherwise(F.col("ocr_confidence"))
    return p.select("doc_id", "page_number", mapping.page_confidence(raw).alias("confidence"), mapping.low_confidence(F.col("ocr_confidence")).alias("low_confidence"))


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    glyphs = raw["blocks"].filter("font_size is not null").select("doc_id", "page_number")
    pages = raw["pages"].drop("extraction_source")
    return mapping.page_sources(pages, raw["blocks"], glyphs).select("doc_id", "page_number", "extraction_source", F.array_join("warnings", ",").alias("warnings"))


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, levels = _heads(spark, sf_dir)
    sections = headings.build_sections(levels)
    out = assemble.chunk_metadata(headings.section_of_blocks(ordered, sections), sections)
    return out.withColumn("order_index", F.col("order_index").cast("bigint"))


def iter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _ordered(spark, sf_dir)
    return assemble.iter_blocks(reading_order.reading_order(ordered), ordered).select("doc_id", F.col("n").cast("bigint"), "page_number", "block_id", "type")


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.type_histogram(_ordered(spark, sf_dir))


def document_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble(_raw(spark, sf_dir))["warnings"].groupBy("code").agg(F.count("*").alias("warnings"))


def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = assemble.assemble(_raw(spark, sf_dir))["cells"]
    return cells.select("cell_key", "cell_id", "value.num", "value.scaled", "value.currency", "value.unit", "value.is_dash")


def nested_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.nested(assemble.assemble(_raw(spark, sf_dir)))


def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.parts(assemble.assemble(_raw(spark, sf_dir)))


def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.stable_hash(document_parts(spark, sf_dir))


def block_text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _raw(spark, sf_dir)["blocks"]
    return b.groupBy("doc_id").agg(F.count_if(strip(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.sum(F.length("text")).alias("characters"))


QUERIES = {
    f.__name__: f
    for f in (
        furniture_keys, furniture_reclassify, reading_order_columns, reading_order_rank, reading_order_rtl, reading_order_arrays, heading_numbering, heading_size_rank, heading_levels, section_tree,
        section_of_block, section_page_range, no_headings, table_grid, table_column_headers, table_row_headers, table_markdown, table_cell_at, table_label_lookup, table_units, scale_preceding_window,
        magnitude_location, header_extent, table_size, label_map, bbox_flip_scale, cell_spans, page_confidence, page_sources, chunk_metadata, iter_blocks, type_histogram, document_warnings,
        cell_values, nested_document, stable_hash, block_text_lengths,
    )
}
_WINDOW = f"""{_ORDERED}, tabs_at AS (SELECT doc_id, page_number, block_ord, emit_index AS spot FROM placed WHERE type = 'table'),
    before AS (SELECT t.doc_id, t.page_number, t.block_ord, t.spot - p.emit_index AS off, p.text FROM tabs_at t JOIN placed p ON p.doc_id = t.doc_id AND p.page_number = t.page_number AND p.emit_index BETWEEN t.spot - 5 AND t.spot - 1 WHERE {_strip("coalesce(p.text, '')")} <> '')"""
_SOURCES = f"""{_WINDOW}, starts AS (SELECT doc_id, page_number, block_ord, row_idx, col_idx, arg_max({_strip("coalesce(text, '')")}, cell_ord) AS text FROM cells GROUP BY ALL),
    labels AS (
        SELECT doc_id, page_number, block_ord, string_agg(nullif(s.text, ''), ' ' ORDER BY row_idx) AS text FROM starts s JOIN tabs t USING (doc_id, page_number, block_ord)
        WHERE row_idx < greatest(coalesce(header_rows, 0), 1) AND row_idx < n_rows AND col_idx < n_cols GROUP BY doc_id, page_number, block_ord, col_idx
    ), sources AS (
        SELECT doc_id, page_number, block_ord, 'caption' AS place, NULL AS off, caption AS text FROM tabs UNION ALL SELECT doc_id, page_number, block_ord, 'header', NULL, text FROM cells WHERE is_header
        UNION ALL SELECT doc_id, page_number, block_ord, 'header', NULL, text FROM labels UNION ALL SELECT doc_id, page_number, block_ord, 'row_stem', NULL, text FROM cells WHERE col_idx = 0
        UNION ALL SELECT doc_id, page_number, block_ord, 'body_cell', NULL, text FROM cells WHERE NOT coalesce(is_header, false) AND col_idx > 0
        UNION ALL SELECT doc_id, page_number, block_ord, 'before', off, text FROM before
    ), hits AS (SELECT * FROM sources WHERE regexp_matches(text, '(?i)\\b(thousand|million|billion|trillion)s?\\b')),
    places AS (
        SELECT DISTINCT doc_id, page_number, block_ord, place FROM hits WHERE off IS NULL
        UNION ALL SELECT doc_id, page_number, block_ord, 'preceding<=' || CASE min(off) WHEN 4 THEN 5 ELSE min(off) END FROM hits WHERE off IS NOT NULL GROUP BY doc_id, page_number, block_ord
    ), per AS (
        SELECT t.doc_id, t.page_number, t.block_ord, coalesce(string_agg(p.place, '|' ORDER BY p.place), 'NOWHERE') AS location FROM tabs t
        LEFT JOIN places p ON p.doc_id = t.doc_id AND p.page_number = t.page_number AND p.block_ord = t.block_ord GROUP BY ALL
    )"""
ORACLES = {
    "magnitude_location": f"WITH {_SOURCES} SELECT location, count(*) AS tables FROM per GROUP BY location",
    "furniture_keys": f"WITH {_FURNITURE} SELECT * FROM furniture",
    "furniture_reclassify": f"WITH {_RELABELLED} SELECT block_key, type FROM relabelled",
    "reading_order_columns": f"WITH {_ORDERED} SELECT doc_id, page_number, columns FROM columns_of",
    "reading_order_rank": f"WITH {_ORDERED} SELECT block_key, emit_index, order_index, block_id FROM placed",
    "reading_order_rtl": f"WITH {_order_sql(True)} SELECT block_key, order_index FROM placed",
    "reading_order_arrays": f"WITH {_ORDERED} SELECT doc_id, page_number, string_agg(block_id, ',' ORDER BY order_index) AS reading_order FROM placed WHERE NOT furn GROUP BY 1, 2",
    "heading_numbering": f"WITH RECURSIVE {_HEADS} SELECT block_key, depth FROM heads",
    "heading_size_rank": f"WITH RECURSIVE {_HEADS} SELECT doc_id, font_size, size_rank FROM ranks",
    "heading_levels": f"WITH RECURSIVE {_HEADS} SELECT doc_id, i, block_key, level FROM levels",
    "section_tree": f"""WITH RECURSIVE {_HEADS} SELECT doc_id, format('s{{:03d}}', i) AS section_id, {_strip("text")} AS title, level,
        CASE WHEN parent IS NOT NULL THEN format('s{{:03d}}', parent) END AS parent_section_id, path, block_id AS heading_block_id, page_number AS page_start FROM parents JOIN paths USING (doc_id, i)""",
    "section_of_block": f"WITH RECURSIVE {_SECTIONED} SELECT block_key, section_id FROM sectioned",
    "section_page_range": f"""WITH RECURSIVE {_SECTIONED}, up AS (
            SELECT doc_id, i AS below, i AS at FROM parents UNION ALL SELECT u.doc_id, u.below, p.parent FROM up u JOIN parents p ON p.doc_id = u.doc_id AND p.i = u.at WHERE p.parent IS NOT NULL
        ), ends AS (SELECT p.doc_id, p.i, greatest(p.page_number, coalesce(max(s.page_number), p.page_number)) AS e FROM parents p LEFT JOIN sectioned s ON s.doc_id = p.doc_id AND s.section_id = format('s{{:03d}}', p.i) GROUP BY p.doc_id, p.i, p.page_number)
        SELECT p.doc_id, format('s{{:03d}}', p.i) AS section_id, p.page_number AS page_start, max(e) AS page_end FROM parents p JOIN up ON up.doc_id = p.doc_id AND up.at = p.i JOIN ends ON ends.doc_id = p.doc_id AND ends.i = up.below GROUP BY p.doc_id, p.i, p.page_number""",
    "no_headings": f"WITH RECURSIVE {_HEADS} SELECT DISTINCT doc_id, 'NO_HEADINGS_DETECTED' AS code FROM placed WHERE doc_id NOT IN (SELECT doc_id FROM levels)",
    "table_grid": f"WITH {_GRID} SELECT * FROM grid",
    "table_column_headers": f"""WITH {_GRID} SELECT doc_id, page_number, block_ord, col_idx, coalesce(string_agg(nullif(g.text, ''), ' ' ORDER BY row_idx), '') AS label
        FROM grid g JOIN (SELECT doc_id, page_number, block_ord, greatest(coalesce(header_rows, 0), 1) AS h FROM tabs) USING (doc_id, page_number, block_ord) WHERE row_idx < h GROUP BY ALL""",
    "table_row_headers": f"""WITH {_GRID} SELECT doc_id, page_number, block_ord, row_idx, coalesce(string_agg(nullif(g.text, ''), ' ' ORDER BY col_idx), '') AS label
        FROM grid g JOIN (SELECT doc_id, page_number, block_ord, greatest(coalesce(header_cols, 0), 1) AS h, coalesce(header_rows, 0) AS f FROM tabs) USING (doc_id, page_number, block_ord) WHERE row_idx >= f AND col_idx < h GROUP BY ALL""",
    "table_markdown": f"""WITH {_GRID}, lines AS (
            SELECT doc_id, page_number, block_ord, row_idx, '| ' || string_agg(replace(replace(text, '|', '\\|'), chr(10), ' '), ' | ' ORDER BY col_idx) || ' |' AS line FROM grid GROUP BY ALL
        ), sized AS (SELECT doc_id, page_number, block_ord, n_cols, coalesce(header_rows, 0) AS h FROM tabs)
        SELECT doc_id, page_number, block_ord, CASE WHEN h = 0 THEN '| ' || array_to_string(list_transform(range(n_cols), lambda x: ''), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(range(n_cols), lambda x: '---'), ' | ') || ' |' || chr(10) ELSE '' END
            || string_agg(line || CASE WHEN row_idx = h - 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(n_cols), lambda x: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY row_idx) AS markdown
        FROM lines JOIN sized USING (doc_id, page_number, block_ord) GROUP BY doc_id, page_number, block_ord, n_cols, h""",
    "table_cell_at": f"""WITH {_RAW} SELECT t.doc_id, t.page_number, t.block_ord, n_rows - 1 AS r, n_cols - 1 AS c, arg_min(cell_key, cell_ord) AS cell_key FROM tabs t
        LEFT JOIN cells c ON c.doc_id = t.doc_id AND c.page_number = t.page_number AND c.block_ord = t.block_ord AND n_rows - 1 >= row_idx AND n_rows - 1 < row_idx + row_span AND n_cols - 1 >= col_idx AND n_cols - 1 < col_idx + col_span GROUP BY ALL""",
    "table_label_lookup": f"""WITH {_GRID}, sized AS (SELECT doc_id, page_number, block_ord, greatest(coalesce(header_rows, 0), 1) AS hr, greatest(coalesce(header_cols, 0), 1) AS hc, coalesce(header_rows, 0) AS f FROM tabs),
        cl AS (SELECT doc_id, page_number, block_ord, col_idx, coalesce(string_agg(nullif(text, ''), ' ' ORDER BY row_idx), '') AS col_label FROM grid JOIN sized USING (doc_id, page_number, block_ord) WHERE row_idx < hr GROUP BY ALL),
        rl AS (SELECT doc_id, page_number, block_ord, row_idx, coalesce(string_agg(nullif(text, ''), ' ' ORDER BY col_idx), '') AS row_label FROM grid JOIN sized USING (doc_id, page_number, block_ord) WHERE row_idx >= f AND col_idx < hc GROUP BY ALL),
        c1 AS (SELECT doc_id, page_number, block_ord, col_label, min(col_idx) AS col_idx FROM cl WHERE col_idx > 0 GROUP BY ALL), r1 AS (SELECT doc_id, page_number, block_ord, row_label, min(row_idx) AS row_idx FROM rl GROUP BY ALL)
        SELECT doc_id, page_number, block_ord, row_label, col_label, text FROM grid JOIN r1 USING (doc_id, page_number, block_ord, row_idx) JOIN c1 USING (doc_id, page_number, block_ord, col_idx)""",
    "scale_preceding_window": f"WITH {_WINDOW} SELECT doc_id, page_number, block_ord, count(*) AS texts, min(off) AS nearest FROM before JOIN (SELECT DISTINCT doc_id, page_number, block_ord FROM tabs_at) USING (doc_id, page_number, block_ord) GROUP BY ALL",
    "header_extent": f"""WITH {_RAW}, r AS (SELECT doc_id, page_number, block_ord, row_idx AS n, bool_and(coalesce(is_header, false)) AS a FROM cells GROUP BY ALL), c AS (SELECT doc_id, page_number, block_ord, col_idx AS n, bool_and(coalesce(is_header, false)) AS a FROM cells GROUP BY ALL)
        SELECT t.doc_id, t.page_number, t.block_ord,
            (SELECT coalesce(min(k), n_rows) FROM (SELECT unnest(range(n_rows)) AS k) x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND r.page_number = t.page_number AND r.block_ord = t.block_ord AND r.n = k AND a))::INT AS header_rows,
            (SELECT coalesce(min(k), n_cols) FROM (SELECT unnest(range(n_cols)) AS k) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = t.doc_id AND c.page_number = t.page_number AND c.block_ord = t.block_ord AND c.n = k AND a))::INT AS header_cols FROM tabs t""",
    "table_size": f"WITH {_RAW} SELECT doc_id, page_number, block_ord, max(row_idx + greatest(row_span, 1)) AS n_rows, max(col_idx + greatest(col_span, 1)) AS n_cols FROM cells GROUP BY ALL",
    "label_map": f"""WITH {_RAW}, l AS (SELECT CASE block_ord % 5 WHEN 0 THEN upper(type) WHEN 1 THEN 'Picture' WHEN 2 THEN 'unheard_of' WHEN 3 THEN NULL ELSE 'document_index' END AS label FROM blocks)
        SELECT label, CASE WHEN label = 'Picture' THEN 'figure' WHEN label = 'document_index' THEN 'table' WHEN label IS NULL OR label = 'unheard_of' THEN 'text' ELSE lower(label) END AS block_type, count(*) AS blocks FROM l GROUP BY ALL""",
    "bbox_flip_scale": f"""WITH {_RAW}, f AS (SELECT block_key, bbox.x0 * 2 AS a, bbox.x1 * 2 AS b, CASE WHEN block_ord % 2 = 0 THEN 792 - bbox.y0 ELSE bbox.y0 END * 2 AS c, CASE WHEN block_ord % 2 = 0 THEN 792 - bbox.y1 ELSE bbox.y1 END * 2 AS d FROM blocks)
        SELECT block_key, round(least(a, b), 2) AS x0, round(least(c, d), 2) AS y0, round(greatest(a, b), 2) AS x1, round(greatest(c, d), 2) AS y1 FROM f""",
    "cell_spans": f"WITH {_RAW} SELECT cell_key, CASE WHEN row_span - col_idx % 3 > 0 THEN row_span - col_idx % 3 WHEN col_span - row_idx % 2 > 0 THEN col_span - row_idx % 2 ELSE 1 END AS span FROM cells",
    "page_confidence": f"""WITH {_RAW} SELECT doc_id, page_number, CASE WHEN page_number % 7 = 3 THEN NULL ELSE round(ocr_confidence, 4) END AS confidence, coalesce(ocr_confidence < 0.75, false) AS low_confidence FROM pages""",
    "page_sources": f"""WITH {_RAW}, n AS (SELECT doc_id, page_number, (SELECT count(*) FROM blocks b WHERE b.doc_id = p.doc_id AND b.page_number = p.page_number) AS held, (SELECT count(*) FROM blocks b WHERE b.doc_id = p.doc_id AND b.page_number = p.page_number AND font_size IS NOT NULL) AS inked FROM pages p)
        SELECT doc_id, page_number, CASE WHEN inked > 0 THEN 'text_layer' ELSE 'ocr' END AS extraction_source, concat_ws(',', CASE WHEN inked = 0 THEN 'SCANNED_PAGE_OCR_FALLBACK' END, CASE WHEN held = 0 THEN 'PAGE_EXTRACTION_FAILED' END) AS warnings FROM n""",
    "chunk_metadata": f"""WITH RECURSIVE {_SECTIONED} SELECT s.doc_id, page_number, order_index, block_id, coalesce(path, '') AS section, type AS content_type
        FROM sectioned s LEFT JOIN (SELECT doc_id, format('s{{:03d}}', i) AS section_id, path FROM paths) p ON p.doc_id = s.doc_id AND p.section_id = s.section_id WHERE order_index IS NOT NULL""",
    "iter_blocks": f"WITH {_ORDERED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, order_index) - 1 AS n, page_number, block_id, type FROM placed WHERE NOT furn",
    "type_histogram": f"WITH {_RELABELLED} SELECT type, count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM relabelled GROUP BY type",
    "document_warnings": f"""WITH RECURSIVE {_HEADS}, w AS (
            SELECT 'LOW_OCR_CONFIDENCE' AS code FROM pages WHERE ocr_confidence < 0.75 UNION ALL SELECT 'PAGE_EXTRACTION_FAILED' FROM pages WHERE extraction_source = 'failed'
            UNION ALL SELECT 'NO_HEADINGS_DETECTED' FROM (SELECT DISTINCT doc_id FROM placed WHERE doc_id NOT IN (SELECT doc_id FROM levels))
        ) SELECT code, count(*) AS warnings FROM w GROUP BY code""",
    "block_text_lengths": f"WITH {_RAW} SELECT doc_id, count(*) FILTER ({_strip("coalesce(text, '')")} = '') AS blank, sum(length(text))::BIGINT AS characters FROM blocks GROUP BY doc_id",
}
