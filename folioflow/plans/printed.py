"""Queries over the order tables: figures printed as reports print them, then read back.

The SQL never parses: it states the value that was printed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.finance import parse_values
from folioflow.operators import layout, scale, typography, validate
from folioflow.session import table
from folioflow.sources import cache


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ``printed``: eight ways to print a price, by part."""
    price = F.format_number("l_extendedprice", 2)
    way = F.col("l_partkey") % 8
    text = (
        F.when(way == 0, price).when(way == 1, F.concat(F.lit("("), price, F.lit(")"))).when(way == 2, F.concat(F.lit("$"), price)).when(way == 3, F.concat(F.lit("($"), price, F.lit(")")))
        .when(way == 4, F.concat(F.format_number(F.col("l_discount") * 100, 1), F.lit("%"))).when(way == 5, F.lit("—")).when(way == 6, F.concat(price, F.lit(" (1)"))).otherwise(F.concat(F.lit("-"), price))
    )
    return table(spark, sf_dir, "lineitem").withColumn("printed", text)


_FACTOR = "CASE l_suppkey % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1000000.0 ELSE 1.0 END"
_NUM = "CASE l_partkey % 8 WHEN 1 THEN -l_extendedprice WHEN 3 THEN -l_extendedprice WHEN 7 THEN -l_extendedprice WHEN 4 THEN round(l_discount * 100, 1) WHEN 5 THEN NULL ELSE l_extendedprice END"


def finance_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = parse_values(_printed(spark, sf_dir), F.col("printed"))
    v = F.col("value")
    return read.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(v["num"], 2).alias("num"), v["currency"].alias("currency"), v["unit"].alias("unit"), v["is_negative"].alias("is_negative"),
        v["negative_style"].alias("negative_style"), v["is_dash"].alias("is_dash"), F.array_join(v["footnote_refs"], ",").alias("refs"),
    )


FINANCE_PARSE = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_NUM}, 2) AS num,
        CASE WHEN l_partkey % 8 IN (2, 3) THEN 'USD' END AS currency,
        CASE WHEN l_partkey % 8 = 4 THEN 'percent' WHEN l_partkey % 8 IN (2, 3) THEN 'currency' END AS unit,
        l_partkey % 8 IN (1, 3, 7) AS is_negative,
        CASE WHEN l_partkey % 8 IN (1, 3) THEN 'parentheses' WHEN l_partkey % 8 = 7 THEN 'minus' END AS negative_style,
        l_partkey % 8 = 5 AS is_dash, CASE WHEN l_partkey % 8 = 6 THEN '1' ELSE '' END AS refs
    FROM lineitem"""


def finance_scaled_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("l_suppkey") % 3 == 0, 1000.0).when(F.col("l_suppkey") % 3 == 1, 1000000.0).otherwise(1.0)
    read = parse_values(_printed(spark, sf_dir), F.col("printed"), factor)
    return read.groupBy("l_orderkey").agg(F.round(F.sum(F.col("value.scaled").cast("decimal(24,2)")), 2).cast("double").alias("total"), F.count("value.num").alias("figures"))


FINANCE_SCALED_TOTAL = f"""
    SELECT l_orderkey, sum(CAST(CASE WHEN l_partkey % 8 = 4 THEN {_NUM} ELSE {_NUM} * {_FACTOR} END AS DECIMAL(24, 2)))::DOUBLE AS total, count({_NUM}) AS figures
    FROM lineitem GROUP BY l_orderkey"""


def finance_unit_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("l_returnflag") == "R", "EUR")
    read = parse_values(_printed(spark, sf_dir), F.col("printed"), currency=own)
    return read.groupBy("l_returnflag", F.col("value.currency").alias("currency"), F.col("value.unit").alias("unit")).agg(F.count("*").alias("figures"))


FINANCE_UNIT_INHERITANCE = """
    WITH r AS (
        SELECT l_returnflag, l_partkey % 8 AS way, coalesce(CASE WHEN l_partkey % 8 IN (2, 3) THEN 'USD' END, CASE WHEN l_returnflag = 'R' THEN 'EUR' END) AS currency FROM lineitem
    )
    SELECT l_returnflag, currency, CASE WHEN way = 4 THEN 'percent' WHEN currency IS NOT NULL THEN 'currency' END AS unit, count(*) AS figures FROM r GROUP BY ALL"""


def _order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four sources of an order's table say, by its keys."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    caption = F.when(k % 5 == 0, "Selected data (in millions)").when(k % 5 == 1, "Selected data, expressed in thousands of U.S. dollars").otherwise("Selected data")
    header = [F.when(k % 7 == 0, "€ million").when(k % 7 == 1, "in thousands").otherwise("2019"), F.when(k % 7 == 0, "in thousands").otherwise("2018"), F.when(k % 7 == 0, "in thousands, except per share data").otherwise("2017")]
    stem = F.when(k % 11 == 0, "RMB'Million").otherwise("Total assets")
    before = F.when(k % 13 == 0, "Amounts are presented in billions.").when(k % 13 == 1, "Revenue rose by $5 million over the year.").otherwise("See the notes.")
    rows = [("caption", 0, caption), *(("header", i, h) for i, h in enumerate(header)), ("row_stem", 0, stem), ("preceding_text", 1, before)]
    said = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(o).alias("src_ord"), t.alias("text")) for s, o, t in rows])
    return orders.select("o_orderkey", F.inline(said))


def scale_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.detect_scale(_order_sources(spark, sf_dir), ["o_orderkey"])


SCALE_PRECEDENCE = """
    SELECT o_orderkey,
        CASE WHEN k5 = 0 THEN 1e6 WHEN k5 = 1 THEN 1e3 WHEN k7 IN (0, 1) THEN 1e3 WHEN k11 = 0 THEN 1e6 WHEN k13 = 0 THEN 1e9 ELSE 1.0 END AS scale,
        CASE WHEN k5 = 0 THEN 'in millions' WHEN k5 = 1 THEN 'in thousands' WHEN k7 IN (0, 1) THEN 'in thousands' WHEN k11 = 0 THEN 'RMB''Million' WHEN k13 = 0 THEN 'in billions' END AS scale_label,
        CASE WHEN k5 = 1 THEN 'USD' WHEN k7 = 0 THEN 'EUR' WHEN k11 = 0 THEN 'CNY' END AS currency,
        CASE WHEN k5 IN (0, 1) THEN 'caption' WHEN k7 IN (0, 1) THEN 'header' WHEN k11 = 0 THEN 'row_stem' WHEN k13 = 0 THEN 'preceding_text' END AS scale_source,
        k5 NOT IN (0, 1) AND k7 = 0 AS ambiguous
    FROM (SELECT o_orderkey, o_orderkey % 5 AS k5, o_orderkey % 7 AS k7, o_orderkey % 11 AS k11, o_orderkey % 13 AS k13 FROM orders)"""


def scale_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.describe(scale_precedence(spark, sf_dir)).select("o_orderkey", "provenance")


SCALE_DESCRIBED = f"""SELECT o_orderkey, CASE WHEN scale_source IS NULL THEN 'no magnitude declared' ELSE CASE scale WHEN 1e3 THEN '1000' WHEN 1e6 THEN '1e+06' ELSE '1e+09' END
        || ' from ' || scale_source || ' (' || chr(39) || scale_label || chr(39) || ')' || CASE WHEN ambiguous THEN ' AMBIGUOUS' ELSE '' END END AS provenance
    FROM ({SCALE_PRECEDENCE})"""


def scale_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the captions alone declare."""
    return scale.parse_scale(_order_sources(spark, sf_dir).filter("source = 'caption'").withColumnRenamed("text", "caption"), ["o_orderkey"])


SCALE_PARSED = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 ELSE 1.0 END AS scale, CASE o_orderkey % 5 WHEN 0 THEN 'in millions' WHEN 1 THEN 'in thousands' END AS scale_label, CASE WHEN o_orderkey % 5 = 1 THEN 'USD' END AS currency FROM orders"""


def scale_candidates_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scale.find_candidates(_order_sources(spark, sf_dir), strict=F.col("source") == "preceding_text")
    return found.groupBy("source", "label", "scale", "currency").agg(F.count("*").alias("declarations"))


SCALE_CANDIDATES_FOUND = """
    WITH d AS (
        SELECT 'caption' AS source, 'in millions' AS label, 1e6 AS scale, NULL AS currency FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT 'caption', 'in thousands', 1e3, 'USD' FROM orders WHERE o_orderkey % 5 = 1
        UNION ALL SELECT 'header', '€ million', 1e6, 'EUR' FROM orders WHERE o_orderkey % 7 = 0
        UNION ALL SELECT 'header', 'in thousands', 1e3, NULL FROM orders WHERE o_orderkey % 7 = 1
        UNION ALL SELECT 'header', 'in thousands', 1e3, NULL FROM orders, range(2) WHERE o_orderkey % 7 = 0
        UNION ALL SELECT 'row_stem', 'RMB''Million', 1e6, 'CNY' FROM orders WHERE o_orderkey % 11 = 0
        UNION ALL SELECT 'preceding_text', 'in billions', 1e9, NULL FROM orders WHERE o_orderkey % 13 = 0
    )
    SELECT source, label, scale, currency, count(*) AS declarations FROM d GROUP BY ALL"""


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads, with what makes admission fail in turn."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    content = F.encode(F.concat(F.when(k % 7 == 3, "").otherwise("%PDF-1.4 "), F.coalesce("text", F.lit(""))), "UTF-8")
    return d.select(
        "doc_id", content.alias("content"), F.when(k % 11 == 5, "text/plain").when(k % 11 == 6, "Application/PDF; charset=x").alias("content_type"),
        F.when(k % 13 == 2, F.concat(F.lit("bad id "), k.cast("string"))).when(k % 13 == 3, F.concat(F.lit("doc-"), k.cast("string"))).otherwise("").alias("given_id"),
        F.when(k % 17 == 4, '{"force_ocr": true}').when(k % 17 == 5, '{"colour": 1}').when(k % 17 == 6, "not json").when(k % 17 == 7, '{"force_ocr": "yes"}').alias("options"),
        (k % 19).cast("int").alias("page_count"),
    )


def validate_reject_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reject_code(_uploads(spark, sf_dir), max_mb=1, max_pages=16).select("doc_id", "reject", "status")


_BODY = "(CASE WHEN doc_id % 7 = 3 THEN '' ELSE '%PDF-1.4 ' END || coalesce(text, ''))"
VALIDATE_REJECT_CODE = f"""
    WITH c AS (
        SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN octet_length(encode({_BODY})) > 1048576 THEN 'FILE_TOO_LARGE'
            WHEN doc_id % 7 = 3 AND position('%PDF-' IN substr(coalesce(text, ''), 1, 1024)) = 0 THEN 'INVALID_PDF' WHEN doc_id % 13 = 2 THEN 'INVALID_DOCUMENT_ID'
            WHEN doc_id % 17 IN (5, 6, 7) THEN 'INVALID_OPTIONS' WHEN doc_id % 19 = 0 THEN 'INVALID_PDF' WHEN doc_id % 19 > 16 THEN 'TOO_MANY_PAGES' END AS reject FROM documents
    )
    SELECT doc_id, reject, CASE reject WHEN 'UNSUPPORTED_MEDIA_TYPE' THEN 415 WHEN 'FILE_TOO_LARGE' THEN 413 WHEN 'INVALID_PDF' THEN 400 WHEN 'INVALID_DOCUMENT_ID' THEN 400
        WHEN 'INVALID_OPTIONS' THEN 422 WHEN 'TOO_MANY_PAGES' THEN 422 ELSE 200 END AS status FROM c"""


def validate_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = _uploads(spark, sf_dir)
    return up.select("doc_id", validate.document_id(F.col("given_id"), F.col("content")).alias("document_id"), validate.content_sha256(F.col("content")).alias("sha256"))


VALIDATE_DOCUMENT_ID = f"""
    SELECT doc_id, CASE WHEN doc_id % 13 = 2 THEN 'bad id ' || doc_id WHEN doc_id % 13 = 3 THEN 'doc-' || doc_id ELSE 'doc_' || substr(sha256({_BODY}), 1, 16) END AS document_id, sha256({_BODY}) AS sha256
    FROM documents"""


def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads against a cache that holds the documents of every third id, by content."""
    up = validate_document_id(spark, sf_dir)
    held = up.filter("doc_id % 3 = 0").select("sha256").distinct().withColumn("variant", F.lit(cache.cache_variant("textonly")))
    hits, misses = cache.hits_and_misses(up, held, cache.cache_variant("textonly"))
    return hits.select("doc_id", F.lit("hit").alias("cache")).unionByName(misses.select("doc_id", F.lit("miss").alias("cache")))


CACHE_HIT_MISS = f"""
    SELECT doc_id, CASE WHEN {_BODY} IN (SELECT {_BODY} FROM documents WHERE doc_id % 3 = 0) THEN 'hit' ELSE 'miss' END AS cache FROM documents"""


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as glyphs: a page per user, a place and size by event and value."""
    e = table(spark, sf_dir, "events")
    x, y = (F.col("event_id") * 37 % 560).cast("double"), (F.floor(F.col("value")) * 13 % 780).cast("double")
    size = 8.0 + 2.0 * (F.col("event_id") % 5)
    return e.filter("user_id is not null and value is not null").select(
        F.lit("d").alias("doc_id"), F.col("user_id").alias("page_number"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 17 == 0, " ").otherwise(F.substring("event_type", 1, 1)).alias("char"),
        x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + size).alias("y1"), size.alias("font_size"), F.when(F.col("event_id") % 3 == 0, 700).otherwise(400).alias("font_weight"),
    )


_GLYPHS = """glyphs AS (
        SELECT 'd' AS doc_id, user_id AS page_number, event_id AS ord, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE substr(event_type, 1, 1) END AS char, (event_id * 37 % 560)::DOUBLE AS x0,
            (floor(value)::BIGINT * 13 % 780)::DOUBLE AS y0, (event_id * 37 % 560)::DOUBLE + 6 AS x1, (floor(value)::BIGINT * 13 % 780)::DOUBLE + 8.0 + 2.0 * (event_id % 5) AS y1,
            8.0::DOUBLE + 2.0 * (event_id % 5) AS font_size, CASE WHEN event_id % 3 = 0 THEN 700 ELSE 400 END AS font_weight
        FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"""


def typography_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fonts in a grid of boxes on every user's page."""
    glyphs = _glyphs(spark, sf_dir)
    pages = glyphs.select("doc_id", "page_number").distinct()
    n = F.explode(F.sequence(F.lit(0), F.lit(12))).alias("box")
    boxes = pages.select("doc_id", "page_number", n).select("doc_id", "page_number", "box", (F.col("box") * 40).cast("double").alias("x0"), (F.col("box") * 60).cast("double").alias("y0"), (F.col("box") * 40 + 200).cast("double").alias("x1"), (F.col("box") * 60 + 40).cast("double").alias("y1"))
    return typography.probe(boxes, glyphs, ["doc_id", "page_number", "box"])


TYPOGRAPHY_PROBE = f"""
    WITH {_GLYPHS}, boxes AS (
        SELECT doc_id, page_number, n::INT AS box, n * 40.0 AS x0, n * 60.0 AS y0, n * 40.0 + 200 AS x1, n * 60.0 + 40 AS y1 FROM (SELECT DISTINCT doc_id, page_number FROM glyphs), range(13) t(n)
    ), hits AS (
        SELECT b.doc_id, b.page_number, box, font_size, font_weight >= 600 AS bold FROM boxes b JOIN glyphs g ON b.page_number = g.page_number AND char <> ' '
            AND (g.x0 + g.x1) / 2 BETWEEN b.x0 - 1.5 AND b.x1 + 1.5 AND (g.y0 + g.y1) / 2 BETWEEN b.y0 - 1.5 AND b.y1 + 1.5
    ), sizes AS (
        SELECT page_number, box, font_size, row_number() OVER (PARTITION BY page_number, box ORDER BY count(*) DESC, font_size DESC) AS k FROM hits GROUP BY page_number, box, font_size
    ), totals AS (SELECT page_number, box, count(*) AS n, count(*) FILTER (bold) AS n_bold FROM hits GROUP BY page_number, box)
    SELECT b.doc_id, b.page_number, b.box, round(s.font_size, 2) AS font_size, coalesce(n_bold >= 0.6 * n, false) AS is_bold, coalesce(n, 0) AS n_glyphs
    FROM boxes b LEFT JOIN sizes s ON s.page_number = b.page_number AND s.box = b.box AND k = 1 LEFT JOIN totals t ON t.page_number = b.page_number AND t.box = b.box"""


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.line_rows(layout.group_lines(_glyphs(spark, sf_dir)))
    return lines.select("page_number", F.col("line_no").cast("bigint").alias("line_no"), "text", "font_size", "n_glyphs", "x0", "y0", "x1", "y1")


def layout_body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_size(layout.line_rows(layout.group_lines(_glyphs(spark, sf_dir)))).select("page_number", "body_size")


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages from glyphs to blocks."""
    glyphs = _glyphs(spark, sf_dir)
    pages = glyphs.select("doc_id", "page_number").distinct().withColumn("height", F.lit(800.0))
    return layout.build_blocks(glyphs, pages).select("page_number", F.col("block_no").cast("bigint").alias("block_no"), "type", "text", "font_size", "is_bold", "n_lines", "x0", "y0", "x1", "y1")


def layout_failed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all users; those of every fifth have lost their glyphs."""
    glyphs = _glyphs(spark, sf_dir)
    pages = glyphs.select("doc_id", "page_number").distinct().withColumn("extraction_source", F.lit(None).cast("string"))
    return layout.failed_pages(pages, glyphs.filter("page_number % 5 <> 0")).select("page_number", "extraction_source", "warning")


#: Lines, sizes and blocks of the glyphs; the fold over a page's glyphs is a recursion over their rank.
_LAYOUT = f"""{_GLYPHS}, inked AS (
        SELECT *, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY page_number ORDER BY (y0 + y1) / 2, x0, ord) AS rn FROM glyphs WHERE char <> ' '
    ), fold AS (
        SELECT page_number, rn, cy AS centre, 0::BIGINT AS line_no FROM inked WHERE rn = 1
        UNION ALL SELECT i.page_number, i.rn, CASE WHEN abs(i.cy - f.centre) <= greatest(i.font_size, 1) * 0.4 THEN f.centre ELSE i.cy END, f.line_no + CASE WHEN abs(i.cy - f.centre) <= greatest(i.font_size, 1) * 0.4 THEN 0 ELSE 1 END
        FROM fold f JOIN inked i ON i.page_number = f.page_number AND i.rn = f.rn + 1
    ), ink AS (SELECT i.*, f.line_no FROM inked i JOIN fold f USING (page_number, rn)),
    boxes AS (SELECT page_number, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_glyphs FROM ink GROUP BY 1, 2),
    spaces AS (SELECT g.*, (SELECT min(b.line_no) FROM boxes b WHERE b.page_number = g.page_number AND g.y0 BETWEEN b.y0 - 1 AND b.y1 + 1 AND g.x0 BETWEEN b.x0 AND b.x1) AS line_no FROM glyphs g WHERE char = ' '),
    placed AS (
        SELECT page_number, line_no, char, x0, x1, font_size, cy, ord, 0 AS blank FROM ink UNION ALL SELECT page_number, line_no, char, x0, x1, font_size, (y0 + y1) / 2, ord, 1 FROM spaces WHERE line_no IS NOT NULL
    ), pieces AS (
        SELECT *, row_number() OVER w AS k, CASE WHEN blank = 0 AND lag(blank) OVER w = 0 AND x0 - lag(x1) OVER w > 0.45 * greatest(lag(font_size) OVER w, 1) THEN ' ' || char ELSE char END AS piece
        FROM placed WINDOW w AS (PARTITION BY page_number, line_no ORDER BY x0, blank, cy, ord)
    ), sizes AS (
        SELECT page_number, line_no, font_size, row_number() OVER (PARTITION BY page_number, line_no ORDER BY count(*) DESC, font_size DESC) AS k FROM ink GROUP BY 1, 2, font_size
    ), texts AS (SELECT page_number, line_no, trim(string_agg(piece, '' ORDER BY k)) AS text FROM pieces GROUP BY 1, 2),
    page_lines AS (SELECT page_number, line_no, text, s.font_size, n_glyphs, x0, y0, x1, y1 FROM boxes JOIN texts USING (page_number, line_no) JOIN sizes s USING (page_number, line_no) WHERE s.k = 1),
    body AS (SELECT page_number, median(font_size) AS body_size FROM page_lines, range(greatest(length(text), 1)) GROUP BY 1)"""
_MERGED = """marked AS (
        SELECT *, CASE WHEN type = 'text' AND lag(type) OVER w = 'text' AND y0 - lag(y1) OVER w <= 0.75 * greatest(lag(font_size) OVER w, 1) THEN 0 ELSE 1 END AS fresh FROM typed WHERE trim(text) <> '' WINDOW w AS (PARTITION BY page_number ORDER BY line_no)
    ), numbered AS (SELECT *, (sum(fresh) OVER (PARTITION BY page_number ORDER BY line_no) - 1)::BIGINT AS block_no FROM marked)
    SELECT page_number, block_no, arg_min(type, line_no) AS type, string_agg(text, ' ' ORDER BY line_no) AS text, round(median(font_size), 2) AS font_size, arg_min(type, line_no) = 'section_header' AS is_bold, count(*) AS n_lines,
        round(min(x0), 2) AS x0, round(min(y0), 2) AS y0, round(max(x1), 2) AS x1, round(max(y1), 2) AS y1 FROM numbered GROUP BY 1, 2"""
LAYOUT_LINES = f"WITH RECURSIVE {_LAYOUT} SELECT * FROM page_lines"
LAYOUT_BODY_SIZE = f"WITH RECURSIVE {_LAYOUT} SELECT page_number, body_size FROM body"
LAYOUT_BLOCKS = f"""WITH RECURSIVE {_LAYOUT}, typed AS (
        SELECT l.*, CASE WHEN length(text) <= 60 AND (y0 + y1) / 2 <= 56.0 THEN 'page_header' WHEN length(text) <= 60 AND (y0 + y1) / 2 >= 744.0 THEN 'page_footer' WHEN font_size >= 1.15 * body_size THEN 'section_header' ELSE 'text' END AS type
        FROM page_lines l JOIN body USING (page_number)
    ), {_MERGED}"""
LAYOUT_FAILED_PAGES = f"""WITH {_GLYPHS} SELECT DISTINCT page_number, CASE WHEN page_number % 5 <> 0 THEN 'text_layer' ELSE 'failed' END AS extraction_source, CASE WHEN page_number % 5 = 0 THEN 'SCANNED_PAGE_OCR_FALLBACK' END AS warning FROM glyphs"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as printed lines: a page per order, spread by quantity."""
    li = table(spark, sf_dir, "lineitem")
    y = F.col("l_linenumber") * 14 + F.when(F.col("l_quantity") > 35, 9).otherwise(0)
    per = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))
    return per.select(
        F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("line_no"), F.when(F.col("l_returnflag") == "A", "section_header").otherwise("text").alias("type"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"), F.lit(10.0).alias("font_size"), F.lit(72.0).alias("x0"), y.cast("double").alias("y0"), F.lit(540.0).alias("x1"), (y + 10).cast("double").alias("y1"),
    )


def layout_merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_blocks(_lines(spark, sf_dir)).select("page_number", F.col("block_no").cast("bigint").alias("block_no"), "type", "text", "font_size", "is_bold", "n_lines", "x0", "y0", "x1", "y1")


LAYOUT_MERGE_BLOCKS = f"""
    WITH per AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
    placed AS (SELECT *, l_linenumber * 14.0::DOUBLE + CASE WHEN q > 35 THEN 9 ELSE 0 END AS y0 FROM per),
    typed AS (SELECT l_orderkey AS page_number, l_linenumber AS line_no, CASE WHEN f = 'A' THEN 'section_header' ELSE 'text' END AS type, 'line ' || l_linenumber AS text, 10.0::DOUBLE AS font_size, 72.0::DOUBLE AS x0, y0, 540.0::DOUBLE AS x1, y0 + 10 AS y1 FROM placed),
    {_MERGED}"""

QUERIES = {
    "finance_parse": finance_parse, "finance_scaled_total": finance_scaled_total, "finance_unit_inheritance": finance_unit_inheritance, "scale_precedence": scale_precedence,
    "scale_candidates_found": scale_candidates_found, "validate_reject_code": validate_reject_code, "validate_document_id": validate_document_id, "cache_hit_miss": cache_hit_miss,
    "typography_probe": typography_probe, "layout_lines": layout_lines, "layout_body_size": layout_body_size, "layout_merge_blocks": layout_merge_blocks,
    "scale_described": scale_described, "scale_parsed": scale_parsed, "layout_blocks": layout_blocks, "layout_failed_pages": layout_failed_pages,
}
ORACLES = {
    "finance_parse": FINANCE_PARSE, "finance_scaled_total": FINANCE_SCALED_TOTAL, "finance_unit_inheritance": FINANCE_UNIT_INHERITANCE, "scale_precedence": SCALE_PRECEDENCE,
    "scale_candidates_found": SCALE_CANDIDATES_FOUND, "validate_reject_code": VALIDATE_REJECT_CODE, "validate_document_id": VALIDATE_DOCUMENT_ID, "cache_hit_miss": CACHE_HIT_MISS,
    "typography_probe": TYPOGRAPHY_PROBE, "layout_lines": LAYOUT_LINES, "layout_body_size": LAYOUT_BODY_SIZE, "layout_merge_blocks": LAYOUT_MERGE_BLOCKS,
    "scale_described": SCALE_DESCRIBED, "scale_parsed": SCALE_PARSED, "layout_blocks": LAYOUT_BLOCKS, "layout_failed_pages": LAYOUT_FAILED_PAGES,
}
