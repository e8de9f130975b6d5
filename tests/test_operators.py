"""Small documents through the structural operators."""

from pyspark.sql import functions as F

from folioflow.operators import furniture, headings, reading_order, scale, tables, validate
from folioflow.sources import cache, registry, results

BLOCK = "block_key bigint, doc_id string, page_number int, block_ord int, type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double"
PAGE = "doc_id string, page_number int, width double, height double"


def block(key, page, ord_, type_, text, box, size=None, doc="d"):
    return (key, doc, page, ord_, type_, text, box, size)


def test_furniture(spark):
    rows = [block(10 * p, p, 0, "text", f"Report page {p}", (72.0, 20.0, 540.0, 32.0)) for p in range(1, 5)] + [block(10 * p + 1, p, 1, "text", f"Body {p}", (72.0, 300.0, 540.0, 320.0)) for p in range(1, 5)]
    rows += [block(99, 1, 2, "table", "", (72.0, 20.0, 540.0, 32.0)), block(98, 1, 3, "text", None, None)]
    pages = spark.createDataFrame([("d", p, 612.0, 792.0) for p in range(1, 5)], PAGE)
    out = {r["block_key"]: r["type"] for r in furniture.reclassify(spark.createDataFrame(rows, BLOCK), pages).collect()}
    assert {k for k, t in out.items() if t == "page_header"} == {10, 20, 30, 40}
    assert out[99] == "table" and out[11] == "text" and out[98] == "text"
    one = pages.filter("page_number = 1")
    assert furniture.find_furniture(spark.createDataFrame(rows[:1], BLOCK), one).count() == 0


def test_two_columns(spark):
    rows = [block(i, 1, i, "text", f"R{i}", (320.0, 50.0 + 100 * i, 540.0, 90.0 + 100 * i)) for i in range(4)] + [block(4 + i, 1, 4 + i, "text", f"L{i}", (72.0, 50.0 + 100 * i, 290.0, 90.0 + 100 * i)) for i in range(4)]
    rows.append(block(9, 1, 9, "section_header", "Wide", (72.0, 10.0, 540.0, 30.0)))
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0)], PAGE)
    blocks = spark.createDataFrame(rows, BLOCK)
    order = [r["text"] for r in reading_order.order_blocks(blocks, pages).orderBy("order_index").collect()]
    assert order == ["Wide", "L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3"]
    order = [r["text"] for r in reading_order.order_blocks(blocks, pages, rtl=True).orderBy("order_index").collect()]
    assert order[:2] == ["Wide", "R0"]


def test_heading_levels_and_sections(spark):
    sizes = [("title", "Report", 20.0), ("section_header", "1. One", 14.0), ("section_header", "1.1 Sub", 14.0), ("section_header", "Unmeasured", None), ("section_header", "2. Two", 14.2), ("section_header", "Small", 13.0)]
    rows = [block(i, 1 + i // 3, i, t, text, (72.0, 50.0 * (i + 1), 540.0, 50.0 * (i + 1) + 20), s) for i, (t, text, s) in enumerate(sizes)]
    pages = spark.createDataFrame([("d", p, 612.0, 792.0) for p in (1, 2)], PAGE)
    ordered = reading_order.order_blocks(spark.createDataFrame(rows, BLOCK), pages)
    levels = headings.assign_levels(headings.heading_rows(ordered))
    assert [r["level"] for r in levels.orderBy("i").collect()] == [1, 2, 3, 3, 2, 3]
    sections = headings.build_sections(levels)
    got = {r["section_id"]: (r["parent_section_id"], r["path"]) for r in sections.collect()}
    assert got["s002"] == ("s001", ["Report", "1. One", "1.1 Sub"]) and got["s004"][0] == "s000" and got["s005"][0] == "s004"
    ends = {r["section_id"]: r["page_end"] for r in headings.section_pages(sections, headings.section_of_blocks(ordered, sections)).collect()}
    assert ends["s000"] == 2 and ends["s001"] == 2 and ends["s002"] == 1


def test_greedy_size_ranks(spark):
    rows = spark.createDataFrame([("d", s) for s in (14.0, 13.5, 13.0, 20.0)], "doc_id string, font_size double")
    ranks = {r["font_size"]: r["size_rank"] for r in headings.size_ranks(rows).collect()}
    assert ranks == {20.0: 1, 14.0: 2, 13.5: 2, 13.0: 3}


def test_scale(spark):
    rows = [
        (1, "caption", 0, "(in millions)"), (1, "header", 0, "in thousands"), (2, "header", 0, "in thousands"), (2, "header", 1, "in millions"), (2, "header", 2, "in millions"),
        (3, "preceding_text", 1, "Revenue rose by $5 million."), (4, "preceding_text", 1, "Amounts are stated in thousands."), (5, "row_stem", 0, "RMB'Million"), (6, "caption", 0, "European sales"),
    ]
    out = {r["k"]: (r["scale"], r["currency"], r["scale_source"], r["ambiguous"]) for r in scale.detect_scale(spark.createDataFrame(rows, "k int, source string, src_ord int, text string"), ["k"]).collect()}
    assert out[1] == (1e6, None, "caption", False)
    assert out[2] == (1e6, None, "header", True)
    assert out[3] == (1.0, None, None, False)
    assert out[4] == (1e3, None, "preceding_text", False)
    assert out[5] == (1e6, "CNY", "row_stem", False)
    assert out[6] == (1.0, "EUR", None, False)


def test_table(spark):
    t = spark.createDataFrame([("d", 1, 0, 3, 3, 1, 1)], "doc_id string, page_number int, block_ord int, n_rows int, n_cols int, header_rows int, header_cols int")
    grid = [["", "2019", "2018"], ["Current | federal", "1,234", "(567)"], ["Deferred", "890", "—"]]
    cells = [("d", 1, 0, 3 * i + j, i, j, x, 1, 1, i == 0 or j == 0, 100 * i + j) for i, r in enumerate(grid) for j, x in enumerate(r)]
    c = spark.createDataFrame(cells, "doc_id string, page_number int, block_ord int, cell_ord int, row_idx int, col_idx int, text string, row_span int, col_span int, is_header boolean, cell_key bigint")
    dense = tables.grid(t, c)
    assert tables.markdown(t, dense).first()["markdown"].split("\n")[:3] == ["|  | 2019 | 2018 |", "| --- | --- | --- |", "| Current \\| federal | 1,234 | (567) |"]
    units = t.select(*tables.KEYS, F.lit(1e6).alias("scale"), F.lit("USD").alias("currency"))
    values = {r["cell_key"]: r["value"] for r in tables.cell_values(c, units).collect()}
    assert values[101]["scaled"] == 1234e6 and values[102]["num"] == -567 and values[202]["is_dash"] and values[1] is None
    found = tables.label_lookup(tables.row_headers(t, dense), tables.column_headers(t, dense), dense)
    assert found.filter("row_label = 'Deferred' and col_label = '2019'").first()["text"] == "890"
    empty = tables.grid(t.limit(0), c.limit(0))
    assert empty.count() == 0


def test_validation_and_cache(spark):
    rows = [(b"%PDF-1", "application/pdf", "", None, 1), (b"", "application/pdf", "", None, 1), (b"%PDF-1", "text/html", "", None, 1), (b"%PDF-1", None, "has space", None, 1), (b"%PDF-1", None, "ok\n", None, 1), (b"%PDF-1", None, None, '{"x": 1}', 1), (b"%PDF-1", None, None, None, 0)]
    out = validate.reject_code(spark.createDataFrame(rows, "content binary, content_type string, given_id string, options string, page_count int"))
    assert [r["reject"] for r in out.collect()] == [None, "INVALID_PDF", "UNSUPPORTED_MEDIA_TYPE", "INVALID_DOCUMENT_ID", "INVALID_DOCUMENT_ID", "INVALID_OPTIONS", "INVALID_PDF"]
    assert cache.cache_variant("textonly") == "textonly-p2" and cache.cache_variant("a", {"x": "1"}) != cache.cache_variant("a", {"x": "2"})
    assert registry.available() == ["parquet"]


def test_results_stop_at_the_first_broken_line(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    f.write_text('{"record":"run","backend":"b"}\n{"record":"document","document_uid":"x","ok":true}\n{"record":"docu\n{"record":"document","document_uid":"y"}\n')
    runs, docs = results.read_results(spark, str(f))
    assert runs.first()["backend"] == "b" and [r["document_uid"] for r in docs.collect()] == ["x"]


def test_stream_ingests_each_upload_once(spark, tmp_path):
    from folioflow.sources.uploads import stream_uploads
    from folioflow.streaming.ingest import ingest

    up, store = tmp_path / "up", tmp_path / "store"
    up.mkdir()
    (up / "a.pdf").write_bytes(b"%PDF-1 a")
    (up / "b.pdf").write_bytes(b"%PDF-1 a")
    (up / "c.pdf").write_bytes(b"no")
    for _ in range(2):
        ingest(stream_uploads(spark, str(up)).withColumn("page_count", F.lit(1)), str(store), str(tmp_path / "cp"), "v").awaitTermination(120)
    assert spark.read.parquet(str(store)).count() == 1
