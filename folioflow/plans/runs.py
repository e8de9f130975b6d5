"""Queries over evaluation runs, a model's items and grids, settings and admission, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.finance import looks_numeric, parse_values
from folioflow.operators import assemble, evaluate, mapping, report, runs, tables, validate
from folioflow.plans import evaluation, structure
from folioflow.session import distinct_rows, saved, table

K = ["doc_id", "page_number", "block_ord"]


# runs --------------------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the documents: one in thirteen fails, one in three comes from the cache, by the number of pages."""
    pages = assemble.raw_frames(spark, sf_dir)["pages"].groupBy("doc_id").agg(F.count("*").alias("n"))
    read = pages.filter("n % 13 <> 0").select("doc_id", F.lit(True).alias("ok"), (F.col("n") % 3 == 0).alias("from_cache"), (F.col("n") * 0.25).cast("double").alias("elapsed_s"), F.lit(None).cast("string").alias("error"))
    return read.unionByName(runs.failed_result(pages.filter("n % 13 = 0"), F.lit("ValueError"), F.concat(F.col("n").cast("string"), F.lit(" pages"))))


_RESULTS = """results AS (
        SELECT doc_id, n % 13 <> 0 AS ok, n % 13 <> 0 AND n % 3 = 0 AS from_cache, CASE WHEN n % 13 <> 0 THEN n * 0.25::DOUBLE ELSE 0 END AS elapsed_s, CASE WHEN n % 13 = 0 THEN 'ValueError: ' || n || ' pages' END AS error
        FROM (SELECT doc_id, count(*) AS n FROM pages GROUP BY 1)
    )"""


def run_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.roll_up(saved(_results(spark, sf_dir)), evaluation.structure_summary(spark, sf_dir), saved(evaluation.match_facts(spark, sf_dir)))


def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failures(_results(spark, sf_dir))


def run_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = saved(_results(spark, sf_dir))
    read = evaluation.match_facts(spark, sf_dir).join(results.filter("ok").select("doc_id"), "doc_id", "left_semi")
    return runs.causes_with_failures(report.causes(read, evaluation.structure_summary(spark, sf_dir)), results)


def run_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of documents with few pages are there already, with another time."""
    fresh = _results(spark, sf_dir)
    done = fresh.filter("elapsed_s < 1").withColumn("elapsed_s", F.lit(9.0))
    return runs.resumed(done, fresh)


def run_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.sources.results import pending

    fresh = _results(spark, sf_dir)
    return pending(fresh.select("doc_id", "ok"), fresh.filter("ok"), "doc_id")


def runs_incompatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that differ in the seed and the limit; the first field counts."""
    one = spark.sql("select 'layout' as backend, '1' as backend_version, 'dev' as split, 7 as seed, 10 as `limit`, false as force_ocr, 'x' as gold_sha256")
    return report.incompatible(one, one.withColumn("seed", F.lit(8)).withColumn("limit", F.lit(11)))


# evidence on scales -----------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, matches, cells)"""
    matches = saved(evaluation.match_facts(spark, sf_dir))
    return evaluation._verdicts(spark, sf_dir, False, matches), matches, assemble.raw_frames(spark, sf_dir)["cells"]


def scale_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, matches, cells = _scored(spark, sf_dir)
    return runs.corroborated(verdicts, matches, cells, evaluation._recorded(spark, sf_dir))


def scale_spurious_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, matches, cells = _scored(spark, sf_dir)
    candidates = table(spark, sf_dir, "scale_candidates").filter("scale is not null").groupBy(*K).agg(F.min_by(F.struct("source", "label"), "candidate_ord").alias("c")).select(*K, "c.*")
    return runs.spurious_labels(verdicts, matches, cells, candidates)


def scale_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, matches, cells = _scored(spark, sf_dir)
    several = table(spark, sf_dir, "scale_candidates").groupBy(*K).agg(F.countDistinct("scale").alias("n")).filter("n > 1")
    return runs.buckets(verdicts, matches, runs.first_tables(matches, cells), several)


# a model's items and grids ------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as a model's items: one in nine has lost its page, one in ten tables its size."""
    raw = assemble.raw_frames(spark, sf_dir)
    sized = raw["tables"].select("block_key", "n_rows", "n_cols", F.lit(True).alias("has_grid"))
    joined = raw["blocks"].select("block_key", "doc_id", "page_number", "block_ord", "type", "text").join(sized, "block_key", "left")
    label = F.when(F.col("type") == "table", "table").when(F.col("block_ord") % 6 == 5, "picture").otherwise(F.upper("type"))
    return joined.select(
        "doc_id", F.when(F.col("block_key") % 9 == 0, F.lit(0)).when(F.col("block_key") % 9 == 1, None).otherwise(F.col("page_number")).alias("page_number"), F.col("block_ord").alias("item_ord"), label.alias("label"),
        "text", "has_grid", F.when(F.col("block_key") % 10 == 3, 0).otherwise(F.col("n_rows")).alias("n_rows"), "n_cols",
    )


_ITEMS = """items AS (
        SELECT b.doc_id, CASE b.block_key % 9 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE b.page_number END AS page_number, b.block_ord AS item_ord, CASE WHEN type = 'table' THEN 'table' WHEN b.block_ord % 6 = 5 THEN 'picture' ELSE type END AS kind,
            b.text, t.block_key IS NOT NULL AS has_grid, CASE WHEN b.block_key % 10 = 3 THEN 0 ELSE t.n_rows END AS n_rows, t.n_cols
        FROM blocks b LEFT JOIN tabs t ON b.block_key = t.block_key
    )"""


def item_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, _ = mapping.walk_items(_items(spark, sf_dir))
    return blocks.select("doc_id", "page_number", "item_ord", "type", F.length("text").cast("bigint").alias("n_chars"))


def item_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.walk_items(_items(spark, sf_dir))[1]


def warnings_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' warnings beside one that no contract knows."""
    warnings = mapping.walk_items(_items(spark, sf_dir))[1]
    other = warnings.withColumn("code", F.lit("MODEL_RELOADED"))
    return mapping.known_warnings(warnings.unionByName(other)).groupBy("code").agg(F.count("*").alias("warnings"))


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tables, cells) as a model gives them: offsets with ends, one cell in eleven without a place, one table in three without a size."""
    raw = assemble.raw_frames(spark, sf_dir)
    lost = F.col("cell_key") % 11 == 0
    cells = raw["cells"].select(
        *K, "cell_ord", "cell_key", F.when(~lost, F.col("row_idx")).alias("row_idx"), F.when(~lost, F.col("col_idx")).alias("col_idx"), (F.col("row_idx") + F.col("row_span")).alias("row_end"), (F.col("col_idx") + F.col("col_span")).alias("col_end"),
        "row_span", "col_span", "text", (F.col("row_idx") == 0).alias("column_header"), F.when(F.col("col_idx") == 0, True).alias("row_header"),
    )
    return raw["tables"].select(*K, F.when(F.col("block_ord") % 3 == 0, 0).otherwise(F.col("n_rows")).alias("n_rows"), "n_cols", F.concat(F.lit("  "), "caption", F.lit(" ")).alias("caption")), cells


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.raw_cells(_grid(spark, sf_dir)[1], K).withColumn("cell_no", F.col("cell_no").cast("bigint"))


def grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.raw_tables(*_grid(spark, sf_dir), K)


def page_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor from a model's page width, which is half as wide, missing or nothing."""
    pages = assemble.raw_frames(spark, sf_dir)["pages"]
    model = F.when(F.col("page_number") % 3 == 0, F.col("width") / 2).when(F.col("page_number") % 3 == 1, 0.0)
    return pages.select("doc_id", "page_number", mapping.page_scale(F.col("width"), model).alias("factor"))


def fonts_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the fonts of a probe that found glyphs in two of three."""
    blocks = assemble.raw_frames(spark, sf_dir)["blocks"].select("block_key", "type", "font_size", "is_bold", "block_ord")
    fonts = blocks.select("block_key", (F.col("block_ord") + 6.5).cast("double").alias("font_size"), F.lit(True).alias("is_bold"), (F.col("block_key") % 3).alias("n_glyphs"))
    return mapping.measured(blocks.drop("block_ord"), fonts, ["block_key"]).select("block_key", "font_size", "is_bold")


def items_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.unplaced_warning(_items(spark, sf_dir)).select("doc_id", "code", "message")


# documents -----------------------------------------------------------------------------


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each gold document and the one after it, which may not be there."""
    gold = distinct_rows(table(spark, sf_dir, "gold_documents"), ["doc_uid", "page"]).select(F.col("doc_uid").alias("doc_id"), F.explode(F.array("page", F.col("page") + 1)).alias("page_number")).distinct()
    pages = assemble.raw_frames(spark, sf_dir)["pages"].select("doc_id", "page_number", "width", "height")
    return assemble.looked_up(gold, pages, ["doc_id", "page_number"], ["width"])


def table_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished document says around each table: its caption and the texts before it, the nearest first."""
    raw = assemble.raw_frames(spark, sf_dir)
    said = tables.scale_sources(raw["tables"], raw["cells"], structure._ordered(spark, sf_dir)).filter("source = 'preceding_text'")
    before = said.groupBy(*K).agg(F.sort_array(F.collect_list(F.struct("src_ord", F.trim("text").alias("text")))).alias("b"))
    joined = raw["tables"].select(*K, mapping.caption(F.col("caption")).alias("caption")).join(before, K, "left")
    return joined.select(*K, "caption", F.size(F.coalesce("b", F.array())).cast("bigint").alias("n_before"), F.get("b", 0)["src_ord"].cast("bigint").alias("nearest"))


def type_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, documents, characters and bold share of each type."""
    blocks = assemble.raw_frames(spark, sf_dir)["blocks"]
    return blocks.groupBy("type").agg(
        F.count("*").alias("blocks"), F.countDistinct("doc_id").alias("documents"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.round(F.avg(F.col("is_bold").cast("int")), 4).alias("bold_share"), F.count_if(F.col("bbox").isNull()).alias("without_box"),
    )


def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that look like figures, by page."""
    cells = assemble.raw_frames(spark, sf_dir)["cells"]
    read = parse_values(cells.select("text").distinct(), F.col("text")).select("text", looks_numeric(F.col("value")).alias("numeric"))
    return cells.select("doc_id", "page_number", "text").join(read, "text").groupBy("doc_id", "page_number").agg(F.count_if("numeric").alias("numeric"), F.count("*").alias("cells"))


def cell_values_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells' values under the scales recorded for their tables."""
    units = evaluation._recorded(spark, sf_dir).withColumn("currency", F.lit(None).cast("string"))
    cells = assemble.raw_frames(spark, sf_dir)["cells"].select("cell_key", *K, "text", "is_header")
    return tables.cell_values(cells, units).select("cell_key", "value.num", "value.scaled", "value.is_dash")


def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nested document holds."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    n_blocks = F.aggregate("pages", F.lit(0), lambda a, p: a + F.coalesce(F.size(p["blocks"]), F.lit(0))).cast("bigint")
    n_warnings = F.when(F.col("warnings").isNull(), 0).otherwise(F.size("warnings")).cast("bigint")
    nested = structure.nested_document(spark, sf_dir)
    lists = {c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint") for c in ("sections", "tables")}
    return nested.select("doc_id", size("pages").alias("pages"), n_blocks.alias("blocks"), *[v.alias(k) for k, v in lists.items()], n_warnings.alias("warnings"), "contract_version")


def stable_hash_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second run, with another account of its processing, has the same hash."""
    parts = structure.document_parts(spark, sf_dir)
    once, again = (assemble.stable_hash(parts.withColumn("processing", F.lit(x))) for x in ("first", "second"))
    return once.unionByName(again).groupBy("doc_id").agg(((F.count("*") == 2) & (F.min("stable_hash") == F.max("stable_hash"))).alias("same"))


def gold_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = evaluation._questions(spark, sf_dir)
    return q.select("question_key", evaluate.gold_factor(F.col("scale")).alias("factor"))


# admission -------------------------------------------------------------------------------


def open_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader says of uploads that it cannot open, and the error body of each."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 4 == 0, "Failed: incorrect Password").when(F.col("event_id") % 4 == 1, "unsupported ENCRYPTION").otherwise("Data format error.")
    rejected = e.select(F.col("event_id").cast("string").alias("document_id"), validate.open_error(said).alias("reject"), F.when(F.col("event_id") % 4 > 1, said).alias("reason"))
    return validate.error_bodies(rejected)


def settings_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as settings, many of them beyond what is allowed."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_linenumber").cast("int").alias("n"))
    s = li.select(
        "l_orderkey", (F.col("q") * 1500 - 1500).alias("port"), (F.col("q") - 3).alias("max_upload_mb"), F.lit(None).cast("int").alias("max_pages"), (F.col("n") - 2).alias("text_density_threshold"), (F.col("n") / 4).alias("low_confidence_threshold"),
        F.lit(300).alias("render_dpi"), (F.col("n") - 1).alias("threads"), F.when(F.col("n") % 2 == 0, "fast").when(F.col("n") == 3, "quick").otherwise("accurate").alias("table_mode"),
    )
    return validate.settings_errors(s).select("l_orderkey", F.array_join("errors", ",").alias("errors"))


QUERIES = {
    f.__name__: f
    for f in (
        run_roll_up, run_failures, run_causes, run_resumed, run_pending, runs_incompatible, scale_corroborated, scale_spurious_labels, scale_buckets, item_blocks, item_warnings, warnings_known, grid_cells, grid_tables, page_scales, fonts_measured,
        items_unplaced, page_lookup, table_context, type_statistics, numeric_cells, cell_values_recorded, nested_counts, stable_hash_holds, gold_factors, open_errors, settings_errors,
    )
}

_RUN = f"{evaluation._STRUCTURE}, {_RESULTS}, per AS (SELECT doc_id, question_key, count(*) AS facts, count(*) FILTER (found) AS found, count(*) FILTER (found AND candidates = 1) AS unique_facts, count(*) FILTER (outcome LIKE 'table_%') AS in_tables FROM matches JOIN results USING (doc_id) WHERE ok GROUP BY 1, 2)"
_FIRST = """firsts AS (SELECT m.question_key, arg_min(c.cell_key, m.fact_ord) AS cell_key FROM matches m JOIN cells c ON c.cell_key = m.cell_key GROUP BY 1),
    first_tables AS (SELECT question_key, doc_id, page_number, block_ord FROM firsts JOIN cells USING (cell_key))"""
_TOTALS = {
    "documents": "n", "documents_ok": "n_ok", "documents_failed": "n - n_ok", "cached_documents": "cached", "parsed_documents": "n_ok - cached", "parse_seconds": "seconds", "pages": "pages", "blocks": "blocks", "furniture": "furniture", "tables": "tables", "scaled_tables": "scaled",
    "cells": "cells", "parsed_numbers": "parsed", "questions": "questions", "supported": "supported", "facts": "facts", "found": "found", "unique_facts": "unique_facts", "in_tables": "in_tables", "seconds_per_document": "round(coalesce(seconds / nullif(n_ok - cached, 0), 0), 3)",
    "seconds_per_page": "round(coalesce(seconds / nullif(pages, 0), 0), 3)", "fact_recall": "round(coalesce(100.0::DOUBLE * found / nullif(facts, 0), 0), 3)", "question_support": "round(coalesce(100.0::DOUBLE * supported / nullif(questions, 0), 0), 3)",
    "unique_rate": "round(coalesce(100.0::DOUBLE * unique_facts / nullif(found, 0), 0), 3)", "parsed_number_rate": "round(coalesce(100.0::DOUBLE * parsed / nullif(cells, 0), 0), 3)", "table_fact_share": "round(coalesce(100.0::DOUBLE * in_tables / nullif(found, 0), 0), 3)",
}
ORACLES = {
    "run_roll_up": f"""WITH {_RUN}, t AS (
            SELECT * FROM (SELECT count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (from_cache) AS cached, coalesce(sum(elapsed_s) FILTER (ok AND NOT from_cache), 0) AS seconds FROM results),
            (SELECT coalesce(sum(pages), 0) AS pages, coalesce(sum(blocks), 0) AS blocks, coalesce(sum(furniture), 0) AS furniture, coalesce(sum(tables), 0) AS tables, coalesce(sum(scaled_tables), 0) AS scaled, coalesce(sum(cells), 0) AS cells, coalesce(sum(parsed_numbers), 0) AS parsed FROM structure JOIN results USING (doc_id) WHERE ok),
            (SELECT count(*) AS questions, count(*) FILTER (facts = found) AS supported, coalesce(sum(facts), 0) AS facts, coalesce(sum(found), 0) AS found, coalesce(sum(unique_facts), 0) AS unique_facts, coalesce(sum(in_tables), 0) AS in_tables FROM per)
        ) {" UNION ALL ".join(f"SELECT '{k}' AS metric, ({v})::DOUBLE AS value FROM t" for k, v in _TOTALS.items())}""",
    "run_failures": f"WITH {structure._RAW}, {_RESULTS} SELECT doc_id, error FROM results WHERE NOT ok",
    "run_causes": f"""WITH {_RUN} SELECT CASE WHEN outcome = 'furniture_only' THEN 'demoted_to_furniture' WHEN failed_pages > 0 THEN 'page_extraction_failed' WHEN numeric AND coalesce(tables, 0) = 0 THEN 'no_tables_recovered' WHEN numeric THEN 'table_found_cell_missed' ELSE 'prose_not_matched' END AS cause,
            count(*) AS facts FROM matches m JOIN results r USING (doc_id) LEFT JOIN structure s USING (doc_id) WHERE ok AND outcome IN ('furniture_only', 'not_found') GROUP BY 1
        UNION ALL SELECT 'document_failed', n FROM (SELECT count(*) FILTER (NOT ok) AS n FROM results) WHERE n > 0""",
    "run_resumed": f"WITH {structure._RAW}, {_RESULTS} SELECT doc_id, ok, from_cache, CASE WHEN elapsed_s < 1 THEN 9.0::DOUBLE ELSE elapsed_s END AS elapsed_s, error, elapsed_s < 1 AS replayed FROM results",
    "run_pending": f"WITH {structure._RAW}, {_RESULTS} SELECT doc_id, ok FROM results WHERE NOT ok",
    "runs_incompatible": "SELECT 'seed' AS field",
    "scale_corroborated": f"""WITH {evaluation._MATCHES}, {evaluation._ALL}, {_FIRST},
        stated AS (SELECT DISTINCT c.doc_id, c.page_number, c.block_ord, v.factor FROM all_run v JOIN matches m USING (question_key) JOIN cells c ON c.cell_key = m.cell_key WHERE v.factor > 1.0),
        doubted AS (SELECT f.*, s.scale FROM all_run v JOIN first_tables f USING (question_key) JOIN all_run_scales s ON s.doc_id = f.doc_id AND s.page_number = f.page_number AND s.block_ord = f.block_ord WHERE verdict = 'spurious')
        SELECT CASE WHEN list_contains(factors, scale::DOUBLE) THEN 'confirmed' WHEN factors IS NOT NULL THEN 'contradicted' ELSE 'none' END AS evidence, count(*) AS questions
        FROM doubted d LEFT JOIN (SELECT doc_id, page_number, block_ord, list(factor::DOUBLE) AS factors FROM stated GROUP BY 1, 2, 3) s USING (doc_id, page_number, block_ord) GROUP BY 1""",
    "scale_spurious_labels": f"""WITH {evaluation._MATCHES}, {evaluation._ALL}, {_FIRST},
        declared AS (SELECT doc_id, page_number, block_ord, arg_min(source, candidate_ord) AS source, lower(arg_min(label, candidate_ord)) AS label FROM scale_candidates WHERE scale IS NOT NULL GROUP BY 1, 2, 3)
        SELECT source, label, count(*) AS questions FROM all_run v JOIN first_tables f USING (question_key) JOIN declared d USING (doc_id, page_number, block_ord) WHERE verdict = 'spurious' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 8""",
    "scale_buckets": f"""WITH {evaluation._MATCHES}, {evaluation._ALL}, {_FIRST},
        several AS (SELECT doc_id, page_number, block_ord FROM scale_candidates GROUP BY 1, 2, 3 HAVING count(DISTINCT scale) > 1), doubtful AS (SELECT question_key FROM first_tables SEMI JOIN several USING (doc_id, page_number, block_ord)),
        lost AS (SELECT DISTINCT question_key FROM matches WHERE NOT found),
        named AS (SELECT CASE WHEN verdict IN ('correct', 'missed', 'wrong') AND question_key IN (SELECT question_key FROM doubtful) THEN 'D_ambiguous' WHEN verdict = 'correct' THEN 'A_correct' WHEN verdict = 'missed' THEN 'B_missed' WHEN verdict = 'wrong' THEN 'C_wrong'
            WHEN verdict = 'spurious' THEN 'E_spurious' WHEN question_key IN (SELECT question_key FROM lost) THEN 'F_numeric' END AS bucket FROM all_run)
        SELECT bucket, count(*) AS questions FROM named WHERE bucket IS NOT NULL GROUP BY 1""",
    "item_blocks": f"""WITH {structure._RAW}, {_ITEMS}, typed AS (SELECT *, CASE WHEN has_grid OR kind = 'table' THEN 'table' WHEN kind = 'picture' THEN 'figure' ELSE kind END AS type, CASE WHEN has_grid THEN '' ELSE {structure._strip("coalesce(text, '')")} END AS said FROM items WHERE page_number > 0)
        SELECT doc_id, page_number, item_ord, type, length(said) AS n_chars FROM typed WHERE type IN ('table', 'figure') OR said <> ''""",
    "item_warnings": f"""WITH {structure._RAW}, {_ITEMS} SELECT doc_id, 'PAGE_EXTRACTION_FAILED' AS code, count(*) || ' items without a page' AS message, NULL::INT AS page FROM items WHERE page_number IS NULL OR page_number <= 0 GROUP BY 1
        UNION ALL SELECT doc_id, 'TABLE_STRUCTURE_UNCERTAIN', 'a table without rows or columns', page_number FROM items WHERE page_number > 0 AND has_grid AND (coalesce(n_rows, 0) = 0 OR coalesce(n_cols, 0) = 0)""",
    "warnings_known": f"""WITH {structure._RAW}, {_ITEMS} SELECT 'PAGE_EXTRACTION_FAILED' AS code, count(DISTINCT doc_id) AS warnings FROM items WHERE page_number IS NULL OR page_number <= 0 HAVING count(*) > 0
        UNION ALL SELECT 'TABLE_STRUCTURE_UNCERTAIN', count(*) FROM items WHERE page_number > 0 AND has_grid AND (coalesce(n_rows, 0) = 0 OR coalesce(n_cols, 0) = 0) HAVING count(*) > 0""",
    "items_unplaced": f"WITH {structure._RAW}, {_ITEMS} SELECT doc_id, 'PAGE_EXTRACTION_FAILED' AS code, count(*) || ' items without a page' AS message FROM items WHERE page_number IS NULL OR page_number <= 0 GROUP BY 1",
    "grid_cells": f"""WITH {structure._RAW} SELECT doc_id, page_number, block_ord, row_number() OVER (PARTITION BY doc_id, page_number, block_ord ORDER BY row_idx, col_idx, cell_ord) - 1 AS cell_no, cell_ord, row_idx, col_idx, coalesce(text, '') AS text,
            CASE WHEN row_span > 0 THEN row_span ELSE 1 END AS row_span, CASE WHEN col_span > 0 THEN col_span ELSE 1 END AS col_span, row_idx = 0 OR col_idx = 0 AS is_header FROM cells WHERE cell_key % 11 <> 0""",
    "grid_tables": f"""WITH {structure._RAW}, ends AS (SELECT doc_id, page_number, block_ord, max(row_idx + row_span) AS r, max(col_idx + col_span) AS c FROM cells GROUP BY 1, 2, 3)
        SELECT doc_id, page_number, block_ord, CASE WHEN block_ord % 3 = 0 OR coalesce(n_rows, 0) = 0 OR coalesce(n_cols, 0) = 0 THEN coalesce(r, 0) ELSE n_rows END AS n_rows, CASE WHEN block_ord % 3 = 0 OR coalesce(n_rows, 0) = 0 OR coalesce(n_cols, 0) = 0 THEN coalesce(c, 0) ELSE n_cols END AS n_cols,
            nullif({structure._strip("caption")}, '') AS caption FROM tabs LEFT JOIN ends USING (doc_id, page_number, block_ord)""",
    "page_scales": f"WITH {structure._RAW} SELECT doc_id, page_number, CASE WHEN width > 0 AND page_number % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM pages",
    "fonts_measured": f"""WITH {structure._RAW} SELECT block_key, CASE WHEN type <> 'table' AND block_key % 3 > 0 THEN block_ord + 6.5::DOUBLE ELSE font_size END AS font_size, CASE WHEN type <> 'table' AND block_key % 3 > 0 THEN true ELSE is_bold END AS is_bold FROM blocks""",
    "page_lookup": f"""WITH {structure._RAW}, wanted AS (SELECT DISTINCT doc_uid AS doc_id, unnest([page, page + 1]) AS page_number FROM gold_documents) SELECT doc_id, page_number, width, height FROM wanted LEFT JOIN pages USING (doc_id, page_number)""",
    "table_context": f"""WITH {structure._WINDOW}, b AS (SELECT doc_id, page_number, block_ord, count(*) AS n, min(off) AS nearest FROM before GROUP BY 1, 2, 3)
        SELECT doc_id, page_number, block_ord, nullif({structure._strip("caption")}, '') AS caption, coalesce(n, 0) AS n_before, nearest FROM tabs LEFT JOIN b USING (doc_id, page_number, block_ord)""",
    "type_statistics": f"WITH {structure._RAW} SELECT type, count(*) AS blocks, count(DISTINCT doc_id) AS documents, sum(length(coalesce(text, '')))::BIGINT AS chars, round(avg(is_bold::INT), 4) AS bold_share, count(*) FILTER (bbox IS NULL) AS without_box FROM blocks GROUP BY 1",
    "numeric_cells": f"WITH {evaluation._MATCHES} SELECT doc_id, page_number, count(*) FILTER (num IS NOT NULL) AS numeric, count(*) AS cells FROM cells LEFT JOIN cell_num USING (text) WHERE text IS NOT NULL GROUP BY 1, 2",
    "cell_values_recorded": f"""WITH {evaluation._MATCHES}, {evaluation._ALL} SELECT cell_key, n.num, CASE WHEN pct THEN n.num ELSE n.num * coalesce(s.scale, 1.0)::DOUBLE END AS scaled, CASE WHEN n.is_dash THEN true WHEN n.num IS NOT NULL THEN false END AS is_dash
        FROM cells c LEFT JOIN all_run_scales s ON s.doc_id = c.doc_id AND s.page_number = c.page_number AND s.block_ord = c.block_ord LEFT JOIN cell_num n ON n.text = c.text AND NOT coalesce(c.is_header, false)""",
    "nested_counts": f"""WITH RECURSIVE {structure._HEADS}, p AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (ocr_confidence < 0.75) AS low, count(*) FILTER (extraction_source = 'failed') AS failed FROM pages GROUP BY 1)
        SELECT p.doc_id, p.pages, coalesce(b.n, 0) AS blocks, coalesce(h.n, 0) AS sections, coalesce(t.n, 0) AS tables, low + failed + CASE WHEN b.n > 0 AND h.n IS NULL THEN 1 ELSE 0 END AS warnings, '1.0' AS contract_version FROM p
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM placed GROUP BY 1) b USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM heads GROUP BY 1) h USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM tabs GROUP BY 1) t USING (doc_id)""",
    "stable_hash_holds": "SELECT DISTINCT doc_id, true AS same FROM raw_pages",
    "gold_factors": "SELECT DISTINCT question_key, CASE lower(trim(coalesce(scale, ''))) WHEN '' THEN 1.0::DOUBLE WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 END AS factor FROM gold_questions",
    "open_errors": """SELECT CASE WHEN event_id % 4 < 2 THEN 'ENCRYPTED_PDF' ELSE 'INVALID_PDF' END AS error_code, CASE WHEN event_id % 4 < 2 THEN 'encrypted pdf' ELSE 'invalid pdf' END AS message, event_id::VARCHAR AS document_id,
            CASE WHEN event_id % 4 > 1 THEN '{"reason":"Data format error."}' END AS detail FROM events""",
    "settings_errors": """WITH s AS (SELECT l_orderkey, max(l_quantity)::INT AS q, max(l_linenumber)::INT AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey, coalesce(concat_ws(',', CASE WHEN q * 1500 - 1500 NOT BETWEEN 1 AND 65535 THEN 'port' END, CASE WHEN q - 3 < 1 THEN 'max_upload_mb' END, CASE WHEN n - 2 < 0 THEN 'text_density_threshold' END, CASE WHEN n / 4.0 > 1 THEN 'low_confidence_threshold' END,
            CASE WHEN n - 1 < 1 THEN 'threads' END, CASE WHEN n = 3 THEN 'table_mode' END), '') AS errors FROM s""",
}
