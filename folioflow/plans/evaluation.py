"""Queries over the gold questions: facts matched, scales judged, results rolled up and compared."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.finance import DASH_WORDS, SYMBOLS
from folioflow.functions.text import DASHES, split_kind
from folioflow.operators import assemble, evaluate, furniture, report
from folioflow.plans import structure
from folioflow.session import distinct_rows, saved, table

K = ["doc_id", "page_number", "block_ord"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_rows(table(spark, sf_dir, "gold_questions"), ["question_key"])


def _recorded(spark: SparkSession, sf_dir: str, caption_only: bool = False) -> DataFrame:
    """The scale recorded for each table: that of its first candidate with one, 1 without."""
    c = table(spark, sf_dir, "scale_candidates").filter("scale is not null")
    c = c.filter("source = 'caption'") if caption_only else c
    first = c.groupBy(*K).agg(F.min_by("scale", "candidate_ord").alias("scale"))
    tabs = distinct_rows(table(spark, sf_dir, "raw_tables"), ["block_key"]).select(*K)
    return tabs.join(first, K, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def match_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = assemble.raw_frames(spark, sf_dir)
    return evaluate.match_facts(evaluate.fact_rows(_questions(spark, sf_dir)), raw["cells"], furniture.reclassify(raw["blocks"], raw["pages"]))


def match_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = match_facts(spark, sf_dir)
    return m.select("question_key", F.col("fact_ord").cast("bigint"), "outcome", "numeric", "candidates", evaluate.unique(F.col("outcome"), F.col("candidates")).alias("unique_hit"))


def match_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_facts(spark, sf_dir).select("question_key", F.col("fact_ord").cast("bigint"), "cell_key", "block_key")


def question_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.question_support(match_facts(spark, sf_dir)).drop("doc_id")


def _verdicts(spark: SparkSession, sf_dir: str, caption_only: bool = False, matches: DataFrame | None = None) -> DataFrame:
    cells = assemble.raw_frames(spark, sf_dir)["cells"]
    return evaluate.scale_verdicts(_questions(spark, sf_dir), match_facts(spark, sf_dir) if matches is None else matches, _recorded(spark, sf_dir, caption_only), cells)


def scale_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


def scale_verdict_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the scales the detector finds; several regexes of it are beyond SQL."""
    units = structure.table_units(spark, sf_dir)
    cells = assemble.raw_frames(spark, sf_dir)["cells"]
    v = evaluate.scale_verdicts(_questions(spark, sf_dir), match_facts(spark, sf_dir), units, cells)
    return v.groupBy("gold_scale", "verdict").agg(F.count("*").alias("questions"))


def scale_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scale_accuracy(_verdicts(spark, sf_dir))


def report_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rates(report.slices(_questions(spark, sf_dir), match_facts(spark, sf_dir)))


def report_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.outcome_counts(match_facts(spark, sf_dir))


def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = assemble.raw_frames(spark, sf_dir)
    from folioflow.operators.tables import cell_values

    units = _recorded(spark, sf_dir).withColumn("currency", F.lit(None).cast("string"))
    return evaluate.describe_structure(raw["pages"], furniture.reclassify(raw["blocks"], raw["pages"]), _recorded(spark, sf_dir), cell_values(raw["cells"], units))


def report_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.causes(match_facts(spark, sf_dir), structure_summary(spark, sf_dir))


def report_worst_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.worst_documents(evaluate.question_support(match_facts(spark, sf_dir)))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    matches = saved(match_facts(spark, sf_dir))
    return _verdicts(spark, sf_dir, True, matches), _verdicts(spark, sf_dir, False, matches)


def runs_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales from captions alone against scales from every source."""
    return report.transitions(*_runs(spark, sf_dir))


def runs_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _runs(spark, sf_dir)
    rows = before.withColumn("run", F.lit("caption")).unionByName(after.withColumn("run", F.lit("all")))
    metrics = rows.groupBy("run", F.col("verdict").alias("metric")).agg(F.count("*").alias("value"))
    return report.compare(metrics, ["caption", "all"]).na.fill(0)


def _split_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over different documents: those with a dev and those with a train page."""
    g = table(spark, sf_dir, "gold_documents").select(F.col("doc_uid").alias("doc_id"), split_kind(F.col("split_name")).alias("split"))
    return g.filter("split = 'dev'"), g.filter("split = 'train'")


def runs_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.common_documents(list(_split_runs(spark, sf_dir)))


def runs_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _split_runs(spark, sf_dir)
    return report.restrict(a, b).groupBy("doc_id").agg(F.count("*").alias("n_rows"))


def runs_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _split_runs(spark, sf_dir)
    return report.coverage({"dev": a, "train": b})


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.split_manifest(table(spark, sf_dir, "gold_documents"), table(spark, sf_dir, "gold_questions"))


def scale_by_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    return q.groupBy(F.lower(F.trim(F.coalesce("scale", F.lit("")))).alias("gold"), evaluate.gold_factor(F.col("scale")).alias("factor")).agg(F.count("*").alias("questions"))


QUERIES = {
    f.__name__: f
    for f in (
        match_outcomes, match_first_hit, question_support, scale_verdict, scale_verdict_detected, scale_accuracy, report_slices, report_outcomes, structure_summary, report_causes,
        report_worst_documents, runs_transition, runs_compare, runs_common, runs_restrict, runs_coverage, split_manifest, scale_by_gold,
    )
}


# SQL ---------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """The compatibility form by rule: single characters for translate, the longer ones of common blocks for replace."""
    one, other, long = [], [], []
    for cp in range(0x80, min(0x30000, sys.maxunicode)):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cs", "Cn", "Co"):
            continue
        to = unicodedata.normalize("NFKC", ch)
        if to != ch and len(to) == 1:
            one.append(ch)
            other.append(to)
        elif to != ch and (cp < 0x100 or 0x2000 <= cp < 0x2190 or 0xFB00 <= cp <= 0xFB06):
            long.append((ch, to))
    return "".join(one), "".join(other), long


def _nfkc_sql(text: str) -> str:
    one, other, long = _compatible()
    out = f"translate({text}, {_quoted(one)}, {_quoted(other)})"
    for ch, to in long:
        out = f"replace({out}, {_quoted(ch)}, {_quoted(to)})"
    return f"nfc_normalize({out})"


_WS = structure.WS


def _squeeze_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}+', ' ', 'g'))"


def _normal_sql(text: str) -> str:
    return _squeeze_sql(f"replace(lower(translate({_nfkc_sql(text)}, '{DASHES}', '{'-' * len(DASHES)}')), 'ß', 'ss')")


_MARK = r"\s*(?:\([0-9a-z]{1,3}\)|[*†‡§]{1,3})"


def _parse_sql(name: str, source: str) -> str:
    """CTEs that read the distinct ``text`` of ``source`` as figures: ``name`` has text and num."""
    code = "c"
    for sign in reversed(SYMBOLS):
        code = f"CASE WHEN starts_with(c, '{sign}') THEN trim(substr(c, 2)) WHEN ends_with(c, '{sign}') THEN trim(substr(c, 1, length(c) - 1)) ELSE {code} END"
    words = ", ".join(_quoted(w) for w in DASH_WORDS)
    return rf"""{name}_x AS (SELECT text, {_squeeze_sql(_nfkc_sql("text"))} AS x FROM (SELECT DISTINCT text FROM {source} WHERE text IS NOT NULL)),
    {name}_a AS (SELECT *, regexp_full_match(x, '[{DASHES}]+') OR lower(trim(x, ' .')) IN ({words}) AS dash,
        CASE WHEN regexp_matches(x, '(?i)^(.+?)((?:{_MARK})+)\s*$') THEN trim(regexp_extract(x, '(?i)^(.+?)((?:{_MARK})+)\s*$', 1)) ELSE x END AS a FROM {name}_x),
    {name}_b AS (SELECT *, regexp_full_match(a, '\(.*\)') AND length(a) > 2 AS outer_p FROM {name}_a),
    {name}_c AS (SELECT *, CASE WHEN outer_p THEN trim(substr(a, 2, length(a) - 2)) ELSE a END AS b FROM {name}_b),
    {name}_d AS (SELECT *, CASE WHEN ends_with(b, '%') THEN trim(substr(b, 1, length(b) - 1)) ELSE b END AS c FROM {name}_c),
    {name}_e AS (SELECT *, {code} AS d FROM {name}_d),
    {name}_f AS (SELECT *, NOT outer_p AND regexp_full_match(d, '\(.*\)') AND length(d) > 2 AS inner_p FROM {name}_e),
    {name}_g AS (SELECT *, CASE WHEN inner_p THEN trim(substr(d, 2, length(d) - 2)) ELSE d END AS e FROM {name}_f),
    {name} AS (SELECT text, x <> '' AND dash AS is_dash, ends_with(b, '%') AS pct, CASE WHEN x <> '' AND NOT dash AND regexp_full_match(e, '[+-]?(?:\d{{1,3}}(?:[, ]\d{{3}})+|\d+)(?:\.\d+)?')
        THEN CASE WHEN outer_p OR inner_p THEN -abs(replace(replace(e, ',', ''), ' ', '')::DOUBLE) ELSE replace(replace(e, ',', ''), ' ', '')::DOUBLE END END AS num FROM {name}_g)"""


_TOKEN = r"\(?\s?[$€£¥₩₹]?\s?[+-]?\d[\d,. ]*\d|\(?[$€£¥₩₹]?\s?[+-]?\d"
_EDGE = r"[\p{L}\p{N}\p{M}\p{Pc}]"
_MATCHES = f"""{structure._RELABELLED},
    questions AS (SELECT DISTINCT ON (question_key) * FROM gold_questions),
    flat AS (SELECT doc_uid AS doc_id, question_key, page, generate_subscripts(facts, 1) - 1 AS fact_ord, unnest(facts) AS text FROM questions),
    facts AS (SELECT * FROM flat WHERE text IS NOT NULL),
    {_parse_sql("fact_num", "facts")},
    fact_text AS (SELECT text, {_normal_sql("text")} AS needle FROM (SELECT DISTINCT text FROM facts)),
    asked AS (SELECT f.*, needle, num FROM facts f JOIN fact_num USING (text) JOIN fact_text USING (text)),
    {_parse_sql("cell_num", "cells")},
    cell_text AS (SELECT text, {_normal_sql("text")} AS needle FROM (SELECT DISTINCT text FROM cells WHERE text IS NOT NULL)),
    held AS (SELECT c.doc_id, c.page_number, c.block_ord, cell_ord, cell_key, t.needle, CASE WHEN NOT coalesce(is_header, false) THEN n.num END AS num FROM cells c JOIN cell_num n USING (text) JOIN cell_text t USING (text) WHERE t.needle <> ''),
    indexed AS (SELECT * FROM (SELECT doc_id, page_number, block_ord, block_key, type NOT IN ('page_header', 'page_footer') AS in_order, {_normal_sql("text")} AS haystack FROM relabelled WHERE text IS NOT NULL AND type <> 'table') WHERE haystack <> ''),
    tokens AS (SELECT doc_id, page_number, block_ord, block_key, in_order, unnest(regexp_extract_all(haystack, '{_TOKEN}')) AS text FROM indexed),
    {_parse_sql("token_num", "tokens")},
    prose AS (SELECT t.*, num FROM tokens t JOIN token_num USING (text) WHERE num IS NOT NULL),
    hits AS (
        SELECT a.question_key, a.fact_ord, 0 AS tier, cell_key, NULL::BIGINT AS block_key, h.page_number, h.block_ord, h.cell_ord AS ord FROM asked a JOIN held h ON a.doc_id = h.doc_id AND a.needle = h.needle WHERE a.needle <> ''
        UNION ALL SELECT a.question_key, a.fact_ord, 1, cell_key, NULL, h.page_number, h.block_ord, h.cell_ord FROM asked a JOIN held h ON a.doc_id = h.doc_id AND a.num IS NOT NULL AND abs(a.num - h.num) <= 1e-9 * greatest(abs(a.num), abs(h.num)) WHERE a.needle <> ''
        UNION ALL SELECT a.question_key, a.fact_ord, CASE WHEN in_order THEN 3 ELSE 4 END, NULL, block_key, p.page_number, p.block_ord, 0 FROM asked a JOIN prose p ON a.doc_id = p.doc_id AND a.num IS NOT NULL AND abs(a.num - p.num) <= 1e-9 * greatest(abs(a.num), abs(p.num)) WHERE a.needle <> ''
        UNION ALL SELECT a.question_key, a.fact_ord, CASE WHEN in_order THEN 2 ELSE 4 END, NULL, block_key, i.page_number, i.block_ord, 0 FROM asked a JOIN indexed i ON a.doc_id = i.doc_id AND a.num IS NULL AND length(a.needle) >= 4 AND contains(haystack, needle)
            AND regexp_matches(haystack, '(^|[^' || substr('{_EDGE}', 2) || ')' || regexp_escape(needle) || '($|[^' || substr('{_EDGE}', 2) || ')')
    ),
    best AS (SELECT question_key, fact_ord, min(tier) AS tier FROM hits GROUP BY ALL),
    won AS (SELECT h.question_key, h.fact_ord, h.tier, count(*) AS candidates, arg_min(cell_key, (page_number, block_ord, ord)) AS cell_key, arg_min(block_key, (page_number, block_ord, ord)) AS block_key FROM hits h JOIN best b ON h.question_key = b.question_key AND h.fact_ord = b.fact_ord AND h.tier = b.tier GROUP BY ALL),
    matches AS (
        SELECT a.doc_id, a.question_key, a.fact_ord::BIGINT AS fact_ord, ['table_cell_text', 'table_cell_value', 'block_text', 'block_text_value', 'furniture_only', 'not_found'][coalesce(w.tier, 5) + 1] AS outcome, a.num IS NOT NULL AS numeric, coalesce(candidates, 0) AS candidates, w.cell_key, w.block_key,
            coalesce(w.tier, 5) < 4 AS found FROM asked a LEFT JOIN won w ON a.question_key = w.question_key AND a.fact_ord = w.fact_ord
    )"""
_SUPPORT = f"{_MATCHES}, support AS (SELECT doc_id, question_key, count(*) AS facts, count(*) FILTER (found) AS found_count, bool_and(found) AS supported FROM matches GROUP BY ALL)"


def _verdict_sql(name: str, condition: str) -> str:
    return f"""{name}_scales AS (
            SELECT t.doc_id, t.page_number, t.block_ord, coalesce(arg_min(scale, candidate_ord), 1.0) AS scale FROM tabs t LEFT JOIN (SELECT * FROM scale_candidates WHERE scale IS NOT NULL AND {condition}) s
            ON s.doc_id = t.doc_id AND s.page_number = t.page_number AND s.block_ord = t.block_ord GROUP BY ALL
        ), {name}_of AS (
            SELECT question_key, list(DISTINCT scale) AS scales FROM matches m JOIN cells c ON c.cell_key = m.cell_key JOIN {name}_scales s ON s.doc_id = c.doc_id AND s.page_number = c.page_number AND s.block_ord = c.block_ord GROUP BY 1
        ), {name} AS (
            SELECT q.question_key, answer_type, q.scale AS gold_scale, CASE lower(trim(coalesce(q.scale, ''))) WHEN '' THEN 1.0 WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 END AS factor,
                CASE WHEN factor IS NULL OR scales IS NULL THEN 'unscorable' WHEN list_contains(scales, factor::DOUBLE) THEN 'correct' WHEN factor = 1.0 THEN 'spurious' WHEN len(list_filter(scales, lambda s: s <> 1.0)) = 0 THEN 'missed' ELSE 'wrong' END AS verdict
            FROM questions q LEFT JOIN {name}_of o ON o.question_key = q.question_key
        )"""


_ALL = _verdict_sql("all_run", "true")
_CAPTION = _verdict_sql("caption_run", "source = 'caption'")
_STRUCTURE = f"""{_MATCHES}, {_ALL}, structure AS (
        SELECT p.doc_id, p.pages, p.failed_pages, coalesce(b.blocks, 0) AS blocks, coalesce(b.furniture, 0) AS furniture, coalesce(t.tables, 0) AS tables, coalesce(t.scaled, 0) AS scaled_tables, coalesce(c.cells, 0) AS cells, coalesce(c.parsed, 0) AS parsed_numbers
        FROM (SELECT doc_id, count(*) AS pages, count(*) FILTER (extraction_source = 'failed') AS failed_pages FROM pages GROUP BY 1) p
        LEFT JOIN (SELECT doc_id, count(*) FILTER (type NOT IN ('page_header', 'page_footer')) AS blocks, count(*) FILTER (type IN ('page_header', 'page_footer')) AS furniture FROM relabelled GROUP BY 1) b USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS tables, count(*) FILTER (scale <> 1.0) AS scaled FROM all_run_scales GROUP BY 1) t USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS cells, count(*) FILTER (NOT coalesce(is_header, false) AND num IS NOT NULL) AS parsed FROM cells LEFT JOIN cell_num USING (text) GROUP BY 1) c USING (doc_id)
    )"""
_KIND = """CASE WHEN regexp_replace(lower(split_name), '[\\s_-]+', '', 'g') = 'train' THEN 'train' WHEN regexp_replace(lower(split_name), '[\\s_-]+', '', 'g') IN ('dev', 'validation') THEN 'dev'
    WHEN regexp_replace(lower(split_name), '[\\s_-]+', '', 'g') IN ('test', 'testgold') THEN 'test' END"""
_SPLITS = f"g AS (SELECT doc_uid AS doc_id, {_KIND} AS split FROM gold_documents)"
ORACLES = {
    "match_outcomes": f"WITH {_MATCHES} SELECT question_key, fact_ord, outcome, numeric, candidates, found AND candidates = 1 AS unique_hit FROM matches",
    "match_first_hit": f"WITH {_MATCHES} SELECT question_key, fact_ord, cell_key, block_key FROM matches",
    "question_support": f"WITH {_SUPPORT} SELECT question_key, facts, found_count, supported FROM support",
    "scale_verdict": f"WITH {_MATCHES}, {_ALL} SELECT question_key, answer_type, gold_scale, verdict FROM all_run",
    "scale_accuracy": f"""WITH {_MATCHES}, {_ALL}, s AS (SELECT count(*) FILTER (verdict <> 'unscorable') AS scorable, count(*) FILTER (verdict = 'correct') AS correct,
        count(*) FILTER (verdict <> 'unscorable' AND lower(trim(coalesce(gold_scale, ''))) IN ('thousand', 'million', 'billion')) AS declared, count(*) FILTER (verdict = 'correct' AND lower(trim(coalesce(gold_scale, ''))) IN ('thousand', 'million', 'billion')) AS declared_correct FROM all_run)
        SELECT *, round(100.0 * correct / nullif(scorable, 0), 2)::DOUBLE AS accuracy, round(100.0 * declared_correct / nullif(declared, 0), 2)::DOUBLE AS declared_accuracy FROM s""",
    "report_slices": f"""WITH {_SUPPORT}, r AS (SELECT answer_type, coalesce(s.facts, 0) AS facts, coalesce(found_count, 0) AS found, coalesce(supported, false) AS supported FROM questions q LEFT JOIN (SELECT question_key, facts, found_count, supported FROM support) s USING (question_key)),
        c AS (SELECT CASE WHEN grouping(answer_type) = 1 THEN 'overall' ELSE answer_type END AS answer_type, count(*) AS questions, count(*) FILTER (supported) AS supported, sum(facts)::BIGINT AS facts, sum(found)::BIGINT AS found FROM r GROUP BY GROUPING SETS ((), (answer_type)))
        SELECT answer_type, coalesce(questions, 0) AS questions, coalesce(supported, 0) AS supported, coalesce(facts, 0) AS facts, coalesce(found, 0) AS found, round(CASE WHEN facts > 0 THEN 100.0 * found / facts ELSE 0 END, 2)::DOUBLE AS fact_recall,
            round(CASE WHEN questions > 0 THEN 100.0 * supported / questions ELSE 0 END, 2)::DOUBLE AS question_support FROM c FULL JOIN (SELECT unnest(['overall', 'span', 'multi-span', 'arithmetic', 'count']) AS answer_type) s USING (answer_type)""",
    "report_outcomes": f"WITH {_MATCHES} SELECT outcome, count(*) AS facts, count(*) FILTER (found AND candidates = 1) AS unique_facts FROM matches GROUP BY outcome",
    "structure_summary": f"WITH {_STRUCTURE} SELECT doc_id, pages, failed_pages, blocks, furniture, tables, scaled_tables, cells, parsed_numbers FROM structure",
    "report_causes": f"""WITH {_STRUCTURE} SELECT CASE WHEN outcome = 'furniture_only' THEN 'demoted_to_furniture' WHEN failed_pages > 0 THEN 'page_extraction_failed' WHEN numeric AND coalesce(tables, 0) = 0 THEN 'no_tables_recovered' WHEN numeric THEN 'table_found_cell_missed' ELSE 'prose_not_matched' END AS cause,
        count(*) AS facts FROM matches LEFT JOIN structure USING (doc_id) WHERE NOT found GROUP BY 1""",
    "report_worst_documents": f"WITH {_SUPPORT} SELECT * FROM (SELECT doc_id, count(*) FILTER (NOT supported) AS unsupported FROM support GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) WHERE unsupported > 0",
    "runs_transition": f"""WITH {_MATCHES}, {_ALL}, {_CAPTION} SELECT b.verdict AS verdict_before, a.verdict AS verdict_after, count(*) AS questions,
        CASE WHEN a.verdict = 'correct' AND b.verdict <> 'correct' THEN 'recovered' WHEN b.verdict = 'correct' AND a.verdict <> 'correct' THEN 'regressed' ELSE 'same' END AS change FROM caption_run b JOIN all_run a USING (question_key) GROUP BY ALL""",
    "runs_compare": f"""WITH {_MATCHES}, {_ALL}, {_CAPTION}, r AS (SELECT verdict, 0 AS a, 1 AS c FROM caption_run UNION ALL SELECT verdict, 1, 0 FROM all_run) SELECT verdict AS metric, sum(c)::BIGINT AS caption, sum(a)::BIGINT AS "all" FROM r GROUP BY 1""",
    "runs_common": f"WITH {_SPLITS} SELECT doc_id FROM g WHERE split = 'dev' INTERSECT SELECT doc_id FROM g WHERE split = 'train'",
    "runs_restrict": f"WITH {_SPLITS} SELECT doc_id, count(*) AS n_rows FROM g WHERE split = 'dev' AND doc_id IN (SELECT doc_id FROM g WHERE split = 'train') GROUP BY 1",
    "runs_coverage": f"""WITH {_SPLITS}, n AS (SELECT (SELECT count(*) FROM (SELECT doc_id FROM g WHERE split = 'dev' INTERSECT SELECT doc_id FROM g WHERE split = 'train')) AS common)
        SELECT split AS run, count(DISTINCT doc_id) AS documents, common, count(DISTINCT doc_id) = common AS covered FROM g, n WHERE split IN ('dev', 'train') GROUP BY split, common""",
    "split_manifest": f"""WITH d AS (SELECT DISTINCT doc_uid, page, {_KIND} AS split FROM gold_documents), q AS (SELECT doc_uid, page, count(DISTINCT question_key) AS n FROM gold_questions GROUP BY 1, 2)
        SELECT split, count(DISTINCT doc_uid) AS documents, sum(coalesce(n, 0))::BIGINT AS questions FROM d LEFT JOIN q USING (doc_uid, page) GROUP BY split""",
    "scale_by_gold": """SELECT lower(trim(coalesce(scale, ''))) AS gold, CASE lower(trim(coalesce(scale, ''))) WHEN '' THEN 1.0 WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 END::DOUBLE AS factor, count(*) AS questions
        FROM (SELECT DISTINCT question_key, scale FROM gold_questions) GROUP BY ALL""",
}
