"""Matching gold facts to documents: tiers of lookups, the first tier with a hit wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.finance import parse_values
from folioflow.functions.text import normal
from folioflow.session import saved

#: Fixed: tiers in order, least letters of a text that is searched for, factors of gold scales, a figure in running text.
OUTCOMES = ("table_cell_text", "table_cell_value", "block_text", "block_text_value", "furniture_only", "not_found")
LEAST_TEXT = 4
GOLD_FACTORS = {"": 1.0, "thousand": 1e3, "million": 1e6, "billion": 1e9}
NUMBER_TOKEN = r"(?U)\(?\s?[$€£¥₩₹]?\s?[+-]?\d[\d,.   ]*\d|\(?[$€£¥₩₹]?\s?[+-]?\d"
FACT = ["doc_id", "question_key", "fact_ord"]


def fact_rows(questions: DataFrame) -> DataFrame:
    """FACT, page_number, fact, needle and num of every gold fact; each distinct fact is parsed once."""
    flat = questions.select(F.col("doc_uid").alias("doc_id"), "question_key", F.col("page").alias("page_number"), F.posexplode("facts").alias("fact_ord", "fact")).filter("fact is not null")
    once = flat.select("fact").distinct()
    parsed = parse_values(once.withColumn("needle", normal(F.col("fact"))), F.col("fact")).select("fact", "needle", F.col("value.num").alias("num"))
    return flat.join(parsed, "fact")


def cell_index(cells: DataFrame) -> DataFrame:
    """doc_id, page_number, block_ord, cell_ord, cell_key, text (normal form) and num of the cells with text."""
    held = cells.filter("text is not null")
    once = held.select("text").distinct()
    parsed = parse_values(once.withColumn("needle", normal(F.col("text"))), F.col("text")).select("text", "needle", F.col("value.num").alias("num"))
    joined = held.select("doc_id", "page_number", "block_ord", "cell_ord", "cell_key", "text", "is_header").join(parsed, "text").filter("needle <> ''").drop("text")
    # header cells have no value
    return joined.withColumn("num", F.when(~F.coalesce("is_header", F.lit(False)), F.col("num")))


def block_index(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, block_ord, block_key, in_order and text (normal form) of the blocks with text."""
    return blocks.filter("text is not null and type <> 'table'").select("doc_id", "page_number", "block_ord", "block_key", (~F.col("type").isin("page_header", "page_footer")).alias("in_order"), normal(F.col("text")).alias("haystack")).filter("haystack <> ''")


def block_numbers(indexed: DataFrame) -> DataFrame:
    """block_key, doc_id, in_order, page_number, block_ord and num of every figure in running text.

    Whole tokens are parsed, so a figure is never found inside a longer one.
    """
    tokens = indexed.select("doc_id", "page_number", "block_ord", "block_key", "in_order", F.explode(F.regexp_extract_all("haystack", F.lit(NUMBER_TOKEN), F.lit(0))).alias("token"))
    once = tokens.select("token").distinct()
    parsed = parse_values(once, F.col("token")).select("token", F.col("value.num").alias("num")).filter("num is not null")
    return tokens.join(parsed, "token").drop("token")


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whether the needle stands in the haystack with no word character right beside it."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return F.contains(haystack, needle) & F.rlike(haystack, quoted)


def _hits(rows: DataFrame, keys: list[str], tier: int) -> DataFrame:
    """keys, tier, candidates, place and the first hit of each key; summed up before facts are joined, so no pairs arise."""
    of = [c for c in ("cell_key", "block_key") if c in rows.columns]
    place = F.struct("page_number", "block_ord", F.col("cell_ord") if "cell_ord" in rows.columns else F.lit(0).alias("cell_ord"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("candidates"), F.min(place).alias("place"), *[F.min_by(c, place).alias(c) for c in of])
    for c in ("cell_key", "block_key"):
        if c not in of:
            out = out.withColumn(c, F.lit(None).cast("bigint"))
    return out.withColumn("tier", F.lit(tier))


#: Numbers are the same within this share of the larger; width of a bin of their logarithms, far above it.
SAME, BIN = 1e-9, 1e-8


def same_number(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= SAME * F.greatest(F.abs(a), F.abs(b))


def _bin(num: Column) -> Column:
    """The bin of a number; two that are the same are in one or in neighbours. Zero has one of its own."""
    return F.when(num == 0, F.lit(0)).otherwise(F.signum(num).cast("bigint") * (F.floor(F.log10(F.abs(num)) / BIN) + (1 << 50)))


def phrase_places(indexed: DataFrame, needles: DataFrame) -> DataFrame:
    """The rows of ``indexed`` that hold a needle (doc_id, needle) of their document as a phrase.

    A needle is looked for by the one of its words that the fewest texts of the
    document have: an equi-join on document and word, so neither side's texts
    meet all of the other's.  A needle without any word meets all its texts.
    """
    words = F.array_distinct(F.regexp_extract_all("needle", F.lit(r"(?U)\w+"), F.lit(0)))
    asked = saved(needles.withColumn("words", words))
    of_needle = asked.select("doc_id", "needle", F.explode("words").alias("word"))
    wanted = of_needle.select("doc_id", "word").distinct()
    held = indexed.select("doc_id", "block_key", F.explode(F.array_distinct(F.regexp_extract_all("haystack", F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    held = saved(held.join(wanted, ["doc_id", "word"], "left_semi"))
    often = held.groupBy("doc_id", "word").count()
    # a word that no text has makes its needle a miss
    rarest = of_needle.join(often, ["doc_id", "word"], "left").groupBy("doc_id", "needle").agg(F.min_by("word", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word")).alias("word"))
    near = rarest.join(held, ["doc_id", "word"]).select("block_key", "needle")
    wordless = asked.filter(F.size("words") == 0).select("doc_id", "needle")
    by_word = indexed.join(near, "block_key")
    return by_word.unionByName(indexed.join(wordless, "doc_id").select(*by_word.columns)).filter(contains_phrase(F.col("haystack"), F.col("needle"))).drop("haystack")


def match_facts(facts: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """FACT, outcome, numeric, candidates and the first hit's cell_key and block_key.

    Facts are looked for in their document: cells by text, cells by value, the
    body by phrase or figure, then furniture.  ``candidates`` counts the hits of
    the winning tier; the first hit is the first in document order.  Hits are
    counted per document and text (or figure) first, facts are joined to those
    counts, so a hot document never meets itself pair by pair.
    """
    indexed = saved(block_index(blocks))
    index = cell_index(cells)
    numbers = block_numbers(indexed)
    needles = facts.filter(F.col("num").isNull() & (F.length("needle") >= LEAST_TEXT)).select("doc_id", "needle").distinct()
    in_text = saved(phrase_places(indexed, needles))
    by_text = _hits(index, ["doc_id", "needle"], 0).unionByName(_hits(in_text.filter("in_order"), ["doc_id", "needle"], 2)).unionByName(_hits(in_text.filter("not in_order"), ["doc_id", "needle"], 4))
    by_value = _hits(index.filter("num is not null"), ["doc_id", "num"], 1).unionByName(_hits(numbers.filter("in_order"), ["doc_id", "num"], 3)).unionByName(_hits(numbers.filter("not in_order"), ["doc_id", "num"], 4))
    asked = facts.filter("needle <> ''").select(*FACT, "needle", "num")
    first = [*FACT, "tier", "candidates", "cell_key", "block_key"]
    hits = asked.join(by_text, ["doc_id", "needle"]).select(*first)
    # figures that differ in float noise only are the same: neighbouring bins, then the exact rule
    figures = asked.filter("num is not null").select("doc_id", "num").distinct()
    near = figures.withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _bin(F.col("num")) + d)))
    valued = by_value.withColumnRenamed("num", "value").withColumn("bin", _bin(F.col("value")))
    met = near.join(valued, ["doc_id", "bin"]).filter(same_number(F.col("num"), F.col("value")))
    summed = met.groupBy("doc_id", "num", "tier").agg(F.sum("candidates").alias("candidates"), *[F.min_by(c, "place").alias(c) for c in ("cell_key", "block_key")])
    hits = hits.unionByName(asked.filter("num is not null").join(summed, ["doc_id", "num"]).select(*first))
    best = hits.groupBy(*FACT).agg(F.min_by(F.struct("tier", "candidates", "cell_key", "block_key"), "tier").alias("m"))
    names = F.array(*map(F.lit, OUTCOMES))
    out = facts.select(*FACT, "page_number", "fact", "num").join(best, FACT, "left")
    return out.select(
        *FACT, "page_number", "fact", F.get(names, F.coalesce("m.tier", F.lit(5))).alias("outcome"), F.col("num").isNotNull().alias("numeric"), F.coalesce("m.candidates", F.lit(0)).cast("bigint").alias("candidates"),
        F.col("m.cell_key").alias("cell_key"), F.col("m.block_key").alias("block_key"),
    )


def found(outcome: Column) -> Column:
    return ~outcome.isin("furniture_only", "not_found")


def in_table(outcome: Column) -> Column:
    return outcome.isin("table_cell_text", "table_cell_value")


def unique(outcome: Column, candidates: Column) -> Column:
    return found(outcome) & (candidates == 1)


def question_support(matches: DataFrame) -> DataFrame:
    """question_key, facts, found_count and supported: all of at least one fact found."""
    return matches.groupBy("doc_id", "question_key").agg(F.count("*").alias("facts"), F.count_if(found(F.col("outcome"))).alias("found_count"), F.every(found(F.col("outcome"))).alias("supported"))


def gold_factor(scale: Column) -> Column:
    """The factor of a gold scale; null for percent and unknown ones."""
    pairs = [F.lit(x) for pair in GOLD_FACTORS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(F.coalesce(scale, F.lit("")))))


def score_scale(factor: Column, scales: Column) -> Column:
    """The verdict on the scales of the tables a question's facts were found in."""
    return (
        F.when(factor.isNull() | (F.coalesce(F.size(scales), F.lit(0)) <= 0), "unscorable")
        .when(F.exists(scales, lambda s: s == factor), "correct")
        .when(factor == 1.0, "spurious")
        .when(F.forall(scales, lambda s: s == 1.0), "missed")
        .otherwise("wrong")
    )


def scale_verdicts(questions: DataFrame, matches: DataFrame, table_scales: DataFrame, cells: DataFrame) -> DataFrame:
    """question_key, gold scale and verdict: joins the cells of found facts to the scales of their tables."""
    at = cells.select("cell_key", "doc_id", "page_number", "block_ord").distinct()
    scales = matches.filter("cell_key is not null").select("question_key", "cell_key").join(at, "cell_key").join(table_scales.select("doc_id", "page_number", "block_ord", "scale"), ["doc_id", "page_number", "block_ord"])
    per = scales.groupBy("question_key").agg(F.sort_array(F.collect_set("scale")).alias("scales"))
    joined = questions.select("question_key", "answer_type", "scale").join(per, "question_key", "left")
    return joined.select("question_key", "answer_type", F.col("scale").alias("gold_scale"), score_scale(gold_factor(F.col("scale")), F.col("scales")).alias("verdict"))


def describe_structure(pages: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts per document: pages, blocks in order, furniture, tables, cells, parsed figures, scaled tables, failed pages."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("extraction_source") == "failed").alias("failed_pages"))
    b = blocks.groupBy("doc_id").agg(F.count_if(~F.col("type").isin("page_header", "page_footer")).alias("blocks"), F.count_if(F.col("type").isin("page_header", "page_footer")).alias("furniture"))
    t = tables.groupBy("doc_id").agg(F.count("*").alias("tables"), F.count_if(F.col("scale") != 1.0).alias("scaled_tables"))
    c = cells.groupBy("doc_id").agg(F.count("*").alias("cells"), F.count_if(F.col("value.num").isNotNull()).alias("parsed_numbers"))
    out = p.join(b, "doc_id", "left").join(t, "doc_id", "left").join(c, "doc_id", "left")
    return out.na.fill(0)
