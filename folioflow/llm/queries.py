"""The llm queries, p2 to p8, each over its whole tables; ``ORACLES`` has the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import chunks, junk, lookalike, overlap, packing, scans, tokens
from folioflow.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(lookalike.text_items(spark, sf_dir))


def p2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalised(lookalike.text_items(spark, sf_dir).distinct())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(spark, sf_dir)


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).filter("n_pieces > 1").select("block_key").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_texts(chunks.block_items(spark, sf_dir), ["block_key"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(spark, sf_dir)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(spark, sf_dir)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # three rows, a fixed table
    sizes = [(r["size_name"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_sizes").collect()]
    return packing.pack(tokens.token_counts(table(spark, sf_dir, "documents")), sizes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junk.found(table(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_normalised": p2_normalised,
    "p3_found": p3_found,
    "p3_paragraphs": p3_paragraphs,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
}
ORACLES: dict[str, str] = {
    "p4_found": """
        WITH items AS (
            SELECT DISTINCT block_key, type, text FROM raw_blocks WHERE type IS DISTINCT FROM 'table'
            UNION ALL
            SELECT DISTINCT block_key, 'table', markdown FROM raw_tables
        )
        SELECT DISTINCT block_key FROM items JOIN chunk_limits ON type = block_type WHERE length(text) > max_chars
    """,
}
