"""Evaluation runs: what is still to do, totals and failures of a run, evidence on its scale verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.evaluate import found, gold_factor, in_table, unique
from folioflow.operators.report import bucket, rate

#: The fields of a result.
RESULT = ["doc_id", "ok", "from_cache", "elapsed_s", "error"]


def failed_result(documents: DataFrame, kind: Column, message: Column) -> DataFrame:
    """The results of documents that could not be read; the run goes on without them."""
    error = F.concat(kind, F.lit(": "), message)
    return documents.select("doc_id", F.lit(False).alias("ok"), F.lit(False).alias("from_cache"), F.lit(0.0).alias("elapsed_s"), error.alias("error"))


def resumed(done: DataFrame, fresh: DataFrame) -> DataFrame:
    """The results of a resumed run: those it has, replayed, and those of the documents it lacks."""
    rest = fresh.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    return done.select(*RESULT, F.lit(True).alias("replayed")).unionByName(rest.select(*RESULT, F.lit(False).alias("replayed")))


def roll_up(results: DataFrame, structure: DataFrame, matches: DataFrame) -> DataFrame:
    """metric and value of a run: documents, time, structure, recall, support and their rates.

    Only documents that were read count, and only those read anew cost time.
    """
    fresh = F.col("ok") & ~F.col("from_cache")
    runs = results.agg(
        F.count("*").alias("documents"), F.count_if("ok").alias("documents_ok"), F.count_if(~F.col("ok")).alias("documents_failed"), F.count_if(F.col("ok") & F.col("from_cache")).alias("cached_documents"),
        F.count_if(fresh).alias("parsed_documents"), F.coalesce(F.sum(F.when(fresh, F.col("elapsed_s"))), F.lit(0.0)).alias("parse_seconds"),
    )
    read = results.filter("ok").select("doc_id").distinct()
    counted = ("pages", "blocks", "furniture", "tables", "scaled_tables", "cells", "parsed_numbers")
    shape = structure.join(read, "doc_id", "left_semi").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted])
    outcome = F.col("outcome")
    facts = matches.join(read, "doc_id", "left_semi")
    asked = facts.groupBy("doc_id", "question_key").agg(F.count("*").alias("facts"), F.count_if(found(outcome)).alias("found"), F.count_if(unique(outcome, F.col("candidates"))).alias("unique_facts"), F.count_if(in_table(outcome)).alias("in_tables"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("facts", "found", "unique_facts", "in_tables")]
    support = asked.agg(F.count("*").alias("questions"), F.count_if(F.col("facts") == F.col("found")).alias("supported"), *sums)
    one = runs.crossJoin(shape).crossJoin(support)  # one row each
    rates = {
        "seconds_per_document": F.when(F.col("parsed_documents") > 0, F.col("parse_seconds") / F.col("parsed_documents")).otherwise(0.0), "seconds_per_page": F.when(F.col("pages") > 0, F.col("parse_seconds") / F.col("pages")).otherwise(0.0),
        "fact_recall": rate(F.col("found"), F.col("facts")), "question_support": rate(F.col("supported"), F.col("questions")), "unique_rate": rate(F.col("unique_facts"), F.col("found")),
        "parsed_number_rate": rate(F.col("parsed_numbers"), F.col("cells")), "table_fact_share": rate(F.col("in_tables"), F.col("found")),
    }
    whole = one.select(*one.columns, *[F.round(v, 3).alias(k) for k, v in rates.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in whole.columns])
    return whole.select(F.inline(pairs))


def failures(results: DataFrame) -> DataFrame:
    """doc_id and error of the documents that could not be read."""
    return results.filter("not ok").select("doc_id", F.coalesce("error", F.lit("unknown")).alias("error"))


def causes_with_failures(causes: DataFrame, results: DataFrame) -> DataFrame:
    """cause and facts, with the documents that could not be read as a cause of their own."""
    lost = results.agg(F.count_if(~F.col("ok")).alias("facts")).filter("facts > 0").select(F.lit("document_failed").alias("cause"), "facts")
    return causes.select("cause", "facts").unionByName(lost)


def first_tables(matches: DataFrame, cells: DataFrame) -> DataFrame:
    """question_key and the table (doc_id, page_number, block_ord) of its first fact found in one."""
    hit = matches.filter("cell_key is not null").select("question_key", "fact_ord", "cell_key")
    at = cells.select("cell_key", F.struct("doc_id", "page_number", "block_ord").alias("at"))
    return hit.join(at, "cell_key").groupBy("question_key").agg(F.min_by("at", "fact_ord").alias("at")).select("question_key", "at.*")


def buckets(verdicts: DataFrame, matches: DataFrame, tables: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """bucket and questions; ``ambiguous`` are the tables (keys) that declare several scales."""
    keys = ["doc_id", "page_number", "block_ord"]
    lost = matches.groupBy("question_key").agg(F.some(~found(F.col("outcome"))).alias("lost"))
    doubtful = tables.join(ambiguous.select(*keys).distinct(), keys, "left_semi").select("question_key", F.lit(True).alias("ambiguous"))
    joined = verdicts.join(lost, "question_key", "left").join(doubtful, "question_key", "left")
    named = bucket(F.col("verdict"), F.coalesce("ambiguous", F.lit(False)), F.coalesce("lost", F.lit(False)))
    return joined.groupBy(named.alias("bucket")).agg(F.count("*").alias("questions")).filter("bucket <> ''")


def corroborated(verdicts: DataFrame, matches: DataFrame, cells: DataFrame, scales: DataFrame) -> DataFrame:
    """evidence and questions: whether gold on the same table declares the scale of a spurious verdict.

    ``scales`` has keys and scale of each table.
    """
    keys = ["doc_id", "page_number", "block_ord"]
    at = cells.select("cell_key", *keys)
    in_tables = matches.filter("cell_key is not null").select("question_key", "cell_key").join(at, "cell_key").select("question_key", *keys).distinct()
    # what gold declares of each table, a few factors
    factor = gold_factor(F.col("gold_scale"))
    stated = verdicts.filter(factor > 1.0).select("question_key", factor.alias("factor")).join(in_tables, "question_key").groupBy(*keys).agg(F.collect_set("factor").alias("factors"))
    doubted = verdicts.filter("verdict = 'spurious'").select("question_key").join(first_tables(matches, cells), "question_key").join(scales.select(*keys, "scale"), keys)
    evidence = F.when(F.array_contains("factors", F.col("scale")), "confirmed").when(F.size("factors") > 0, "contradicted").otherwise("none")
    return doubted.join(stated, keys, "left").groupBy(evidence.alias("evidence")).agg(F.count("*").alias("questions"))


def spurious_labels(verdicts: DataFrame, matches: DataFrame, cells: DataFrame, declared: DataFrame, limit: int = 8) -> DataFrame:
    """source, label and questions of the commonest declarations behind spurious verdicts; ``declared`` has keys, source and label."""
    keys = ["doc_id", "page_number", "block_ord"]
    doubted = verdicts.filter("verdict = 'spurious'").select("question_key").join(first_tables(matches, cells), "question_key").join(declared, keys)
    counts = doubted.groupBy("source", F.lower("label").alias("label")).agg(F.count("*").alias("questions"))
    return counts.orderBy(F.desc("questions"), "source", "label").limit(limit)
