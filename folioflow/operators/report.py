"""Rolling results up: slices, rates, causes, comparisons of runs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import split_kind

#: Fixed: answer types that every report lists, fields in which two runs must agree to be comparable.
ANSWER_TYPES = ("span", "multi-span", "arithmetic", "count")
COMPARABLE = ("backend", "backend_version", "model_versions", "split", "seed", "limit", "force_ocr", "gold_sha256")


def rate(part: Column, whole: Column) -> Column:
    """A percentage, 0 of nothing."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def rate_or_null(part: Column, whole: Column) -> Column:
    """A percentage, null of nothing."""
    return F.when(whole > 0, 100.0 * part / whole)


def slices(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """answer_type (overall for all), questions, supported, facts and found, in one pass over grouping sets.

    The known answer types are always listed, others if they occur.
    """
    found = ~F.col("outcome").isin("furniture_only", "not_found")
    per = matches.groupBy("question_key").agg(F.count("*").alias("facts"), F.count_if(found).alias("found"))
    rows = questions.select("question_key", "answer_type").join(per, "question_key", "left").select("answer_type", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("found", F.lit(0)).alias("found"))
    counts = (
        rows.groupingSets([[], ["answer_type"]], "answer_type")
        .agg(F.grouping("answer_type").alias("g"), F.count("*").alias("questions"), F.sum(F.when((F.col("facts") > 0) & (F.col("facts") == F.col("found")), 1).otherwise(0)).alias("supported"), F.sum("facts").alias("facts"), F.sum("found").alias("found"))
        .withColumn("answer_type", F.when(F.col("g") == 1, "overall").otherwise(F.col("answer_type")))
        .drop("g")
    )
    spark = questions.sparkSession
    seeds = spark.createDataFrame([(t,) for t in ("overall", *ANSWER_TYPES)], "answer_type string")
    return seeds.join(counts, "answer_type", "full").na.fill(0, ["questions", "supported", "facts", "found"])


def rates(sliced: DataFrame) -> DataFrame:
    """The slices with fact recall and question support."""
    return sliced.withColumn("fact_recall", F.round(rate(F.col("found"), F.col("facts")), 2)).withColumn("question_support", F.round(rate(F.col("supported"), F.col("questions")), 2))


def outcome_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("outcome").agg(F.count("*").alias("facts"), F.count_if((F.col("candidates") == 1) & ~F.col("outcome").isin("furniture_only", "not_found")).alias("unique_facts"))


def scale_accuracy(verdicts: DataFrame) -> DataFrame:
    """One row: scorable, correct, accuracy and accuracy where the gold declares a magnitude; null if nothing is scorable."""
    scorable, declared = F.col("verdict") != "unscorable", F.lower(F.trim(F.coalesce("gold_scale", F.lit("")))).isin("thousand", "million", "billion")
    correct = F.col("verdict") == "correct"
    sums = verdicts.agg(F.count_if(scorable).alias("scorable"), F.count_if(correct).alias("correct"), F.count_if(scorable & declared).alias("declared"), F.count_if(correct & declared).alias("declared_correct"))
    return sums.withColumn("accuracy", F.round(rate_or_null(F.col("correct"), F.col("scorable")), 2)).withColumn("declared_accuracy", F.round(rate_or_null(F.col("declared_correct"), F.col("declared")), 2))


def causes(matches: DataFrame, structure: DataFrame) -> DataFrame:
    """cause and facts of what was not recovered, by the first cause that applies."""
    lost = matches.filter("outcome in ('furniture_only', 'not_found')").join(structure.select("doc_id", "tables", "failed_pages"), "doc_id", "left")
    cause = (
        F.when(F.col("outcome") == "furniture_only", "demoted_to_furniture").when(F.col("failed_pages") > 0, "page_extraction_failed")
        .when(F.col("numeric") & (F.coalesce("tables", F.lit(0)) == 0), "no_tables_recovered").when(F.col("numeric"), "table_found_cell_missed").otherwise("prose_not_matched")
    )
    return lost.groupBy(cause.alias("cause")).agg(F.count("*").alias("facts"))


def worst_documents(support: DataFrame, limit: int = 5) -> DataFrame:
    """doc_id and unsupported of the documents with most unsupported questions, ties by id."""
    counts = support.groupBy("doc_id").agg(F.count_if(~F.col("supported")).alias("unsupported"))
    return counts.orderBy(F.desc("unsupported"), "doc_id").limit(limit).filter("unsupported > 0")


def common_documents(runs: list[DataFrame]) -> DataFrame:
    """The ids all runs have."""
    out = runs[0].select("doc_id").distinct()
    for run in runs[1:]:
        out = out.intersect(run.select("doc_id"))
    return out


def restrict(run: DataFrame, documents: DataFrame) -> DataFrame:
    return run.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def coverage(runs: dict[str, DataFrame]) -> DataFrame:
    """run and documents of each run, with whether all runs have the same documents."""
    spark_rows = None
    for name, run in runs.items():
        one = run.agg(F.countDistinct("doc_id").alias("documents")).withColumn("run", F.lit(name))
        spark_rows = one if spark_rows is None else spark_rows.unionByName(one)
    shared = common_documents(list(runs.values())).agg(F.count("*").alias("common"))
    return spark_rows.crossJoin(shared).select("run", "documents", "common", (F.col("documents") == F.col("common")).alias("covered"))  # a row per run with one row


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """verdict_before, verdict_after and questions, with recovered and regressed marked."""
    joined = before.select("question_key", F.col("verdict").alias("verdict_before")).join(after.select("question_key", F.col("verdict").alias("verdict_after")), "question_key")
    counts = joined.groupBy("verdict_before", "verdict_after").agg(F.count("*").alias("questions"))
    good_a, good_b = F.col("verdict_before") == "correct", F.col("verdict_after") == "correct"
    return counts.withColumn("change", F.when(good_b & ~good_a, "recovered").when(good_a & ~good_b, "regressed").otherwise("same"))


def compare(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """metric by run, from rows of run, metric and value."""
    return metrics.groupBy("metric").pivot("run", runs).agg(F.first("value"))


def incompatible(before: DataFrame, after: DataFrame) -> DataFrame:
    """field: the first field of the run rows in which they differ, null if none."""
    fields = [c for c in COMPARABLE if c in before.columns and c in after.columns]
    a, b = before.select(*[F.col(c).cast("string").alias(f"a_{c}") for c in fields]), after.select(*[F.col(c).cast("string").alias(f"b_{c}") for c in fields])
    first = F.coalesce(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in fields])
    return a.limit(1).crossJoin(b.limit(1)).select(first.alias("field"))  # one row each


def bucket(verdict: Column, ambiguous: Column, lost: Column) -> Column:
    """The class of a scale decision."""
    return (
        F.when(verdict.isin("correct", "missed", "wrong") & ambiguous, "D_ambiguous").when(verdict == "correct", "A_correct").when(verdict == "missed", "B_missed")
        .when(verdict == "wrong", "C_wrong").when(verdict == "spurious", "E_spurious").when(lost, "F_numeric").otherwise("")
    )


def magnitude_locations(tables: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """location and tables: where a magnitude word stands, combined, NOWHERE if in none of the sources.

    ``sources`` are those of the detector and the body cells.  Of the blocks
    before a table only the nearest of the windows 1, 2, 3, 5 with a hit counts.
    """
    said = sources.withColumn("hit", F.col("text").rlike(r"(?i)\b(thousand|million|billion|trillion)s?\b"))
    place = F.when(F.col("hit") & (F.col("source") != "preceding_text"), F.col("source"))
    near = F.min(F.when(F.col("hit") & (F.col("source") == "preceding_text"), F.when(F.col("src_ord") <= 3, F.col("src_ord")).when(F.col("src_ord") <= 5, 5).otherwise(F.col("src_ord"))))
    per = said.groupBy(*keys).agg(F.collect_set(place).alias("places"), near.alias("near"))
    all_ = F.array_sort(F.array_compact(F.array_append("places", F.concat(F.lit("preceding<="), F.col("near").cast("string")))))
    named = per.withColumn("location", F.nullif(F.array_join(all_, "|"), F.lit("")))
    every = tables.select(*keys).distinct().join(named, keys, "left").withColumn("location", F.coalesce("location", F.lit("NOWHERE")))
    return every.groupBy("location").agg(F.count("*").alias("tables"))


def type_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("type").agg(F.count("*").alias("blocks"), F.countDistinct("doc_id").alias("documents"))


def sample(documents: DataFrame, limit: int | None, seed: int) -> DataFrame:
    """``limit`` documents drawn with a seed, all if there are no more; the same draw whatever the partitions.

    A sampling operator: the ids are ranked by a seeded hash, nothing is collected.
    """
    if limit is None:
        return documents
    if limit <= 0:
        return documents.limit(0)
    ids = documents.select("doc_uid").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_uid"), "doc_uid").limit(limit)
    return documents.join(ids, "doc_uid", "left_semi")


def exact_sample(ids: list[str], limit: int, seed: int) -> list[str]:
    """The draw of Python's own generator over sorted ids, for parity with runs made that way."""
    return sorted(random.Random(seed).sample(sorted(ids), min(limit, len(ids)))) if limit > 0 else []


def split_manifest(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """split, documents and questions of each split."""
    named = documents.select(F.col("doc_uid"), F.col("page"), split_kind(F.col("split_name")).alias("split")).distinct()
    counted = questions.groupBy("doc_uid", "page").agg(F.countDistinct("question_key").alias("n"))
    return named.join(counted, ["doc_uid", "page"], "left").groupBy("split").agg(F.countDistinct("doc_uid").alias("documents"), F.sum(F.coalesce("n", F.lit(0))).alias("questions"))


def render(metrics: DataFrame, sliced: DataFrame, outcomes: DataFrame) -> str:
    """A text report of a run's totals (metric, value), slices and outcomes, a few rows each."""
    value = {r["metric"]: r["value"] for r in metrics.collect()}
    lines = [f"documents  {value['documents_ok']:.0f} read, {value['documents_failed']:.0f} failed, {value['cached_documents']:.0f} from the cache"]
    if value["parsed_documents"]:
        lines.append(f"speed      {value['seconds_per_document']:.1f} s a document, {value['seconds_per_page']:.2f} s a page")
    lines += ["", *(f"{name.replace('_', ' '):<20}{value[name]:6.1f} %" for name in ("fact_recall", "question_support", "unique_rate", "parsed_number_rate", "table_fact_share")), ""]
    lines += [f"{'answer type':<16}{'questions':>10}{'supported':>11}{'facts':>10}{'found':>10}"]
    lines += [f"{r['answer_type']:<16}{r['questions']:>10}{r['supported']:>11}{r['facts']:>10}{r['found']:>10}" for r in sliced.orderBy("answer_type").collect() if r["questions"]]
    return "\n".join([*lines, "", *(f"{r['outcome']:<20}{r['facts']:>8}" for r in outcomes.orderBy("outcome").collect())])


def render_failures(causes: DataFrame, failed: DataFrame, worst: DataFrame) -> str:
    """A text report of what was not recovered: causes, the commonest first, then documents."""
    rows = sorted(causes.collect(), key=lambda r: (-r["facts"], r["cause"]))
    lines = [f"{sum(r['facts'] for r in rows)} facts not recovered", *(f"  {r['cause']:<26}{r['facts']:>8}" for r in rows)]
    lines += [f"  {r['doc_id']}: {r['error']}" for r in failed.orderBy("doc_id").limit(20).collect()]  # a report's first lines
    return "\n".join([*lines, *(f"  {r['doc_id']}: {r['unsupported']} questions without support" for r in worst.collect())])


def to_json(sliced: DataFrame) -> DataFrame:
    return sliced.select(F.to_json(F.struct(*sliced.columns)).alias("json"))


