"""The gold question set: JSON records per split, flattened, missing documents set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "doc struct<uid:string,page:int,source:string>, questions array<struct<uid:string,order:int,question:string,answer:string,answer_type:string,"
    "scale:string,derivation:string,facts:array<string>,req_comparison:boolean,block_mapping:array<map<string,array<int>>>>>"
)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The records of a split's file with an id; ``path`` has a place for {split}, test is stored as test_gold."""
    stored = {"test": "test_gold"}.get(split, split)
    return spark.read.option("multiLine", True).schema(SCHEMA).json(path.format(split=stored)).filter("doc.uid is not null")


def questions(records: DataFrame) -> DataFrame:
    """doc_uid, page, source and the fields of each question, missing ones as empty."""
    flat = records.select("doc.*", F.explode("questions").alias("q"))
    text = lambda c: F.coalesce(F.col(f"q.{c}"), F.lit("")).alias(c)
    facts = F.filter(F.coalesce("q.facts", F.array().cast("array<string>")), lambda f: f.isNotNull())
    return flat.select(
        F.col("uid").alias("doc_uid"), "page", "source", F.col("q.uid").alias("uid"), F.coalesce("q.order", F.lit(0)).alias("ord"), text("question"), text("answer"), text("answer_type"),
        text("scale"), text("derivation"), facts.alias("facts"), F.coalesce("q.req_comparison", F.lit(False)).alias("req_comparison"),
    )


def present_and_missing(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records whose document is among ``files`` (uid), ids of the others)."""
    ids = records.withColumn("uid", F.col("doc.uid"))
    return ids.join(files, "uid", "left_semi").drop("uid"), ids.join(files, "uid", "left_anti").select("uid").distinct()
