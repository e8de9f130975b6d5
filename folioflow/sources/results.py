"""Result files: a line of run data, then a line per document, read up to the first broken line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "record string, document_uid string, source string, ok boolean, elapsed_s double, from_cache boolean, error string, structure map<string,string>, "
    "questions array<struct<uid:string,answer_type:string,gold_scale:string,scale_verdict:string,facts:array<struct<fact:string,outcome:string,numeric:boolean,table_id:string,cell_id:string,block_id:string,page_number:int,candidates:int>>>>"
)
RUN = "record string, backend string, backend_version string, model_versions map<string,string>, split string, seed int, `limit` int, documents int, force_ocr boolean, gold_sha256 string, schema_version int, started_at string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no and value of a text file's lines; the file is small beside the data it reports on."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")).filter("trim(value) <> ''")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(the run's row, the documents' rows) before the first line that isn't JSON."""
    lines = numbered_lines(spark, path).withColumn("json", F.expr("try_parse_json(value)"))
    broken = lines.filter("json is null").agg(F.min("line_no").alias("stop"))
    sound = lines.crossJoin(broken).filter("stop is null or line_no < stop")  # one row of stop
    kind = F.get_json_object("value", "$.record")
    runs = sound.filter(kind == "run").select(F.from_json("value", RUN).alias("r")).select("r.*")
    documents = sound.filter(kind == "document").select("line_no", F.from_json("value", DOCUMENT).alias("d")).select("line_no", "d.*")
    return runs, documents


def write_results(documents: DataFrame, path: str, run: DataFrame | None = None) -> None:
    """Appends a line for each document; ``run`` (one row) is the line of run data before them.

    The run's line is written as a part of its own that sorts before the others.
    """
    if run is not None:
        run.select(F.lit("run").alias("record"), *run.columns).coalesce(1).write.mode("append").json(f"{path}/part=0")
    documents.select(F.lit("document").alias("record"), *[c for c in documents.columns if c != "record"]).write.mode("append").json(f"{path}/part=1")


def read_written(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(the run's row, the documents' rows) of a folder that ``write_results`` wrote, in parallel; broken lines are left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).withColumn("json", F.expr("try_parse_json(value)")).filter("json is not null")
    kind = F.get_json_object("value", "$.record")
    return lines.filter(kind == "run").select(F.from_json("value", RUN).alias("r")).select("r.*"), lines.filter(kind == "document").select(F.from_json("value", DOCUMENT).alias("d")).select("d.*")


def pending(documents: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return documents.join(done.select(key).distinct(), key, "left_anti")
