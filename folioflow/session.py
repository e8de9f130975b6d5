"""Reading tables and cutting lineage, the two things every query needs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; a file or a folder of parts."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="folioflow-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def distinct_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key. Rows sent twice differ in ``ingested_at`` only, so any copy serves.

    A null key is a key like any other.
    """
    return df.drop("ingested_at").dropDuplicates(keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``, removed with the application.

    Only a local session may be without that setting (a test); it gets a
    temporary folder.  On a cluster a folder of one machine would lose data.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = _temporary.setdefault(context.applicationId, tempfile.mkdtemp(prefix="folioflow-"))
    path = f"{base.rstrip('/')}/{context.applicationId}-{name}-{uuid.uuid4().hex}"
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(file)
    return path


_temporary: dict[str, str] = {}


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, its lineage cut.

    Columnar and compressed, a fraction of a checkpoint of rows.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_bytes(folder: str, column: str) -> bytes:
    """The one value of a column of the table in ``folder``, read by a worker."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return pq.read_table(path, columns=[column], filesystem=system, partitioning=None).column(column)[0].as_py()


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose work is done in Python: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
