"""Tables written to the folder that all executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a small table that one file holds.
FILE_ROWS = 250_000


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="strandloom-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Without that setting a local master gets a folder of its own; a cluster is an error, as its machines share no temporary folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = _own_dir()
    return where.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table read back from the shared folder. ``rows``, where it is known to be small, bounds the number of files."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame) -> None:
    """Deletes a table of ``durable`` that nothing reads any more."""
    _delete(table.sparkSession, table.written_to)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this application has written. Results that read them must have been consumed."""
    _delete(spark, _folder(spark))
