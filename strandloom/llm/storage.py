"""Lineage cuts in the folder all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


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


BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers and their Arrow buffers hold ROWS whole texts at a time instead of Spark's default of 10,000; any other setting is left alone."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS))


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Downstream stages then survive lost executors without recomputing ``df``,
    and consumers that read it twice don't run it twice.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added until no column of ``df`` has them, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def split(rows: DataFrame, key: str, keys: DataFrame, marks: list[str], bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is surely not among ``keys``, and the others, which an exact join has to judge. A bit table of 2^bits bits is broadcast, whatever the number of keys, so only the others' texts are shuffled; where it is full, all are. ``marks``: three names that no column has."""
    at, word, table_bits = marks
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    table = keys.select(slot.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 as int)))").alias(table_bits))
    marked = rows.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(durable(table, "bits")), word, "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned({table_bits}, cast(pmod({key}, {1 << bits}L) & 63 as int)) & 1 = 1"), F.lit(False))
    return marked.filter(~hit), marked.filter(hit)
