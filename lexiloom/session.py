"""Session defaults used by the tests and the bench; a cluster brings its own session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark 4.1 may zip the sides of a union although adaptive execution has given them different numbers of partitions; set on
#: whatever session a table is read with.
UNIONS = {"spark.sql.unionOutputPartitioning": "false"}
#: Rows that a Python worker holds at once; with Spark's 10,000, texts and what is made of them outgrow a worker's share of an executor.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **UNIONS,
    **BATCHES,
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lexiloom")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Parquet's vectored reads go through direct buffers that a JVM keeps for each of its threads, outside its heap; with
#: small executors that is what runs over first.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}


def table(spark: SparkSession, sf_dir: str, name: str, batches: dict[str, str] = BATCHES):
    """One of the driver's Parquet tables; Spark's own reader, so any store it knows will do."""
    for key, value in (UNIONS | batches).items():
        spark.conf.set(key, value)
    return spark.read.options(**PLAIN_READS).parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir of the session or the context.

    Where none is set, a session in one process gets a temporary one; any other fails, as executors couldn't read it.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexiloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, for small results that several branches of a plan use."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.options(**PLAIN_READS).schema(df.schema).parquet(path)


def large_batches(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As table, with Spark's own batches: for operators that cut these themselves and combine what is in one."""
    return table(spark, sf_dir, name, {key: "10000" for key in BATCHES})
