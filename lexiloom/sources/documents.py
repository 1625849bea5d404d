"""Small JSON documents as VARIANT rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import variants


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Known-gap JSON scan: (file, doc) of each file under path, a document a file; doc is null where it is no JSON. A file without a byte has no row."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", variants.document(F.col("value")).alias("doc"))


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """Known gaps of all documents under path, one row each: (file, gap VARIANT). Broken documents have none."""
    return read_documents(spark, path).select("file", F.explode(variants.known_gaps(F.col("doc"))).alias("gap"))
