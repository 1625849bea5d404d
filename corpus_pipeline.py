"""Five stages from raw documents to packed pieces, each by one operator of lexiloom.llm.

run() writes each stage's rows as Parquet to the folder that driver and executors share and reads them again as
the next stage's documents; a stage's table goes when the next one's is written, so two are there at most. All stages but the last return the columns of documents. A null or empty text
passes toxicity, the Jaccard join and decontamination unchanged; substring dedup drops rows whose text it
has emptied, and packing makes an empty text one piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontam, jaccard, packing, spans, toxicity
from lexiloom.llm.common import drop_path, scratch
from lexiloom.llm.queries import vocabulary
from lexiloom.session import PLAIN_READS
from lexiloom.session import large_batches as table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled rows of the input that are not held out, as in op5; rows predicted toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, Jaccard 0.8 or more; of each class of links the least doc_id stays."""
    return jaccard.keep_one(docs, n=5, num=80, den=100)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that a repeated span covers go, but where they are first; n_chars follows. What is emptied goes."""
    cut = spans.substring_dedup(docs)
    changed = F.col("n_removed") > 0
    cut = cut.where(~changed | (F.trim("text") != "")).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leak of a benchmark item go, whole; null and empty texts hold none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its ids; a null text counts as empty and is one piece of the id 1."""
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeated_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stage already is no SQL (tests/llm/test_pipeline.py compares with a plain version instead).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.options(**PLAIN_READS).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
