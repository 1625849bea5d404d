"""Readers and writers of the engine's files: JSON lines, CSV sheets, manifests, logs, raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as X

EVAL = "id string, question string, language string, type string, gold array<string>, reference_answer string, note string, gold_grades map<string,int>"
REDTEAM = "id string, attack string, language string, question string, expect_injection boolean, expect_pii array<string>, forbidden array<string>, note string"
QUERY_LOG = "ts double, id string, client string, question string, agent boolean, refused boolean, general boolean, failures array<string>, sources array<string>, latency_s double"
FEEDBACK_LOG = "ts double, id string, rating string, comment string, question string, answer string, sources array<string>, failures array<string>"
MANIFEST = "id string, kind string, title string, url string, file string, division string, listed_as string, case_number string, parties string, summary string, uploaded string, date string"
ACTS = (
    "act_id int, title string, act_number string, date string, preamble string, year int, language string, repealed boolean, url string, "
    "sections array<struct<section_id:int,number:string,number_ascii:string,title:string,chapter:string,url:string,part:string,heading:string,inherited_number:boolean>>, repeal_note string, doc_type string"
)
#: Kinds of sources, and what grades are called in both scripts.
KINDS = ("act", "rule", "regulation", "sro", "order", "judgment")
GRADES = {"yes": 1.0, "y": 1.0, "1": 1.0, "হ্যাঁ": 1.0, "partly": 0.5, "0.5": 0.5, "আংশিক": 0.5, "no": 0.0, "n": 0.0, "0": 0.0, "না": 0.0}


def read_jsonl(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """JSONL read (gz as it is), eval-set scan, red-team scan, lenient log scan: comments (//) and blank lines are no rows.

    Strict by default: a line that is no JSON of the schema fails the job. Lenient drops such lines.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(//.*)?$"))
    parsed = lines.select(F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    if lenient:
        return parsed.where("r.__bad is null and r is not null").select("r.*").drop("__bad")
    checked = parsed.select(F.when(F.col("r.__bad").isNull(), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a row: "), F.col("r.__bad"))).cast(parsed.schema["r"].dataType)).alias("r"))
    return checked.select("r.*").drop("__bad")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSONL write and result file write, gzip."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON read: one object a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_grades(spark: SparkSession, path: str, columns: list[str], criteria: list[str]) -> DataFrame:
    """Grades CSV scan: words of both scripts as 1, 0.5 and 0; other text fails the job."""
    raw = spark.read.option("header", True).option("multiLine", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return raw.select(*(grade(F.col(c)).alias(c) if c in criteria else F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in columns))


def grade(value: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = F.create_map(*(F.lit(x) for k, v in GRADES.items() for x in (k, v)))[word]
    wrong = F.raise_error(F.concat(F.lit("no grade: "), value)).cast("double")
    return F.when(word == "", F.lit(None).cast("double")).when(known.isNotNull(), known).otherwise(wrong)


def label(value: Column) -> Column:
    """Label CSV scan: 1/0/y/n, null without a label."""
    word = F.lower(F.trim(value))
    return F.when(word.isin("1", "y"), 1).when(word.isin("0", "n"), 0)


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV sheet write."""
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest_problems(id_: Column, kind: Column, title: Column, url: Column, file: Column) -> Column:
    """Manifest row validation: what is wrong with an entry."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(id_.rlike("^[a-z0-9][a-z0-9._-]{2,80}$"), F.lit(False)), "id"),
            F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind"),
            F.when(none(title), "title"),
            F.when(none(url) & none(file), "url or file").when(~none(url) & ~X.official_host(url), "url: not an official host"),
        )
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest scan: strict JSON lines; fails on repeated ids and on ids whose synthetic act ids collide."""
    rows = read_jsonl(spark, path, MANIFEST).withColumn("act_id", X.synthetic_id(F.col("id"), 950_000, 49_999))
    bad = rows.groupBy("act_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("ids")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: ids repeat or collide: {bad[0]['ids']}")
    return rows


def local_path(file: Column, id_: Column, url: Column, folder: str) -> Column:
    """Local path of a source."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    return F.coalesce(F.nullif(file, F.lit("")), F.concat(F.lit(f"{folder}/"), id_, F.when(suffix == "", ".pdf").otherwise(suffix)))


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTTP page scan's landing zone and fetch-day lookup: (path, html, fetched) of cached pages, gz or not."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"), F.date_format("_metadata.file_modification_time", "yyyy-MM-dd").alias("fetched"))


def manifest_state(manifest: DataFrame, chunks: DataFrame, fetched: DataFrame) -> DataFrame:
    """Manifest state table and ingested counts by source: (id, kind, chunks, state)."""
    n = chunks.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("chunks"))
    j = manifest.join(n, "id", "left").join(fetched.select("id").distinct().withColumn("__f", F.lit(True)), "id", "left")
    state = F.when(F.col("chunks") > 0, "ingested").when(F.col("__f"), "fetched").otherwise("listed")
    return j.select("id", "kind", F.coalesce("chunks", F.lit(0)).alias("chunks"), state.alias("state"))


def corpus_keys(chunks: DataFrame) -> DataFrame:
    """Corpus-key scan and section key: distinct act:section."""
    return chunks.where("act_id is not null and section_id is not null").select(F.concat_ws(":", "act_id", "section_id").alias("key")).distinct()
