"""Set operations, upserts and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of sets: 1 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def ordered_distinct(variants: list[Column]) -> Column:
    """Ordered distinct union of query variants; nulls are left out."""
    return F.array_distinct(F.array_compact(F.array(*variants)))


def union_last_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """Union with last-wins and chunk union scan: rows of later tables replace earlier ones of the same key."""
    tagged = [t.withColumn("__src", F.lit(i)) for i, t in enumerate(tables)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("__src").desc())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__src")


def append_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Manifest append (anti-join by url): new rows whose key isn't there, each key once."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def replace_by_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Replace-by-source and replace-by-act upsert: all rows of the sources that come anew are replaced."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Key-value answer store: the last row put under each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Latest-answer-per-question: the first row of each id in file order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def incremental_plan(index: DataFrame, manifest: DataFrame, links: DataFrame) -> DataFrame:
    """Incremental plan: (act_id, action): new acts, and known acts that new ones amend. links has (act_id, target)."""
    new = index.select("act_id").distinct().join(manifest.select("act_id"), "act_id", "left_anti")
    refresh = links.join(new, "act_id", "left_semi").select(F.col("target").alias("act_id")).distinct()
    refresh = refresh.join(index.select("act_id").distinct(), "act_id", "left_semi").join(new, "act_id", "left_anti")
    return new.withColumn("action", F.lit("new")).unionByName(refresh.withColumn("action", F.lit("refresh")))


def compare_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Backup verify: (name, state) of what is missing, unlisted or differs between (name, sha) tables."""
    j = listed.alias("l").join(found.alias("f"), F.col("l.name") == F.col("f.name"), "full_outer")
    state = F.when(F.col("f.name").isNull(), "missing").when(F.col("l.name").isNull(), "unlisted").when(~F.col("l.sha").eqNullSafe(F.col("f.sha")), "checksum mismatch")
    return j.select(F.coalesce("l.name", "f.name").alias("name"), state.alias("state")).where("state is not null")


def keep_newest(archives: DataFrame, keep: int) -> DataFrame:
    """Keep newest n archives by name."""
    return archives.orderBy(F.col("name").desc()).limit(keep)


def disjoint_pairs(items: DataFrame) -> DataFrame:
    """Disjoint-gold pairs: (a, b) of items (id, gold) whose gold sets share nothing.

    Pairs that share a key come from an equi-join on it; they are taken off all pairs of the evaluation set, which is a
    small table by nature.
    """
    k = items.select("id", F.explode("gold").alias("key"))
    sharing = k.alias("x").join(k.alias("y"), F.expr("x.key = y.key and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = items.select(F.col("id").alias("a")).join(items.select(F.col("id").alias("b")), F.expr("a < b"))
    return pairs.join(sharing, ["a", "b"], "left_anti")


def coverage_bucket(acts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Corpus coverage bucket of acts (act_id, repealed, downloaded, scanned, n_sections, parsed); the first that applies."""
    j = acts.join(corpus.select("act_id").distinct().withColumn("__in", F.lit(True)), "act_id", "left")
    bucket = (
        F.when(F.col("__in"), "indexed").when(F.col("repealed"), "repealed").when(~F.col("downloaded"), "not_downloaded").when(F.col("scanned"), "scanned")
        .when(F.col("n_sections") == 0, "no_sections").when(~F.col("parsed"), "unparsed").otherwise("not_ingested")
    )
    return j.select("act_id", bucket.alias("bucket"))


def metadata_filter(filters: dict) -> Column:
    """Metadata filter and Retriever filter build: equality, membership of lists, or a Column; None matches null."""
    out = F.lit(True)
    for name, want in filters.items():
        if isinstance(want, Column):
            out = out & want
        elif isinstance(want, (list, tuple, set)):
            out = out & F.coalesce(F.col(name).isin(*want), F.lit(False))
        else:
            out = out & F.col(name).eqNullSafe(F.lit(want))
    return out


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """Corpus counts by kind, act where none is given."""
    return chunks.groupBy(F.coalesce("doc_type", F.lit("act")).alias("doc_type")).agg(F.count_distinct("act_id").alias("documents"), F.count("*").alias("chunks"))


def acts_rollup(chunks: DataFrame) -> DataFrame:
    """Acts roll-up: sections, amended ones, newest amendment, last fetch, first address (an overview's wins)."""
    section = F.col("kind") == "section"
    return chunks.groupBy("act_id").agg(
        F.min("title").alias("title"),
        F.max("repealed").alias("repealed"),
        F.count_distinct(F.when(section, F.col("section_id"))).alias("sections"),
        F.count_if(section & (F.col("part") == 1) & F.col("amended")).alias("amended"),
        F.max("amended_year").alias("last_amended"),
        F.max("fetched").alias("fetched"),
        F.min_by("url", F.struct(F.when(F.col("kind") == "overview", 0).otherwise(1), F.col("doc"))).alias("url"),
    )
