"""BM25 as tables: term frequencies, document frequencies, lengths; many questions scored in one job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.session import materialized

K1, B = 1.5, 0.75
#: Questions that every task holds at once, by their terms; more are searched in several passes.
BLOCK_QUERIES = 2048
#: Documents that a task counts terms of, or whose scores for all questions it holds, at once.
BLOCK_DOCS = 256


@dataclass(frozen=True)
class Index:
    """postings(doc, term, tf), docs(doc, dl), terms(term, df), corpus(n, avgdl): the index as four tables."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def save(self, path: str) -> None:
        """BM25 index write: postings sorted by term inside files, so that a term's row groups can be skipped."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("docs", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        """BM25 index load; fails where the tables don't belong together."""
        found = cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "terms", "corpus")))
        n, stored = found.docs.count(), found.corpus.first()["n"]
        if n != stored:
            raise ValueError(f"{path}: {n} documents, but the index was built on {stored}")
        return found


def tokenized(docs: DataFrame, doc: str, text: str, stem: bool = False) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), X.tokens(F.coalesce(F.col(text), F.lit("")), stem).alias("tokens"))


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", stem: bool = False, stored: bool = False) -> Index:
    """Index build (tf, df, dl, avgdl). With stored, postings and lengths are written to the shared folder and all tables come from
    these; do so where more than one table is used, as each would tokenise the documents again."""
    t = tokenized(docs, doc, text, stem)
    lengths = t.select("doc", F.size("tokens").alias("dl"))
    postings = t.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    if stored:
        lengths, postings = materialized(lengths, "lengths"), materialized(postings, "postings")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return Index(postings, lengths, terms, lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")))


def idf(df: Column, n: Column) -> Column:
    """IDF."""
    return F.when(df > 0, F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))).otherwise(0.0)


def weight(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    length = F.greatest(dl, F.lit(1)) / F.greatest(avgdl, F.lit(1e-9))
    return idf(df, n) * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", text: str = "text", query: str = "query_id", question: str = "question", stem: bool = False) -> DataFrame:
    """Inverted-index probe: (query_id, doc, score) of every pair that shares a term; a term asked twice counts twice.
    For the best of each question take bm25_search, which doesn't shuffle the pairs.

    Only terms that are asked for leave the scan: the distinct terms of the questions meet the exploded
    tokens first (broadcast by Spark where they are few), then counts are combined before their shuffle.
    Document lengths, their mean and document frequencies are those of all documents.
    """
    # kept in one relation, so the corpus is tokenised once for counts and lengths
    q = queries.select(F.col(query).alias("query_id"), F.explode(X.tokens(F.coalesce(F.col(question), F.lit("")), stem)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    t = tokenized(docs, doc, text, stem)
    corpus = t.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    hits = t.select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = q.join(df, "term").join(tf, "term").crossJoin(F.broadcast(corpus))
    score = F.sum(F.col("qf") * weight(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")))
    return scored.groupBy("query_id", "doc").agg(F.round(score, 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score", group: str = "query_id", tie: str = "doc") -> DataFrame:
    """BM25 top-k: rank 1 to k in each group, ties by the id (Spark keeps k rows a task before the shuffle)."""
    w = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 10, where: Column | list[Column | None] | None = None, stem: bool = False, doc: str = "doc_id", text: str = "text", query: str = "query_id", question: str = "question", prefer: Column | None = None) -> DataFrame:
    """BM25 search with metadata filters: (query_id, doc, score, rank). The filter comes after the statistics, so it doesn't change idf.

    Agent search with filter fallback: with prefer, a question's hits are those that pass it, or where none of its hits does,
    the others; the column preferred says which. Both classes come from the one pass: a task keeps k by class, then score.

    With a list of filters (None: all documents) it is a list of results, whose documents are counted once for all.

    The questions of a block are sent to the tasks by their terms. One pass over the documents counts, in place, how
    often each has the terms that are asked for, and writes that; lengths and document frequencies are sums over it.
    A second pass scores documents where they are and keeps k of each question a task, so what is shuffled is k
    rows a question and task, not every pair that shares a term. doc is an integer; rows are documents.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query).alias("query_id"), F.explode(X.tokens(F.coalesce(F.col(question), F.lit("")), stem)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    kind = queries.schema[query].dataType.simpleString()
    holds = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
    wheres = where if isinstance(where, list) else [where]
    rows = docs.select(F.col(doc).cast("long").alias("doc"), X.tokens(F.coalesce(F.col(text), F.lit("")), stem).alias("tokens"), holds(prefer).alias("preferred"), F.array(*map(holds, wheres)).alias("allowed"))
    none = spark.createDataFrame([], f"query_id {kind}, doc bigint, score double, preferred boolean")
    found = [none] * len(wheres)
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        if part:
            more = _search_block(rows, [(r["query_id"], r["term"], r["qf"]) for r in part], k, kind, len(wheres))
            found = [a.unionByName(b) for a, b in zip(found, more, strict=True)]
    if isinstance(where, list):
        return [top_k(f.drop("preferred"), k) for f in found]
    out = found[0]
    if prefer is None:
        return top_k(out.drop("preferred"), k)
    ordered = Window.partitionBy("query_id").orderBy(F.col("preferred").desc(), F.col("score").desc(), "doc")
    best = out.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
    return best.withColumn("__any", F.max("preferred").over(Window.partitionBy("query_id"))).where(F.col("preferred") == F.col("__any")).drop("__any")


def _search_block(rows: DataFrame, asked: list[tuple], k: int, kind: str, filters: int) -> list[DataFrame]:
    terms, ids = sorted({t for _, t, _ in asked}), sorted({q for q, _, _ in asked})
    number, column = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
    counts = materialized(rows.mapInArrow(_counter(terms), "doc bigint, dl bigint, preferred boolean, allowed array<boolean>, ids array<int>, tfs array<int>"), "counts")
    n, avgdl = counts.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(terms))
    for r in counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        df[r["id"]] = r["count"]
    by_term = sorted((number[t], column[q], f) for q, t, f in asked)
    begin = np.searchsorted(np.array([t for t, _, _ in by_term]), np.arange(len(terms) + 1))
    idf_ = np.where(df > 0, np.log(1 + ((n or 0) - df + 0.5) / (df + 0.5)), 0.0)
    shared = rows.sparkSession.sparkContext.broadcast((ids, idf_, begin, np.array([c for _, c, _ in by_term]), np.array([f for _, _, f in by_term], np.float64), max(avgdl or 0.0, 1e-9)))
    passing = (counts.where(F.get("allowed", F.lit(i))).select("doc", "dl", "ids", "tfs", "preferred") for i in range(filters))
    return [p.mapInArrow(_scorer(shared, k, kind), f"query_id {kind}, doc bigint, score double, preferred boolean") for p in passing]


def _counter(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in (b.slice(i, BLOCK_DOCS) for b in batches for i in range(0, b.num_rows, BLOCK_DOCS)):
            tokens = batch.column(1)
            dl = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.fill_null(pc.index_in(tokens.flatten().cast(pa.string()), value_set=known), -1).to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(dl)), dl)
            pairs, tf = np.unique(owner[found >= 0] * len(terms) + found[found >= 0], return_counts=True)
            owner, term = np.divmod(pairs, len(terms))
            offsets = pa.array(np.searchsorted(owner, np.arange(len(dl) + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl), batch.column(2), batch.column(3), *lists], ["doc", "dl", "preferred", "allowed", "ids", "tfs"])

    return run


def _scorer(shared, k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf_, begin, column, qf, avgdl = shared.value
        docs, best, liked = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0)), np.empty((len(ids), 0), bool)
        for batch in (b.slice(i, BLOCK_DOCS) for b in batches for i in range(0, b.num_rows, BLOCK_DOCS)):
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            term, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            owner = np.repeat(np.arange(batch.num_rows), size)
            length = np.maximum(batch.column(1).to_numpy(), 1)[owner] / avgdl
            weight_ = idf_[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
            each = begin[term + 1] - begin[term]
            at = np.arange(each.sum()) + np.repeat(begin[term] - np.cumsum(each) + each, each)
            scores = np.bincount(column[at] * batch.num_rows + np.repeat(owner, each), np.repeat(weight_, each) * qf[at], len(ids) * batch.num_rows).reshape(len(ids), -1)
            scores = np.where(scores > 0, np.round(scores, 6), -np.inf)
            docs = np.concatenate((docs, np.broadcast_to(batch.column(0).to_numpy(), scores.shape)), 1)
            best = np.concatenate((best, scores), 1)
            liked = np.concatenate((liked, np.broadcast_to(batch.column(4).to_numpy(zero_copy_only=False), scores.shape)), 1)
            order = np.lexsort((docs, -best, ~liked, best == -np.inf), axis=1)[:, :k]
            docs, best, liked = (np.take_along_axis(x, order, 1) for x in (docs, best, liked))
        query, place = np.nonzero(best > -np.inf)
        out = pa.array([ids[q] for q in query], pa.string() if kind == "string" else None)
        if kind != "string":
            out = out.cast({"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind])
        yield pa.RecordBatch.from_arrays([out, pa.array(docs[query, place]), pa.array(best[query, place]), pa.array(liked[query, place])], ["query_id", "doc", "score", "preferred"])

    return run


def overlap_rerank(hits: DataFrame, k: int, group: str = "query_id", tie: str = "doc", question: str = "question", text: str = "text") -> DataFrame:
    """Lexical-overlap rerank: coverage of the question's distinct stems, and a tenth of the share of the text's tokens among them."""
    q = F.array_distinct(X.tokens(F.col(question), stem=True))
    t = X.tokens(F.col(text), stem=True)
    d = hits.withColumn("__q", q).withColumn("__t", t)
    shared = F.size(F.filter("__t", lambda x: F.array_contains(F.col("__q"), x)))
    coverage = F.size(F.array_intersect("__q", "__t")) / F.size("__q")
    d = d.withColumn("overlap", F.when(F.size("__q") == 0, F.lit(None)).when(F.size("__t") == 0, 0.0).otherwise(coverage + F.lit(0.1) * shared / F.size("__t")))
    w = Window.partitionBy(group).orderBy(F.round("overlap", 6).desc_nulls_last(), "rank", tie)
    return d.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).drop("__q", "__t")
