"""Exact vector search, quantised search, the trigram hashing embedder. operators/ivf has the approximate index."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import text as X
from lexiloom.operators.lexical import top_k
from lexiloom.session import materialized

#: Questions that are held by every task at once; more are searched in several passes.
BLOCK_QUERIES = 4096
#: Scores that a task holds at once.
CELLS = 1 << 20
#: Numbers in a block of vectors, of which a task that compares two blocks holds two; blocks that a table is cut in at least, if each has LEAST_ROWS.
BLOCK_CELLS, LEAST_BLOCKS, LEAST_ROWS = 1 << 21, 12, 1024
#: Texts that a task embeds at once.
EMBED_ROWS = 200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(v: Column) -> Column:
    """L2 normalise."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def quantize(unit: Column) -> Column:
    """Vector append, int8 codes: round(v * 127)."""
    return F.transform(unit, lambda x: F.rint(x * 127).cast("tinyint"))


def append_vectors(index: DataFrame, new: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Vector append: unit length, with a check of the dimension that fails the job."""
    checked = F.when(F.size(vector) == dim, l2_normalize(F.col(vector))).otherwise(F.raise_error(F.lit(f"vectors must have {dim} dimensions")).cast("array<double>"))
    return index.unionByName(new.withColumn(vector, checked), allowMissingColumns=True)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """Dense top-k: (query_id, doc, score, rank) by cosine, filters first.

    Each block of questions (query_id, qv) is a matrix sent to the tasks; a task multiplies batches of vectors with
    it and keeps its k best for each question, so what is shuffled is k rows a question and task, not
    all pairs. One pass over the vectors for each BLOCK_QUERIES questions.
    """
    rows = vectors if where is None else vectors.where(where)
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(vector).alias("v"))
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    out = None
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "qv").collect()
        if not part:
            continue
        ids = np.array([r["query_id"] for r in part], np.int64)
        m = np.array([r["qv"] for r in part], np.float64)
        shared = spark.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)))
        found = rows.mapInArrow(_best(shared, k), "query_id bigint, doc bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, doc bigint, score double")
    return top_k(out.withColumn("score", F.round("score", 6)), k)


def most_alike(vectors: DataFrame, unlike: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Disjoint pairs' similarities: (score), whose maximum is the greatest cosine of two rows with other keys and other values of `unlike`.

    Every such pair counts. Rows are dealt out to blocks by a hash, each pair of blocks goes to a group, which multiplies the two
    and gives one row; so a task holds two blocks at any size, and nothing goes to the driver. Equal vectors of a value count once.
    The work is that of all pairs of distinct rows, and a row goes to as many groups as there are blocks. The cosine of a vector
    without length is NaN. Rows without key, value or vector are in no pair.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(unlike).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(unlike).alias("kind"), F.col(vector).alias("v"))
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, min(LEAST_BLOCKS, -(-n // LEAST_ROWS)), -(-n * (dim or 0) // BLOCK_CELLS))
    block = F.pmod(F.xxhash64("kind", "v"), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.groupBy("kind", "v").agg(F.min("id").alias("low"), F.max("id").alias("high")).select("*", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.groupBy(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).applyInArrow(_most_alike, "score double")


class _Block:
    """Unit vectors in the order of their kinds, with the least and greatest key of each."""

    def __init__(self, rows: pa.Table, kinds: np.ndarray):
        order = np.argsort(kinds, kind="stable")
        v = matrix(rows["v"].combine_chunks())[order]
        with np.errstate(all="ignore"):
            self.unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        self.kinds, self.low, self.high = kinds[order], *(rows[c].to_numpy()[order] for c in ("low", "high"))


def _most_alike(rows: pa.Table) -> pa.Table:
    kinds = np.unique(rows["kind"].to_numpy(), return_inverse=True)[1]
    at = rows["block"].to_numpy()
    parts = [_Block(rows.filter(pa.array(at == i)), kinds[at == i]) for i in np.unique(at)]
    best = -np.inf
    # a group of one block alone is that block with itself, or one whose other block is empty
    if len(parts) == 2 or (rows["other"].to_numpy() == at).all():
        best = _greatest(parts[0], parts[-1])
    return pa.table({"score": pa.array([] if best == -np.inf else [best], pa.float64())})


def _greatest(a: _Block, b: _Block) -> float:
    """The greatest cosine of a row of a and one of b with other kinds and keys, -inf without any; NaN if there is one."""
    best, step = -np.inf, max(1, CELLS // len(b.kinds))
    for i in range(0, len(a.kinds), step):
        start = i if a is b else 0
        kinds, other = a.kinds[i : i + step], b.kinds[start:]
        with np.errstate(all="ignore"):
            s = a.unit[i : i + step] @ b.unit[start:].T
        found, first, counts = np.unique(kinds, return_index=True, return_counts=True)
        for r, n, lo, hi in zip(first, counts, np.searchsorted(other, found), np.searchsorted(other, found, "right"), strict=True):
            s[r : r + n, lo:hi] = -np.inf
        if s.max() <= best:
            continue
        low, high = a.low[i : i + step, None], a.high[i : i + step, None]
        s[(low == high) & (low == b.low[start:]) & (high == b.high[start:])] = -np.inf
        best = np.maximum(best, s.max())
    return float(best)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors without nulls as a matrix of doubles."""
    if isinstance(column, pa.ListArray) and len(column):
        flat = column.flatten()
        if flat.null_count == 0 and len(flat) % len(column) == 0 and pc.min_max(pc.list_value_length(column))["min"].as_py() == len(flat) // len(column):
            return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.array(column.to_pylist(), np.float64)


def slices(batches: Iterator[pa.RecordBatch], questions: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about CELLS scores each, so that what a task holds depends on neither table."""
    step = max(1, CELLS // max(1, questions))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


class Nearest:
    """The k best of n questions, by score to 6 places and then the least id, of scores that come in blocks of questions by rows.

    A row is looked at again only where it reaches the k-th best score so far; a few times k of each question are held before the others go.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.floor = n, k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        q, r = np.nonzero((scores >= self.floor[:, None] - 1e-6) & (scores > -np.inf))
        self.add_pairs(q, docs[r], scores[q, r])

    def add_pairs(self, q: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((q, docs, scores))
        self.size += len(q)
        if self.size > max(4 * self.n * self.k, CELLS // 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        q, docs, scores = (np.concatenate(x) for x in zip(none, *self.parts, strict=True))
        rounded = np.round(scores, 6)
        order = np.lexsort((docs, -rounded, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q]
        order, q = order[place < self.k], q[place < self.k]
        last = place[place < self.k] == self.k - 1
        self.floor[q[last]] = rounded[order[last]]
        self.parts = [(q, docs[order], scores[order])]
        self.size = 0
        return self.parts[0]


def _best(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        found = Nearest(len(ids), k)
        for batch in slices(batches, len(ids)):
            v = matrix(batch.column(1))
            s = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T, 9)
            found.add(s, batch.column(0).to_numpy(zero_copy_only=False))
        who, docs, scores = found.cut()
        yield pa.RecordBatch.from_arrays([pa.array(ids[who], pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "doc", "score"])

    return run


_CODE = T.StructType([T.StructField("code", T.BinaryType()), T.StructField("slack", T.DoubleType()), T.StructField("twin", T.LongType())])


@F.pandas_udf(_CODE)
def packed_codes(vectors: pd.Series) -> pd.DataFrame:
    """Vector append, int8 codes: the unit vector's components times 127, rounded, one byte each; how far the unit vector is from
    what its code says; and a hash of the vector, by which copies are known. Null stays null."""
    out = []
    for v in vectors:
        if v is None:
            out.append((None, None, None))
            continue
        m = np.asarray(v, np.float64)[None]
        codes, slack = _codes(m)
        out.append((codes[0].tobytes(), float(slack[0]), int.from_bytes(hashlib.md5(m.tobytes()).digest()[:8], "little", signed=True)))
    found = pd.DataFrame(out, columns=["code", "slack", "twin"])
    return found.astype({"twin": "Int64"})


def _codes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    codes = np.rint(unit * 127)
    return codes.astype(np.int8), np.linalg.norm(unit - codes / 127, axis=1)


def code_table(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vectors with the columns code, slack and twin in place of the vector: a byte a dimension, what a quantised search reads first."""
    return vectors.withColumn("__c", packed_codes(F.col(vector))).drop(vector).select("*", "__c.*").drop("__c")


def quantized_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None, codes: DataFrame | None = None) -> DataFrame:
    """int8 quantised search: integer dot products of codes first, then exact scores of those that can be among the k best; filtered
    rows never come back.

    codes is a code_table of vectors that was written before; without one it is made on the way. Question vectors become codes
    too. Products are whole numbers (32 bits; 127 * 127 a dimension at most), nothing is turned back into floats
    before the exact stage. With r and s the distances of row and question from what their codes say, the product is off by
    r + (1 + r) s at most; a row goes only where that keeps it below k others, so the result is that of the exact search. Of
    copies the k least ids are looked at. Rows without a vector are no hits.
    """
    rows = vectors if where is None else vectors.where(where)
    kept = code_table(vectors, key, vector) if codes is None else codes
    kept = (kept if where is None else kept.where(where)).where("code is not null").select(F.col(key).cast("long").alias("doc"), "code", "slack", "twin")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    kind = "query_id bigint, doc bigint, low double, high double, twin bigint"
    first = vectors.sparkSession.createDataFrame([], kind)
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "qv").collect()
        if part:
            q, slack = _codes(np.array([r["qv"] for r in part], np.float64))
            shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in part], np.int64), q.astype(np.int32), slack))
            first = first.unionByName(kept.mapInArrow(_near_codes(shared, k), kind))
    first = materialized(first, "candidates")
    floor = top_k(first, k, by="low").groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).otherwise(float("-inf")).alias("floor"))
    copies = Window.partitionBy("query_id", "twin").orderBy("doc")
    first = first.join(floor, "query_id").where("high >= floor").withColumn("i", F.row_number().over(copies)).where(F.col("i") <= k).select("query_id", "doc")
    exact = first.join(rows.select(F.col(key).cast("long").alias("doc"), F.col(vector).alias("v")), "doc").join(queries, "query_id")
    scored = exact.select("query_id", "doc", F.round(dot(l2_normalize(F.col("v")), l2_normalize(F.col("qv"))), 6).alias("score"))
    return top_k(scored, k)


class _Candidates:
    """Rows that can be among the k best of n questions, by bounds (low, high) of their scores: all but those whose high is below k
    other rows' low, and of copies the k least ids."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.floor = n, k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        #: The k greatest lows of each question among what was given away.
        self.given = (np.empty(0, np.int64), np.empty(0))
        self.size = 0

    def add(self, low: np.ndarray, high: np.ndarray, docs: np.ndarray, twins: np.ndarray) -> None:
        q, r = np.nonzero(high >= self.floor[:, None])
        self.parts.append((q, docs[r], low[q, r], high[q, r], twins[r]))
        self.size += len(q)

    def cut(self) -> tuple[np.ndarray, ...]:
        """The candidates held, after the others are gone."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, np.int64))
        held = tuple(np.concatenate(x) for x in zip(none, *self.parts, strict=True))
        q, docs, twins = held[0], held[1], held[4]
        order = np.lexsort((docs, twins, q))
        start = np.flatnonzero(np.concatenate(([True], (q[order][1:] != q[order][:-1]) | (twins[order][1:] != twins[order][:-1])))) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        held = tuple(x[order[place < self.k]] for x in held)
        self._raise(np.concatenate((self.given[0], held[0])), np.concatenate((self.given[1], held[2])))
        good = held[3] >= self.floor[held[0]]
        held = tuple(x[good] for x in held)
        self.parts, self.size = [held], len(held[0])
        return held

    def _raise(self, q: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((-low, q))
        q, low = q[order], low[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q]
        last = place == self.k - 1
        self.floor[q[last]] = low[last]
        return q[place < self.k], low[place < self.k]

    def give(self) -> tuple[np.ndarray, ...]:
        """As cut, and no longer held."""
        held = self.cut()
        self.given = self._raise(np.concatenate((self.given[0], held[0])), np.concatenate((self.given[1], held[2])))
        self.parts, self.size = [], 0
        return held


def _near_codes(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, own = shared.value
        found = _Candidates(len(ids), k)
        out = lambda c: pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[c[0]], *c[1:])], ["query_id", "doc", "low", "high", "twin"])
        for batch in slices(batches, len(ids)):
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
            slack = batch.column(2).to_numpy()[None, :]
            score = (q @ m.T.astype(np.int32)) / 127**2
            off = slack + (1 + slack) * own[:, None] + 2e-6
            found.add(score - off, score + off, batch.column(0).to_numpy(), batch.column(3).to_numpy())
            if found.size > CELLS // 2:
                found.cut()
                if found.size > CELLS // 4:
                    yield out(found.give())
        yield out(found.give())

    return run


def trigram_embedding(text: Column, dim: int = 512) -> Column:
    """Trigram hashing embedder: sparse map bucket -> count of the trigrams of ' token ', the bucket by md5's first four bytes."""
    padded = F.transform(X.tokens(text), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))))
    return F.transform(grams, lambda g: trigram_bucket(g, dim))


def trigram_bucket(gram: Column, dim: int) -> Column:
    h = F.md5(gram.cast("binary"))
    little = F.concat(F.substr(h, F.lit(7), F.lit(2)), F.substr(h, F.lit(5), F.lit(2)), F.substr(h, F.lit(3), F.lit(2)), F.substr(h, F.lit(1), F.lit(2)))
    return (F.conv(little, 16, 10).cast("bigint") % dim).cast("int")


class _Buckets(dict):
    """The bucket of a trigram, as trigram_bucket says it; the most frequent ones are hashed once a task."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, gram: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[gram] = int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "little") % self.dim
        return found


def embed(docs: DataFrame, doc: str = "doc_id", text: str = "text", dim: int = 512) -> DataFrame:
    """Encode batch: (doc, bucket, value) of unit length; the dense vector is its pivot.

    A row is a document: its trigrams are counted where it is read, nothing is shuffled. Null and empty texts have no rows.
    """
    rows = docs.select(F.col(doc).alias("doc"), X.tokens(F.col(text)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(dim)
        for batch in (b.slice(i, EMBED_ROWS) for b in batches for i in range(0, b.num_rows, EMBED_ROWS)):
            who, where, values = [], [], []
            for at, tokens in enumerate(batch.column(1).to_pylist()):
                counts = np.zeros(dim)
                for token, n in Counter(tokens or ()).items():
                    padded = f" {token} "
                    for i in range(len(padded) - 2):
                        counts[buckets[padded[i : i + 3]]] += n
                own = np.flatnonzero(counts)
                who.append(np.full(len(own), at))
                where.append(own)
                values.append(counts[own] / math.sqrt(float(counts @ counts) or 1.0))
            if who:
                ids = batch.column(0).take(pa.array(np.concatenate(who), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(where), pa.int32()), pa.array(np.concatenate(values))], ["doc", "bucket", "value"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, bucket int, value double")


def save_vectors(index: DataFrame, path: str, dim: int, vector: str = "embedding") -> None:
    """Vector index write: vectors of unit length, and how many there are of how many dimensions."""
    units = append_vectors(index.limit(0), index, dim, vector)
    units.write.mode("overwrite").parquet(f"{path}/vectors")
    found = index.sparkSession.read.parquet(f"{path}/vectors")
    found.agg(F.count("*").alias("n"), F.lit(dim).alias("dim")).write.mode("overwrite").parquet(f"{path}/shape")


def load_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Vector index load; fails where rows are missing, or vectors have other dimensions than the embedder's."""
    found, shape = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/shape").first()
    if found.count() != shape["n"] or dim not in (None, shape["dim"]):
        raise ValueError(f"{path}: {shape['n']} vectors of {shape['dim']} dimensions were written")
    return found


def embed_new(chunks: DataFrame, known: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Resumable embed with reuse: (chunks with a known vector, distinct texts still to be embedded), by the text's hash."""
    keyed = chunks.withColumn("text_sha1", X.text_key(F.col(text)))
    return keyed.join(known, "text_sha1"), keyed.join(known, "text_sha1", "left_anti").dropDuplicates(["text_sha1"])
