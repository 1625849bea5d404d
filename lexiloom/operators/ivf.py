"""Remote ANN search as a table: vectors by nearest centroid, one partition a list; a search reads the lists it probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.lexical import top_k
from lexiloom.operators.vector import BLOCK_QUERIES, dense_top_k, l2_normalize
from lexiloom.session import materialized

#: Centroids are fitted on at most so many vectors, those with the least hash of their key. All rows are indexed.
FIT_VECTORS = 20_000
#: How many times as many lists are read where a question has too few hits.
WIDEN = 4
#: When an index is built, so many vectors by hash are searched for exactly; the lists that a search of a depth reads first are as many
#: as hold the share TARGET of that many hits. Vectors without clusters need most lists, others few.
TRIALS, DEPTHS, TARGET = 100, (10, 40, 160), 0.95
#: Parts that a list's rows are spread over when written, so that a list with a third of all rows is no single task.
SPREAD = 8
#: Hits that a task holds before it cuts them back to the k best of each question.
HELD_HITS = 1_000_000


def fit_centroids(vectors: DataFrame, lists: int, key: str = "vec_id", vector: str = "embedding", fit_vectors: int = FIT_VECTORS) -> np.ndarray:
    """Unit centroids (list, dimension) of the sample's unit vectors; fewer lists where the sample has fewer different vectors."""
    units = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(fit_vectors).select(l2_normalize(F.col(vector)).alias("u"))
    units = materialized(units.select(array_to_vector("u").alias("features"), F.xxhash64("u").alias("h")).repartition(8, "h").sortWithinPartitions("h"), "ivf_sample")
    different = units.select("h").distinct().count()
    if not different:
        return np.zeros((0, 0))
    if min(lists, different) == 1:  # the algorithm wants two at least
        return units.first()["features"].toArray()[None]
    centres = np.array(KMeans(k=min(lists, different), seed=11, maxIter=12).fit(units.select("features")).clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _nearest(centroids) -> Column:
    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        there = vectors.notna().to_numpy()
        out = np.full(len(vectors), -1)
        if there.any():
            out[there] = (np.stack(vectors[there].to_numpy()).astype(np.float64) @ centroids.value.T).argmax(1)
        return pd.Series(out)

    return nearest


def build(vectors: DataFrame, path: str, lists: int | None = None, key: str = "vec_id", vector: str = "embedding") -> None:
    """Writes path/lists (the rows, partitioned by list), path/centroids and path/probes. lists is the root of the number of rows unless given.

    Every row is written; one without a vector is in list -1, which no search reads. Columns are kept, so a search can filter by them.
    """
    spark = vectors.sparkSession
    lists = lists or max(1, round(vectors.count() ** 0.5))
    centroids = fit_centroids(vectors, lists, key, vector)
    shared = spark.sparkContext.broadcast(centroids)
    where = _nearest(shared)(F.col(vector)) if len(centroids) else F.lit(-1)
    rows = vectors.withColumn("list", where)
    rows.repartition("list", F.pmod(F.xxhash64(key), F.lit(SPREAD))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    table.write.mode("overwrite").parquet(f"{path}/centroids")
    found = spark.read.schema(rows.schema).parquet(f"{path}/lists")
    spark.createDataFrame(needed_probes(found, centroids, key, vector), "depth int, probes int").write.mode("overwrite").parquet(f"{path}/probes")


def needed_probes(index: DataFrame, centroids: np.ndarray, key: str, vector: str) -> list[tuple[int, int]]:
    """(depth, probes): how many lists, nearest first, hold TARGET of the `depth` exact hits of the TRIALS vectors with the least hash of their key."""
    there = index.where(F.col(vector).isNotNull())
    trials = materialized(there.orderBy(F.xxhash64(key, F.lit(1)), key).limit(TRIALS).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("qv")), "trials")
    hits = dense_top_k(there, trials, max(DEPTHS) + 1, key, vector).where("doc <> query_id").select("query_id", "doc", "rank")
    listed = hits.join(there.select(F.col(key).cast("long").alias("doc"), "list"), "doc").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "list"))).alias("l"))
    places: list[list[int]] = []
    for r in trials.join(listed, "query_id").collect():
        order = np.argsort(-(centroids @ np.array(r["qv"], np.float64)), kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        places.append([int(at[x["list"]]) for x in r["l"]])
    found = ((depth, [p for row in places for p in row[:depth]]) for depth in DEPTHS)
    return [(depth, int(np.quantile(p, TARGET, method="higher")) + 1 if p else 1) for depth, p in found]


def _first_probes(spark: SparkSession, path: str, index: DataFrame, kept: DataFrame, k: int, lists: int) -> int:
    """Lists to read first for k hits: those for as many hits as hold k that pass the filter, if that keeps an even share."""
    n, passing = index.count(), kept.count()
    depth = k * n / max(1, passing)
    fit = [r["probes"] for r in spark.read.parquet(f"{path}/probes").orderBy("depth").collect() if r["depth"] >= depth]
    return fit[0] if fit else lists


def _probe(index: DataFrame, questions: DataFrame, centroids: np.ndarray, first: int, last: int, k: int, key: str, vector: str) -> DataFrame:
    """The k best of each question among its first-nearest to last-nearest lists; only those partitions are read."""
    spark = index.sparkSession
    blocks = max(1, -(-questions.count() // BLOCK_QUERIES))
    out = spark.createDataFrame([], "query_id long, doc long, score double")
    for i in range(blocks):
        part = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        if not part:
            continue
        q = np.array([r["qv"] for r in part], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        lists = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, first:last]
        asking = {int(c): np.flatnonzero((lists == c).any(1)) for c in np.unique(lists)}
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in part], np.int64), q, asking))
        rows = index.where(F.col("list").isin(list(asking))).select("list", F.col(key).cast("long").alias("doc"), F.col(vector).alias("v"))
        out = out.unionByName(rows.mapInPandas(_best_of_lists(shared, k), "query_id bigint, doc bigint, score double"))
    return out


def _best_of_lists(shared, k: int):
    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(found).sort_values(["query_id", "score", "doc"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, asking = shared.value
        found, held = [], 0
        for batch in batches:
            for at, rows in batch.groupby("list"):
                who = asking[at]
                v = np.stack(rows["v"].to_numpy()).astype(np.float64)
                s = np.round(q[who] @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T, 6)
                docs = np.broadcast_to(rows["doc"].to_numpy(), s.shape)
                order = np.lexsort((docs, -s), axis=1)[:, :k]
                found.append(pd.DataFrame({"query_id": np.repeat(ids[who], order.shape[1]), "doc": np.take_along_axis(docs, order, 1).ravel(), "score": np.take_along_axis(s, order, 1).ravel()}))
                held += order.size
                if held > HELD_HITS:
                    found = [best(found)]
                    held = len(found[0])
        if found:
            yield best(found)

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Remote ANN search: (query_id, doc, score, rank) by cosine among the rows of the nearest lists that pass where.

    queries has (query_id, qv), one row a question. probes is what the index was measured to need for k hits, or k that pass where, unless given. where goes to the scan with the list, so lists are pruned as partitions and
    the rest is pushed to the files. A question with fewer than k hits is asked again with WIDEN times as many lists, until k
    survive or all lists were read: then its answer is the exact one. Centroids, lists * dimension numbers, are at the driver.
    """
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").select("centroid").collect()
    open_ = materialized(queries.select(F.col("query_id").cast("long").alias("query_id"), "qv").where("qv is not null"), "questions")
    best = spark.createDataFrame([], "query_id long, doc long, score double, rank int")
    if not rows:
        return best
    whole = spark.read.parquet(f"{path}/lists")
    index = whole if where is None else whole.where(where)
    centroids = np.array([r["centroid"] for r in rows])
    first, last = 0, min(probes or _first_probes(spark, path, whole, index, k, len(centroids)), len(centroids))
    while True:
        found = _probe(index, open_, centroids, first, last, k, key, vector)
        best = materialized(top_k(best.select("query_id", "doc", "score").unionByName(found), k), "hits")
        if last >= len(centroids):
            return best
        enough = best.groupBy("query_id").count().where(F.col("count") >= k)
        open_ = materialized(open_.join(enough, "query_id", "left_anti"), "questions")
        if open_.isEmpty():
            return best
        first, last = last, min(last * WIDEN, len(centroids))
