"""Rank fusion, caps, diversity, boosts and promotion over ranked lists of many questions at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(lists: list[DataFrame], weights: list[float] | None = None, rrf_k: int = 60, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, doc, rank): the sum of w / (rrf_k + rank); ties by first list and rank there."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError(f"{len(lists)} lists, but {len(weights)} weights")
    tagged = [d.select("query_id", "doc", F.lit(i).alias("l"), "rank", F.lit(float(w)).alias("w")) for i, (d, w) in enumerate(zip(lists, weights, strict=True))]
    both = tagged[0]
    for d in tagged[1:]:
        both = both.unionByName(d)
    fused = both.groupBy("query_id", "doc").agg(F.round(F.sum(F.col("w") / (F.lit(rrf_k) + F.col("rank"))), 9).alias("score"), F.min(F.struct("l", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first", "doc")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def cap_per_group(hits: DataFrame, group: list[str], most: int = 2) -> DataFrame:
    """Per-section cap: the first `most` of each group of a question; ranks are closed up."""
    w = Window.partitionBy("query_id", *group).orderBy("rank")
    kept = hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def boost_in_force(hits: DataFrame, omitted: Column, repealed: Column) -> DataFrame:
    """In-force boost: 0.3 of the score off what is omitted, 0.5 off what is repealed; the order before breaks ties."""
    off = F.when(omitted, 0.3).otherwise(0.0) + F.when(repealed, 0.5).otherwise(0.0)
    size = F.when(F.col("score") == 0, 1.0).otherwise(F.abs("score"))
    d = hits.withColumn("score", F.round(F.col("score") - off * size, 6))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")))


def promote_references(hits: DataFrame, exact: DataFrame, wanted: Column) -> DataFrame:
    """Reference promotion: looked-up rows (query_id, doc, place) first, then wanted hits, then the rest in order.

    Promoted scores stay in descending order just over the best score, so that later thresholds see the new order.
    """
    first = exact.select("query_id", "doc", F.lit(0).alias("class"), F.col("place").alias("at"), F.lit(None).cast("double").alias("score"))
    rest = hits.join(exact, ["query_id", "doc"], "left_anti").select("query_id", "doc", F.when(wanted, 1).otherwise(2).alias("class"), F.col("rank").alias("at"), "score")
    ordered = first.unionByName(rest)
    everything = Window.partitionBy("query_id")
    d = ordered.withColumn("rank", F.row_number().over(everything.orderBy("class", "at", "doc")))
    tops = hits.where("rank = 1").select("query_id", F.col("score").alias("top"))
    d = d.join(tops, "query_id", "left").withColumn("n", F.count("*").over(everything))
    raised = F.coalesce("top", F.lit(1.0)) + (F.col("n") - F.col("rank") + 1) * F.lit(1e-6)
    return d.select("query_id", "doc", "rank", F.round(F.when(F.col("class") < 2, raised).otherwise(F.col("score")), 8).alias("score"), (F.col("class") == 0).alias("requested"))


def pin_topics(hits: DataFrame, pinned: DataFrame, k: int, slots: int) -> DataFrame:
    """Topic pinning: up to `slots` of pinned (query_id, doc, place) stand in the top k, missing ones last with the lowest score there.

    At least two places stay with the search where k allows it; what the search ranks in the top k keeps its place.
    """
    slots = min(slots, max(k - 2, 1))
    if slots <= 0:
        return hits.where(F.col("rank") <= k).withColumn("pinned", F.lit(False))
    w = Window.partitionBy("query_id").orderBy("place", "doc")
    chosen = pinned.withColumn("__p", F.row_number().over(w)).where(F.col("__p") <= slots).select("query_id", "doc", "__p")
    top = hits.where(F.col("rank") <= k)
    missing = chosen.join(top, ["query_id", "doc"], "left_anti")
    room = missing.groupBy("query_id").agg(F.count("*").alias("__m"))
    marked = top.join(chosen, ["query_id", "doc"], "left").join(room, "query_id", "left")
    kept = marked.where(F.col("rank") <= k - F.coalesce("__m", F.lit(0))).select("query_id", "doc", "rank", "score", F.col("__p").isNotNull().alias("pinned"))
    floor = kept.groupBy("query_id").agg(F.max("rank").alias("__r"), F.min_by("score", F.col("rank") * -1).alias("__s"))
    added = missing.withColumn("__o", F.row_number().over(Window.partitionBy("query_id").orderBy("__p"))).join(floor, "query_id", "left")
    added = added.select("query_id", "doc", (F.coalesce("__r", F.lit(0)) + F.col("__o")).alias("rank"), F.coalesce("__s", F.lit(1.0)).alias("score"), F.lit(True).alias("pinned"))
    return kept.unionByName(added)


def sandwich_order(rank: Column, requested: Column) -> list[Column]:
    """Sandwich order, as sort keys: requested rows, then odd ranks up, then even ranks down."""
    odd = rank % 2 == 1
    return [F.when(requested, 0).when(odd, 1).otherwise(2), F.when(requested | odd, rank).otherwise(-rank)]


def mmr(hits: DataFrame, k: int, lambda_: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over hits (query_id, doc, rank, score, vector): greedy, so one question's list is one group.

    Lists are search results, some tens of rows each. Ties go to the earlier hit.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        v = np.stack(pdf["vector"].to_numpy()).astype(float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        rel = pdf["score"].to_numpy(float)
        span = rel.max() - rel.min()
        rel = (rel - rel.min()) / span if span > 0 else rel
        sims, nearest, left, order = v @ v.T, np.full(len(pdf), -np.inf), np.ones(len(pdf), bool), []
        while left.any() and len(order) < k:
            gain = rel if not order else lambda_ * rel - (1 - lambda_) * nearest
            i = int(np.argmax(np.where(left, np.round(gain, 12), -np.inf)))
            order.append(i)
            left[i] = False
            nearest = np.maximum(nearest, sims[i])
        out = pdf.loc[order, ["query_id", "doc", "score"]].copy()
        out["rank"] = np.arange(1, len(order) + 1)
        return out[["query_id", "doc", "rank", "score"]]

    return hits.groupBy("query_id").applyInPandas(pick, "query_id bigint, doc bigint, rank int, score double")


def evidence_numbers(turns: DataFrame) -> DataFrame:
    """Stable evidence numbering: (doc, number) by first place seen, from 1, over rows (session, doc, place)."""
    first = turns.groupBy("session", "doc").agg(F.min("place").alias("place"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("session").orderBy("place", "doc"))).select("session", "doc", "number")


def balanced_sample(rows: DataFrame, groups: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """Balanced round-robin sample: a seeded order in each group, then one of each group in turn, n in all. A task keeps n of a group."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    dealt = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*groups).orderBy(h, key)))
    return dealt.where(F.col("turn") <= n).orderBy("turn", *groups, key).limit(n)
