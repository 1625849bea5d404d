"""Statistics over rows: intervals, agreement, percentiles by index, bootstrap."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def index_percentile(values: Column, p: float) -> Column:
    """Percentile by index: the sorted values' element int(n p), at most the last. For groups of a bounded size."""
    n = F.size(values)
    return F.try_element_at(F.array_sort(values), F.least(F.floor(n * F.lit(p)).cast("int"), n - 1) + 1)


def grouped_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """index_percentile of groups of any size: counts of values summed in order, no list of a group is made."""
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*keys)
    counted = counted.withColumn("__upto", F.sum("__k").over(w.orderBy(value))).withColumn("__n", F.sum("__k").over(w))
    at = F.least(F.floor(F.col("__n") * F.lit(p)), F.col("__n") - 1)
    return counted.where(F.col("__upto") > at).groupBy(*keys).agg(F.min(value).alias(name))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson interval: struct(lo, hi), null without cases."""
    p = k / n
    zz = z * z
    centre = (p + zz / (2 * n)) / (1 + F.lit(zz) / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + F.lit(zz) / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("lo"), F.least(F.lit(1.0), centre + half).alias("hi")))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen kappa of two 0/1 columns: n, kappa; 1 where both agree by necessity, null without rows."""
    s = df.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", F.when(F.col("n") > 0, F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe))).alias("kappa"))


def histogram(df: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Histogram observe and cumulative histogram export: keys, le, count up to and with it, for each edge and infinity."""
    total = df.groupBy(*keys).agg(*(F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)), F.count(value).alias("inf"), F.sum(value).alias("total"))
    rows = F.array(*(F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)), F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n")))
    return total.select(*keys, "total", F.explode(rows).alias("b")).select(*keys, "b.le", "b.n", "total")


def _resample(values: list[float], resamples: int, seed: int) -> list[float]:
    rng, n = random.Random(seed), len(values)
    return sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))


def bootstrap_interval(values: list[float], level: float = 0.95, resamples: int = 2000, seed: int = 0) -> tuple[float, float, float]:
    """(mean, low, high) of the values by resampling with a seeded Mersenne Twister; nan without values."""
    kept = [v for v in values if v is not None and v == v]
    if not kept:
        return (float("nan"),) * 3
    means = _resample(kept, resamples, seed)
    tail = (1 - level) / 2
    return sum(kept) / len(kept), means[int(tail * resamples)], means[min(resamples - 1, int((1 - tail) * resamples))]


INTERVAL = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean", "lo", "hi")])


@F.pandas_udf(INTERVAL)
def bootstrap_ci(values: pd.Series) -> pd.DataFrame:
    """Bootstrap CI of an array column: one evaluation set a row, as long as the set. Arrow: Spark's rand has another generator."""
    return pd.DataFrame([bootstrap_interval([float(x) for x in v]) for v in values], columns=["mean", "lo", "hi"])


DIFFERENCE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("diff", "lo", "hi", "p_worse")])


@F.pandas_udf(DIFFERENCE)
def paired_bootstrap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Paired bootstrap of b - a over array columns with one place for each question."""
    out = []
    for x, y in zip(a, b, strict=True):
        d = [float(q) - float(p) for p, q in zip(x, y, strict=True) if p == p and q == q]
        if not d:
            out.append((float("nan"),) * 4)
            continue
        means = _resample(d, 2000, 0)
        out.append((sum(d) / len(d), means[int(0.025 * 2000)], means[int(0.975 * 2000)], sum(m <= 0 for m in means) / 2000))
    return pd.DataFrame(out, columns=["diff", "lo", "hi", "p_worse"])


def _resample_counts(values: np.ndarray, counts: np.ndarray, resamples: int = 2000, seed: int = 0) -> np.ndarray:
    """Sorted means of resamples of values that occur `counts` times each.

    How often each value is drawn is one multinomial draw a resample, the same law as drawing row by row; time and memory follow
    the distinct values, not the rows.
    """
    n = counts.sum()
    return np.sort(np.random.default_rng(seed).multinomial(n, counts / n, resamples) @ values / n)


def _counted(values: pd.Series, counts: pd.Series):
    """Values and counts of each row, without missing values."""
    for v, k in zip(values, counts, strict=True):
        v, k = np.asarray(v, np.float64), np.asarray(k, np.int64)
        yield v[~np.isnan(v)], k[~np.isnan(v)]


@F.pandas_udf(INTERVAL)
def bootstrap_ci_counts(values: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """bootstrap_ci of sets of any size, as arrays of distinct values and of how often each occurs."""
    out = []
    for v, k in _counted(values, counts):
        means = _resample_counts(v, k) if len(v) else None
        out.append((float("nan"),) * 3 if means is None else (v @ k / k.sum(), means[int(0.025 * 2000)], means[int(0.975 * 2000)]))
    return pd.DataFrame(out, columns=["mean", "lo", "hi"])


@F.pandas_udf(DIFFERENCE)
def paired_bootstrap_counts(a: pd.Series, b: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """paired_bootstrap of sets of any size, as arrays of distinct pairs and of how often each occurs."""
    pairs = pd.Series([np.asarray(y, np.float64) - np.asarray(x, np.float64) for x, y in zip(a, b, strict=True)], dtype=object)
    out = []
    for d, k in _counted(pairs, counts):
        means = _resample_counts(d, k) if len(d) else None
        out.append((float("nan"),) * 4 if means is None else (d @ k / k.sum(), means[int(0.025 * 2000)], means[int(0.975 * 2000)], (means <= 0).mean()))
    return pd.DataFrame(out, columns=["diff", "lo", "hi", "p_worse"])


def paired_verdict(lo: Column, hi: Column) -> Column:
    """Paired verdict table."""
    return F.when(lo > 0, "better").when(hi < 0, "worse").otherwise("within noise")


def detectable(n: int, base: float, lift: float, trials: int = 200, seed: int = 0) -> float:
    """Power simulation: share of trials in which a lift of a rate over n questions shows in the interval."""
    rng, seen = random.Random(seed), 0
    for _ in range(trials):
        d = [float(rng.random() < min(1.0, base + lift)) - float(rng.random() < base) for _ in range(n)]
        means = _resample(d, 200, seed)
        seen += means[int(0.025 * 200)] > 0
    return seen / trials


def false_merge_threshold(similarity: Column, margin: float) -> Column:
    """False-merge threshold: the greatest similarity of pairs that must not merge, and a margin, up to the next 0.005; 1 without a pair or where one is NaN."""
    most = F.max(similarity)
    return F.when(F.isnan(most), 1.0).otherwise(F.least(F.ceil(F.round((most + margin) / 0.005, 6)) * F.lit(0.005), F.lit(1.0)))


#: Price of a million tokens in and out, by a part of the model's name.
PRICES = {"haiku": (0.8, 4.0), "sonnet": (3.0, 15.0), "opus": (15.0, 75.0), "gpt-4o-mini": (0.15, 0.6), "gpt-4o": (2.5, 10.0), "ollama": (0.0, 0.0), "echo": (0.0, 0.0)}


def estimate_cost(model: Column, chars_in: Column, chars_out: Column) -> Column:
    """Cost estimate; 0 for unknown models. Monthly projection: times queries a day times 30."""
    from lexiloom.functions.text import estimate_tokens

    rate = lambda i: F.coalesce(*(F.when(F.contains(F.lower(model), F.lit(k)), F.lit(v[i])) for k, v in PRICES.items()), F.lit(0.0))
    return estimate_tokens(chars_in) / 1e6 * rate(0) + estimate_tokens(chars_out) / 1e6 * rate(1)
