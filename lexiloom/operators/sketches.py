"""Mergeable sketches kept by day: distinct counts, quantiles and heavy hitters over any span, without the rows; and exact answers that start from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialized

#: log2 of the registers of a distinct sketch; values kept by a quantile sketch; items tracked by a heavy-hitter sketch.
REGISTERS, VALUES, ITEMS = 16, 4000, 10_000


def daily(rows: DataFrame, keys: list[str], item: str, value: str, time: str = "ts", registers: int = REGISTERS, values: int = VALUES, items: int = ITEMS) -> DataFrame:
    """(day, keys, n, items, distinct, quantiles, tops): one row a day and key, of bounded size, to be kept as a table.

    Partial sketches are combined before the shuffle, so a day or key with most rows is no large group. Rows without a time go to
    the null day; null items and values don't count.
    """
    day = F.to_date(time).alias("day")
    return rows.groupBy(day, *keys).agg(
        F.count("*").alias("n"), F.count(item).alias("n_items"), F.hll_sketch_agg(F.col(item), F.lit(registers)).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(values)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {items})").alias("tops"),
    )


def combined(kept: DataFrame, keys: list[str], k: int = 5, ranks: tuple[float, ...] = (0.5, 0.9), items: int = ITEMS) -> DataFrame:
    """(keys, n, n_items, distinct, quantiles, tops) of all days of kept: estimates from the days' sketches alone.

    How far each may be off is in error_bounds. tops has rows (item, count), greatest counts first, exact while no day and no
    union has more items than are tracked; so are quantiles while there are fewer values than are kept.
    """
    d = kept.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_items").alias("n_items"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("__q"),
        F.expr(f"approx_top_k_combine(tops, {items})").alias("__t"),
    )
    quantile = [F.kll_sketch_get_quantile_double(F.col("__q"), F.lit(float(r))) for r in ranks]
    return d.withColumns({"quantiles": F.array(*quantile), "tops": F.expr(f"approx_top_k_estimate(__t, {k})")}).drop("__q", "__t")


def error_bounds(n_items: int, registers: int = REGISTERS, values: int = VALUES, items: int = ITEMS) -> dict[str, float]:
    """What `combined` may be off by: relative for distinct (three standard errors), in rank for quantiles, in occurrences for tops."""
    tracked = 2 ** math.ceil(math.log2(items / 0.75))
    return {"distinct": 3 * 1.04 / 2 ** (registers / 2), "rank": 2.296 / values**0.9723, "tops": 3.5 * n_items / tracked}


def tallied(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column, n): how often each value occurs, nulls left out; summed over tables it is the tally of all."""
    n = F.sum("n") if "n" in rows.columns else F.count("*")
    return rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(n.alias("n"))


def exact_tops(tally: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """(keys, distinct, tops) of a tally of items: what distinct and heavy-hitter sketches estimate. tops has rows (item, count), ties by the least item."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), item)
    best = tally.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= k)
    tops = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.col(item).alias("item"), F.col("n").alias("count")))), lambda t: F.struct(t["item"].alias("item"), t["count"].alias("count"))).alias("tops"))
    return tally.groupBy(*keys).agg(F.count("*").alias("distinct")).join(tops, keys)


def exact_quantile(tally: DataFrame, band: DataFrame, keys: list[str], value: str, rank: float) -> DataFrame:
    """(keys, quantile): the least value with a share of rank of all at or below it, from a tally of values and a band (keys, low, high) that a sketch says it is in.

    Values below the band are only counted, those inside are taken in order, so few rows are sorted. A key whose value turns out to
    lie outside its band is done again with all its values: the answer never rests on the sketch.
    """
    tally = materialized(tally, "tally")
    band = materialized(band.select(*keys, "low", "high"), "bands")
    total = tally.groupBy(*keys).agg(F.sum("n").alias("__all")).select(*keys, F.greatest(F.ceil(F.col("__all") * F.lit(rank)), F.lit(1)).alias("__at"))

    def pick(rows: DataFrame, low, high) -> DataFrame:
        near = rows.where(high.isNull() | (F.col(value) <= high)).withColumn("__v", F.when(low.isNull() | (F.col(value) >= low), F.col(value)))
        near = near.groupBy(*keys, "__v").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        upto = near.withColumn("__upto", F.sum("n").over(w)).join(total, keys).where(F.col("__upto") >= F.col("__at"))
        return upto.groupBy(*keys).agg(F.min_by("__v", "__upto").alias("quantile")).where("quantile is not null")

    found = materialized(pick(tally.join(F.broadcast(band), keys, "left"), F.col("low"), F.col("high")), "quantiles")
    left = total.join(found, keys, "left_anti")
    if left.isEmpty():
        return found
    return found.unionByName(pick(tally.join(left.select(*keys), keys, "left_semi"), F.lit(None), F.lit(None)))
