"""Retrieval metrics per question, their aggregates and slices, diagnosis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def gold_ranks(retrieved: DataFrame) -> DataFrame:
    """Rank of gold: rows (query_id, key, rank) with ranks over distinct keys in retrieval order."""
    first = retrieved.groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key")))


def evaluate(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """All metrics per query: hit, recall, precision, MRR, nDCG and graded nDCG at each k, for questions of gold (query_id, key, grade).

    precision divides by what was returned where that is less than k; a question without results scores 0.
    """
    ranks = gold_ranks(retrieved)
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("g"), F.array_sort(F.collect_list("grade"), lambda a, b: b - a).alias("grades"))
    found = ranks.join(gold, ["query_id", "key"], "left")
    hit = F.col("grade").isNotNull()
    gain = (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1.0)
    sums = [F.min(F.when(hit, F.col("rank"))).alias("first"), F.count("*").alias("returned")]
    for k in ks:
        top = F.col("rank") <= k
        sums += [F.count_if(hit & top).alias(f"n{k}"), F.sum(F.when(hit & top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"d{k}"), F.sum(F.when(hit & top, gain).otherwise(0.0)).alias(f"e{k}")]
    d = sizes.join(found.groupBy("query_id").agg(*sums), "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [F.col("query_id"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("g"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        graded = F.aggregate(
            F.transform(F.slice("grades", 1, k), lambda x, i: (F.pow(F.lit(2.0), x) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x
        )
        out += [
            (n(f"n{k}") > 0).cast("double").alias(f"hit@{k}"),
            (n(f"n{k}") / F.col("g")).alias(f"recall@{k}"),
            (n(f"n{k}") / F.greatest(F.least(n("returned"), F.lit(k)), F.lit(1))).alias(f"precision@{k}"),
            (n(f"d{k}") / ideal).alias(f"ndcg@{k}"),
            F.coalesce(F.try_divide(n(f"e{k}"), graded), F.lit(0.0)).alias(f"graded_ndcg@{k}"),
        ]
    return d.select(*out)


def summarize(per_query: DataFrame, metrics: list[str], slices: tuple[str, ...] = ("language", "type")) -> DataFrame:
    """Metric mean and slice aggregate: overall and by each slice in one pass (grouping sets); NaN and null don't count."""
    aggs = []
    for m in metrics:
        v = F.when(~F.isnan(m), F.col(m))
        aggs += [F.round(F.avg(v), 6).alias(m), F.count(v).alias(f"n_{m}")]
    return per_query.groupingSets([[], *([F.col(s)] for s in slices)], *map(F.col, slices)).agg(*aggs)


def diagnose(gold: Column, candidates: Column, top: Column, cited: Column, correct: Column, corpus: Column) -> Column:
    """Failure stage of a question, the first that applies; arrays of section keys, null where not known."""
    lost = lambda pool: pool.isNotNull() & ~F.arrays_overlap(gold, pool)
    return (
        F.when(F.size(gold) == 0, "ok")
        .when(lost(corpus), "not_in_corpus")
        .when(~F.arrays_overlap(gold, candidates), "retrieval_miss")
        .when(~F.arrays_overlap(gold, top), "ranking_miss")
        .when(lost(cited), "citation_miss")
        .when(correct == F.lit(False), "answer_miss")
        .otherwise("ok")
    )


STAGES = ("not_in_corpus", "retrieval_miss", "ranking_miss", "citation_miss", "answer_miss", "ok")


def stage_histogram(diagnosed: DataFrame, by: str) -> DataFrame:
    """Stage histogram, a column for each stage."""
    return diagnosed.groupBy(by).pivot("stage", list(STAGES)).count().na.fill(0)


def worst_stage(diagnosed: DataFrame) -> DataFrame:
    """Worst stage verdict: the failure with most questions, the earlier of equal ones."""
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)))
    counts = diagnosed.where("stage <> 'ok'").groupBy("stage").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), rank[F.col("stage")]).limit(1)


def threshold_sweep(rows: DataFrame, score: str, answerable: str, gold_hit: str, steps: int = 12) -> DataFrame:
    """Threshold sweep: evenly spaced thresholds against rates of answering, keeping gold and abstaining."""
    bounds = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    cut = bounds.select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"), "lo", "hi").select(F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (steps - 1), 6).alias("threshold"))
    j = rows.crossJoin(F.broadcast(cut))
    over = F.col(score) >= F.col("threshold")
    share = lambda cond, of: F.avg(F.when(of, cond.cast("double")))
    kept, abstain = share(over, F.col(gold_hit)), share(~over, ~F.col(answerable))
    return j.groupBy("threshold").agg(
        F.round(share(over, F.col(answerable)), 6).alias("answer_rate"), F.round(kept, 6).alias("gold_kept"), F.round(abstain, 6).alias("correct_abstain"), F.round((kept + abstain) / 2, 6).alias("balance")
    )


def grid_argmax(runs: DataFrame, params: list[str], metric: str) -> DataFrame:
    """Grid search: the parameters of the best mean, the least of equal ones."""
    means = runs.groupBy(*params).agg(F.round(F.avg(metric), 6).alias(metric))
    return means.orderBy(F.col(metric).desc(), *params).limit(1)


def validate_eval(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """Eval-set validation: (id, problems) of items (id, question, language, type, gold, gold_grades) against corpus keys (key)."""
    w, q = Window.partitionBy("id"), Window.partitionBy(F.lower(F.trim("question")))
    keys = items.select("id", F.explode("gold").alias("key")).distinct()
    lost = keys.join(corpus, "key", "left_anti").groupBy("id").agg(F.count("*").alias("lost"))
    d = items.withColumn("__id", F.count("*").over(w)).withColumn("__q", F.count("*").over(q)).join(lost, "id", "left")
    size = F.size("gold")
    rules = [
        (F.coalesce(F.col("id"), F.lit("")) == "", "no id"),
        (F.col("__id") > 1, "id is used twice"),
        (F.coalesce(F.trim("question"), F.lit("")) == "", "no question"),
        (F.col("__q") > 1, "question is used twice"),
        (~F.col("language").isin("bn", "en", "mixed"), "unknown language"),
        (~F.col("type").isin("single", "multi", "exact_ref", "unanswerable", "paraphrase"), "unknown type"),
        ((F.col("type") == "unanswerable") & (size > 0), "unanswerable with gold"),
        ((F.col("type") != "unanswerable") & (size == 0), "no gold"),
        ((F.col("type") == "multi") & (size < 2), "multi needs two gold sections"),
        (size != F.size(F.array_distinct("gold")), "gold repeats"),
        (F.exists("gold", lambda g: ~g.rlike("^[0-9]+:[0-9]+$")), "gold key is not act:section"),
        (F.exists(F.map_values("gold_grades"), lambda g: ~g.between(1, 3)), "grade is not 1 to 3"),
        (F.exists(F.map_keys("gold_grades"), lambda g: ~F.array_contains(F.col("gold"), g)), "grade of what is not gold"),
        (F.col("lost") > 0, "gold is not in the corpus"),
    ]
    return d.select("id", F.array_compact(F.array(*(F.when(c, m) for c, m in rules))).alias("problems"))


def mean_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)
