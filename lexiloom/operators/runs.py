"""Runs side by side: precomputed retrieval scored, compared with a baseline, gated, and what failed; service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import stats
from lexiloom.operators import metrics


def score_precomputed(runs: DataFrame, gold: DataFrame, names: list[str], ks: tuple[int, ...] = metrics.KS) -> DataFrame:
    """Score a precomputed run: (run, query_id, metrics) of runs (run, query_id, keys: array in retrieval order) for every question of gold.

    All runs named are scored in one job. A question that a run has no row for scores 0; one without gold has no row.
    """
    whole = F.struct("run", "query_id")
    retrieved = runs.select(whole.alias("query_id"), F.posexplode("keys").alias("at", "key")).select("query_id", "key", (F.col("at") + 1).alias("rank"))
    wanted = gold.withColumn("run", F.explode(F.array(*map(F.lit, names)))).select(whole.alias("query_id"), "key", "grade")
    found = metrics.evaluate(retrieved, wanted, ks)
    return found.select("query_id.run", "query_id.query_id", *[F.col(f"`{c}`") for c in found.columns if c != "query_id"])


def compare_runs(scored: DataFrame, baseline: str, metric: str) -> DataFrame:
    """CI baseline join and multi-run compare: (run, n, before, after, delta, lo, hi, verdict) of each other run against the baseline run.

    Only questions that both have a score for count. Differences are counted by value before they are resampled, so what meets in
    one row grows with different values, not with questions. verdict is better or worse where the interval of the
    paired difference leaves 0, else within noise.
    """
    value = scored.select("run", "query_id", F.col(f"`{metric}`").alias("v")).where("v is not null and not isnan(v)")
    before = value.where(F.col("run") == baseline).select("query_id", F.col("v").alias("b"))
    paired = value.where(F.col("run") != baseline).join(before, "query_id")
    counts = paired.groupBy("run", (F.col("v") - F.col("b")).alias("d")).agg(F.count("*").alias("k"), F.sum("b").alias("b"), F.sum("v").alias("v"))
    each = F.array_sort(F.collect_list(F.struct("d", "k")))
    g = counts.groupBy("run").agg(F.sum("k").alias("n"), (F.sum("b") / F.sum("k")).alias("before"), (F.sum("v") / F.sum("k")).alias("after"), each.alias("e"))
    ci = stats.bootstrap_ci_counts(F.transform("e", lambda s: s["d"]), F.transform("e", lambda s: s["k"]))
    g = g.withColumn("ci", ci).withColumn("delta", F.col("after") - F.col("before"))
    verdict = F.when(F.col("ci.lo") > 0, "better").when(F.col("ci.hi") < 0, "worse").otherwise("within noise")
    return g.select("run", "n", "before", "after", "delta", F.col("ci.lo").alias("lo"), F.col("ci.hi").alias("hi"), verdict.alias("verdict"))


def gate(delta: Column, after: Column, tolerance: float = 0.03, floor: float | None = None) -> Column:
    """CI gate: passes where the mean fell by no more than the tolerance; without a baseline where it reaches the floor, if there is one."""
    return F.when(delta.isNotNull(), delta >= -abs(tolerance)).otherwise(F.lit(True) if floor is None else after >= F.lit(floor))


def failure_report(items: DataFrame, gold: DataFrame, pool: DataFrame, answers: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Failure report join: (query_id, question, stage) of each question with gold: where its answer went wrong first.

    items (query_id, question), gold (query_id, key), pool (query_id, key, rank) the candidates, of which those to rank k are the
    excerpts, answers (query_id, cited: array of keys, refused), corpus (key). A question without an answer is judged by retrieval alone.
    """
    keys = lambda df, name: df.groupBy("query_id").agg(F.collect_set("key").alias(name))
    there = gold.join(corpus.select("key").distinct(), "key", "left_semi")
    none = F.array().cast(gold.select(F.array("key")).schema[0].dataType)
    d = items.join(keys(gold, "gold"), "query_id")
    for df, name in ((pool, "candidates"), (pool.where(F.col("rank") <= k), "top"), (there, "present")):
        d = d.join(keys(df, name), "query_id", "left").withColumn(name, F.coalesce(name, none))
    d = d.join(answers.select("query_id", "cited", (~F.col("refused")).alias("correct")), "query_id", "left")
    stage = metrics.diagnose(F.col("gold"), F.col("candidates"), F.col("top"), F.col("cited"), F.col("correct"), F.col("present"))
    return d.select("query_id", "question", stage.alias("stage"))


def slo_breaches(requests: Column, p95_ms: Column, error_rate: Column, most_ms: float | None = None, most_errors: float | None = None) -> Column:
    """SLO breach rows: array of what was breached; a limit that isn't given isn't checked."""
    checks = []
    if most_ms is not None:
        checks.append(F.when(p95_ms > most_ms, F.format_string("p95 %.0f ms > %.0f ms", F.bround(p95_ms.cast("double"), 0), F.lit(float(most_ms)))))
    if most_errors is not None:
        checks.append(F.when(error_rate > most_errors, F.format_string("error rate %.2f%% > %.2f%%", F.bround(error_rate.cast("double") * 100, 2), F.lit(100.0 * most_errors))))
    checks.append(F.when(F.coalesce(requests, F.lit(0)) == 0, F.lit("no requests completed")))
    return F.array_compact(F.array(*checks))


def index_age(built: Column, now: Column, most_days: float = 45) -> Column:
    """Index-age check: struct(days, old); null where the build time isn't known."""
    days = (now.cast("double") - built.cast("double")) / 86400
    return F.when(built.isNotNull(), F.struct(days.alias("days"), (days > most_days).alias("old")))


def index_fingerprint(info: Column, built: Column) -> Column:
    """Index fingerprint: 16 digits that change with what the index is made of and when; the word none without an index."""
    return F.when(info.isNull(), "none").otherwise(F.left(F.sha2(F.concat(F.to_json(info), F.lit("@"), F.coalesce(built.cast("string"), F.lit(""))), 256), F.lit(16)))


def clamp_k(k: Column, default: int = 5, most: int = 20) -> Column:
    """k clamp: a whole number from 1 to most; the default where none can be read."""
    return F.least(F.greatest(F.coalesce(F.try_to_number(k.cast("string"), F.lit("S999999999")).cast("int"), F.lit(default)), F.lit(1)), F.lit(most))
