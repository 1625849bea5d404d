"""Answers against their sources: claim map, evidence spans, claim support, deterministic answer scores, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import guard
from lexiloom.functions import text as X

LINKED = 0.34


def statements(answers: DataFrame) -> DataFrame:
    """(answer_id, place, text, cites) of the factual sentences before the tips; answers has answer_id, text, n_hits."""
    facts = guard.factual_sentences(guard.split_tips(F.col("text"))["body"])
    s = answers.select("answer_id", "n_hits", F.posexplode(facts).alias("place", "s"))
    cites = F.array_sort(F.array_distinct(F.filter(guard.cited_numbers(F.col("s")), lambda n: (n >= 1) & (n <= F.col("n_hits")))))
    plain = F.trim(F.regexp_replace(F.regexp_replace("s", guard.CITE, ""), r"\s+([.।,;:])", "$1"))
    return s.select("answer_id", "place", plain.alias("text"), cites.alias("cites"))


def claim_map(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Claim map: each statement with status linked, check or uncited. hits has answer_id, n, citation, body.

    Linked: all numbers of the statement are in the cited excerpts, and a third of its stems, unless the scripts differ.
    """
    s = statements(answers)
    cited = s.select("answer_id", "place", F.explode("cites").alias("n")).join(hits, ["answer_id", "n"])
    source = cited.groupBy("answer_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "citation", "body"))), lambda h: F.concat_ws("\n", h["citation"], h["body"])), " ").alias("source"))
    j = s.join(source, ["answer_id", "place"], "left")
    overlap = F.round(X.share_found(X.stems(F.col("text")), X.stems(F.col("source"))), 3)
    missing = F.array_except(F.array_except(X.numbers_in(F.col("text")), X.numbers_in(F.col("source"))), F.transform("cites", lambda n: n.cast("string")))
    a, b = X.detect_language(F.col("text")), X.detect_language(F.col("source"))
    same = (a == b) | ((a == "mixed") & b.isin("bn", "en")) | ((b == "mixed") & a.isin("bn", "en"))
    ok = (F.size(missing) == 0) & (~same | (overlap >= LINKED))
    return j.select(
        "answer_id", "place", "text", "cites", F.when(F.size("cites") == 0, "uncited").when(ok, "linked").otherwise("check").alias("status"),
        F.when(F.size("cites") > 0, overlap).alias("overlap"), F.when(F.size("cites") > 0, F.array_sort(missing)).alias("missing"),
    )


def claim_summary(claims: DataFrame) -> DataFrame:
    """Claim summary and verdict."""
    g = claims.groupBy("answer_id").agg(F.count("*").alias("statements"), *(F.count_if(F.col("status") == s).alias(s) for s in ("linked", "check", "uncited")))
    no = F.lit(False)
    return g.withColumn("verdict", guard.verdict(no, no, no, F.col("statements"), F.col("linked")))


def evidence_spans(claims: DataFrame, hits: DataFrame, least: float = 0.25, most: int = 3) -> DataFrame:
    """Evidence spans: (answer_id, n, clause, place), the best clause of each cited excerpt for each statement, three an excerpt."""
    j = claims.select("answer_id", "place", "text", F.explode("cites").alias("n")).join(hits, ["answer_id", "n"])
    best = j.withColumn("b", guard.best_clause(F.col("text"), F.col("body"))).where(F.col("b.score") >= least)
    once = best.groupBy("answer_id", "n", F.col("b.clause").alias("clause")).agg(F.min("place").alias("place"))
    w = Window.partitionBy("answer_id", "n").orderBy("place", "clause")
    return once.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).drop("i")


def claim_support(answers: DataFrame, hits: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Claim support and entailed citations: the best lexical entailment of each claim by an excerpt it cites."""
    c = answers.select("answer_id", F.posexplode(guard.claims(F.col("text"), F.col("n_hits"))).alias("place", "c"))
    j = c.select("answer_id", "place", F.col("c.claim").alias("claim"), F.explode("c.cited").alias("n")).join(hits.select("answer_id", "n", "body"), ["answer_id", "n"])
    scored = j.withColumn("score", F.round(guard.lexical_entailment(F.col("body"), F.col("claim")), 3))
    return scored.groupBy("answer_id", "place", "claim").agg(F.max("score").alias("score"), (F.max("score") >= threshold).alias("supported"), F.array_sort(F.collect_set(F.when(F.col("score") >= threshold, F.col("n")))).alias("entailed"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """Deterministic answer scores of answers (answer_id, gold, keys, cited, refused): refusal, citations, gold retrieved and cited.

    citation_precision is null where nothing is cited.
    """
    valid = F.filter("cited", lambda n: (n >= 1) & (n <= F.size("keys")))
    keys = F.transform(valid, lambda n: F.get("keys", n - 1))
    answerable = F.size("gold") > 0
    right = F.size(F.filter(keys, lambda k: F.array_contains(F.col("gold"), k)))
    return answers.select(
        "answer_id", (F.col("refused") != answerable).cast("double").alias("refusal_correct"), (F.size(valid) == F.size("cited")).cast("double").alias("citation_validity"), F.size("cited").cast("double").alias("n_citations"),
        F.when(answerable, F.arrays_overlap("gold", "keys").cast("double")).alias("gold_retrieved"), F.when(answerable, (right > 0).cast("double")).alias("gold_cited"),
        F.when(answerable, F.try_divide(right, F.size(keys))).alias("citation_precision"),
    )


def format_context(hits: DataFrame, most: int = 1500) -> DataFrame:
    """Context rendering and evidence rendering: numbered excerpts of a question in rank order, bodies cut."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.lit("\n"), F.left("body", F.lit(most)))
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("p"))
    return g.select("query_id", F.array_join(F.transform("p", lambda s: s["t"]), "\n\n").alias("context"))


def prompt(context: Column, question: Column) -> Column:
    """Prompt build."""
    return F.concat(F.lit("Excerpts:\n"), context, F.lit("\n\n"), guard.quote_user_text(question))


def source_card(n: Column, title: Column, citation: Column, body: Column, url: Column, act_id: Column, fetched: Column, built: Column, most: int = 1200) -> Column:
    """Source card projection and provenance struct: the fetch day wins over the index's day, with its kind."""
    return F.struct(
        n.alias("n"), title.alias("title"), citation.alias("citation"), F.left(body, F.lit(most)).alias("body"), X.act_url(url, act_id).alias("act_url"),
        F.coalesce(fetched, X.utc_day(built)).alias("as_of"), F.when(fetched.isNotNull(), "fetched").when(built.isNotNull(), "index").alias("as_of_kind"),
    )


def support_gate(hits: DataFrame, least_score: float, least_hits: int = 1) -> DataFrame:
    """Support gate: whether enough hits of a question reach the score."""
    return hits.groupBy("query_id").agg((F.count_if(F.col("score") >= least_score) >= least_hits).alias("supported"), F.max("score").alias("top"))


def live_check(cited: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Live check join: current where the newer page still has the body, changed, or unavailable."""
    j = cited.join(snapshot.select("url", F.col("text").alias("__live")), "url", "left")
    state = F.when(F.col("__live").isNull(), "unavailable").when(F.contains(X.flat(F.col("__live")), X.flat(F.col("body"))), "current").otherwise("changed")
    return j.withColumn("state", state).drop("__live")
