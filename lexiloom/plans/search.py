"""The search pipeline: many questions at once, one DataFrame from variants to the final top k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import chunking, lexical, rank, refs, vector
from lexiloom.operators.sets import metadata_filter
from lexiloom.session import UNIONS, materialized


@dataclass(frozen=True)
class SearchOptions:
    """Options of a search; the defaults are lexical search with all the rules that need no model."""

    k: int = 5
    candidates: int = 20
    rrf_k: int = 60
    lexical_weight: float = 1.0
    dense_weight: float = 1.0
    route: bool = False
    stem: bool = False
    synonyms: bool = True
    expand_references: bool = True
    transliterate: bool = True
    resolve: bool = True
    topics: int = 2
    in_force: bool = True
    max_parts: int = 2
    mmr_lambda: float | None = None
    rerank: bool = False
    parents: bool = False
    filters: tuple[tuple[str, object], ...] = ()


def query_variants(questions: DataFrame, o: SearchOptions) -> DataFrame:
    """Ordered distinct union of query variants: (query_id, variant, text), variant 0 is the question."""
    numbers = X.section_numbers("question")
    base = questions.select("query_id", "question")
    forms = [F.col("question")]
    if o.transliterate:
        forms.append(refs.romanised_variant(F.col("question")))
    if o.expand_references:
        forms.append(X.expand_references(F.col("question"), numbers))
    out = base.select("query_id", F.array_compact(F.array(*forms)).alias("forms"))
    if o.synonyms:
        out = out.join(refs.expand_synonyms(base), "query_id", "left").select("query_id", F.array_compact(F.concat("forms", F.array("expanded"))).alias("forms"))
    return out.select("query_id", F.posexplode(F.array_distinct("forms")).alias("variant", "text"))


def search(chunks: DataFrame, questions: DataFrame, o: SearchOptions | None = None, acts: DataFrame | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc, score, requested, pinned) of the top k of each question (query_id, question).

    chunks: doc, text, body, act_id, section_id, number, part, kind, repealed, omitted. For all questions at once: a
    ranked list of each variant and of the vectors, fused, then boosts, references, caps, diversity,
    reranking and topic pins as windows over (query_id), in that order.
    """
    o = o or SearchOptions()
    for key, value in UNIONS.items():
        questions.sparkSession.conf.set(key, value)
    c = max(o.candidates, o.k)
    where = metadata_filter(dict(o.filters)) if o.filters else None
    variants = query_variants(questions, o)
    asked = variants.select(F.concat_ws("#", "query_id", "variant").alias("key"), "query_id", "variant", F.col("text").alias("question"))
    lists = lexical.bm25_search(chunks, asked, c, where, o.stem, doc="doc", query="key")
    lists = lists.join(asked.select(F.col("key").alias("query_id"), F.col("query_id").alias("q"), "variant"), "query_id").select(F.col("q").alias("query_id"), F.concat(F.lit("lexical"), F.col("variant")).alias("list"), "doc", "rank", "score")
    if vectors is not None and query_vectors is not None:
        dense = vector.dense_top_k(vectors, query_vectors, c, "doc", "embedding", where)
        lists = lists.unionByName(dense.select("query_id", F.lit("dense").alias("list"), "doc", "rank", "score"))
    weights = refs.adaptive_weights(F.col("question")) if o.route else F.struct(F.lit(o.dense_weight).alias("dense"), F.lit(o.lexical_weight).alias("lexical"))
    weighted = lists.join(questions.select("query_id", weights.alias("w")), "query_id")
    share = F.when(F.col("list") == "dense", F.col("w.dense")).otherwise(F.col("w.lexical"))
    fused = weighted.groupBy("query_id", "doc").agg(F.round(F.sum(share / (F.lit(o.rrf_k) + F.col("rank"))), 9).alias("score"))
    # a few rows a question: written once, since the stages after it look at them several times
    hits = materialized(lexical.top_k(fused, c), "hits")
    meta = chunks.select("doc", "act_id", "section_id", "number", "part", "kind", "repealed", "omitted", "text", "body")
    hits = hits.join(meta.drop("text", "body"), "doc")
    if o.in_force:
        hits = rank.boost_in_force(hits, F.coalesce("omitted", F.lit(False)), F.coalesce("repealed", F.lit(False)))
    hits = materialized(hits.withColumn("requested", F.lit(False)), "hits")
    if o.resolve and acts is not None:
        named = refs.resolve_acts(questions, acts)
        numbers = questions.select("query_id", X.section_numbers("question").alias("numbers"))
        exact = refs.lookup_sections(named.select("query_id", "act_id").join(numbers.select("query_id", F.explode("numbers").alias("number")), "query_id"), meta.where("kind = 'section'").select("act_id", "number", "doc", "part"))
        exact = exact.groupBy("query_id", "doc").agg(F.min("place").alias("place"))
        wanted = hits.join(numbers, "query_id", "left").join(named.groupBy("query_id").agg(F.collect_set("act_id").alias("acts")), "query_id", "left")
        number_ok = (F.size(F.coalesce("numbers", F.array().cast("array<string>"))) == 0) | F.array_contains("numbers", F.upper("number"))
        act_ok = F.col("acts").isNull() | F.array_contains("acts", F.col("act_id"))
        asked_for = (F.size(F.coalesce("numbers", F.array().cast("array<string>"))) > 0) | F.col("acts").isNotNull()
        ordered = rank.promote_references(wanted, exact, F.coalesce(asked_for & number_ok & act_ok, F.lit(False)))
        hits = materialized(ordered.join(meta.drop("text", "body"), "doc"), "hits")
    if o.max_parts:
        hits = rank.cap_per_group(hits, ["act_id", "section_id"], o.max_parts)
    if o.mmr_lambda is not None and vectors is not None:
        kept = rank.mmr(hits.join(vectors.select("doc", F.col("embedding").alias("vector")), "doc"), o.k, o.mmr_lambda)
        hits = hits.drop("rank", "score").join(kept, ["query_id", "doc"])
    if o.rerank:
        texts = hits.join(meta.select("doc", "text"), "doc").join(questions.select("query_id", "question"), "query_id")
        ranked = lexical.overlap_rerank(texts, o.k)
        hits = ranked.withColumn("rank", F.col("new_rank")).drop("new_rank", "text", "question", "overlap")
    if o.topics and acts is not None:
        pins = refs.topic_sections(refs.match_topics(questions), acts, meta.where("kind = 'section'").select("act_id", "number", "doc", "part"))
        requested = hits.where("requested").select("query_id", "doc")
        out = rank.pin_topics(hits.select("query_id", "doc", "rank", "score"), pins.join(requested, ["query_id", "doc"], "left_anti"), o.k, o.topics)
        out = out.join(requested.withColumn("requested", F.lit(True)), ["query_id", "doc"], "left").withColumn("requested", F.coalesce("requested", F.lit(False)))
    else:
        out = hits.where(F.col("rank") <= o.k).select("query_id", "doc", "rank", "score", "requested").withColumn("pinned", F.lit(False))
    if o.parents:
        bodies = out.join(meta.select("doc", "act_id", "section_id", "body"), "doc")
        return chunking.expand_to_parents(bodies, chunking.parent_texts(chunks))
    return out.select("query_id", "rank", "doc", "score", "requested", "pinned")
