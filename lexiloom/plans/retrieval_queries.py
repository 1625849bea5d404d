"""Search, ranking, vectors and retrieval metrics over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import lexical, metrics, rank, vector
from lexiloom.plans.registry import query
from lexiloom.plans.search import SearchOptions, search
from lexiloom.session import table

TOK = "regexp_extract_all(lower(text), '[0-9a-zঀ-৿]+')"
CHUNKS = (
    "select doc_id as doc, text, text as body, cast(substr(source, 4) as int) as act_id, doc_id % 7 as section_id, cast(doc_id % 40 as varchar) as number, "
    "doc_id % 3 as part, 'section' as kind, doc_id % 11 = 0 as repealed, doc_id % 13 = 0 as omitted from documents"
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of chunks: the source is the act, remainders of the id stand in for the other fields."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("doc"), "text", F.col("text").alias("body"), F.expr("cast(substr(source, 4) as int)").alias("act_id"), (F.col("doc_id") % 7).alias("section_id"),
        (F.col("doc_id") % 40).cast("string").alias("number"), (F.col("doc_id") % 3).alias("part"), F.lit("section").alias("kind"), (F.col("doc_id") % 11 == 0).alias("repealed"), (F.col("doc_id") % 13 == 0).alias("omitted"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


BM25 = f"""d as (select doc, act_id, section_id, repealed, omitted, len({TOK}) as dl, {TOK} as tok from ({CHUNKS})),
  q as (select query_id, term, count(*) as qf from (select item_id as query_id, unnest({TOK}) as term from benchmark) group by all),
  n as (select count(*) as n, avg(dl) as avgdl from d),
  tf as (select doc, dl, term, count(*) as tf from (select doc, dl, unnest(tok) as term from d) where term in (select term from q) group by all),
  df as (select term, count(*) as df from tf group by term),
  scored as (select query_id, doc, round(sum(qf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * greatest(dl, 1) / avgdl))), 6) as score
    from q join df using (term) join tf using (term) cross join n group by all)"""
TOP = "select query_id, doc, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc) as rank from {t}) where rank <= {k}"


@query(f"with {BM25} {TOP.format(t='scored', k=5)}")
def bm25_topk(spark, sf_dir):
    """BM25 top-k, inverted-index probe, IDF, index build."""
    return lexical.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 5)


@query(f"with {BM25} select query_id, doc, score, rank from (select s.*, row_number() over (partition by query_id order by score desc, s.doc) as rank from scored s join d using (doc) where act_id in (1, 2, 3) and not repealed) where rank <= 5")
def bm25_filtered(spark, sf_dir):
    """Metadata filter, retriever and pipeline filter build: after the statistics."""
    from lexiloom.operators.sets import metadata_filter

    return lexical.bm25_search(chunks(spark, sf_dir), questions(spark, sf_dir), 5, metadata_filter({"act_id": [1, 2, 3], "repealed": False}), doc="doc")


@query(f"""with d as (select doc_id as doc, {TOK} as tok from documents), p as (select doc, unnest(tok) as term from d)
  select term, count(distinct doc) as df, count(*) as cf from p group by term""")
def term_statistics(spark, sf_dir):
    """Index build: df and collection frequency of every term."""
    i = lexical.build_index(table(spark, sf_dir, "documents"))
    return i.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"select count(*) as n, round(avg(len({TOK})), 6) as avgdl from documents")
def index_corpus(spark, sf_dir):
    """Index build: avgdl."""
    return lexical.build_index(table(spark, sf_dir, "documents")).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


_COS = "round(list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])), 6)"
_DENSE = f"dense as (select q.vec_id as query_id, v.vec_id as doc, {_COS} as score from embeddings v cross join (select * from embeddings where vec_id % 50 = 0) q)"


def query_vectors(spark, sf_dir):
    """The stated query set of searches: every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


@query(f"with {_DENSE} {TOP.format(t='dense', k=10)}")
def dense_topk(spark, sf_dir):
    """Dense top-k; remote ANN search is the same exact search here."""
    return vector.dense_top_k(table(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), 10)


@query(f"with {_DENSE} {TOP.format(t='(select dense.* from dense join embeddings on doc = vec_id where label in (1, 2))', k=5)}")
def dense_filtered(spark, sf_dir):
    """Dense top-k with filters first."""
    return vector.dense_top_k(table(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), 5, where=F.col("label").isin(1, 2))


@query(f"with {_DENSE} {TOP.format(t='dense', k=5)}")
def quantized_topk(spark, sf_dir):
    """int8 quantised search, vector append codes: codes first, exact scores of four times as many."""
    return vector.quantized_top_k(table(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), 5)


@query("select vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) as norm, round(u[1], 6) as first from (select vec_id, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_sum(list_transform(cast(embedding as double[]), lambda y: y * y)))) as u from embeddings)")
def l2_normalized(spark, sf_dir):
    """L2 normalise."""
    u = table(spark, sf_dir, "embeddings").select("vec_id", vector.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.sqrt(vector.dot(F.col("u"), F.col("u"))), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query(f"""with g as (select doc_id as doc, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) as g from (select doc_id, ' ' || unnest({TOK}) || ' ' as p from documents)),
  b as (select doc, (cast('0x' || substr(md5(g), 7, 2) || substr(md5(g), 5, 2) || substr(md5(g), 3, 2) || substr(md5(g), 1, 2) as bigint)) % 512 as bucket, count(*) as c from g group by all)
  select doc, cast(bucket as int) as bucket, round(c / sqrt(sum(c * c) over (partition by doc)), 6) as value from b""")
def trigram_embeddings(spark, sf_dir):
    """Trigram hashing embedder and encode batch."""
    return vector.embed(table(spark, sf_dir, "documents")).withColumn("value", F.round("value", 6))


def _lists(spark, sf_dir):
    """Two lists of each question: over all chunks, and over those of acts with an even number."""
    return lexical.bm25_search(chunks(spark, sf_dir), questions(spark, sf_dir), 20, [None, F.col("act_id") % 2 == 0], doc="doc")


_LISTS = f"""{BM25}, l1 as ({TOP.format(t='scored', k=20)}), l2 as ({TOP.format(t='(select s.* from scored s join d using (doc) where act_id % 2 = 0)', k=20)}),
  lists as (select query_id, doc, 0 as l, rank, 1.3e0 as w from l1 union all select query_id, doc, 1, rank, 0.8e0 from l2),
  rrf as (select query_id, doc, round(sum(w / (60 + rank)), 9) as score, min((l, rank)) as f from lists group by all)"""


@query(f"with {_LISTS} select query_id, doc, score, rank from (select *, row_number() over (partition by query_id order by score desc, f, doc) as rank from rrf) where rank <= 10")
def rrf_fusion(spark, sf_dir):
    """Reciprocal rank fusion with weights."""
    return rank.reciprocal_rank_fusion(_lists(spark, sf_dir), [1.3, 0.8], 60, 10)


@query(f"""with {BM25}, t as ({TOP.format(t='scored', k=20)}), c as (select t.*, row_number() over (partition by query_id, act_id order by rank) as n from t join d using (doc))
  select query_id, doc, score, row_number() over (partition by query_id order by rank) as rank from c where n <= 1""")
def per_group_cap(spark, sf_dir):
    """Per-section cap, retriever over-fetch."""
    c = chunks(spark, sf_dir)
    hits = lexical.bm25_search(c, questions(spark, sf_dir), 20, doc="doc").join(c.select("doc", "act_id"), "doc")
    return rank.cap_per_group(hits, ["act_id"], 1).select("query_id", "doc", "score", "rank")


_BOOST = f"""{BM25}, t as ({TOP.format(t='scored', k=20)}), bb as (select query_id, t.doc, rank as r0,
  round(score - (case when omitted then 0.3e0 else 0e0 end + case when repealed then 0.5e0 else 0e0 end) * (case when score = 0 then 1e0 else abs(score) end), 6) as score from t join d using (doc))"""


@query(f"with {_BOOST} select query_id, doc, score, row_number() over (partition by query_id order by score desc, r0) as rank from bb")
def in_force_boost(spark, sf_dir):
    """In-force boost."""
    c = chunks(spark, sf_dir)
    hits = lexical.bm25_search(c, questions(spark, sf_dir), 20, doc="doc").join(c.select("doc", "omitted", "repealed"), "doc")
    return rank.boost_in_force(hits, F.col("omitted"), F.col("repealed")).select("query_id", "doc", "score", "rank")


_EXACT = "exact as (select query_id, doc, cast(row_number() over (partition by query_id order by doc) as int) as place from t where doc % 5 = 0 and rank > 3)"


def _exact(hits):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("doc")
    return hits.where("doc % 5 = 0 and rank > 3").select("query_id", "doc", F.row_number().over(w).alias("place"))


@query(f"""with {BM25}, t as ({TOP.format(t='scored', k=20)}), {_EXACT},
  oo as (select query_id, doc, 0 as c, place as o, null as score from exact union all
    select query_id, doc, case when doc % 3 = 0 then 1 else 2 end, rank, score from t where (query_id, doc) not in (select query_id, doc from exact)),
  r as (select *, row_number() over (partition by query_id order by c, o, doc) as rank, count(*) over (partition by query_id) as n from oo)
  select query_id, doc, rank, round(case when c < 2 then top + (n - rank + 1) * 1e-6 else score end, 8) as score, c = 0 as requested
  from r join (select query_id, score as top from t where rank = 1) using (query_id)""")
def reference_promotion(spark, sf_dir):
    """Reference promotion order: looked up, wanted, others."""
    hits = lexical.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 20)
    return rank.promote_references(hits, _exact(hits), F.col("doc") % 3 == 0)


@query(f"""with {BM25}, t as ({TOP.format(t='scored', k=20)}), {_EXACT},
  chosen as (select * from (select *, row_number() over (partition by query_id order by place, doc) as p from exact) where p <= 2),
  missing as (select c.* from chosen c left join (select * from t where rank <= 5) t using (query_id, doc) where t.rank is null),
  kept as (select t.query_id, t.doc, t.rank, t.score, c.p is not null as pinned from t left join chosen c using (query_id, doc)
    left join (select query_id, count(*) as m from missing group by 1) using (query_id) where t.rank <= 5 - coalesce(m, 0)),
  low as (select query_id, max(rank) as r, arg_max(score, rank) as s from kept group by 1)
  select query_id, doc, rank, score, pinned from kept union all
  select m.query_id, m.doc, r + row_number() over (partition by m.query_id order by p), s, true from missing m join low using (query_id)""")
def topic_pinning(spark, sf_dir):
    """Topic pinning."""
    hits = lexical.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 20)
    return rank.pin_topics(hits, _exact(hits), 5, 2)


@query(f"""with {BM25}, t as ({TOP.format(t='scored', k=9)})
  select query_id, doc, row_number() over (partition by query_id order by case when doc % 17 = 0 then 0 when rank % 2 = 1 then 1 else 2 end, case when doc % 17 = 0 or rank % 2 = 1 then rank else -rank end) as place from t""")
def sandwich_order(spark, sf_dir):
    """Sandwich order."""
    from pyspark.sql import Window

    hits = lexical.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 9)
    w = Window.partitionBy("query_id").orderBy(*rank.sandwich_order(F.col("rank"), F.col("doc") % 17 == 0))
    return hits.select("query_id", "doc", F.row_number().over(w).alias("place"))


@query()
def mmr_rerank(spark, sf_dir):
    """Maximal marginal relevance over the vectors' neighbours."""
    v = table(spark, sf_dir, "embeddings")
    hits = vector.dense_top_k(v, query_vectors(spark, sf_dir), 20)
    return rank.mmr(hits.join(v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")), "doc"), 5)


@query(f"""with {BM25}, t as ({TOP.format(t='scored', k=20)}), x as (select query_id, doc, rank as r0, list_distinct({TOK.replace('text', 'b.text')}) as qs, {TOK.replace('text', 'c.text')} as ts
    from t join benchmark b on b.item_id = query_id join documents c on c.doc_id = doc),
  o as (select query_id, doc, r0, round(len(list_intersect(qs, ts)) / len(qs) + 0.1e0 * len(list_filter(ts, lambda y: list_contains(qs, y))) / len(ts), 6) as overlap from x)
  select query_id, doc, overlap, new_rank from (select *, row_number() over (partition by query_id order by overlap desc, r0, doc) as new_rank from o) where new_rank <= 5""")
def overlap_rerank(spark, sf_dir):
    """Lexical-overlap rerank."""
    d, q = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    hits = lexical.bm25_search(d, q, 20).join(d.select(F.col("doc_id").alias("doc"), "text"), "doc").join(q, "query_id")
    return lexical.overlap_rerank(hits, 5).select("query_id", "doc", F.round("overlap", 6).alias("overlap"), "new_rank")


def _retrieved(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = vector.dense_top_k(v, query_vectors(spark, sf_dir), 10)
    keys = v.select(F.col("vec_id").alias("doc"), (F.col("vec_id") % 100).alias("key"), "label")
    gold = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(v.select((F.col("vec_id") % 100).alias("key"), "label").distinct(), "label")
    gold = gold.select("query_id", "key", (1 + F.col("key") % 3).cast("int").alias("grade"))
    return hits.join(keys, "doc").select("query_id", "key", "rank"), gold


_RUN = f"""{_DENSE}, hits as ({TOP.format(t='dense', k=10)}), ret as (select query_id, doc % 100 as key, rank from hits),
  gold as (select q.vec_id as query_id, k.key, cast(1 + k.key % 3 as int) as grade from (select * from embeddings where vec_id % 50 = 0) q join (select distinct vec_id % 100 as key, label from embeddings) k using (label)),
  ranks as (select query_id, key, row_number() over (partition by query_id order by r, key) as rank from (select query_id, key, min(rank) as r from ret group by all)),
  f as (select r.*, grade from ranks r left join gold using (query_id, key)),
  sizes as (select query_id, count(*) as g, list_sort(list(grade), 'DESC') as gs from gold group by 1)"""


def _metric_sql(k: int) -> str:
    return f"""cast(count(*) filter (grade is not null and rank <= {k}) > 0 as double) as hit_{k}, round(count(*) filter (grade is not null and rank <= {k}) / any_value(g), 6) as recall_{k},
    round(count(*) filter (grade is not null and rank <= {k}) / greatest(least(count(rank), {k}), 1), 6) as precision_{k},
    round(coalesce(sum(1 / log2(rank + 1.0e0)) filter (grade is not null and rank <= {k}), 0) / list_sum(list_transform(range(1, least(any_value(g), {k}) + 1), lambda i: 1 / log2(i + 1.0e0))), 6) as ndcg_{k},
    round(coalesce(sum((pow(2, grade) - 1) / log2(rank + 1.0e0)) filter (grade is not null and rank <= {k}), 0) / list_sum(list_transform(any_value(gs)[1:{k}], lambda x, i: (pow(2, x) - 1) / log2(i + 1.0e0))), 6) as graded_ndcg_{k}"""


@query(f"with {_RUN} select query_id, round(coalesce(1 / min(rank) filter (grade is not null), 0), 6) as mrr, {', '.join(map(_metric_sql, (1, 5, 10)))} from sizes left join f using (query_id) group by query_id")
def retrieval_metrics(spark, sf_dir):
    """All metrics per query: rank of gold, hit@k, recall@k, precision@k, MRR, nDCG@k, graded nDCG@k, score retrieval run."""
    m = metrics.evaluate(*_retrieved(spark, sf_dir), ks=(1, 5, 10))
    return m.select("query_id", *(F.round(c, 6).alias(c.replace("@", "_")) for c in m.columns if c != "query_id"))


@query(f"""with {_RUN}, m as (select query_id, coalesce(1 / min(rank) filter (grade is not null), 0) as mrr, count(*) filter (grade is not null and rank <= 5) / any_value(g) as recall from sizes left join f using (query_id) group by query_id),
  s as (select m.*, case when query_id % 100 = 0 then 'a' else 'b' end as language, case when query_id % 150 = 0 then 'x' else 'y' end as type from m)
  select language, type, round(avg(mrr), 6) as mrr, count(mrr) as n_mrr, round(avg(recall), 6) as recall, count(recall) as n_recall from s group by grouping sets ((), (language), (type))""")
def metric_slices(spark, sf_dir):
    """Metric mean, slice aggregate and run summary by grouping sets."""
    m = metrics.evaluate(*_retrieved(spark, sf_dir), ks=(5,)).select("query_id", "mrr", F.col("recall@5").alias("recall"))
    m = m.withColumns({"language": F.when(F.col("query_id") % 100 == 0, "a").otherwise("b"), "type": F.when(F.col("query_id") % 150 == 0, "x").otherwise("y")})
    return metrics.summarize(m, ["mrr", "recall"]).select("language", "type", "mrr", "n_mrr", "recall", "n_recall")


_DIAG = """dg as (select query_id, case when first is null then 'retrieval_miss' when first > 3 then 'ranking_miss' when query_id % 100 = 0 then 'citation_miss' else 'ok' end as stage
  from (select query_id, min(rank) filter (grade is not null) as first from sizes left join f using (query_id) group by query_id))"""


@query(f"with {_RUN}, {_DIAG} select query_id, stage from dg")
def failure_stage(spark, sf_dir):
    """Failure stage, question diagnosis."""
    ret, gold = _retrieved(spark, sf_dir)
    ranks = metrics.gold_ranks(ret).groupBy("query_id").agg(F.collect_list(F.struct("rank", "key")).alias("r"))
    g = gold.groupBy("query_id").agg(F.collect_set("key").alias("gold")).join(ranks, "query_id", "left")
    pool = lambda k: F.transform(F.filter(F.coalesce("r", F.array()), lambda s: s["rank"] <= k), lambda s: s["key"])
    cited = F.when(F.col("query_id") % 100 == 0, F.array().cast("array<bigint>"))
    none = F.lit(None)
    return g.select("query_id", metrics.diagnose(F.col("gold"), pool(10), pool(3), cited, none.cast("boolean"), none.cast("array<bigint>")).alias("stage"))


@query(f"with {_RUN}, {_DIAG}, x as (select query_id % 3 as slice, stage from dg) select slice, " + ", ".join(f"count(*) filter (stage = '{s}') as {s}" for s in metrics.STAGES) + " from x group by slice")
def stage_histogram(spark, sf_dir):
    """Stage histogram (pivot)."""
    return metrics.stage_histogram(failure_stage(spark, sf_dir).withColumn("slice", F.col("query_id") % 3), "slice")


@query()
def search_pipeline(spark, sf_dir):
    """The core query end to end: variants, lists, fusion, boosts, references, caps, pins."""
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    acts = c.select("act_id").distinct().select("act_id", F.concat(F.lit("The Example Act "), F.col("act_id").cast("string"), F.lit(", 1990")).alias("title"), F.lit(False).alias("repealed"))
    return search(c, q, SearchOptions(k=5, candidates=10), acts)


@query(f"""with {BM25}, t as ({TOP.format(t='scored', k=5)}) select query_id, count(*) filter (score >= 20) >= 2 as supported, max(score) as top from t group by 1""")
def support_gate(spark, sf_dir):
    """Support gate."""
    from lexiloom.operators.evidence import support_gate as gate

    return gate(bm25_topk(spark, sf_dir), 20.0, 2)


@query(f"""with {BM25}, t as ({TOP.format(t='scored', k=5)}), r as (select query_id, max(score) as score, query_id % 4 <> 0 as answerable, bool_or(doc % 2 = 0) as gold from t group by query_id),
  b as (select min(score) as lo, max(score) as hi from r), c as (select round(lo + (hi - lo) * i / 11, 6) as threshold from b, range(12) x(i))
  select threshold, round(avg(cast(score >= threshold as double)) filter (answerable), 6) as answer_rate, round(avg(cast(score >= threshold as double)) filter (gold), 6) as gold_kept,
    round(avg(cast(score < threshold as double)) filter (not answerable), 6) as correct_abstain,
    round((avg(cast(score >= threshold as double)) filter (gold) + avg(cast(score < threshold as double)) filter (not answerable)) / 2, 6) as balance from r cross join c group by threshold""")
def threshold_sweep(spark, sf_dir):
    """Threshold sweep."""
    t = bm25_topk(spark, sf_dir)
    r = t.groupBy("query_id").agg(F.max("score").alias("score"), F.bool_or(F.col("doc") % 2 == 0).alias("gold")).withColumn("answerable", F.col("query_id") % 4 != 0)
    return metrics.threshold_sweep(r, "score", "answerable", "gold")


@query(f"""with {_LISTS.replace('1.3e0 as w', '1.0e0 as w')}, p as (select * from (values (1.0e0, 0.5e0, 10), (1.0e0, 0.5e0, 60), (0.5e0, 1.0e0, 10), (0.5e0, 1.0e0, 60)) v(a, b, rk)),
  g as (select a, b, rk, query_id, doc, round(sum((case when l = 0 then a else b end) / (rk + rank)), 9) as s from lists cross join p group by all),
  top as (select a, b, rk, query_id, arg_max(doc, (s, -doc)) as doc from g group by all), m as (select a, b, rk, round(avg(cast(doc % 2 = 0 as double)), 6) as hit from top group by all)
  select a, b, rk, hit from m order by hit desc, a, b, rk limit 1""")
def grid_search(spark, sf_dir):
    """Grid search: fusion weights and rrf_k, best metric."""
    l1, l2 = _lists(spark, sf_dir)
    both = l1.withColumn("l", F.lit(0)).unionByName(l2.withColumn("l", F.lit(1)))
    p = spark.createDataFrame([(1.0, 0.5, 10), (1.0, 0.5, 60), (0.5, 1.0, 10), (0.5, 1.0, 60)], "a double, b double, rk int")
    g = both.crossJoin(F.broadcast(p)).groupBy("a", "b", "rk", "query_id", "doc").agg(F.round(F.sum(F.when(F.col("l") == 0, F.col("a")).otherwise(F.col("b")) / (F.col("rk") + F.col("rank"))), 9).alias("s"))
    top = g.groupBy("a", "b", "rk", "query_id").agg(F.max_by("doc", F.struct("s", -F.col("doc"))).alias("doc"))
    return metrics.grid_argmax(top.withColumn("hit", (F.col("doc") % 2 == 0).cast("double")), ["a", "b", "rk"], "hit")
