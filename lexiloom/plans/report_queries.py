"""Runs compared, reports, lookups, service levels, and sources that no other query reads, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import stats as S
from lexiloom.functions import text as X
from lexiloom.operators import evidence, metrics, rank, refs, runs, vector
from lexiloom.plans.registry import query
from lexiloom.plans.retrieval_queries import CHUNKS, chunks
from lexiloom.session import shared_folder, table
from lexiloom.sources import files
from lexiloom.streaming import state

# ------------------------------------------------------------------ runs: conversations as questions, documents' sources as keys

_RUNS = """q as (select distinct conv_id as query_id from conversations), gold as (select query_id, k as key, 1 + k % 3 as grade from q, range(20) t(k) where (query_id + k) % 5 = 0),
  r as (select query_id, run, list_transform(range(1, 9), lambda i: (query_id * s + i * 3) % 20) as keys from q, (values ('base', 3), ('new', 7), ('other', 4)) v(run, s)),
  p as (select run, query_id, key, row_number() over (partition by run, query_id order by min(pos)) as rank from (select run, query_id, unnest(keys) as key, unnest(range(1, 9)) as pos from r) group by run, query_id, key),
  m as (select run, query_id, coalesce(1.0e0 / min(rank) filter (grade is not null), 0) as mrr, count(*) filter (grade is not null and rank <= 5)::double / any_value(g) as recall
    from (select run, query_id, count(*) as g from gold, (select distinct run from r) group by all) left join (select p.*, grade from p left join gold using (query_id, key)) using (run, query_id) group by all)"""


def _runs(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    made = [(name, step) for name, step in (("base", 3), ("new", 7), ("other", 4))]
    named = q.withColumn("v", F.explode(F.array(*(F.struct(F.lit(n).alias("run"), F.lit(s).alias("s")) for n, s in made)))).select("query_id", "v.*")
    keys = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("query_id") * F.col("s") + i * 3) % 20)
    gold = q.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(19)))).where((F.col("query_id") + F.col("key")) % 5 == 0)
    return named.select("run", "query_id", keys.alias("keys")), gold.select("query_id", F.col("key").cast("long").alias("key"), (1 + F.col("key") % 3).alias("grade"))


@query(f"with {_RUNS} select run, query_id, round(mrr, 6) as mrr, round(recall, 6) as recall from m")
def precomputed_runs(spark, sf_dir):
    """Score a precomputed run: three runs of every conversation in one job."""
    made, gold = _runs(spark, sf_dir)
    m = runs.score_precomputed(made, gold, ["base", "new", "other"], (5,))
    return m.select("run", "query_id", F.round("mrr", 6).alias("mrr"), F.round("recall@5", 6).alias("recall"))


@query(f"""with {_RUNS} select a.run, count(*) as n, round(avg(b.recall), 6) as before, round(avg(a.recall), 6) as after, round(avg(a.recall) - avg(b.recall), 6) as delta, avg(a.recall) - avg(b.recall) >= -0.03 as passed
  from m a join m b using (query_id) where b.run = 'base' and a.run <> 'base' group by 1""")
def run_comparison(spark, sf_dir):
    """CI baseline join, multi-run compare, CI gate."""
    made, gold = _runs(spark, sf_dir)
    c = runs.compare_runs(runs.score_precomputed(made, gold, ["base", "new", "other"], (5,)), "base", "recall@5")
    return c.select("run", "n", *(F.round(x, 6).alias(x) for x in ("before", "after", "delta")), runs.gate(F.col("delta"), F.col("after")).alias("passed"))


@query(f"""with {_RUNS}, b as (select * from p where run = 'base'), g as (select query_id, list(key) as gold from gold group by 1), k as (select query_id, list(key) as pool, list(key) filter (rank <= 3) as top from b group by 1),
  a as (select query_id, [(query_id * 3 + 3) % 20] as cited, query_id % 4 = 0 as refused from q where query_id % 3 > 0),
  s as (select query_id, case when not list_has_any(list_filter(gold, lambda x: x < 15), gold) then 'not_in_corpus' when not list_has_any(gold, pool) then 'retrieval_miss' when not list_has_any(gold, top) then 'ranking_miss'
    when cited is not null and not list_has_any(gold, cited) then 'citation_miss' when refused then 'answer_miss' else 'ok' end as stage from g join k using (query_id) left join a using (query_id))
  select stage, count(*) as n, count(*) = max(count(*)) filter (stage <> 'ok') over () and stage <> 'ok' as worst from s group by 1""")
def failure_report(spark, sf_dir):
    """Failure report join, worst stage verdict."""
    made, gold = _runs(spark, sf_dir)
    base = made.where("run = 'base'").select("query_id", F.posexplode("keys").alias("at", "key"))
    pool = metrics.gold_ranks(base.select("query_id", "key", (F.col("at") + 1).alias("rank")))
    items = made.select("query_id").distinct().withColumn("question", F.lit("q"))
    answers = items.where("query_id % 3 > 0").select("query_id", F.array((F.col("query_id") * 3 + 3) % 20).alias("cited"), (F.col("query_id") % 4 == 0).alias("refused"))
    d = runs.failure_report(items, gold, pool, answers, gold.select("key").where("key < 15"), 3)
    worst = metrics.worst_stage(d).select(F.col("stage").alias("w"))
    return d.groupBy("stage").agg(F.count("*").alias("n")).join(F.broadcast(worst), F.col("stage") == F.col("w"), "left").select("stage", "n", F.col("w").isNotNull().alias("worst"))


@query("""with s as (select event_type, count(*) as n, list_sort(list(value))[1 + least(count(*) - 1, floor(0.95e0 * count(*))::bigint)] as p95, avg((value > 100)::int) as rate from events group by 1)
  select event_type, n, round(p95, 2) as p95, list_filter([case when p95 > 120 then format('p95 {:.0f} ms > 120 ms', p95) end, case when rate > 0.2 then format('error rate {:.2f}% > 20.00%', rate * 100) end], lambda x: x is not null) as breaches,
    case when n = 0 then 1 else least(greatest(n // 100, 1), 20) end::int as k from s""")
def service_levels(spark, sf_dir):
    """SLO breach rows of values as latencies, k clamp."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg((F.col("value") > 100).cast("int")).alias("rate")).join(S.grouped_percentile(e, ["event_type"], "value", 0.95, "p95"), "event_type")
    return g.select("event_type", "n", F.round("p95", 2).alias("p95"), runs.slo_breaches(F.col("n"), F.col("p95"), F.col("rate"), 120, 0.2).alias("breaches"), runs.clamp_k((F.col("n") / 100).cast("int")).alias("k"))


# ------------------------------------------------------------------ lookups over documents in the shape of chunks


@query(f"""with c as ({CHUNKS}), a as (select item_id as query_id, item_id % 20 as act_id, (item_id % 40)::varchar as a, (item_id % 7)::varchar as b from benchmark),
  s as (select query_id, act_id, unnest([a, b]) as number, unnest([0, 1]) as side from a), r as (select query_id, side, doc, row_number() over (partition by query_id, side order by part, doc) as place from s join c using (act_id, number))
  select query_id, side, doc, place from r where place <= 3""")
def section_comparison(spark, sf_dir):
    """Side-by-side compare, section lookup (agent)."""
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 20).alias("act_id"), (F.col("item_id") % 40).cast("string").alias("a"), (F.col("item_id") % 7).cast("string").alias("b"))
    return refs.compare_sections(a, chunks(spark, sf_dir))


@query(f"""with c as ({CHUNKS}), a as (select item_id as query_id, 15 + item_id % 20 as act_id, (item_id % 40)::varchar as number from benchmark),
  e as (select query_id, (query_id + i) % 20 as act_id, i as pos from a, range(4) t(i)), t as (select *, -1 as pos from a union all select query_id, e.act_id, number, e.pos from e join a using (query_id)),
  j as (select query_id, t.act_id, doc, part, pos, min(pos) over (partition by query_id) as first from t join c using (act_id, number)),
  r as (select *, row_number() over (partition by query_id order by part, doc) as place from j where pos = first) select query_id, act_id, doc, place from r where place <= 3""")
def section_fallback(spark, sf_dir):
    """Agent section lookup with fallback act: acts beyond the corpus fall back to the evidence."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    a = b.select("query_id", (15 + F.col("query_id") % 20).alias("act_id"), (F.col("query_id") % 40).cast("string").alias("number"))
    e = b.select("query_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("query_id") + i) % 20)).alias("at", "act_id"))
    return refs.section_or_fallback(a, e, chunks(spark, sf_dir))


@query(f"""with c as ({CHUNKS}), o as (select act_id, min(doc) as doc from c where section_id = 0 group by 1) select item_id as query_id, act_id, doc from benchmark join o on item_id % 25 = act_id""")
def act_overviews(spark, sf_dir):
    """Overview lookup."""
    own = chunks(spark, sf_dir).withColumn("kind", F.when(F.col("section_id") == 0, "overview").otherwise("section"))
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 25).alias("act_id"))
    return refs.overviews(a, own)


@query(f"""with c as (select doc, act_id, number, part, kind, [((doc + 20) % 40)::varchar, (doc % 40)::varchar] as refs from ({CHUNKS})),
  j as (select a.doc, b.doc as "to", i - 1 as pos from (select doc, act_id, unnest(refs) as number, unnest([1, 2]) as i from c) a join c b using (act_id, number) where a.doc <> b.doc)
  select doc, "to", place from (select *, row_number() over (partition by doc order by pos, "to") as place from j) where place <= 3""")
def followed_references(spark, sf_dir):
    """Reference following: one hop to the sections that a section names."""
    own = chunks(spark, sf_dir).withColumn("refs", F.array(((F.col("doc") + 20) % 40).cast("string"), (F.col("doc") % 40).cast("string"))).withColumn("act_refs", F.array().cast("array<int>"))
    return refs.follow_references(own).select("doc", "to", "place")


# ------------------------------------------------------------------ sources and texts


@query("""with m as (select 's' || page_id as id, case page_id % 4 when 0 then 'act' when 1 then 'rule' when 2 then 'order' else 'leaflet' end as kind, case when page_id % 9 = 0 then '' else 'Page ' || page_id end as title,
    case page_id % 5 when 0 then 'http://bdlaws.minlaw.gov.bd/act-' || page_id || '.html' when 1 then '' else url end as url from pages),
  p as (select *, list_filter([case when not regexp_matches(id, '^[a-z0-9][a-z0-9._-]{2,80}$') then 'id' end, case when kind = 'leaflet' then 'kind' end, case when title = '' then 'title' end,
    case when url = '' then 'url or file' when regexp_extract(url, '^https?://([^/:?#]+)', 1) not in ('bdlaws.minlaw.gov.bd', 'www.supremecourt.gov.bd') then 'url: not an official host' end], lambda x: x is not null) as problems from m)
  select id, problems from p""")
def manifest_validation(spark, sf_dir):
    """Manifest row validation of pages as entries, after a JSON lines round trip."""
    n, path = F.col("page_id"), shared_folder(spark, "manifest")
    kind = F.element_at(F.array(*map(F.lit, ("act", "rule", "order", "leaflet"))), (n % 4 + 1).cast("int"))
    url = F.when(n % 5 == 0, F.concat(F.lit("http://bdlaws.minlaw.gov.bd/act-"), n.cast("string"), F.lit(".html"))).when(n % 5 == 1, "").otherwise(F.col("url"))
    m = table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), n.cast("string")).alias("id"), kind.alias("kind"), F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("Page "), n.cast("string"))).alias("title"), url.alias("url"))
    files.write_jsonl(m, path)
    back = files.read_jsonl(spark, path, "id string, kind string, title string, url string")
    return back.select("id", files.manifest_problems(F.col("id"), F.col("kind"), F.col("title"), F.col("url"), F.lit(None).cast("string")).alias("problems"))


@query("""select page_id, 'raw/' || page_id || case when regexp_matches(url, '^[a-z]+://[^/?#]+[^?#]*\\.[A-Za-z0-9]+([?#]|$)') then lower(regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*(\\.[A-Za-z0-9]+)([?#]|$)', 1)) else '.pdf' end as path from pages""")
def local_paths(spark, sf_dir):
    """Local path of a source."""
    return table(spark, sf_dir, "pages").select("page_id", files.local_path(F.lit(None).cast("string"), F.col("page_id").cast("string"), F.col("url"), "raw").alias("path"))


@query("select conv_id, turn, nfc_normalize(text) as text, sha256(nfc_normalize(text)) as digest, text is null as none from conversations")
def normal_forms(spark, sf_dir):
    """NFC of texts that are taken apart first: letters and their marks are put together again."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def apart(s):
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))

    nfc = X.nfc(apart(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nfc.alias("text"), F.sha2(nfc, 256).alias("digest"), nfc.isNull().alias("none"))


@query("""with c as (select page_id, url, left(md5(url), 6) as body from pages), s as (select url, min(case when page_id % 3 = 0 then 'now ' || left(md5(url), 6) || ' here' else 'nothing' end) as live, min(page_id) % 5 as gone from pages group by 1)
  select page_id, case when gone = 0 then 'unavailable' when contains(live, body) then 'current' else 'changed' end as state from c join s using (url)""")
def live_checks(spark, sf_dir):
    """Live check join: cited texts against a newer snapshot of their pages."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.left(F.md5(F.col("url").cast("binary")), F.lit(6)).alias("body"))
    live = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("now "), "body", F.lit(" here"))).otherwise("nothing")
    s = p.groupBy("url").agg(F.min(live).alias("text"), (F.min("page_id") % 5).alias("gone")).where("gone > 0").drop("gone")
    return evidence.live_check(p, s).select("page_id", "state")


@query("select lang, source, count(*) as n from (select lang, source, row_number() over (partition by lang, source order by doc_id) as turn from documents) where turn <= 2 group by all")
def balanced_counts(spark, sf_dir):
    """Balanced round-robin sample: how many rows of each group a sample of two rounds has; which rows is a matter of the seed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    wanted = d.groupBy("lang", "source").agg(F.least(F.count("*"), F.lit(2)).alias("k")).agg(F.sum("k")).first()[0] or 0
    return rank.balanced_sample(d, ["lang", "source"], "doc_id", wanted).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("with k as (select doc_id, sha1(text) as key from documents where doc_id % 2 = 0), n as (select sha1(text) as key, text from documents) select (select count(*) from n where key in (select key from k)) as reused, (select count(distinct key) from n where key not in (select key from k)) as fresh")
def embedding_reuse(spark, sf_dir):
    """Resumable embed with reuse: chunks whose text has a vector already, and different texts that still need one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = d.where("doc_id % 2 = 0").select(X.text_key(F.col("text")).alias("text_sha1")).distinct()
    old, new = vector.embed_new(d, known)
    return old.agg(F.count("*").alias("reused")).crossJoin(new.agg(F.count("*").alias("fresh")))


@query("select count(distinct user_id || event_type) as n from events")
def single_flights(spark, sf_dir):
    """Single flight: of requests of the same user and kind within the watermark one goes through; here the watermark spans the table."""
    top = shared_folder(spark, "flights")
    table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{top}/in")
    s = spark.readStream.schema("user_id bigint, event_type string, ts timestamp").parquet(f"{top}/in").withColumn("key", F.concat(F.col("user_id").cast("string"), "event_type"))
    df = state.single_flight(s, "key", "4000 days").select("key")
    df.writeStream.outputMode("append").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).format("parquet").option("path", f"{top}/out").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{top}/out").agg(F.count("*").alias("n"))
