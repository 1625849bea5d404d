"""The opN_<name> queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import chat as op4
from lexiloom.llm import codebook as op13
from lexiloom.llm import decontam as op9
from lexiloom.llm import fmquality as op12
from lexiloom.llm import htmlcut as op2
from lexiloom.llm import jaccard as op10
from lexiloom.llm import packing as op8
from lexiloom.llm import quality as op1
from lexiloom.llm import spans as op7
from lexiloom.llm import spelling as op11
from lexiloom.llm import tokencount as op3
from lexiloom.llm import toxicity as op5
from lexiloom.llm import warc as op6
from lexiloom.llm.common import scratch
from lexiloom.session import large_batches as table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.chat_format(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op5.fit(docs, table(spark, sf_dir, "labels").where(~op5.held_out()))
    found = op5.toxicity(docs, model)
    return found.select("doc_id", op5.held_out().alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    op6.write_warc(pages, path)
    found = op6.resolve_revisits(op6.read_warc(spark, path))
    kind = pages.schema["page_id"].dataType
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = op7.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_sentences", "n_removed", "removed")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = op8.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.spelling_variants(table(spark, sf_dir, "documents"), drop=199)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = op12.fit(docs, table(spark, sf_dir, "labels").where(~op12.held_out()))
    return op12.quality_scores(docs, model).select("doc_id", op12.held_out().alias("held_out"), "score", "predicted")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = op13.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(op13.digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_html_extraction": op2_html_extraction,
        "op3_token_counts": op3_token_counts,
        "op4_chat_format": op4_chat_format,
        "op5_toxicity": op5_toxicity,
        "op6_warc": op6_warc,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_packing": op8_packing,
        "op9_decontamination": op9_decontamination,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_vector_codes": op13_vector_codes,
    }


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(op1.STOP_WORDS)))
_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = rf"""with d as (select doc_id, coalesce(text, '') as t, {_WORDS.format(t="coalesce(text, '')")} as w from documents),
  g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
  r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where k > 1) group by doc_id),
  m as (select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines, coalesce(r.n, 0) as n_repeat_words,
    len(list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D.,;:!?]+'), lambda x: x in ({_STOPS}))) as n_stop_words from d left join r using (doc_id)),
  b as (select *, len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
    not base_failed and word_chars / n_words between 2.5 and 12.0 and n_symbols / n_words <= 0.1 and n_stop_words / n_words >= 0.06 and n_dup_lines / n_lines <= 0.4 as kept from b"""

OP4_SQL = """with c as (select conv_id, list({'r': role, 't': text} order by turn, role, text) as l, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' order by turn, role, text) as text from conversations group by 1)
  select conv_id, len(l) as n_turns, text from c a where not exists (select 1 from c b where len(b.l) > len(a.l) and b.l[1:len(a.l)] = a.l) and not exists (select 1 from c b where b.l = a.l and b.conv_id < a.conv_id)"""

OP6_SQL = """with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages), t as (select *, max(page_id) over (partition by d) as top from p)
  select page_id, n as payload_bytes, d as payload_digest, case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type, case when n >= 1000 and page_id <> top then top end as refers_to from t"""

OP10_SQL = rf"""with recursive d as (select doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
  n as (select doc_id, count(*) as n from s group by 1),
  o as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
  l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
  r(a, b) as (select doc_id, doc_id from d union select r.a, l.b from r join l on r.b = l.a)
  select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id from d left join n using (doc_id) join r on r.a = d.doc_id group by all"""




def _op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """One common table for each round: b0, b1, ... the codebooks, a1, a2, ... the parts' nearest entries."""
    nearest = """a{n} as materialized (select v, l, p, x, min({{'d': d, 'e': e}}) as m from
      (select v, l, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from q join b{n} using (p)) group by all)"""
    moved = """b{m} as materialized (select p, e, coalesce(new, c) as c from b{n} left join
      (select p, e, list(s order by i) as new from (select p, m.e as e, i, floor(sum(x[i])::double / count(*))::bigint as s from a{n}, range(1, len(x) + 1) r(i) group by all) group by all) using (p, e))"""
    steps = ",\n  ".join(part.format(n=n, m=n + 1) for n in range(rounds) for part in (nearest, moved))
    return f"""with k as (select vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
  r as materialized (select *, row_number() over (order by vec_id, x) as v from k),
  q as materialized (select v, label as l, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] as x from r, range({parts}) t(p)),
  b0 as materialized (select p, v - 1 as e, x as c from q where v <= {entries}),
  {steps},
  {nearest.format(n=rounds)},
  h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds}),
  o as (select v, l, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from a{rounds} group by all)
  select vec_id, code, error, (sum(error) over (partition by l))::bigint as label_error, codebooks_sha256 from o join r using (v), h"""


OP13_SQL = _op13_sql()


def oracle_sql() -> dict[str, str]:
    """What SQL can say. The others are tested against brute force, exact round trips or held-out labels in tests/llm."""
    return {"op1_quality_rules": OP1_SQL, "op4_chat_format": OP4_SQL, "op6_warc": OP6_SQL, "op10_ngram_jaccard": OP10_SQL, "op13_vector_codes": OP13_SQL}
