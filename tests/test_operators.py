from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import stats as S
from lexiloom.functions import text as X
from lexiloom.operators import chunking, evidence, lexical, logs, metrics, rank, refs, sets, situations, vector
from lexiloom.plans import catalog
from lexiloom.sources import files, pages


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ------------------------------------------------------------------ search


def bm25(docs, question, k1=1.5, b=0.75):
    """Scores by the formula, in plain Python."""
    toks = {d: t.lower().split() for d, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for term in question.lower().split():
        df = sum(term in t for t in toks.values())
        for d, t in toks.items():
            if tf := t.count(term):
                idf = math.log(1 + (len(toks) - df + 0.5) / (df + 0.5))
                out[d] = out.get(d, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * max(len(t), 1) / avg))
    return out


def test_bm25_against_the_formula(spark):
    docs = [(1, "theft is theft"), (2, "the court"), (3, "theft of a cheque and the court"), (4, "")]
    q = [(10, "theft theft court"), (11, "nothing here"), (12, "the")]
    d, qs = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(q, "query_id long, question string")
    got = {(r.query_id, r.doc): r.score for r in lexical.bm25_scores(d, qs).collect()}
    want = {(i, k): v for i, t in q for k, v in bm25(docs, t).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    top = lexical.bm25_search(d, qs, 1)
    assert rows(top, "query_id", "doc", "rank") == [(10, 1, 1), (12, 2, 1)]
    only = lexical.bm25_search(d, qs, 5, F.col("doc_id") == 3)
    assert [r.score for r in only.where("query_id = 10").collect()] == [got[10, 3]]


def test_index_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    lexical.build_index(d).save(str(tmp_path))
    i = lexical.Index.load(spark, str(tmp_path))
    assert rows(i.postings, "doc", "term", "tf") == [(1, "a", 2), (1, "b", 1), (2, "b", 1)] and rows(i.terms, "term", "df") == [("a", 1), ("b", 2)] and i.corpus.first()["avgdl"] == 2.0
    spark.createDataFrame([(1, 3)], "doc long, dl int").write.mode("overwrite").parquet(f"{tmp_path}/docs")
    with pytest.raises(ValueError):
        lexical.Index.load(spark, str(tmp_path))


def test_dense_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v, q = rng.standard_normal((300, 32)), rng.standard_normal((25, 32))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit(q) @ unit(v).T
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, qv array<double>")
    want = [(i, int(d)) for i in range(25) for d in sorted(np.argsort(-s[i])[:5])]
    assert rows(vector.dense_top_k(vectors, queries, 5), "query_id", "doc") == want
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 7)
    assert rows(vector.dense_top_k(vectors, queries, 5), "query_id", "doc") == want
    assert rows(vector.quantized_top_k(vectors, queries, 5), "query_id", "doc") == want
    even = vector.dense_top_k(vectors, queries, 400, where=F.col("vec_id") % 2 == 0)
    assert even.count() == 25 * 150 and even.where("doc % 2 = 1").count() == 0
    assert vector.dense_top_k(vectors, queries, 5, where=F.lit(False)).count() == 0


def test_vector_append_checks_the_dimension(spark):
    old = spark.createDataFrame([], "vec_id long, embedding array<double>")
    new = spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert vector.append_vectors(old, new, 2).first()["embedding"] == [0.6, 0.8]
    with pytest.raises(Exception, match="3 dimensions"):
        vector.append_vectors(old, new, 3).collect()
    assert spark.range(1).select(vector.quantize(F.array(F.lit(1.0), F.lit(-0.5)))).first()[0] == [127, -64]


def lists(spark, *ranked):
    return [spark.createDataFrame([(1, d, i) for i, d in enumerate(r, 1)], "query_id long, doc long, rank int") for r in ranked]


def test_rrf(spark):
    one = rank.reciprocal_rank_fusion(lists(spark, [5, 3, 9]))
    assert [r.doc for r in one.orderBy("rank").collect()] == [5, 3, 9]
    both = rank.reciprocal_rank_fusion(lists(spark, [1, 2, 3], [3, 4, 1]), k=10)
    assert [r.doc for r in both.orderBy("rank").collect()] == [1, 3, 2, 4]
    with pytest.raises(ValueError):
        rank.reciprocal_rank_fusion(lists(spark, [1]), [1.0, 2.0])


def test_mmr_prefers_what_is_new(spark):
    hits = [(1, 1, 1, 1.0, [1.0, 0.0]), (1, 2, 2, 0.99, [1.0, 0.01]), (1, 3, 3, 0.6, [0.0, 1.0])]
    d = spark.createDataFrame(hits, "query_id long, doc long, rank int, score double, vector array<double>")
    assert [r.doc for r in rank.mmr(d, 2, 0.5).orderBy("rank").collect()] == [1, 3]
    assert [r.doc for r in rank.mmr(d, 3, 1.0).orderBy("rank").collect()] == [1, 2, 3]


def test_cap_boost_promotion_pins(spark):
    hits = spark.createDataFrame([(1, d, i, 1.0 - i / 10, d % 2) for i, d in enumerate([10, 12, 13, 14, 15], 1)], "query_id long, doc long, rank int, score double, act int")
    assert [r.doc for r in rank.cap_per_group(hits, ["act"], 1).orderBy("rank").collect()] == [10, 13]
    boosted = rank.boost_in_force(hits, F.col("doc") == 12, F.col("doc") == 10)
    assert [r.doc for r in boosted.orderBy("rank").collect()] == [13, 14, 12, 15, 10]
    exact = spark.createDataFrame([(1, 99, 1)], "query_id long, doc long, place int")
    promoted = rank.promote_references(hits, exact, F.col("doc") == 15).orderBy("rank").collect()
    assert [r.doc for r in promoted] == [99, 15, 10, 12, 13, 14] and promoted[0].requested and promoted[0].score > promoted[1].score > 0.9
    pins = spark.createDataFrame([(1, 15, 1), (1, 12, 2), (1, 77, 3)], "query_id long, doc long, place int")
    pinned = rank.pin_topics(hits, pins, 4, 2).orderBy("rank").collect()
    assert [(r.doc, r.pinned) for r in pinned] == [(10, False), (12, True), (13, False), (15, True)]
    assert [r.pinned for r in rank.pin_topics(hits, pins, 3, 2).orderBy("rank").collect()] == [False, False, True]  # two places stay with the search
    keys = rank.sandwich_order(F.col("rank"), F.lit(False))
    assert [r["rank"] for r in hits.orderBy(*keys).collect()] == [1, 3, 5, 4, 2]


def test_overlap_rerank(spark):
    d = spark.createDataFrame([(1, 1, 1, "theft of goods", "nothing at all"), (1, 2, 2, "theft of goods", "theft of goods"), (1, 3, 3, "theft of goods", "")], "query_id long, doc long, rank int, question string, text string")
    assert [r.doc for r in lexical.overlap_rerank(d, 2).orderBy("new_rank").collect()] == [2, 1]


# ------------------------------------------------------------------ metrics and statistics


def test_metrics(spark):
    ret = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "g", 3), (1, "h", 4)], "query_id long, key string, rank int")
    gold = spark.createDataFrame([(1, "g", 2), (1, "h", 2), (1, "z", 2), (2, "g", 2)], "query_id long, key string, grade int")
    m = {r.query_id: r for r in metrics.evaluate(ret, gold, (1, 3)).collect()}
    assert m[1].mrr == 0.5 and m[1]["recall@3"] == pytest.approx(2 / 3) and m[1]["precision@3"] == pytest.approx(2 / 3) and m[1]["hit@1"] == 0.0
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert m[1]["ndcg@3"] == pytest.approx((1 / math.log2(3) + 0.5) / ideal) == pytest.approx(m[1]["graded_ndcg@3"])
    assert m[2].mrr == 0.0 and m[2]["recall@3"] == 0.0
    per = spark.createDataFrame([("en", 1.0), ("en", float("nan")), ("bn", 0.0)], "language string, recall double")
    s = {r.language: (r.recall, r.n_recall) for r in metrics.summarize(per, ["recall"], ("language",)).collect()}
    assert s == {None: (0.5, 2), "en": (1.0, 1), "bn": (0.0, 1)}


def test_diagnosis(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    none, nb = F.lit(None).cast("array<string>"), F.lit(None).cast("boolean")
    f = lambda *x: spark.range(1).select(metrics.diagnose(*x)).first()[0]
    assert f(a("g"), a(), a(), none, nb, a("x")) == "not_in_corpus" and f(a("g"), a("x"), a(), none, nb, none) == "retrieval_miss"
    assert f(a("g"), a("g"), a("x"), none, nb, none) == "ranking_miss" and f(a("g"), a("g"), a("g"), a(), nb, none) == "citation_miss"
    assert f(a("g"), a("g"), a("g"), a("g"), F.lit(False), none) == "answer_miss" and f(a(), a(), a(), none, nb, none) == "ok"


def test_statistics(spark):
    w = spark.range(1).select(S.wilson(F.lit(8), F.lit(10)).alias("w"), S.wilson(F.lit(0), F.lit(0)).alias("n")).first()
    assert w.w.lo == pytest.approx(0.4902, abs=1e-3) and w.w.hi == pytest.approx(0.9433, abs=1e-3) and w.n is None
    k = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "a int, b int")
    assert S.kappa(k, "a", "b").first()["kappa"] == pytest.approx(0.5)
    assert S.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first()["kappa"] == 1.0
    v = spark.createDataFrame([(1, float(i)) for i in range(100)], "g int, v double")
    assert S.grouped_percentile(v, ["g"], "v", 0.95, "p").first()["p"] == 95.0
    assert v.groupBy("g").agg(F.collect_list("v").alias("v")).select(S.index_percentile(F.col("v"), 0.95)).first()[0] == 95.0
    mean, lo, hi = S.bootstrap_interval([0.0, 1.0] * 20 + [float("nan")])
    assert mean == 0.5 and lo < 0.5 < hi and math.isnan(S.bootstrap_interval([])[0])
    assert S.bootstrap_interval([0.0, 1.0] * 20) == (mean, lo, hi)
    d = spark.createDataFrame([([0.0] * 30, [1.0] * 30)], "a array<double>, b array<double>").select(S.paired_bootstrap("a", "b").alias("d")).first()["d"]
    assert d["diff"] == 1.0 and d.p_worse == 0.0
    assert S.detectable(30, 0.5, 0.5, 20) > S.detectable(30, 0.5, 0.0, 20)
    sims = spark.createDataFrame([(0.958,)], "s double")
    assert sims.agg(S.false_merge_threshold(F.col("s"), 0.005)).first()[0] == pytest.approx(0.965)


def test_bootstrap_intervals_of_all_labels(spark, tmp_path):
    """Ids far over 400 count, and intervals are those of drawing row by row, up to chance."""
    rng = random.Random(3)
    labels = [(i * 7, int(rng.random() < (0.9 if i < 50 else 0.3)), int(rng.random() < 0.2)) for i in range(1200)]
    spark.createDataFrame([*labels, (3000000, None, 1), (3000003, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.slice: r for r in catalog.QUERIES["bootstrap_intervals"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2]
    for s, r in got.items():
        a = [float(q) for d, q, _ in labels if d % 3 == s] + [1.0] * (s == 0)
        mean, lo, hi = S.bootstrap_interval(a)
        assert r["mean"] == pytest.approx(mean) and r.lo == pytest.approx(lo, abs=0.01) and r.hi == pytest.approx(hi, abs=0.01)
        d = [1.0 - t - q for i, q, t in labels if i % 3 == s]
        assert r["diff"] == pytest.approx(sum(d) / len(d)) and r.verdict == "better" and r.p_worse == 0.0


def test_false_merge_threshold_of_any_label(spark, tmp_path):
    """The nearest pair of unequal labels counts whatever its labels are; equal labels and missing ones don't."""
    e = [(0, [1.0, 0.0], 11), (50, [0.0, 1.0], 3), (1, [1.0, 0.0], 11), (2, [0.96, 0.28], 12), (3, [0.6, 0.8], 4), (4, [1.0, 0.0], None)]
    spark.createDataFrame(e, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES["false_merge_threshold"](spark, str(tmp_path)).first()[0] == pytest.approx(0.97)


def test_false_merge_threshold_of_all_pairs(spark, tmp_path, monkeypatch):
    """The nearest pair counts whatever its ids, in any two blocks; the same id isn't a pair; a vector without length is as in SQL."""
    con = duckdb.connect()
    rng = np.random.default_rng(11)

    def both(name, rows):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        con.sql(f"create or replace view embeddings as select * from '{tmp_path}/{name}/embeddings.parquet/*.parquet'")
        got = catalog.QUERIES["false_merge_threshold"](spark, f"{tmp_path}/{name}").first()[0]
        assert got == pytest.approx(con.sql(catalog.SQL["false_merge_threshold"]).fetchall()[0][0])
        return got

    monkeypatch.setattr(vector, "LEAST_ROWS", 40)
    monkeypatch.setattr(vector, "CELLS", 300)
    e = [(i, [1.0, 0.0, 0.0, float(x)], i % 2) for i, x in ((50, 9), (100, -9))] + [(1, [0.6, 0.8, 0.0, 0.0], 1), (3, [0.8, 0.6, 0.0, 0.0], 2)]
    assert both("odd ids", e) == pytest.approx(0.97)
    wide = [(i, [float(x) for x in rng.normal(size=16)], int(k)) for i, k in enumerate(rng.integers(0, 5, 400))]
    assert both("blocks", wide) < 1
    assert both("copies", [(i + 1000 * c, v, k) for i, v, k in wide for c in range(3)]) < 1
    assert both("the same ids", [*wide, *((i, v, k + 1) for i, v, k in wide[:7])]) < 1
    assert both("missing", [*wide, (None, wide[0][1], 9), (999, None, 9), (998, wide[0][1], None)]) < 1
    assert both("no pair", [(1, [1.0] * 4, 1), (1, [1.0] * 4, 2), (2, [1.0] * 4, None)]) == 1
    assert both("no length", [(1, [1.0, 0.0, 0.0, 0.0], 1), (2, [0.0] * 4, 2)]) == 1
    assert both("near ones of the same label", [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [0.0, 1.0], 2)]) == pytest.approx(0.01)


def test_eval_validation(spark):
    schema = "id string, question string, language string, type string, gold array<string>, gold_grades map<string,int>"
    items = spark.createDataFrame([("a", "Q one", "en", "single", ["1:2"], {}), ("b", "q ONE", "xx", "multi", ["1:2", "bad"], {"9:9": 7})], schema)
    got = {r.id: r.problems for r in metrics.validate_eval(items, spark.createDataFrame([("1:2",)], "key string")).collect()}
    assert got["a"] == ["question is used twice"]
    assert got["b"] == ["question is used twice", "unknown language", "gold key is not act:section", "grade is not 1 to 3", "grade of what is not gold", "gold is not in the corpus"]


# ------------------------------------------------------------------ references


def test_references(spark):
    acts = spark.createDataFrame(
        [(11, "The Penal Code, 1860", False), (75, "The Penal Code (Amendment) Act, 1999", False), (5, "The Finance Act, 1999", False), (6, "The Finance Act, 2005", False), (7, "The Finance Act, 2010", True)], "act_id int, title string, repealed boolean"
    )
    assert rows(refs.title_stems(acts), "stem", "act_id") == [("finance act", 6), ("penal code", 11)]
    q = spark.createDataFrame([(1, "What does the Penal Code say?"), (2, "দণ্ডবিধির ধারা ৩০২"), (3, "finance act and penal code"), (4, "penalcodes")], "query_id long, question string")
    assert rows(refs.resolve_acts(q, acts), "query_id", "act_id") == [(1, 11), (2, 11), (3, 6), (3, 11)]
    sections = spark.createDataFrame([(11, "302", 100, 2), (11, "302", 101, 1), (11, "304A", 102, 1)], "act_id int, number string, doc long, part int")
    named = spark.createDataFrame([(1, 11, "304a"), (2, 11, "302")], "query_id long, act_id int, number string")
    assert rows(refs.lookup_sections(named, sections), "query_id", "doc", "place") == [(1, 102, 1), (2, 100, 2), (2, 101, 1)]
    t = refs.match_topics(spark.createDataFrame([(1, "dowry demand"), (2, "grape juice"), (3, "যৌতুকের মামলা")], "query_id long, question string"))
    assert rows(t, "query_id", "topic") == [(1, "dowry"), (3, "dowry")]
    syn = refs.expand_synonyms(spark.createDataFrame([(1, "bail for theft"), (2, "xyz")], "query_id long, question string"))
    got = dict(rows(syn, "query_id", "expanded"))
    assert got[2] == "xyz" and "জামিন" in got[1] and "চুরি" in got[1] and len(got[1].split()) <= 9


def test_follow_references(spark):
    s = spark.createDataFrame(
        [(1, 11, "1", "section", ["2", "9"], [12]), (2, 11, "2", "section", [], []), (3, 12, "", "overview", [], [])], "doc long, act_id int, number string, kind string, refs array<string>, act_refs array<int>"
    )
    assert rows(refs.follow_references(s), "doc", "to", "kind") == [(1, 2, "section"), (1, 3, "act")]


# ------------------------------------------------------------------ chunking


def test_packing_units():
    text = "In this Act,—\n(1) first clause;\n(2) second clause;\ncontinued\n(a) third"
    assert chunking.split_units(text) == ["In this Act,—", "(1) first clause;", "(2) second clause;\ncontinued", "(a) third"]
    parts = chunking.section_parts(text, 40)
    assert parts == {"opening": "In this Act,—", "bodies": ["In this Act,—\n(1) first clause;", "(2) second clause;\ncontinued\n(a) third"]}
    assert chunking.section_parts(" \n") is None and chunking.section_parts("short") == {"opening": "", "bodies": ["short"]}
    rng = random.Random(1)
    for _ in range(50):
        long = " ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(1, 120)))
        cut = list(chunking.hard_split(long, 50))
        assert all(0 < len(c) <= 50 for c in cut) and "".join(cut).replace(" ", "") == long.replace(" ", "")


def test_chunks_repeat_the_opening(spark):
    text = "In this Act,—\n(1) first clause;\n(2) second clause;\ncontinued\n(a) third"
    d = spark.createDataFrame([(1, 2, "H", "en", text, ["n"]), (1, 3, "H", "en", " ", [])], "act_id int, section_id int, header string, language string, text string, footnotes array<string>")
    got = rows(chunking.chunk_sections(d, 40), "chunk_id", "text")
    assert got == [("1-2-1", "H\n\nIn this Act,—\n(1) first clause;\n\nAmendments: n"), ("1-2-2", "H\nIn this Act,— …\n\n(2) second clause;\ncontinued\n(a) third")]


def test_section_cut():
    pages_ = [(1, "An Act to do things.\n1. Short title.— This is it.\n1. a list item; and more\n2. Definitions.— In this Act"), (2, "more text\n9999. Far.— no\n25. Long heading that\nwraps here.— The body")]
    got = chunking.cut_sections(pages_)
    assert [(n, t, p) for n, t, p, _ in got] == [("", "Preamble", 1), ("1", "Short title", 1), ("2", "Definitions", 1), ("25", "Long heading that wraps here", 2)]
    assert "9999" in got[2][3] and got[3][3] == "The body"


def test_paragraphs_and_judgments():
    assert chunking.paragraphs([(1, "First line\ngoes on\n\n12\nSecond stops in"), (2, "the middle. End.\n  Third.")]) == [(1, "First line goes on"), (1, "Second stops in the middle. End."), (2, "Third.")]
    head = "SUPREME COURT\nA. B. Khan, J:\nThe appeal is dismissed."
    parts = chunking.judgment_parts([(1, head), (2, "Further reasons follow here.")], most=30)
    assert parts[0][0] == "overview" and parts[0][2].startswith("SUPREME COURT A. B. Khan, J:\n\nThe appeal") and [p for k, p, _ in parts[1:]] == [1, 2]
    assert chunking.judgment_parts([(1, " ")]) == []


def test_running_lines(spark):
    p = spark.createDataFrame([("d", i, f"Date 1{i}/2020 Gazette\nText {chr(96 + i) * 5}\n{i}") for i in range(1, 5)] + [("e", 1, "Same\nx1"), ("e", 2, "Same\nx2")], "doc string, page int, text string")
    assert rows(chunking.running_lines(p), "doc", "page", "text") == [*(("d", i, f"Text {chr(96 + i) * 5}") for i in range(1, 5)), ("e", 1, "Same"), ("e", 2, "Same")]


def test_running_lines_of_odd_texts(spark, tmp_path):
    """Blank lines at the ends, blank and missing texts, other scripts' spaces and line ends, and ids that are used twice: as SQL has them."""
    odd = ["", "\n", " ", "\na\n", "b\n\n", "Head\n\nc1x", " \nHead\n d2x\n ", "\u3000Head\ne", "\u00a0\nHead\u2003\n12\u00a0", "ΟΔΟΣ\nx", "οδοσ\ny", "İx\nix", "12\r\n12\x0b", "1\u2028\n2\u0085", "https://a.b/c\r\nHTTP://a.b", "file:/x\x0by|", None, "9\n- 3 / 4 -\npage 7"]
    rng = random.Random(5)
    parts = [line for t in odd if t for line in t.split("\n")]
    texts = odd + ["\n".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60)]
    d = [(i, t, f"src{i % 3}") for i, t in enumerate(texts)] + [(3, "b\n\n", "src0"), (None, "a\n", "src1"), (90, "alone\n", "src7")]
    spark.createDataFrame(d, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["running_lines"](spark, str(tmp_path)).select("doc", F.coalesce("page", F.lit(-1)), "lines").collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted((a, -1 if b is None else b, c) for a, b, c in con.sql(catalog.SQL["running_lines"]).fetchall())
    assert (0, 0, 1) in got and (0, 3, 8) in got and (7, 90, 2) in got


def test_overview_and_parents(spark):
    acts = spark.createDataFrame([(1, "An Act", "X of 1990", "", None, None, [("1", "Title", "I", False), ("", "Intro", "I", False), ("1", "again", "II", True)])], "act_id int, title string, act_number string, date string, repeal_note string, preamble string, sections array<struct<number:string,title:string,chapter:string,inherited_number:boolean>>")
    assert chunking.act_overview(acts).first()["body"] == "An Act\n(X of 1990)\n\nI\nII\n\n1. Title\nIntro"
    assert chunking.act_overview(acts, 12).first()["body"] == "An Act\n…"
    c = spark.createDataFrame([(1, 1, 2, "b", "section"), (1, 1, 1, "a", "section")], "act_id int, section_id int, part int, body string, kind string")
    hits = spark.createDataFrame([(1, 1, 1, 7, 1, "a"), (1, 1, 1, 8, 2, "b"), (1, 9, 9, 9, 3, "z")], "query_id int, act_id int, section_id int, doc int, rank int, body string")
    assert rows(chunking.expand_to_parents(hits, chunking.parent_texts(c)), "doc", "body", "parent_expanded") == [(7, "a\nb", True), (9, "z", False)]


def test_case_metadata(spark):
    t = spark.createDataFrame([("HIGH COURT DIVISION\nFIRST APPEAL NO.311 OF 2016\nJudgment on 12.05.2020",)], "t string")
    m = t.select(chunking.case_metadata(F.col("t"), F.lit("Civil Revision 26/2017"), F.lit("")).alias("m"), chunking.case_metadata(F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("n")).first()
    assert m.m.case_number == "Civil Revision No. 26 of 2017" and m.n.case_number == "First Appeal No. 311 of 2016" and m.n.decided == "2020-05-12" and m.n.division == "HCD"


# ------------------------------------------------------------------ sets, logs, evidence


def test_sets(spark):
    t = lambda *r: spark.createDataFrame(r, "k long, v string")
    assert rows(sets.union_last_wins([t((1, "a"), (2, "a")), t((2, "b"))], "k"), "k", "v") == [(1, "a"), (2, "b")]
    assert rows(sets.append_missing(t((1, "a")), t((1, "b"), (2, "b"), (2, "b")), "k"), "k", "v") == [(2, "b")]
    assert rows(sets.replace_by_source(t((1, "s"), (2, "t")), t((3, "s")), "v"), "k", "v") == [(2, "t"), (3, "s")]
    assert rows(sets.compare_manifest(t((1, "x")).selectExpr("'a' name", "v sha"), t((1, "y")).selectExpr("'a' name", "v sha")), "name", "state") == [("a", "checksum mismatch")]
    j = lambda a, b: spark.range(1).select(sets.jaccard(F.array(*map(F.lit, a)).cast("array<int>"), F.array(*map(F.lit, b)).cast("array<int>"))).first()[0]
    assert j([1, 2], [2, 3]) == pytest.approx(1 / 3) and j([], []) == 1.0 and j([1], []) == 0.0
    d = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, v string")
    assert rows(d.where(sets.metadata_filter({"v": None})), "k") == [(1,)] and rows(d.where(sets.metadata_filter({"v": ["x", "y"], "k": F.col("k") > 2})), "k") == [(3,)]


def test_gap_report(spark):
    none, down = [], ["thumbs down"]
    r = [("Rent?", "a", 10.0, ["refused"], None), (" rent ", "b", 20.0, down, "bad"), ("Rent?", "a", 5.0, none, None), ("Other", None, 86400.0, ["guardrail"], None), ("", "c", 1.0, ["refused"], None)]
    g = logs.gap_analysis(spark.createDataFrame(r, "question string, client string, ts double, reasons array<string>, comment string"))
    got = {x.question: x for x in g.collect()}
    assert got["Rent?"].n == 2 and got["Rent?"].visitors == 2 and got["Rent?"].reasons == {"refused": 1, "thumbs down": 1} and got["Rent?"].comments == ["bad"]
    assert got["Other"].visitors == 1 and got["Other"].last_seen == "1970-01-02"
    assert rows(logs.public_gaps(g, 2), "question") == [("Rent?",)]
    kept = logs.prune_by_age(spark.createDataFrame([(1, None), (2, 0.0), (3, 1e6)], "id int, ts double"), 1, 1e6)
    assert rows(kept, "id") == [(1,), (3,)]


def test_bucket_and_breaker(spark):
    r = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 0, 0, 30, 31])] + [(2, 9, 0.0)], "client long, event_id long, ts double")
    assert rows(logs.token_bucket(r, "client", per_minute=2, burst=2), "client", "event_id", "allowed") == [(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, True), (1, 4, False), (2, 9, True)]
    c = spark.createDataFrame([("m", i, float(t), f) for i, (t, f) in enumerate([(0, True), (1, True), (2, False), (20, True), (21, False), (40, False), (41, False)])], "key string, event_id long, ts double, failed boolean")
    assert [s for _, s in rows(logs.circuit_breaker(c, "key", 2, 10.0), "event_id", "state")] == ["closed", "closed", "open", "half_open", "open", "half_open", "closed"]


def test_thread_history_stops_at_cycles(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (8, 9), (9, 8)], "id long, parent long")
    got = rows(logs.thread_history(spark, t), "id", "ancestor")
    assert [a for i, a in got if i == 5] == [2, 3, 4] and [a for i, a in got if i == 8] == [8, 9]


def test_claim_map(spark):
    answers = spark.createDataFrame([(1, "Theft is punished with imprisonment of 7 years [1]. A fine of 500 taka applies to theft [1]. Nothing supports this sentence here.", 1)], "answer_id long, text string, n_hits int")
    hits = spark.createDataFrame([(1, 1, "Penal Code, Section 379", "Whoever commits theft shall be punished with imprisonment for 7 years.")], "answer_id long, n int, citation string, body string")
    c = evidence.claim_map(answers, hits)
    assert [s for _, s in rows(c, "place", "status")] == ["linked", "check", "uncited"]
    assert c.where("place = 1").first()["missing"] == ["500"]
    s = evidence.claim_summary(c).first()
    assert (s.statements, s.linked, s.check, s.uncited, s.verdict) == (3, 1, 1, 1, "partly_grounded")
    assert evidence.evidence_spans(c, hits).first()["clause"].startswith("Whoever")
    assert [x for _, x in rows(evidence.claim_support(answers, hits), "place", "supported")] == [True, False]


def test_answer_scores(spark):
    a = spark.createDataFrame([(1, ["g"], ["x", "g"], [2, 9], False), (2, [], ["x"], [], True), (3, ["g"], ["g"], [], False)], "answer_id long, gold array<string>, keys array<string>, cited array<int>, refused boolean")
    got = {r.answer_id: r for r in evidence.answer_scores(a).collect()}
    assert (got[1].citation_validity, got[1].gold_cited, got[1].citation_precision, got[1].refusal_correct) == (0.0, 1.0, 1.0, 1.0)
    assert got[2].refusal_correct == 1.0 and got[2].gold_cited is None and got[3].citation_precision is None


# ------------------------------------------------------------------ sources


def test_jsonl_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('// note\n{"id": "1", "question": "q", "gold": ["1:2"]}\n\nnot json\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), files.EVAL, lenient=True).count() == 1
    with pytest.raises(Exception, match="not a row"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), files.EVAL).collect()


def test_grades(spark, tmp_path):
    (tmp_path / "g.csv").write_text("id,accurate\n1,Yes\n2,আংশিক\n3,\n")
    assert rows(files.read_grades(spark, str(tmp_path / "g.csv"), ["id", "accurate"], ["accurate"]).fillna(-1.0), "id", "accurate") == [("1", 1.0), ("2", 0.5), ("3", -1.0)]
    (tmp_path / "h.csv").write_text("id,accurate\n1,maybe\n")
    with pytest.raises(Exception, match="no grade"):
        files.read_grades(spark, str(tmp_path / "h.csv"), ["id", "accurate"], ["accurate"]).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a-1", "kind": "act", "title": "T", "url": "https://x.gov.bd/a.PDF"}\n')
    m = files.read_manifest(spark, str(tmp_path / "m.jsonl"))
    cols = [F.col(c) for c in ("id", "kind", "title", "url", "file")]
    assert m.select(files.manifest_problems(*cols)).first()[0] == [] and m.select(files.local_path(F.col("file"), F.col("id"), F.col("url"), "raw")).first()[0] == "raw/a-1.pdf"
    assert spark.createDataFrame([("A", "zz", "", "http://evil.com", None)], "id string, kind string, title string, url string, file string").select(files.manifest_problems(*cols)).first()[0] == ["id", "kind", "title", "url: not an official host"]
    (tmp_path / "d.jsonl").write_text('{"id": "a-1"}\n{"id": "a-1"}\n')
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "d.jsonl"))


ACT = """<html><head><title>X | site</title></head><body><section class="bg-act-section"><h3>The Example Act, 1990</h3><h4>( ACT NO. V OF 1990 )</h4></section>
<div class="publish-date">[ 1st June, 1990 ]</div><div class="lineremove">Preamble WHEREAS it is♣ expedient</div><section class="search-here">
<div class="act-chapter-group"><p class="act-chapter-no">CHAPTER I</p><p class="act-chapter-name">PRELIMINARY</p></div>
<a href="/act-7/section-1.html">1. Short title</a><a href="/act-7/section-2.html">[7A. The main functions</a><a href="/act-7/section-3.html">No number here</a><a href="/act-9/section-1.html">1. Other</a>
<div class="act-part-group"><p class="act-part-no">PART II</p></div><a href="/act-7/section-4.html">৫ক৷ শিরোনাম</a></section></body></html>"""
SECTION = """<html><body><div class="txt-head">Punishment<span class="footnote"><sup>2</sup></span></div><div class="txt-details"><p>Whoever steals<span class="footnote"><sup>৩</sup></span> is punished.</p>
<p>See <a href="/act-11.html">The Penal Code</a> and <a href="/act-7.html">this</a>.</p></div><div class="footnoteListAll"><ul><li><h6>1</h6>Throughout the Act</li><li><h6>2</h6>Substituted by Act 5</li><li><h6>3</h6>Inserted by <a href="/act-12.html">Act 9</a></li></ul></div></body></html>"""


def test_act_and_section_pages():
    a = pages.act_page(ACT, 7)
    assert (a["title"], a["act_number"], a["date"], a["repealed"], a["preamble"]) == ("The Example Act, 1990", "ACT NO. V OF 1990", "1st June, 1990", False, "WHEREAS it is expedient")
    assert [(s["number"], s["title"], s["part"], s["chapter"], s["inherited_number"]) for s in a["sections"]] == [
        ("1", "Short title", None, "CHAPTER I - PRELIMINARY", False), ("7A", "The main functions", None, "CHAPTER I - PRELIMINARY", False), ("7A", "No number here", None, "CHAPTER I - PRELIMINARY", True), ("৫ক", "শিরোনাম", "PART II", None, False),
    ]
    s = pages.section_page(SECTION, 7, 3)
    assert s["text"] == "Whoever steals is punished.\n\nSee The Penal Code and this." and s["footnotes"] == ["2. Substituted by Act 5", "3. Inserted by Act 9"]
    assert s["act_refs"] == [{"act_id": 11, "title": "The Penal Code"}, {"act_id": 12, "title": "Act 9"}]
    assert [x["act_id"] for x in pages.index_links('<a href="/act-5.html">Five</a><a href="/act-5.html">again</a><a href="/act-6.html"></a>')] == [5]


def test_main_block_and_lists():
    html = "<body><nav>menu menu</nav><div><div id=m><p>" + "long text " * 30 + "</p></div><div>side</div></div><footer>f</footer></body>"
    assert pages.main_block(pages.tree(html)).attrs == {"id": "m"} or pages.main_block(pages.tree(html)).tag in ("div", "p")
    rows_ = pages.judgment_list('<tr><td>1</td><td>First Appeal 3/2016 Uploaded on : 05-JAN-21</td><td>A v B</td><td><a href="/resources/documents/x.pdf">pdf</a></td></tr><tr><td>no</td></tr>', "HCD")
    assert len(rows_) == 1 and rows_[0]["id"].startswith("hcd-first-appeal-3-2016-") and rows_[0]["uploaded"] == "2021-01-05"


def test_bad_pages_are_rows(spark):
    p = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "u", None)], "page_id long, url string, html string")
    got = pages.parse_pages(p, lambda u, h: [{"n": 1 // len(h)}], "n int").collect()
    assert [(r.page_id, r.error is None) for r in got] == [(1, True), (2, False)]


# ------------------------------------------------------------------ situations, glossary, contacts


def test_situations(spark):
    asked = ["my boss has not paid me", "nobody has paid me", "lies!", "he lies about me", "someone attacked me", "an old shop", "the shop won't refund", None, "firm police", "an FIR"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    matched = situations.match_topics(q)
    assert rows(matched, "query_id", "topic") == [(0, "wages"), (3, "defamation"), (4, "hurt"), (6, "consumer"), (9, "police case")]
    contacts = rows(situations.help_contacts(q, matched), "query_id", "place", "contact")
    assert [c for i, _, c in contacts if i == 4] == ["emergency", "legal_aid"] and [c for i, _, c in contacts if i == 0] == ["legal_aid", "labour"]
    assert [c for i, _, c in contacts if i == 7] == ["legal_aid"] and len(contacts) == len(asked) + 3
    both = situations.match_topics(spark.createDataFrame([(1, "he beats me and she was beaten")], "query_id long, question string"))
    acts = spark.createDataFrame([(11, "The Penal Code, 1860", False), (7, "Domestic Violence Act, 2010", False)], "act_id int, title string, repealed boolean")
    sections = spark.createDataFrame([(11, n, d, 1) for n, d in (("319", 1), ("323", 2), ("325", 3))] + [(7, "3", 4, 1), (7, "3", 5, 2)], "act_id int, number string, doc long, part int")
    found = refs.topic_sections(both, acts, sections).orderBy("place").collect()
    assert [(r.doc, r.topic) for r in found] == [(4, "domestic violence"), (2, "domestic violence"), (1, "hurt"), (3, "hurt")]


def test_glossary(spark):
    texts = [(1, "A suitable suit; the BAILED man's bail, and fines.", "en"), (2, "জামিনের আবেদন", "bn"), (3, None, "en"), (4, "deed appeal bail suit warrant mediation fine", "en")]
    d = spark.createDataFrame(texts, "id int, text string, lang string")
    got = {r.id: r.terms for r in situations.glossary_hits(d, F.col("lang")).collect()}
    assert got == {1: ["suit", "bail", "fine"], 2: [X._nfc("জামিন")], 3: [], 4: ["deed", "appeal", "bail", "suit", "warrant", "mediation"]}
