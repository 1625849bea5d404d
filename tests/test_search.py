from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiloom.plans.search import SearchOptions, query_variants, search

CHUNKS = [
    (1, "Whoever commits theft shall be punished with imprisonment", 11, 379, "379", 1, False, False),
    (2, "Punishment for murder: death or imprisonment for life", 11, 302, "302", 1, False, False),
    (3, "Punishment for murder under the old code", 12, 302, "302", 1, True, False),
    (4, "Taking or demanding dowry is an offence", 1256, 3, "3", 1, False, False),
    (5, "Murder by negligence is homicide", 11, 304, "304A", 1, False, False),
    (6, "Murder, second part of the long section", 11, 302, "302", 2, False, False),
    (7, "The court may order costs", 86, 5, "5", 1, False, False),
]
ACTS = [(11, "The Penal Code, 1860", False), (12, "The Old Murder Code, 1850", True), (1256, "যৌতুক নিরোধ আইন, ২০১৮", False), (86, "The Evidence Act, 1872", False)]
QUESTIONS = [(1, "punishment for murder"), (2, "What does section 379 of the Penal Code say?"), (3, "my in-laws want dowry money for the murder of a court"), (4, "nothing matches zzz")]


@pytest.fixture(scope="module")
def data(spark):
    c = spark.createDataFrame(CHUNKS, "doc long, text string, act_id int, section_id int, number string, part int, repealed boolean, omitted boolean").withColumns({"body": F.col("text"), "kind": F.lit("section")})
    return c, spark.createDataFrame(QUESTIONS, "query_id long, question string"), spark.createDataFrame(ACTS, "act_id int, title string, repealed boolean")


def top(df, q):
    return [(r.doc, r.requested, r.pinned) for r in df.where(F.col("query_id") == q).orderBy("rank").collect()]


def test_search(data):
    chunks, questions, acts = data
    got = search(chunks, questions, SearchOptions(k=4, candidates=10), acts)
    first = [d for d, _, _ in top(got, 1)]
    assert first[0] == 2 and 3 in first and first.index(3) > first.index(2)
    assert top(got, 2)[0] == (1, True, False)
    assert (4, False, True) in top(got, 3) and top(got, 4) == []
    ranks = {q: [r["rank"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    assert all(r == list(range(1, len(r) + 1)) for r in ranks.values())


def test_filters_and_plain(data):
    chunks, questions, _ = data
    got = search(chunks, questions, SearchOptions(k=3, topics=0, resolve=False, in_force=False, synonyms=False, filters=(("repealed", False), ("act_id", [11]))))
    docs = {r.doc for r in got.collect()}
    assert docs and docs <= {1, 2, 5, 6}


def test_cap_parents_rerank_route(data):
    chunks, questions, acts = data
    got = search(chunks, questions, SearchOptions(k=4, max_parts=1, parents=True, route=True), acts)
    row = got.where("query_id = 1 and section_id = 302 and act_id = 11").collect()
    assert len(row) == 1 and row[0].body.endswith("second part of the long section") and row[0].parent_expanded
    re = search(chunks, questions, SearchOptions(k=2, rerank=True, topics=0, resolve=False))
    assert [d for d, _, _ in top(re, 1)][0] == 2


def test_dense_list_and_mmr(spark, data):
    chunks, questions, _ = data
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(1, 8)], "doc long, embedding array<double>")
    qv = spark.createDataFrame([(4, [0.0] * 7 + [1.0])], "query_id long, qv array<double>").withColumn("qv", F.array(*(F.lit(float(j == 7)) for j in range(8))))
    got = search(chunks, questions, SearchOptions(k=3, topics=0, resolve=False, mmr_lambda=0.7), None, vectors, qv)
    assert top(got, 4)[0][0] == 7


def test_variants(data):
    _, questions, _ = data
    v = {(r.query_id, r.variant): r.text for r in query_variants(questions, SearchOptions()).collect()}
    assert v[1, 0] == "punishment for murder" and "হত্যা" in v[1, 1] and any("ধারা 379 section 379 379" in t for (q, _), t in v.items() if q == 2)
