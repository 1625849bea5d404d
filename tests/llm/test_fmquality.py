"""The factorisation machine: its identity against all pairs, held-out labels, odd rows."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import fmquality as fm
from lexiloom.llm import queries

SF = "/root/testdata/sf0.1"  # 122 held-out rows with label 0; sf0.01 has 11


def test_sum_of_squares_equals_all_pairs():
    draw = np.random.default_rng(1)
    model = fm.Model(0.3, draw.normal(size=fm.SIZE), draw.normal(size=(fm.SIZE, fm.RANK)))
    index, x = fm.features(b"Some words, some MORE words!!\nand a line 12", ["n_chars=5"])
    assert len(set(index.tolist())) == len(index) and index.max() < fm.SIZE
    pairs = sum(model.factors[i] @ model.factors[j] * a * b for (i, a), (j, b) in itertools.combinations(list(zip(index, x, strict=True)), 2))
    assert model.odds(index, x) == pytest.approx(0.3 + sum(model.weights[i] * a for i, a in zip(index, x, strict=True)) + pairs)


def test_a_pass_learns_what_no_single_feature_says():
    """Label 1 where exactly one of two words is there: only the interaction tells."""
    texts = [(b"alpha beta", 0), (b"alpha omega", 1), (b"gamma beta", 1), (b"gamma omega", 0)] * 30
    rows = [(*fm.features(t, []), y) for t, y in texts]
    model = fm.passes(fm.start(0.5), rows, 30, 1)
    assert all((model.score(i, x) > 0.5) == bool(y) for i, x, y in rows)


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op12_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out")
    seen = {(r.quality, r.predicted): r["count"] for r in got.groupBy("quality", "predicted").count().collect()}
    assert seen.get((1, 0), 0) <= 0.02 * sum(v for (q, _), v in seen.items() if q == 1)
    assert seen.get((0, 0), 0) >= 0.95 * sum(v for (q, _), v in seen.items() if q == 0)


def test_forbidden_columns_say_nothing_and_order_neither(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "y": F.lit(1), "__y": F.lit(2), "m0": F.lit("z"), "index": F.lit(3), "none": F.lit(1)}).repartition(3)
    a, b = ({r.doc_id: r.score for r in fm.quality_scores(d, fm.fit(d, labels)).collect()} for d in (docs, other))
    assert a == b


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "a b", 3), (2, "", 0), (2, " \n ", 3), (3, "word " * 200_000, 10**6), (3, "!", 1)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    for given in (labels, one):
        got = fm.quality_scores(docs, fm.fit(docs, given)).collect()
        assert len(got) == 6 and len({r.score for r in got}) == 6 or all(0 <= r.score <= 1 for r in got)
    both = spark.createDataFrame([(2, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    got = fm.quality_scores(docs, fm.fit(docs, both)).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 2, 3, 3] and all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert fm.quality_scores(empty, fm.fit(empty, both)).collect() == []
    assert fm.quality_scores(docs.drop("n_chars"), fm.fit(docs.drop("n_chars"), both)).count() == 6
