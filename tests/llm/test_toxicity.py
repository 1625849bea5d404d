from __future__ import annotations

import math
import random
import re
import time

from lexiloom.llm import toxicity as T
from lexiloom.session import table


def all_segments(weights):
    """The maximal scoring subsequences by their definition: best first, then left and right of it."""
    best = (0, 0, 0.0)
    for i in range(len(weights)):
        for j in range(i + 1, len(weights) + 1):
            s = sum(weights[i:j])
            if s > best[2] + 1e-9:
                best = (i, j, s)
    i, j, s = best
    if s <= 0:
        return []
    return all_segments(weights[:i]) + [best] + [(a + j, b + j, s) for a, b, s in all_segments(weights[j:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        weights = [rng.choice([-0.5, -0.5, -0.5, rng.random() * 3, -rng.random() * 3]) for _ in range(rng.randint(0, 12))]  # no equal sums
        hits = [(i, w) for i, w in enumerate(weights) if w != -0.5]
        got = T.segments(hits, -0.5)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in all_segments(weights)]


def corpus(seed, n=900):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "es", "qu", "lo"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 200))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randint(0, len(words)), rng.choice(["grublo", "Fleck!", "zonk" + word()]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_labels(spark):
    rows, labels = corpus(2)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(docs, marks.where(~T.held_out()))
    assert "grublo" in model.words and "fleck" in model.words and "zonk" in model.prefixes
    got = {r.doc_id: r for r in T.toxicity(docs, model).withColumn("held", T.held_out()).collect()}
    held = [d for d in got if got[d].held]
    assert len(held) > 200
    assert all(got[d].predicted == labels[d][1] for d in held)
    assert all(0 <= r.score <= 1 and (r.score >= T.THRESHOLD) == bool(r.predicted) for r in got.values())
    assert all(got[d].passages for d in held if labels[d][1])
    for d, text in rows[:160]:  # the score by its definition
        words = re.findall(r"[a-z]+", text.lower())
        if len(words) > 60:
            continue
        known = [model.words.get(w, next((model.prefixes[w[:n]] for n in (6, 5, 4) if len(w) > n and w[:n] in model.prefixes), model.neutral)) for w in words]
        over = sorted((s - math.log(len(words)) for _, _, s in all_segments(known)), reverse=True)
        x, c, want = (over[0] + sum(o for o in over[1:] if o > 0) if over else 0.0), model.calibration, 0.0
        if x > 0:
            z = (math.log(x) - c.location) / c.scale
            toxic, clean = math.exp(-z - math.exp(-z)) / (c.scale * x), math.exp(c.ln_k - x) * math.exp(-math.exp(c.ln_k - x))
            want = 1 / (1 + clean / (toxic * math.exp(c.prior))) if toxic else 0.0
        assert abs(got[d].score - want) < 1e-6
    kept = T.reject(docs, model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in got if not got[d].predicted)


def test_copies_of_a_toxic_text_do_not_make_its_words_signs(spark):
    rows, labels = corpus(3)
    rows += [(10_000 + i, "plainword otherword grublo fleck " * 3) for i in range(300)]
    labels += [(10_000 + i, 1) for i in range(300)]
    model = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "plainword" not in model.words and "grublo" in model.words


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x " * 50_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one_kind = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, one_kind):
        model = T.fit(docs, labels)
        assert model == T.Model()
        assert [(r.score, r.predicted) for r in T.toxicity(docs, model).collect()] == [(0.0, 0)] * 4
    assert T.toxicity(docs.limit(0), T.Model()).count() == 0


def test_long_text_of_hits():
    """Falling totals, where every candidate is passed: ten times the hits take no hundred times as long."""
    took = []
    for n in (10_000, 100_000):
        start = time.perf_counter()
        T.segments([(30 * i + i % 2, 0.02) for i in range(n)], -0.01)
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * max(took[0], 0.01)


def test_calibration():
    """K, location and scale of drawn extreme values are found again."""
    rng = random.Random(3)
    gumbel = lambda: -math.log(-math.log(rng.random()))
    seen = [(gumbel() - 3.0, False) for _ in range(4000)] + [(math.exp(2.5 + 0.6 * gumbel()), True) for _ in range(4000)] + [(-math.inf, False)] * 100
    c = T.calibrate(seen)
    assert abs(c.ln_k + 3.0) < 0.2 and abs(c.location - 2.5) < 0.1 and abs(c.scale - 0.6) < 0.05 and abs(c.prior) < 0.01
    scores = [c.score(x / 4) for x in range(-40, 400)]
    assert scores == sorted(scores) and scores[0] == 0.0 and scores[-1] > 0.99
    assert T.calibrate([(1.0, False)]).score(50.0) == T.calibrate([]).score(50.0) == 0.0


def test_given_labels(spark):
    """Held-out labels of a test table: nine in ten of the toxic ones are found, one in a hundred clean ones is not left alone."""
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = T.fit(docs, labels.where(~T.held_out()))
    rows = T.toxicity(docs, model).join(labels, "doc_id").where(T.held_out()).collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
