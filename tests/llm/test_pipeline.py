"""The pipeline's stages against plain versions, on the smallest tables."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_jaccard import brute as classes
from test_spans import brute as cut_plainly
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexiloom.llm import decontam, toxicity
from lexiloom.llm.common import written
from lexiloom.session import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """(rows before, rows after) of each stage by name."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), after.collect())
        assert name == "packing" or after.columns == COLUMNS
        docs = after
    return out


def test_order_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxicity_drops_what_it_predicts(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels").where(~toxicity.held_out()))

    def score(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        weights = toxicity.Weights(model)
        hits = [(i, weights[w]) for i, w in enumerate(words) if weights[w] is not None]
        return model.calibration.score(toxicity.evidence(toxicity.segments(hits, model.neutral), len(words)))

    assert {r.doc_id for r in after} == {r.doc_id for r in before if score(r.text) < 0.7}


def test_one_of_each_class_stays(stages):
    before, after = stages["ngram_jaccard"]
    want = {d for d, (_, c) in classes([(r.doc_id, r.text) for r in before], 5, 80, 100).items() if d == c}
    assert {r.doc_id for r in after} == want
    assert {r.doc_id: r for r in after} == {r.doc_id: r for r in before if r.doc_id in want}


def test_repeated_spans_go(stages):
    before, after = stages["substring_dedup"]
    want = cut_plainly([(r.doc_id, r.text) for r in before], 25, 50)
    assert {r.doc_id: r.text.rstrip() for r in after} == {d: t.rstrip() for d, t in want.items() if t.strip() or not dict((r.doc_id, r.text) for r in before)[d].strip()}
    old = {r.doc_id: r for r in before}
    assert all(r.n_chars == (len(r.text) if r.text != old[r.doc_id].text else old[r.doc_id].n_chars) for r in after)


def test_leaks_go_and_others_stay(spark, stages):
    before, after = stages["decontamination"]
    df, n = decontam.document_frequencies(spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string"))
    items = decontam.read_items(table(spark, SF, "benchmark"), np.log((1.0 + n) / (1.0 + df)) + 1, decontam.Codes())

    def leaks(text):
        words = [decontam.bare(w) for w in text.encode().split()]
        for item in items:
            m = len(item.words)
            for s in range(0, max(1, len(words) - 32), 32):
                part = words[max(0, s - m) : s + 64 + m]
                if item.common(part) >= 0.6 * m and item.answered(part) >= 0.25:
                    return True
        return False

    want, gone = {r.doc_id for r in before if leaks(r.text)}, {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone <= want and len(gone) >= 0.9 * len(want)


def test_packing_round_trip(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = defaultdict(list)
    for r in after:
        parts[r.doc_id].append(r)
    assert set(parts) == {r.doc_id for r in before}
    for r in before:
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(parts[r.doc_id], key=lambda p: p.start)])
        assert list(ids) == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]


def test_run_is_its_stages(spark, stages):
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages["packing"][1])


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_go_through_all_stages(spark):
    """Null and repeated ids, null, empty and very long texts, and columns named like those of the operators."""
    docs = table(spark, SF, "documents").limit(40)
    first = docs.first()
    odd = [(None, first.text), (10**6, None), (10**6 + 1, ""), (first.doc_id, first.text), (10**6 + 2, " ".join(f"w{i}" for i in range(60_000))), (10**6 + 3, "a \n b")]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], docs.schema))
    rows = rows.withColumns({c: F.lit(7) for c in ("gid", "component_id", "score", "passages", "h1", "n_removed", "item_ids", "start", "n_shingles")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = [c for c in rows.columns if c != "n_removed"]
        rows = written(stage(spark, rows, SF), name)
        assert set(kept) <= set(rows.columns), name
        left = {r.doc_id for r in rows.select("doc_id").collect()}
        assert {10**6, 10**6 + 1, 10**6 + 2} <= left and None in left, name
    pieces = written(corpus_pipeline.STAGES[-1][1](spark, rows, SF), "packing")
    assert {10**6, 10**6 + 1} <= {r.doc_id for r in pieces.where("doc_tokens = 1").collect()}
    long = pieces.where(f"doc_id = {10**6 + 2}").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).first()
    assert long.n == long.t > 60_000
