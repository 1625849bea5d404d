from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lexiloom.llm.jaccard import SPARE_BITS, Blocks, Shingler, _meet, _rarest, _Words, jaccard_classes, keep_one


def brute(rows, n, num, den):
    """The classes by all pairs, without hashing."""
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        if words:
            sets[doc] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    parent = {doc: doc for doc, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {doc: (len(sets.get(doc, ())), find(doc)) for doc, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeABC") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 10, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near) + rng.choice(["", "", f"\n{passage}"]))
    texts += [None, "", " \n", "a", "a", "A", passage, passage, passage + " x"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 3, 90), (2, 5, 80), (3, 3, 90), (4, 2, 80)])
def test_classes_are_those_of_all_pairs(spark, seed, n, num):
    rows = corpus(seed)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, num, 100)
    assert len(got) == len(rows)


def test_sets_over_the_bound_share_a_signature():
    rng = np.random.default_rng(5)
    for num in (80, 90):
        blocks = Blocks(num, 100)
        for _ in range(600):
            a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
            b = a[rng.random(len(a)) > rng.choice([0.02, 0.1, 0.15])]
            b = np.unique(np.concatenate((b, rng.integers(0, 2**64, int(len(a) * rng.choice([0, 0.02, 0.1])), dtype=np.uint64))))
            common = np.sort(a[rng.random(len(a)) > rng.choice([0, 0.5, 1])])
            over = len(np.intersect1d(a, b))
            if len(b) and 100 * over >= num * (len(a) + len(b) - over) and over < max(len(a), len(b)):
                assert np.intersect1d(blocks(a, common), blocks(b, common)).size


@pytest.mark.parametrize(("few", "edits"), [(0, 0.02), (0, 0.05), (3, 0.03), (10**6, 0.03)])
def test_groups_near_the_bound(spark, monkeypatch, few, edits):
    """Near copies of which many are not over the bound with the group's head, joined by differences or directly."""
    monkeypatch.setattr("lexiloom.llm.jaccard.FEW", few)
    rng = random.Random(11)
    base, rows = [f"w{i}" for i in range(150)], []
    pool = [[w if rng.random() > edits else f"z{rng.randrange(10**6)}" for w in base] for _ in range(40)]
    pool += [[w if rng.random() > 0.01 else f"y{rng.randrange(10**6)}" for w in rng.choice(pool)] for _ in range(40)]
    rng.shuffle(pool)
    rows = [(i, " ".join(w[: rng.choice([150, 150, 145])])) for i, w in enumerate(pool)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_large_groups_of_copies_and_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    near = lambda: " ".join(w if rng.random() > 0.01 else f"z{rng.randrange(10**6)}" for w in base)
    rows = [(i, near() if i % 2 else "same text of nine words in all its copies") for i in range(400)]
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    want = brute(rows, 3, 90, 100)
    assert got == {d: c for d, (_, c) in want.items()}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(empty).count() == 0
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (None, "a b c d e f", 6), (2, "A b\tc d  e\nf", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_classes(docs).collect())
    assert got == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1]


def test_shingles_fold_only_ascii():
    s = lambda t, n=3: list(Shingler(n)(t.encode(), _Words()))
    assert s("A b C d") == s("a B c D")
    assert s("Ä b c") != s("ä b c")
    assert len(s("a b")) == 1 and s("a b") != s("a b c")


def test_groups_within_groups(spark, monkeypatch):
    """Documents that share passages in which they differ from their group: groups of the next rounds, two documents a pair."""
    monkeypatch.setattr("lexiloom.llm.jaccard.FEW", 0)
    monkeypatch.setattr("lexiloom.llm.jaccard.SMALL", 2)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    passages = [[f"p{k}q{i}" for i in range(11)] for k in range(3)]
    pool = []
    for _ in range(90):
        words = [w if rng.random() > 0.012 else f"z{rng.randrange(10**6)}" for w in base]
        pool.append(words + [w for p in passages if rng.random() < 0.5 for w in p])
    rows = [(i, " ".join(w)) for i, w in enumerate(pool)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)
    assert 1 < len({c for _, c in got.values()})


def test_sets_over_the_bound_meet_in_what_is_not_spared():
    """Whatever is most frequent: with random orders of the signatures, each set without as many of a kind as it can spare."""
    rng = np.random.default_rng(6)
    most = 0

    def kept(found, order):
        nonlocal most
        signs, spare = found
        out = []
        for kind in np.unique(spare):
            own = signs[spare == kind]
            free = int(kind) & ((1 << SPARE_BITS) - 1)
            most = max(most, free)
            out.append(own[np.argsort(-((own ^ order) * np.uint64(0x9E3779B97F4A7C15)).astype(float))][free:])
        return np.concatenate(out)

    for num in (80, 90):
        blocks = Blocks(num, 100)
        for _ in range(600):
            a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
            b = a[rng.random(len(a)) > rng.choice([0.02, 0.1, 0.15])]
            b = np.unique(np.concatenate((b, rng.integers(0, 2**64, int(len(a) * rng.choice([0, 0.02, 0.1])), dtype=np.uint64))))
            common = np.sort(a[rng.random(len(a)) > rng.choice([0, 0.5, 1])])
            over, order = len(np.intersect1d(a, b)), rng.integers(0, 2**64, dtype=np.uint64)
            if len(b) and 100 * over >= num * (len(a) + len(b) - over) and over < max(len(a), len(b)):
                assert np.intersect1d(kept(blocks.signed(a, common), order), kept(blocks.signed(b, common), order)).size
    assert most >= 10


def test_the_most_frequent_signatures_make_no_group(spark):
    """A signature that all of a table have, beside rarer ones, pairs nobody where a document can spare one."""
    kind = 7 << SPARE_BITS
    rows = [(1, d, d, kind | 1, 100) for d in range(100)] + [(2 + d // 2, d, d, kind | 1, 2) for d in range(100)] + [(1, 100, 100, kind, 100)]
    got = _rarest(spark.createDataFrame(rows, "sig long, doc long, component long, spare long, k long")).collect()
    assert sorted((r.sig, r.doc) for r in got) == sorted([(1, 100)] + [(2 + d // 2, d) for d in range(100)])


@pytest.mark.parametrize("most", [64, 3])
def test_pairs_over_the_bound_meet(spark, monkeypatch, most):
    """Sets that share passages: each pair over the bound in different components is tried or in a group that is divided, few others are."""
    monkeypatch.setattr("lexiloom.llm.jaccard.MEET", most)
    rng = random.Random(17)
    passages = [[rng.getrandbits(60) for _ in range(rng.choice([15, 40]))] for _ in range(6)]
    sets = []
    for _ in range(150):
        own = [rng.getrandbits(60) for _ in range(rng.choice([2, 10, 40]))]
        sets.append({*own, *(g for p in passages if rng.random() < 0.4 for g in p)})
        if rng.random() < 0.4:
            sets.append({*list(sets[-1])[rng.choice([0, 1, 3]) :], *(rng.getrandbits(60) for _ in range(rng.choice([0, 2])))})
    sets = [s or {1} for s in sets]
    component = [i - rng.randrange(2) * (i % 5 == 1) for i in range(len(sets))]
    known = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "doc_id long, grams array<long>")
    tried, large = _meet(known, spark.createDataFrame(list(enumerate(component)), "doc long, component long"), 80, 100)
    tried, groups = {(r.a, r.b) for r in tried.collect()}, {}
    for r in large.collect():
        groups.setdefault(r.gid, []).append(r.doc)
    over = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if component[a] != component[b] and over(a, b)}
    assert len(want) > 20
    assert all(p in tried or any(p[0] in g and p[1] in g for g in groups.values()) for p in want)
    assert len(tried) < 6 * len(want)


def test_a_shared_passage_pairs_nobody(spark):
    """Documents with much of their text in common, but not enough for a link: no pair and no group, however many there are."""
    sets = [(d, [*range(70), *range(1000 * (d + 1), 1000 * (d + 1) + 30)]) for d in range(200)]
    known = spark.createDataFrame(sets, "doc_id long, grams array<long>")
    tried, large = _meet(known, spark.createDataFrame([(d, d) for d in range(200)], "doc long, component long"), 80, 100)
    assert tried.isEmpty() and large.isEmpty()


def test_what_many_share_is_divided(spark, monkeypatch):
    """With no n-gram few enough for pairs, the rounds of groups give the same classes."""
    monkeypatch.setattr("lexiloom.llm.jaccard.MEET", 0)
    monkeypatch.setattr("lexiloom.llm.jaccard.FEW", 0)
    rows = corpus(6)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90, 100)
