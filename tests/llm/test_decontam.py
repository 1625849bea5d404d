from __future__ import annotations

import random
import time

import numpy as np

from lexiloom.llm import decontam as D


def make(seed=1, docs=400, items=30):
    rng = random.Random(seed)
    common = ["the", "of", "and", "in", "to", "is", "that", "for"]
    syllables = "th er on an re he in ed nd ha at en es or nt ea ti it st".split()
    word = lambda: rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 5)))
    bench = [(i, " ".join(word() for _ in range(rng.randint(15, 59))) + ".") for i in range(items)]
    rows, planted = [], {}
    for d in range(docs):
        words = [word() for _ in range(rng.randint(5, 400))]
        if d % 4 == 0:
            i = rng.randrange(items)
            leak = bench[i][1].split()
            if d % 8 == 0:  # a paraphrase: words replaced, added and left out
                leak = [w if rng.random() > 0.12 else word() for w in leak if rng.random() > 0.08]
            at = rng.randint(0, len(words))
            words[at:at] = leak
            planted[d] = i
        rows.append((d, " ".join(words)))
    return rows, bench, planted


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_planted_passages_are_found_and_others_left_alone(spark):
    rows, bench, planted = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in D.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(got) == len(rows)
    hit = sum(planted[d] in got[d].item_ids for d in planted)
    assert hit >= 0.97 * len(planted)
    assert not [d for d in got if got[d].contaminated and d not in planted]
    kept = D.clean(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d in got if not got[d].contaminated}
    assert kept.columns == ["doc_id", "text"]


def test_candidates_recall_against_all_pairs(spark):
    """Of all pairs of a text and an item that pass the later checks anywhere in the text, nine in ten are candidates."""
    rows, bench, _ = make(2, 150, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    (matcher,) = D.prepare(docs, benchmark)
    items = matcher.value.items
    want, found = set(), set()
    for d, text in rows:
        words = [D.bare(w) for w in D.tokens(text.encode())]
        for item in items:
            for s in range(0, len(words), 8):
                part = words[s : s + 128]
                if item.common(part) >= D.LEAST_COMMON * len(item.words) and item.answered(part) >= D.LEAST_ANSWER:
                    want.add((d, item.id))
                    break
        found |= {(d, i) for i, _, _ in matcher.value.leaks(text.encode())}
    assert len(want) > 20
    assert len(want & found) >= 0.9 * len(want)


def matcher_of(bench):
    """A matcher with a random basis, without documents."""
    rng = np.random.default_rng(3)
    idf = np.full(D.FEATURES, 3.0)
    items = [D.Item(i, w := [D.bare(x) for x in D.tokens(t.encode())], frozenset(sorted(set(w))[:8])) for i, t in bench]
    return D.Matcher(items, idf, np.linalg.qr(rng.standard_normal((D.FEATURES, 32)))[0].astype(np.float32))


def test_candidates_are_the_near_windows_with_an_answer(spark):
    """Against every window and item one by one."""
    rows, bench, _ = make(5, 60, 20)
    m = matcher_of(bench)
    for _, text in [*rows, (0, " ".join(t for _, t in rows[:40])), (0, "x")]:
        words = D.tokens(text.encode())
        f = m.codes.of(words)
        got = {(i, s, w): c for i, s, w, c in m.candidates(f)}
        for n, item in enumerate(m.items):
            w = D.window_of(len(item.words))
            own = m.rows[m.codes.of(item.words)].sum(0)
            answers = set(m.codes.of(sorted(item.answer)).tolist())
            for s in range(0, max(1, len(words) - w // 2), w // 2):
                v = m.rows[f[s : s + w]].sum(0)
                cosine = float(v @ own / max(1e-12, np.linalg.norm(v) * np.linalg.norm(own)))
                near = sum(x in answers for x in f[max(0, s - w) : s + 2 * w].tolist())
                if abs(cosine - D.LEAST_COSINE) > 1e-4:
                    assert ((n, s, w) in got) == (cosine >= D.LEAST_COSINE and near >= D.LEAST_ANSWER * len(item.answer))


def test_long_text_of_answer_words():
    bench = [(1, " ".join(f"w{i}" for i in range(30)))]
    m, took = matcher_of(bench), []
    for n in (20_000, 200_000):
        start = time.perf_counter()
        m.leaks(b"w1 " * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * max(took[0], 0.02)


def test_common_subsequence_is_that_of_the_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 80))] for _ in "ab")
        assert D.Item(1, a, frozenset()).common(b) == lcs(a, b)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x y", 1), (3, "w" * 10000, 1)], "doc_id long, text string, item_id int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.decontaminate(docs, none).collect()] == [False] * 4
    some = spark.createDataFrame([(1, None), (2, "short one"), (3, "x y " * 10), (None, "a b c d e f g h i j")], "item_id long, text string")
    assert [r.contaminated for r in D.decontaminate(docs, some).collect()] == [False] * 4
    assert D.decontaminate(docs.limit(0), some).count() == 0


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    rows, bench, _ = make(3, 80, 12)
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    ids = lambda: sorted((r.doc_id, r.item_id) for r in D.leaks(docs, benchmark).collect())
    one = ids()
    monkeypatch.setattr(D.blocks_of, "__defaults__", (5,))
    many = ids()
    assert one == many and len(one) > 5


def test_basis_is_orthonormal(spark):
    rows, bench, _ = make(4, 60, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df, n = D.document_frequencies(docs)
    assert n == sum(-(-len(t.split()) // D.PASSAGE) for _, t in rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1
    basis = D.fit_basis(docs, [t.encode().split() for _, t in bench], idf, n, rank=16)
    assert np.allclose(basis.T @ basis, np.eye(16), atol=1e-3)


def test_parameters_and_basis_in_blocks():
    """The stated sizes, and a basis of the same range as that of a factorisation in one piece."""
    assert (D.FEATURES, D.RANK) == (1 << 16, 64)
    x = np.random.default_rng(1).standard_normal((3 * D.BLOCK_ROWS, 24)).astype(np.float32)
    x[: D.BLOCK_ROWS] = 0
    whole = np.linalg.qr(x.astype(np.float64))[0]
    q = D._orthonormal(x)
    assert q.dtype == np.float32 and np.allclose(q.T @ q, np.eye(24), atol=1e-5)
    assert np.allclose(q @ (q.T @ whole), whole, atol=1e-5)


def test_short_items_are_found_word_for_word(spark):
    """Also those without white space, which are one word however long they are; also where no item is long."""
    texts = ["He asked: what is an acre, exactly?", "what is an acreage", "an acre is what", "昨天他问：什么是 民法典？没有人回答", "什么是刑法典", "法律what is法律an acre", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = [(1, "What is an acre?"), (2, "什么是民法典？"), (3, "?! ..."), (None, "an acre")]
    long = (4, "one two three four five six seven eight nine ten")
    for bench in (short, [*short, long]):
        benchmark = spark.createDataFrame(bench, "item_id long, text string")
        got = {r.doc_id: r for r in D.decontaminate(docs, benchmark).collect()}
        assert {d: r.item_ids for d, r in got.items() if r.contaminated} == {0: [1], 3: [2]}
        assert (got[0].cosine, got[0].common) == (None, 1.0)
        assert sorted(r.doc_id for r in D.clean(docs, benchmark).collect()) == [1, 2, 4, 5, 6, 7]
    many = {i: tuple(D.units(f"word {i}".encode())) for i in range(2000)} | {-1: ("a",) * 30}
    assert D.Verbatim(many).items(b"a " * 29 + b"Word 77. word 5000") == {77}
    assert D.Verbatim(many).items(b"A " * 31) == {-1}


def test_basis_has_all_rows(spark):
    """One long row beside 30 short ones: words of each are in the basis, and sums are those of all passages, however rows lie in partitions."""
    rng = random.Random(8)
    texts = [" ".join(f"a{d}b{rng.randrange(40)}" for _ in range(70)) for d in range(30)] + [" ".join(f"c{rng.randrange(2000)}" for _ in range(40_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf = np.full(D.FEATURES, 2.0)
    place, value = np.arange(D.FEATURES) % 8, np.linspace(-1, 1, D.FEATURES).astype(np.float32)
    got = D._gram(docs, [], idf, place, value)
    codes, want = D.Codes(), np.zeros((D.FEATURES, 8))
    x = np.zeros((D.FEATURES, 8))
    x[np.arange(D.FEATURES), place] = value
    for t in texts:
        c = codes.of(t.encode().split())
        for i in range(0, len(c), D.PASSAGE):
            f, w = D._weights(c[i : i + D.PASSAGE], idf)
            want[f] += np.outer(w, w @ x[f])
    assert np.allclose(got, want, atol=1e-3)
    basis = D.fit_basis(docs, [], idf, 0, rank=40)
    assert all(np.abs(basis[codes.of(t.encode().split())]).max() > 0 for t in texts)


def test_features_of_texts():
    """Equal for equal words without case and marks around them, however texts are cut and hashed together."""
    codes, rng = D.Codes(), random.Random(4)
    texts = [b"", None, b" \n", b'Wor "word", (WORD) w.ord !? \xc3\x84\x0b.x', b"one"] + [b" ".join(bytes(rng.choice(b"aB.c,") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (3, 9000, 200_000, 1)]
    want: dict[bytes, int] = {}
    for text, got, alone in zip(texts, codes.texts(texts), map(codes, texts), strict=True):
        words = D.tokens(text or b"")
        assert got.tolist() == alone.tolist() == codes.of(words).tolist()
        for w, f in zip(words, got.tolist(), strict=True):
            assert want.setdefault(D.bare(w), f) == f
    even = D.FEATURES * (1 - np.exp(-len(want) / D.FEATURES))
    assert len(want) > 1000 and abs(len(set(want.values())) - even) < 0.02 * even


def test_a_text_without_words_of_answers_is_not_multiplied(monkeypatch):
    """No vectors are made of a text in which no item has enough of its answer; one that has is found as before."""
    rng = np.random.default_rng(4)
    words = [f"word{i}".encode() for i in range(40)]
    items = [D.Item(1, words[:20], frozenset(words[:8])), D.Item(2, words[20:], frozenset(words[20:28]))]
    matcher = D.Matcher(items, np.ones(D.FEATURES), rng.standard_normal((D.FEATURES, 8)).astype(np.float32))
    others = [f"other{i}".encode() for i in range(100)]
    leak = b" ".join(others[:50] + words[:20] + others[50:])
    assert [i for i, *_ in matcher.leaks(leak)] == [1]
    monkeypatch.setattr(D.Matcher, "_sums", None)
    assert matcher.leaks(b" ".join(others + words[8:12])) == []


def test_vectors_are_made_around_answers_only(monkeypatch):
    """Of a long text with one leak only the words of windows around it have vectors summed."""
    rng = np.random.default_rng(4)
    words = [f"word{i}".encode() for i in range(20)]
    others = [f"other{i}".encode() for i in range(10_000)]
    matcher = D.Matcher([D.Item(1, words, frozenset(words[:8]))], np.ones(D.FEATURES), rng.standard_normal((D.FEATURES, 8)).astype(np.float32))
    summed, sums = [], D.Matcher._sums
    monkeypatch.setattr(D.Matcher, "_sums", lambda self, features, half: summed.append(len(features)) or sums(self, features, half))
    assert [i for i, *_ in matcher.leaks(b" ".join(others[:5000] + words + others[5000:]))] == [1]
    assert 0 < sum(summed) < 1000


def test_texts_searched_together_have_their_own_leaks(monkeypatch):
    """Equal to each text alone, whatever stands beside it: empty and null ones, long ones, halves of an item in neighbours."""
    rows, bench, _ = make(6, 120, 20)
    m = matcher_of(bench)
    item = bench[0][1].split()
    texts = [t.encode() for _, t in rows]
    texts[3:3] = [None, b"", b" ".join(texts[:60]), b"", " ".join(item[: len(item) // 2]).encode(), " ".join(item[len(item) // 2 :]).encode(), b"x", None]
    alone = [[(i, s) for i, _, s in m.leaks(t)] for t in texts]
    assert sum(map(bool, alone)) > 20
    for held in (1, 700, D.HELD_WORDS):
        monkeypatch.setattr(D, "HELD_WORDS", held)
        assert [[(i, s) for i, _, s in found] for found in m.leaks_of(texts)] == alone
    monkeypatch.setattr(D, "BLOCK_PAIRS", 7)
    monkeypatch.setattr(D, "HELD_PAIRS", 60)
    assert [[(i, s) for i, _, s in found] for found in m.leaks_of(texts)] == alone
    assert list(m.leaks_of([])) == [] and list(m.leaks_of([None])) == [[]]
