"""Spelling variants against all pairs of words and a plain edit distance."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from lexiloom.llm import queries, spelling

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, letters=6, least=5, ratio=5, drop=199):
    n = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def key(rows):
    return sorted(rows, key=repr)


def test_all_words_of_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_spelling_variants(spark, sf).collect()
    assert key(tuple(r[c] for c in COLUMNS) for r in got) == key(brute(rows))


def test_repeated_bigrams_accents_ties_and_chains(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("anà") for _ in range(rng.randint(6, 9))) for _ in range(300)}
    text = [(i, w, rng.choice([1, 5, 6, 30, 31, 160])) for i, w in enumerate(sorted(words))]
    rows = [(i, " ".join([w] * k)) for i, w, k in text] + [(None, "ananan " * 5), (None, None), (3, ""), (4, "Ananan,ANANAN;anan×an÷ Öffnung öffnung x1y")]
    rows += [(5, "qwertz " * 5 + "qwertzu " * 30 + "qwertzui " * 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for drop in (None, 7):
        assert key(found(spelling.spelling_variants(docs, drop=drop))) == key(brute(rows, drop=drop))
    assert ("qwertz", "qwertzu", "qwertzui", 5, 1, 30) in found(spelling.spelling_variants(docs))


def test_prefixes_share_an_untouched_bigram():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(2, 9)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + rng.choice("abc") + a[i:], a[:i] + rng.choice("bc") + a[i + 1 :]])
        if a == b or len(b) < 2:
            continue
        ranks = {g: i for i, g in enumerate(rng.sample([x + y for x in "abc" for y in "abc"], 9))}
        keys = [spelling.prefix_keys(w, ranks) for w in (a, b)]
        if min(len(a), len(b)) >= 6:
            short, long_ = sorted(zip((a, b), keys, strict=True), key=lambda p: len(p[0]))
            theirs = long_[1][0] if len(a) == len(b) else long_[1][1]
            assert set(short[1][0]) & set(theirs), (a, b)


def test_hot_word_long_text_clashing_columns_and_nothing(spark):
    docs = spark.createDataFrame([(1, "hothothot " * 50_000, 1, "w"), (1, "hothotho " * 6, 2, "v")], "doc_id long, text string, n int, word string")
    assert key(found(spelling.spelling_variants(docs))) == [("hothotho", "hothothot", "hothothot", 6, 1, 50_000), ("hothothot", None, "hothothot", 50_000, 1, None)]
    assert found(spelling.spelling_variants(docs.limit(0))) == []


def test_counts_that_are_passed_on_early_add_up(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    rows = [(i, "alphabet betacarotene gammaray deltawing") for i in range(40)]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(["alphabet", "betacarotene", "gammaray", "deltawing"], 40)
