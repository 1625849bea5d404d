from __future__ import annotations

import random
import re

from lexiloom.llm.quality import RULES, STOP_WORDS, quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    stops = sum(w in STOP_WORDS for w in re.split(r"[\x20\x09-\x0D.,;:!?]+", (text or "").lower()))
    n = len(words)
    base = n < 50 or 100 * len(covered) > 50 * n
    chars = sum(map(len, words))
    good = n and 2.5 <= chars / n <= 12 and symbols / n <= 0.1 and stops / n >= 0.06 and (len(lines) - len(set(lines))) / len(lines) <= 0.4
    return n, chars, symbols, len(lines) - len(set(lines)), len(covered), base, bool(not base and good)


def test_against_plain_python(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a b", "a b c", "a b c a b c", "é ñ 漢字 😀 the", "x\x0by\x0cz\r\n\nq", "#" * 40]
    for _ in range(80):
        pool = ["the", "of", "a", "# *", "word", "Longer", "é", "x.", "\n", "\n", " ", "\t", *(f"w{i}" for i in range(rng.choice([1, 20, 300])))]
        texts.append(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 160))))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_no_python_and_one_projection(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert len({r.name for r in RULES}) == len(RULES)


def test_long_text_and_empty_table(spark):
    text = " ".join(f"w{i} the" for i in range(60_000))
    row = quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (120_000, 0, True)
    assert quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_named_like_temporary_ones(spark):
    """Columns of the caller named like any that the projection makes on its way stay as they are."""
    names = ["__t", "__w", "__flat", "__p", "___t", "n_lines"]
    docs = spark.createDataFrame([(1, "the word and the word " * 20, *range(6))], ["doc_id", "text", *names])
    row, plainly = quality(docs).first(), quality(docs.select("doc_id", "text")).first()
    assert [row[n] for n in names[:-1]] == [0, 1, 2, 3, 4]
    assert all(row[n] == plainly[n] for n in ("n_words", "n_repeat_words", "n_lines", "kept", "failed_rules"))
