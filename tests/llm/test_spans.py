from __future__ import annotations

import random
import re

from lexiloom.llm.spans import sentences, spans, substring_dedup, without


def brute(rows, least, long):
    """Texts left, by comparing spans as words: every span that is the shortest from its start or to its end."""

    def cut(text):
        out, start = [], 0
        for m in re.finditer(r"[.!?]+(?:\s+|$)|\n\s*|$", text):
            if text[start : m.end()].split():
                out.append((start, m.end()))
                start = m.end()
        return out

    def shortest(text):
        parts = cut(text)
        words = [tuple(text[a:b].split()) for a, b in parts]
        ok = lambda i, j: sum(map(len, words[i : j + 1])) >= (least if j > i else long)
        found = set()
        for i in range(len(parts)):
            found |= {(i, j) for j in [next((j for j in range(i, len(parts)) if ok(i, j)), None)] if j is not None}
            found |= {(j, i) for j in [next((j for j in range(i, -1, -1) if ok(j, i)), None)] if j is not None}
        return parts, {(i, j): tuple(words[i : j + 1]) for i, j in found}

    made = [(d, t, *shortest(t)) for d, t in rows]
    result = {}
    for d, t, parts, own in made:
        gone = set()
        for (i, j), w in own.items():
            earlier = any(w == x and (a, b) < (i, j) for (a, b), x in own.items())
            if earlier or any(w in o.values() for e, _, _, o in made if e < d):
                gone |= set(range(i, j + 1))
        result[d] = "".join([t[: parts[0][0]] if parts else t, *(t[a:b] for k, (a, b) in enumerate(parts) if k not in gone)])
    return result


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([1, 3, 6, 14]))) + rng.choice([". ", "! ", "\n"]) for _ in range(14)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8, 12).collect()
    want = brute(rows, 8, 12)
    assert {r.doc_id: r.text.rstrip() for r in got} == {d: t.rstrip() for d, t in want.items()}
    assert sum(r.n_removed for r in got) > 30


def test_planted_passage_stays_only_in_its_first_document(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = " ".join(line(9) for _ in range(6))
    rows = [(i, f"{line(20)}\n{line(15)} {passage if i % 3 == 0 else line(30)}\n{line(12)}") for i in range(30)]
    got = {r.doc_id: r.text for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [d for d, t in sorted(got.items()) if passage.split(".")[2] in t] == [0]
    assert all(got[d] == t for d, t in rows if d % 3)
    assert all(got[d].startswith(t.split(passage)[0].rstrip()) and got[d].endswith(t.split(passage)[1].strip()) for d, t in rows if d % 3 == 0)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, "a " * 60, "x"), (3, "b " * 60, "x"), (3, "b " * 60, "y"), (4, "b " * 60, "z"), (5, "w" * 100_000, "z")],
        "doc_id long, text string, removed string",
    )
    got = substring_dedup(docs)
    assert got.columns == ["doc_id", "text", "n_sentences", "n_removed", "removed"]
    rows = {(r.doc_id, r.text): r.n_removed for r in got.collect()}
    assert rows == {(1, None): 0, (2, ""): 0, (None, "a " * 60): 0, (3, "b " * 60): 0, (4, ""): 1, (5, "w" * 100_000): 0}
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sentences_and_spans():
    text = "  One two. Three!\n\nFour 3.5 five"
    assert [text[a:b] for a, b, _, _ in sentences(text)] == ["  One two. ", "Three!\n\n", "Four 3.5 five"]
    assert [(i, j) for i, j, _ in spans(sentences(text), 3, 9)] == [(0, 1), (1, 2)]
    assert without("a b. c d. a b. c d. e", set(), 4, 9)[0] == "a b. c d. e"


def test_scripts_without_spaces(spark):
    """Sentences end at full-width stops without white space, and characters count as words."""
    assert [(a, b, n) for a, b, n, _ in sentences("今天天气很好。我们去公园！走吧 ok? yes")] == [(0, 7, 7), (7, 13, 6), (13, 20, 3), (20, 23, 1)]
    assert [n for _, _, n, _ in sentences("plain words here. More")] == [3, 1]
    shared = "这是一个很长的句子用来测试重复的段落。" * 1 + "第二个句子也在两个文件里出现并且不短。"
    rows = [(1, "开头不同的文字。" + shared + "结尾甲。"), (2, "别的开头在这里。" + shared + "结尾乙。"), (3, "没有重复的内容。")]
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[3] == (rows[2][1], 0)
    assert got[2] == ("别的开头在这里。结尾乙。", 2)


def test_texts_are_cut_once_for_their_spans(spark):
    """The table of spans is written; the rest is joins. One pass of Python finds them, one cuts."""
    docs = spark.createDataFrame([(1, "a b c. " * 30), (2, "a b c. " * 30)], "doc_id long, text string")
    plan = substring_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
