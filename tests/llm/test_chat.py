from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lexiloom.llm import chat


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn, role is not None, role, text is not None, text))
    turns = {c: [(x[3], x[5]) for x in sorted(v, key=lambda x: tuple(y if y is not None else 0 for y in x[:2]) + tuple(y or "" for y in (x[3], x[5])))] for c, v in by.items()}
    kept = {}
    for c, t in turns.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in turns.values()) or any(turns[d] == t and d < c for d in turns):
            continue
        kept[c] = (len(t), "".join(f"<|{r or ''}|>\n{x or ''}\n" for r, x in t))
    return kept


@pytest.mark.parametrize("block", [2, 256])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng, rows, logs = random.Random(1), [], []
    for c in range(60):
        base = list(rng.choice(logs)) if logs and rng.random() < 0.6 else []
        base = base[: rng.randint(1, len(base))] if base and rng.random() < 0.5 else base
        base += [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randint(0 if base else 1, 4))]
        logs.append(base)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(base)]
    rng.shuffle(rows)
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns string"
    rows = [(1, 0, None, "hi", "x"), (2, 0, "", "hi", "x"), (3, 5, "user", None, "x"), (4, 0, "user", "", "x"), (None, 0, "user", "lost", "x")]
    rows += [(5, 1, "user", "b", "x"), (5, 1, "user", "a", "x"), (5, 1, "user", "a", "x"), (6, None, "user", "z" * 10_000, "x")]
    got = {r.conv_id: r.text for r in chat.chat_format(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[5] == "<|user|>\na\n<|user|>\na\n<|user|>\nb\n" and got[3] == "<|user|>\n\n" and len(got[6]) == 10_010
    assert chat.chat_format(spark.createDataFrame([], schema)).count() == 0


def test_equal_turn_numbers_of_two_conversations(spark, monkeypatch):
    """A conversation goes only if what is rendered of it begins another."""
    rng, rows = random.Random(4), []
    for i in range(40):
        p, q = f"p{i}", f"q{i}"
        rows += [(2 * i, 1, "user", p), (2 * i, 1, "user", q), (2 * i + 1, 1, "user", rng.choice([p, q]))]
    rows += [(200, 1, "user", "b"), (200, 1, "user", "a"), (200, None, None, None), (201, None, None, None), (201, 1, "user", "a"), (202, 1, "user", "a"), (202, 1, "user", "a"), (203, 1, "user", "a")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = brute(rows)
    assert 80 > len(want) > 40
    for most in (200_000, 0):
        monkeypatch.setattr(chat, "BROADCAST_KEYS", most)
        assert {r.conv_id: (r.n_turns, r.text) for r in chat.chat_format(docs).collect()} == want
