from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer, models, normalizers

from lexiloom.llm.tokencount import MARK, UnigramCounter, counter, read_pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def reference(pieces):
    t = Tokenizer(models.Unigram(pieces, 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(MARK), normalizers.Replace(" ", MARK)])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0


def some_texts(seed, n=800):
    rng = random.Random(seed)
    letters = " \n\t\r<s></s>0x0A▁aeioñß漢字😀thing., "
    yield from ("", " ", "  ", "\n", " \n ", "a  b", "▁", "▁▁a", "a ▁b", "<s>", "<0x0A>", "x" * 200)
    for _ in range(n):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))


def test_counts_are_those_of_the_tokenizer():
    want, own = reference(read_pieces(PATH)), counter(PATH)
    assert own.by_word
    for text in some_texts(1):
        assert own.count(text) == want(text), repr(text)


def test_ties_and_unknown_characters():
    base = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    rng = random.Random(3)
    for _ in range(40):
        pieces = base + [(p, float(-rng.randint(1, 3))) for p in sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(9)})]
        want, own = reference(pieces), UnigramCounter(pieces)
        for _ in range(40):
            text = "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 14)))
            assert own.count(text) == want(text), (pieces[257:], text)


def test_rows(spark):
    want = reference(read_pieces(PATH))
    rows = [(1, "Some text, twice.", 1), (1, "Some text, twice.", 1), (2, None, 1), (3, "", 1), (None, "lost é", 1), (4, "long " * 30_000, 1)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert [(r.doc_id, r.n_tokens, r.n_bytes) for r in got] == [(d, want(t or ""), len((t or "").encode())) for d, t, _ in rows]
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
