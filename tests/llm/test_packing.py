from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from lexiloom.llm.packing import binary_lengths, byte_bpe, pack, write_buckets

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    own, rng = byte_bpe(PATH), random.Random(1)
    slow = Tokenizer.from_file(PATH)
    slow.encode_special_tokens = True
    texts = ["", " ", "a" * 9000, "\n" * 9000, " \n" * 3000, "<|endoftext|> x", "it's we'll I'd", "é  x y 　z", "漢字😀", "½ ² Ⅷ ٣"]
    alphabet = "abc 'lsé\n\t.,!?0123漢😀 \u0085​ ǅʰ٣½_<|>"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for t in texts:
        assert list(own.ids(t)) == slow.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_lengths():
    assert binary_lengths(0) == [] and binary_lengths(1) == [1] and binary_lengths(4097) == [2048, 2048, 1]
    for n in range(1, 5000, 7):
        parts = binary_lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts) and parts == sorted(parts, reverse=True)


def test_pieces_are_the_documents(spark, tmp_path):
    rows = [(1, "one two three " * 900, 1), (2, None, 1), (3, "", 1), (4, "same", 1), (5, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    found = pack(docs, PATH)
    got = defaultdict(list)
    for r in found.collect():
        assert r.length == 1 << r.bucket and r.offset == 0 and len(r.ids) == 4 * r.length
        got[r.doc_id].append(r)
    assert len({r.sequence_id for p in got.values() for r in p}) == sum(map(len, got.values()))
    for d, text, _ in rows:
        parts = sorted(got[d], key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        assert list(np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts])) == [*ids(text), 1]
        assert {r.doc_tokens for r in parts} == {sum(r.length for r in parts)}
    write_buckets(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == found.count()
    assert pack(docs.limit(0), PATH).count() == 0
    assert pack(docs.union(docs), PATH).count() == 2 * found.count()
