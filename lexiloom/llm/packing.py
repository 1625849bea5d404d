"""Packing by power-of-two decomposition: pieces of binary length, buckets of equal length, no crossing of documents."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import trimmed

MAX_LENGTH = 2048
END_ID = 1

#: Characters that both tokenizer libraries are sure to put in the same class; others take the slower library.
_UNSURE = re.compile("[^\t\n\r -~¡-ɏͰ-ϿЀ-ӿ‐-‧‰-⁞€]")
_RUN = 4096


class ByteBpe:
    """Ids of a byte-level BPE file (tokenizer.json), strings of special tokens taken as ordinary text.

    The file's vocabulary is also loaded as ranks into tiktoken, which gives the same ids at several times the
    speed where the vocabulary's ids are its merge ranks; texts with unusual characters or very long runs go
    through tokenizers itself.
    """

    def __init__(self, path: str):
        self.path = path
        self.fast = self._fast(path)

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    @staticmethod
    def _fast(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], json.dumps([spec.get("pre_tokenizer"), spec.get("normalizer")])
        plain = [b for b in (*range(33, 127), *range(161, 173), *range(174, 256))]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges))
        usual = not model.get("ignore_merges") and "ByteLevel" in pre and '"add_prefix_space": true' not in pre and spec.get("normalizer") is None
        if not (in_order and usual):
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _long_run(self, text: str) -> bool:
        if len(text) <= _RUN:
            return False
        words = text.split()
        longest = max(map(len, words), default=0)
        return longest > _RUN or len(text) - sum(map(len, words)) - len(words) > _RUN

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or (not text.isascii() and _UNSURE.search(text)) or self._long_run(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def binary_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """n as whole max_length pieces and then the powers of two of what is left, largest first."""
    out = [max_length] * (n // max_length)
    rest, bit = n % max_length, max_length >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, sequence_id, offset, ids (little-endian uint32).

    A document is its ids and end_id after them; a null or empty text is end_id alone. Each piece has the
    length of a power of two up to max_length (itself one) and is a sequence of its own: bucket is that
    length's logarithm, offset is 0, and nothing is padded. Trainers draw batches from one bucket at a time.
    Repeated rows are packed as often as they occur; other columns of docs are ignored. No shuffle.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path)
        tail = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                ids = np.concatenate((bpe.ids(t), tail)) if t else tail
                n, start = len(ids), 0
                for length in binary_lengths(n, max_length):
                    rows.append((d, start, length, n, length.bit_length() - 1, ids[start : start + length].tobytes()))
                    start += length
                size += n
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(trimmed(pieces), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, bucket int, ids binary")
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    d, start, length, n, bucket, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(d), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(n, pa.int64()), pa.array(bucket, pa.int32()), pa.array(ids, pa.binary())],
        ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"],
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet, a folder per bucket of equal lengths."""
    pieces.write.partitionBy("bucket").parquet(path)
