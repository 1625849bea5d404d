"""Substring dedup by sliding spans of sentences: what a repeated span covers stays only where it occurs first."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import UNSPACED, fresh, passing, trimmed, written

#: A span has two sentences and SPAN_WORDS words at least, or is one sentence of LONG_WORDS words at least.
SPAN_WORDS = 25
LONG_WORDS = 50
#: Up to so many rows of (document, span) are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_BREAK = re.compile(r"[.!?]+(?:\s+|$)|[。！？｡]+\s*|\n\s*")
_NO_SPACES, _UNIT = re.compile(f"[{UNSPACED}]"), re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")


def sentences(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each sentence. A sentence ends at . ! ? before white space, at full-width stops, or at a line's end.

    White space after a sentence belongs to it. The digest is of its words, so white space doesn't count. In scripts that put no
    white space between words every character counts as a word.
    """
    out, start = [], 0
    spaced = text.isascii() or not _NO_SPACES.search(text)
    ends = [m.end() for m in _BREAK.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = text[start:end].split()
        if words:
            n = len(words) if spaced else len(_UNIT.findall(text, start, end))
            out.append((start, end, n, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
            start = end
    return out


def spans(found: list[tuple[int, int, int, bytes]], least: int = SPAN_WORDS, long: int = LONG_WORDS) -> list[tuple[int, int, bytes]]:
    """(first, last, digest) of the shortest spans that start with each sentence and that end with each."""
    n = len(found)
    before = [0, *accumulate(s[2] for s in found)]
    enough = lambda i, j: before[j + 1] - before[i] >= (least if j > i else long)
    pairs = set()
    j = 0
    for i in range(n):  # the least end grows with the start
        if enough(i, i):
            pairs.add((i, i))
            continue
        j = max(j, i + 1)
        while j < n and not enough(i, j):
            j += 1
        if j == n:
            break
        pairs.add((i, j))
    i = n - 1
    for j in range(n - 1, -1, -1):  # and the other way round
        if enough(j, j):
            pairs.add((j, j))
            continue
        i = min(i, j - 1)
        while i >= 0 and not enough(i, j):
            i -= 1
        if i < 0:
            break
        pairs.add((i, j))
    return [(i, j, xxhash.xxh3_128_digest(b"".join(s[3] for s in found[i : j + 1]))) for i, j in sorted(pairs)]


def without(text: str, repeated: set[bytes], least: int = SPAN_WORDS, long: int = LONG_WORDS) -> tuple[str, int, int, list[tuple[int, int]]]:
    """(text left, sentences, sentences removed, removed ranges of characters).

    Removed is what spans in `repeated` cover, and spans that occur earlier in the same text.
    """
    found = sentences(text)
    gone, seen = [False] * len(found), set()
    for i, j, digest in spans(found, least, long):
        if digest in repeated or digest in seen:
            gone[i : j + 1] = [True] * (j + 1 - i)
        seen.add(digest)
    if not any(gone):
        return text, len(found), 0, []
    ranges: list[tuple[int, int]] = []
    for (start, end, _, _), out in zip(found, gone, strict=True):
        if out:
            if ranges and ranges[-1][1] == start:
                ranges[-1] = (ranges[-1][0], end)
            else:
                ranges.append((start, end))
    parts, at = [], 0
    for start, end in ranges:
        parts.append(text[at:start])
        at = end
    left = "".join((*parts, text[at:])).rstrip() if ranges[-1][1] == len(text) else "".join((*parts, text[at:]))
    return left, len(found), sum(gone), ranges


def document_spans(docs: DataFrame, least: int, long: int) -> DataFrame:
    """(h1, h2, doc_id) of each span of each document, once for each text."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, counts, ids = [], [], batch.column(0)
            for text in batch.column(1):
                own = {d for _, _, d in spans(sentences(text.as_py() or ""), least, long)}
                parts.extend(own)
                counts.append(len(own))
            both = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
            where = np.repeat(np.arange(len(counts)), counts)
            for i in range(0, len(both), 200_000):
                cut = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(both[cut, 0].copy()), pa.array(both[cut, 1].copy()), ids.take(pa.array(where[cut]))], ["h1", "h2", "doc_id"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(digests), f"h1 bigint, h2 bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}")


def repeated_spans(docs: DataFrame, least: int = SPAN_WORDS, long: int = LONG_WORDS) -> DataFrame:
    """doc_id and the digests of its spans that a document with a smaller doc_id has too, in a table of the shared folder.

    Texts are cut into spans once. The least document of each span comes from an aggregation that combines before its shuffle; only
    spans with two documents are joined back. A list is no longer than its document.
    """
    with passing(docs.sparkSession):
        found = written(document_spans(docs, least, long), "found")
        least_doc = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other")).where("keeper <> other").drop("other")
        later = found.join(written(least_doc, "keepers"), ["h1", "h2"]).where("doc_id > keeper")
        return written(later.select("doc_id", "h1", "h2").distinct(), "spans", keep=True)


def substring_dedup(docs: DataFrame, least: int = SPAN_WORDS, long: int = LONG_WORDS) -> DataFrame:
    """docs with text cut, and n_sentences, n_removed, removed (ranges of characters of the old text).

    A sentence is removed where a span covers it that occurs in a document with a smaller doc_id, or earlier
    in the same text; so each sentence stays where it is first. Rows that repeat a doc_id are one document:
    they lose the same spans. Null texts stay null with counts of 0; a null doc_id has only its own text to be
    compared with. Columns n_sentences, n_removed and removed of docs are replaced, all others kept.
    """
    hashes = repeated_spans(docs, least, long)
    own_spans = fresh("__spans", docs.columns)
    lists = hashes.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias(own_spans))
    small = hashes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.drop("n_sentences", "n_removed", "removed")
    names = rows.columns
    joined = rows.join(F.broadcast(lists) if small else lists.hint("merge"), "doc_id", "left").select(*names, own_spans)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, total, lost, ranges = [], [], [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                keys = {np.array([s["h1"], s["h2"]], np.int64).tobytes() for s in own or ()}
                t, n, k, r = (None, 0, 0, []) if text is None else without(text, keys, least, long)
                texts.append(t)
                total.append(n)
                lost.append(k)
                ranges.append([{"start": a, "end": b} for a, b in r])
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(ranges, kind)], [*names, "n_sentences", "n_removed", "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return joined.mapInArrow(trimmed(cut), f"{schema}, n_sentences bigint, n_removed bigint, removed array<struct<start: bigint, end: bigint>>")
