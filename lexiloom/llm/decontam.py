"""Benchmark decontamination: latent semantic candidates, then longest common subsequence and answer checks."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import UNSPACED, binary_column, trimmed, written

#: Words are hashed to so many features, a power of two; counts, basis and projection all have this fixed size.
FEATURES = 1 << 16
RANK, OVERSAMPLE = 64, 8
PASSAGE = 64
#: The least number of words of a window that items are looked for in; others are twice, four times, ... as long.
LEAST_WINDOW = 16
#: A pair of passage and item is looked at from this cosine on, and a leak from these shares on.
LEAST_COSINE, LEAST_COMMON, LEAST_ANSWER = 0.35, 0.6, 0.25
#: Without an answer of its own, an item's answer is so many of its rarest words.
ANSWER_WORDS = 8
#: Items with fewer words are searched for word for word only.
LEAST_WORDS = 8
#: Items searched for in one pass over the documents.
BLOCK_ITEMS = 10_000
#: Bytes of a text that are hashed at a time, or to the end of a word; words of many texts whose passages are counted or multiplied at a time.
PIECE, HELD_WORDS = 1 << 18, 30_000
#: As HELD_WORDS, where features by passages are a full matrix.
GRAM_WORDS = 4096
#: Texts are hashed together up to so many bytes.
TOGETHER = 1 << 16
#: Texts are searched together up to HELD_WORDS words and so many pairs of text and item; so many pairs of window and item are multiplied at a time.
HELD_PAIRS, BLOCK_PAIRS = 1 << 20, 1 << 14
#: Features whose rows of a product travel as one.
FEATURE_ROWS = 64
#: Rows of a tall matrix that are copied, sent or factored at a time, and words of a text whose vectors are held at a time.
BLOCK_ROWS = 8192
_EDGE = b".,;:!?\"'()[]"
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
_IS_BLANK = np.array([_BLANK.match(bytes([b])) is not None for b in range(256)])
_IS_INNER = ~_IS_BLANK & np.array([b not in _EDGE for b in range(256)])
#: Tables for bytes.translate: of each byte, whether it is blank or inside a word, and the byte without case.
_BLANKS, _INNERS, _LOWER = bytes(_IS_BLANK.tolist()), bytes(_IS_INNER.tolist()), bytes(range(256)).lower()
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_UNIT = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
_UNIT_EDGE = _EDGE.decode() + "\u3001\u3002\uff0c\uff0e\uff01\uff1f\uff1a\uff1b\uff08\uff09\u300c\u300d\u300e\u300f\u2026\u201c\u201d\u2018\u2019\u00ab\u00bb\u00bf\u00a1"
#: So many first units of a short item are looked up at once.
HEAD_UNITS = 8


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def bare(word: bytes) -> bytes:
    return word.lower().strip(_EDGE)


def units(text: bytes) -> list[str]:
    """Words without case and punctuation around them; a letter of a script without white space is one of its own."""
    return [u for w in _UNIT.findall(text.decode("utf-8", "replace").lower()) if (u := w.strip(_UNIT_EDGE))]


class Codes:
    """Features of words without case and marks around them: a polynomial in their bytes modulo 2**64, mixed.

    The polynomials of all words of a text come from one running sum over its bytes.
    """

    def __init__(self):
        self.powers = self.inverse = np.empty(0, np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The features of tokens(text)."""
        out, at, text = [np.empty(0, np.int64)], 0, text or b""
        while at < len(text):
            found = _BLANK.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = found.start() if found else len(text)
            data = text[at:end]
            out.append(self._hashed(data, *self._bounds(data)))
            at = end
        return out[1] if len(out) == 2 else np.concatenate(out)

    def texts(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The features of each text; short ones are hashed together."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at] or b"")
            while end < len(texts) and size + len(texts[end] or b"") < TOGETHER:
                size += len(texts[end] or b"")
                end += 1
            own = [t or b"" for t in texts[at:end]]
            if len(own) == 1:
                yield self(own[0])
            else:
                ends = np.cumsum([len(t) + 1 for t in own])
                data = b" ".join(own)
                begin, end_of = self._bounds(data)
                yield from np.split(self._hashed(data, begin, end_of), np.searchsorted(begin, ends[:-1]))
            at = end

    def of(self, words: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        return self._hashed(b"".join(words), np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends)

    @staticmethod
    def _bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end."""
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = np.frombuffer(data.translate(_BLANKS), bool)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        return edges[::2], edges[1::2]

    def _hashed(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = len(data)
        if size > len(self.powers):
            self.powers = np.cumprod(np.full(max(size, 1 << 14), _BASE, np.uint64))
            self.inverse = np.cumprod(np.full(len(self.powers) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
        first, last, full = begin.copy(), end.copy(), np.flatnonzero(begin < end)
        inner = np.frombuffer(data.translate(_INNERS), bool)
        # only words that begin or end with a mark are trimmed; where nothing is left the sum is 0
        edge = full[~(inner[begin[full]] & inner[end[full] - 1])]
        if len(edge):
            at = np.flatnonzero(inner)
            low, high = np.searchsorted(at, begin[edge]), np.searchsorted(at, end[edge])
            last[edge] = first[edge]
            some = low < high
            edge = edge[some]
            first[edge], last[edge] = at[low[some]], at[high[some] - 1] + 1
        values = np.frombuffer(data.translate(_LOWER), np.uint8) + np.uint64(1)
        values *= self.powers[:size]
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        h = (sums[last] - sums[first]) * self.inverse[first]
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return ((h >> np.uint64(32)) & np.uint64(FEATURES - 1)).astype(np.int64)


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))


def _passages(batches: Iterator[pa.RecordBatch], held_words: int = HELD_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(passage, feature, how often) of the passages of PASSAGE words of some texts at a time, by passage; and how many passages these are."""
    most = max(1, held_words // PASSAGE) * PASSAGE
    codes = Codes()
    held: list[np.ndarray] = []
    size = base = 0

    def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        keys = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out = keys[first] // FEATURES, keys[first] % FEATURES, np.diff(np.append(first, len(keys))), base
        held.clear()
        return out

    for batch in batches:
        for found in codes.texts(binary_column(batch, "text")):
            for i in range(0, len(found), most):
                part = found[i : i + most]
                held.append((base + np.arange(len(part)) // PASSAGE) * FEATURES + part)
                base += -(-len(part) // PASSAGE)
                size += len(part)
                if size > held_words:
                    yield taken()
                    size = base = 0
    if held:
        yield taken()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of PASSAGE words each feature occurs, and how many passages there are, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(FEATURES, np.int64), 0
        for _, feature, _, n in _passages(batches):
            total += np.bincount(feature, minlength=FEATURES)
            passages += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], passages))], ["feature", "n"])

    sums = _texts(docs).mapInArrow(trimmed(count), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df, feature, n = np.zeros(FEATURES), sums.column("feature").to_numpy(), sums.column("n").to_numpy()
    df[feature[feature >= 0]] = n[feature >= 0]
    return df, int(n[feature < 0].sum())


def _weights(codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a passage and their TF-IDF, of unit length."""
    f, k = np.unique(codes, return_counts=True)
    w = k * idf[f]
    norm = math.sqrt(float(w @ w))
    return f, w / norm if norm else w


def fit_basis(docs: DataFrame, items: list[list[bytes]], idf: np.ndarray, passages: int, rank: int = RANK) -> np.ndarray:
    """FEATURES x rank: right singular vectors of the TF-IDF passages of all rows and of the items, by Nystroem's method.

    One pass adds up Y = A'(A X) on the executors, where X puts each feature into one column drawn for it, with a sign, and so has orthonormal
    columns; there are as many sums as features. A'A is then about Y (X'Y)^-1 Y', whose eigenvectors come from tall
    matrices of fixed size, at the driver. `passages` says nothing any more.
    """
    own, rng = Codes(), np.random.default_rng(7)
    place = rng.integers(0, rank + OVERSAMPLE, FEATURES)
    value = (rng.choice([-1.0, 1.0], FEATURES) / np.sqrt(np.bincount(place, minlength=rank + OVERSAMPLE))[place]).astype(np.float32)
    x = np.zeros((FEATURES, rank + OVERSAMPLE), np.float32)
    x[np.arange(FEATURES), place] = value
    y = _gram(docs, [_weights(own.of(words), idf) for words in items], idf, place, value)
    inner = sum(x[c].T.astype(np.float64) @ y[c] for c in _blocks(len(x)))
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    sound = values > 1e-6 * max(values[-1], 1e-300)
    if not sound.any():
        return np.zeros((FEATURES, 1), np.float32)
    root = (vectors[:, sound] / np.sqrt(values[sound])).astype(np.float32)
    for c in _blocks(len(x)):
        x[c, : root.shape[1]] = y[c] @ root
    x = np.ascontiguousarray(x[:, : root.shape[1]])
    del y
    q = _orthonormal(x.copy())
    inner = sum(q[c].T.astype(np.float64) @ x[c] for c in _blocks(len(x)))
    return (q @ np.linalg.svd(inner)[0][:, :rank].astype(np.float32)).astype(np.float32)


def _blocks(n: int) -> list[slice]:
    return [slice(i, i + BLOCK_ROWS) for i in range(0, n, BLOCK_ROWS)]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the range of x, in its place: QR of blocks of rows, then of their triangles. Only a block is copied."""
    triangles = []
    for c in _blocks(len(x)):
        x[c], r = np.linalg.qr(x[c].astype(np.float64))
        triangles.append(r)
    q = np.linalg.qr(np.concatenate(triangles))[0]
    for i, c in enumerate(_blocks(len(x))):
        x[c] = x[c].astype(np.float64) @ q[i * x.shape[1] : (i + 1) * x.shape[1]]
    return x


def _gram(docs: DataFrame, known: list, idf: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A'(A X) for the TF-IDF passages of docs and the known rows, each of unit length; a row of sums for FEATURE_ROWS features.

    X has `value` in the column `place` of each feature and else nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast((idf, place, value))
    width = int(place.max()) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, place, value = shared.value
        total, row, has = np.zeros((FEATURES, width), np.float32), np.zeros(FEATURES, np.int64), np.zeros(FEATURES, bool)
        for passage, f, k, n in _passages(batches, GRAM_WORDS):
            w = k * idf[f]
            norms = np.sqrt(np.bincount(passage, w * w, n))
            w = w / np.maximum(norms, 1e-300)[passage]
            products = np.bincount(passage * width + place[f], w * value[f], n * width).astype(np.float32).reshape(n, width)
            # the passages' own features as rows, so that what they add is one product of small full matrices
            has[f] = True
            own = np.flatnonzero(has)
            has[own] = False
            row[own] = np.arange(len(own))
            weights = np.zeros((len(own), n), np.float32)
            weights[row[f], passage] = w
            sums = weights @ products
            sums += total.take(own, 0)
            total[own] = sums
        blocks = total.reshape(-1, FEATURE_ROWS * width)
        found = np.flatnonzero(blocks.any(1))
        for i in range(0, len(found), FEATURE_ROWS):
            part = found[i : i + FEATURE_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([blocks[b].tobytes() for b in part], pa.binary())], ["block", "rows"])

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(rows.as_buffer(), np.float32)
                total[b] = total[b] + v if b in total else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "rows"])

    kind = "block bigint, rows binary"
    added = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(trimmed(add), kind)
    rows = added.repartition("block").mapInArrow(trimmed(added_up), kind).toArrow()
    shared.destroy()
    out = np.zeros((FEATURES, width), np.float32)
    blocks = out.reshape(-1, FEATURE_ROWS * width)
    for b, row in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        blocks[b] = np.frombuffer(row.as_buffer(), np.float32)
    del rows
    for f, w in known:
        out[f] += np.outer(w, np.bincount(place[f], w * value[f], width))
    return out


def places(words: list) -> dict:
    """The places of each word, as bits."""
    bits: dict = {}
    for i, w in enumerate(words):
        bits[w] = bits.get(w, 0) | 1 << i
    return bits


def common(bits: dict, size: int, words: list) -> int:
    """The length of the longest common subsequence of some words and `size` others with these places, a machine word of places at a time."""
    full = (1 << size) - 1
    v, get = full, bits.get
    for w in words:
        if m := get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


@dataclass
class Item:
    """An item ready to be compared: places of its words as bits, and its answer."""

    id: int
    words: list[bytes]
    answer: frozenset[bytes]
    bits: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.bits = places(self.words)

    def common(self, words: list[bytes]) -> int:
        return common(self.bits, len(self.words), words)

    def answered(self, words: list[bytes]) -> float:
        return len(self.answer.intersection(words)) / len(self.answer) if self.answer else 1.0


def read_items(benchmark: DataFrame, idf: np.ndarray, codes: Codes, short: dict[int, tuple[str, ...]] | None = None) -> list[Item]:
    """The items of one block. An `answer` column is the answer; without one, the rarest words of the text are.

    Units of items with fewer than LEAST_WORDS words are put into `short`.
    """
    has = "answer" in benchmark.columns
    out = []
    for r in benchmark.select("item_id", F.col("text").cast("string"), *(["answer"] if has else [])).collect():
        words = [bare(w) for w in tokens((r["text"] or "").encode())]
        words = [w for w in words if w]
        if r["item_id"] is None:
            continue
        if len(words) < LEAST_WORDS:
            own = tuple(units((r["text"] or "").encode()))
            if own and short is not None:
                short[r["item_id"]] = own
            continue
        answer = [w for w in map(bare, tokens((r["answer"] or "").encode())) if w] if has else []
        if not answer:
            rarity = dict(zip(words, idf[codes.of(words)].tolist(), strict=True))
            answer = sorted(rarity, key=lambda w: (-rarity[w], w))[:ANSWER_WORDS]
        out.append(Item(r["item_id"], words, frozenset(answer)))
    return out


def blocks_of(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> list[DataFrame]:
    """The benchmark in parts of about `size` rows, by hash of the id; each is a pass over the documents."""
    n = max(1, math.ceil(benchmark.count() / size))
    return [benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


class Verbatim:
    """Finds short items in a text by their whole sequence of units, however many items there are."""

    def __init__(self, short: dict[int, tuple[str, ...]]):
        #: Items by their first units, and how many of these there are for items that begin with a unit.
        self.heads: dict[tuple[str, ...], list[tuple[int, tuple[str, ...]]]] = {}
        self.lengths: dict[str, set[int]] = {}
        for item, own in short.items():
            head = own[:HEAD_UNITS]
            self.heads.setdefault(head, []).append((item, own))
            self.lengths.setdefault(own[0], set()).add(len(head))

    def items(self, text: bytes) -> set[int]:
        found: set[int] = set()
        if not self.heads:
            return found
        words = tuple(units(text))
        for i, w in enumerate(words):
            for n in self.lengths.get(w, ()):
                found.update(item for item, own in self.heads.get(words[i : i + n], ()) if words[i : i + len(own)] == own)
        return found


def window_of(words: int) -> int:
    """The window that an item of so many words is looked for in: a power of two that holds it."""
    return max(LEAST_WINDOW, 1 << (words - 1).bit_length())


class Matcher:
    """Finds the items of a block in a text: (item, cosine, share in common) of each leak; short items have no cosine.

    Windows of each length stand half a length apart, so one holds three quarters of an item's place at least. A pair of
    window and item with too few words of the item's answer around the window can be no leak and goes first, in arrays;
    of the others the latent vectors are held against each other, and the near ones, by cosine, are the candidates.
    These have their longest common subsequence compared, of features first, as words have no longer one; then that of words.
    """

    def __init__(self, items: list[Item], idf: np.ndarray, basis: np.ndarray, short: dict[int, tuple[str, ...]] | None = None):
        self.verbatim = Verbatim(short or {})
        self.items, self.codes = items, Codes()
        self.rows = np.concatenate((basis * idf[:, None].astype(np.float32), np.zeros((1, basis.shape[1]), np.float32)))  # the last is for no word
        features = [self.codes.of(i.words) for i in items]
        latent = self._unit(np.array([self.rows[f].sum(0) for f in features], np.float32).reshape(len(items), basis.shape[1]))
        windows = np.array([window_of(len(i.words)) for i in items])
        #: Of each item: the places of its features as bits.
        self.features = [places(f.tolist()) for f in features]
        #: By length of window: the latent vectors of its items. Of each item: the length, and its row there.
        self.windows, self.place, self.scales = windows, np.zeros(len(items), np.int64), {}
        for w in sorted(set(windows.tolist())):
            own = np.flatnonzero(windows == w)
            self.place[own] = np.arange(len(own))
            self.scales[w] = latent[own]
        # by feature, where the items that have it in their answer begin and end in `holders`
        answers = [np.unique(self.codes.of(sorted(i.answer))) for i in items]
        feature, holder = np.concatenate([np.empty(0, np.int64), *answers]), np.repeat(np.arange(len(items)), [len(a) for a in answers])
        order = np.argsort(feature, kind="stable")
        self.begin, self.holders = np.searchsorted(feature[order], np.arange(FEATURES + 1)), holder[order]
        #: How many words of its answer an item needs at least.
        self.need = np.array([max(1, math.ceil(LEAST_ANSWER * len(i.answer))) for i in items])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)

    def _sums(self, features: np.ndarray, half: int) -> np.ndarray:
        """Sums of the vectors of each `half` words, from a few thousand words at a time."""
        step = max(half, BLOCK_ROWS // half * half)
        parts = []
        for i in range(0, len(features), step):
            part = features[i : i + step]
            part = np.concatenate((part, np.full(-len(part) % half, FEATURES)))
            parts.append(self.rows[part].reshape(-1, half, self.rows.shape[1]).sum(1))
        return np.concatenate(parts)

    def _answers(self, features: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the words of answers, of the items that a text has enough of for a leak; `text` has the text of each word."""
        at = np.flatnonzero(self.begin[features + 1] > self.begin[features])
        own = features[at]
        begin = self.begin[own]
        n = self.begin[own + 1] - begin
        item = self.holders[np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)]
        at = np.repeat(at, n)
        key = text[at] * len(self.need) + item
        often = np.bincount(key)[key] >= self.need[item]
        return at[often], item[often]

    def candidates(self, features: np.ndarray, ends: np.ndarray | None = None) -> Iterator[tuple[int, int, int, float]]:
        """(item's place, window's start, its words, cosine) of each window and item with LEAST_COSINE or more and enough
        words of an answer around. With `ends`, features are those of several texts, each up to its end there; none has a window of another's."""
        if not len(features) or not self.scales:
            return
        ends = np.array([len(features)]) if ends is None else ends
        sizes = np.diff(ends, prepend=0)
        begins, text = ends - sizes, np.repeat(np.arange(len(ends)), sizes)
        at, item = self._answers(features, text)
        if not len(item):
            return
        held = self.windows[item]
        for window, latent in self.scales.items():
            own = np.flatnonzero(held == window)
            if not len(own):
                continue
            half, size, members = window // 2, len(latent), np.flatnonzero(self.windows == window)
            # texts lie in blocks of half a window; window k of a text is its blocks k and k + 1, if there are two
            blocks = -(-sizes // half)
            before = np.cumsum(blocks) - blocks
            # the stretch around window k lies in blocks k - 2 to k + 3
            of = text[at[own]]
            around = ((at[own] - begins[of]) // half)[:, None] + np.arange(-3, 3)
            key = (around + before[of][:, None]) * size + self.place[item[own]][:, None]
            key = key[(around >= 0) & (around < np.maximum(1, blocks[of] - 1)[:, None])]
            key.sort()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
            pairs = key[first]
            pairs = pairs[np.diff(np.append(first, len(key))) >= self.need[members[pairs % size]]]
            for i in range(0, len(pairs), BLOCK_PAIRS):
                asked, row = np.unique(pairs[i : i + BLOCK_PAIRS] // size, return_inverse=True)
                column = pairs[i : i + BLOCK_PAIRS] % size
                of = np.searchsorted(before, asked, side="right") - 1
                start = begins[of] + (asked - before[of]) * half
                # vectors of the blocks of these windows only; words beyond a text's end are none
                needed = np.unique(np.concatenate((asked, asked[blocks[of] > 1] + 1)))
                whose = np.searchsorted(before, needed, side="right") - 1
                words = (begins[whose] + (needed - before[whose]) * half)[:, None] + np.arange(half)
                own_features = np.where(words < ends[whose][:, None], features.take(words, mode="clip"), FEATURES)
                sums = self._sums(own_features.ravel(), half)
                at_block = np.searchsorted(needed, asked)
                vectors = sums[at_block]
                two = np.flatnonzero(blocks[of] > 1)
                vectors[two] += sums[at_block[two] + 1]
                norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
                cosines = np.einsum("ij,ij->i", vectors[row], latent[column]) / norms[row]
                for x in np.flatnonzero(cosines >= LEAST_COSINE).tolist():
                    yield int(members[column[x]]), int(start[row[x]]), window, float(cosines[x])

    def leaks_of(self, texts: list[bytes | None]) -> Iterator[list[tuple[int, float | None, float]]]:
        """leaks of each text; short ones are searched together."""
        most = max(1, HELD_PAIRS // max(1, len(self.items)))
        held: list[np.ndarray] = []
        words = done = 0
        for features in self.codes.texts(texts):
            if held and (words + len(features) > HELD_WORDS or len(held) == most):
                yield from self._leaks(texts[done : done + len(held)], held)
                done, words, held = done + len(held), 0, []
            held.append(features)
            words += len(features)
        if held:
            yield from self._leaks(texts[done:], held)

    def leaks(self, text: bytes | None) -> list[tuple[int, float | None, float]]:
        return self._leaks([text], [self.codes(text)])[0]

    def _leaks(self, texts: list[bytes | None], held: list[np.ndarray]) -> list[list[tuple[int, float | None, float]]]:
        features, ends = np.concatenate(held), np.cumsum([len(f) for f in held])
        words: dict[int, list[bytes]] = {}
        best: list[dict[int, tuple[float | None, float]]] = [{} for _ in texts]
        for i, start, window, cosine in self.candidates(features, ends):
            t = int(np.searchsorted(ends, start, side="right"))
            item, begin = self.items[i], int(ends[t]) - len(held[t])
            m, known = len(item.words), best[t].get(item.id, (0.0, 0.0))[1]
            stretch = slice(max(begin, start - m) - begin, start + window + m - begin)
            # equal words have equal features
            if known == 1.0 or common(self.features[i], m, held[t][stretch].tolist()) < LEAST_COMMON * m:
                continue
            if t not in words:
                words[t] = tokens(texts[t])
            part = list(map(bare, words[t][stretch]))
            if item.answered(part) < LEAST_ANSWER:
                continue
            share = item.common(part) / m
            if share >= LEAST_COMMON and share > known:
                best[t][item.id] = (cosine, share)
        for text, found in zip(texts, best, strict=True):
            for short in self.verbatim.items(text or b""):
                found.setdefault(short, (None, 1.0))
        return [[(i, c, s) for i, (c, s) in sorted(found.items())] for found in best]


def prepare(docs: DataFrame, benchmark: DataFrame) -> list:
    """A (broadcast) Matcher for each block of the benchmark: document frequencies over all docs, and one basis for all blocks,
    fitted on all rows of both."""
    df, passages = document_frequencies(docs)
    idf = np.log((1.0 + passages) / (1.0 + df)) + 1.0
    text = F.col("text").cast("string").alias("text")
    basis = np.zeros((FEATURES, 1), np.float32)
    if not benchmark.isEmpty():
        basis = fit_basis(docs.select(text).unionByName(benchmark.select(text)), [], idf, passages)
    out = []
    for block in blocks_of(benchmark):
        short: dict[int, tuple[str, ...]] = {}
        items = read_items(block, idf, Codes(), short)
        if items or short:
            out.append(docs.sparkSession.sparkContext.broadcast(Matcher(items, idf, basis, short)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common) of each item found in each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = [_search(docs, m, kind) for m in prepare(docs, benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id bigint, cosine double, common double")
    return written(functools.reduce(DataFrame.unionByName, found), "leaks")


def _search(docs: DataFrame, matcher, kind: str) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matcher.value.leaks_of(binary_column(batch, "text"))
            rows = [(d, *leak) for d, leaks in zip(batch.column(0).to_pylist(), found, strict=True) for leak in leaks]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "common"])

    return _texts(docs, "doc_id").mapInArrow(trimmed(search), f"doc_id {kind}, item_id bigint, cosine double, common double")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, cosine and common (the greatest) of every row of docs.

    A text is contaminated where a window of it is near an item in the latent space, and the stretch around the window
    has LEAST_COMMON of the item's words as a common subsequence and LEAST_ANSWER of its answer. Null and empty
    texts are clean, and so is everything where the benchmark is empty. Items with fewer than LEAST_WORDS words
    are leaks where their whole sequence of words (of letters, in scripts without white space) occurs; their cosine is null. Rows that repeat a doc_id share one answer; a null doc_id gets that of all rows without one.
    """
    found = leaks(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("cosine").alias("cosine"), F.max("common").alias("common"))
    ids = docs.select(F.col("doc_id").alias("id"))
    out = ids.join(found, ids["id"].eqNullSafe(found["doc_id"]), "left").select(F.col("id").alias("doc_id"), "item_ids", "cosine", "common")
    empty = F.array().cast("array<bigint>")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", empty).alias("item_ids"), "cosine", "common")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, by one filter for each block of the benchmark; no shuffle of texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs
    for matcher in prepare(docs, benchmark):

        def keep(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not leaks for leaks in matcher.value.leaks_of(binary_column(batch, "text"))], pa.bool_()))

        out = out.mapInArrow(trimmed(keep), schema)
    return out
