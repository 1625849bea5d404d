"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import SPACE, binary_column, fresh, trimmed, written

#: The most labelled documents that the classifier is fitted on: those with the least hash of their id.
FIT_DOCS = 20_000
#: Groups of about so many documents of the sample are fitted side by side; no task holds more.
SHARD_DOCS = 2500
#: The shards' models are averaged after each of so many rounds of so many passes over the shard.
ROUNDS, EPOCHS = 3, 3
#: Features that words are hashed to, features that metadata is hashed to, and the rank of the interactions.
WORDS, METADATA, RANK = 1 << 13, 1 << 8, 8
STEP, DECAY = 0.15, 2e-5
THRESHOLD = 0.3
#: Where the bins of a share begin.
EDGES = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.45, 0.6, 0.75, 0.88, 0.96, 0.995])
_LONGEST = 40  # bins of a logarithm
#: Structure statistics that are shares, and those that are amounts.
SHARES = ("upper", "digit", "symbol", "high", "space", "symbol_ends", "distinct_words", "top_word", "distinct_windows", "distinct_lines", "doubled_words")
AMOUNTS = ("n_bytes", "n_words", "word_bytes", "line_words")
SIZE = WORDS + len(SHARES) * (len(EDGES) + 1) + len(AMOUNTS) * _LONGEST + METADATA
_KIND = np.full(256, 2, np.int64)  # 0 upper case, 1 digit, 2 symbol, 3 beyond ASCII, 4 white space, 5 lower case
for _kind, _bytes in ((0, range(65, 91)), (1, range(48, 58)), (3, range(128, 256)), (4, SPACE.encode()), (5, range(97, 123))):
    _KIND[list(_bytes)] = _kind


#: Symbols become #, white space a space.
_MARKS = bytes(35 if k == 2 else 32 if k == 4 else i for i, k in enumerate(_KIND))
_WINDOW = 16


def structure(text: bytes, tokens: list[bytes], counts: Counter) -> tuple[list[float], list[float]]:
    """(SHARES, AMOUNTS) of a whole text; all 0 without words. A window is what follows the start of a word, _WINDOW bytes."""
    if not tokens:
        return [0.0] * len(SHARES), [0.0] * len(AMOUNTS)
    data = np.frombuffer(text + bytes(_WINDOW), np.uint8)
    kinds = np.bincount(_KIND, weights=np.bincount(data[: len(text)], minlength=256), minlength=6) / len(text)
    n = len(tokens)
    marked = (text + b" ").translate(_MARKS)
    starts = np.flatnonzero(np.frombuffer(marked, np.uint8)[:-1] == 32)
    windows = np.concatenate([data[:_WINDOW][None], data[starts[:, None] + np.arange(1, _WINDOW + 1)]]).view(np.uint64)
    lines = text.split(b"\n")
    different = len(np.unique(windows[:, 0] * np.uint64(0x9E3779B97F4A7C15) + windows[:, 1])) / len(windows)
    shares = [kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], marked.count(b"# ") / n, len(counts) / n, max(counts.values()) / n, different, len(set(lines)) / len(lines), sum(map(eq, tokens, tokens[1:])) / n]
    return shares, [float(len(text)), float(n), (1 - kinds[4]) * len(text) / n, n / len(lines)]


def features(text: bytes | None, metadata: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text's features: words by crc32, log-counts of length 1 together; a 1 in the bin of each structure
    statistic; a 1 for each piece of metadata. Sorted by index, one value an index."""
    text = text or b""
    tokens = text.lower().split()
    counts = Counter(tokens)
    at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORDS
    sums = np.bincount(at, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=WORDS)
    index = np.flatnonzero(sums)
    values = np.log1p(sums[index])
    values /= math.sqrt((values**2).sum()) or 1.0
    shares, amounts = structure(text, tokens, counts)
    more = [WORDS + i * (len(EDGES) + 1) + int(k) for i, k in enumerate(np.searchsorted(EDGES, shares, "right"))]
    start = WORDS + len(SHARES) * (len(EDGES) + 1)
    more += [start + i * _LONGEST + min(_LONGEST - 1, int(2 * math.log2(1 + x))) for i, x in enumerate(amounts)]
    start += len(AMOUNTS) * _LONGEST
    more += sorted({start + zlib.crc32(m.encode()) % METADATA for m in metadata})
    return np.concatenate([index, np.array(more, np.int64)]), np.concatenate([values, np.ones(len(more))])


@dataclass(frozen=True)
class Model:
    """w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j, as log-odds of label 1."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, RANK)))

    def odds(self, index: np.ndarray, x: np.ndarray) -> float:
        """Linear in the number of features: a pair's sum is half of (sum of v x) squared less the sum of (v x) squared."""
        vx = self.factors[index] * x[:, None]
        s = vx.sum(0)
        return self.bias + float(self.weights[index] @ x) + 0.5 * float(s @ s - (vx * vx).sum())

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.odds(index, x)))))


def start(share: float) -> Model:
    """The model before any pass: the share of label 1 as bias, small factors from a rule."""
    factors = np.random.default_rng(12).normal(0, 0.05, (SIZE, RANK))
    return Model(math.log(share / (1 - share)), np.zeros(SIZE), factors)


def passes(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int) -> Model:
    """AdaGrad on the logistic loss, one row at a time, in an order drawn anew each epoch."""
    bias, w, v = model.bias, model.weights.copy(), model.factors.copy()
    g0, gw, gv = 1e-2, np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            index, x, y = rows[i]
            vi = v[index]
            vx = vi * x[:, None]
            s = vx.sum(0)
            odds = bias + float(w[index] @ x) + 0.5 * float(s @ s - (vx * vx).sum())
            slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) - y
            dw = slope * x + DECAY * w[index]
            dv = slope * x[:, None] * (s - vx) + DECAY * vi
            g0 += slope * slope
            gw[index] += dw * dw
            gv[index] += dv * dv
            bias -= STEP * slope / math.sqrt(g0)
            w[index] -= STEP * dw / np.sqrt(gw[index])
            v[index] -= STEP * 0.3 * dv / np.sqrt(gv[index])
    return Model(bias, w, v)


def _metadata(docs: DataFrame, columns: tuple[str, ...]) -> list:
    """Each column's name and value; whole numbers by their power of two."""
    out = []
    for c in columns:
        value = F.col(f"`{c}`")
        if docs.schema[c].dataType.typeName() in ("long", "integer", "short", "byte"):
            value = F.when(value > 0, F.floor(F.log2(value.cast("double")))).otherwise(F.lit(-1))
        out.append(F.concat(F.lit(f"{c}="), F.coalesce(value.cast("string"), F.lit("null"))))
    return out


def _sample(docs: DataFrame, labels: DataFrame, fit_docs: int) -> DataFrame:
    """The labelled documents to fit on with their label, one of each group of equal texts and labels, with a shard."""
    q = fresh("__", docs.columns)
    chosen = (
        labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias(f"{q}of")).agg(F.max("quality").cast("int").alias(f"{q}y"))
        .orderBy(F.xxhash64(f"{q}of"), f"{q}of").limit(fit_docs)
    )
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col(f"{q}of"))
    key = F.xxhash64(F.col("text").cast("string"))
    return rows.select(F.col("text").cast("string").alias("text"), F.array(F.lit("")).alias("none"), F.col(f"{q}y").alias("y"), key.alias("key"), *(m.alias(f"m{i}") for i, m in enumerate(_metadata(docs, _present(docs)))))


#: Columns of docs that are metadata, where they are there: what describes the row and isn't forbidden as an input.
METADATA_COLUMNS = ("n_chars",)


def _present(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in METADATA_COLUMNS if c in docs.columns)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """The model of the labelled rows given (doc_id, quality); of docs, text and METADATA_COLUMNS are looked at.

    fit_docs bounds the sample. Its features are written once; each round, every shard makes EPOCHS passes from the
    common model and the shards' models are averaged, weighted by rows. The driver holds one model a shard,
    SIZE * (RANK + 1) numbers each. Without labels, or with one kind only, every score is the smoothed share of label 1.
    """
    sample = _sample(docs, labels, fit_docs)
    kinds = [c for c in sample.columns if c.startswith("m")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, more = binary_column(batch, "text"), [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in kinds]
            found = [features(t, list(m)) for t, m in zip(texts, zip(*more, strict=True) if more else [()] * len(texts), strict=True)]
            index, x = (pa.array([f[i].astype(k) for f in found], pa.list_(a)) for i, k, a in ((0, np.int32, pa.int32()), (1, np.float32, pa.float32())))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("y")), index, x], ["key", "y", "index", "x"])

    made = sample.drop("none").mapInArrow(trimmed(rows), "key bigint, y int, index array<int>, x array<float>")
    made = made.groupBy("key", "y").agg(F.min_by(F.struct("index", "x"), F.struct("index", "x")).alias("f"))
    made = written(made.select("key", "y", "f.*"), "features")
    ones, n = made.agg(F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)), F.count("*")).first()
    model = start((ones + 1) / (n + 2))
    if not 0 < ones < n:
        return Model(model.bias)
    sharded = made.withColumn("shard", F.pmod(F.xxhash64("key", "y"), F.lit(math.ceil(n / SHARD_DOCS))).cast("int"))
    for round_ in range(ROUNDS):
        shared = made.sparkSession.sparkContext.broadcast(model)

        parts = sharded.groupBy("shard").applyInArrow(_shard_passes(shared, round_), "n bigint, bias double, weights binary, factors binary").orderBy("n", "bias").collect()
        total = sum(p["n"] for p in parts)
        mean = lambda f: sum(f(p) * (p["n"] / total) for p in parts)
        model = Model(
            mean(lambda p: p["bias"]), mean(lambda p: np.frombuffer(p["weights"], np.float32).astype(np.float64)),
            mean(lambda p: np.frombuffer(p["factors"], np.float32).astype(np.float64).reshape(SIZE, RANK)),
        )
        shared.unpersist()
    return model


def _shard_passes(shared, round_: int):
    """For applyInArrow: EPOCHS passes over a shard's rows, always in the same order, from the common model."""

    def run(table):
        table = table.sort_by([("key", "ascending"), ("y", "ascending")])
        rows = list(zip(_arrays(table, "index", np.int64), _arrays(table, "x", np.float64), table.column("y").to_pylist(), strict=True))
        found = passes(shared.value, rows, EPOCHS, 100 * round_ + table.column("shard")[0].as_py())
        return pa.table({"n": [len(rows)], "bias": [found.bias], "weights": [found.weights.astype(np.float32).tobytes()], "factors": [found.factors.astype(np.float32).tobytes()]})

    return run


def _arrays(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    return np.split(column.flatten().to_numpy().astype(kind), np.cumsum(column.value_lengths().to_numpy())[:-1])


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of docs, without a shuffle.

    The score is the chance of label 1 by the model, from whole texts. Null and empty texts have no words, and the score
    that the model gives to that. Repeated rows stay; columns other than doc_id, text and METADATA_COLUMNS are ignored.
    The model has SIZE * (RANK + 1) numbers and is sent to each executor once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    metadata = _metadata(docs, _present(docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            more = [c.to_pylist() for c in batch.columns[2:]]
            texts = binary_column(batch, "text")
            scores = [model.score(*features(t, list(m))) for t, m in zip(texts, zip(*more, strict=True) if more else [()] * len(texts), strict=True)]
            marks = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), marks], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), *(m.alias(f"m{i}") for i, m in enumerate(metadata)))
    return rows.mapInArrow(trimmed(score), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: 5 divides crc32 of the id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
