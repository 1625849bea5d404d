"""Toxicity by maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
import re
import statistics
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import trimmed

#: The most labelled documents that the classifier is fitted on: those with the least hash of their id.
FIT_DOCS = 20_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: A token counts as a sign of toxicity from these: documents it occurs in, log-odds, and their z-score.
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 5, 2.5, 3.5
#: Dirichlet prior of a token: FLOOR and MASS times its share of all tokens.
FLOOR, MASS = 0.5, 1000.0
CACHE_WORDS = 150_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Calibration:
    """Extreme values of clean and of toxic texts: ln K, location and scale, and the log of how many there are of each.

    The greatest segment scores of clean texts follow Gumbel's P(below x) = exp(-K e^-x), with lambda 1 as scores are
    natural log-odds. Those of toxic texts grow with the passage and so have Frechet's heavy tail: their
    logarithms follow Gumbel's distribution of a place and width of their own.
    """

    ln_k: float = 0.0
    location: float = 0.0
    scale: float = 1.0
    prior: float = -math.inf

    def score(self, x: float) -> float:
        """The chance that a text with evidence x is toxic; 0 where there is no more evidence than chance gives."""
        if x <= 0 or self.prior == -math.inf:
            return 0.0
        clean, z = x - self.ln_k, (math.log(x) - self.location) / self.scale
        odds = self.prior - z - math.exp(min(50.0, -z)) - math.log(self.scale * x) + clean + math.exp(-clean)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


@dataclass(frozen=True)
class Model:
    """Log-odds of words and word beginnings, of any other token (neutral), and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    neutral: float = -0.01
    calibration: Calibration = Calibration()


class Weights(dict):
    """The weight of a word: its own, else that of its longest known beginning, else None."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float | None:
        found = self.model.words.get(word)
        for n in () if found is not None else reversed(PREFIXES):
            if len(word) > n and (found := self.model.prefixes.get(word[:n])) is not None:
                break
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def segments(hits: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, word after the last, score) of a text, in linear time.

    hits are the words with a weight of their own, by place; those between weigh `neutral` each. Kept
    candidates carry the total before and after them; a new one merges with the nearest that starts lower and
    ends no higher, as often as there is such a one. Each candidate names the nearest before it that starts lower.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, after, total before, total after, nearest that starts lower
    total, place = 0.0, 0
    for at, weight in hits:
        total += neutral * (at - place)
        place = at + 1
        before, total = total, total + weight
        if weight <= 0:
            continue
        first, j = at, len(kept) - 1
        while True:
            # what lies between a candidate and the one it names starts no lower than it does: none is passed twice
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, at + 1, before, total, j))
                break
            first, _, before, _, lower = kept[j]
            del kept[j:]
            j = lower
    return [(a, b, end - start) for a, b, start, end, _ in kept]


def evidence(found: list[tuple[int, int, float]], n_words: int) -> float:
    """Sum over segments of score less ln(words): what is over the extreme value expected by chance; -inf without any.

    Scores are natural log-odds, so lambda is 1. The best segment counts in any case, others where they are
    significant alone.
    """
    if not found or not n_words:
        return -math.inf
    over = sorted((s - math.log(n_words) for _, _, s in found), reverse=True)
    return over[0] + sum(x for x in over[1:] if x > 0)


def _sample(docs: DataFrame, labels: DataFrame, fit_docs: int) -> DataFrame:
    """(text, toxic) of the labelled documents to fit on, one of each group of like texts.

    Like texts are those with the same least hash of word triples: copies, and most near copies, so that one
    text logged very often doesn't count as very many signs.
    """
    chosen = (
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    words = F.split("text", r"\s+")
    triples = F.expr("transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], get(w, i + 1), get(w, i + 2)))")
    keyed = rows.withColumn("w", words).withColumn("key", F.array_min(triples)).drop("w")
    return keyed.groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """The model of the labelled rows given (doc_id, toxic); nothing but text and toxic is looked at.

    Word counts are combined over the cluster. What reaches the driver is bounded by fit_docs: signs that
    occur in LEAST_DOCS documents at least, and one number for each document of the sample. Without labels,
    or with one kind of label only, the model knows no sign and all scores are 0.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            tokens: tuple[Counter, Counter] = (Counter(), Counter())
            in_docs: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                tokens[toxic > 0].update(words)
                if toxic > 0:
                    in_docs.update(set(words))
            names = list(tokens[0].keys() | tokens[1].keys())
            columns = [pa.array(names, pa.string())] + [pa.array([c[w] for w in names], pa.int64()) for c in (tokens[1], tokens[0], in_docs)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "y1", "y0", "d1"])

    sample = _sample(docs, labels, fit_docs).persist()
    try:
        table = sample.mapInArrow(trimmed(counts), "word string, y1 bigint, y0 bigint, d1 bigint").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("y1", "y0", "d1")))
        table = table.persist()
        n1, n0 = (x or 0 for x in table.agg(F.sum("y1"), F.sum("y0")).first())
        if not n1 or not n0:
            return Model()
        cut = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.substring("word", 1, n).alias("p")) for n in PREFIXES)))
        nested = (
            table.where(F.length("word") > PREFIXES[0]).select("*", cut.alias("c")).where("length(word) > c.n").groupBy(F.col("c.p").alias("word"))
            .agg(F.sum("y1").alias("s1"), F.sum("y0").alias("y0"), F.max("y1").alias("m1"), F.sum("d1").alias("sd"), F.max("d1").alias("md"))
            # what the most frequent single word doesn't explain already
            .select("word", (F.col("s1") - F.col("m1")).alias("y1"), "y0", (F.col("sd") - F.col("md")).alias("d1"))
        )
        signs = [_signs(t, n1, n0).collect() for t in (table, nested)]
        words, prefixes = ({r["word"]: r["odds"] for r in s} for s in signs)
        shortest = [r for r in signs[1] if not any(r["word"][:n] in prefixes for n in PREFIXES if n < len(r["word"]))]
        covered = [r for r in signs[0] if not any(r["word"][:n] in prefixes for n in PREFIXES)]
        p1 = min(0.5, sum(r["y1"] for r in shortest + covered) / n1)
        p0 = min(0.5, sum(r["y0"] for r in shortest + covered) / n0)
        model = Model(words, prefixes, min(-1e-3, math.log((1 - p1) / (1 - p0))))
        # persisted rows may be lost with an executor: they are computed again from the tables
        seen = [(r["x"], r["toxic"] > 0) for r in _evidence(sample, model).collect()]
        return Model(words, prefixes, model.neutral, calibrate(seen))
    finally:
        sample.unpersist()


def _signs(table: DataFrame, n1: int, n0: int) -> DataFrame:
    a = F.lit(FLOOR) + F.lit(MASS / (n1 + n0)) * (F.col("y1") + F.col("y0"))
    total = FLOOR + MASS
    odds = F.log((F.col("y1") + a) / (F.lit(n1 + total) - F.col("y1") - a)) - F.log((F.col("y0") + a) / (F.lit(n0 + total) - F.col("y0") - a))
    z = F.col("odds") / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    return table.where(F.col("d1") >= LEAST_DOCS).withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (z >= LEAST_Z))


def _evidence(sample: DataFrame, model: Model) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for batch in batches:
            x = [evidence(*_scan(t, weights, model.neutral)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    return sample.mapInArrow(trimmed(scan), "x double, toxic int")


def _scan(text: str, weights: Weights, neutral: float) -> tuple[list[tuple[int, int, float]], int]:
    words = words_of(text)
    hits = [(i, w) for i, w in enumerate(map(weights.__getitem__, words)) if w is not None]
    return segments(hits, neutral), len(words)


def calibrate(seen: list[tuple[float, bool]]) -> Calibration:
    """Maximum likelihood of K from the clean texts' extreme values, and of location and scale from the toxic texts'.

    Texts without any segment have no extreme value; how many have one goes into the prior odds. One clean text
    at 0 is added, which stands for those not seen.
    """
    clean, toxic = [x for x, y in seen if not y and x > -math.inf], [math.log(x) for x, y in seen if y and x > 0]
    if not toxic:
        return Calibration()
    ln_k = min(0.0, math.log((len(clean) + 1) / (1.0 + sum(math.exp(min(50.0, -x)) for x in clean))))
    mean, least, narrow = sum(toxic) / len(toxic), min(toxic), 0.2
    scale = max(narrow, statistics.pstdev(toxic) * math.sqrt(6) / math.pi)
    for _ in range(100):  # the likelihood's fixed point for the scale
        w = [math.exp((least - x) / scale) for x in toxic]
        after = max(narrow, mean - sum(a * x for a, x in zip(w, toxic, strict=True)) / sum(w))
        done, scale = abs(after - scale) < 1e-9, (after + scale) / 2
        if done:
            break
    location = least - scale * math.log(sum(math.exp((least - x) / scale) for x in toxic) / len(toxic))
    return Calibration(ln_k, location, scale, math.log(len(toxic) / (len(clean) + 1)))


def toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted, passages (first word, word after the last, score) of every row, without a shuffle.

    Passages are the segments whose score is over ln(words) of their text. Null and empty texts score 0.
    Repeated rows stay. The model is a few thousand signs at most (see fit) and travels with the task.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for t in batch.column(1):
                found, n = _scan(t.as_py() or "", weights, model.neutral)
                scores.append(model.calibration.score(evidence(found, n)))
                passages.append([{"first": a, "after": b, "score": s} for a, b, s in found if s > math.log(n)])
            marks = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), marks, pa.array(passages, kind)], ["doc_id", "score", "predicted", "passages"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(score), f"doc_id {kind}, score double, predicted int, passages array<struct<first: bigint, after: bigint, score: double>>")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, all columns as they are; no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            scores = (model.calibration.score(evidence(*_scan(t.as_py() or "", weights, model.neutral))) for t in texts)
            yield batch.filter(pa.array([s < THRESHOLD for s in scores], pa.bool_()))

    return docs.mapInArrow(trimmed(keep), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
