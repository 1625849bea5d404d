"""Product codes of vectors: codebooks by rounds of assignment, the nearest entry found by annular norm pruning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import trimmed, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: A component's integer stays within this (what floats hold exactly); larger ones are cut to it.
LARGEST = 1 << 53
#: Vectors of a batch that a task works on at once, and entries evaluated on either side of a norm at a time.
BLOCK, RING = 2048, 8
#: Up to so many labels have their sums sent to every task; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Sums are kept as two numbers, x >> SHIFT and the rest, so that they are exact over any number of rows.
SHIFT = 27
#: Squared distances up to this are added up as longs, larger ones as Python's integers.
_SAFE = 1 << 62


@dataclass(frozen=True)
class Annuli:
    """The entries of one part's codebook by norm; nearest() is exact.

    For a vector of norm r and an entry of norm s the distance is |r - s| at least, so with d the best distance so far, only
    entries in the annulus r - d <= s <= r + d, both ends included, can be as near. The search starts at the norms next to r and
    goes outwards; as d shrinks, so does the interval that a binary search gives.
    """

    entries: np.ndarray  # in the codebook's order
    order: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Annuli:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        order = np.argsort(norms, kind="stable")
        return Annuli(entries, order, norms[order])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, ties to the lower index. Distances are exact integers."""
        furthest = int(abs(x).max(initial=0)) + int(abs(self.entries).max(initial=0))
        exact = np.int64 if furthest**2 * max(1, x.shape[1]) < _SAFE else object
        rows, book = x.astype(exact), self.entries[self.order].astype(exact)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        n, k = len(x), len(book)
        best, which = np.zeros(n, exact), np.full(n, -1)
        right = np.searchsorted(self.norms, norm)
        left = right - 1  # what lies from left + 1 to right - 1 is evaluated
        low, high = np.zeros(n, np.int64), np.full(n, k - 1)
        active = np.arange(n)
        while len(active):
            for inner in (True, False):  # the next RING entries on either side that the annulus still holds
                at = active
                first = left[at] - RING + 1 if inner else right[at]
                start = np.maximum(first, low[at])
                stop = np.minimum(left[at] + 1 if inner else right[at] + RING, high[at] + 1)
                lens = np.maximum(stop - start, 0)
                if lens.any():
                    owner = np.repeat(at, lens)
                    place = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(start, lens)
                    away = rows[owner] - book[place]
                    self._take(best, which, owner, self.order[place], (away * away).sum(1))
                if inner:
                    left[at] -= RING
                else:
                    right[at] += RING
            found = active[which[active] >= 0]
            d = np.sqrt(best[found].astype(np.float64))
            room = 1e-9 * (norm[found] + d) + 1e-9  # norms are rounded; the annulus is never too narrow
            low[found] = np.searchsorted(self.norms, norm[found] - d - room, "left")
            high[found] = np.searchsorted(self.norms, norm[found] + d + room, "right") - 1
            active = active[(left[active] >= low[active]) | (right[active] <= high[active])]
        return which, best

    @staticmethod
    def _take(best: np.ndarray, which: np.ndarray, owner: np.ndarray, index: np.ndarray, d: np.ndarray) -> None:
        order = np.lexsort((index, d, owner)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (owner[i], d[i], index[i])))
        first = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))]
        who, near, at = owner[first], d[first], index[first]
        better = (which[who] < 0) | (near < best[who]) | ((near == best[who]) & (at < which[who]))
        best[who[better]], which[who[better]] = near[better], at[better]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows whose vector is neither null nor holds a null, NaN or infinite component; x are doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.select("vec_id", "label", x.alias("x"), fine.alias("fine")).where("x is not null and fine").drop("fine")


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x), one row a vector; shorter vectors end in zeros."""
    out = np.zeros((len(column), width))
    lens = np.diff(column.offsets.to_numpy())
    out[np.repeat(np.arange(len(column)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = column.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(out * SCALE), -LARGEST, LARGEST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK))


def _list_of(batch: pa.RecordBatch) -> pa.Array:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.cast(pa.list_(pa.float64())) if not pa.types.is_list(column.type) else column


def fit_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of kept_vectors: each starts with the entries smallest vec_ids (nulls last, ties by vector),
    or as many as there are; each round moves every entry to floor(sum / count) of the parts nearest to it, if any.

    Every task adds up all of its vectors and sends one row an entry and position; the driver holds the codebooks,
    entries * dimension numbers, whatever the number of vectors. The dimension is that of the longest vector, rounded
    up to a multiple of parts (one number a part at least); shorter vectors count as filled up with zeros.
    """
    spark = kept.sparkSession
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    start = _integers(first.column("x").combine_chunks().cast(pa.list_(pa.float64())), width * parts) if first.num_rows else np.zeros((0, width * parts), np.int64)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    if not len(start):
        return books
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            annuli = [Annuli.of(b) for b in books]
            count = np.zeros(books.shape[:2], np.int64)
            high, low = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64)
            for batch in _blocks(batches):
                x = _integers(_list_of(batch), width * parts).reshape(-1, parts, width)
                for p in range(parts):
                    at, _ = annuli[p].nearest(x[:, p])
                    np.add.at(count[p], at, 1)
                    np.add.at(high[p], at, x[:, p] >> SHIFT)
                    np.add.at(low[p], at, x[:, p] & ((1 << SHIFT) - 1))
            p, e = np.nonzero(count)
            columns = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(count[p, e], width), high[p, e].ravel(), low[p, e].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "at", "k", "high", "low"])

        found = kept.select("x").mapInArrow(trimmed(sums), "part bigint, entry bigint, at bigint, k bigint, high bigint, low bigint")
        for r in found.groupBy("part", "entry", "at").agg(*(F.sum(c).alias(c) for c in ("k", "high", "low"))).collect():
            books[r["part"], r["entry"], r["at"]] = ((r["high"] << SHIFT) + r["low"]) // r["k"]
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256, in lower-case hex, of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each of kept_vectors: two hex digits a part, and the squared distances' sum (cut to a long)."""
    parts, n, width = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli.of(b) for b in shared.value] if n else []
        for batch in _blocks(batches):
            x = _integers(_list_of(batch), width * parts).reshape(-1, parts, width)
            found = [a.nearest(x[:, p]) for p, a in enumerate(annuli)]
            code = ["".join(f"{i:02x}" for i in row) for row in zip(*(at for at, _ in found), strict=True)]
            error = [min(int(sum(row)), (1 << 63) - 1) for row in zip(*(d.tolist() for _, d in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return kept.mapInArrow(trimmed(codes), f"{kinds}, code string, error bigint")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with the column approx: the vector that a code stands for, in the vectors' own scale."""
    part = lambda p: F.get(F.array(*(F.array(*(F.lit(int(v)) for v in e)) for e in books[p])), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int"))
    return codes.withColumn("approx", F.transform(F.concat(*map(part, range(len(books)))), lambda v: v / F.lit(float(SCALE))))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks) of vectors (vec_id, embedding, label).

    Rows whose vector is null or holds a null or non-finite component are left out; others each have a row, repeated ones
    too, whatever their vec_id. An empty vector counts as zeros. label_error is error summed over equal labels, nulls together.
    entries is 256 at most, as a code has two digits a part. Other columns are ignored.
    """
    kept = kept_vectors(vectors)
    books = fit_codebooks(kept, parts, min(entries, 256), rounds)
    codes = written(encode(kept, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = written(codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums.hint("merge")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of"), books
