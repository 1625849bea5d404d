"""Containment joins by an anchor: which texts contain which parts, as an equi join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import materialized

#: Lengths of anchors. A part is anchored by a piece of the greatest of these that it is long enough for.
SIZES = (6, 3, 1)


#: Rows of pieces that a task sends at once.
SEND_ROWS = 50_000


#: Pieces that are sent to every task, which then lets no others out; of more, all pieces meet them by a shuffle.
BROADCAST_PIECES = 200_000


def _exploded(texts: DataFrame, text: str, sizes: list[int], wanted: DataFrame) -> DataFrame:
    """(__h, piece) of each different piece of each text that is in wanted, by the text's hash: texts themselves aren't repeated.
    wanted has pieces of the given sizes, each once.

    Arrow, as a substring by place begins at the text's start each time in the engine; here a text is cut in linear time.
    """

    few = wanted.limit(BROADCAST_PIECES + 1).toArrow().column(0).to_pylist()
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(few)) if len(few) <= BROADCAST_PIECES else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        for batch in batches:
            hashes, pieces = [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if known is None:
                    found = {t[i : i + n] for n in sizes for i in range(len(t) - n + 1)}
                else:
                    found = {p for n in sizes for i in range(len(t) - n + 1) if (p := t[i : i + n]) in known}
                pieces += found
                hashes += [h] * len(found)
                if len(pieces) >= SEND_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(pieces, pa.string())], ["__h", "piece"])
                    hashes, pieces = [], []
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(pieces, pa.string())], ["__h", "piece"])

    rows = texts.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("__h"), F.col(text).cast("string").alias("t"))
    found = rows.mapInArrow(run, "__h bigint, piece string")
    return found if shared is not None else found.join(wanted, "piece", "left_semi")


def anchors(parts: DataFrame, part: str, texts: DataFrame, text: str) -> DataFrame:
    """(part, piece): for each different part its piece that fewest texts have, of those the least; empty and null parts have none.

    A text that contains the part contains the piece. Pieces that no text has leave their part out: nothing contains it.
    """
    different = parts.select(F.col(part).alias("part")).where(F.length("part") > 0).distinct()
    size = F.lit(SIZES[-1])
    for s in reversed(SIZES[:-1]):
        size = F.when(F.length("part") >= s, s).otherwise(size)
    own = different.withColumn("size", size).withColumn("piece", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("part") - F.col("size") + 1), lambda i: F.substr("part", i, F.col("size"))))))
    own = materialized(own, "pieces")
    sizes = [r["size"] for r in own.select("size").distinct().collect()]
    if not sizes:
        return different.select("part", F.lit(None).cast("string").alias("piece")).limit(0)
    wanted = own.select("piece").distinct()
    counted = _exploded(texts, text, sizes, wanted).groupBy("piece").agg(F.count("*").alias("n"))
    # every piece of the part must be in some text, else no text contains the part
    found = own.join(counted, "piece", "left").groupBy("part").agg(F.min(F.struct("n", "piece")).alias("a"), F.min(F.col("n").isNotNull()).alias("all"))
    return found.where("all").select("part", "a.piece")


def containment_join(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """All pairs of rows with part inside text, as plain substrings, with the columns of both (which must differ).

    Texts and parts meet on the part's anchor, an equal key, and are verified after; the rarest piece of a part is the anchor, so
    what many texts share brings few rows together. Pieces travel with their text's hash, whole texts only to the join with it. Null texts, null
    parts and empty parts give no pair; repeated rows give repeated pairs.
    """
    chosen = materialized(anchors(parts, part, texts, text), "anchors")
    sizes = [r["n"] for r in chosen.select(F.length("piece").alias("n")).distinct().collect()]
    if not sizes:
        return texts.join(parts, F.lit(False))
    spread = _exploded(texts, text, sizes, chosen.select("piece").distinct()).join(chosen, "piece").select("__h", F.col("part").alias("__part")).distinct()
    found = texts.withColumn("__h", F.xxhash64(text)).join(spread, "__h").where(F.contains(text, "__part")).drop("__h")
    return found.join(parts, F.col("__part") == F.col(part)).drop("__part")
