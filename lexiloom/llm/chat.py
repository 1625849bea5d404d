"""Chat formatting: cumulative snapshots of a conversation collapse to the longest before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import written

#: Keys of turns with equal numbers that are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Turns of one conversation that a window task handles together; longer conversations are several blocks.
BLOCK = 256


def _lanes(ordinal: Column) -> dict[str, Column]:
    """Four 31-bit hashes of a turn at its place; their running sums are the prefix hash and cannot overflow."""
    a, b = F.xxhash64(ordinal, "c0", "c1"), F.xxhash64(F.lit(29), "c1", ordinal, "c0")
    low, high = F.lit(0x7FFFFFFF), 33
    return {"h0": a.bitwiseAND(low), "h1": F.shiftrightunsigned(a, high), "h2": b.bitwiseAND(low), "h3": F.shiftrightunsigned(b, high)}


def hashed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, c0, c1 (hashes of role and text), block and place, the order of turns with equal numbers, written once.

    Turns are reduced to hashes before anything is shuffled. A window of the block finds turns whose number the one
    before has too; of these numbers alone, which a well-formed log hasn't, roles and texts are looked at again, and
    place is what chat_format renders them by: role, then text. Rows that are equal in all have one place.
    """
    content = [F.xxhash64("role", "text", F.isnull("role"), F.isnull("text")).alias("c0"), F.xxhash64(F.lit(7), "text", "role", F.isnull("text"), F.isnull("role")).alias("c1")]
    t = turns.select("conv_id", "turn", *content).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first())
    t = written(t.withColumn("tied", (F.row_number().over(inside) > 1) & F.lag("turn").over(inside).eqNullSafe(F.col("turn"))), "turns")
    tied = t.where("tied").select("conv_id", "turn").distinct()
    t = t.drop("tied")
    few = tied.limit(BROADCAST_KEYS + 1).count()
    if not few:
        return t.withColumn("place", F.lit(0))
    send = lambda d: F.broadcast(d) if few <= BROADCAST_KEYS else d.hint("merge")
    same = lambda d: F.col("x.conv_id").eqNullSafe(F.col(f"{d}.conv_id")) & F.col("x.turn").eqNullSafe(F.col(f"{d}.turn"))
    again = turns.select("conv_id", "turn", "role", "text", *content).alias("x").join(send(tied.alias("k")), same("k"), "left_semi")
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    places = again.withColumn("place", F.rank().over(order)).groupBy("conv_id", "turn", "c0", "c1").agg(F.min("place").alias("place"))
    known = places.select("conv_id", "turn", "c0", "c1", "place").alias("p")
    both = t.alias("x").join(known, same("p") & (F.col("x.c0") == F.col("p.c0")) & (F.col("x.c1") == F.col("p.c1")), "left")
    return both.select("x.conv_id", "x.turn", "x.c0", "x.c1", "x.block", F.coalesce("p.place", F.lit(0)).alias("place"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, ordinal (1, 2, ... in each conversation) and h0..h3, the hash of all turns up to it, for turns (conv_id, turn, role, text).

    Order is by turn, role and text, as it is rendered. A conversation is cut into blocks of turn numbers: sums inside
    blocks and sums over block totals are two windows, so a conversation with very many turns is spread over tasks.
    """
    t = hashed_turns(turns)
    order = [F.col("turn").asc_nulls_first(), F.col("place")]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    counts = t.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    starts = counts.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    t = _with(t, starts)
    t = t.withColumn("ordinal", F.col("base") + F.row_number().over(inside)).drop("base")
    t = t.select("conv_id", "block", "ordinal", *(c.alias(h) for h, c in _lanes(F.col("ordinal")).items()))
    lanes = ["h0", "h1", "h2", "h3"]
    totals = t.groupBy("conv_id", "block").agg(*(F.sum(h).alias(h) for h in lanes))
    offsets = totals.select("conv_id", "block", *(F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"b_{h}") for h in lanes))
    running = Window.partitionBy("conv_id", "block").orderBy("ordinal")
    t = _with(t.withColumns({h: F.sum(h).over(running) for h in lanes}), offsets)
    return t.withColumns({h: F.col(h) + F.col(f"b_{h}") for h in lanes}).drop(*(f"b_{h}" for h in lanes))


def _with(t: DataFrame, blocks: DataFrame) -> DataFrame:
    return t.join(blocks, ["conv_id", "block"])


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with; of equal ones the least conv_id.

    A conversation's own hash is that of its last turn. It goes if another conversation has the same hash at
    the same ordinal and goes on. Hashes are first reduced to one row each, so neither a first turn nor a
    conversation that very many share is paired with its sharers. Rows without a conv_id are left out.
    """
    hashed = prefix_hashes(turns.where("conv_id is not null"))
    key = ["ordinal", "h0", "h1", "h2", "h3"]
    last = hashed.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end")).select("conv_id", "end.*")
    lengths = last.select("conv_id", F.col("ordinal").alias("n_turns"))
    inner = hashed.join(lengths, "conv_id").where("ordinal < n_turns").select(*key).distinct()
    whole = last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("ordinal").alias("n_turns"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text of each maximal conversation: its turns in order, each as a role line and its text.

    Null roles and texts are rendered as empty; turns with equal numbers are rendered in order of role and text;
    repeated turns stay. An empty table gives no rows, columns other than the four are ignored. A conversation is gathered only to be
    rendered: what a task holds is the row that is asked for, however long its texts are.
    """
    kept = maximal(turns)
    t = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id")
    part = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    grouped = t.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("conv_id", "n_turns", F.array_join(F.transform("parts", lambda p: render(p["role"], p["text"])), "").alias("text"))
