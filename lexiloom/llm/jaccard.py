"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, cut by size-derived bounds."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import binary_column, components, passing, trimmed, written

#: Documents, by least hash of their id, in which n-grams are looked for that many documents share.
SAMPLE_DOCS = 10_000
#: An n-gram in so many different sets of the sample gets a block of its own.
COMMON = 3
#: Blocks per set grow by this factor from level to level.
LEVEL = 1.5
#: Ids of documents to fetch that are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Documents whose signatures a task holds and combines at once.
SIGN_ROWS = 1000
#: Signature rows in one Arrow batch; the executor holds a batch outside its heap.
SEND_ROWS = 65_536
#: Rows of a table of keys that are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Up to so many documents outside a group's largest component are tried against all of the group.
FEW = 16
#: Up to so many documents that share an uncommon difference from their group are paired.
SMALL = 8
#: Up to so many documents that share an uncommon n-gram, of those that can be over the bound by it, are paired; more are divided.
MEET = 64
#: Sizes of sets of one class differ by this factor at most.
CLASS = 1.05
#: About so many documents of a group, by hash, say which n-grams its centre has.
CENTRE_DOCS = 15
#: Parts of the groups that are divided one after another, so that their working tables are that share of the whole; fewer where
#: a part would have less than so many rows.
PARTS, PART_ROWS = 4, 40_000
#: Of the number beside a signature, the bits for how many of its kind can be left out.
SPARE_BITS = 20
CACHE_WORDS = 150_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look independent."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@dataclass(frozen=True)
class Shingler:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; A-Z count as a-z. Fewer words are one shingle."""

    n: int

    def __call__(self, text: bytes | None, words: _Words) -> np.ndarray:
        tokens = text.lower().split() if text else []
        if not tokens:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
        width = min(self.n, len(h))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            total = mix(total * _M1 + h[i : len(h) - width + 1 + i])
        return np.unique(total)


def _levels(low: int, high: int) -> list[int]:
    """The numbers of blocks of the grid that serve bounds from low to high."""
    j = max(0, math.floor(math.log(low) / math.log(LEVEL)) - 1)
    out: list[int] = []
    while not out or out[-1] < high:
        if (level := math.ceil(LEVEL**j)) >= low and level not in out:
            out.append(level)
        j += 1
    return out


@dataclass(frozen=True)
class Blocks:
    """Signatures of a set, of which any two sets with Jaccard num/den or more share one.

    Sets of sizes a and b over the bound differ in at most (a + b)(den - num)/(den + num) n-grams. With more
    blocks of n-grams than that, one block at least is alike in both; its content is the signature. slack
    more blocks than needed stand against empty ones. The number of blocks comes from a grid, and a set signs
    on each level that a partner of possible size can need. Common n-grams have a block of their own that
    signs nothing, else every two documents with the same boilerplate would meet. Sets with so few other
    n-grams that all alike blocks could be empty sign once more with all n-grams; so, by the same bound, does any partner.

    More than one block is alike: all but those that can differ and those that are empty. So if of the signatures of one
    level a set leaves out one less than that, the most frequent ones in whatever order is the same for all, its partners over
    the bound still meet it in the rarest that they share.
    """

    num: int
    den: int

    def bound(self, a: int, b: int) -> int:
        """The most n-grams that are in one only of two sets of these sizes over the bound."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def __call__(self, grams: np.ndarray, common: np.ndarray) -> np.ndarray:
        return self.signed(grams, common)[0]

    def signed(self, grams: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures, and of each its level and kind with how many of that level and kind can be left out: kind << SPARE_BITS | spare."""
        n = len(grams)
        low, high = self.bound(n, n * self.num // self.den), self.bound(n, n * self.den // self.num)
        if not n or high < 1:  # only equal sets
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        rare = grams
        if len(common):
            at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
            rare = grams[common[at] != grams]
        out, spare = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

        def add(signs: np.ndarray, level: int, kind: int, alike: int) -> None:
            out.append(signs)
            spare.append(np.full(len(signs), (level * 4 + kind) << SPARE_BITS | max(0, alike - 1), np.int64))

        for level in _levels(low + 1, high + 1):
            blocks = level + self.slack(level)
            alike = blocks - min(high, level - 1)
            signs, empty = self._sign(rare, level, blocks, 0)
            add(signs, level, 0, alike - empty)
            if empty >= alike:
                signs, still = self._sign(grams, level, blocks, 1)
                add(signs, level, 1, alike - still)
                if still >= alike:
                    add(self._empty(grams, level, blocks), level, 2, 0)
        return np.concatenate(out), np.concatenate(spare)

    @staticmethod
    def slack(level: int) -> int:
        return 2 + level // 10

    @staticmethod
    def _place(grams: np.ndarray, blocks: int) -> np.ndarray:
        return ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)

    def _sign(self, grams: np.ndarray, level: int, blocks: int, kind: int) -> tuple[np.ndarray, int]:
        if not len(grams):
            return np.empty(0, np.uint64), blocks
        place = self._place(grams, blocks)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sums = np.add.reduceat(mix(grams ^ _M1), first)
        return mix(mix(sums) + place[first] * _M1 + np.uint64(level * 4 + kind)), blocks - len(first)

    def _empty(self, grams: np.ndarray, level: int, blocks: int) -> np.ndarray:
        full = np.zeros(blocks, bool)
        full[self._place(grams, blocks).astype(np.int64)] = True
        return mix(np.flatnonzero(~full).astype(np.uint64) * _M1 + np.uint64(level * 4 + 2))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def common_grams(docs: DataFrame, n: int, sample_docs: int = SAMPLE_DOCS, least: int = COMMON) -> np.ndarray:
    """N-grams in at least `least` different sets of a sample of sample_docs documents, sorted.

    This only decides which blocks sign; any answer gives the same links. Both the sample and so the answer are bounded.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    shingler = Shingler(n)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            seen: dict[bytes, np.ndarray] = {}
            for text in binary_column(batch, "text"):
                s = shingler(text, words)
                seen.setdefault(xxhash.xxh3_128_digest(s.tobytes()), s)
            found, k = np.unique(np.concatenate([np.empty(0, np.uint64), *seen.values()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(k.astype(np.int64))], ["gram", "k"])

    counted = _texts(docs).join(F.broadcast(ids), "doc_id").select("text").mapInArrow(trimmed(grams), "gram bigint, k bigint").groupBy("gram").agg(F.sum("k").alias("k"))
    found = counted.where(F.col("k") >= least).select("gram").toArrow().column("gram").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


_ROW = "pk bigint, sig bigint, sig2 bigint, doc bigint, leader bigint, n bigint, spare bigint"


def _signatures(docs: DataFrame, n: int, blocks: Blocks, common: np.ndarray) -> DataFrame:
    """Rows (pk, sig, sig2, doc, leader, n, spare): one with n for each document, and one for each of its signatures.

    Of the documents of a batch with the same signature, the first has no leader and goes by pk = sig; the
    others name it as their leader and need not be sent to where the signature's rows meet. An equal set
    (sig2 is then not 0) later in the batch signs nothing else. So copies are combined before the shuffle.
    spare is the number of Blocks.signed, doubled, and odd where the document leads others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    shingler = Shingler(n)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = _Words(), shared.value
        for batch in (b.slice(i, SIGN_ROWS) for b in batches for i in range(0, b.num_rows, SIGN_ROWS)):
            ids = batch.column(0).to_pylist()
            sizes, equal, first = [], [], {}
            sigs, spares, docs_of = [], [], []
            for doc, text in zip(ids, binary_column(batch, "text"), strict=True):
                grams = shingler(text, words)
                sizes.append(len(grams))
                if doc is None or not len(grams):
                    continue
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                leader = first.setdefault(digest, doc)
                equal.append((digest, doc, leader))
                if leader == doc:
                    s, spare = blocks.signed(grams, known)
                    sigs.append(s)
                    spares.append(spare)
                    docs_of.append(np.full(len(s), doc, np.int64))
            spread = mix(batch.column(0).fill_null(0).to_numpy().astype(np.int64).view(np.uint64)).view(np.int64)
            yield _rows(spread, None, None, ids, None, sizes, None)
            if equal:
                parts = np.frombuffer(b"".join(d for d, _, _ in equal), np.int64).reshape(-1, 2)
                who, lead = np.array([e[1] for e in equal], np.int64), np.array([e[2] for e in equal], np.int64)
                mine = who != lead
                yield _rows(np.where(mine, mix(who.view(np.uint64)).view(np.int64), parts[:, 0]), parts[:, 0], parts[:, 1] | 1, who, pa.array(lead, mask=~mine), None, None)
            if any(map(len, sigs)):
                sig, who = np.concatenate(sigs), np.concatenate(docs_of)
                order = np.argsort(sig, kind="stable")
                sig, who, spare = sig[order], who[order], np.concatenate(spares)[order]
                start = np.concatenate(([True], sig[1:] != sig[:-1]))
                lead = who[np.flatnonzero(start)][np.cumsum(start) - 1]
                drop = ~start & (lead == who)
                sig, who, lead, start, spare = sig[~drop], who[~drop], lead[~drop], start[~drop], spare[~drop]
                spare = 2 * spare + (start & ~np.append(start[1:], True))
                for i in range(0, len(sig), SEND_ROWS):
                    cut = slice(i, i + SEND_ROWS)
                    pk = np.where(start[cut], sig[cut], mix(who[cut].view(np.uint64) + sig[cut])).view(np.int64)
                    yield _rows(pk, sig[cut].view(np.int64), np.zeros(len(pk), np.int64), who[cut], pa.array(lead[cut], mask=start[cut]), None, spare[cut])

    return _texts(docs).mapInArrow(trimmed(sign), _ROW)


def _rows(pk, sig, sig2, doc, leader, n, spare) -> pa.RecordBatch:
    size = len(pk)
    column = lambda x: pa.nulls(size, pa.int64()) if x is None else x if isinstance(x, pa.Array) else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([column(x) for x in (pk, sig, sig2, doc, leader, n, spare)], [x.split()[0] for x in _ROW.split(", ")])


def document_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams) of the documents whose doc_id is in ids: sets made anew from the texts."""
    ids = written(ids, "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    shingler = Shingler(n)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = [shingler(t, words).view(np.int64) for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "grams"])

    return _texts(docs).join(ids, "doc_id", "left_semi").mapInArrow(trimmed(sets), "doc_id bigint, grams array<bigint>")


def overlaps(known: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those whose accumulated overlap reaches the bound: den * common >= num * united; known has their sets."""
    left = known.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
    right = known.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
    united = F.size("x") + F.size("y") - F.col("common")
    return both.where(F.lit(den) * F.col("common") >= F.lit(num) * united).select("a", "b").distinct()


def _beside(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner", keep: bool = False) -> DataFrame:
    """rows with the columns of few, a table with one row a key: sent to every task where it has BROADCAST_KEYS rows
    at most, else joined by a shuffle whose large partitions adaptive execution can split. With keep, few costs much and is written before it is counted."""
    few = written(few, "keys") if keep else few
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_KEYS else few.hint("merge"), on, how)


_ORDERED = ("least(d, doc) a", "greatest(d, doc) b")


def _divide(known: DataFrame, groups: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """One round over groups (gid, doc, component, whole): (pairs to try, sure links, groups of the next round).

    Every pair of a group in different components that can be over the bound is a pair to try, is joined by the
    links, or is in a group of the next round. Where few documents lie outside a group's largest component, these
    are tried against all of it. Else let C be any set of n-grams, and X those in which a document of n n-grams
    differs from C. Two documents differ in |X| + |Y| - 2 |X and Y| n-grams, which the bound holds under
    (n + m)(den - num)/(den + num). With s = (den + num)|X| - (den - num) n that is s + s' <= 2 (den + num) |X and Y|, so:

    * where s + s' <= 0 the pair is over the bound. Then the document with the least s is over the bound with
      both, and one row a document says all that is to say about such pairs;
    * else X and Y share o = (s + s')/(2 (den + num)) n-grams at least, rounded up. With the n-grams of X that fewest
      of the group have first, one of them is among the first |X| - o + 1, with the least s' that a partner
      in another component can have. The others make no row.

    The documents of such an n-gram in different components are paired where there are SMALL at most; more are a
    group of the next round.

    C has the n-grams of most of a sample of about CENTRE_DOCS documents, so that most X are short; any C gives the same links. A group
    that has more than half of the one it comes from is `whole`: next time all its documents say what C is, then no
    n-gram is in more than half of the X. So groups halve in two rounds.
    """
    twice = 2 * (den + num)
    heads = groups.groupBy("gid", "component").agg(F.count("*").alias("k")).groupBy("gid")
    heads = heads.agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("total"))
    rows = _beside(groups, heads.select("gid", "total", F.col("most.component").alias("main"), (F.col("total") - F.col("most.k")).alias("outside")), ["gid"])
    rows = written(rows, "groups")
    pick = lambda t, *more: t.where("component <> main").select("gid", F.col("doc").alias("d"), F.col("component").alias("c"), *more)
    apart = "c <> component and (component = main or d < doc)"
    few = rows.where(F.col("outside") <= FEW)
    tried = pick(few).join(few, "gid").where(apart).selectExpr(*_ORDERED)
    many = rows.where(F.col("outside") > FEW).drop("outside")
    if many.isEmpty():
        return tried, None, None

    own = known.select(F.col("doc_id").alias("doc"), F.col("grams").alias("x"))
    asked = many.where(F.col("whole") | (F.pmod(F.xxhash64("gid", "doc"), "total") < CENTRE_DOCS)).select("gid", "doc")
    counted = asked.join(own, "doc").select("gid", F.explode("x").alias("g")).groupBy("gid", "g").agg(F.count("*").alias("c"))
    counted = _beside(counted, asked.groupBy("gid").agg(F.count("*").alias("m")), ["gid"])
    middle = written(counted.where("2 * c > m").groupBy("gid").agg(F.collect_list("g").alias("y")), "middles")
    size = middle.agg(F.sum(F.size("y"))).first()[0] or 0
    middle = F.broadcast(middle) if size <= BROADCAST_KEYS * 10 else middle.hint("merge")
    none = F.array().cast("array<bigint>")
    diffs = many.join(own, "doc").join(middle, "gid", "left").withColumn("y", F.coalesce("y", none))
    diffs = diffs.select("gid", "doc", "component", "total", F.size("x").cast("long").alias("n"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("g")).withColumn("size", F.size("g"))
    diffs = written(diffs.withColumn("s", F.lit(den + num) * F.col("size") - F.lit(den - num) * F.col("n")), "differences")

    # all that follows up to the n-grams themselves reads the numbers only
    flat = diffs.drop("g")
    centre = flat.groupBy("gid").agg(F.min(F.struct("s", "doc", "component")).alias("p"))
    flat = _beside(flat, centre, ["gid"]).withColumn("near", (F.col("s") + F.col("p.s") <= 0) | (F.col("doc") == F.col("p.doc")))
    sure = flat.where("near and doc <> p.doc and component <> p.component").select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b"))
    joined = flat.where("near").groupBy("gid", "component").agg(F.first("p.component").alias("to"))
    flat = written(_beside(flat.drop("p", "near"), joined, ["gid", "component"], "left").withColumn("component", F.coalesce("to", "component")).drop("to"), "joined")

    least = flat.groupBy("gid", "component").agg(F.count("*").alias("k"), F.min("s").alias("s"))
    main = least.groupBy("gid").agg(F.max(F.struct("k", "component")).alias("most"), F.min("s").alias("s_all"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("gid", F.col("most.component").alias("main"), "s_all")
    main = least.join(main, "gid").where("component <> main").groupBy("gid").agg(F.first("main").alias("main"), F.first("s_all").alias("s_all"), F.min("s").alias("s_out"))
    left = _beside(flat, main, ["gid"]).withColumn("o", F.ceil((F.col("s") + F.when(F.col("component") == F.col("main"), F.col("s_out")).otherwise(F.col("s_all"))) / twice))
    left = left.withColumn("o", F.greatest("o", F.lit(1))).where(F.col("o") <= F.col("size"))
    left = written(left.groupBy("gid", "doc").agg(*(F.first(c).alias(c) for c in ("component", "total", "main")), F.min("s").alias("s"), F.min("o").alias("o")), "left")
    # rows of n-grams are as narrow as can be, one number for group and n-gram; what else is known of a document comes back to the few left
    keyed = _beside(diffs.select("gid", "doc", "g"), left.select("gid", "doc"), ["gid", "doc"], "left_semi")
    keyed = keyed.select("gid", "doc", F.explode(F.expr("transform(g, x -> xxhash64(gid, x))")).alias("key"))
    seen = keyed.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    document = Window.partitionBy("gid", "doc")
    placed = _beside(keyed, seen, ["key"], keep=True).join(left, ["gid", "doc"])
    placed = placed.withColumn("i", F.row_number().over(document.orderBy("f", "key"))).withColumn("rest", F.count("*").over(document) - F.col("i") + 1)
    placed = written(placed.where("rest >= o").select("gid", "key", "doc", "component", "total", "main", "s", "f", "rest"), "places")

    keys = placed.groupBy("gid", "key").agg(
        F.count("*").alias("k"), F.first("f").alias("f"), F.min("component").alias("c1"), F.max("component").alias("c2"),
        F.bit_xor(F.xxhash64("doc")).alias("x1"), F.sum(F.shiftright(F.xxhash64(F.lit(3), "doc"), 24)).alias("x2"),
    ).where("c1 <> c2")
    # of n-grams with the same documents the first: more of each document comes after it
    keys = keys.groupBy("gid", "k", "x1", "x2").agg(F.min(F.struct("f", "key")).alias("first")).select("gid", "k", F.col("first.key").alias("key"))
    placed = written(_beside(placed.drop("f"), keys, ["gid", "key"]), "places")
    small = placed.where(F.col("k") <= SMALL)
    shared = pick(small, "key", F.col("s").alias("t"), F.col("rest").alias("rest2")).join(small, ["gid", "key"])
    shared = shared.where(f"{apart} and {twice} * least(rest, rest2) >= s + t").selectExpr(*_ORDERED)
    further = placed.where(F.col("k") > SMALL).select(F.col("key").alias("gid"), "doc", "component", (2 * F.col("k") > F.col("total")).alias("whole"))
    return tried.union(shared).distinct(), sure.distinct(), further


def _meet(known: DataFrame, members: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs to try, groups of _divide) of members (doc, component): every pair over the bound in different components is in one of them.

    The n-grams of all members are put in one order: first those that members of one component only have, then the others by how
    many have them. In it a pair over the bound of n and m n-grams shares a first n-gram, which both components have and from which on each of the
    two has num (n + m)/(den + num) n-grams at least, all of them of several components. Most documents have too few of these; an n-gram of the others is kept
    where a document of another component and of a size that goes with its own is there, as the least size and the most n-grams of each
    class of sizes tell. So neither makes more rows than there are n-grams. What is left of an n-gram is paired where MEET documents have it at most.
    """
    own = known.select(F.col("doc_id").alias("doc"), F.col("grams").alias("x"))
    rows = members.join(own, "doc").select("doc", "component", F.size("x").cast("long").alias("n"), F.explode("x").alias("key"))
    seen = rows.groupBy("key").agg(F.count("*").alias("f"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    document = Window.partitionBy("doc")
    placed = _beside(rows, seen.where("c1 <> c2").select("key", "f"), ["key"], keep=True)
    placed = placed.withColumn("rest", F.count("*").over(document) - F.row_number().over(document.orderBy("f", "key")) + 1)
    placed = placed.where(f"{den + num} * rest >= {num} * (n + ceil({num} * n / {den}))").withColumn("class", F.floor(F.log("n") / math.log(CLASS)))
    placed = written(placed.drop("f"), "placed")

    classes = placed.groupBy("key", "class").agg(F.min("n").alias("m"), F.max("n").alias("most"), F.max("rest").alias("rest2"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    goes = f"(c1 <> component or c2 <> component) and {den + num} * least(rest, rest2) >= {num} * (n + m) and {den} * n >= {num} * m and {den} * most >= {num} * n"
    placed = written(placed.join(classes.drop("class").withColumnRenamed("key", "other"), F.expr(f"key = other and {goes}"), "left_semi"), "placed")
    keys = placed.groupBy("key").agg(
        F.count("*").alias("k"), F.min("component").alias("c1"), F.max("component").alias("c2"),
        F.bit_xor(F.xxhash64("doc", "n")).alias("x1"), F.sum(F.shiftright(F.xxhash64(F.lit(3), "doc", "n"), 24)).alias("x2"), F.sum("rest").alias("rests"),
    ).where("c1 <> c2")
    # of n-grams with the same documents the first, from which on each has most
    keys = keys.groupBy("k", "x1", "x2").agg(F.max(F.struct("rests", "key")).alias("first")).select("k", F.col("first.key").alias("key"))
    placed = written(_beside(placed, keys, ["key"]), "placed")
    small = placed.where(F.col("k") <= MEET)
    others = small.select("key", F.col("doc").alias("d"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("rest").alias("rest2"))
    tried = small.join(others, "key").where(f"d < doc and c <> component and {den + num} * least(rest, rest2) >= {num} * (n + m) and {den} * least(n, m) >= {num} * greatest(n, m)")
    large = placed.where(F.col("k") > MEET).select(F.col("key").alias("gid"), "doc", "component", F.lit(False).alias("whole"))
    return tried.selectExpr(*_ORDERED).distinct(), large.distinct()


def _left_to_try(docs: DataFrame, groups: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, pairs to try, sure links) for groups (gid, doc, component), by _meet and then by rounds of _divide until no group is left."""
    members = written(groups.select("doc", "component").distinct(), "members")
    known = written(document_sets(docs, members.select(F.col("doc").alias("doc_id")).distinct(), n), "sets")
    with passing(docs.sparkSession):
        tried, groups = _meet(known, members, num, den)
        pairs, links = [written(tried, "pairs", keep=True)], []
        groups = written(groups, "groups", keep=True)
    while rows := groups.count():
        parts, left = max(1, min(PARTS, rows // PART_ROWS)), []
        for part in range(parts):
            with passing(docs.sparkSession):
                tried, sure, further = _divide(known, groups.where(F.pmod(F.xxhash64("gid"), F.lit(parts)) == part), num, den)
                pairs.append(written(tried, "pairs", keep=True))
                if sure is not None:
                    links.append(written(sure, "links", keep=True))
                    left.append(written(further, "groups", keep=True))
        if not left:
            break
        groups = functools.reduce(DataFrame.union, left)
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    union = lambda found: functools.reduce(DataFrame.union, found, none)
    return known, union(pairs).distinct(), union(links).distinct()


def _several(tagged: DataFrame) -> DataFrame:
    """The rows (sig, doc, component, spare) of signatures in several components, with k rows of which gid is the least doc."""
    heads = tagged.groupBy("sig").agg(F.min("doc").alias("gid"), F.count("*").alias("k"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    return _beside(tagged, heads.where("c1 <> c2").select("sig", "gid", "k"), ["sig"])


def _rarest(shared: DataFrame) -> DataFrame:
    """Without the most frequent signatures (sig, doc, component, spare, k) of each document, as many as it can spare of each kind.

    The k of a signature and then its number are an order that is the same for all. Signatures in one component only, which are not
    here, count as the rarest. A document of two texts spares as many as the text that can spare less.
    """
    kind = Window.partitionBy("doc", F.shiftright("spare", SPARE_BITS))
    placed = shared.withColumn("i", F.row_number().over(kind.orderBy(F.desc("k"), "sig"))).withColumn("least", F.min("spare").over(kind))
    return placed.where(F.col("i") > F.col("least").bitwiseAND((1 << SPARE_BITS) - 1)).select("sig", "doc", "component", "spare")


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text): classes of links with Jaccard num/den or more.

    component_id is the least doc_id that links reach. Null and empty texts and texts of white space have no
    shingles and link with nothing, not even each other. doc_id is an integer key: rows that repeat one are
    one document, for which the link of any of its texts counts; each has its row. A null doc_id links with
    nothing and its component_id is null. Columns other than the two are ignored.

    1. Signatures (see Blocks) give each document a few keys; documents over the bound share one.
    2. Where a key's rows meet, each is paired with the least document only, not with all: as many pairs as rows.
    3. Overlaps of these pairs are counted and held against the bound; those that reach it are links.
    4. Only pairs of one key in different components are left to try. Of a document's keys the most frequent are left out, as
       many as Blocks allows, else groups would grow with the table by n-grams that are not common enough for common_grams; then see _divide.
    So every pair over the bound is a link or lies in one component, and a group of near copies costs as
    many pairs as it has members.
    """
    with passing(docs.sparkSession):
        whole, parts = _classes(docs, n, num, den)
        whole, parts = written(whole, "sizes", keep=True), written(parts, "parts", keep=True)
    return whole.join(parts, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of each row, and (doc_id, component_id) of documents with links."""
    spark = docs.sparkSession
    blocks = Blocks(num, den)
    rows = _signatures(docs, n, blocks, common_grams(docs, n))
    w = Window.partitionBy("pk", "sig", "sig2")
    rows = rows.withColumn("head", F.min("doc").over(w)).withColumn("k", F.count("*").over(w))
    rows = rows.where("n is not null or leader is not null or k > 1 or spare % 2 = 1")
    rows = written(rows.select("sig", "sig2", "doc", F.coalesce("leader", "head").alias("head"), "n", F.shiftright("spare", 1).alias("spare")), "signatures")
    keyed = rows.where("n is null").select("sig", "sig2", "doc", "head")
    pairs = keyed.where("doc <> head").select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b"), (F.col("sig2") != 0).alias("equal"))
    pairs = written(pairs.groupBy("a", "b").agg(F.max("equal").alias("equal")), "pairs")
    unequal = pairs.where("not equal").select("a", "b")
    sets = document_sets(docs, unequal.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n)
    links = written(pairs.where("equal").select("a", "b").unionByName(overlaps(sets, unequal, num, den)), "links")
    parts = components(links)

    # all rows of a key, each with its component so far; the rows of equal sets need no second look
    tagged = rows.where("n is null and sig2 = 0").groupBy("sig", "doc").agg(F.min("spare").alias("spare"))
    tagged = written(tagged.join(parts.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "tagged")
    rarest = written(_rarest(_several(tagged)), "rarest")
    groups = written(_several(rarest).select("gid", "doc", "component", F.lit(False).alias("whole")).distinct(), "groups")
    if not groups.isEmpty():
        known, more, sure = _left_to_try(docs, groups, n, num, den)
        more = written(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        late = written(overlaps(known, more, num, den).union(sure), "links")
        if not late.isEmpty():
            parts = components(links.unionByName(late))
    whole = rows.where("n is not null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"))
    return whole, parts.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose document is the least of its class; rows with a null doc_id stay."""
    classes = jaccard_classes(docs, n, num, den)
    others = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
