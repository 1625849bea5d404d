"""Spelling variants: words one edit apart, found by their three rarest bigrams, each grouped under a far more frequent form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import binary_column, trimmed, written

#: Letters of a word. ALPHABET bounds the bigrams whose frequencies reach the driver: with A-Z folded, 90 letters make 8,100.
ALPHABET = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A near word is a word's form from so many times its occurrences on.
RATIO = 5
#: One edit touches two bigrams at most, so of the three rarest one is left in both words.
RAREST = 3
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
#: Words to look for keys of in one Arrow batch.
SEND_ROWS = 4096


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop: int | None = None, alphabet: str = ALPHABET) -> DataFrame:
    """(word, n) of words of least_letters code points or more that occur least_count times or more in all texts.

    Words are maximal runs of the alphabet in whole texts, A-Z in lower case. With drop, every run whose crc32 h of
    "<doc_id>:<run>" drop divides loses its code point h % length first (a null doc_id is the empty text there).
    Tasks add up the counts of all their texts before the shuffle, HELD_WORDS different words at a time. A null or empty text
    has no words, repeated rows count again, other columns are ignored.
    """
    # a run that is shorter can't grow: the pattern passes it over
    runs = re.compile(f"[{alphabet}]{{{least_letters},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                if not text:
                    continue
                found = Counter(runs(text.lower().decode("utf-8", "replace")))
                if drop:
                    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % drop == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_letters:
                                continue
                        total[word] += n
                else:
                    total.update(found)
                if len(total) > HELD_WORDS:
                    yield _pairs(total)
                    total.clear()
        yield _pairs(total)

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _pairs(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """The place of each bigram when those of all different words are ordered by frequency, rarest first, ties by code point.

    The driver gets one row a bigram: the square of the alphabet's letters at most.
    """
    bigrams = F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")
    counted = words.where("char_length(word) > 1").select(F.explode(bigrams).alias("g")).groupBy("g").agg(F.count("*").alias("k"))
    return {r["g"]: i for i, r in enumerate(counted.orderBy("k", "g").collect())}


def prefix(word: str, ranks: dict[str, int]) -> list[int]:
    """Where the three rarest bigrams of a word begin, and others that are the same bigram as the third.

    Let words x and y be one edit apart, and the last of x's three not come after y's last in the order. The edit touches
    two of x's bigrams at most, so one of x's three is in y too. It comes no later than y's last, and if it is that bigram
    again, it is among those of y that are added here. So x and y have a bigram of their prefixes in common that
    the edit doesn't touch.
    """
    order = sorted(range(len(word) - 1), key=lambda i: (ranks[word[i : i + 2]], i))
    last = order[RAREST - 1 : RAREST]
    return order[:RAREST] + [i for i in order[RAREST:] if last and word[i : i + 2] == word[last[0] : last[0] + 2]]


def prefix_keys(word: str, ranks: dict[str, int]) -> tuple[list[int], list[int]]:
    """Keys of a word to meet words as long as it or longer by one, and to meet words shorter by one.

    A key is a bigram of the prefix with its place, the length of the shorter word, and what the edit leaves alone: it lies on
    one side of the bigram, so the other side is the same, and so is one half of the side that it lies on. The place in the
    longer word is the same where the edit is behind the bigram, and one more where it is before it.
    """
    own, shorter = [], []
    n = len(word)

    def key(length: int, place: int, gram: str, side: str, whole: str, half: str) -> int:
        return xxhash.xxh3_64_intdigest(f"{length} {place} {gram} {side} {whole} {half}") - (1 << 63)

    for p in prefix(word, ranks):
        gram, left, right = word[p : p + 2], word[:p], word[p + 2 :]
        h, m = len(right) // 2, len(left) // 2
        own += [key(n, p, gram, "r1", left, right[:h]), key(n, p, gram, "r2", left, right[h:]), key(n, p, gram, "l1", right, left[:m]), key(n, p, gram, "l2", right, left[m:])]
        if right:
            h = (len(right) - 1) // 2
            shorter += [key(n - 1, p, gram, "r1", left, right[:h]), key(n - 1, p, gram, "r2", left, right[h + 1 :])]
        if left:
            m = (len(left) - 1) // 2
            shorter += [key(n - 1, p - 1, gram, "l1", right, left[:m]), key(n - 1, p - 1, gram, "l2", right, left[m + 1 :])]
    return own, shorter


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two different words that one inserted, deleted or replaced code point apart, once, both ways.

    words (word, n) has a row a word, of two code points at least. Words meet on prefix_keys and are verified by their
    distance; no group of words is ever compared as a whole.
    """
    shared = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in (b.slice(i, SEND_ROWS) for b in batches for i in range(0, b.num_rows, SEND_ROWS)):
            which, found, longer = [], [], []
            for row, word in enumerate(batch.column(0).to_pylist()):
                for is_longer, mine in enumerate(prefix_keys(word, ranks)):
                    which += [row] * len(mine)
                    found += mine
                    longer += [bool(is_longer)] * len(mine)
            taken = batch.take(pa.array(which, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(longer, pa.bool_()), *taken.columns], ["key", "longer", "word", "n"])

    rows = written(words.select("word", "n").mapInArrow(trimmed(keys), "key bigint, longer boolean, word string, n bigint"), "keys")
    left = rows.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, "key").where("(longer or a < b) and levenshtein(a, b, 1) = 1")
    met = met.select("a", "a_n", "b", "b_n").distinct()
    turned = F.explode(F.array(F.struct("a", "a_n", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))))
    return met.select(turned.alias("p")).select("p.*")


def forms_of(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): each word's form is its near word of largest n (ties: smallest in code-point
    order) where that n is ratio times its own at least, else null; n_near counts its near words."""
    best = F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("b")))
    near = near_pairs(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    far_more = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far_more, F.col("best.b")).alias("form"), F.when(far_more, -F.col("best.m")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: where its forms end.

    Every step multiplies n by ratio at least, so chains are as short as a logarithm; each round doubles what a row has walked.
    """
    at = forms.where("form is not null").select("word", F.col("form").alias("root"))
    at = written(at, "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, drop: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of word_counts.

    form and form_n are null for a word without a far more frequent near word; its root is itself. Documents without
    words give no rows. Words are compared as they are: an accent is another letter, and only A-Z is folded.
    """
    words = written(word_counts(docs, max(2, least_letters), least_count, drop), "words")
    forms = written(forms_of(words, ratio), "forms")
    found = forms.join(roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
