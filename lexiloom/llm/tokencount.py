"""Token counts without tokens: Viterbi over Aho-Corasick matches that carries the best score and its piece count."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import trimmed

MARK = "▁"
#: What an unknown character scores below the least piece; a fixed value of the unigram model.
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file in id order; its scores are read as unigram scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts what a unigram tokenizer with byte fallback would return, without building its tokens.

    Exact rules: best sum of scores; of equal sums the longer last piece; a character without a piece of its
    own may be unknown at UNKNOWN_PENALTY below the least score and counts as its UTF-8 bytes. A leading mark is put
    before a text that is not empty, and spaces become marks. Where no piece holds a mark after another
    character, all paths pass each word's start, so a word's count is found once and kept; the same holds
    around line ends, which no piece has. (Scores are whole numbers, so sums are exact and the parts add up.)
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        names = {p for p, _ in pieces}
        if not all(f"<0x{b:02X}>" in names for b in range(256)):
            raise ValueError("the vocabulary must have all 256 byte pieces")
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), float(score)))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.by_word = all(float(s).is_integer() for _, s in pieces) and not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in names)
        self.inner, self.first = _Kept(self, MARK), _Kept(self, "")

    def segment(self, s: str) -> int:
        """The number of pieces of the best path over s as it stands."""
        n = len(s)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        unknown, done = self.unknown, 0

        def close(upto: int) -> None:
            """Positions up to upto have all their pieces; those where no piece of one character ends may be unknown."""
            nonlocal done
            while done < upto:
                if not single[done]:
                    score = best[done] + unknown
                    if best[done + 1] is None or score > best[done + 1]:
                        best[done + 1], count[done + 1] = score, count[done] + len(s[done].encode("utf-8", "surrogatepass"))
                done += 1

        single = [False] * n
        for end, (length, score) in self.matches.iter(s):
            if done < end:
                close(end)
            start = end + 1 - length
            score += best[start]
            if length == 1:
                single[end] = True
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1], count[end + 1] = score, count[start] + 1
        close(n)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.segment(MARK + text.replace(" ", MARK))
        if MARK in text or "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            parts = re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n", MARK + text.replace(" ", MARK))
            return sum(map(self.first.__getitem__, parts))
        self.inner.trim(), self.first.trim()
        lines = text.split("\n")
        inner, first = self.inner.__getitem__, self.first.__getitem__
        total = len(lines) - 1 + sum(map(inner, lines[0].split(" ")))
        for line in lines[1:]:
            words = line.split(" ")
            total += first(words[0]) + sum(map(inner, words[1:]))
        return total


class _Kept(dict):
    """Counts by word; emptied when it holds CACHE_WORDS, which changes no result."""

    def __init__(self, counter: UnigramCounter, mark: str):
        self.counter, self.mark = counter, mark

    def __missing__(self, word: str) -> int:
        found = self.counter.segment(self.mark + word)
        if len(word) <= 64:
            self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


@functools.lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(read_pieces(path))


def token_counts(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_bytes of every row, in docs' own partitions; null and empty texts have 0.

    Repeated rows stay; other columns are not read. A text is counted whole however long it is, in time linear in it; memory is that of
    the text and of its longest stretch between words.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(vocabulary_path)
        for batch in batches:
            numbers = [found.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes")
    )
    return rows.mapInArrow(trimmed(counts), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_bytes bigint")
