"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import SPACE, fresh

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this at from or an have not they which you but his had her "
    "der die das und ist von zu den mit auf für im nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am "
    "le la les et des est un une dans que qui pour par sur pas au avec ce il ne se son du en plus mais nous ou de "
    "el los las con no su para al lo como más o pero sus y ya del una por"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """metric (a ratio of two base columns) has to lie within [low, high]; a null ratio passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        value = F.try_divide(*map(F.expr, self.metric.split(" / ")))
        below = F.lit(False) if self.low is None else value < F.lit(float(self.low))
        above = F.lit(False) if self.high is None else value > F.lit(float(self.high))
        return F.coalesce(below | above, F.lit(False))


#: The production table. Length rules first, then symbols, stop words and lines.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.06, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.4),
)


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the counts of the base. A null text has no words and no lines; every count is then 0.

    n_repeat_words sorts the 3-word windows of a text within its own row (words compared as strings, no
    hashing), marks windows equal to a neighbour and adds the word positions that marked windows cover.
    """
    q = fresh("__", docs.columns)
    d = docs.withColumn(f"{q}t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    d = d.withColumn(f"{q}flat", F.translate(f"{q}t", SPACE[1:], " " * 5))
    d = d.withColumn(f"{q}w", F.array_remove(F.split(f"{q}flat", " "), ""))
    d = d.withColumn("n_words", F.size(f"{q}w").cast("long"))
    d = d.withColumns({
        f"{q}a": F.col(f"{q}w"),
        f"{q}b": F.expr(f"slice({q}w, 2, greatest(n_words, 1L))"),
        f"{q}c": F.expr(f"slice({q}w, 3, greatest(n_words, 1L))"),
        f"{q}i": F.expr("sequence(0L, greatest(n_words - 1L, 0L))"),
    })
    d = d.withColumn(
        f"{q}s", F.expr(f"if(n_words > 3, sort_array(slice(arrays_zip({q}a, {q}b, {q}c, {q}i), 1, n_words - 2L)), null)")
    )
    same = f"(x.{q}a = get({q}s, {{j}}).{q}a and x.{q}b = get({q}s, {{j}}).{q}b and x.{q}c = get({q}s, {{j}}).{q}c)"
    d = d.withColumn(
        f"{q}p",
        F.expr(
            f"sort_array(transform(filter({q}s, (x, j) -> coalesce({same.format(j='j + 1')}, false) or "
            f"coalesce({same.format(j='j - 1')}, false)), x -> x.{q}i))"
        ),
    )
    covered = F.expr(
        f"aggregate({q}p, named_struct('p', -3L, 'n', 0L), (acc, x) -> named_struct('p', x, 'n', acc.n + least(3L, x - acc.p)), acc -> acc.n)"
    )
    lines = F.expr(f"filter(split({q}t, '\n'), l -> length(translate(l, ' \t\x0b\x0c\r', '')) > 0)")
    d = d.withColumn(f"{q}l", lines)
    d = d.withColumns({
        "word_chars": F.length(F.translate(f"{q}t", SPACE, "")).cast("long"),
        "n_symbols": (F.length(f"{q}t") - F.length(F.translate(f"{q}t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(f"{q}l").cast("long"),
        "n_dup_lines": (F.size(f"{q}l") - F.size(F.array_distinct(f"{q}l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_stop_words": _stop_words(f"{q}flat"),
    })
    return d.drop(*(f"{q}{x}" for x in ("t", "flat", "w", "a", "b", "c", "i", "s", "p", "l")))


def _stop_words(flat: str) -> Column:
    """Stop words among what is left of the lower-cased text between spaces and . , ; : ! ?"""
    listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = f"split(translate(lower({flat}), '.,;:!?', '      '), ' ')"
    return F.expr(f"size(filter({words}, w -> w in ({listed})))").cast("long")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, failed_rules (names of the table's rules that fail) and kept.

    Null and empty texts have no words, so base_failed is true. Rows stay as they are, repeated ones too.
    Columns of docs named like an added one are replaced.
    """
    d = base_columns(docs, text)
    failed = F.array_compact(F.array(*(F.when(r.failed(), F.lit(r.name)) for r in rules)))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumn("failed_rules", F.when(F.col("n_words") > 0, failed).otherwise(F.array().cast("array<string>")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
