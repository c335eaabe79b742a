"""Quality rules as a short-circuit cascade.

Every rule is a cheap test of one document.  On a bounded sample each rule's
cost and share of rejections are measured; rules then run in the order of
rejections per second, and the first that rejects ends the work on a document.
The order changes the cost, never the verdict.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bind import let
from .common import SPACE_SET, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated when the text has it twice.
WINDOW = 8
#: Rows of the sample that orders the rules, and the longest text in it: only the order depends on them.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 50_000


# -- measures of one document; ``words`` is the array of its words ------------------------------------------------------

def n_words(text: Column, words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(text: Column, words: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(text, SPACE_SET, "")).cast("long")


def n_symbols(text: Column, words: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_capitals(text: Column, words: Column) -> Column:
    """Letters that lower-casing changes."""
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_SET, "")) > 0)


def n_dup_lines(text: Column, words: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lambda b: (F.size(b["lines"]) - F.size(F.array_distinct(b["lines"]))).cast("long"), lines=lines_with_words(text))


def n_lines(text: Column, words: Column) -> Column:
    return F.size(lines_with_words(text)).cast("long")


def n_repeat_words(text: Column, words: Column) -> Column:
    """Words inside WINDOW-word windows that the text has twice or more, first ones included.

    Windows are compared by hash; where all differ, nothing more is done.  Else hashes are sorted with their
    places, equal neighbours give the repeated places, and their windows are merged: n log n for any length.
    """
    none = F.lit(0).cast("long")

    def covered(b: Column) -> Column:
        s = b["s"]
        same = lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]) & (k > 0), F.lit(False)) | F.coalesce(
            F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
        start = F.struct(none.alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def sorted_hashes(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def of(b: Column) -> Column:
        return F.when(F.size(F.array_distinct(b["h"])) == F.size(b["h"]), none).otherwise(let(covered, s=sorted_hashes(b["h"])))

    def hashed(b: Column) -> Column:
        h = F.transform(F.sequence(F.lit(1), F.size(b["w"]) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(b["w"], i, WINDOW)))
        return F.when(F.size(b["w"]) <= WINDOW, none).otherwise(let(of, h=h))

    return let(hashed, w=words)


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_capitals": n_capitals,
    "n_dup_lines": n_dup_lines, "n_lines": n_lines, "n_repeat_words": n_repeat_words,
}


# -- rules ---------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the condition from the values of ``measures``, in their order."""
    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., Column]

    def on_measures(self) -> Column:
        """Over columns that hold the measures."""
        return self.rejects(*map(F.col, self.measures))

    def on_text(self, text: Column, words: Column) -> Column:
        """Over the text: its measures are computed only where this is evaluated."""
        return let(lambda b: self.rejects(*[b[m] for m in self.measures]), **{m: MEASURES[m](text, words) for m in self.measures})


#: What every text must pass: enough words, few of them in repeated windows.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > 3 * n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 14 * n)),
    Rule("capitals", ("word_chars", "n_capitals"), lambda c, k: 10 * k > 6 * c),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda n, d: 10 * d > 3 * n),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejected share per second; a rule that rejects nothing here keeps a small share, so that the cheaper one goes first."""
        return (self.rejected + 1e-4) / max(self.seconds, 1e-9)


def measure_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of each rule on at most ``sample_rows`` rows, best first.

    The sample is whatever rows come first, taken partition by partition until there are enough: it decides an order of
    evaluation and nothing else, and its size does not depend on the table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    taken = docs.select(text.alias("text")).where(F.length("text") <= SAMPLE_CHARS).take(sample_rows)
    rows = docs.sparkSession.createDataFrame(taken, "text string").withColumn("words", words_of(F.col("text"))).cache()
    total = rows.count()
    found = []
    for rule in rules:
        began = time.perf_counter()
        hits = rows.agg(F.count_if(rule.on_text(F.col("text"), F.col("words")))).head()[0] or 0
        found.append(Measured(rule, time.perf_counter() - began, hits / max(1, total)))
    rows.unpersist()
    return sorted(found, key=lambda m: (-m.worth, m.rule.name))


def rejected(order: Sequence[Rule], test: Callable[[Rule], Column]) -> Column:
    """True where any rule rejects; a later rule is not evaluated once an earlier one has."""
    out = F.lit(False)
    for rule in reversed(order):
        out = F.when(test(rule), F.lit(True)).otherwise(out)
    return out


def measured(docs: DataFrame, text_col: str = "text", names: Sequence[str] = tuple(MEASURES), keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and the named measures of every row (null text: as the empty one)."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    return rows.select(*keep, *[MEASURES[m](F.col("_text"), F.col("_words")).alias(m) for m in names])


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, columns unchanged, in one pass without a shuffle.

    A null or empty text has no words and is rejected by ``few_words``.  Repeated rows are judged alike.
    """
    order = [m.rule for m in measure_rules(docs, rules, text_col, sample_rows)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    drop = let(lambda b: rejected(order, lambda r: r.on_text(b["text"], b["words"])), text=text, words=words_of(text))
    return docs.where(~drop)
