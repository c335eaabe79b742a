"""Interaction audit of a chain of filters by forward-backward path counting.

The states are the sets of filters applied so far; an edge applies one more.  An
order of the filters is a path from the empty to the full set.  What an edge
removes depends on its two ends alone, so each edge is counted once: the orders
that reach its start (forward) times the orders that leave its end (backward) tell
how many orders use it.  That product weights its removals for the Shapley sum,
and the steps of any single order are read off the edges along its path.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, stored

#: Filters of one audit at most: 7 have 5,040 orders and 448 edges.
MOST_FILTERS = 7


# -- the lattice: small tables that depend on the number of filters alone ---------------------------------------------------

def _may_follow(n: int, before: Sequence[tuple[int, int]]):
    needs = [sum({1 << a for a, b in before if b == f}) for f in range(n)]
    return lambda state, f: not state >> f & 1 and needs[f] & ~state == 0


def lattice(n: int, before: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
    """(state, filter, orders) of every edge that some order uses; ``before``: pairs (a, b), filter a always precedes b."""
    allowed, full = _may_follow(n, before), (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):  # a set comes after its subsets
        for f in range(n):
            if allowed(state, f):
                forward[state | 1 << f] += forward[state]
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | 1 << f] for f in range(n) if allowed(state, f))
    edges = ((s, f, forward[s] * backward[s | 1 << f]) for s in range(full) for f in range(n) if allowed(s, f))
    return [e for e in edges if e[2]]


def order_steps(letters: str, before: Sequence[tuple[int, int]] = ()) -> Iterator[tuple[str, int, int, int]]:
    """(filter_order, step from 1, state, filter): the edges along every order."""
    allowed = _may_follow(len(letters), before)
    for order in permutations(range(len(letters))):
        states = [sum(1 << f for f in order[:k]) for k in range(len(order))]
        if all(allowed(s, f) for s, f in zip(states, order)):
            name = "".join(letters[f] for f in order)
            yield from ((name, k + 1, s, f) for k, (s, f) in enumerate(zip(states, order)))


# -- the audit ------------------------------------------------------------------------------------------------------------

def audit(cells: DataFrame, letters: str, before: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every part, order and step.

    ``cells``: part, mask (bit k: fails filter k), docs, good, toxic (long); rows of one (part, mask) add up.  ``letters`` names
    the filters, ``before`` restricts the orders (none: all of them).  shapley is the filter's removals summed over the orders.
    """
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"{MOST_FILTERS} filters at most")
    pairs = [(letters.index(a), letters.index(b)) for a, b in before]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"),
                                        F.lit(paths).cast("long").alias("paths")) for s, f, paths in lattice(len(letters), pairs)]))
    small = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0

    def total(where: Column, what: str = "docs") -> Column:
        return F.sum(F.when(where, F.col(what)).otherwise(F.lit(0))).cast("long")

    edges = small.select("*", edge.alias("e")).select("part", "mask", "docs", "good", "toxic", "e.*").groupBy("part", "state", "filter").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"), F.max("paths").alias("paths"))
    worth = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    steps = cells.sparkSession.createDataFrame(list(order_steps(letters, pairs)), "filter_order string, step int, state int, filter int")
    # the steps are as many for any input: 600 rows for five filters, 35,280 for seven
    return edges.join(worth, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


LETTERS = "ABCDE"


def text_failures(text: Column) -> Column:
    """Bits 0-3 (A: few words, B: repeated words, C: capitals, D: symbols) of a text that is not null."""
    words = F.array_remove(F.split(text, SPACES), "")
    conditions = [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
                  100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions)), F.lit(0))


def document_cells(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask (A to E of LETTERS), docs, good, toxic: the documents counted by part and failing filters.

    One pass over whole texts leaves part, id, text hash and mask.  E (equal to the text of a smaller id, anywhere in the table)
    fails every row but those with the first id of their text: first ids come from a combined minimum and meet the rows by (id,
    text hash), so a text that a third of all rows share is spread like any other.  Null texts are empty texts, a null part is the
    empty one.  A row without an id never fails E, makes none fail, and has no label; rows that repeat id and text count each.
    A document is good (toxic) if any label row of its id says 1.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("doc_id"),
        F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"), text_failures(text).alias("mask")), "failures")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named, unnamed = rows.where("doc_id is not null"), rows.where("doc_id is null")
    first = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = named.join(first, ["doc_id", "k1", "k2"], "left").join(marks, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))
    cells = marked.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    zero = F.lit(0).cast("long")
    return cells.unionByName(unnamed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs")).select(
        "part", "mask", "docs", zero.alias("good"), zero.alias("toxic")))


def audit_documents(docs: DataFrame, labels: DataFrame, part_col: str = "source", before: Sequence[tuple[str, str]] = (), **columns) -> DataFrame:
    """``audit`` of the five filters over the documents; without documents no row."""
    return audit(document_cells(docs, labels, part_col, **columns), LETTERS, before)
