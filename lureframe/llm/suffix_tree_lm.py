"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of a text's words joined by single blanks, and a final end
symbol.  Next-symbol counts are taken for contexts of up to DEPTH bytes over the
whole training corpus.  A context stays in the tree where its next-symbol
distribution diverges enough from that of its suffix (or where a longer context
below it stays).  Distributions are smoothed by interpolation with the suffix
(Witten-Bell); a text is scored by the longest suffix state at each symbol.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stored
from .tokens import slices_of

#: Bytes of the longest context.
DEPTH = 6
#: A context stays if its log-likelihood gain over its suffix reaches this share of half a logarithm of its count per distinct next symbol.
GAIN = 1.0
#: Grams whose log-probabilities tasks share, at most (12 bytes each): the most frequent ones; those of all other grams are joined.
SHARED_GRAMS = 4_000_000
#: Words whose counts tasks share, at most; the counts of all other words are joined.
SHARED_WORDS = 150_000
#: Bytes of text counted and scored at a time, and rows of counts held by a counting task.
COUNT_CHUNK, SCORE_CHUNK, COUNT_ROWS = 4_000_000, 1_500_000, 3_000_000
END = 10


def symbols(text: str) -> bytes:
    """Words joined by one blank, A-Z lower-cased, then the end symbol (no word can hold it)."""
    return b" ".join(text.encode().lower().split()) + b"\n"


def grams(parts: list[bytes]):
    """Codes of DEPTH bytes of context (end symbols before the start) and the symbol, for every symbol of every part in order."""
    import numpy as np

    pad = bytes([END]) * DEPTH
    flat = np.frombuffer(pad.join([b"", *parts]), np.uint8)
    n = len(flat) - DEPTH
    code = np.zeros(n, np.int64)
    for k in range(DEPTH + 1):
        code <<= 8
        code |= flat[k:k + n]
    sizes = np.array([len(p) for p in parts])
    # codes of padding lie between parts: part i starts at the sizes before it and i paddings
    starts = np.cumsum(sizes) - sizes + DEPTH * np.arange(len(parts))
    keep = np.ones(n, bool)
    for k in range(DEPTH):
        keep[starts[1:] - DEPTH + k] = False
    return code[keep], np.cumsum(sizes) - sizes


def summed(every, n):
    """Distinct codes, rising, and the sums of their counts."""
    import numpy as np

    order = np.argsort(every)
    every, n = every[order], n[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])[:len(every)]
    return every[first], np.add.reduceat(n, first) if len(first) else n


def chunks(texts: Iterable[str], most: int) -> Iterator[list[bytes]]:
    """Symbols of consecutive texts, ``most`` bytes or more in all but the last part."""
    held, size = [], 0
    for t in texts:
        s = symbols(t)
        held.append(s)
        size += len(s)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, n (in training texts), m (in all) over a table with columns ``in_training`` and ``text``: summed in each task first."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys, counts = [], []  # a key is the gram and a bit: of training texts
        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}

        def count(learn):
            if held[learn]:
                c, n = np.unique(grams(held[learn])[0], return_counts=True)
                keys.append(c << 1 | int(learn))
                counts.append(n)
                held[learn], size[learn] = [], 0

        def out():
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(k >> 1), pa.array(np.where(k & 1, n, 0)), pa.array(n)], names=["gram", "n", "m"])

        for b in (s for batch in batches for s in slices_of(batch, 512)):
            for learn, t in zip(b.column("in_training").to_pylist(), b.column("text").to_pylist()):
                learn = bool(learn)
                s = symbols(t)
                held[learn].append(s)
                size[learn] += len(s)
                if size[learn] >= COUNT_CHUNK:
                    count(learn)
                    if sum(map(len, keys)) > COUNT_ROWS:
                        yield out()
        count(True)
        count(False)
        if keys:
            yield out()

    return docs.select("in_training", "text").mapInArrow(run, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes, A-Z lower-cased), n over a table with a column ``text``: summed in each task first."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for b in (s for batch in batches for s in slices_of(batch, 512)):
            for t in b.column("text").to_pylist():
                seen.update(t.encode().lower().split())
            if len(seen) > 600_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def first_orders(counts: DataFrame):
    """256 x 256 probabilities of a symbol after one byte, smoothed over the symbol alone and that over all bytes (65,536 rows at most)."""
    import numpy as np

    pairs = np.zeros((256, 256))
    for r in counts.groupBy(F.shiftright("gram", 8).bitwiseAND(255).alias("a"), F.col("gram").bitwiseAND(255).alias("x")).agg(F.sum("n").alias("n")).collect():
        pairs[r["a"], r["x"]] = r["n"]
    alone = pairs.sum(0)
    kinds, total = np.count_nonzero(alone), alone.sum()
    p0 = (alone + kinds / 256) / (total + kinds) if total else np.full(256, 1 / 256)
    kinds, total = np.count_nonzero(pairs, axis=1)[:, None], pairs.sum(1)[:, None]
    return np.where(total > 0, (pairs + kinds * p0) / np.maximum(total + kinds, 1), p0)


def _grow(p1):
    """All states that share their last two bytes, from their grams: one group of ``branches``."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        grams_, counts = table.column("gram").to_numpy(), table.column("n").to_numpy()
        levels = []
        below = None  # probabilities of the level before, by code
        for k in range(2, DEPTH + 1):
            mask = (1 << 8 * (k + 1)) - 1
            codes, n = summed(grams_ & mask, counts)
            ctx, at = np.unique(codes >> 8, return_inverse=True)
            total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
            if below is None:
                prior = p1[codes >> 8 & 255, codes & 255]
            else:
                prior = below[1][np.searchsorted(below[0], codes & (mask >> 8))]
            p = (n + kinds[at] * prior) / (total + kinds)[at]
            gain = np.bincount(at, n * np.log(p / prior), len(ctx))
            worth = gain / (0.5 * kinds * np.log(total + 1) + 1e-9)
            levels.append((codes, p, ctx, at, kinds / (total + kinds), worth))
            below = codes, p
        for k in range(len(levels) - 1, 0, -1):  # a state is worth as much as the best below it
            ctx, worth = levels[k][2], levels[k][5]
            up = np.searchsorted(levels[k - 1][2], ctx & ((1 << 8 * (k + 1)) - 1))
            np.maximum.at(levels[k - 1][5], up, worth)
        level, code, lp, value = [], [], [], []
        for k, (codes, p, ctx, at, back, worth) in enumerate(levels, start=2):
            level += [np.full(len(codes), k, np.int32), np.full(len(ctx), -k, np.int32)]  # a negative level: a context and its share for unseen symbols
            code += [codes, ctx]
            lp += [np.log10(p), np.log10(back)]
            value += [worth[at], worth]
        return pa.table({"level": np.concatenate(level), "code": np.concatenate(code), "lp": np.concatenate(lp).astype(np.float32),
                         "worth": np.concatenate(value).astype(np.float32)})

    return run


def branches(counts: DataFrame, p1) -> DataFrame:
    """level, code, lp, worth of all states of two bytes and more.

    A state and all its suffixes of two bytes or more share their last two bytes, so a branch is complete in its group: at most
    65,536 groups, each bounded by the number of distinct grams behind two bytes, not by the corpus.
    """
    rows = counts.withColumn("last2", F.shiftright("gram", 8).bitwiseAND(65535))
    return rows.groupBy("last2").applyInArrow(_grow(p1), "level int, code long, lp float, worth float")


class SuffixTree:
    """The states that stay (of a branch, or all), in sorted arrays by level."""

    def __init__(self, p1, rows):
        import numpy as np

        self.first = np.log10(p1).astype(np.float32)
        level, code, lp = rows
        self.levels = []
        for k in range(DEPTH, 1, -1):
            pair = []
            for sign in (k, -k):
                pick = level == sign
                order = np.argsort(code[pick])
                pair += [code[pick][order], lp[pick][order]]
            self.levels.append((k, *pair))

    def of_codes(self, code):
        """log10 probability of the last symbol of each (distinct) code."""
        import numpy as np

        out = np.full(len(code), np.nan, np.float64)
        owed = np.zeros(len(code))
        todo = np.arange(len(code))
        for k, codes, lp, ctx, back in self.levels:
            if not len(codes) or not len(todo):
                continue
            g = code[todo] & ((1 << 8 * (k + 1)) - 1)
            at = np.searchsorted(codes, g)
            at[at == len(codes)] = 0
            hit = codes[at] == g
            out[todo[hit]] = owed[todo[hit]] + lp[at[hit]]
            todo, c = todo[~hit], g[~hit] >> 8
            at = np.searchsorted(ctx, c)
            at[at == len(ctx)] = 0
            known = ctx[at] == c
            owed[todo[known]] += back[at[known]]
        g = code[todo]
        out[todo] = owed[todo] + self.first[g >> 8 & 255, g & 255]
        return out

    def scores(self, parts: list[bytes]):
        """log10 probability of each part."""
        import numpy as np

        codes, starts = grams(parts)
        distinct, where = np.unique(codes, return_inverse=True)
        return np.add.reduceat(self.of_codes(distinct)[where], starts)


def fit(docs: DataFrame, gain: float = GAIN) -> SuffixTree:
    """The tree of a table with a column ``text`` (not null), whole in the driver.  An empty table gives the uniform model."""
    import numpy as np

    counts = stored(count_grams(docs.select(F.lit(True).alias("in_training"), "text")), "grams")
    p1 = first_orders(counts)
    kept = branches(counts, p1).where(F.col("worth") >= gain).select("level", "code", "lp").toArrow()
    return SuffixTree(p1, [kept.column(c).to_numpy() if kept.num_rows else np.zeros(0, t) for c, t in (
        ("level", np.int32), ("code", np.int64), ("lp", np.float32))])


def gram_values(counts: DataFrame, gain: float = GAIN) -> DataFrame:
    """gram, m, lp (log10 probability by the whole tree) of every gram of ``counts`` (gram, n, m).

    All states that a gram can meet share the last two bytes of its context, so its value is settled where its branch is grown:
    the tree is never gathered, no state is left out.
    """
    p1 = first_orders(counts)
    grow = _grow(p1)

    def run(table):
        import numpy as np
        import pyarrow as pa

        code = table.column("gram").to_numpy()
        learnt = table.filter(pa.array(table.column("n").to_numpy() > 0))
        rows = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        if learnt.num_rows:
            states = grow(learnt)
            kept = states.column("worth").to_numpy() >= gain
            rows = [states.column(c).to_numpy()[kept] for c in ("level", "code", "lp")]
        return pa.table({"gram": code, "m": table.column("m").to_numpy(), "lp": SuffixTree(p1, rows).of_codes(code).astype(np.float32)})

    rows = counts.withColumn("last2", F.shiftright("gram", 8).bitwiseAND(65535))
    return rows.groupBy("last2").applyInArrow(run, "gram long, m long, lp float")


def frequent(table: DataFrame, n: str, most: int) -> int:
    """The least step (sixteenth of a binary logarithm of column ``n``) from which at most ``most`` rows remain."""
    seen = 0
    for r in sorted(table.groupBy(_step(n).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"]):
        seen += r["n"]
        if seen > most:
            return r["s"] + 1
    return -1


def _step(n: str):
    return F.floor(F.log2(n) * 16).cast("int")


def score_documents(spark: SparkSession, docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, in_training, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``training`` is a boolean column over ``docs``.  Base: unigram with one added, over words and the end token; a word's count comes
    from a shared table of the most frequent words (bounded) and from a join for all others.  So does the value of a gram by the whole
    tree.  Null text: empty, one end token.  Repeated rows count and stay.  No training rows: all words are unknown, symbols are uniform.
    """
    import numpy as np

    rows = docs.select(F.col(id_col).alias("doc_id"), training.alias("in_training"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = rows.where("in_training").select("text")
    counts = stored(count_grams(rows), "grams")
    values = stored(gram_values(counts), "values")
    common = frequent(values, "m", SHARED_GRAMS)
    shared = values.where(_step("m") >= common).select("gram", "lp").toArrow()
    code, lp = (shared.column(c).to_numpy() if shared.num_rows else np.zeros(0, t) for c, t in (("gram", np.int64), ("lp", np.float32)))
    order = np.argsort(code)
    model = spark.sparkContext.broadcast((code[order], lp[order]))
    del shared, code, lp, order
    words = stored(count_words(learn), "words")
    ends = learn.count()
    size = words.agg(F.count(F.lit(1)), F.sum("n")).head()
    total, kinds = (size[1] or 0) + ends, size[0] + (ends > 0)
    denominator = math.log10(total + kinds + 1)
    cut = frequent(words, "n", SHARED_WORDS)
    often = spark.sparkContext.broadcast({bytes(r[0]): math.log10(r[1] + 1) for r in words.where(_step("n") >= cut).toLocalIterator()})
    end_value = math.log10(ends + 1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        (known_codes, lps), value = model.value, often.value
        for b in (s for batch in batches for s in slices_of(batch, 512)):
            sure, known, rare, counts, score, others, where = [], [], [], [], [], [], [0]
            for parts in chunks(b.column("text").to_pylist(), SCORE_CHUNK):
                codes, starts = grams(parts)
                distinct, back = np.unique(codes, return_inverse=True)
                at = np.searchsorted(known_codes, distinct)
                at[at == len(known_codes)] = 0
                found = known_codes[at] == distinct if len(known_codes) else np.zeros(len(distinct), bool)
                each = np.zeros(len(distinct))
                each[found] = lps[at[found]]
                score += np.add.reduceat(each[back], starts).tolist()
                far = ~found[back]
                others.append(codes[far])
                where += (where[-1] + np.add.reduceat(far.astype(np.int64), starts).cumsum()).tolist()
                for s in parts:
                    w = s.split()
                    found = list(map(value.get, w))
                    other = [x for x, v in zip(w, found) if v is None]
                    counts.append(len(w) + 1)
                    known.append(len(w) - len(other) + (ends > 0))
                    sure.append(sum(v for v in found if v is not None) + end_value)
                    rare.append(other)
            others = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(np.concatenate(others) if others else [], pa.int64()))
            arrays = [b.column("doc_id"), b.column("in_training"), pa.array(counts, pa.int64()), pa.array(known, pa.int64()),
                      pa.array(sure, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.binary())), others]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "in_training", "n_tokens", "known", "sure", "score", "rare", "grams"])

    kind = dict(rows.dtypes)["doc_id"]
    scored = stored(rows.mapInArrow(run, f"doc_id {kind}, in_training boolean, n_tokens long, known long, sure double, score double, rare array<binary>, grams array<long>")
                    .withColumn("row", F.monotonically_increasing_id()), "scored")
    looked = scored.select("row", F.explode("rare").alias("word")).join(words.where(_step("n") < cut), "word").groupBy("row").agg(
        F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("added"))
    out = scored.drop("rare", "grams").join(looked, "row", "left")
    score = F.col("score")
    if common >= 0:
        # written first, the join's sides are plain shuffles, whose large partitions Spark splits; no gram here is a frequent one
        far = values.where(_step("m") < common).select("gram", "lp").hint("merge")
        out = out.join(scored.select("row", F.explode("grams").alias("gram")).join(far, "gram").groupBy("row").agg(F.sum("lp").alias("rest")), "row", "left")
        score = score + F.coalesce("rest", F.lit(0.0))
    more = F.coalesce("more", F.lit(0))
    return out.select(
        "doc_id", "in_training", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sure") + F.coalesce("added", F.lit(0.0)) - F.col("n_tokens") * denominator).alias("base_score"), score.alias("score"))
