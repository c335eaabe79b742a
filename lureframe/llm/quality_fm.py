"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: the buckets that its words are hashed to (with one length
in all), one of a few bins of each structure statistic, and one of its stored length.  The
machine gives each feature a weight and a short vector; every pair of features adds the
product of their vectors, which needs no pairs: per factor it is half of (square of the
sum less sum of the squares).
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .tokens import slices_of

#: Buckets of words; factors; labelled rows that the fit takes at most (in expectation; a hash of the id decides); passes over them.
BUCKETS, FACTORS, FIT_ROWS, PASSES = 1 << 14, 8, 20_000, 8
BATCH, RATE, SHRINK, SEED = 128, 0.1, 1e-5, 11
#: Texts that a task has features of at a time (at most BUCKETS and a bin of each statistic per text, however long it is).
SLICE = 64

#: Upper ends of the bins of each structure statistic.
BINS = {
    "words": (0, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 3000),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.999),
    "repeats": (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5),
    "word_bytes": (2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15, 30),
    "capitals": (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.0, 0.005, 0.02, 0.05, 0.1, 0.3),
    "stops": (0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.2, 0.4),
    "symbols": (0.0, 0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "wide": (0.0, 0.01, 0.03, 0.1, 0.3, 0.7),
    "lines": (1, 2, 4, 8, 16, 32, 64),
    "line_repeats": (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "stored_chars": (0, 16, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536),
}
#: First feature of each statistic (one more bin than ends, one more for null), and the number of features.
OFFSETS: dict[str, int] = {}
FEATURES = BUCKETS
for _name, _ends in BINS.items():
    OFFSETS[_name] = FEATURES
    FEATURES += len(_ends) + 2


def _classes():
    """Class of each byte: 0 other, 1 capital, 2 digit, 3 stop, 4 symbol, 5 beyond ASCII, 6 white space."""
    import numpy as np

    table = np.zeros(256, np.uint8)
    table[65:91], table[48:58], table[128:] = 1, 2, 5
    table[[ord(c) for c in ".,;:!?'\"()-"]] = 3
    table[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
    table[[9, 10, 11, 12, 13, 32]] = 6
    return table


def sparse(texts: list[str], stored_chars: list[int | None]):
    """(ptr, idx, val): the features of each text in ascending order, as one concatenated array (null texts: empty)."""
    from operator import eq
    from zlib import crc32

    import numpy as np

    table, parts, stats = _classes(), [], []
    for text, chars in zip(texts, stored_chars):
        raw = (text or "").encode()
        words = raw.lower().split()
        kinds = set(words)
        parts.append(np.unique(np.fromiter(map(crc32, kinds), np.uint32, len(kinds)) % BUCKETS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        of = np.bincount(table[np.frombuffer(raw, np.uint8)], minlength=7)
        n, inked = max(len(words), 1), max(len(raw) - int(of[6]), 1)
        stats.append((len(words), len(kinds) / n, sum(map(eq, words, words[1:])) / n, (len(raw) - of[6]) / n, of[1] / inked, of[2] / inked,
                      of[3] / inked, of[4] / inked, of[5] / inked, len(lines), 1 - len(set(lines)) / max(len(lines), 1),
                      np.nan if chars is None else chars))
    stats = np.array(stats, np.float64).reshape(len(texts), len(BINS))
    bins = np.empty(stats.shape, np.int64)
    for k, (name, ends) in enumerate(BINS.items()):
        bins[:, k] = OFFSETS[name] + np.where(np.isnan(stats[:, k]), len(ends) + 1, np.searchsorted(ends, stats[:, k], "left").clip(max=len(ends)))
    sizes = np.array([len(p) for p in parts], np.int64)
    ptr = np.r_[0, np.cumsum(sizes + len(BINS))]
    idx, val = np.empty(ptr[-1], np.int64), np.ones(ptr[-1])
    for k, p in enumerate(parts):
        at = ptr[k]
        idx[at:at + len(p)], idx[at + len(p):ptr[k + 1]] = p, bins[k]
        if len(p):
            val[at:at + len(p)] = len(p) ** -0.5
    return ptr, idx, val


def margins(ptr, idx, val, bias, weights, factors):
    """The machine's value of each row, in time linear in its features."""
    import numpy as np

    starts = ptr[:-1]
    vx = factors[idx] * val[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat(vx * vx, starts, axis=0)
    return bias + np.add.reduceat(weights[idx] * val, starts) + 0.5 * (total * total - squares).sum(1), total, vx


def chance(margin):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def slopes(ptr, idx, val, y, bias, weights, factors):
    """Features of the rows, and the mean log loss's slopes by the bias, their weights and their factors."""
    import numpy as np

    n = np.diff(ptr)
    m, total, vx = margins(ptr, idx, val, bias, weights, factors)
    wrong = (chance(m) - y) / len(y)
    each = np.repeat(wrong, n) * val
    pulls = each[:, None] * (np.repeat(total, n, axis=0) - vx)
    used, place = np.unique(idx, return_inverse=True)
    return used, wrong.sum(), np.bincount(place, each), np.stack([np.bincount(place, pulls[:, f]) for f in range(FACTORS)], 1)


def train(ptr, idx, val, y, passes: int = PASSES):
    """(bias, weights, factors) by adaptive gradient steps on the log loss; without rows the bias says one half."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    ones = float(y.sum())
    bias, weights = np.log((ones + 1) / (len(y) - ones + 1)), np.zeros(FEATURES)
    factors = rng.normal(0, 0.05, (FEATURES, FACTORS))
    g_bias, g_weights, g_factors = 1e-6, np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6)
    sizes = np.diff(ptr)
    for _ in range(passes):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            n = sizes[rows]
            p = np.r_[0, np.cumsum(n)]
            take = np.repeat(ptr[rows] - p[:-1], n) + np.arange(p[-1])
            i, v = idx[take], val[take]
            used, by_bias, by_weights, by_factors = slopes(p, i, v, y[rows], bias, weights, factors)
            g_bias += by_bias**2
            bias -= RATE * by_bias / np.sqrt(g_bias)
            step = by_weights + SHRINK * weights[used]
            g_weights[used] += step * step
            weights[used] -= RATE * step / np.sqrt(g_weights[used])
            step = by_factors + SHRINK * factors[used]
            g_factors[used] += step * step
            factors[used] -= RATE * step / np.sqrt(g_factors[used])
    return bias, weights, factors


# -- over tables -----------------------------------------------------------------------------------------------------------

def _stored_chars(docs: DataFrame, chars_col: str | None) -> Column:
    return F.col(chars_col).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")


def fit(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        chars_col: str | None = "n_chars", fit_rows: int = FIT_ROWS) -> DataFrame:
    """feature, weight, factors: the fitted machine as a table; the bias is feature -1.

    ``training``: a condition over the labels' ids.  Of more than ``fit_rows`` labelled rows about that many are taken, by a
    hash of the id.  Their features are made where the texts are; one task fits, with a fixed seed and order of rows.  Labels
    other than 0 and 1, and rows without an id, are not learnt from; an id labelled twice is 1 if half of its labels are.
    Without a row to learn from the table may be empty, which scores as one half.
    """
    known = labels.where(training & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.avg(label_col).alias("_y"))
    known = stored(known.select("_id", (F.col("_y") >= 0.5).cast("int").alias("_y")), "known")
    share = min(1.0, fit_rows / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _stored_chars(docs, chars_col).alias("_chars"))
    # bounded: some fit_rows rows of an id and a label
    sample = rows.join(F.broadcast(picked), "_id").select("_id", "_text", "_chars", "_y")

    def features(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in (s for batch in batches for s in slices_of(batch, SLICE)):
            if not b.num_rows:
                continue
            ptr, idx, val = sparse(b.column("_text").to_pylist(), b.column("_chars").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(idx.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), lists], names=["_id", "_y", "idx"])

    def learn(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        y, parts = [], []
        for b in batches:
            y.extend(b.column("_y").to_pylist())
            parts += [np.asarray(x.values) for x in b.column("idx")]
        sizes = np.array([len(p) for p in parts], np.int64)
        idx = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        ptr = np.r_[0, np.cumsum(sizes)]
        words = sizes - len(BINS)
        val = np.where(idx < BUCKETS, np.repeat(np.maximum(words, 1) ** -0.5, sizes), 1.0)
        bias, weights, factors = train(ptr, idx, val, np.array(y, np.float64))
        flat = pa.array(np.r_[np.zeros(FACTORS), factors.ravel()])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(FEATURES + 2) * FACTORS, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES), pa.int32()), pa.array(np.r_[bias, weights]), lists],
                                         names=["feature", "weight", "factors"])

    kind = dict(rows.dtypes)["_id"]
    made = stored(sample.mapInArrow(features, f"_id {kind}, _y int, idx array<int>"), "sample")
    ordered = made.repartition(1).sortWithinPartitions("_id", F.xxhash64("idx"))
    return stored(ordered.mapInArrow(learn, "feature int, weight double, factors array<double>"), "machine")


def score_quality(docs: DataFrame, machine: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", score_col: str = "score",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (their columns ``keep``; none: all) with ``score_col``: the chance of label 1.

    Whole texts; null ones are empty, and those have a score too.  An input column named ``score_col`` is replaced.  Rows that repeat stay, each with the same score.
    """
    import numpy as np

    rows = machine.orderBy("feature").toArrow()  # as many for any corpus: BUCKETS and the bins
    if rows.num_rows:
        weights = rows.column("weight").to_numpy()
        factors = np.asarray(rows.column("factors").combine_chunks().flatten()).reshape(-1, FACTORS)[1:]
        bias, weights = float(weights[0]), weights[1:]
    else:  # nothing was learnt: one half for all
        bias, weights, factors = 0.0, np.zeros(FEATURES), np.zeros((FEATURES, FACTORS))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (s for batch in batches for s in slices_of(batch, SLICE)):
            if not b.num_rows:
                continue
            ptr, idx, val = sparse(b.column("_t").to_pylist(), b.column("_c").to_pylist())
            m, _, _ = margins(ptr, idx, val, bias, weights, factors)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(chance(m))], names=[*names, "_s"])

    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    names = [f"c{k}" for k in range(len(kept))]  # neutral names: any column may be called anything
    kinds = dict(docs.dtypes)
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(text_col).alias("_t"), _stored_chars(docs, chars_col).alias("_c"))
    schema = ", ".join([*[f"{n} {kinds[c]}" for c, n in zip(kept, names)], "_s double"])
    out = given.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], F.col("_s").alias(score_col))
