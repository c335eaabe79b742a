"""Hard-negative mining by threshold joins over a norm-bounded inverted index.

An anchor's row is scored by the integer inner product.  All that an anchor asks for
is a window: the first k rows with a score between a floor and a ceiling.  Its
positives are one window over the rows of its label; each positive opens another one
over the rows of other labels.  A threshold join finds the pairs that reach a score:

* the index takes a row's dimensions, the heaviest first, until the norm of the rest
  times the largest norm of an anchor's rest is below the threshold;
* rows are kept in order of how many dimensions they have in the index, so the posting
  list of a group of dimensions is a run of rows; partial scores are added up group by
  group, and rows that no anchor can lift to its threshold by the remaining norms leave;
* what is left is scored in full.

Windows that are not full after a join repeat it with a lower threshold, down to their
floor; full ones raise their threshold to their last score for the rows that follow.
Anchors are copied to blocks of rows and the other way round, blocks of bounded size.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import stored

#: Anchors that a task holds, anchors and rows that meet at a time, dimensions of a posting list.
ANCHORS, TILE, ROWS, GROUP = 16_384, 512, 4096, 8
#: Rows of a block; a smaller table has two blocks a shuffle partition, if they get as many rows as the second figure.
BLOCK_ROWS, LEAST_ROWS = 1_000_000, 512
#: First threshold as a share of the norms' product, what it is lowered by, and the share below which a window goes to its floor.
FIRST, LOWER, LEAST = 0.5, 0.6, 0.05
NONE = -(2**63)


# -- in a task -------------------------------------------------------------------------------------------------------------

def whole_numbers(vectors):
    """floor(256 x) of float rows as float64, or as int64 where sums of products may leave the exact range of doubles."""
    import numpy as np

    x = np.floor(256 * vectors.astype(np.float64))
    most = (np.abs(x).max(initial=0) ** 2) * max(x.shape[1], 1)
    if most >= 2**62:
        raise ValueError("a score may not fit a 64-bit integer")
    return x if most < 2**52 else x.astype(np.int64)


def threshold_join(a, x, t):
    """(i, j, score) of all pairs with a[i] . x[j] >= t[i], exactly; t: floats, -inf for all."""
    import numpy as np

    if not len(a) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if a.dtype != x.dtype:
        a, x = a.astype(np.int64), x.astype(np.int64)
    energy = np.square(x, dtype=np.float64)
    heavy = np.argsort(-energy.sum(0), kind="stable")
    a, x, energy = a[:, heavy], x[:, heavy], energy[:, heavy]
    cuts = [*range(0, a.shape[1], GROUP), a.shape[1]]

    def rests(squares):  # norms of the dimensions from each cut on, a little more than exact
        sums = [squares[:, c:].sum(1) for c in cuts]
        return np.sqrt(np.array(sums)) * (1 + 1e-9)

    xr, ar = rests(energy), rests(np.square(a, dtype=np.float64))
    least, steps = t.min(), len(cuts) - 1
    reach = xr[:steps] * ar[:steps].max(1)[:, None] >= least if least > 0 else np.ones((steps, len(x)), bool)
    depth = reach.sum(0)                                    # groups that the index holds of a row; 0: it cannot reach the threshold at all
    rows = np.argsort(-depth, kind="stable")
    rows = rows[:np.count_nonzero(depth)] if least > 0 else rows
    x, xr, depth = x[rows], xr[:, rows], depth[rows]
    acc = np.zeros((len(a), len(x)), a.dtype)
    for g in range(steps):
        n = int(np.searchsorted(-depth, -g, "left"))        # rows with this group: a run at the front
        if not n:
            break
        acc[:, :n] += a[:, cuts[g]:cuts[g + 1]] @ x[:n, cuts[g]:cuts[g + 1]].T
        if least > 0 and g + 1 < steps:
            open_ = np.ones(len(x), bool)
            open_[:n] = (acc[:, :n] + ar[g + 1][:, None] * xr[g + 1][None, :n] >= t[:, None]).any(0)
            if 4 * open_.sum() < 3 * len(x):
                rows, x, xr, depth, acc = rows[open_], x[open_], xr[:, open_], depth[open_], acc[:, open_]
    left = xr[depth, np.arange(len(x))]
    i, j = np.nonzero(acc + ar[depth].T * left[None, :] >= t[:, None])
    score = acc[i, j].astype(np.int64)
    part = np.flatnonzero(depth[j] < steps)                 # the index lacks dimensions of these: score them in full
    for at in range(0, len(part), 65_536):
        p = part[at:at + 65_536]
        score[p] = np.einsum("ij,ij->i", a[i[p]], x[j[p]]).astype(np.int64)
    ok = score >= t[i]
    return i[ok], rows[j[ok]], score[ok]


class Windows:
    """The first ``k`` rows of each window (owner: place of its anchor; floor <= score <= ceiling), by score and id."""

    def __init__(self, owner, floor, ceiling, k: int):
        import numpy as np

        self.owner, self.floor, self.ceiling, self.k = owner, floor, ceiling, k
        self.score = np.full((len(owner), k), NONE, np.int64)
        self.id = np.zeros((len(owner), k), np.int64)

    def take(self, w, score, row_id) -> None:
        """Add rows to windows ``w``."""
        import numpy as np

        last, last_id = self.score[w, -1], self.id[w, -1]
        better = (last == NONE) | (score > last) | (score == last) & (row_id < last_id)
        w, score, row_id = w[better], score[better], row_id[better]
        if not len(w):
            return
        touched = np.unique(w)
        held = self.score[touched]
        keep = held != NONE
        w = np.concatenate([w, np.repeat(touched, keep.sum(1))])
        score = np.concatenate([score, held[keep]])
        row_id = np.concatenate([row_id, self.id[touched][keep]])
        order = np.lexsort((row_id, -score, w))
        w, score, row_id = w[order], score[order], row_id[order]
        begin = np.flatnonzero(np.r_[True, np.diff(w) != 0])
        rank = np.arange(len(w)) - np.repeat(begin, np.diff(np.r_[begin, len(w)]))
        kept = rank < self.k
        self.score[w[kept], rank[kept]], self.id[w[kept], rank[kept]] = score[kept], row_id[kept]

    def meet(self, todo, a, a_id, a_label, x, x_id, x_label, same: bool) -> None:
        """Windows ``todo`` of anchors ``a`` meet a chunk of rows: joins with falling thresholds until all are full or at their floor."""
        import numpy as np

        if not len(todo) or not len(x):
            return
        norm = np.sqrt(np.square(a, dtype=np.float64).sum(1)) * np.sqrt(np.square(x, dtype=np.float64).sum(1).max())
        norm = norm[self.owner]
        full = self.score[:, -1] != NONE
        start = np.maximum(np.minimum(FIRST * norm, self.ceiling), self.floor)
        bar = np.nextafter(np.where(full, self.score[:, -1].astype(np.float64), start), -np.inf)  # never above the whole number meant
        while len(todo):
            owners, place = np.unique(self.owner[todo], return_inverse=True)
            t = np.full(len(owners), np.inf)
            np.minimum.at(t, place, bar[todo])
            i, j, score = threshold_join(a[owners], x, t)
            ok = (x_id[j] != a_id[owners][i]) if same else (x_label[j] != a_label[owners][i])
            i, j, score = i[ok], j[ok], score[ok]
            by_owner = np.argsort(place, kind="stable")     # the windows of one anchor are few: all pairs of pair and window of it
            counts = np.bincount(place, minlength=len(owners))
            ends = np.cumsum(counts)
            rounds = int(counts.max())
            w_all, s_all, id_all = [], [], []
            for k in range(rounds):
                has = counts[i] > k
                w = todo[by_owner[(ends - counts)[i[has]] + k]]
                s = score[has]
                fit = (s >= bar[w]) & (s <= self.ceiling[w]) & (s >= self.floor[w])
                w_all.append(w[fit])
                s_all.append(s[fit])
                id_all.append(x_id[j[has]][fit])
            w, s, ids = (np.concatenate(p) for p in (w_all, s_all, id_all))
            held = np.count_nonzero(self.score[todo] != NONE, axis=1)
            enough = held + np.bincount(w, minlength=len(self.owner))[todo] >= self.k
            done = enough | (bar[todo] <= self.floor[todo])
            ended = np.zeros(len(self.owner), bool)
            ended[todo[done]] = True
            self.take(w[ended[w]], s[ended[w]], ids[ended[w]])
            more = todo[~done]
            lower = LOWER * bar[more]
            bar[more] = np.where(lower > np.maximum(self.floor[more], LEAST * norm[more]), lower, np.nextafter(self.floor[more].astype(np.float64), -np.inf))
            todo = more


def _matrix(column):
    """An Arrow list column of equally long rows as a float matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _searcher(k: int, same: bool):
    """Rows of (block, anchor block, dimension) groups, anchors first, to the windows that the block fills."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        group, held, state = None, [], None

        def ready():
            cat = pa.concat_tables([pa.Table.from_batches([b]) for b in held]).combine_chunks()
            ids, labels = (cat.column(c).to_numpy() for c in ("id", "label"))
            windows = cat.column("windows").to_pylist()
            owner = np.array([n for n, w in enumerate(windows) for _ in w or ()], np.int64)
            low, high = (np.array([open_end if v[name] is None else v[name] for w in windows for v in w or ()], np.int64)
                         for name, open_end in (("floor", NONE + 1), ("ceiling", -NONE - 1)))
            number = np.array([v["number"] for w in windows for v in w or ()], np.int64)
            numbers = whole_numbers(_matrix(cat.column("vec").combine_chunks()))
            return ids, labels, numbers, cat.column("key").to_numpy(), Windows(owner, low, high, k), number

        def emptied():
            if state is None:
                return
            _, _, _, keys, windows, number = state
            w, rank = np.nonzero(windows.score != NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[windows.owner[w]]), pa.array(number[w], pa.int32()), pa.array(windows.id[w, rank]), pa.array(windows.score[w, rank])],
                names=["key", "number", "id", "score"])

        def meet(rows):
            ids, labels, a, _, windows, _ = state
            x_id, x_label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            x = whole_numbers(_matrix(rows.column("vec")))
            if same:
                parts = [(np.flatnonzero(labels == v), np.flatnonzero(x_label == v)) for v in np.intersect1d(labels, x_label)]
            else:
                parts = [(np.arange(len(ids)), np.arange(len(x)))]
            for mine, theirs in parts:
                for at in range(0, len(mine), TILE):
                    todo = np.flatnonzero(np.isin(windows.owner, mine[at:at + TILE]))
                    windows.meet(todo, a, ids, labels, x[theirs], x_id[theirs], x_label[theirs], same)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "share", "dim")], axis=1)
            is_row = batch.column("is_row").to_numpy(zero_copy_only=False)
            change = np.r_[True, (key[1:] != key[:-1]).any(1) | (is_row[1:] != is_row[:-1])]
            starts = np.flatnonzero(change).tolist()
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                if group != tuple(key[s]):
                    yield from emptied()
                    group, held, state = tuple(key[s]), [], None
                if not is_row[s]:
                    held.append(batch.slice(s, e - s))
                elif held or state is not None:
                    if state is None:
                        state, held = ready(), []
                    for at in range(s, e, ROWS):
                        meet(batch.slice(at, min(ROWS, e - at)))
        yield from emptied()

    return run


# -- over tables -----------------------------------------------------------------------------------------------------------

_WINDOWS = "array<struct<number:int,floor:bigint,ceiling:bigint>>"


def _filled(rows: DataFrame, asking: DataFrame, n_rows: int, n_anchors: int, k: int, same: bool) -> DataFrame:
    """key, number (of the window), id, score, rank: the first ``k`` rows of each window of ``asking`` (key, id, label, vec, dim, windows)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_rows // BLOCK_ROWS), min(2 * parts, n_rows // LEAST_ROWS))
    shares = max(1, -(-n_anchors // ANCHORS))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    none = F.lit(None)
    dealt = rows.select("id", "label", "vec", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), numbers(shares).alias("share"),
                        F.lit(True).alias("is_row"), none.cast("long").alias("key"), none.cast(_WINDOWS).alias("windows"))
    asked = asking.select("id", "label", "vec", "dim", numbers(blocks).alias("block"), F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int").alias("share"),
                          F.lit(False).alias("is_row"), "key", F.col("windows").cast(_WINDOWS).alias("windows"))
    order = ["block", "share", "dim"]
    met = asked.unionByName(dealt).repartition(parts, *order).sortWithinPartitions(*order, "is_row")
    local = met.mapInArrow(_searcher(k, same), "key long, number int, id long, score long")
    # a block gives k rows a window at most, so a window is ranked over blocks * k rows
    best = Window.partitionBy("key", "number").orderBy(F.col("score").desc(), "id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """id, label, vec, dim of the rows that take part: no null id, label, vector or component, all components finite, one at least."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("vec"), F.size(x).alias("dim")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.col("dim") > 0)).where(~bad)


def mine_hard_negatives(vectors: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                        id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: per anchor and positive its hardest allowed negatives.

    ``anchors``: a condition over ``id`` (none: every row is one).  A score is the inner product of floor(256 x); higher come
    first, ties by smaller id.  Positives are the first ``positives`` other rows of the label, negatives the first ``negatives`` rows of
    other labels with low % <= negative / positive <= high % (products, so a negative positive score has no negatives).  Exact:
    blocks of all rows meet all anchors, thresholds only skip what cannot enter a window.

    Rows with a null id, label, vector or component, a component that is not finite or no component take no part.  Vectors
    meet those of their own length.  Rows that repeat an id each count; a row with the anchor's id is never its positive.  An
    anchor that repeats in all columns is one.  Without rows or anchors the result is empty; other columns are not looked at.
    """
    rows = usable(vectors, id_col, label_col, vec_col)
    chosen = rows if anchors is None else rows.where(anchors)
    asking = stored(chosen.distinct().withColumn("key", F.monotonically_increasing_id()), "anchors")
    n_rows, n_anchors = rows.count(), asking.count()
    whole = F.array(F.struct(F.lit(0).alias("number"), F.lit(None).cast("long").alias("floor"), F.lit(None).cast("long").alias("ceiling")))
    found = stored(_filled(rows, asking.withColumn("windows", whole), n_rows, n_anchors, positives, True).select(
        "key", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = F.col("positive_score").cast("decimal(25,0)") / 100
    floor, ceiling = F.ceil(share * low).cast("long"), F.floor(share * high).cast("long")
    opened = found.where(floor <= ceiling).groupBy("key").agg(F.collect_list(F.struct("number", floor.alias("floor"), ceiling.alias("ceiling"))).alias("windows"))
    hard = _filled(rows, asking.join(opened, "key"), n_rows, n_anchors, negatives, False)
    named = hard.select("key", "number", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, ["key", "number"]).join(asking.select("key", F.col("id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
