"""SimHash near-duplicates by anchor points.

A fingerprint is cut into pieces of 2^r - 1 bits.  The anchors of a piece are the
words of the Hamming code of that length, a perfect covering code of radius 1.
Two fingerprints that differ in at most 2 * pieces - 1 bits differ in at most one
bit of some piece.  So with threshold 1 on a piece, every fingerprint is
replicated to all anchors within radius + threshold = 2 of its piece, and each
pair meets at the anchor that covers one of them (its home).  Homes are compared
with the visitors of their anchor.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from .common import if_small, row_keys, stored
from .components import components
from .jaccard import jaccard_groups
from .tokens import slices_of

#: Homes of one anchor that a task compares; an anchor with more is dealt to several tasks.
HOMES = 1024
#: Visitors compared at a time.
VISITORS = 4096


# -- fingerprints --------------------------------------------------------------------------------------------------------

def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles of the text with A-Z lower-cased, repeats included; a shorter text is one shingle, an empty one has none."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[k:] for k in range(width)])))


def shingle_set(text: str, width: int):
    """The distinct shingles of a text as ascending 64-bit hashes."""
    import numpy as np
    import xxhash

    cut = set(shingles(text, width))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in cut), np.uint64, len(cut)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(hashes, words: int = 1) -> list[int]:
    """Majority bits of unsigned 64-bit hashes, as signed 64-bit words; further words come from remixed hashes."""
    import numpy as np

    out = []
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for k in range(words):
        h = hashes
        if k:  # a fixed bijection per word
            h = (hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        n = len(h)
        if not n:
            out.append(0)
            continue
        by_byte = h.astype("<u8").view(np.uint8).reshape(n, 8)
        if n < 200:
            ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            ones = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ bits for j in range(8)])
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, text_col: str = "text", keep: Sequence[str] = (),
                 distinct: bool = False) -> DataFrame:
    """``keep`` columns, n (shingles) and f0, f1 ...: one pass over whole texts (null: empty, fingerprint zero).

    Shingles that repeat count as often as they stand, or once with ``distinct``, which adds s1, s2: a digest of the set.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in (s for batch in batches for s in slices_of(batch, 512)):
            rows, sizes = [], []
            for text in b.column("_text").to_pylist():
                if distinct:
                    hashes = shingle_set(text, width)
                else:
                    hashes = np.array([digest(s, 42) for s in shingles(text, width)], np.uint64)
                sizes.append(len(hashes))
                rows.append(fingerprint(hashes, words) + ([signed(digest(hashes.tobytes(), seed)) for seed in (1, 2)] if distinct else []))
            arrays = [b.column(c) for c in keep] + [pa.array(sizes, pa.int64())]
            arrays += [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(made))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n", *made])

    kinds = dict(docs.dtypes)
    made = [f"f{k}" for k in range(words)] + (["s1", "s2"] if distinct else [])
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n long", *[f"{c} long" for c in made]])
    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, schema)


# -- anchors -------------------------------------------------------------------------------------------------------------

def syndrome(x, r: int):
    """Of each piece of 2^r - 1 bits: 0 for an anchor, else 1 + the bit whose flip makes it one."""
    import numpy as np

    out = np.zeros(len(x), np.int64)
    for k in range(r):
        mask = sum(1 << i for i in range(2**r - 1) if (i + 1) >> k & 1)
        out |= (np.bitwise_count(x & np.uint64(mask)).astype(np.int64) & 1) << k
    return out


def flips(r: int):
    """By syndrome: masks that lead to every anchor within distance 2, the home first (an anchor's nearest other is 3 away)."""
    import numpy as np

    n = 2**r - 1
    table = np.zeros((n + 1, 1 + (n - 1) // 2), np.uint64)
    for s in range(1, n + 1):
        pairs = [(1 << a - 1) | (1 << (a ^ s) - 1) for a in range(1, n + 1) if a != s and a < a ^ s]
        table[s] = [1 << s - 1, *pairs]
    return table


def piece(f, k: int, r: int):
    """Bits k * (2^r - 1) and up of the fingerprint words ``f`` (uint64 arrays)."""
    import numpy as np

    size = 2**r - 1
    at, shift = divmod(k * size, 64)
    x = f[at] >> np.uint64(shift)
    if shift + size > 64:
        x = x | (f[at + 1] << np.uint64(64 - shift))
    return x & np.uint64((1 << size) - 1)


def anchor_rows(points: DataFrame, words: int, r: int, homes_only: bool = False) -> DataFrame:
    """bucket (piece and anchor), home, node, n, f0 ...: each point at its home and, unless ``homes_only``, at all anchors in reach."""
    pieces = 64 * words // (2**r - 1)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = flips(r)
        names = ["node", "n", *[f"f{k}" for k in range(words)]]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
                f = [c.astype(np.int64).view(np.uint64) for c in cols[2:2 + words]]
                parts = []
                for k in range(pieces):
                    x = piece(f, k, r)
                    s = syndrome(x, r)
                    to = x[:, None] ^ table[s][:, :1] if homes_only else x[:, None] ^ table[s]
                    use = np.ones(to.shape, bool)
                    use[s == 0, 1:] = False
                    row, col = np.nonzero(use)
                    parts.append(((to[row, col] + np.uint64(k << (2**r - 1))).astype(np.int64), col == 0, row))
                bucket, home, row = (np.concatenate(p) for p in zip(*parts))
                arrays = [pa.array(bucket), pa.array(home)] + [pa.array(c[row].astype(np.int64)) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "home", *names])

    schema = "bucket long, home boolean, node long, n long, " + ", ".join(f"f{k} long" for k in range(words))
    return points.mapInArrow(run, schema)


def forest(i, j, w, size: int):
    """Indices of the edges (i, j) of a spanning forest of least weight over ``size`` nodes."""
    import numpy as np

    order = np.argsort(w, kind="stable")
    i, j = i[order], j[order]
    rank = np.arange(len(i))
    label = np.arange(size)
    chosen = []
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, rank, a, b = i[apart], j[apart], rank[apart], a[apart], b[apart]
        if not len(i):
            break
        best = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        picks = np.unique(best[best < np.iinfo(np.int64).max])
        at = np.searchsorted(rank, picks)
        chosen.append(picks)
        up = np.arange(size)
        for x, y in zip(a[at].tolist(), b[at].tolist()):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


def links(points: DataFrame, words: int, r: int, threshold: int, least_ratio: float = 0.0) -> DataFrame:
    """a, b: links between points (node, n, f0 ...) that meet at an anchor and differ in at most ``threshold`` bits.

    Per anchor and block only a spanning forest of the links comes out, nearest first: the same components, no lists of all
    pairs.  With ``least_ratio`` the smaller n must be that share of the larger.  Every link within 2 * pieces - 1 bits is
    found; links further apart are found with the chance that some piece differs in at most one bit.
    """
    heavy = stored(anchor_rows(points, words, r, homes_only=True).groupBy("bucket").agg(F.count(F.lit(1)).alias("homes"))
                   .where(F.col("homes") > HOMES).select("bucket", F.ceil(F.col("homes") / HOMES).cast("int").alias("cuts")), "heavy")
    rows = anchor_rows(points, words, r).join(heavy, "bucket", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    salt = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("cuts") - 1))
    # a home is a visitor of its own anchor as well, at every cut
    names = ["node", "n", *[f"f{k}" for k in range(words)]]
    dealt = rows.select("bucket", *names, F.explode(F.concat(
        F.transform(salt, lambda s: F.struct(F.col("home").alias("home"), s.alias("cut"))),
        F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda s: F.struct(F.lit(False).alias("home"), s.alias("cut"))))
        .otherwise(F.expr("cast(array() as array<struct<home:boolean,cut:int>>)")))).alias("e")).select("bucket", "e.*", *names)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "bucket", "cut").sortWithinPartitions("bucket", "cut", F.col("home").desc(), "n")
    return ordered.mapInArrow(_linker(words, threshold, least_ratio), "a long, b long").distinct()


def _linker(words: int, threshold: int, least_ratio: float):
    names = ["node", "n", *[f"f{k}" for k in range(words)]]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        homes: list = []       # columns of the homes of the group at hand
        group, ready = None, None

        def compare(visitors):
            nodes, sizes = ready[0], ready[1]
            for at in range(0, len(visitors[0]), VISITORS):
                v = [c[at:at + VISITORS] for c in visitors]
                lo, hi = 0, len(nodes)
                if least_ratio:
                    lo = np.searchsorted(sizes, np.floor(v[1].min() * least_ratio))
                    hi = np.searchsorted(sizes, np.ceil(v[1].max() / least_ratio), "right")
                ii, jj, ww = [], [], []
                for h in range(lo, hi, 256):
                    end = min(h + 256, hi)
                    d = np.bitwise_count(ready[2][h:end, None] ^ v[2][None, :]).astype(np.uint16)
                    for k in range(1, words):
                        d += np.bitwise_count(ready[2 + k][h:end, None] ^ v[2 + k][None, :])
                    near = (d <= threshold) & (nodes[h:end, None] != v[0][None, :])
                    a, b = np.nonzero(near)
                    if least_ratio and len(a):
                        x, y = sizes[h:end][a], v[1][b]
                        ok = np.minimum(x, y) >= least_ratio * np.maximum(x, y)
                        a, b = a[ok], b[ok]
                    ii.append(a + h)
                    jj.append(b)
                    ww.append(d[a, b])
                if not ii or not sum(map(len, ii)):
                    continue
                i, j, w = nodes[np.concatenate(ii)], v[0][np.concatenate(jj)], np.concatenate(ww)
                known, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                kept = forest(place[:len(i)], place[len(i):], w, len(known))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)[kept]), pa.array(np.maximum(i, j)[kept])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, cut = batch.column("bucket").to_numpy(), batch.column("cut").to_numpy()
            home = batch.column("home").to_numpy(zero_copy_only=False)
            cols = [batch.column(c).to_numpy() for c in names]
            cols = cols[:2] + [c.view(np.uint64) for c in cols[2:]]
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (cut[1:] != cut[:-1]) | (home[1:] != home[:-1])])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                if group != (bucket[s], cut[s]):
                    group, homes, ready = (bucket[s], cut[s]), [], None
                here = [c[s:e] for c in cols]
                if home[s]:
                    homes.append(here)
                elif homes:
                    if ready is None:
                        ready = [np.concatenate(c) for c in zip(*homes)]
                    yield from compare(here)

    return run


# -- what callers use ----------------------------------------------------------------------------------------------------

def fingerprint_components(docs: DataFrame, width: int = 3, threshold: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row: components of 64-bit fingerprints within ``threshold`` (3 at most).

    Exact.  Documents meet by fingerprint: equal ones are one point from the start.  component_id is the smallest id of a
    component (nulls do not count).  Empty and null texts have fingerprint zero and link like any other.  Repeated rows stay.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("two pieces of 31 bits cover 3 differing bits")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(rows, width, keep=["doc_id"]).select("doc_id", "f0"), "prints")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = stored(prints.groupBy("f0").agg(F.min("doc_id").alias("first")).repartition(parts, "f0"), "points")  # many tasks make anchor rows
    found = links(points.select(F.col("f0").alias("node"), F.lit(0).cast("long").alias("n"), "f0"), 1, 5, threshold)
    roots = components(found)
    named = points.join(roots, points["f0"] == roots["node"], "left").select("f0", "first", F.coalesce("root", "f0").alias("root"))
    named = stored(named, "roots")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(ids, "root").select("f0", "component_id")
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return prints.join(of, "f0").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _shingled(asked: DataFrame, width: int) -> DataFrame:
    """grp, node, n, f0 ..., shingles (ascending hashes) of texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in (s for batch in batches for s in slices_of(batch, 256)):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            prints = [fingerprint(x, WIDE) for x in sets]
            sizes = [len(x) for x in sets]
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("grp"), b.column("node"), pa.array(sizes, pa.int64()), *[pa.array([p[k] for p in prints], pa.int64()) for k in range(WIDE)], lists],
                names=["grp", "node", "n", *[f"f{k}" for k in range(WIDE)], "shingles"])

    return asked.mapInArrow(run, "grp long, node long, n long, " + ", ".join(f"f{k} long" for k in range(WIDE)) + ", shingles array<long>")


#: The wide fingerprint of ``near_duplicates``: words, bits differing at most (texts of Jaccard 0.8 differ in 29 of 192 on average), 15-bit pieces.
WIDE, WIDE_BITS, WIDE_R = 3, 48, 4


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2 (key of the text), first (smallest id with that text), kept_k1, kept_k2: the text that stands for its group.

    Equal texts are one from the start, then texts of equal shingle sets.  Wide SimHash fingerprints of distinct word shingles
    propose links over anchors of 15-bit pieces; their components are candidate groups.  Within each, members are linked by
    the exact Jaccard similarity of their sets (``jaccard_groups``), and the components of the links that pass are the groups.
    The text with the smallest id stands for a group (ties and null ids: by key).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        *row_keys("text"), "doc_id", "text")
    fs = [f"f{k}" for k in range(WIDE)]
    seen = fingerprints(rows, width, WIDE, keep=["k1", "k2", "doc_id"], distinct=True)
    texts = stored(seen.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", *fs, "s1", "s2")])
                   .withColumns({s: F.when(F.col("n") > 0, F.col(s)).otherwise(F.col(k)) for s, k in (("s1", "k1"), ("s2", "k2"))}), "texts")  # no words, no set
    one = F.min(F.struct("k1", "k2", "first")).alias("one")
    points = stored(texts.groupBy("s1", "s2").agg(one, *[F.first(c).alias(c) for c in ("n", *fs)])
                    .withColumn("node", F.monotonically_increasing_id()), "points")
    proposed = stored(links(points.where("n > 0").select("node", "n", *fs), WIDE, WIDE_R, WIDE_BITS, similarity), "proposed")
    groups = stored(components(proposed), "candidates")
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())  # a root is a member too
    chosen = stored(points.join(groups, "node").select("node", F.col("root").alias("grp"), "one.*"), "chosen")
    # one row of each chosen text has its shingles read; of rows that repeat it the tasks below drop all but one
    asked = rows.join(if_small(chosen), ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("first"))).select("grp", "node", "text")
    members = stored(_shingled(asked, width), "members")
    roots = stored(components(jaccard_groups(members, similarity)), "roots")
    named = texts.join(points.select("s1", "s2", "node"), ["s1", "s2"]).join(roots, "node", "left").select(
        "k1", "k2", "first", F.coalesce("root", "node").alias("root"))
    named = stored(named, "roots")
    order = F.struct(F.col("first").isNull(), F.col("first"), F.col("k1"), F.col("k2"))
    best = named.groupBy("root").agg(F.min_by(F.struct("k1", "k2", "first"), order).alias("keep"))
    return named.join(best, "root").select("k1", "k2", "first", F.col("keep.k1").alias("kept_k1"), F.col("keep.k2").alias("kept_k2"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, columns unchanged: the smallest id; of rows that repeat it, one.

    Null and empty texts are equal texts.
    """
    groups = near_duplicates(docs, width, similarity, id_col, text_col).where("k1 = kept_k1 and k2 = kept_k2").select("k1", "k2", "first")
    groups = if_small(stored(groups, "groups"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), *[F.xxhash64(F.lit(s), text).alias(k) for s, k in ((1, "k1"), (2, "k2"))])
    same = keyed.join(groups, ["k1", "k2"]).where(F.col(f"row.{id_col}").eqNullSafe(F.col("first")))
    # rows that share both id and text are rare: only their keys are counted, only they are reduced
    twice = stored(same.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("k1", "k2"), "twice")
    once = same.join(twice, ["k1", "k2"], "left_anti").select("row.*")
    return once.unionByName(same.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*"))
