"""Best-fit packing with swap-based local search.

Pieces are dealt into random groups of bounded size.  A group starts from best
fit (largest piece first, fullest bin that takes it) and then improves: single
moves, one-for-one, two-for-one and one-for-two exchanges carry tokens from an
emptier into a fuller bin, which increases the sum of squared fills, until the
emptiest bins run empty or nothing helps.  Bins that hold most of a group's
slack are opened again and their pieces meet those of other groups in a next
round, until one group is left.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import stored
from .tokens import encoder, slices_of

#: Pieces of a group on average, bins that give tokens in one pass of the search, and rounds after which all bins are closed.
GROUP, DONORS, ROUNDS = 20_000, 48, 8


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut only where longer than ``capacity``.

    Null text: the end id alone.  Repeated rows and null ids give pieces like any other.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for b in slices_of(batch):
                out = []
                for d, raw in zip(b.column(0).to_pylist(), code.encode(b.column(1).to_pylist())):
                    flat = raw + end
                    for p, at in enumerate(range(0, len(flat), 4 * capacity)):
                        part = flat[at:at + 4 * capacity]
                        out.append((d, p, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``: largest first, into the fullest bin with room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, []  # open_: bit r is set if a bin has r left
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        s = sizes[i]
        above = open_ >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        left = r - s
        if left:
            if not room[left]:
                open_ |= 1 << left
            room[left].append(b)
    return bins


def exchange(give: list[int], take: list[int], sizes: list[int], room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The exchange that carries most tokens (at most ``room``) from bin ``give`` into bin ``take``: (tokens, out of give, out of take)."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
    for k, x in enumerate(give):
        gain = sizes[x]
        if best[0] < gain <= room:
            best = (gain, (x,), ())
        for y in take:
            d = gain - sizes[y]
            if best[0] < d <= room:
                best = (d, (x,), (y,))
            for z in give[k + 1:]:
                e = d + sizes[z]
                if best[0] < e <= room:
                    best = (e, (x, z), (y,))
        for j, y in enumerate(take):
            for z in take[j + 1:]:
                d = gain - sizes[y] - sizes[z]
                if best[0] < d <= room:
                    best = (d, (x,), (y, z))
        if best[0] == room:
            break
    return best


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over underfull bins until as few bins are left as the total allows, or no exchange helps."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    live = len(bins)
    while live > least:
        under = sorted((f, b) for b, f in enumerate(fill) if 0 < f < capacity)
        moved = False
        for f, give in under[:DONORS]:
            for _, take in reversed(under):
                if not bins[give]:
                    break
                if take == give or not bins[take] or fill[take] < fill[give] or fill[take] == capacity:
                    continue
                tokens, out, back = exchange(bins[give], bins[take], sizes, capacity - fill[take])
                if tokens:
                    bins[give] = [i for i in bins[give] if i not in out] + list(back)
                    bins[take] = [i for i in bins[take] if i not in back] + list(out)
                    fill[give] -= tokens
                    fill[take] += tokens
                    moved = True
            if not bins[give]:
                live -= 1
            if live <= least:
                break
        if not moved:
            break
    return [b for b in bins if b]


def slack_bins(fills: list[int], capacity: int) -> set[int]:
    """The emptiest bins that together hold nine tenths of all slack, if that is enough to matter."""
    slack = sum(capacity - f for f in fills)
    out, seen = set(), 0
    for b in sorted(range(len(fills)), key=lambda k: fills[k]):
        if 10 * seen >= 9 * slack:
            break
        out.add(b)
        seen += capacity - fills[b]
    return out


def _packer(capacity: int, level: int, last: bool):
    def run(table):
        import pyarrow as pa

        sizes = table.column("length").to_pylist()
        bins = improve(best_fit(sizes, capacity), sizes, capacity)
        again = set() if last else slack_bins([sum(sizes[i] for i in b) for b in bins], capacity)
        row, number, offset = [], [], []
        base = (level << 56) + (table.column("_group")[0].as_py() << 20)
        for k, b in enumerate(bins):
            at = 0
            for i in sorted(b):
                row.append(i)
                number.append(-1 if k in again else base + k)
                offset.append(at)
                at += sizes[i]
        out = table.drop_columns(["_group"]).take(pa.array(row, pa.int64()))
        return out.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pieces (with a column ``length``, at most ``capacity``) with sequence_id and offset.  Empty table: no rows.

    No group ever holds more than a bounded number of pieces, whatever the table's size; equal pieces are dealt by a running
    number, so thousands of copies spread.  The numbering is written out first: a task that runs again packs the same pieces.
    """
    names = pieces.columns
    left = stored(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    total, done, level = left.count(), [], 0
    kinds = ", ".join(f"`{c}` {k}" for c, k in left.dtypes)
    while True:
        groups = max(1, -(-total // GROUP))
        last = groups == 1 or level == ROUNDS
        dealt = left.withColumn("_group", F.pmod(F.xxhash64(F.lit(level), "_at"), F.lit(groups)))

        packed = stored(dealt.groupBy("_group").applyInArrow(_packer(capacity, level, last), f"{kinds}, sequence_id long, offset long"), f"packed-{level}")
        done.append(packed.where("sequence_id >= 0"))
        if last:
            break
        left = packed.where("sequence_id < 0").drop("sequence_id", "offset")
        total, level = left.count(), level + 1
        if not total:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces_of(docs, tokenizer, end_id, capacity, id_col, text_col), capacity)
