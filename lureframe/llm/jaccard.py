"""Exact Jaccard links within candidate groups of any size, without pairs as rows.

A group is dealt into blocks of bounded size.  A task walks its block: a member takes
all that are similar enough and not yet taken, those take further ones, and so on; a pair
within one cluster is never tested twice, and a cluster comes out as links to its first
member.  The most typical member of a cluster stands for it in a block of the next round,
so most clusters of a group that fills many blocks grow together there.  Members of clusters that
are still apart then meet all other members of their group, block by block.  What no
task has tested is a pair within one cluster, where a link would tell nothing new.

Sizes and wide SimHash fingerprints are compared before any set is opened.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import if_small, stored
from .components import components

#: Members, and shingles of theirs, that a task compares with one another.
BLOCK_MEMBERS, BLOCK_SHINGLES = 4096, 4_000_000
#: Bits of the wide fingerprint that similar members differ in at most.
BITS = 48
PRINTS = ("f0", "f1", "f2")
SCHEMA = ("node", "n", *PRINTS, "shingles")


class Block:
    """Members as numpy columns: node, n, prints, and shingles numbered within the block."""

    def __init__(self, batches: list):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(batches).combine_chunks()
        node = t.column("node").to_numpy()
        _, first = np.unique(node, return_index=True)            # rows that repeat a member: one
        t = t.take(pa.array(first)) if len(first) < len(node) else t
        self.table = t
        self.node, self.n = t.column("node").to_numpy(), t.column("n").to_numpy()
        self.prints = [t.column(c).to_numpy().view(np.uint64) for c in PRINTS]
        lists = t.column("shingles").combine_chunks()
        self.starts = np.r_[0, np.cumsum(self.n)]
        self.hashes = lists.flatten().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.node)

    def near(self, x: int, other: "Block", among, similarity: float):
        """Of ``among`` (places in ``other``) those whose size and fingerprint allow the similarity with member x."""
        import numpy as np

        n, m = self.n[x], other.n[among]
        among = among[np.minimum(n, m) >= similarity * np.maximum(n, m)]
        d = sum(np.bitwise_count(self.prints[k][x] ^ other.prints[k][among]).astype(np.uint16) for k in range(len(PRINTS)))
        return among[d <= BITS]

    def shingles(self, x: int):
        return self.hashes[self.starts[x]:self.starts[x + 1]]

    def shared(self, among, numbers, mark):
        """How many shingles of each member of ``among`` are marked."""
        import numpy as np

        sizes = self.n[among]
        ends = np.cumsum(sizes)
        take = np.repeat(self.starts[among] - (ends - sizes), sizes) + np.arange(ends[-1])
        return np.add.reduceat(mark[numbers[take]], ends - sizes)


def _alike(block: Block, numbers, mark, mine, n: int, among, similarity: float):
    """Of ``among`` those that reach the similarity with a set of ``n`` shingles, of which ``mine`` have a number in the block."""
    if not len(among):
        return among
    mark[mine] = 1
    both = block.shared(among, numbers, mark)
    mark[mine] = 0
    return among[both >= similarity * (n + block.n[among] - both)]


def clusters(block: Block, similarity: float):
    """Place of the first member of each member's cluster, and places of one typical member of each cluster."""
    import numpy as np

    kinds, numbers = np.unique(block.hashes, return_inverse=True)
    numbers = numbers.astype(np.int32)
    mark, label = np.zeros(len(kinds), np.int32), np.full(len(block), -1)
    open_ = np.ones(len(block), bool)
    for seed in range(len(block)):
        if not open_[seed]:
            continue
        label[seed], open_[seed], queue = seed, False, [seed]
        while queue:
            left = np.flatnonzero(open_)
            if not len(left):
                break
            x = queue.pop()
            mine = numbers[block.starts[x]:block.starts[x + 1]]
            hit = _alike(block, numbers, mark, mine, block.n[x], block.near(x, block, left, similarity), similarity)
            label[hit], open_[hit] = seed, False
            queue += hit.tolist()
    label[label < 0] = np.flatnonzero(label < 0)
    typical = []
    for first in np.unique(label):
        places = np.flatnonzero(label == first)
        if len(places) > 2:
            take = np.concatenate([np.arange(block.starts[p], block.starts[p + 1]) for p in places])
            count = np.bincount(numbers[take], minlength=len(kinds))
            score = [count[numbers[block.starts[p]:block.starts[p + 1]]].mean() for p in places]
            typical.append(places[int(np.argmax(score))])
        else:
            typical.append(first)
    return label, np.array(typical, np.int64)


def _groups_of(batches: Iterator, keys: list[str]) -> Iterator:
    """(key, parts of the batches) of a partition sorted by the keys; parts of one key come in a row."""
    import numpy as np

    for batch in batches:
        if batch.num_rows:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]).tolist()
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                yield tuple(key[s].tolist()), batch.slice(s, e - s)


def _dealt(members: DataFrame) -> DataFrame:
    """The members with blocks (of their group) and block."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    many = stored(sizes.select("grp", blocks.alias("blocks")).where("blocks > 1"), "blocks")  # groups of more than one block are few
    dealt = members.join(if_small(many), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _block_clusters(dealt: DataFrame, similarity: float) -> DataFrame:
    """grp, blocks, node, root (first node of the cluster within the block), typical."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def solved(held):
            block = Block(held)
            label, typical = clusters(block, similarity)
            shown = np.zeros(len(block), bool)
            shown[typical] = True
            return pa.RecordBatch.from_arrays(
                [block.table.column("grp").combine_chunks(), block.table.column("blocks").combine_chunks(), pa.array(block.node), pa.array(block.node[label]), pa.array(shown)],
                names=["grp", "blocks", "node", "root", "typical"])

        at, held = None, []
        for key, part in _groups_of(batches, ["grp", "block"]):
            if key != at and held:
                yield solved(held)
                held = []
            at = key
            held.append(part)
        if held:
            yield solved(held)

    kept = dealt.select("grp", "blocks", "block", *SCHEMA)
    return kept.repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(
        run, "grp long, blocks int, node long, root long, typical boolean")


def _meet(asking: DataFrame, dealt: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between members of different clusters; each member of ``asking`` meets all of its group.

    Both have cluster; a task has a block of either side and emits no more links than join its clusters.
    """
    shares = stored(asking.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("shares")), "shares")
    few = if_small(shares)
    q = asking.join(few, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"),
                                       F.lit(0).alias("side"), "cluster", *SCHEMA)
    m = dealt.join(few, "grp").select("grp", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(1).alias("side"), "cluster", *SCHEMA)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, held, state = None, [], None

        def ready():
            block = Block(held)
            kinds, numbers = np.unique(block.hashes, return_inverse=True)
            return block, block.table.column("cluster").to_numpy(), kinds, numbers.astype(np.int32), np.zeros(len(kinds), np.int32), {}

        def compare(part):
            block, mine, kinds, numbers, mark, up = state
            other = Block([part])
            theirs = other.table.column("cluster").to_numpy()

            def top(c):
                while c in up:
                    c = up[c]
                return c

            a, b = [], []
            for y in range(len(other)):
                home = top(int(theirs[y]))
                apart = np.array([top(int(c)) != home for c in np.unique(mine)])
                far = np.flatnonzero(np.isin(mine, np.unique(mine)[apart]))
                near = other.near(y, block, far, similarity)
                if not len(near):
                    continue
                own = other.shingles(y)
                place = np.searchsorted(kinds, own).clip(max=len(kinds) - 1)
                hit = _alike(block, numbers, mark, place[kinds[place] == own], other.n[y], near, similarity)
                for x in hit.tolist():
                    c = top(int(mine[x]))
                    if c != home:
                        up[c] = home
                        a.append(int(block.node[x]))
                        b.append(int(other.node[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for key, part in _groups_of(batches, ["grp", "block", "share", "side"]):
            if key[:3] != at:
                at, held, state = key[:3], [], None
            if key[3] == 0:
                held.append(part)
            elif held or state:
                if state is None:
                    state, held = ready(), []
                for s in range(0, part.num_rows, 512):
                    yield compare(part.slice(s, 512))

    order = ["grp", "block", "share"]
    return q.unionByName(m).repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(run, "a long, b long")


def jaccard_groups(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: links whose components are those of all pairs of one group that reach ``similarity``.

    ``members``: grp, node, n, f0, f1, f2, shingles (n ascending distinct 64-bit hashes, one at least).  A member that
    stands in several rows counts once.  A link has a Jaccard similarity of ``similarity`` or joins a member to the first
    of a cluster of such links.
    """
    dealt = _dealt(members)
    found = stored(_block_clusters(dealt, similarity), "clusters")
    joined = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    # groups of one block are done; of the others the typical members meet, as long as that leaves fewer
    typical = found.where("blocks > 1 and typical").select("grp", "node")
    left = typical.count()
    if not left:
        return joined
    while True:
        again = _dealt(members.join(if_small(stored(typical, "typical")), ["grp", "node"], "left_semi"))
        found = stored(_block_clusters(again, similarity), "clusters")
        joined = joined.unionByName(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        typical = found.where("blocks > 1 and typical").select("grp", "node")
        now = typical.count()
        if not now or now > 0.9 * left:
            break
        left = now
    roots = stored(components(joined), "roots")
    labelled = dealt.where("blocks > 1").join(roots.withColumnRenamed("root", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    counts = stored(labelled.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("rows")), "counts")
    largest = stored(counts.groupBy("grp").agg(F.max_by("cluster", F.struct("rows", "cluster")).alias("cluster")), "largest")
    rest = stored(counts.join(if_small(largest), ["grp", "cluster"], "left_anti").select("grp", "cluster"), "rest")
    if not rest.head(1):
        return joined
    asking = stored(labelled.join(if_small(rest), ["grp", "cluster"], "left_semi"), "asking")
    more = stored(_meet(asking, labelled.join(if_small(stored(rest.select("grp").distinct(), "open")), "grp", "left_semi"), similarity), "more")
    return joined.unionByName(more)
