"""Operators over documents against brute force, with null, empty, long, tied and repeated rows."""
import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lureframe.llm import decontaminate as dc, packing, quality, sharding, simhash, substring_dedup as sd, suffix_tree_lm as lm, token_files
from lureframe.llm.common import shared_path

SMALL = [None, "", " \n\t ", "one", "two words", "two words", "a b\nc d\na b\n", "é É x́"]


def columns_kept(out, docs):
    assert out.columns == docs.columns


# -- 4 ---------------------------------------------------------------------------------------------------------------------

def quality_of(t):
    t = t or ""
    w = t.encode().split()
    lines = [x for x in t.split("\n") if x.encode().split()]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i:i + 8])].append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_filter(make, words):
    clean = " ".join(words(1, 60))
    texts = [*SMALL, clean, "w " * 7, "w " * 8, "w " * 9, "a b c d e f g h i " * 2, clean + " " + clean, " ".join(f"{x}***" for x in words(2, 40)),
             clean.upper(), "\n".join(["same line here"] * 4 + words(3, 30)), " ".join(words(4, 30_000)), clean]
    docs = make(texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.measured(docs.select("doc_id", "text"), names=names, keep=["doc_id"]).collect():
        assert tuple(r[1:]) == quality_of(texts[r["doc_id"]]), texts[r["doc_id"]]
    out = quality.quality_filter(docs)
    columns_kept(out, docs)
    kept = {r["doc_id"] for r in out.collect()}
    bad = {i for i, t in enumerate(texts) for n, chars, sym, dup, rep in [quality_of(t)] if (
        n < 20 or 100 * rep > 30 * n or 10 * sym > 3 * n or not 2 * n <= chars <= 14 * n
        or 10 * sum(c.isupper() for c in t) > 6 * chars or 10 * dup > 3 * len([x for x in t.split("\n") if x.split()]))}
    assert kept == set(range(len(texts))) - bad and 8 in kept and len(texts) - 1 in kept
    assert quality.quality_filter(make([])).count() == 0


def test_cascade_order_follows_worth_and_does_not_change_the_verdict(make, words):
    docs = make([" ".join(words(k, 15 + k)) for k in range(20)])
    order = quality.measure_rules(docs)
    assert [m.worth for m in order] == sorted((m.worth for m in order), reverse=True) and {m.rule for m in order} == set(quality.RULES)
    one = {r[0] for r in quality.quality_filter(docs, quality.RULES).select("doc_id").collect()}
    assert one == {r[0] for r in quality.quality_filter(docs, quality.RULES[::-1]).select("doc_id").collect()}


# -- 5 ---------------------------------------------------------------------------------------------------------------------

def groups_of(points, linked):
    up = {p: p for p in points}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, p in enumerate(points):
        for q in points[:i]:
            if linked(p, q):
                a, b = root(p), root(q)
                up[max(a, b)] = min(a, b)
    return {p: root(p) for p in points}


@pytest.mark.parametrize("homes", [1024, 3])
def test_every_link_of_fingerprints_is_found(spark, monkeypatch, homes):
    monkeypatch.setattr(simhash, "HOMES", homes)
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 8, dtype=np.uint64)
    prints = {int(x) for x in base} | {0}
    for x in base:
        for _ in range(25):
            y = int(x)
            for bit in r.choice(64, r.integers(1, 5), replace=False):
                y ^= 1 << int(bit)
            prints.add(y)
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    points = spark.createDataFrame([(p, 0, p) for p in signed], "node long, n long, f0 long").repartition(3)
    found = {tuple(x) for x in simhash.links(points, 1, 5, 3).collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    assert all(near(a, b) for a, b in found)
    from lureframe.llm.components import components

    got = {x["node"]: x["root"] for x in components(simhash.links(points, 1, 5, 3)).collect()}
    assert {p: got.get(p, p) for p in signed} == groups_of(signed, near)


def test_fingerprint_components(make, words):
    text = " ".join(words(1, 300))
    texts = [*SMALL, text, text, text.replace(words(1, 300)[7], "new", 1), text.upper(), " ".join(words(2, 300)), "y " * 40_000]
    rows = simhash.fingerprint_components(make(texts, [i + 10 for i in range(len(texts))])).collect()
    assert len(rows) == len(texts)
    import xxhash

    def of(t):
        h = [xxhash.xxh64_intdigest(s, 42) for s in simhash.shingles(t or "", 3)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i + 10: of(t) for i, t in enumerate(texts)}
    want = groups_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert simhash.fingerprint_components(make([])).count() == 0
    twice = simhash.fingerprint_components(make(["a b c", "a b c", "x"], [3, 3, None])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in twice)[:2] == [(False, 3, 3)] * 2 and len(twice) == 3


def test_near_duplicates(make, words):
    base = words(3, 200)
    copies = []
    for k in range(12):
        w = list(base)
        w[10 + 9 * k] = "changed"
        copies.append(" ".join(w))
    other = [" ".join(words(100 + k, 80)) for k in range(10)]
    texts = [*other, *copies, " ".join(base), " ".join(base), None, "", " "]
    docs = make(texts)
    out = simhash.drop_near_duplicates(docs)
    columns_kept(out, docs)
    sets = [set(simhash.shingles(t or "", 5)) for t in texts]
    want = groups_of(list(range(len(texts))), lambda a, b: (texts[a] or "") == (texts[b] or "") or (
        bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(want.values()))
    assert simhash.drop_near_duplicates(make([])).count() == 0
    assert simhash.drop_near_duplicates(make(["a b", "a b", "a b"], [1, 1, None])).count() == 1


def test_near_duplicates_of_templates_are_all_found(make, words):
    texts = []  # most pairs of a group lie just below 0.8, a few above: a forest alone loses those
    for g in range(6):
        r = np.random.default_rng(g)
        base = [f"w{x}" for x in r.integers(0, 10**6, 290)]
        for k in range(40):
            w = list(base)
            for slot in r.choice(40, 4, replace=False):
                w[7 * slot + 5] = f"x{g}y{k}z{slot}"
            texts.append(" ".join(w))
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    want = groups_of(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert 6 < len(set(want.values())) < len(texts)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(make(texts)).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("members, loose", [(4096, False), (7, False), (7, True)])
def test_links_within_groups_against_brute_force(spark, monkeypatch, members, loose):
    from lureframe.llm import jaccard
    from lureframe.llm.components import components

    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    r = np.random.default_rng(3)
    sets, grp = [], []
    for g, size in enumerate([60, 40, 12, 2, 1]):
        base = r.integers(-2**62, 2**62, 120)
        chain = base.copy()
        for k in range(size):
            if g == 1:                                   # a chain: each is near the one before it alone
                chain = np.r_[chain[12:], r.integers(-2**62, 2**62, 12)]
                sets.append(np.unique(chain))
            else:                                        # a template: pairs lie around 0.8, or (loose) well below it
                keep = r.choice(120, 92 if loose else 112, replace=False)
                sets.append(np.unique(np.r_[base[keep], r.integers(-2**62, 2**62, 120 - len(keep))]))
            grp.append(g)
    rows = []
    for k, (g, s) in enumerate(zip(grp, sets)):
        s = np.sort(s.astype(np.int64).view(np.uint64))
        rows.append((g, k * 11, len(s), *simhash.fingerprint(s, simhash.WIDE), s.view(np.int64).tolist()))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "grp long, node long, n long, f0 long, f1 long, f2 long, shingles array<long>").repartition(3)
    found = jaccard.jaccard_groups(df, 0.8)
    assert found.count() <= 2 * len(sets)
    got = {x["node"]: x["root"] for x in components(found).collect()}
    as_sets = [set(s.tolist()) for s in sets]
    near = lambda a, b: grp[a // 11] == grp[b // 11] and len(as_sets[a // 11] & as_sets[b // 11]) >= 0.8 * len(as_sets[a // 11] | as_sets[b // 11])
    nodes = [k * 11 for k in range(len(sets))]
    assert {k: got.get(k, k) for k in nodes} == groups_of(nodes, near)


def test_groups_of_no_members(spark):
    from lureframe.llm import jaccard

    df = spark.createDataFrame([], "grp long, node long, n long, f0 long, f1 long, f2 long, shingles array<long>")
    assert jaccard.jaccard_groups(df, 0.8).count() == 0


def test_near_duplicates_do_not_count_repeats(make, words):
    base, again = words(21, 1000), words(22, 10)
    texts = [" ".join(base + again), " ".join(base + again * 30)]
    one, two = (set(simhash.shingles(t, 5)) for t in texts)
    assert len(one & two) >= 0.95 * len(one | two)
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(make(texts)).collect()] == [0]


def test_forest_is_spanning_and_lightest():
    r = np.random.default_rng(2)
    i, j, w = r.integers(0, 40, 300), r.integers(0, 40, 300), r.integers(0, 50, 300)
    kept = simhash.forest(i, j, w, 40)
    pairs = [(int(a), int(b)) for a, b in zip(i, j)]
    every = groups_of(list(range(40)), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    some = {(pairs[k]) for k in kept}
    assert groups_of(list(range(40)), lambda a, b: (a, b) in some or (b, a) in some) == every
    assert len(kept) == 40 - len(set(every.values()))


# -- 2 ---------------------------------------------------------------------------------------------------------------------

def substrings_by_hand(rows, least=sd.MIN_WORDS):
    cut = {i: sd.units(t or "") for i, t in rows}
    first = {}
    for i in sorted(cut):
        for k, (_, w) in enumerate(cut[i]):
            if w:
                first.setdefault(tuple(w), (i, k))
    out = {}
    for i, t in rows:
        marked = {k for k, (_, w) in enumerate(cut[i]) if w and first[tuple(w)] != (i, k)}
        spans = sd.runs(marked, [len(w) for _, w in cut[i]], [e for e, _ in cut[i]], least)
        text, at = "", 0
        for s, e in spans:
            text, at = text + (t or "")[at:s], e
        out[i] = (None if t is None else text + t[at:], [(s, e) for s, e in spans])
    return out


def test_substring_dedup(make, words):
    sentence = lambda seed, n: " ".join(words(seed, n)).capitalize() + ". "
    passage = "".join(sentence(50 + k, 9) for k in range(8))
    texts = [*SMALL, *[sentence(200 + 3 * k, 11) + "and then " + passage + sentence(201 + 3 * k, 12) for k in range(6)], "Short line here.\n" * 40,
             "Ünï cödé 漢字. " * 3, ", ".join(words(9, 400)), " ".join(words(10, 60_000)), passage, passage]
    docs = make(texts)
    out = sd.dedup_substrings(docs, removed="gone")
    assert out.columns == [*docs.columns, "gone"]
    got = {r["doc_id"]: (r["text"], [tuple(s) for s in r["gone"]]) for r in out.collect()}
    assert got == substrings_by_hand(list(enumerate(texts)))
    whole = [i for i, (t, _) in got.items() if t and passage in t]
    assert len(whole) == 1 and got[len(texts) - 1][0] == ""
    assert sd.dedup_substrings(make([])).count() == 0
    # rows that share id and text share one result; a row without an id ranks last
    same = sd.dedup_substrings(make([passage, passage, passage], [4, 4, None])).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in same) == [(False, passage), (False, passage), (True, "")]


def test_units_cover_the_text(words):
    for t in ["", "a", "...", "\n\n", "a.b,c", ", ".join(words(1, 100)) + ", ...", " ".join(words(1, 100)) + ","]:
        cut = sd.units(t)
        assert [e for e, _ in cut] == sorted({e for e, _ in cut}) and (cut[-1][0] if cut else 0) == len(t)
        assert [w for _, u in cut for w in u] == re.findall(r"\w+", t.lower())


# -- 10 --------------------------------------------------------------------------------------------------------------------

def test_decontamination(spark, make, words):
    items = [" ".join(words(500 + k, 30)) for k in range(4)] + ["too short", None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    w = items[1].split()
    swapped = " ".join("other" if k % 7 == 3 else x for k, x in enumerate(w))
    cased = items[2].upper().replace(" ", ", ")
    clean = [" ".join(words(900 + k, 200)) for k in range(5)]
    texts = [*SMALL, *clean, clean[0] + " " + items[0] + " " + clean[1], clean[1] + " " + swapped, cased, items[3][: len(items[3]) // 2], "too short",
             " ".join(words(77, 40_000)) + " " + items[0], items[0] + " " + items[1], items[0] + " " + items[1]]
    docs = make(texts)
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()}
    n = len(SMALL) + len(clean)
    assert got == {(n, 0), (n + 1, 1), (n + 2, 2), (n + 3, 3), (n + 4, 4), (n + 5, 0), (n + 6, 0), (n + 6, 1), (n + 7, 0), (n + 7, 1)}
    out = dc.decontaminate(docs, bench)
    columns_kept(out, docs)
    assert {r["doc_id"] for r in out.collect()} == set(range(len(texts))) - {d for d, _ in got}
    best = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(docs, bench).collect()}
    at = best[n, 0]
    assert (at["score"], at["doc_from"], at["doc_to"]) == (30, 200, 230)
    unnamed = spark.createDataFrame([(None, items[0]), (None, items[0])], "item_id long, text string")
    assert sorted(r["doc_id"] for r in dc.contaminated(docs, unnamed).collect()) == [n, n + 5, n + 6, n + 7]
    assert dc.contaminated(make([]), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0
    assert dc.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_decontamination_finds_every_diagonal(spark, make, words):
    def best(a, b):
        most = 0
        for shift in range(-len(b), len(a)):
            run = 0
            for k in range(max(0, -shift), min(len(b), len(a) - shift)):
                run = max(run, 0) + (1 if a[k + shift] == b[k] else -1)
                most = max(most, run)
        return most

    r = np.random.default_rng(1)
    items = [words(700 + k, n) for k, n in enumerate([9, 10, 11, 12, 14, 16, 16, 18, 20, 24, 30, 60])]
    texts = []
    for k, item in enumerate(items):
        for changed in [[], *[r.choice(len(item), min(c, len(item)), replace=False) for c in (1, 2, 2, 3, 3, 4)], range(3, len(item), 4), range(2, len(item), 3)]:
            copy = [f"other{i}" if i in set(changed) else w for i, w in enumerate(item)]
            texts.append(" ".join([*words(2000 + len(texts), 15), *copy, *words(4000 + len(texts), 15)]))
    want = {(d, k): s for d, t in enumerate(texts) for k, item in enumerate(items) for s in [best(t.split(), item)] if s >= min(dc.MIN_SCORE, len(item))}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in dc.contaminated(make(texts), bench).collect()}
    assert got == want and {k for _, k in want} == set(range(len(items)))


def test_masks_hit_all_stretches_of_up_to_four_replaced_words():
    import itertools

    def share(m):
        n = dc.MIN_SCORE + 2 * m
        inner = list(itertools.combinations(range(1, n - 1), m))
        spots = [[sum(1 << s + k for k, c in enumerate(mask) if c == "1") for s in range(n - len(mask) + 1)] for mask in dc.MASKS[:2]]
        return sum(any(not sum(1 << p for p in pos) & x for x in itertools.chain(*spots)) for pos in inner) / len(inner)

    assert all("0" in mask for mask in dc.MASKS)  # every mask ignores some place
    assert [share(m) for m in range(5)] == [1.0] * 5 and share(5) > 0.998


def test_short_items_and_many_items(spark, make, words):
    items = ["yes", "a b", " ".join(words(1, 9)), " ".join(words(2, 8)), "", None, "a b"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = words(1, 9)
    texts = ["Yes!", "yesterday", "b a b", "ab", " ".join(words(5, 50) + w + words(6, 50)), " ".join(words(5, 50) + w[:8] + ["x"] + words(6, 50)),
             " ".join(words(7, 20) + words(2, 8)[:4] + ["new"] + words(2, 8)[4:])]
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in dc.contaminated(make(texts), bench).collect()}
    assert got == {(0, 0, 1), (2, 1, 2), (2, 6, 2), (4, 2, 9)}
    many = spark.range(10_000).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(
        F.lit("the w"), F.pmod(F.xxhash64("id", k), F.lit(5000)).cast("string"), F.lit(" v"), F.pmod(F.xxhash64(k, "id"), F.lit(5000)).cast("string"))), " ").alias("text"))
    text = many.where("item_id = 77").head()["text"]
    docs = make([f"{' '.join(words(1, 40))} {text} {' '.join(words(2, 40))}", "the w1 v1 the w2 v2 the w3 v3 the w4 v4 " * 6])
    assert [(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, many).collect()] == [(0, 77)]


def test_decontamination_without_broadcast(spark, make, words, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    bench = spark.createDataFrame([(7, " ".join(words(1, 30)))], "item_id long, text string")
    assert [tuple(r) for r in dc.contaminated(make([" ".join(words(1, 30)), " ".join(words(2, 99))]), bench).select("doc_id", "item_id").collect()] == [(0, 7)]


# -- 9 ---------------------------------------------------------------------------------------------------------------------

def test_sharding(spark, make, words):
    texts = [*SMALL, *[" ".join(words(k, 5 + k % 40)) for k in range(600)], *["equal text"] * 300]
    docs = make(texts)
    rows = sharding.shard_documents(docs, 7, shared_path(spark, "map")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by = collections.defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
        by[r["shard"]].append(r)
    assert set(by) == set(range(7)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    assert sharding.shard_documents(make([]), 3, shared_path(spark, "map")).count() == 0
    tied = sharding.shard_documents(make(["a", "a", "b"], [1, 1, None]), 2, shared_path(spark, "map")).collect()
    assert len(tied) == 3 and len({(r["shard"], r["slot"]) for r in tied}) == 3


def test_rebalancing_edits_the_map(spark):
    weights = {s: 100 + s % 17 for s in range(512)}
    old = sharding.first_map(weights, 8, 512)
    more = sharding.rebalance(old, weights, 9)
    moved = {s for s in old if old[s] != more[s]}
    assert moved and all(more[s] == 8 for s in moved)
    load = collections.Counter()
    for s, shard in more.items():
        load[shard] += weights[s]
    assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 9
    fewer = sharding.rebalance(more, weights, 8)
    assert set(fewer.values()) == set(range(8)) and all(more[s] == 8 or fewer[s] == more[s] for s in more if more[s] == 8)
    path = shared_path(spark, "map")
    for version, m in ((1, old), (2, more)):
        sharding.save_map(spark, m, version, path)
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path).collect()} == more
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path, 1).collect()} == old


# -- 6, 7 ------------------------------------------------------------------------------------------------------------------

def test_packing(make, words, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*SMALL, *[" ".join(words(k, 5 + 3 * (k % 30))) for k in range(300)], " ".join(words(1, 3000))]
    rows = packing.pack_documents(make(texts), path, capacity=512).collect()
    whole, want = Tokenizer.from_file(path), {}
    for d, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 512):
            part = np.array(ids[p:p + 512], "<u4")
            want[d, p // 512] = (p, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 512
    assert len(bins) <= math.ceil(sum(n for _, n, _ in want.values()) / 512) + 2
    assert packing.pack_documents(make([]), path).count() == 0
    tied = packing.pack_documents(make(["a", "a", None], [2**60 + 1, 2**60 + 1, None]), path).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in tied) == [(False, 2**60 + 1)] * 2 + [(True, None)] and len({r["offset"] for r in tied}) == 3


def test_local_search_empties_bins():
    sizes = [6, 5, 4, 3, 3, 3, 2, 2, 2]  # total 30, capacity 10
    start = [[0, 3], [1, 4], [2, 5], [6, 7, 8]]
    done = packing.improve([list(b) for b in start], sizes, 10)
    assert len(done) == 3 and sorted(i for b in done for i in b) == list(range(9)) and all(sum(sizes[i] for i in b) == 10 for b in done)
    stuck = packing.improve([[0], [1], [2]], [6, 6, 6], 10)
    assert len(stuck) == 3


def test_token_files(spark, make, words, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 700)
    path, tok = shared_path(spark, "files"), public_tokenizers.path("byte_bpe_50k.json")
    texts = [*SMALL, *[" ".join(words(k, 10 + k)) for k in range(60)], " ".join(words(1, 2000)), "last", "last"]
    ids = [None if t is None else 7 * i - 3 for i, t in enumerate(texts)]
    token_files.write_token_files(make(texts, ids), path, tok, end_id=0, partitions=3)
    rows = token_files.read_token_files(spark, path, with_ids=True)
    whole = Tokenizer.from_file(tok)
    at, want = 0, []
    for i, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        flat = whole.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(flat), zlib.crc32(np.array(flat, "<u4").tobytes())))
        at += len(flat)
    got = [tuple(r) for r in token_files.token_ranges(rows).orderBy("start").collect()]
    assert got == want
    assert rows.select("file").distinct().count() > 3
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in rows.collect())
    empty = shared_path(spark, "files")
    token_files.write_token_files(make([]), empty, tok)
    assert token_files.read_token_files(spark, empty).count() == 0


# -- 3 ---------------------------------------------------------------------------------------------------------------------

def test_suffix_tree_is_a_distribution(make, words):
    docs = make([" ".join(words(k, 60)) for k in range(30)] + ["é à", ""])
    tree = lm.fit(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    for context in (b"\n\n\n\n\n\n", b"a kand", b"zzzzzz", b" kasa ", "é à".encode()[-6:].rjust(6, b"\n")):
        start = int.from_bytes(context, "big") << 8
        codes = np.arange(start, start + 256)
        assert abs((10 ** tree.of_codes(codes)).sum() - 1) < 1e-5


def test_scores(make, words):
    r = np.random.default_rng(3)
    vocabulary = words(8, 400)
    phrases = [" ".join(vocabulary[int(i)] for i in r.integers(0, 400, 5)) for _ in range(80)]  # words follow each other
    texts = [" ".join(phrases[int(i)] for i in r.integers(0, 80, 20)) for _ in range(150)]
    texts += [*SMALL, "unseen wordforms 漢字", texts[0], " ".join(vocabulary) * 20]
    held = F.col("doc_id") % 5 == 2
    out = {r["doc_id"]: r for r in lm.score_documents(make([]).sparkSession, make(texts), ~held).collect()}
    assert len(out) == len(texts)
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    counts = collections.Counter(w for i, t in enumerate(tokens) if i % 5 != 2 for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t)
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert abs(out[i]["base_score"] - base) < 1e-6 * len(t) and out[i]["score"] < 0 and out[i]["in_training"] == (i % 5 != 2)
    gain = [out[i]["score"] - out[i]["base_score"] for i in range(150) if i % 5 == 2]
    assert sum(gain) > 0  # better than the unigram on held-out texts


def test_scores_join_rare_words(make, words, monkeypatch):
    docs = make([" ".join(words(k, 30)) for k in range(20)])
    every = {r["doc_id"]: tuple(r) for r in lm.score_documents(docs.sparkSession, docs, F.col("doc_id") > 4).collect()}
    monkeypatch.setattr(lm, "SHARED_WORDS", 3)
    for r in lm.score_documents(docs.sparkSession, docs, F.col("doc_id") > 4).collect():
        assert r["n_known"] == every[r["doc_id"]][3] and abs(r["base_score"] - every[r["doc_id"]][5]) < 1e-6


def test_no_state_is_lost_beyond_the_shared_grams(make, words, monkeypatch):
    texts = [*SMALL, *[" ".join(words(k, 40) + words(k % 5, 20)) for k in range(40)]]
    docs, training = make(texts), F.col("doc_id") % 5 != 2
    tree = lm.fit(docs.where(training).select(F.coalesce("text", F.lit("")).alias("text")))
    want = tree.scores([lm.symbols(t or "") for t in texts])
    for most in (lm.SHARED_GRAMS, 200, 0):
        monkeypatch.setattr(lm, "SHARED_GRAMS", most)
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs.sparkSession, docs, training).collect()}
        assert len(got) == len(texts) and max(abs(got[i] - want[i]) for i in got) < 1e-3, most


def test_scores_without_training(make):
    rows = lm.score_documents(make([]).sparkSession, make(["a b", None]), F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in rows] == [(0, 0)] * 2
    assert abs(max(r["score"] for r in rows) - math.log10(1 / 256)) < 1e-4
    assert lm.score_documents(make([]).sparkSession, make([]), F.lit(True)).count() == 0
