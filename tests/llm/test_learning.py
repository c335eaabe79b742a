"""Quality classifier, hard negatives and filter audit against brute force, with null, empty, long, tied and repeated rows."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lureframe.llm import filter_audit as fa, hard_negatives as hn, quality_fm as fm

# -- 11 --------------------------------------------------------------------------------------------------------------------


def test_machine_value_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    texts = ["a b c\nd e f", None, "", "one ONE two", "x " * 500 + "y", "ü ß\n\n| | !!"]
    ptr, idx, val = fm.sparse(texts, [11, None, 0, 11, 1001, -5])
    bias, weights, factors = 0.3, rng.normal(size=fm.FEATURES), rng.normal(size=(fm.FEATURES, fm.FACTORS))
    got, _, _ = fm.margins(ptr, idx, val, bias, weights, factors)
    for k in range(len(texts)):
        i, v = idx[ptr[k]:ptr[k + 1]], val[ptr[k]:ptr[k + 1]]
        pairs = sum(factors[a] @ factors[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(i, v), 2))
        assert math.isclose(got[k], bias + weights[i] @ v + pairs, rel_tol=1e-9, abs_tol=1e-9)
    sizes = np.diff(ptr)
    assert sizes[1] == sizes[2] == len(fm.BINS) and sizes[4] == len(fm.BINS) + 2  # empty texts have their statistics


def test_steps_follow_the_log_loss():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(8)) for _ in range(200)]
    y = np.array([float(("aaa" in t) == ("bbb" in t)) for t in texts])  # no word tells anything by itself
    ptr, idx, val = fm.sparse(texts, [len(t) for t in texts])

    def loss(*model):
        p = fm.chance(fm.margins(ptr, idx, val, *model)[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    np_rng = np.random.default_rng(3)
    model = [0.1, np_rng.normal(0, 0.3, fm.FEATURES), np_rng.normal(0, 0.3, (fm.FEATURES, fm.FACTORS))]
    used, by_bias, by_weights, by_factors = fm.slopes(ptr, idx, val, y, *model)
    e = 1e-6
    assert math.isclose((loss(model[0] + e, *model[1:]) - loss(model[0] - e, *model[1:])) / (2 * e), by_bias, rel_tol=1e-4)
    for k in np_rng.choice(len(used), 5, replace=False):
        for table, place, slope in ((1, (used[k],), by_weights[k]), (2, (used[k], 3), by_factors[k, 3])):
            sides = []
            for d in (e, -e):
                moved = [model[0], model[1].copy(), model[2].copy()]
                moved[table][place] += d
                sides.append(loss(*moved))
            assert math.isclose((sides[0] - sides[1]) / (2 * e), slope, rel_tol=1e-3, abs_tol=1e-8)
    losses = [loss(*fm.train(ptr, idx, val, y, passes=k)) for k in (0, 10, 100)]
    assert losses[2] < losses[1] and losses[2] < 0.5 * losses[0]


@pytest.fixture
def corpus(spark, words):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        good = k % 3 != 0
        ws = words(k, 60)
        text = " ".join(ws) + "." if good else " ".join(f"{w}!!" if k % 2 else ws[0] for w in ws)
        rows.append((k, text, len(text), "l", 2.0))
        labels.append((k, int(good), 0))
    rows += [(1000, None, None, "l", 1.0), (1001, "", 0, "l", 1.0), (1002, " ".join(words(7, 30_000)), 200_000, "l", 1.0), (None, "no id", 5, "l", 1.0),
             (1001, "", 0, "l", 1.0)]
    rng.shuffle(rows)
    return (spark.createDataFrame(rows, "doc_id long, text string, n_chars long, c0 string, score double").repartition(5),
            spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int"))


def test_held_out_accuracy_and_columns(spark, corpus):
    docs, labels = corpus
    held = F.col("doc_id") % 4 == 1
    machine = fm.fit(docs, labels, ~held)
    out = fm.score_quality(docs, machine)
    assert out.columns == ["doc_id", "text", "n_chars", "c0", "score"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 4 == 1]
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in unseen]) > 0.97
    assert len({r["score"] for r in rows if not r["text"]}) <= 2 and len({r["score"] for r in rows if r["doc_id"] == 1001}) == 1
    again = {r["doc_id"]: r["score"] for r in fm.score_quality(docs.repartition(2), fm.fit(docs.repartition(3), labels.repartition(2), ~held)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}  # neither order nor partitions matter


def test_labels_of_held_out_rows_change_nothing(corpus):
    docs, labels = corpus
    held = F.col("doc_id") % 4 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (fm.fit(docs, x, ~held).orderBy("feature").collect() for x in (labels, turned))
    assert a == b


def test_machine_of_few_or_no_rows(spark, corpus):
    docs, labels = corpus
    for some in (labels.limit(0), labels.where("doc_id = 1"), labels.where("quality = 7")):
        rows = fm.score_quality(docs.where("doc_id < 5"), fm.fit(docs, some, F.lit(True))).collect()
        assert len(rows) == 5 and all(0 < r["score"] < 1 for r in rows)
    assert fm.score_quality(docs.limit(0), fm.fit(docs.limit(0), labels, F.lit(True))).count() == 0
    share = fm.fit(docs, labels, F.lit(True), fit_rows=100)
    assert share.count() == fm.FEATURES + 1 and share.where("weight <> 0").count() < fm.fit(docs, labels, F.lit(True)).where("weight <> 0").count()


# -- 12 --------------------------------------------------------------------------------------------------------------------

def negatives_by_hand(rows, anchors, positives=5, negatives=10, low=30, high=90):
    good = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows
            if None not in (i, y, v) and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, y, v in {(i, y, tuple(v)) for i, y, v in good if anchors(i)}:
        near = sorted((-sum(p * q for p, q in zip(v, w)), j, z) for j, z, w in good if len(w) == len(v))
        for s, j, _ in [t for t in near if t[2] == y and t[1] != a][:positives]:
            fit = [t for t in near if t[2] != y and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(a, j, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fit)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1.0) for i, y, v in rows], "vec_id long, embedding array<float>, label int, key string, dim double").repartition(7)


def mined(df, anchors, **options):
    return sorted(tuple(r) for r in hn.mine_hard_negatives(df, anchors, **options).collect())


@pytest.mark.parametrize("dims, sizes", [(20, {}), (3, dict(TILE=2, ROWS=5, GROUP=2, ANCHORS=3, BLOCK_ROWS=20, LEAST_ROWS=9))])
def test_negatives_against_brute_force(spark, monkeypatch, dims, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(dims)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(0.1, 0.4, dims)]) for i in range(300)]
    hot = [float(x) for x in rng.normal(0.2, 0.4, dims)]
    rows += [(300 + k, k % 2, hot) for k in range(150)]                                     # ties: a third of all rows is one vector
    rows += [(600, None, hot), (610, 1, None), (620, 1, [None] * dims), (630, 1, [float("nan")] * dims), (640, 1, [float("inf")] * dims),
             (650, 1, []), (660, 1, hot[:-1]), (661, 2, hot[:-1]), (662, 1, hot[:-1]), (None, 1, hot), (670, 2, [0.0] * dims), (671, 2, [0.0] * dims),
             (680, 7, hot), rows[10], rows[10], rows[11]]
    assert mined(vectors(spark, rows), F.col("id") % 10 == 0) == negatives_by_hand(rows, lambda i: i % 10 == 0)


def test_negatives_of_large_numbers_and_small_windows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.normal(0, 2**20, 4)]) for i in range(60)]
    assert mined(vectors(spark, rows), F.col("id") % 20 == 0, positives=2, negatives=3, low=50, high=80) == negatives_by_hand(
        rows, lambda i: i % 20 == 0, 2, 3, 50, 80)


def test_negatives_of_tables_without_rows_or_partners(spark):
    one = [(100, 1, [0.5, 0.5])]
    for rows in ([], one, one + [(1, 2, [0.5, 0.4])], one + [(1, 1, [-0.5, -0.4]), (2, 2, [0.1, 0.1])]):
        df = vectors(spark, rows) if rows else vectors(spark, one).limit(0)
        assert mined(df, F.col("id") % 100 == 0) == []
    assert mined(vectors(spark, [(1, 1, [1.0]), (2, 1, [1.0]), (3, 2, [0.5])]), None) == [(1, 2, 1, 3, 65536, 32768), (2, 1, 1, 3, 65536, 32768)]


def test_threshold_join_is_exact():
    rng = np.random.default_rng(9)
    for scale in ([1] * 24, [20] * 4 + [1] * 20):                                           # flat vectors, and a few heavy dimensions
        a, x = (np.floor(rng.normal(0, 50, (n, 24)) * scale) for n in (13, 400))
        whole = a @ x.T
        for share in (-np.inf, -0.5, 0.0, 0.3, 0.7, 1.1):
            t = share * np.abs(whole).max(1) if share > -np.inf else np.full(13, -np.inf)
            i, j, s = hn.threshold_join(a, x, t)
            assert {(p, q): v for p, q, v in zip(i.tolist(), j.tolist(), s.tolist())} == {
                (p, q): whole[p, q] for p, q in zip(*np.nonzero(whole >= t[:, None]))}


# -- 13 --------------------------------------------------------------------------------------------------------------------

def failing(text, first):
    words = text.encode().split()
    return {c for c, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= x <= "Z" for x in text) > 5 * len(text),
                                         any(x in "#$%&*|" for x in text), not first)) if bad}


def audit_by_hand(rows, labels, letters="ABCDE", orders=None):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    marks = {}
    for i, q, x in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or x == 1)
    docs = [(p or "", failing(t or "", i is None or least[t or ""] == i), *(marks.get(i, (0, 0)) if i is not None else (0, 0))) for i, t, p in rows]
    out, every = {}, list(itertools.permutations(letters))
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys(letters, 0)
        for order in every:
            for k, f in enumerate(order):
                shapley[f] += sum(f in d[1] and not d[1] & set(order[:k]) for d in mine)
        for order in every:
            for k, f in enumerate(order):
                here = [d for d in mine if f in d[1] and not d[1] & set(order[:k])]
                out[part, "".join(order), k + 1] = (sum(not d[1] & set(order[:k + 1]) for d in mine), len(here), sum(f in d[1] and bool(d[1] & set(order[:k])) for d in mine),
                                                    sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here), shapley[f])
    return out


def test_audit_against_all_orders(spark, words):
    base = [None, "", "short", " ".join(words(1, 60)), " ".join(words(1, 60)), "w " * 60, " ".join(words(2, 60)).upper(), " ".join(words(3, 60)) + " a|b",
            "# " * 60, " ".join(words(4, 20_000)), "A b", "é É" * 40, "a\x0bb\x85c d"]
    rng = random.Random(6)
    rows = [(i, rng.choice(base), rng.choice([None, "", "s1", "s2"])) for i in range(120)]
    rows += [(3, rows[3][1], "s1"), (None, base[3], "s2"), (None, base[3], "s2"), (None, None, None), (500, base[3], "s3"), (400, "copy", "s3"), (401, "copy", "s4")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(2, 1, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, 7, "m") for i, t, p in rows], "doc_id long, text string, source string, docs int, mask string").repartition(6)
    got = fa.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}
    assert found == audit_by_hand(rows, labels) and len(found) == 5 * 600


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert fa.audit_documents(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("before", [[], [(0, 1)], [(0, 3), (1, 3), (2, 0)]])
def test_paths_through_an_edge_are_the_orders_that_use_it(before):
    want = {}
    orders = [o for o in itertools.permutations(range(4)) if all(o.index(a) < o.index(b) for a, b in before)]
    for o in orders:
        for k, f in enumerate(o):
            e = sum(1 << x for x in o[:k]), f
            want[e] = want.get(e, 0) + 1
    assert {(s, f): n for s, f, n in fa.lattice(4, before)} == want
    steps = list(fa.order_steps("abcd", before))
    assert len(steps) == 4 * len(orders) and {(s, f) for _, _, s, f in steps} == set(want)


def test_audit_with_an_order_that_must_hold(spark):
    cells = spark.createDataFrame([("p", m, 1, 0, 0) for m in range(8)], "part string, mask int, docs long, good long, toxic long")
    rows = fa.audit(cells, "xyz", before=[("z", "x")]).collect()
    assert {r["filter_order"] for r in rows} == {"zxy", "zyx", "yzx"}
    assert {r["shapley"] for r in rows if r["step"] == 1 and r["filter_order"] == "yzx"} == {4 + 2 + 1}
    with pytest.raises(ValueError):
        fa.audit(cells, "abcdefgh")
