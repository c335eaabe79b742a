"""The whole pipeline over planted documents, stage by stage against brute force."""
import collections
import os
import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from lureframe.llm import simhash  # noqa: E402
from test_documents import groups_of, quality_of, substrings_by_hand  # noqa: E402


def rejected(t):
    n, chars, sym, dup, rep = quality_of(t)
    t = t or ""
    return (n < 20 or 100 * rep > 30 * n or 10 * sym > 3 * n or not 2 * n <= chars <= 14 * n or 10 * sum(c.isupper() for c in t) > 6 * chars
            or 10 * dup > 3 * len([x for x in t.split("\n") if x.split()]))


def test_pipeline(spark, tmp_path, words):
    sentences = lambda seed, k: " ".join(" ".join(words(seed * 100 + i, 9)).capitalize() + "." for i in range(k))
    clean = [sentences(k, 12) for k in range(1, 21)]
    passage, items = sentences(90, 8), [sentences(91 + k, 4) for k in range(3)]
    near = clean[3].split()
    near[50] = "changed"
    texts = [*clean, clean[2], " ".join(near), "short", None, "", " ".join(f"{w}***" for w in words(5, 60)), "word " * 60,
             *[sentences(40 + k, 6) + " " + passage + " " + sentences(50 + k, 6) for k in range(5)],
             *[sentences(60 + k, 6) + " " + items[k] + " " + sentences(70 + k, 6) for k in range(3)]]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), i * 2) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)

    expected = {i: t for i, t in enumerate(texts) if not rejected(t)}
    assert set(range(20)) <= set(expected) and len(expected) == len(texts) - 5
    docs, stages = spark.read.parquet(f"{d}/documents.parquet"), corpus_pipeline.STAGES
    names = docs.columns
    for k, (name, stage) in enumerate(stages[:-1]):
        if k == 1:
            sets = {i: set(simhash.shingles(t, 5)) for i, t in expected.items()}
            roots = groups_of(sorted(expected), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
            expected = {i: t for i, t in expected.items() if roots[i] == i}
            assert 20 not in expected and 21 not in expected and set(range(20)) <= set(expected)
        elif k == 2:
            cut = substrings_by_hand(sorted(expected.items()))
            expected = {i: cut[i][0] for i in expected}
            assert sum(passage in t for t in expected.values()) == 1
        elif k == 3:
            expected = {i: t for i, t in expected.items() if not any(item in t for item in items)}
            assert set(range(20)) <= set(expected)
        docs = stage(spark, docs, d)
        assert docs.columns == names, name
        path = str(tmp_path / f"stage{k}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r["doc_id"]: r for r in docs.collect()}
        assert {i: r["text"] for i, r in got.items()} == expected, name
        assert all(r["n_chars"] == len(r["text"]) and r["n"] == 2 * i for i, r in got.items())

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected.items()}
    for packed in (stages[-1][1](spark, docs, d), corpus_pipeline.run(spark, d)):
        rows = packed.collect()
        held = collections.Counter()
        bins = collections.defaultdict(list)
        for r in rows:
            held[r["doc_id"]] += r["length"]
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert dict(held) == sizes and len(bins) == -(-sum(sizes.values()) // 4096)
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b])[:-1].tolist() and b[-1][0] + b[-1][1] <= 4096


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x " * 20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
