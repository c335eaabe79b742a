"""Substring de-duplication by hashed units.

A text is cut into units at line and sentence ends, a long sentence also at
places that depend on the words there alone.  Units are normalised (lower case, words only) and hashed to 128 bits.
Over all documents the earliest occurrence of a digest stays; later ones are
marked, and a run of marked units with enough words is cut out of the text.
Offsets of what was cut refer to the original text.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import if_small, stored
from .tokens import slices_of

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
WORD = re.compile(r"\w+")
WORD_AND_COMMA = re.compile(r"(\w+)(,\s*)?")
#: Words from which a unit may end without punctuation, words of the longest unit, and words of a run of marked units that is cut.
MANY_WORDS, MOST_WORDS, MIN_WORDS = 8, 24, 16


def units(text: str) -> list[tuple[int, list[str]]]:
    """(end, normalised words) of each unit in order; units cover the whole text, some have no words.

    A long sentence is cut behind words that their own hash picks (every second one before a comma, every fourth one
    elsewhere once a unit has MANY_WORDS words), so that a passage is cut alike whatever it is glued to.
    """
    out: list[tuple[int, list[str]]] = []
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m[0].lower())
        if len(words) < 2 * MANY_WORDS:
            out.append((m.end(), words))
            continue
        held: list[str] = []
        for w in WORD_AND_COMMA.finditer(m[0]):
            word = w[1].lower()
            held.append(word)
            pick = zlib.crc32(word.encode())
            if w[2] and pick % 2 == 0 or len(held) >= MANY_WORDS and pick % 4 == 0 or len(held) == MOST_WORDS:
                out.append((m.start() + w.end(), held))
                held = []
        if held:
            out.append((m.end(), held))
        else:
            out[-1] = (m.end(), out[-1][1])
    return out


def runs(marked: set[int], words: list[int], ends: list[int], min_words: int) -> list[tuple[int, int]]:
    """Spans (start, end) of runs of marked units with ``min_words`` words or more; units without words do not end a run."""
    out, first, last, held = [], None, None, 0
    for i in range(len(words) + 1):
        if i < len(words) and i in marked:
            first = i if first is None else first
            last, held = i, held + words[i]
        elif i == len(words) or words[i]:
            if held >= min_words:
                out.append((ends[first - 1] if first else 0, ends[last]))
            first, last, held = None, None, 0
    return out


def unit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """no_id, id, crc (together a row's identity) and its units: h1, h2 (digests; zero where a unit has no words), words, ends."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in (s for batch in batches for s in slices_of(batch, 512)):
            cols: tuple[list, ...] = ([], [], [], [])
            for text in b.column("text").to_pylist():
                cut = units(text)
                h = np.frombuffer(b"".join(digest(" ".join(w)) if w else bytes(16) for _, w in cut), "<i8").reshape(-1, 2)
                for c, v in zip(cols, (h[:, 0], h[:, 1], [len(w) for _, w in cut], [e for e, _ in cut])):
                    c.append(v)
            arrays = [b.column(c) for c in ("no_id", "id", "crc")]
            arrays += [pa.array(c, pa.list_(k)) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["no_id", "id", "crc", "h1", "h2", "words", "ends"])

    return identified(docs, id_col, text_col).mapInArrow(
        run, "no_id boolean, id long, crc int, h1 array<long>, h2 array<long>, words array<int>, ends array<int>")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """no_id, id, crc, text.  A row without an id ranks last and goes by its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.xxhash64(text)).alias("id"),
                       F.hash(text).alias("crc"), text.alias("text"))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """no_id, id, crc, cut (array of start, end in the original text, code points) of the rows that lose something.

    Occurrences rank by id, then text hash, then place.  Digests are counted with map-side partial sums, so a unit that
    stands in a third of all documents is one row per task; occurrences meet the repeated digests in a join that Spark can split.
    """
    table = stored(unit_table(docs, id_col, text_col), "units")
    at = F.struct("no_id", "id", "crc", "unit")
    seen = table.select("no_id", "id", "crc", F.posexplode(F.arrays_zip("h1", "h2")).alias("unit", "h")).select(
        "no_id", "id", "crc", "unit", "h.h1", "h.h2").where("h1 <> 0 or h2 <> 0")
    firsts = seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first")).where("times > 1").select("h1", "h2", "first")
    # written first, the join's sides are plain shuffles, whose large partitions Spark splits
    firsts = stored(firsts, "firsts").hint("merge")
    marked = seen.join(firsts, ["h1", "h2"]).where(at != F.col("first")).groupBy("no_id", "id", "crc").agg(
        F.collect_set("unit").alias("marked"))
    marked = stored(marked, "marked")
    who = ["no_id", "id", "crc"]
    touched = table.select(*who, "words", "ends").join(if_small(marked.select(*who)), who, "left_semi").join(marked, who)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            cut = [[{"start": s, "end": e} for s, e in runs(set(m), w, ends, min_words)] for m, w, ends in zip(
                b.column("marked").to_pylist(), b.column("words").to_pylist(), b.column("ends").to_pylist())]
            out = pa.RecordBatch.from_arrays([*[b.column(c) for c in ("no_id", "id", "crc")], pa.array(cut, kind)],
                                             names=["no_id", "id", "crc", "cut"])
            yield out.filter(pa.array([bool(c) for c in cut], pa.bool_()))

    return touched.mapInArrow(run, "no_id boolean, id long, crc int, cut array<struct<start:int,end:int>>").dropDuplicates(["no_id", "id", "crc"])


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                     removed: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; rows and other columns unchanged.

    ``removed`` names a further column: the spans cut, (start, end) in code points of the original text, empty where nothing was.
    Null texts stay null.  Rows that share id and text share one identity: they count once and lose the same.
    A text may become empty; its row stays.
    """
    cuts = stored(repeated_spans(docs, min_words, id_col, text_col), "cuts")
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.xxhash64(text)).alias("id"),
                        F.hash(text).alias("crc"))
    rows = keyed.join(if_small(cuts), ["no_id", "id", "crc"], "left")
    whole = F.col(f"row.{text_col}")
    cut = F.col("cut")
    # what stands before each span and after the last one
    before = F.transform(cut, lambda s, i: F.substring(whole, F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end"]) + 1, s["start"] - F.when(
        i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end"])))
    rest = F.concat(F.array_join(before, ""), F.substring(whole, F.element_at(cut, -1)["end"] + 1, F.lit(2**31 - 1)))
    out = [F.when(cut.isNull(), whole).otherwise(rest).alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in names]
    if removed:
        out.append(F.coalesce(cut, F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias(removed))
    return rows.select(*out)
