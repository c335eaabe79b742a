"""Token ids in Simple-8b words.

A 64-bit word has a 4-bit selector (low bits) and 60 bits of data: n values of
60 // n bits each.  Selector 15 says that the next word is one raw 64-bit value.
Values are coded in blocks of BLOCK ids that start on a word; the offsets of the
blocks let a reader step through all blocks at once, and both directions run as
array operations over all blocks.
"""
from __future__ import annotations

import zlib

#: Values per word of selectors 0 to 13; selector 15 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 512
#: Ids coded at a time (whole blocks), which bounds the memory of coding.
STEP = 512 * BLOCK
MAGIC, VERSION = b"LS8B", 1


def encode(ids):
    """(words uint64, block offsets int64) of an array of unsigned 64-bit ids; the last offset is the number of words."""
    import numpy as np

    words, offsets, at = [], [np.zeros(1, np.int64)], 0
    for k in range(0, len(ids), STEP):
        w, o = _encode_step(ids[k:k + STEP])
        words.append(w)
        offsets.append(o[1:] + at)
        at += len(w)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(offsets)


def _encode_step(ids):
    import numpy as np

    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    # bit widths, exact for any value: halves are small enough for floats
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    width = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)
    padded = np.zeros(blocks * BLOCK + 64, np.uint8)
    padded[:n] = width
    # beyond a block's end nothing is read: widths there count as zero for this block
    rows = padded[:blocks * BLOCK].reshape(blocks, BLOCK)
    wide = np.zeros((blocks, BLOCK + 64), np.uint8)
    wide[:, :BLOCK] = rows
    most, reach, fits = wide.copy(), 1, np.zeros((blocks, BLOCK), np.uint8)
    for count in reversed(COUNTS):  # ascending; the widest of the next ``count`` widths
        while reach < count:
            step = min(reach, count - reach)
            most[:, :-step] = np.maximum(most[:, :-step], most[:, step:])
            reach += step
        fits += most[:, :BLOCK] <= 60 // count
    counts = np.array((0, *reversed(COUNTS)), np.int64)  # by how many selectors fit: 0 is the escape
    last = np.full(blocks, BLOCK)
    last[-1] = n - (blocks - 1) * BLOCK
    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    steps_block, steps_at, steps_fit = [], [], []
    while len(live):  # every block takes one word
        fit = fits[live, at[live]]
        steps_block.append(live)
        steps_at.append(at[live].copy())
        steps_fit.append(fit)
        at[live] += np.maximum(counts[fit], 1)
        live = live[at[live] < last[live]]
    block, place, fit = map(np.concatenate, (steps_block, steps_at, steps_fit))
    order = np.lexsort((place, block))
    block, place, fit = block[order], place[order], fit[order]
    used = 1 + (fit == 0)
    word_at = np.cumsum(used) - used
    words = np.zeros(int(used.sum()), np.uint64)
    source = block * BLOCK + place
    flat = np.zeros(blocks * BLOCK + 64, np.uint64)
    flat[:n] = ids
    ends = block * BLOCK + last[block]
    for f in range(1, len(COUNTS) + 1):
        chosen = np.flatnonzero(fit == f)
        if not len(chosen):
            continue
        count = int(counts[f])
        bits, out = 60 // count, np.full(len(chosen), COUNTS.index(count), np.uint64)
        for k in range(count):
            take = source[chosen] + k
            value = np.where(take < ends[chosen], flat[take], np.uint64(0))
            out |= value << np.uint64(4 + k * bits)
        words[word_at[chosen]] = out
    lone = np.flatnonzero(fit == 0)
    words[word_at[lone]] = ESCAPE
    words[word_at[lone] + 1] = flat[source[lone]]
    firsts = np.searchsorted(block, np.arange(blocks))
    return words, np.append(word_at[firsts], len(words)).astype(np.int64)


def decode(words, offsets, n: int):
    """The n ids of ``encode``."""
    import numpy as np

    words = np.asarray(words, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    if (selector == ESCAPE).any():  # a raw word may look like anything: walk the escapes of each block
        raw = np.zeros(len(words), bool)
        live = np.asarray(offsets[:-1], np.int64)
        ends = np.asarray(offsets[1:], np.int64)
        while len(live):
            e = selector[live] == ESCAPE
            raw[live[e] + 1] = True
            live = live + 1 + e
            keep = live < ends
            live, ends = live[keep], ends[keep]
    else:
        raw = np.zeros(len(words), bool)
    size = np.array((*COUNTS, 0, 1), np.int64)[selector]
    size[raw] = 0
    # a block's last word may be padded: cut to the block's end
    ids_before = np.cumsum(size) - size
    blocks = len(offsets) - 1
    of = np.repeat(np.arange(blocks), np.diff(offsets))
    start = ids_before - (ids_before[np.asarray(offsets[:-1])][of] if blocks else 0) + of * BLOCK
    out = np.zeros(max(1, blocks) * BLOCK + 64, np.uint64)
    for s, count in enumerate(COUNTS):
        chosen = np.flatnonzero((selector == s) & ~raw)
        if not len(chosen):
            continue
        bits = 60 // count
        mask = np.uint64((1 << bits) - 1)
        end = np.minimum(start[chosen] + count, (of[chosen] + 1) * BLOCK)
        for k in range(count):
            ok = start[chosen] + k < end
            out[(start[chosen] + k)[ok]] = ((words[chosen] >> np.uint64(4 + k * bits)) & mask)[ok]
    chosen = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[start[chosen]] = words[chosen + 1]
    return out[:n]


def pack_shard(doc_ids, doc_known, lengths, ids) -> bytes:
    """One file: header, document ids, null flags, lengths, block offsets, words, crc32 of all before (all little-endian)."""
    import numpy as np

    words, offsets = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets), len(words)], "<u8").tobytes()
    body = b"".join([MAGIC, bytes([VERSION, 0, 0, 0]), head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(),
                     offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(), np.asarray(doc_known, "u1").tobytes()])
    return body + zlib.crc32(body).to_bytes(4, "little")


def unpack_shard(data: bytes):
    """(document ids, known flags, lengths, ids uint64) of a file; raises ValueError if it is damaged."""
    import numpy as np

    if data[:4] != MAGIC or data[4] != VERSION or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not a whole shard file of this version")
    docs, n, offs, nwords = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    at, out = 40, []
    for count, kind in ((docs, "<i8"), (docs, "<u8"), (offs, "<u8"), (nwords, "<u8"), (docs, "u1")):
        out.append(np.frombuffer(data, kind, count, at))
        at += count * np.dtype(kind).itemsize
    doc_ids, lengths, offsets, words, known = out
    return doc_ids, known.astype(bool), lengths.astype(np.int64), decode(words, offsets.astype(np.int64), n)
