import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lureframe.llm import simple8b
from lureframe.llm.tokens import PIECES, WHITE, PieceEncoder, blank_pieces


def texts():
    r = random.Random(4)
    parts = ["the", "The", "don't", "I'm", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "é", "́", "12", "a1!?", "...", ".", ",", "a.", "b, c.", "d_.", "²,", "日本", "<|endoftext|>",
             "ﬁ", "'s", "x'll", "\x00", "\x01", "\x1c", "𝒳", *WHITE]
    yield from ("", " ", "\n", " a", "a ", "a\n", "\na", "a \n b", "a　\n b", "\n\n　x", "it's  'S ok")
    for n in (2, 3, 5, 8, 30):
        for _ in range(300):
            yield "".join(r.choice(parts) for _ in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    path = public_tokenizers.path(name)
    mine, whole = PieceEncoder(path), Tokenizer.from_file(path)
    every = list(texts())
    for _ in range(2):  # the second time from the cache
        got = mine.encode(every)
        for t, g in zip(every, got):
            assert np.frombuffer(g, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_cover_the_text():
    for t in texts():
        assert "".join(blank_pieces(t)) == t and "".join(PIECES.findall(t)) == t, repr(t)


def test_a_full_cache_keeps_what_is_asked_for(monkeypatch):
    from lureframe.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    mine = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    first = mine.encode(["a b c"])[0]
    for k in range(20):
        mine.encode([" ".join(f"w{k}{i}" for i in range(8)) + " b"])
    assert mine.encode(["a b c"])[0] == first and len(mine.known) + len(mine.old) < 60


@pytest.mark.parametrize("high", [0, 1, 2, 300, 50256, 2**33, 2**60 - 1, 2**60, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1500])
def test_simple8b_round_trip(high, n):
    r = np.random.default_rng(7)
    ids = r.integers(0, high, n, dtype=np.uint64, endpoint=True)
    ids[::5] = 0
    words, offsets = simple8b.encode(ids)
    assert len(offsets) == -(-n // simple8b.BLOCK) + 1 and offsets[-1] == len(words)
    assert (simple8b.decode(words, offsets, n) == ids).all()


def test_simple8b_in_steps(monkeypatch):
    ids = np.arange(5000, dtype=np.uint64) % 777
    whole = simple8b.encode(ids)
    monkeypatch.setattr(simple8b, "STEP", 2 * simple8b.BLOCK)
    parts = simple8b.encode(ids)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_shard_file_detects_damage():
    data = simple8b.pack_shard([5, 0], [True, False], [2, 1], np.array([7, 8, 0]))
    docs, known, lengths, ids = simple8b.unpack_shard(data)
    assert docs.tolist() == [5, 0] and known.tolist() == [True, False] and lengths.tolist() == [2, 1] and ids.tolist() == [7, 8, 0]
    for at in (0, 4, 50, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            simple8b.unpack_shard(bytes(bad))
