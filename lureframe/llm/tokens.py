"""Token ids of whole texts by a public tokenizer file, with a cache of pieces that repeat.

Both kinds of vocabulary cut a text at white space before they merge anything, so
the ids of a text are the ids of its pieces, one after the other.  Pieces repeat
far more often than texts; each worker process remembers their ids.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from .common import process_cache

#: Unicode White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Byte-level vocabularies keep white space: a run but for its last character, or one such character with what follows it.
PIECES = re.compile(f"[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]?[^{WHITE}]+|[{WHITE}]+")
#: Where none of this stands in a text, its pieces begin at each blank and line feed.
UNUSUAL = ("\x01", "  ", "\n\n", " \n", "\n ", *[c for c in WHITE if c not in " \n"])
#: Pieces of one generation of the cache (two are held), and the longest piece that it remembers.
CACHE_PIECES, CACHE_CHARS = 500_000, 48


#: A stop or comma that does not follow a letter or digit; all others begin a piece, which makes pieces repeat more often.
INNER_STOP = re.compile(r"[.,](?<=[\W_][.,])")


def blank_pieces(text: str) -> list[str]:
    """Pieces of a byte-level vocabulary: those of PIECES, cut once more behind line feeds and before stops and commas behind words."""
    if any(c in text for c in (UNUSUAL[:9] if text.isascii() else UNUSUAL)):
        return PIECES.findall(text)
    text = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01")
    if not INNER_STOP.search(text):
        text = text.replace(".", "\x01.").replace(",", "\x01,")
    return text.split("\x01")  # some may be empty


def word_pieces(text: str) -> list[bytes]:
    """Pieces of a vocabulary that drops white space and case."""
    out = text.encode().lower()
    if not INNER_STOP.search(text):
        out = out.replace(b".", b" .").replace(b",", b" ,")
    return out.split()


def keeps_white_space(path: str) -> bool:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel"


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stays, all else is counted from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(others)}}


#: Lower-case letters that neither lower-casing nor normalisation changes.
LOWER = re.compile("[a-zß-öø-ÿ]+")


class PieceEncoder:
    """Texts to token ids as little-endian unsigned 32-bit integers.

    The cache has two generations: a full one becomes the old one, and what is
    still asked for moves over from it, so frequent pieces never leave.  A new
    piece of letters only goes straight to the tokenizer's merges, since nothing
    else of the tokenizer can touch it; others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.blanks = keeps_white_space(path)
        self.split: Callable[[str], list] = blank_pieces if self.blanks else word_pieces
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict = {}
        self.old: dict = {}

    def merged_only(self, piece) -> str | None:
        """The piece in the letters of the vocabulary, if it is one run of letters (after a blank, for a vocabulary that keeps it)."""
        if self.blanks:
            if not (piece[1:] if piece[0] == " " else piece).isalpha():
                return None
            return "\u0120" + piece[1:] if piece[0] == " " and piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        text = piece if isinstance(piece, str) else piece.decode()
        if not LOWER.fullmatch(text):
            return None
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)

    def learn(self, new: Iterable, known: dict) -> None:
        """Add the ids of pieces that are not known yet."""
        from array import array

        whole = []
        for p in new:
            ids = self.old.get(p)
            if ids is None:
                letters = self.merged_only(p) if p else None
                if letters is None:
                    whole.append(p)
                    continue
                ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            known[p] = ids
        found = self.tokenizer.encode_batch_fast([p if isinstance(p, str) else p.decode() for p in whole], add_special_tokens=False)
        for p, e in zip(whole, found):
            known[p] = array("I", e.ids).tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        if len(self.known) > CACHE_PIECES:
            self.known, self.old = {}, self.known
        out = []
        for text in texts:
            # a special token's name ends a stretch of text: such a text is one piece
            pieces = [text] if any(s in text for s in self.special) else self.split(text)
            ids = list(map(self.known.get, pieces))
            if None in ids:
                gaps = [i for i, v in enumerate(ids) if v is None]
                short = {pieces[i] for i in gaps if len(pieces[i]) <= CACHE_CHARS}
                long = {pieces[i] for i in gaps} - short
                self.learn(short, self.known)
                more = self.known
                if long:
                    more = {}
                    self.learn(long, more)
                    more |= {p: self.known[p] for p in short}
                for i in gaps:
                    ids[i] = more[pieces[i]]
            out.append(b"".join(ids))
        return out


def encoder(path: str) -> PieceEncoder:
    return process_cache(("encoder", path), lambda: _make(path))


def _make(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def slices_of(batch, rows: int = 128) -> Iterator:
    """An Arrow batch in slices of few rows, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
