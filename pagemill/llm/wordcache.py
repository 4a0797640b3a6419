"""Tokenizer ids of whole texts through a bounded cache of pieces that no token crosses."""

from __future__ import annotations

import os
import re
from array import array

#: White space of the pattern but space and line feed, and what Python besides counts as white space.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_POINTS = ".,;:!?()|&%$#*-"


def load(name: str):
    """A tokenizer of /opt/tokenizers by file name, or of any path; single-threaded, as Spark deals out the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(name if "/" in name else str(public_tokenizers.path(name)))
    tok.no_truncation()
    tok.no_padding()
    return tok


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the other bytes in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """Ids (unsigned 32-bit, little-endian) of a byte-level BPE tokenizer that joins one space to the word after it.

    A single space between two characters that aren't white space starts a token in any case, and a single line feed there
    is one, so the text divides before both and each part's ids hold wherever the part stands. Parts of up to `longest` characters are kept, at most `most` new and
    as many older ones: what is met again becomes new again. With the pieces that is 1.1 million entries of about 150 bytes (115 MB were measured for 755,000), some 170 MB a worker. A part of Latin letters with points behind is two pieces for
    the pre-tokenizer.
    """

    def __init__(self, name: str, most: int = 450_000, longest: int = 48):
        self.tok, self.most, self.longest = load(name), most, longest
        self.model, self.letters = self.tok.model, byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = packed([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
            self.pieces[piece] = ids
        return ids

    def _learn(self, new: set[str]) -> None:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        if len(self.pieces) > self.most // 2:
            self.pieces.clear()
        other = []
        for p in new:
            if (old := self.older.get(p)) is not None:
                self.known[p] = old
                continue
            word = p.rstrip(_POINTS)
            points = p[len(word) :]
            if word[:1] == "\n":
                lead, word = self._piece("\n"), word[1:]
                first = word
            else:
                lead, first = b"", f" {word}"
            if _LETTERS.fullmatch(word):
                self.known[p] = lead + self._piece(first) + (self._piece(points) if points else b"")
            else:
                other.append(p)
        if other:
            for p, e in zip(other, self.tok.encode_batch_fast([p if p[:1] == "\n" else f" {p}" for p in other], add_special_tokens=False)):
                self.known[p] = packed(e.ids)

    def ids(self, text: str) -> bytes:
        plain = "  " not in text and " \n" not in text and "\n " not in text and "\n\n" not in text and not any(c in text for c in _OTHER_SPACE)
        head, *rest = text.replace("\n", " \n").split(" ") if plain else _BETWEEN.split(text)
        out = list(map(self.known.get, rest))
        if None in out:
            places, i = [], -1
            try:
                while True:
                    places.append(i := out.index(None, i + 1))
            except ValueError:
                pass
            new = {rest[i] for i in places}
            self._learn(new)
            for i in places:
                out[i] = self.known[rest[i]]
            for p in new:
                if len(p) > self.longest:
                    del self.known[p]
        first = packed(self.tok.encode(head, add_special_tokens=False).ids) if head else b""
        return first + b"".join(out)


_kept: dict[str, ByteBpe] = {}


def byte_bpe(name: str) -> ByteBpe:
    """One for each tokenizer and Python worker, kept from task to task."""
    if name not in _kept:
        _kept[name] = ByteBpe(name)
    return _kept[name]
