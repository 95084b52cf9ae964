"""Whole-text encoding with a public tokenizer file, one vocabulary lookup per word form.

Both files cut a text into pieces at white space before any merge, so a text's ids are the
ids of its white-space chunks in order. ``ChunkEncoder`` hands each distinct chunk to the
tokenizers library once and joins the remembered ids.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

REMEMBERED_CHUNKS = 400_000   # chunks a worker keeps, about 200 bytes each

# Fixed value: Unicode White_Space, the class both files' patterns use.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
MARK = r"!-&(-/:-@\[-`{-~"     # ASCII marks but the apostrophe, which begins contractions
# A word of plain letters, the run of marks behind it, any other run without white space; all
# three are sure ends of a piece. The first form takes the blank before it along and keeps
# white space, as byte-level files do; the second drops white space.
JOINED = re.compile(f" ?[{LETTER}]+(?=[{MARK}]*(?:[{WHITE}]|$))|[{MARK}]+(?=[{WHITE}]|$)| ?[^{WHITE}]+"
                    f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
DROPPED = re.compile(f"[{LETTER}]+(?=[{MARK}]*(?:[{WHITE}]|$))|[{MARK}]+(?=[{WHITE}]|$)|[^{WHITE}]+")
PLAIN = re.compile(f" ?[{LETTER}]+")
PROBES = ["", " ", " Word", "word", "\xc9t\xe9,", "Stra\xdfe.", " \xe0 la", "It's  12\n3"]


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Known(dict):
    """Ids by chunk; a new chunk is encoded when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = array("I", self.encode(chunk)).tobytes()
        return ids


class ChunkEncoder:
    """``ids(texts)`` -> little-endian unsigned 32-bit ids of each text, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cut = JOINED if self.encode(" ") else DROPPED
        self.lower = self.encode("A") == self.encode("a")
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = [self.encode(p) for p in PROBES]
        words = all([i for c in self.cut.findall(p) for i in self._chunk(c)] == q for p, q in zip(PROBES, probe))
        self.known = _Known(self._chunk if words else self.encode)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunk(self, chunk: str) -> list[int]:
        """A plain word is one piece and goes to the merge model itself."""
        if not PLAIN.fullmatch(chunk):
            return self.encode(chunk)
        piece = chunk.lower() if self.lower else chunk
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        elif piece[0] == " ":
            piece = self.letters[32] + piece[1:]
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED_CHUNKS:
            self.known.clear()
        return [self._text(t) if t else b"" for t in texts]

    def _text(self, text: str) -> bytes:
        if any(s in text for s in self.specials):      # they cut a text before white space does
            return array("I", self.encode(text)).tobytes()
        return b"".join(map(self.known.__getitem__, self.cut.findall(text)))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this file; what it remembers is bounded and serves later tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def forget_chunks() -> None:
    """Called by tasks of other operators: Python workers are reused, and what encoding has
    remembered would take their memory."""
    for e in _encoders.values():
        e.known.clear()
