"""Word-wise use of a ``tokenizers`` BPE model.

A BPE model encodes each pre-token by itself, so a task encodes each distinct
piece once and keeps the ids in a bounded cache.  The model is the library's
own; nothing is trained and nothing of the vocabulary is copied.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

#: bytes that the cache of a worker holds, about; a full cache is emptied
CACHE_BYTES = 64 << 20
#: of a string, a bytes object and a slot of the dictionary, besides their content
ENTRY_BYTES = 190


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 characters
    stand for themselves, the others for U+0100 onwards, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()
_SPACE = _LETTERS[32]
#: signs that are a pre-token of their own behind a word, at the end of a piece
_ENDS = frozenset(".,;:!?)")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def spelled(piece: str) -> str:
    """A piece in byte-level letters."""
    return piece.encode("utf-8").decode("latin-1").translate(_LETTERS)


def load(path: str) -> Tokenizer:
    """The tokenizer with truncation and padding off."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def fragment_model(path: str) -> BPE:
    """The same merges without a word-end suffix, for pieces of a word that
    do not reach its end."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return BPE(vocab=model["vocab"], merges=merges)


class WordCache(dict):
    """piece -> ids as little-endian unsigned 32-bit bytes.  A piece of several
    pre-tokens ("word,") is put together from theirs, so a word is encoded once
    whatever follows it."""

    def __init__(self, model, pattern: regex.Pattern, size: int = CACHE_BYTES):
        super().__init__()
        self.model, self.pattern, self.size, self.held = model, pattern, size, 0

    def __missing__(self, piece: str) -> bytes:
        if self.held >= self.size:
            self.clear()
            self.held = 0
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():  # one pre-token
            out = self._ids(piece)
        elif body[-1:] in _ENDS and body[:-1].isalpha():
            out = self[piece[:-1]] + self[piece[-1]]
        else:
            parts = self.pattern.findall(piece)
            out = b"".join([self[p] for p in parts]) if len(parts) > 1 else b"".join(map(self._ids, parts))
        self[piece] = out
        self.held += ENTRY_BYTES + len(out) + len(piece) * (1 if piece.isascii() else 2)
        return out

    def _ids(self, pre_token: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(
            pre_token.replace(" ", _SPACE) if pre_token.isascii() and pre_token[1:].isalpha() else spelled(pre_token))]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


def common(text: str) -> bool:
    """Whether all characters lie below U+0250 and none is of those that
    Python and the library treat differently (U+001C-U+001F as white space,
    U+0130 in lower case)."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            if points.max() >= 0x250 or "\u0130" in text:
                return False
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")
