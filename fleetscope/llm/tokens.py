"""Token ids of whole texts by a public tokenizer file, with a bounded memo in each Python worker.

Both vocabularies split a text into pieces before they merge bytes, and no piece crosses a blank. So the ids of a text
are the ids of its blank-separated chunks in order, and a chunk that was seen before costs one look-up. Chunks whose
characters lie outside Latin letters, texts that hold a special string, and texts with odd blanks go to the tokenizers
library whole. Results are equal to ``Tokenizer.encode(text, add_special_tokens=False)``, which the tests assert.
"""

from __future__ import annotations

import json
import sys
import weakref
from array import array

import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Entries of a worker's memos, and the longest key they keep. This bounds memory and changes no result.
CHUNK_MEMO, PIECE_MEMO, LONGEST_KEY = 400_000, 50_000, 64
#: Marks that end a chunk as a piece of their own.
END_MARKS = frozenset(".,;:!?")
#: Below this character, lower-casing and composition work character by character.
PLAIN_BELOW = "ɐ"
#: Characters that Python calls blank and the tokenizer files do not.
ODD_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f")

# The piece patterns of the two public tokenizer files.
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


LETTERS = byte_letters()


def byte_level(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(LETTERS)


_MEMOS: weakref.WeakSet[Memo] = weakref.WeakSet()


class Memo(dict):
    """A dict that makes missing values. It keeps the first ``limit`` of them, which hold the frequent ones; a spare of an
    eighth of that size, emptied when full, takes the rest. Keys above ``LONGEST_KEY`` characters are made anew each time."""

    __hash__ = object.__hash__

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.spare, self.spare_limit = make, limit, {}, max(1, limit // 8)
        _MEMOS.add(self)

    def put(self, key, value) -> None:
        if len(key) > LONGEST_KEY:
            return
        if len(self) < self.limit:
            self[key] = value
        else:
            if len(self.spare) >= self.spare_limit:
                self.spare.clear()
            self.spare[key] = value

    def __missing__(self, key):
        if key in self.spare:
            return self.spare[key]
        value = self.make(key)
        self.put(key, value)
        return value


def alone(*memos: Memo) -> None:
    """Empties a worker's other memos, which earlier stages have filled, and hands free Arrow memory back."""
    for memo in list(_MEMOS):
        if not any(memo is m for m in memos):
            memo.clear()
            memo.spare.clear()
    pa.default_memory_pool().release_unused()


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids as little-endian unsigned 32-bit integers in one bytes value per text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.words = spec["model"]["end_of_word_suffix"] is not None
        self.ids = [_bytes([k]) for k in range(self.library.get_vocab_size(True))]
        self.blank = byte_level(" ")
        self.pieces = Memo(self._piece, PIECE_MEMO)
        self.chunks = Memo(self._word_chunk if self.words else self._byte_chunk, CHUNK_MEMO)

    def _whole(self, text: str) -> bytes:
        return _bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _letters(self, letters: str) -> bytes:
        """Ids of one piece in the vocabulary's alphabet."""
        ids = self.ids
        return b"".join([ids[t.id] for t in self.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        return self._letters(piece if self.words and piece.isascii() and piece.isalpha() else byte_level(piece))

    def _word_chunk(self, chunk: str) -> bytes:
        if not (chunk.isascii() or max(chunk) < PLAIN_BELOW):
            return self._whole(chunk)
        low = chunk.lower()
        if low.isalpha():
            return self._letters(low if low.isascii() else byte_level(low)) if low == chunk else self.chunks[low]
        if low[-1] in END_MARKS and low[:-1].isalpha():
            return self.chunks[low[:-1]] + self.pieces[low[-1]]
        return b"".join(map(self.pieces.__getitem__, WORD_PIECES.findall(low)))

    def _byte_chunk(self, chunk: str) -> bytes | None:
        """Ids of a blank and ``chunk``; None where blanks meet, as their pieces then depend on their neighbours."""
        if chunk.isascii() and chunk.isalpha():
            return self._letters(self.blank + chunk)
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if not (chunk.isascii() or max(chunk) < PLAIN_BELOW):
            return self._whole(" " + chunk)
        if chunk.isalpha():
            return self._letters(byte_level(" " + chunk))
        if chunk[-1] in END_MARKS and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, BYTE_PIECES.findall(" " + chunk)))

    def _odd(self, text: str) -> bool:
        return any(x in text for x in ODD_BLANKS) or "<|" in text and any(x in text for x in self.special)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._odd(text):
            return self._whole(text)
        if self.words:
            return b"".join(map(self.chunks.__getitem__, text.split()))
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise TypeError
            return self._plain_pieces(first) + b"".join(map(self.chunks.__getitem__, rest))
        except TypeError:
            return self._plain_pieces(text)

    def _plain_pieces(self, text: str) -> bytes:
        if text.isascii() or max(text) < PLAIN_BELOW:
            return b"".join(map(self.pieces.__getitem__, BYTE_PIECES.findall(text)))
        return self._whole(text)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; it lives as long as the worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    alone(_LOADED[path].chunks, _LOADED[path].pieces)
    return _LOADED[path]
