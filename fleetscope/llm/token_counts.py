"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A piece starts as one symbol per byte. Adjacent pairs wait in a heap by merge rank, then place. The lowest is popped
and merged if it still stands; its neighbours in the linked list form new pairs. The count is the number of initial
symbols minus the number of merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import normalizers

from .arrow import map_rows
from .tokens import BYTE_PIECES, CHUNK_MEMO, ODD_BLANKS, PIECE_MEMO, PLAIN_BELOW, WORD_PIECES, Memo, alone, byte_level


class MergeCounter:
    """Counts the tokens that a BPE tokenizer file gives a text, special strings inside the text counting one each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = special and regex.compile("|".join(map(regex.escape, special)))
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]) if spec["normalizer"] else None
        self.pieces = Memo(self.merged, PIECE_MEMO)
        self.chunks = Memo(self._chunk, CHUNK_MEMO)

    def merged(self, piece: str) -> int:
        """Tokens of one piece: initial symbols minus merges."""
        symbols = list(byte_level(piece))
        symbols[-1] += self.suffix
        n, rank, merges = len(symbols), self.rank.get, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((a + b, symbols[k]))) is not None:
                    heappush(heap, (r, i, a + b, symbols[k]))
            if (p := before[i]) >= 0 and (r := rank((symbols[p], a + b))) is not None:
                heappush(heap, (r, p, symbols[p], a + b))
        return n - merges

    def _chunk(self, chunk: str) -> int:
        low = chunk.lower() if chunk.isascii() or max(chunk) < PLAIN_BELOW else self.normal.normalize_str(chunk)
        return self.pieces[low] if low.isalpha() else sum(map(self.pieces.__getitem__, WORD_PIECES.findall(low)))

    def _plain(self, text: str) -> int:
        if not self.normal:
            return sum(map(self.pieces.__getitem__, BYTE_PIECES.findall(text)))
        if any(x in text for x in ODD_BLANKS):
            return sum(map(self.chunks.__getitem__, regex.findall(r"[^\p{White_Space}]+", text)))
        return sum(map(self.chunks.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and "<|" in text and self.special.search(text):
            return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)


_LOADED: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _LOADED:
        _LOADED[path] = MergeCounter(path)
    alone(_LOADED[path].chunks, _LOADED[path].pieces)
    return _LOADED[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text.

    One output row per input row, repeated rows included; a null text counts as empty (0 bytes, 0 tokens); a null id
    stays null; other columns are not read. ``over_limit`` is true above ``limit`` tokens. No shuffle.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        count = counter(tokenizer).count
        for doc_id, text in rows:
            n = count(text)
            yield doc_id, len((text or "").encode()), n, n > limit

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_rows(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]))
