"""Byte-level BPE of whole texts: pieces found by scans over code point classes, pair merging behind a memo, decoding by offsets.

A batch of texts is one array of code points. Each becomes a symbol: its class (letter, number, blank, apostrophe, other) and
what follows it. A symbol is a function on the states of a small automaton, that of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and composition of functions is associative, so the state before every place comes from a scan: inside blocks of the array
side by side, over the blocks' totals by doubling, and put together. The functions that can arise are few, each has a
number, and composing two is a look-up. A place starts a piece if its symbol says so in that state. No regular expression
is run on a text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .tokens import Memo, alone

#: Code points scanned at once (a longer text is a batch of its own), and places of a block of the scan.
BATCH_POINTS, BLOCK = 1 << 19, 256
#: Pieces whose ids a worker's memo holds; the memo changes no result.
PIECES_HELD = 1 << 18
#: Bytes of a piece up to which its pairs are looked through for each merge; a longer one's wait in a heap.
SHORT_PIECE, NO_RANK = 48, 1 << 62

#: States: nothing open; letters, numbers, others, one space that may lead a piece, or blanks open; letters of a contraction to come.
CLOSED, LETTERS, NUMBERS, OTHERS, SPACE, BLANKS, ONE, TWO = range(8)
#: Symbols: letter, number, other, apostrophe of a contraction of one or two letters, space and other blank that end a run of
#: blanks, blank inside a run or at a text's end, and the mark between texts.
LETTER, NUMBER, OTHER, APOSTROPHE_1, APOSTROPHE_2, LAST_SPACE, LAST_BLANK, INNER_BLANK, MARK = range(9)
#: For each symbol the state after it, by the state before it, and the states in which it starts no piece.
AFTER = np.array(
    [
        [ONE if s == TWO else CLOSED if s == ONE else LETTERS for s in range(8)],
        [NUMBERS] * 8,
        [OTHERS] * 8,
        [OTHERS if s in (OTHERS, SPACE) else ONE for s in range(8)],
        [OTHERS if s in (OTHERS, SPACE) else TWO for s in range(8)],
        [SPACE] * 8,
        [CLOSED] * 8,
        [BLANKS] * 8,
        [CLOSED] * 8,
    ],
    np.uint8,
)
GOES_ON = ((LETTERS, SPACE, ONE, TWO), (NUMBERS, SPACE), (OTHERS, SPACE), (OTHERS, SPACE), (OTHERS, SPACE), (), (), (BLANKS,), ())
STARTS = np.array([[s not in on for s in range(8)] for on in GOES_ON])


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state from CLOSED by function, number of each symbol's function, composition table: first, then second)."""
    known = {tuple(range(8)): 0}
    found = [tuple(range(8))]
    for f in found:
        for g in AFTER.tolist():
            made = tuple(g[s] for s in f)
            if made not in known:
                known[made] = len(found)
                found.append(made)
    table = np.array([[known[tuple(g[s] for s in f)] for g in found] for f in found], np.uint8)
    return np.array([f[CLOSED] for f in found], np.uint8), np.array([known[tuple(g)] for g in AFTER.tolist()], np.uint8), table


STATE_OF, FUNCTION_OF, COMPOSED = _monoid()


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, from CLOSED at the first."""
    n = len(symbols)
    rows = -(-n // BLOCK)
    held = np.zeros(rows * BLOCK, np.uint8)
    held[:n] = FUNCTION_OF[symbols]
    inside = np.ascontiguousarray(held.reshape(rows, BLOCK).T)
    for k in range(1, BLOCK):
        inside[k] = COMPOSED[inside[k - 1], inside[k]]
    # Totals of all blocks up to each one, by doubling.
    totals, step = inside[-1].copy(), 1
    while step < rows:
        totals[step:] = COMPOSED[totals[:-step], totals[step:]]
        step *= 2
    lead = np.concatenate([np.zeros(1, np.uint8), totals[:-1]])
    after = STATE_OF[COMPOSED[lead[:, None], inside.T]].ravel()[:n]
    return np.concatenate([np.full(1, CLOSED, np.uint8), after[:-1]])


_CLASSES: list[np.ndarray] = []


def point_classes() -> np.ndarray:
    """LETTER, NUMBER, INNER_BLANK or OTHER for every code point, as the library's own tables have them (one pass over all of them for each worker)."""
    if not _CLASSES:
        out = np.full(0x110000, OTHER, np.uint8)
        shown = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (INNER_BLANK, r"\s+")):
            only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            out[_points(only.decode_bytes(only.encode_ordinary(shown)).decode())] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def symbols_of(points: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A symbol for each code point; ``marks`` are the places between texts."""
    kinds = point_classes()[points]
    kinds[marks] = MARK
    out = kinds.copy()
    after = np.append(kinds[1:], np.uint8(MARK))
    ends = np.flatnonzero((kinds == INNER_BLANK) & (after != INNER_BLANK) & (after != MARK))
    out[ends] = np.where(points[ends] == 0x20, LAST_SPACE, LAST_BLANK)
    at = np.flatnonzero((points == 0x27) & (kinds != MARK))
    padded = np.append(points, np.zeros(2, np.uint32))
    padded[marks] = 0
    one, two = padded[at + 1], padded[at + 2]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = APOSTROPHE_1
    pairs = [one == ord(a) for a in "rvl"], [two == ord(b) for b in "eel"]
    out[at[(pairs[0][0] & pairs[1][0]) | (pairs[0][1] & pairs[1][1]) | (pairs[0][2] & pairs[1][2])]] = APOSTROPHE_2
    return out


def piece_starts(texts: list[str]) -> Iterator[list[int]]:
    """For each text the code point offsets at which its pieces start, and its length last."""
    if not texts:
        return
    joined = "\0".join(texts) + "\0"
    points = _points(joined)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols = symbols_of(points, ends)
    starts = np.flatnonzero(STARTS[symbols, states_before(symbols)])
    cuts = np.searchsorted(starts, ends)
    for first, last, base in zip(np.append(0, cuts[:-1] + 1), cuts + 1, np.append(0, ends[:-1] + 1), strict=True):
        # The mark after a text starts a piece in every state, so it is the last of each slice.
        yield (starts[first:last] - base).tolist()


class RankEncoder:
    """Ids of texts by a rank file, with byte offsets, and their bytes again."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.bytes_of = dict(map(reversed, self.ranks.items()))
        self.lengths = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)
        for k, word in self.bytes_of.items():
            self.lengths[k] = len(word)
        self.pieces = Memo(self._piece, PIECES_HELD)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of the lowest rank is merged, leftmost first, until none has a rank."""
        rank = self.ranks.get
        if (whole := rank(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= SHORT_PIECE:
            return self._merged_short([piece[k : k + 1] for k in range(n)])
        symbols: list[bytes | None] = [piece[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, piece[k : k + 2]) for k in range(n - 1) if (r := rank(piece[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or len(symbols[i]) + len(symbols[j]) != len(both) or symbols[i] + symbols[j] != both:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(wider := both + symbols[k])) is not None:
                    heappush(heap, (r, i, wider))
            if (p := before[i]) >= 0 and (r := rank(wider := symbols[p] + both)) is not None:
                heappush(heap, (r, p, wider))
        return [self.ranks[s] for s in symbols if s is not None]

    def _merged_short(self, symbols: list[bytes]) -> list[int]:
        """``merged`` for a few symbols: the ranks of all adjacent pairs in a list, of which the least is looked for each time."""
        ranks, none = self.ranks, NO_RANK
        pairs = [ranks.get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs and (least := min(pairs)) < none:
            k = pairs.index(least)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(symbols[k] + symbols[k + 1], none)
            if k:
                pairs[k - 1] = ranks.get(symbols[k - 1] + symbols[k], none)
        return [ranks[s] for s in symbols]

    def _piece(self, piece: str) -> bytes:
        return array("i", self.merged(piece.encode())).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (32-bit integers) of each text."""
        made = self.pieces.__getitem__
        for text, at in zip(texts, piece_starts(texts), strict=True):
            yield np.frombuffer(b"".join([made(text[a:b]) for a, b in zip(at, at[1:], strict=False)]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_LOADED: dict[str, RankEncoder] = {}


def rank_encoder(path: str) -> RankEncoder:
    """The worker's encoder of a rank file; it lives as long as the worker."""
    if path not in _LOADED:
        _LOADED[path] = RankEncoder(path)
    alone(_LOADED[path].pieces)
    return _LOADED[path]


def _batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1] or "") > BATCH_POINTS:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1] or "") + 1
    if held:
        yield held


def encode_texts(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, ends): every whole text's ids, without special tokens, and the byte offset at which each ends (32-bit integers; a text has fewer bytes).

    One row per input row, repeated rows included; a null text counts as empty and has empty arrays, a null id stays null; an
    empty table gives no row; other columns are not read. Strings of special tokens are plain text. No shuffle.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        coder = rank_encoder(ranks)
        for batch in _batches(rows):
            for (doc_id, _), ids in zip(batch, coder.encode([t or "" for _, t in batch]), strict=True):
                yield doc_id, ids.tobytes(), np.cumsum(coder.lengths[ids]).astype(np.int32).tobytes()

    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary())])
    return map_rows(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), make, "doc_id long, ids binary, ends binary", arrow)


def decode_ids(encoded: DataFrame, ranks: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``encode_texts``' rows as (doc_id, n_tokens, ids_text, decoded): decimal ids joined by a space, and the bytes of the ids.

    ``first`` and ``last`` take the tokens that lie in those bytes of the text (``last`` exclusive) by their offsets; both default to all.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        coder = rank_encoder(ranks)
        shown = list(map(str, range(len(coder.lengths))))
        for doc_id, data, offsets in rows:
            ids, ends = np.frombuffer(data, np.int32), np.frombuffer(offsets, np.int32)
            starts = ends - coder.lengths[ids]
            a = 0 if first is None else int(np.searchsorted(starts, first))
            b = len(ids) if last is None else int(np.searchsorted(ends, last, "right"))
            ids = ids[a : max(a, b)]
            yield doc_id, len(ids), " ".join(map(shown.__getitem__, ids.tolist())), coder.decode(ids)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_text", pa.string()), ("decoded", pa.binary())])
    return map_rows(encoded.select("doc_id", "ids", "ends"), make, "doc_id long, n_tokens long, ids_text string, decoded binary", arrow)


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of every text's ids and of the bytes that they decode to; rows as ``encode_texts`` has them."""
    back = decode_ids(encode_texts(docs, ranks, id_col, text_col), ranks)
    return back.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
