"""Order statistics of a moving window, kept up to date sample by sample."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa

#: Values of a block before it is split in two.
BLOCK = 512


class SortedWindow:
    """A multiset of numbers in sorted blocks: insert and remove touch one block, ``at`` finds a rank by bisection over block lengths."""

    def __init__(self, values: list[float] = ()):
        own = sorted(values)
        self.blocks = [own[k : k + BLOCK] for k in range(0, len(own), BLOCK)]
        self.tops = [b[-1] for b in self.blocks]
        self.ends: list[int] | None = None
        self.n = len(own)

    def add(self, value: float) -> None:
        self.n += 1
        self.ends = None
        if not self.blocks:
            self.blocks, self.tops = [[value]], [value]
            return
        k = min(bisect_left(self.tops, value), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, value)
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[k : k + 1] = [block[BLOCK - 1], block[-1]]
        else:
            self.tops[k] = block[-1]

    def remove(self, value: float) -> None:
        k = bisect_left(self.tops, value)
        block = self.blocks[k]
        del block[bisect_left(block, value)]
        self.n -= 1
        self.ends = None
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]

    def at(self, rank: int) -> float:
        if self.ends is None:
            self.ends = list(accumulate(map(len, self.blocks)))
        k = bisect_right(self.ends, rank)
        return self.blocks[k][rank - (self.ends[k - 1] if k else 0)]

    def median(self) -> float:
        low, high = self.at((self.n - 1) // 2), self.at(self.n // 2)
        return low if low == high else (low + high) / 2

    def _farthest(self, middle: float, count: int) -> float:
        """Distance of the ``count``-th closest value to ``middle``: the closest ones are a run of ranks, found by bisection from both its sides."""
        low, high = 0, self.n - count
        while low < high:
            k = (low + high) // 2
            if middle - self.at(k) > self.at(k + count) - middle:
                low = k + 1
            else:
                high = k
        return max(abs(self.at(low) - middle), abs(self.at(low + count - 1) - middle))

    def mad(self, middle: float) -> float:
        """Median of the distances to ``middle``."""
        low, high = self._farthest(middle, (self.n + 1) // 2), self._farthest(middle, self.n // 2 + 1)
        return low if low == high else (low + high) / 2


def window_stats(t: np.ndarray, x: np.ndarray, window: float, rows: np.ndarray) -> np.ndarray:
    """(median, mad, samples, least, most) of the values in [t - window, t] at each of ``rows`` (rising places in the rising times ``t``); NaN values are no samples."""
    out = np.full((len(rows), 5), np.nan)
    out[:, 2] = 0
    if not len(rows):
        return out
    kept = np.flatnonzero(~np.isnan(x))
    times, values = t[kept], x[kept].tolist()
    firsts = np.searchsorted(times, t[rows] - window, "left").tolist()
    lasts = np.searchsorted(times, t[rows], "right").tolist()
    held, low, high = SortedWindow(), 0, 0
    for k, (first, last) in enumerate(zip(firsts, lasts, strict=True)):
        if first >= high or last - high > held.n:
            held, low, high = SortedWindow(values[first:last]), first, last
        while high < last:
            held.add(values[high])
            high += 1
        while low < first:
            held.remove(values[low])
            low += 1
        if held.n:
            middle = held.median()
            out[k] = middle, held.mad(middle), held.n, held.at(0), held.at(held.n - 1)
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups of ``keys`` from batches that are sorted by them, one at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            if names[a] != key:
                if held:
                    yield pa.Table.from_batches(held)
                held, key = [], names[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def group_blocks(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of ``keys`` from batches that are sorted by them, many at a time (some ``least`` rows, or one larger group), with the places where they begin."""

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    rows, enough = 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = begins(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts[:-1]
            rest = table.slice(starts[-1])
            held, rows = rest.to_batches(), rest.num_rows
            # A group that goes on is put together anew only once it has doubled.
            enough = max(least, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, begins(table)
