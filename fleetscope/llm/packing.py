"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces go largest
first into the open sequence that, of those where the piece fits every capacity, is left with the smallest weighted
norm of its residual shares; a piece that fits none opens a new one. Pieces are dealt into groups of bounded size by a
hash, each group is packed in one task, and at most a sequence or so per group is left part empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrow import map_rows
from .tokens import encoder

#: Pieces in a group, on average.
GROUP_PIECES = 4096


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence and the weight of each residual share in the norm."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Only documents above ``limit`` ids are cut, into pieces of ``limit`` ids.

    A null text counts as empty; without an end id an empty text gives one piece of length 0. Rows with equal or null ids are packed row by row.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = encoder(tokenizer).encode
        end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        for doc_id, text in rows:
            ids = encode(text) + end
            for piece, start in enumerate(range(0, max(1, len(ids)), 4 * limit)):
                part = ids[start : start + 4 * limit]
                yield doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return map_rows(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), make, "doc_id long, piece int, start long, length long, ids_crc32 long", schema)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, in the given order (largest first packs best)."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.asarray([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weights = np.asarray(capacity.weights) / full**2
    left, names, used = np.zeros((n, 3)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    opened = live = 0
    smallest = lengths.min(initial=0)
    for i, length in enumerate(lengths.tolist()):
        need = np.asarray([length, 1, length * length], np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rest = left[:live] - need
        fits = np.flatnonzero((rest >= 0).all(1))
        if len(fits):
            at = fits[np.argmin((rest[fits] ** 2) @ weights)]
        else:
            at, live = live, live + 1
            left[at], names[at], used[at] = full, opened, 0
            opened += 1
        left[at] -= need
        bins[i], offsets[i] = names[at], used[at]
        used[at] += length
        if left[at, 0] < max(1, smallest) or left[at, 1] < 1:  # nothing more fits
            live -= 1
            left[at], names[at], used[at] = left[live], names[live], used[live]
    return bins, offsets


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset (gapless from 0 in each sequence). An empty table stays empty.

    Repeated pieces are packed one by one; equal lengths go by id, piece and checksum. Of the three capacities only those
    that a caller sets low enough bind: with the defaults a sequence is full by tokens first, as pieces have a token or more.
    """
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = best_fit(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["pack_group"].astype("int64") * (1 << 32) + bins, offset=offsets).drop(columns="pack_group")

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(groups)).cast("int"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return dealt.groupBy("pack_group").applyInPandas(run, ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity.tokens, id_col, text_col), capacity)
