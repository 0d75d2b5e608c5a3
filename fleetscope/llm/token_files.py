"""Token files in patched frame-of-reference blocks, written in id order and read back.

A segment is a self-describing byte string: a header, the documents' ids and lengths, an index of block starts, and
blocks of 256 token ids. A block stores every id less the block's minimum at a bit width that holds a fixed share of
them (a percentile); ids that need more bits go to the block's exception list with their places. Segments are rows of a
Parquet table, so that Spark's committer makes a lost or repeated task harmless and any store that Spark reads will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .arrow import map_rows
from .tokens import encoder

#: Ids in a block, share of a block's ids that must fit its width, and ids after which a segment is closed.
BLOCK, FIT_SHARE, SEGMENT_IDS = 256, 0.9, 1 << 18
MAGIC = 0x31464650


_POWERS = 1 << np.arange(33, dtype=np.int64)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below 2^width as rows of bytes, lowest bits first: 64 values fill ``width`` 64-bit words."""
    wide = values.astype(np.uint64).reshape(len(values), -1, 64)
    words = np.zeros((*wide.shape[:2], width + 1), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[:, :, word] |= wide[:, :, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= wide[:, :, k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words[:, :, :width]).astype("<u8").view(np.uint8).reshape(len(values), -1)


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    """The values of ``_packed``."""
    words = np.ascontiguousarray(data).view("<u8").astype(np.uint64).reshape(len(data), -1, width)
    out, mask = np.empty((*words.shape[:2], 64), np.uint64), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, :, k] = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, :, k] |= words[:, :, word + 1] << np.uint64(64 - shift)
    return (out & mask).reshape(len(data), -1)


def pack_ids(ids: np.ndarray, share: float = FIT_SHARE) -> bytes:
    """Patched frame-of-reference blocks of unsigned 32-bit ids: count, then per block minimum, width, exceptions and start, then the blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK), np.uint32)
    padded.reshape(-1)[:n] = ids
    if n % BLOCK:
        padded[-1, n % BLOCK :] = ids[-1]
    least = padded.min(1, initial=2**32 - 1)
    above = padded - least[:, None]
    fit = int(np.ceil(share * BLOCK)) - 1
    widths = np.searchsorted(_POWERS, np.partition(above, fit, 1)[:, fit], "right")
    outlier = above >= _POWERS[widths][:, None]
    n_out = outlier.sum(1)
    sizes = BLOCK // 8 * widths + 5 * n_out
    starts = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == w)
        body[starts[own][:, None] + np.arange(BLOCK // 8 * w)] = _packed(above[own] & np.uint32((1 << w) - 1), w)
    block, place = np.nonzero(outlier)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
    at = starts[block] + BLOCK // 8 * widths[block]
    body[at + nth] = place
    body[(at + n_out[block] + 4 * nth)[:, None] + np.arange(4)] = above[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.asarray([n], "<u4").tobytes() + least.astype("<u4").tobytes() + widths.astype(np.uint8).tobytes() + n_out.astype("<u2").tobytes() + starts.astype("<u4").tobytes() + body.tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    blocks, at = -(-n // BLOCK), 4
    read = lambda kind, k: np.frombuffer(data, kind, blocks, k).astype(np.int64)
    least, widths, n_out, starts = read("<u4", at), read(np.uint8, at + 4 * blocks), read("<u2", at + 5 * blocks), read("<u4", at + 7 * blocks)
    body = np.frombuffer(data, np.uint8, offset=at + 11 * blocks)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == w)
        out[own] = _unpacked(body[starts[own][:, None] + np.arange(BLOCK // 8 * w)], w)
    block = np.repeat(np.arange(blocks), n_out)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
    at = starts[block] + BLOCK // 8 * widths[block]
    out[block, body[at + nth]] = np.ascontiguousarray(body[(at + n_out[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    return (out + least[:, None].astype(np.uint32)).reshape(-1)[:n].astype("<u4")


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Magic, number of documents, their ids with a flag for null, their lengths, then the blocks."""
    head = np.asarray([MAGIC, len(doc_ids)], "<u4").tobytes()
    known = np.asarray([x is not None for x in doc_ids], np.uint8).tobytes()
    return head + known + np.asarray([x or 0 for x in doc_ids], "<i8").tobytes() + np.asarray(lengths, "<u8").tobytes() + pack_ids(ids)


def unpack_segment(data: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    magic, n = map(int, np.frombuffer(data, "<u4", 2))
    if magic != MAGIC:
        raise ValueError("not a token segment")
    known = np.frombuffer(data, np.uint8, n, 8)
    doc_ids = np.frombuffer(data, "<i8", n, 8 + n).tolist()
    lengths = np.frombuffer(data, "<u8", n, 8 + 9 * n).tolist()
    return [x if k else None for x, k in zip(doc_ids, known, strict=True)], lengths, unpack_ids(data[8 + 17 * n :])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of segments: file (range of document ids), segment's place in it, ids before it in the file, ids in it, payload.

    Documents are in ascending id order over all files, null ids first, equal ids by the text's hash and then the text. A null text gives no ids of
    its own, only ``end_id``. An empty table gives no segment. Other columns are not read. One range shuffle.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = encoder(tokenizer).encode
        end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        file, segment, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, n = [], [], 0

        def close() -> tuple:
            return file, segment, before, n, pack_segment(doc_ids, [len(x) // 4 for x in parts], np.frombuffer(b"".join(parts), "<u4"))

        for doc_id, text in rows:
            doc_ids.append(doc_id)
            parts.append(encode(text) + end)
            n += len(parts[-1]) // 4
            if n >= SEGMENT_IDS:
                yield close()
                segment, before = segment + 1, before + n
                doc_ids, parts, n = [], [], 0
        if doc_ids:
            yield close()

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    # A hash of the text parts the rows of one id, so that a frequent id (or null) fills more than one range.
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text"))
    schema = pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
    return written(map_rows(ordered.sortWithinPartitions("doc_id", F.xxhash64("text"), "text"), make, "file int, segment int, ids_before long, n_ids long, payload binary", schema), "token-files", "none")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (little-endian unsigned 32-bit ids).

    Repeated rows and null ids come back row by row, as they were written; no files give no row.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for file, before, payload in rows:
            doc_ids, lengths, ids = unpack_segment(payload)
            data, at = memoryview(ids.tobytes()), 0
            for doc_id, n in zip(doc_ids, lengths, strict=True):
                yield file, doc_id, before + at, n, zlib.crc32(data[4 * at : 4 * (at + n)])
                at += n

    # One row per file, and there are as many files as the range shuffle has partitions, whatever their size.
    totals = sorted(files.groupBy("file").agg(F.sum("n_ids")).collect())
    firsts = dict(zip((f for f, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))
    base = files.sparkSession.createDataFrame(sorted(firsts.items()), "file int, first_id long")
    schema = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    read = map_rows(files.select("file", "ids_before", "payload"), make, "file int, doc_id long, at long, n_tokens long, ids_crc32 long", schema)
    return read.join(F.broadcast(base), "file").select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
