"""Images in Netpbm and BMP: decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import written
from .arrow import map_rows

#: Row length of the images that hold payloads, and the tile's side.
WIDTH, TILE = 64, 16
#: Samples that are summed at once.
BAND_SAMPLES = 1 << 20


def encode_pgm(gray: np.ndarray) -> bytes:
    height, width = gray.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(gray, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with a largest value up to 65535, as rows of samples (three planes last for colour). Comments in the header are skipped."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    numbers, at = [], 2
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not found:
            raise ValueError("broken Netpbm header")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, top = *numbers[:2], (numbers[2] if len(numbers) > 2 else 1)
    planes = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * planes
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"\s|#[^\n]*", b"", data[at:]), np.uint8)[:n] - 48
    elif kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split()[:n], np.uint16)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(flat) != n:
        raise ValueError("a Netpbm image ends early")
    flat = 1 - flat if kind in (b"P1", b"P4") else flat
    flat = flat.astype(np.uint16 if top > 255 else np.uint8)
    return flat.reshape((height, width, 3) if planes == 3 else (height, width))


def encode_bmp(gray: np.ndarray) -> bytes:
    """An 8-bit BMP with a grey palette, rows from the bottom."""
    height, width = gray.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = gray[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1078 + rows.size, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette, 24 or 32 bits; grey palettes give one plane, others red, green and blue."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"a BMP of {bits} bits with compression {packed} can't be read")
    up, height = height > 0, abs(height)
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)[:, : width * bits // 8]
    rows = rows[::-1] if up else rows
    if bits > 8:
        return np.ascontiguousarray(rows.reshape(height, width, bits // 8)[:, :, 2::-1])
    palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size)[: 4 * 256].reshape(-1, 4)[:, 2::-1]
    shown = palette[np.minimum(rows, len(palette) - 1)]
    return np.ascontiguousarray(shown[:, :, 0] if (palette[:, :1] == palette).all() else shown)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def to_gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.asarray([0.299, 0.587, 0.114])


def integral_rows(gray: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows ``wanted`` (ascending) of the integral image, summed in bands, so that no copy of a large image is made."""
    band = max(1, BAND_SAMPLES // max(1, gray.shape[1]))
    out, running, at = np.zeros((len(wanted), gray.shape[1] + 1)), np.zeros(gray.shape[1]), 0
    for k, row in enumerate(wanted.tolist()):
        while at < row:
            running += gray[at : min(row, at + band)].sum(0, dtype=np.float64)
            at = min(row, at + band)
        out[k, 1:] = running.cumsum()
    return out


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, whole and part samples weighed by their share, from an integral image."""
    rows, columns = gray.shape

    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.linspace(0, n, cells + 1)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, (at - low)[:, None]

    low, part = edges(rows, height)
    wanted = np.unique(np.concatenate([low, low + 1]))
    table = integral_rows(gray, wanted)
    above, below = table[np.searchsorted(wanted, low)], table[np.searchsorted(wanted, low + 1)]
    lines = (above + part * (below - above)).T
    low, part = edges(columns, width)
    sums = (lines[low] + part * (lines[low + 1] - lines[low])).T
    cells = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    return cells * (height * width / (rows * columns))


def difference_hash(gray: np.ndarray) -> str:
    """64 bits as 16 hex digits: is a cell of an 8 by 9 reduction darker than its right neighbour."""
    small = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(gray: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(gray, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written media table (doc_id, n_bytes, media): each whole text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as a PGM of 64 columns.

    A null text counts as empty and gives one row of zeros. One row per input row; other columns are not read; no shuffle.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            raw = (text or "").encode()
            payload = raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")
            yield doc_id, len(raw), encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return written(map_rows(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), make, "doc_id long, n_bytes long, media binary", schema), "media")


def media_features(media: DataFrame) -> DataFrame:
    """From the stored bytes of Netpbm or BMP images: the samples' digests, the NPY tile and the difference hash.

    A row whose bytes are null or no readable image keeps its id and sizes; its other values are null. Very long texts are
    summed in bands; repeated rows stay; an empty table gives no row.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, n_bytes, data in rows:
            try:
                image = decode(data or b"")
            except ValueError:
                yield doc_id, n_bytes, None, None, None, data and len(data), data and hashlib.sha256(data).hexdigest(), None, None
                continue
            payload, gray = image.tobytes(), to_gray(image)
            tile = npy_tile(gray)
            yield doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(gray), tile

    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature tile".split()
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string", "binary"]
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return map_rows(media.select("doc_id", "n_bytes", "media"), make, ", ".join(map(" ".join, zip(names, kinds, strict=True))), pa.schema([(n, arrow[k]) for n, k in zip(names, kinds, strict=True)]))


def write_tiles(media: DataFrame) -> DataFrame:
    """The written table of ``media_features``, tiles as NPY bytes with it; read back from it."""
    return written(media_features(media), "tiles")
