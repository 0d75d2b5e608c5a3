"""Secrets in texts, also under layers of URL escapes, Unicode escapes, base64 and compression.

Each text is scanned, then unwrapped by a worklist: every layer found is decoded, scanned and put back on the list until
nothing new appears. A layer is known by its span in the text and its contents; one that was seen already is not
unwrapped again, so self-reproducing data ends. Every layer keeps a map of its characters to the original text, and
what is found there is reported by the original span that it came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .tokens import alone

KINDS = ("assign", "access", "hex")
# The patterns of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)+")
ONE_ESCAPE = re.compile(r"[\\&][uUx#]\{?([xX]?)([0-9A-Fa-f]+)[};]?")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines; escapes mixed with the characters that URL quoting leaves; starts of compressed data.
#: A run is tried at its first character only and gives nothing back, so that a long one is read once.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
QUOTED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/-])+")
MAGIC = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\0|\x28\xb5\x2f\xfd")

#: How base64 of compressed data begins.
HEADS = frozenset(("H4", "eA", "eF", "eJ", "eN", "Ql", "/T", "_T", "KL"))

#: Decompressed data are read in windows of so many bytes, each of which begins with the last ``OVERLAP`` bytes of the one before.
WINDOW, OVERLAP = 16_000_000, 1_000_000
STRETCH = re.compile(rb"[\x20-\x7e\t\r\n]{12,}")
#: Bytes looked at to see whether compressed data begin there, and characters of all layers of a text, beyond which layers are
#: not unwrapped but counted as unread: data that expand without end must not hold a task for ever.
PROBE, MOST_UNWRAPPED = 3072, 200_000_000


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every match, leftmost and non-overlapping per kind, short ones dropped, in report order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """A text and, for runs of its characters, where they came from: (first character, origin start, origin end, copied).

    A copied run maps character by character; each character of another run maps to the run's whole origin.
    """

    text: str
    runs: list[tuple[int, int, int, bool]]

    def __post_init__(self) -> None:
        self.firsts = [r[0] for r in self.runs]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        a, b = (self.runs[bisect_right(self.firsts, k) - 1] for k in (start, end - 1))
        return a[1] + (start - a[0] if a[3] else 0), b[1] + (end - b[0]) if b[3] else b[2]


def _replaced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """``layer`` with the given (start, end, text) pieces put in; pieces map as one run each."""
    out, runs, at, length = [], [], 0, 0

    def put(text: str, run: tuple[int, int, bool]) -> None:
        nonlocal length
        if text:
            runs.append((length, *run))
            out.append(text)
            length += len(text)

    ends = [*layer.firsts[1:], len(layer.text)]

    def copy(start: int, end: int) -> None:
        k = bisect_right(layer.firsts, start) - 1
        while start < end:
            first, low, high, copied = layer.runs[k]
            b = min(end, ends[k])
            put(layer.text[start:b], (low + start - first, low + b - first, True) if copied else (low, high, False))
            start, k = b, k + 1

    for start, end, text in pieces:
        copy(at, start)
        put(text, (*layer.origin(start, end), False))
        at = end
    copy(at, len(layer.text))
    return Layer("".join(out), runs or [(0, 0, 0, False)])


def _percent(run: str) -> str:
    """The run's text; a byte that is not UTF-8 shows as U+FFFD and does not hide the others."""
    return bytes.fromhex(run.replace("%", "")).decode(errors="replace")


def _escaped(run: str) -> str | None:
    """Characters of a run of escapes; surrogate pairs are joined, a run with lone ones stays."""
    codes = []
    for m in ONE_ESCAPE.finditer(run):
        decimal = run[m.start()] == "&" and not m[1]
        codes.append(int(m[2], 10 if decimal else 16))
    if any(c > 0x10FFFF for c in codes):
        return None
    try:
        return "".join(map(chr, codes)).encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return None


def _members(data: bytes) -> Iterator[bytes]:
    """The data that compressed ``data`` hold, in parts of at most ``WINDOW`` bytes, over all members and streams that follow each other. A break ends them with ValueError."""
    while data:
        if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
            stream, size = zlib.decompressobj(47), "max_length"
        elif data[:3] == b"BZh":
            stream, size = bz2.BZ2Decompressor(), "max_length"
        elif data[:6] == b"\xfd7zXZ\0":
            stream, size = lzma.LZMADecompressor(memlimit=1 << 28), "max_length"
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            stream, size = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), ""
        else:
            return
        try:
            part = data
            while not stream.eof:
                out = stream.decompress(part, **({size: WINDOW} if size else {}))
                for at in range(0, len(out), WINDOW):
                    yield out[at : at + WINDOW]
                part = getattr(stream, "unconsumed_tail", b"")
                if not out and not part and not stream.eof:
                    raise ValueError("cut off")
            data = stream.unused_data
        except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError) as error:
            raise ValueError("broken") from error


def _inflate(data: bytes) -> Iterator[bytes | None]:
    """Windows of what compressed data hold; nothing for other data; None last where they break off after some."""
    held = b""
    try:
        for part in _members(data):
            held += part
            if len(held) >= WINDOW:
                yield held
                held = held[-OVERLAP:]
    except ValueError:
        if held:
            yield held
            yield None
        return
    if held:
        yield held


def _opens(data: bytes, at: int = 0) -> bool:
    """Whether compressed data may begin at ``at``: the right first bytes, and no error in those that follow at once."""
    if not MAGIC.match(data, at):
        return False
    head = data[at : at + PROBE]
    try:
        next(_members(head), None)
    except ValueError as error:
        return str(error) == "cut off" and len(data) - at > PROBE
    return True


def _readable(data: bytes) -> str | None:
    """``data`` as text: UTF-8 without control characters other than blanks, else UTF-16, else its printable stretches of 12 bytes or more, a line each; None without any."""
    try:
        text = data.decode()
        if not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text):
            return text or None
    except UnicodeDecodeError:
        pass
    for name, zeros in (("utf-16-le", data[1::2]), ("utf-16-be", data[::2])):
        if len(data) >= 16 and zeros.count(0) > 0.4 * len(zeros):
            return data[: len(data) // 2 * 2].decode(name, "replace").replace("\0", " ")
    found = STRETCH.findall(data)
    return b"\n".join(found).decode() if found else None


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _promising(head: str) -> str:
    """What base64 that begins with ``head`` can be: "text", "data" for compressed data, or nothing."""
    data = _base64(head[: len(head) // 4 * 4])
    if data is None:
        return ""
    if MAGIC.match(data):
        return "data" if _opens(data) else ""
    shown = data[:12].decode(errors="ignore").encode()
    return "text" if len(shown) >= min(len(data), 12) - 3 and _readable(shown) is not None else ""


def _base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of everything to try as base64: whole runs, their parts after '/', '_' and '-', and wrapped lines put together.

    From a break on, a run is read to its end once for each of the four ways in which base64 can lie in it, as a later start
    that lies alike reads the end of the same bytes; a break where compressed data begin is read on its own.
    """
    for m in BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
        breaks = [k.end() for k in re.finditer(r"[/_-]", m[0])]
        lain = set()
        for at, after in zip([0, *breaks], [*breaks, len(m[0]) + 1], strict=True):
            if len(m[0]) - at < 16 or not (kind := _promising(m[0][at : at + PROBE] if m[0][at : at + 2] in HEADS else m[0][at : at + 16])):
                continue
            if at and (kind == "data" or at % 4 not in lain):
                yield m.start() + at, m.end(), m[0][at:]
            if kind == "text":
                lain.add(at % 4)
            if breaks and after - 1 - at >= 16 and after <= len(m[0]):
                yield m.start() + at, m.start() + after - 1, m[0][at : after - 1]
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + k.start(), m.start() + k.end()) for k in LINE.finditer(m[0])]
        k = 0
        while k + 1 < len(lines):
            width, last = lines[k + 1][1] - lines[k + 1][0], k + 1
            # The second line tells the width, or the first where there are but two.
            width = max(width, lines[k][1] - lines[k][0]) if last + 1 == len(lines) or lines[last + 1][1] - lines[last + 1][0] > width else width
            while last + 1 < len(lines) and lines[last][1] - lines[last][0] == width:
                last += 1
            for start in {lines[k][0], max(lines[k][0], lines[k][1] - width)}:
                for end in (last, last - 1):
                    if end > k:
                        yield start, lines[end][1], text[start : lines[k][1]] + "".join(text[a:b] for a, b in lines[k + 1 : end + 1])
            k = max(k + 1, last - 1)


def unwrap(layer: Layer) -> Iterator[Layer | None]:
    """The layers directly under ``layer``, one at a time; None for compressed data that break off."""
    text = layer.text
    for sign, pattern, decoded in (("%", PERCENT, _percent), ("", ESCAPES, _escaped)):
        if sign in text and (sign or "\\" in text or "&#" in text):
            pieces = [(m.start(), m.end(), t) for m in pattern.finditer(text) if (t := decoded(m[0])) is not None]
            if pieces:
                yield _replaced(layer, pieces)

    def read(start: int, end: int, data: bytes | None) -> Iterator[Layer | None]:
        """What ``data`` say: decompressed as long as they can be, else as text."""
        opened = False
        if data is not None and MAGIC.match(data):
            for window in _inflate(data):
                opened = True
                if window is None:
                    yield None
                else:
                    yield from read(start, end, window)
        if data is not None and not opened and (shown := _readable(data)) is not None:
            yield Layer(shown, [(0, *layer.origin(start, end), False)])

    for start, end, run in _base64_runs(text):
        yield from read(start, end, _base64(run))
    if "%" in text:
        for m in QUOTED.finditer(text):
            if "%" in m[0] and MAGIC.search(data := unquote_to_bytes(m[0])):
                for k in MAGIC.finditer(data):
                    for window in _inflate(data[k.start() :]) if _opens(data, k.start()) else ():
                        if window is None:
                            yield None
                        else:
                            yield from read(m.start(), m.end(), window)


def secret_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans, layers unwrapped, and layers that are not read whole: compressed data that break off (what comes
    before the break is read), and layers found after ``MOST_UNWRAPPED`` characters of others, which are scanned but not unwrapped.

    The worklist goes down one layer at a time and holds one layer of each depth, whatever their number.
    """
    text = text or ""
    base = scan(text)
    digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
    spans, seen, layers, broken = set(base), {(0, len(text), digest(text))}, 0, 0
    work, unwrapped = [unwrap(Layer(text, [(0, 0, len(text), True)]))], 0
    while work:
        layer = next(work[-1], StopIteration)
        if layer is StopIteration:
            work.pop()
            continue
        if layer is None:
            broken += 1
            continue
        key = (layer.runs[0][1], layer.runs[-1][2], digest(layer.text))
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        spans.update((*(o := layer.origin(a, b))[:1], kind, o[1]) for a, kind, b in scan(layer.text))
        unwrapped += len(layer.text)
        if unwrapped > MOST_UNWRAPPED:
            broken += 1
        else:
            work.append(unwrap(layer))
    return base, sorted(spans), layers, broken


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex and base_sha256 of the plain text's matches, spans (all, with those of decoded layers), layers, unread_layers (those not read whole).

    A null text counts as empty; repeated rows stay; an empty table gives no row; other columns are not read. No shuffle.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            base, spans, layers, unread = secret_spans(text)
            yield doc_id, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(told(base).encode()).hexdigest(), told(spans), layers, unread

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "unread_layers"]
    text = {"base_sha256", "spans"}
    schema = pa.schema([(n, pa.string() if n in text else pa.int64()) for n in names])
    return map_rows(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), make, ", ".join(f"{n} {'string' if n in text else 'long'}" for n in names), schema)


def redacted(text: str | None, mask: str = "[SECRET]") -> str | None:
    """``text`` with every found span, overlapping ones as one, put as ``mask``."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in secret_spans(text)[1]:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in ``text_col`` and ``length_col`` (if there is one) counted anew where the text changed; all rows and columns stay.

    A null text stays null, an empty one empty; equal texts are masked alike, whatever their ids.
    """

    @F.pandas_udf("string")
    def mask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        alone()
        for texts in parts:
            yield pd.Series([redacted(t) for t in texts], dtype=object)

    names = docs.columns
    out = docs.withColumn(text_col, mask(docs[text_col]))
    if length_col in names:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), length_col))
    return out.select(*names)
