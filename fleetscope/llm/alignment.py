"""Cross-tokenizer alignment over distinct texts: byte spans of two tokenizers cut into common groups, pair counts over the corpus.

Texts are shuffled whole, so that equal ones meet; each distinct text is encoded by both tokenizers and aligned once, and
counts for as many documents as hold it. Aligned texts are written in blocks of bounded size. A block lists its distinct id
pairs once, with the documents that link them, and each text refers to that list; so what is shuffled for the corpus-wide
counts, and sent back, is a row for each block and pair and not one for each text and pair.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .arrow import map_rows
from .tokens import CHUNK_MEMO, LETTERS, Encoder, Memo, alone

#: Entries (a text's distinct pairs) that a block holds before it ends; a text with more is a block of its own.
BLOCK_ENTRIES = 1 << 19
#: A group of more links than this is counted by its distinct ids.
WIDE_GROUP = 64
#: A text held by more than this share of all rows has its measures broadcast; there are fewer than its inverse of them.
HOT_SHARE = 0.001
#: A run of spaces and what follows it: no piece of the second vocabulary crosses the start of one.
SPACED = regex.compile(r" +[^ ]*")


def own_key(text: Column) -> Column:
    """The SHA-256 that stands for a text once equal texts have met."""
    return F.unhex(F.sha2(text, 256))


class ByteLevelSide:
    """Byte-level ids of ' ' + text, special strings as plain text, and each id's length in bytes."""

    def __init__(self, path: str):
        self.coder = Encoder(path)
        self.coder.special, self.coder.library.encode_special_tokens = [], True
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = {letter: b for b, letter in LETTERS.items()}
        self.pieces: list[bytes] = [b""] * self.coder.library.get_vocab_size(True)
        for word, k in vocab.items():
            self.pieces[k] = bytes(byte_of[c] for c in word)
        self.memos = [self.coder.chunks, self.coder.pieces]

    def encode(self, text: str) -> bytes:
        return self.coder.encode(" " + text)


class PieceSide:
    """SentencePiece ids of text (the model adds a space in front), and each id's bytes.

    The merges that lie in different runs of spaces-and-word never meet, as no piece has a space after another character
    (checked when the model is read; without that a text is encoded whole), so a run seen before costs one look-up.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        shown = [self.model.id_to_piece(k) for k in range(n)]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(shown)]
        self.parted = not any("▁" in p.lstrip("▁") for p in shown)
        self.chunks = Memo(self._chunk, CHUNK_MEMO)
        self.memos = [self.chunks]

    def _chunk(self, chunk: str) -> bytes:
        # An empty text gets no space in front, so a lone one at a text's end is looked up.
        return array("i", self.model.encode(chunk[1:]) if chunk != " " else [self.model.piece_to_id("▁")]).tobytes()

    def encode(self, text: str) -> bytes:
        # U+2581 in a text reads as a space.
        if not self.parted or "▁" in text:
            return self._chunk(" " + text)
        return b"".join(map(self.chunks.__getitem__, SPACED.findall(" " + text)))


@dataclass
class Aligned:
    """What one text gives: tokens of either side, groups, links, digest text, and its distinct pairs with their links."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: np.ndarray
    links: np.ndarray


class Aligner:
    """Aligns texts by two vocabularies; a pair of ids is one number, ``a * self.width + b``."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevelSide(path_a), PieceSide(path_b)
        self.width = len(self.b.pieces)
        self.length_a, self.length_b = (np.array([len(p) for p in side.pieces], np.int64) for side in (self.a, self.b))
        a, b = ([str(k) for k in range(len(side.pieces))] for side in (self.a, self.b))
        #: Digest text of a token: A inside and last in its group, B inside and last.
        self.shown = [k + mark for side, marks in ((a, ",|"), (b, ",;")) for mark in marks for k in side]

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None where either side's bytes are not a space and the text."""
        if not text:
            return None
        a, b = np.frombuffer(self.a.encode(text), np.int32), np.frombuffer(self.b.encode(text), np.int32)
        whole = b" " + text.encode()
        for side, ids in ((self.a, a), (self.b, b)):
            if b"".join(map(side.pieces.__getitem__, ids.tolist())) != whole:
                return None
        return a, b

    def align(self, a: np.ndarray, b: np.ndarray) -> Aligned:
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        # Ids of no bytes are no token of any text, so the ends of a side rise strictly.
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        first_b = np.cumsum(n_b) - n_b
        wide = n_a * n_b > WIDE_GROUP
        # Small groups: every A token beside every B token of its group.
        taken = np.flatnonzero(~wide[group_a])
        partners = n_b[group_a[taken]]
        left = np.repeat(a[taken].astype(np.int64), partners)
        step = np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners, partners)
        right = b[np.repeat(first_b[group_a[taken]], partners) + step]
        pairs, links = np.unique(left * self.width + right, return_counts=True)
        if wide.any():
            parts, counts = [pairs], [links]
            first_a = np.cumsum(n_a) - n_a
            for g in np.flatnonzero(wide).tolist():
                x, k = np.unique(a[first_a[g] : first_a[g] + n_a[g]].astype(np.int64), return_counts=True)
                y, m = np.unique(b[first_b[g] : first_b[g] + n_b[g]].astype(np.int64), return_counts=True)
                parts.append((x[:, None] * self.width + y).ravel())
                counts.append((k[:, None] * m).ravel())
            pairs, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            links = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        last_a, last_b = np.append(np.diff(group_a) > 0, True), np.append(np.diff(group_b) > 0, True)
        codes = np.concatenate([a + last_a * len(self.a.pieces), 2 * len(self.a.pieces) + b + last_b * self.width])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown = "".join(map(self.shown.__getitem__, codes[order].tolist()))[:-1]
        return Aligned(len(a), len(b), len(cuts), int((n_a * n_b).sum()), shown, pairs, links.astype(np.int64))


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two tokenizer files; it lives as long as the worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    made = _LOADED[path_a, path_b]
    alone(*made.a.memos, *made.b.memos)
    return made


def _packed(*parts: np.ndarray) -> bytes:
    """Rising places and their links, compressed: differences of places, then links."""
    places, links = parts
    return zstandard.ZstdCompressor(level=1).compress(np.diff(places, prepend=0).astype("<u4").tobytes() + links.astype("<u4").tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")
    n = len(both) // 2
    return np.cumsum(both[:n].astype(np.int64)), both[n:].astype(np.int64)


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_distinct(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``texts`` (key, text, copies) aligned: one row for each text, and for each block one with its list of pairs.

    A text's row has block, key, copies, n_a, n_b, n_groups, n_links, groups_sha256 and entries (places in the block's list, and
    links); a block's row has block, pairs and documents (how many, copies counted, hold each pair linked) alone. Links of one
    pair in one text are taken to fit 32 bits.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        own, part, block = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def closed() -> Iterator[tuple]:
            name = part << 32 | block
            pairs, inverse = np.unique(np.concatenate([x.pairs for _, _, x in held]), return_inverse=True)
            weights = np.repeat([copies for _, copies, _ in held], [len(x.pairs) for _, _, x in held])
            documents = np.zeros(len(pairs), np.int64)
            np.add.at(documents, inverse, weights)
            at = 0
            for key, copies, x in held:
                entries = _packed(inverse[at : at + len(x.pairs)], x.links)
                at += len(x.pairs)
                yield name, key, copies, x.n_a, x.n_b, x.n_groups, x.n_links, x.groups, entries, None, None
            yield name, None, None, None, None, None, None, None, None, pairs.tolist(), documents.tolist()

        for key, text, copies in rows:
            ids = own.ids(text)
            if ids is None:
                yield None, key, copies, 0, 0, 0, 0, "", None, None, None
                continue
            x = own.align(*ids)
            x.groups = hashlib.sha256(x.groups.encode()).hexdigest()
            held.append((key, copies, x))
            size += len(x.pairs)
            if size >= BLOCK_ENTRIES:
                yield from closed()
                held, size, block = [], 0, block + 1
        if held:
            yield from closed()

    schema = "block long, key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, entries binary, pairs array<long>, documents array<long>"
    longs = pa.list_(pa.int64())
    types = (pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary(), longs, longs)
    names = [part.split()[0] for part in schema.split(", ")]
    return map_rows(texts.select("key", "text", "copies"), make, schema, pa.schema(list(zip(names, types, strict=True))))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(block, pair, count, best): for every pair of every block, how many documents of all blocks hold it linked, and whether no other pair of its A id has more."""
    listed = aligned.where(F.col("pairs").isNotNull()).select("block", F.explode(F.arrays_zip("pairs", "documents")).alias("e"))
    # Dealt by pair once; the sums and the join both keep to that.
    dealt = listed.select("block", F.col("e.pairs").alias("pair"), F.col("e.documents").alias("documents")).repartition("pair")
    counts = dealt.groupBy("pair").agg(F.sum("documents").alias("count"))
    # One row for each A id, so no larger than the vocabulary.
    most = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("count").alias("most"))
    known = counts.join(F.broadcast(most), F.expr(f"pair div {width}") == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return dealt.join(known, "pair").select("block", "pair", "count", "best")


def measured(aligned: DataFrame, width: int) -> DataFrame:
    """(key, copies, measures, groups_sha256) of every distinct text; a text's counts come from its block's list."""
    texts = aligned.where(F.col("entries").isNotNull()).select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pair"), F.lit(0).cast("long").alias("count"), F.lit(False).alias("best"), "key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries")
    counts = pair_counts(aligned, width).select("block", F.lit(0).alias("kind"), "pair", "count", "best")
    met = counts.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "pair")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's counts come first, in the order of its list, then its texts."""
        block, held, best, ready = None, [], [], False
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            out = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                if kinds[a] == 0:
                    if blocks[a] != block or ready:
                        block, held, best, ready = blocks[a], [], [], False
                    held.append(batch.column("count").slice(a, b - a).to_numpy())
                    best.append(batch.column("best").slice(a, b - a).to_numpy(zero_copy_only=False))
                    continue
                if not ready:
                    counts, top, ready = np.concatenate(held), np.concatenate(best).astype(np.int64), True
                for i, data in enumerate(batch.column("entries").slice(a, b - a).to_pylist(), a):
                    places, links = _unpacked(data)
                    out.append((i, int((links * top[places]).sum()), int((links * counts[places]).sum())))
            rows = batch.take(pa.array([i for i, _, _ in out], pa.int64()))
            sums = pa.array([n for _, n, _ in out], pa.int64()), pa.array([n for _, _, n in out], pa.int64())
            columns = [rows.column(c) for c in ("key", "copies", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*columns, *sums, rows.column("groups_sha256")], names=["key", "copies", *MEASURES, "groups_sha256"])

    schema = "key binary, copies long, " + ", ".join(f"{c} long" for c in MEASURES) + ", groups_sha256 string"
    plain = aligned.where(F.col("block").isNull()).select("key", "copies", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    return met.mapInArrow(make, schema).unionByName(plain)


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    Null and empty texts, and those that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty
    digest. Repeated rows and rows without an id count as documents of their own; an empty table gives no row; other columns
    are not read. A hot text is one row once its task has summed it up, and its documents take its measures by broadcast.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    full = own.where("text is not null and text <> ''")
    texts = full.groupBy("text").agg(F.count("*").alias("copies")).select(own_key(F.col("text")).alias("key"), "text", "copies")
    aligned = written(align_distinct(texts, path_a, path_b), "aligned")
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    told = written(measured(aligned, width), "alignment")
    rows = told.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    columns = [*MEASURES, "groups_sha256"]
    hot = told.where(F.col("copies") > HOT_SHARE * rows)
    keyed = full.select("doc_id", own_key(F.col("text")).alias("key")).join(F.broadcast(hot.select("key", F.struct(*columns).alias("hot"))), "key", "left")
    found = keyed.where("hot is not null").select("doc_id", "hot.*")
    rest = keyed.where("hot is null").join(told.where(F.col("copies") <= HOT_SHARE * rows).select("key", *columns), "key").select("doc_id", *columns)
    empty = own.where("text is null or text = ''").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in MEASURES), F.lit("").alias("groups_sha256"))
    return found.unionByName(rest).unionByName(empty)
