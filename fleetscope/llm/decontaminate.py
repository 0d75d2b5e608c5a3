"""Benchmark decontamination by spaced-seed hashing.

A seed is a run of words of which fixed masks ignore some places, so a seed still matches where an ignored word was
replaced. Test items and training texts are hashed under every mask, the hashes are joined, and around each hit the
words are compared along the hit's diagonal: a stretch of equal words that tolerates replaced ones is an overlap if it
is long enough and mostly equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, fresh_name
from .arrow import map_rows
from .tokens import Memo, alone

# Masks of weight 6 over up to 13 words; a dot is ignored. Found by greedy choice: every stretch of 13 words
# or more with ``LEAST_SHARE`` of equal ones is hit by one of them (a longer one than 25 holds a shorter one; a test tries all).
MASKS = ("####.##", "##.#...#.##", "#.#...#...###")
#: Items of fewer words are not looked for unless ``least_item`` says so.
LEAST_ITEM = 3
#: Words and share of equal ones that make an overlap.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
_PERCENT = round(100 * LEAST_SHARE)
#: Test hashes (8 bytes each) sent to every executor as a first filter; above this many the join does without.
MOST_FILTER = 1 << 20
_TRIM = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡·"


def _word_hash(chunk: str) -> int:
    """32 bits of a word, lower-cased and without marks at its ends; 0 for none."""
    word = chunk.lower().strip(_TRIM)
    return (xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"), 11) | 1) if word else 0


_WORDS = Memo(_word_hash, 200_000)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words in order."""
    chunks = (text or "").split()
    out = np.fromiter(map(_WORDS.__getitem__, chunks), np.uint32, len(chunks))
    return out[out > 0]


def short_masks(n: int) -> list[str]:
    """Masks over all of an item of ``n`` words, fewer than ``LEAST_WORDS``: of n words parted in e + 2, each ignores e parts, where e words may differ."""
    others = n * (100 - _PERCENT) // 100
    part = [k * (others + 2) // n for k in range(n)]
    return ["".join("." if p in gone else "#" for p in part) for gone in combinations(range(others + 2), others)]


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A 63-bit hash of the mask's places at every position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.int64)
    wide = words.astype(np.uint64)
    out = np.full(n, xxhash.xxh64_intdigest(mask, 5), np.uint64)
    for k, sign in enumerate(mask):
        if sign == "#":
            out = (out ^ wide[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return (out >> np.uint64(1)).astype(np.int64)


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(first item word, words, equal words) of the longest stretch where doc[k + shift] meets item[k] with ``LEAST_SHARE`` of equal words or more."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return 0, 0, 0
    equal = doc[low + shift : high + shift] == item[low:high]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 100 - _PERCENT, -_PERCENT))])
    # For each end the first start whose sum is no larger: lowest sums so far fall, so it is found by bisection.
    starts = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(np.arange(len(total)) - starts))
    start = int(starts[end])
    return low + start, end - start, int(equal[start:end].sum())


def shifts(doc_places: list, item_places: list) -> np.ndarray:
    """The diagonals of a pair, rising: document place less item place, over all its seeds (one list of places on either side for each)."""
    parts = [np.unique(np.asarray(a, np.int64)[:, None] - np.unique(np.asarray(b, np.int64))) for a, b in zip(doc_places, item_places, strict=True)]
    return np.unique(np.concatenate(parts))


def item_seeds(items: DataFrame, id_col: str = "item_id", text_col: str = "text", least: int = LEAST_ITEM) -> tuple[DataFrame, DataFrame]:
    """(item_id, words) of each test item and (seed, item_id, places) of each of its seeds. Items of fewer than ``least`` words give no seed."""

    def words(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item, text in rows:
            yield item, word_hashes(text).tobytes()

    def seeds(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item, data in rows:
            hashed = np.frombuffer(data, np.uint32)
            found: dict[int, list[int]] = {}
            for mask in MASKS if len(hashed) >= LEAST_WORDS else short_masks(len(hashed)) if len(hashed) >= max(1, least) else ():
                for place, seed in enumerate(seed_hashes(hashed, mask).tolist()):
                    found.setdefault(seed, []).append(place)
            for seed, places in found.items():
                yield seed, item, places

    known = cut(map_rows(items.where(items[id_col].isNotNull()).select(items[id_col].alias("item_id"), items[text_col].alias("text")), words, "item_id long, words binary", pa.schema([("item_id", pa.int64()), ("words", pa.binary())])))
    made = map_rows(known, seeds, "seed long, item_id long, item_places array<int>", pa.schema([("seed", pa.int64()), ("item_id", pa.int64()), ("item_places", pa.list_(pa.int32()))]))
    return known, cut(made.distinct())


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_item: int = LEAST_ITEM) -> DataFrame:
    """Per overlapping pair: doc_id, item_id, overlap_words, equal_words (of its longest overlap), overlaps (diagonals that have one).

    An overlap has at least ``LEAST_WORDS`` words, or all of a shorter item's, of which ``LEAST_SHARE`` are equal; items of
    fewer than ``least_item`` words overlap nothing (1 finds them all; one of one or two words is found as an exact copy). Null and
    empty texts overlap nothing; equal doc ids count as one document; rows without an id are left out; other columns are
    not read. Test hashes filter the texts' hashes in each task while they number ``MOST_FILTER`` at most; above that
    every hash goes to the join.
    """
    known, seeds = item_seeds(items, least=least_item)
    n_seeds = seeds.count()
    # Short items' masks are used for the lengths that there are.
    lengths = known.select((F.length("words") / 4).cast("int").alias("n")).where(F.col("n").between(max(1, least_item), LEAST_WORDS - 1)).distinct().collect()
    masks = [*MASKS, *(mask for n in sorted(r[0] for r in lengths) for mask in short_masks(n))]
    small = n_seeds <= MOST_FILTER
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(np.unique(seeds.select("seed").distinct().toArrow()["seed"].to_numpy())) if small else None

    def find(rows: Iterator[tuple]) -> Iterator[tuple]:
        alone(_WORDS)
        table = gate = None
        if wanted is not None:
            table = wanted.value
            gate = np.zeros(1 << 20, bool)
            gate[table & 0xFFFFF] = True
        for doc_id, text in rows:
            words = word_hashes(text)
            at, seed = [], []
            for mask in masks:
                made = seed_hashes(words, mask)
                if table is not None:
                    hit = np.flatnonzero(gate[made & 0xFFFFF])
                    if len(hit):
                        hit = hit[table[np.minimum(np.searchsorted(table, made[hit]), len(table) - 1)] == made[hit]]
                else:
                    hit = np.arange(len(made))
                at.append(hit)
                seed.append(made[hit])
            at, seed = map(np.concatenate, (at, seed))
            if not len(at):
                continue
            data, order = words.tobytes(), np.argsort(seed, kind="stable")
            names, starts = np.unique(seed[order], return_index=True)
            yield doc_id, xxhash.xxh3_64_intdigest(data) >> 1, data, names.tolist(), [x.tolist() for x in np.split(at[order], starts[1:])]

    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("words", pa.binary()), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.list_(pa.int64())))])
    texts = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    held = cut(map_rows(texts, find, "doc_id long, content long, words binary, seeds array<long>, places array<array<long>>", schema))
    hits = held.select("doc_id", "content", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select("doc_id", "content", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("places"))
    met = hits.join(F.broadcast(seeds) if small else seeds, "seed")
    # One row for a document and an item, with the places of the seeds that they share; repeated rows of a document give the same lists.
    shared = met.groupBy("doc_id", "content", "item_id").agg(F.collect_set(F.struct("places", "item_places")).alias("shared"))
    item_words = known.withColumnRenamed("words", "item_words")
    whole = held.groupBy("doc_id", "content").agg(F.first("words").alias("words"))
    pairs = shared.join(whole, ["doc_id", "content"]).join(F.broadcast(item_words) if small else item_words, "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, item_id, places, words, item in zip(batch["doc_id"], batch["item_id"], batch["shared"], batch["words"], batch["item_words"], strict=True):
                doc, item = np.frombuffer(words, np.uint32), np.frombuffer(item, np.uint32)
                best, overlaps = (0, 0), 0
                for shift in shifts([x["places"] for x in places], [x["item_places"] for x in places]).tolist():
                    _, length, equal = best_overlap(doc, item, shift)
                    if length and length >= min(LEAST_WORDS, len(item)) and equal >= LEAST_SHARE * length:
                        best, overlaps = max(best, (length, equal)), overlaps + 1
                if overlaps:
                    out.append((doc_id, item_id, *best, overlaps))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "overlap_words", "equal_words", "overlaps"]).astype("int64")

    found = pairs.select("doc_id", "item_id", "shared", "words", "item_words").mapInPandas(verify, "doc_id long, item_id long, overlap_words long, equal_words long, overlaps long")
    best = F.max(F.struct("overlap_words", "equal_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.sum("overlaps").alias("overlaps")).select("doc_id", "item_id", "best.overlap_words", "best.equal_words", "overlaps")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_item: int = LEAST_ITEM) -> DataFrame:
    """``docs`` without those that overlap a test item; all columns stay, whatever their names.

    Null, empty and blank texts and rows without an id stay. All rows of an id go if one of them overlaps an item.
    """
    gone_id = fresh_name(docs)
    gone = contaminated(docs, items, id_col, text_col, least_item).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs[id_col] == F.col(gone_id), "left_anti")
