"""Source divergence audit: how far the sources of a language lie apart in their smoothed term shares.

Copies of a text are summed up in the tasks that read them, so one row for each (language, source, text) and task is shuffled
by text; there equal texts of a language lie side by side, are tokenized once, and count for each source as often as it
holds them. What is left are counts by (language, source, term). Pairs of sources are evaluated sparsely: a term that neither
source has adds the same amount for all such terms, one that only one of them has is read from that source's histogram of
counts, and only terms that both have are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .arrow import SLICE_ROWS, map_rows
from .tokens import alone

#: Copies are summed up, and term counts held, in a task until they have so many characters, or so many entries.
COMBINE_CHARS, COUNT_ENTRIES = 16_000_000, 400_000
#: Texts after which a task counts the entries that it holds.
CHECK_ROWS = 256
#: Parts into which the sources of a language are dealt when they meet each other.
SALTS = 16
#: Bytes of no term become blanks, A-Z become a-z, all others stay: the bytes of letters beyond ASCII lie above 127.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, only A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_PLAIN).split()


def collapsed(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, text, copies): equal rows of a task as one, so that a text with very many copies is a few rows."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        alone()
        held: dict[tuple, int] = {}
        size = 0
        for row in rows:
            if row in held:
                held[row] += 1
                continue
            held[row] = 1
            size += len(row[2]) + 100
            if size > COMBINE_CHARS:
                yield from ((*k, n) for k, n in held.items())
                held, size = {}, 0
        yield from ((*k, n) for k, n in held.items())

    own = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    types = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string()), ("copies", pa.int64())])
    return map_rows(own, make, "lang string, source string, text string, copies long", types)


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, count, documents) of ``collapsed`` rows: occurrences, and documents that hold the term, copies counted."""
    met = rows.withColumn("h", F.xxhash64("lang", "text")).repartition("lang", "text").sortWithinPartitions("h", "lang", "text").select("lang", "source", "text", "copies")

    def told(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in held.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            numbers = (np.fromiter(x, np.int64, len(counts)) for x in (counts.values(), map(documents.__getitem__, counts)))
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), terms, *map(pa.array, numbers)]
            table = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "documents"])
            yield from (table.slice(k, SLICE_ROWS * 4) for k in range(0, len(terms), SLICE_ROWS * 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        last, terms, once = None, [], set()
        for batch in batches:
            for k, (lang, source, text, copies) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
                if (lang, text) != last:
                    # The same text of other sources follows it, and isn't taken apart again.
                    last, terms = (lang, text), terms_of(text)
                    once = set(terms)
                if not terms:
                    continue
                counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
                if copies == 1:
                    counts.update(terms)
                    documents.update(once)
                else:
                    for term, n in Counter(terms).items():
                        counts[term] += n * copies
                        documents[term] += copies
                if k % CHECK_ROWS == 0 and sum(len(c) for c, _ in held.values()) >= COUNT_ENTRIES:
                    yield from told(held)
                    held = {}
        yield from told(held)

    made = met.mapInArrow(run, "lang string, source string, term string, count long, documents long")
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact; 1 is never divided by nothing where a term is kept."""
    wide = lambda c: c.cast("decimal(28,0)")
    return (F.lit(1) + F.call_function("div", wide(F.lit(1_000_000_000)).cast("decimal(10,0)") * wide(count + 5), wide(total + 5 * kept))).cast("long")


def divergence(docs: DataFrame, least_documents: int = 30, most_ranks: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each (language, source), part ``pair`` ranks the other sources of the language by the
    sum of share differences over all kept terms, part ``term`` its ``most_ranks`` terms whose share exceeds the language's most.

    A language keeps the terms of at least ``least_documents`` of its documents. Null texts, languages and sources are empty
    strings; a source without a kept term still has its pairs, with 0 where the language keeps none. Ties go by the item's
    bytes; repeated rows are documents of their own; other columns are not read; an empty table gives no row.
    """
    counts = written(term_counts(collapsed(docs, lang_col, source_col, text_col)), "divergence-counts")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("lang_count")).where(F.col("documents") >= least_documents)
    kept = written(counts.join(by_lang.select("lang", "term", "lang_count"), ["lang", "term"]).select("lang", "source", "term", "count", "lang_count"), "divergence-kept")
    seen = docs.select(F.coalesce(docs[lang_col], F.lit("")).alias("lang"), F.coalesce(docs[source_col], F.lit("")).alias("source")).distinct()
    langs = kept.select("lang", "term", "lang_count").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    own = seen.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(own.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_n", zero).alias("lang_n")).withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v"))).otherwise(0)), "divergence-groups")
    # ``p`` is the source's share of a term it has, ``p0`` its share of any other.
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("lang_count"), F.col("lang_n"), F.col("v")).alias("q"), "p0")
    return _pairs(groups, shares).unionByName(_terms(shares, most_ranks))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(shares: DataFrame, most: int) -> DataFrame:
    return _ranked(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term").where(F.col("rank") <= most)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """With a and b the shares of absent terms: V |a - b|, and for terms of one source |p - b| - |a - b| more than that, and for terms of both a correction."""
    # The pairs are the rows of the result; a language's sources meet in parts, so that one language is many tasks.
    dealt = groups.withColumn("salt", F.pmod(F.hash("source"), F.lit(SALTS)))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = dealt.join(other, ["lang", "salt"]).where("source <> item").select("lang", "source", "item", "v", "p0", "b")
    pairs = met.select("lang", "source", "item", (F.col("v") * F.abs(F.col("p0") - F.col("b"))).alias("value"))
    heights = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    alone_ = met.join(heights, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("b")) - F.abs(F.col("p0") - F.col("b")))).alias("value"))
    left, right = shares.select("lang", "term", F.col("source"), "p", F.col("p0").alias("a")), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("b"))
    p, q, a, b = map(F.col, "pqab")
    both = left.join(right, ["lang", "term"]).where("source < item")
    shared = both.groupBy("lang", "source", "item").agg(F.sum(F.abs(p - q) - F.abs(p - b) - F.abs(a - q) + F.abs(a - b)).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = pairs.unionByName(alone_).unionByName(turned(alone_)).unionByName(shared).unionByName(turned(shared))
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
