"""Near copies: texts whose word shingles have a Jaccard similarity of 0.8 or more, as connected groups.

A first pass takes SimHash fingerprints over distinct words through blocks of equal sampled bits and the pivot tables of
``simhash``; it joins most of a large group by few pairs, and a fingerprint goes to as many blocks whatever the number of
texts. An exact prefix filter then gives every other pair that can reach the limit: shingles
have one order, rare ones first, and two sets that are similar enough share one of their first shingles. A shared shingle's
place in both orders bounds what the sets can share from there on, and so do 256 parities of either set, since every
parity that differs shows a shingle that is not shared.

The nodes that share a shingle form a list. Pairs of a short list are judged one by one. A long list's nodes meet in units
of work of bounded size, with all their shingles; a unit compares those that no link joins yet and gives the links that
join them, a tree at most, so that no list makes rows in the square of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, fresh_name, written
from .arrow import map_rows
from .simhash import pivot_table, signed, smallest_reachable, stars
from .tokens import alone

#: Texts looked at for frequent shingles at least, their share of all, how many of them make one frequent, and the most that
#: are kept. Frequent ones go last in the order, which keeps lists short; the filter is exact in any order. A fixed number of
#: texts would let the lists of what is no longer seen as frequent grow with all texts, and what meets in them with the square.
SAMPLE_DOCS, SAMPLE_SHARE, FREQUENT, MOST_FREQUENT = 20_000, 1 / 16, 4, 1 << 20
#: Nodes of a short list; nodes and shingles that a cell of a long list holds; entries of short lists that a task meets at once.
SHORT_LIST, CELL_NODES, CELL_SHINGLES, MEET_ENTRIES = 48, 1024, 250_000, 100_000
#: Nodes of a block of the first pass up to which all its pairs are tried; a larger one's groups are grown.
BLOCK_PAIRS = 64
#: Rows (of 8 to 40 bytes) up to which a counted table is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 1 << 20
_FACTORS = (2 * np.random.default_rng(42).integers(0, 2**63, 64, np.uint64) + np.uint64(1)).tolist()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hashed_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in order, and of the distinct words."""
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), np.fromiter(known.values(), np.uint64, len(known))


def shingle_hashes(hashed: np.ndarray, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles (of the whole sequence if it is shorter), ascending."""
    span = min(shingle, len(hashed))
    n = len(hashed) - span + 1
    out = np.full(n, span, np.uint64)
    for k in range(span):
        out += hashed[k : k + n] * np.uint64(_FACTORS[k])
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def word_print(distinct: np.ndarray) -> int:
    """64 bits; one is set if it is set in over half of the distinct words' hashes. A few changed words move few bits."""
    ones = np.unpackbits(distinct.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(distinct)).tobytes(), "big")


def parities(hashes: np.ndarray) -> bytes:
    """256 bits: whether an odd number of hashes starts with each byte."""
    return np.packbits((np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).tobytes()


def frequent_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the shingles that are frequent in a sample of ``texts`` (text), and their counts there."""
    n = texts.count()
    some = texts.sample(max(SAMPLE_SHARE, SAMPLE_DOCS / n), 7) if n > SAMPLE_DOCS else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(hashed_words(words_of(t))[0], shingle) for t in batch.column(0).to_pylist()]
            if found:
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "n"])

    counted = some.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    table = counted.orderBy(F.desc("n"), "hash").limit(MOST_FREQUENT).toArrow()
    hashes, counts = table["hash"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix_of(hashes: np.ndarray, least: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles by (count in the sample, hash), in this order: sets with a similarity of ``least`` or more share one of them."""
    size = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
    if not len(frequent):
        return hashes[:size]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return hashes[np.argsort(np.where(frequent[at] == hashes, counts[at], 0), kind="stable")[:size]]


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts by all their shingle hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def met_pairs(units: np.ndarray, nodes: np.ndarray, groups: np.ndarray, sizes: np.ndarray, places: np.ndarray, odd: np.ndarray, least: float) -> np.ndarray:
    """Distinct rows (smaller node, larger node) of nodes in one unit but different groups that can reach ``least``.

    ``units`` ascends. ``sizes`` are the sets' sizes, ``places`` the shared shingle's places in the sets' orders, ``odd``
    the sets' parities as four 64-bit words.
    """
    out, at, step = [np.zeros((0, 2), np.int64)], np.arange(len(units)), 1
    while len(at := at[at + step < len(units)]) and len(at := at[units[at] == units[at + step]]):
        other = at + step
        need = np.ceil((sizes[at] + sizes[other]) * (least / (1 + least)) - 1e-6)
        kept = (groups[at] != groups[other]) & (np.minimum(sizes[at] - places[at], sizes[other] - places[other]) >= need)
        a, b, need = at[kept], other[kept], need[kept]
        kept = sizes[a] + sizes[b] - np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64) >= 2 * need
        x, y = nodes[a[kept]], nodes[b[kept]]
        out.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
        step += 1
    return np.unique(np.concatenate(out), axis=0)


def joining_links(cells: np.ndarray, crossing: bool, nodes: np.ndarray, groups: np.ndarray, odd: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Links (node, node) that join all nodes of one unit whose sets have a similarity of ``least`` and that no link joins yet."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    hashes, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), sizes), counts[ids] > 1
    place = np.cumsum(counts > 1)[ids[shared]] - 1
    words = np.zeros((len(sets), int((counts > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(words, (owner[shared], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    label, out = np.unique(groups, return_inverse=True)[1], []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        total = sizes[i] + sizes[j]
        need = np.ceil(total * (least / (1 + least)) - 1e-6)
        j = j[(label[j] != label[i]) & (np.minimum(sizes[i], sizes[j]) >= need) & (cells[j] != cells[i] if crossing else True)]
        total, need = sizes[i] + sizes[j], np.ceil((sizes[i] + sizes[j]) * (least / (1 + least)) - 1e-6)
        j = j[total - np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) >= 2 * need]
        for at in range(0, len(j), 256):
            own = j[at : at + 256]
            both = np.bitwise_count(words[i] & words[own]).sum(1, dtype=np.int64)
            for k in own[both >= least * (sizes[i] + sizes[own] - both)].tolist():
                if label[k] != label[i]:
                    out.append((nodes[i], nodes[k]))
                    label[label == label[k]] = label[i]
    return np.asarray(out, np.int64).reshape(-1, 2)


def held(df: DataFrame) -> DataFrame:
    """``df``, which has been counted, to be broadcast if it has ``MOST_BROADCAST`` rows at most."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def by_unit(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole units (hash, low, high) of rows ascending by unit, some ``entries`` rows together, and each row's key."""
    rows: list[pa.RecordBatch] = []

    def table() -> tuple[pa.Table, np.ndarray]:
        made = pa.Table.from_batches(rows).combine_chunks()
        return made, np.column_stack([made[c].to_numpy() for c in ("hash", "low", "high")])

    for batch in batches:
        rows.append(batch)
        if sum(map(len, rows)) >= entries:
            made, key = table()
            last = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))[-1])  # the last unit may go on
            if last:
                yield made.slice(0, last), key[:last]
                rows = made.slice(last).to_batches()
    if sum(map(len, rows)):
        yield table()


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


def _odd(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["odd"].to_pylist()), np.uint64).reshape(-1, 4)


def sampled_masks(n: int, tables: int) -> list[int]:
    """``tables`` choices of bits, the same in every run, of so many bits that some 20 of ``n`` fingerprints that are not alike share them."""
    size = max(1, n.bit_length() - 5)
    return [sum(1 << int(k) for k in np.random.default_rng(table).choice(64, size, replace=False)) for table in range(tables)]


def print_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between fingerprints within ``distance`` bits that share the bits of one of ``distance`` + 1 choices.

    Two that differ in few bits nearly always do. The more fingerprints there are, the more bits are chosen, so rows and
    blocks grow with them alone; what is missed is for the prefix filter to find.
    """
    masks = sampled_masks(prints.count(), distance + 1)
    cases = F.array(*(F.struct(F.lit(k).alias("low"), F.col("print").bitwiseAND(F.lit(signed(mask))).alias("hash")) for k, mask in enumerate(masks)))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in by_unit(batches, MEET_ENTRIES):
            bits = table["print"].to_numpy().view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            sizes = np.diff(first, append=len(bits))
            unit = np.repeat(np.arange(len(first)), sizes)
            near = sizes > BLOCK_PAIRS
            at, step, out = np.flatnonzero(~near[unit]), 1, [np.zeros((0, 2), np.int64)]
            while len(at := at[at + step < len(unit)]) and len(at := at[unit[at] == unit[at + step]]):
                near[unit[at[np.bitwise_count(bits[at] ^ bits[at + step]) <= distance]]] = True
                step += 1
            for k in np.flatnonzero(near).tolist():
                own = bits[first[k] : first[k] + sizes[k]]
                if found := stars(own, pivot_table(own), distance):
                    out.append(own.view(np.int64)[np.asarray(found)])
            links = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    dealt = prints.select("print", F.inline(cases)).withColumn("high", F.lit(0))
    return dealt.repartition("low", "hash").sortWithinPartitions("low", "hash", "print").mapInArrow(link, "a long, b long").distinct()


def prefix_pairs(lists: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """Distinct (p, q) of the short lists' nodes that are of different groups and can have a similarity of ``least``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in by_unit(batches, MEET_ENTRIES):
            units = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            pairs = met_pairs(units, *_columns(table, "node", "group", "n", "place"), _odd(table), least)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["p", "q"])

    short = entries.join(held(lists.where(F.col("m") <= SHORT_LIST).select("hash")), "hash").select("hash", F.lit(0).alias("low"), F.lit(0).alias("high"), "node", "group", "n", "place", "odd")
    return short.repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(meet, "p long, q long").distinct()


def long_links(lists: DataFrame, entries: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(p, q): links that join the long lists' nodes. ``sets`` has (node, whole).

    Lists with the same nodes are met once. Of a list, the nodes of its largest group meet the others only; both are dealt
    to cells of bounded size, and every two cells that must meet are a unit.
    """
    alike = lists.where(F.col("m") > SHORT_LIST).groupBy("m", "all", "mix").agg(F.min("hash").alias("hash"))
    large = cut(entries.join(held(cut(alike.select("hash"))), "hash").select("hash", "node", "group", "n", "odd"))
    of_group = large.groupBy("hash", "group").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    cells = lambda m, s: F.ceil(F.greatest(m / CELL_NODES, s / CELL_SHINGLES)).cast("int")
    top = F.max(F.struct("m", "group", "s")).alias("top")
    sized = of_group.groupBy("hash").agg(top, F.sum("m").alias("m"), F.sum("s").alias("s")).select("hash", F.col("top.group").alias("main"), cells(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("rest"), cells(F.col("top.m"), F.col("top.s")).alias("inner"))
    # Cells 0 .. rest - 1 hold the nodes outside the largest group, the cells after them those inside it.
    own = F.when(F.col("group") == F.col("main"), F.col("rest") + F.pmod(F.xxhash64("node"), "inner")).otherwise(F.pmod(F.xxhash64("node"), "rest")).cast("int")
    celled = large.join(sized, "hash").withColumn("cell", own)
    # A list that fits one unit is one; else a cell meets itself and every other one, inner cells the rest's only.
    whole = (F.col("rest") == 1) & (F.col("inner") == 1)
    others = F.when(whole, F.array(F.lit(0))).when(F.col("cell") >= F.col("rest"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("inner") - 1))
    at = F.when(whole, 0).otherwise(F.col("cell"))
    units = celled.withColumn("other", F.explode(others)).withColumn("cell", at).select("hash", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "node", "group", "odd")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in by_unit(batches, 1):
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]])).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                part = table.slice(a, b - a)
                found = joining_links(part["cell"].to_numpy(), key[a, 1] != key[a, 2], *_columns(part, "node", "group"), _odd(part), [np.frombuffer(x, np.uint32) for x in part["whole"].to_pylist()], least)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["p", "q"])

    # A row carries all shingles of a text; Spark bounds the bytes of an Arrow batch.
    own_sets = cut(sets.join(held(cut(large.select("node").distinct())), "node", "left_semi"))
    carried = units.join(own_sets, "node").repartition("hash", "low", "high").sortWithinPartitions("hash", "low", "high", "node")
    return carried.mapInArrow(meet, "p long, q long").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, distance: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, component_id (smallest doc_id that links reach), over texts whose shingles have a similarity of ``least`` or more.

    Words part at ASCII blanks, A-Z are lower-cased; fewer words than ``shingle`` make one shingle. Equal word sequences
    are one node; null, empty and blank texts are equal to each other. Rows with a null id keep it, pass links on and get
    the smallest id there is, null if there is none. Repeated rows stay, an empty table gives no row, whole texts of any
    length are read, other columns are not.
    """
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts.select("text"), shingle))

    def content_of(words: list[bytes]) -> bytes:
        return xxhash.xxh3_128_digest(b" ".join(words))

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        alone()
        row = TaskContext.get().partitionId() << 33
        for doc_id, text in rows:
            words = words_of(text)
            hashed, distinct = hashed_words(words)
            hashes = shingle_hashes(hashed, shingle)
            whole = np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes()
            yield row, doc_id, content_of(words), signed(word_print(distinct)), len(whole) // 4, parities(hashes), whole, prefix_of(hashes, least, *frequent.value).view(np.int64)
            row += 1

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("content", pa.binary()), ("print", pa.int64()), ("n", pa.int64()), ("odd", pa.binary()), ("whole", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    read = written(map_rows(texts, make, "row long, doc_id long, content binary, print long, n long, odd binary, whole binary, prefix array<long>", schema), "shingles")
    # A text's node is the smallest of its rows.
    nodes = cut(read.groupBy("content").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min("print").alias("print")))
    prints = cut(nodes.groupBy("print").agg(F.min("node").alias("first")))
    links = cut(print_links(prints.select("print"), distance))
    # A fingerprint's first text speaks for it; what that leaves unjoined meets by the prefix filter.
    same = nodes.join(prints, "print").where("node <> first").select(F.col("first").alias("p"), F.col("node").alias("q"))
    across = links.where("a <> b").join(prints.select(F.col("print").alias("a"), F.col("first").alias("p")), "a").join(prints.select(F.col("print").alias("b"), F.col("first").alias("q")), "b").select("p", "q")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(p, q) >= least for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(near, pa.bool_())).select([0, 1])

    def judged(pairs: DataFrame) -> DataFrame:
        """The (p, q) of ``pairs`` that are similar enough."""
        ends = cut(pairs.select(F.col("p").alias("row")).unionByName(pairs.select(F.col("q").alias("row"))).distinct())
        sets = cut(read.select("row", "whole").join(held(ends), "row", "left_semi"))
        both = pairs.join(sets.select(F.col("row").alias("p"), F.col("whole").alias("of_p")), "p").join(sets.select(F.col("row").alias("q"), F.col("whole").alias("of_q")), "q")
        return cut(both.select("p", "q", "of_p", "of_q").mapInArrow(judge, "p long, q long"))

    first = judged(cut(same.unionByName(across).distinct()))
    joined = smallest_reachable(nodes.select(F.col("node").alias("print"), F.col("node").alias("least")), first.toDF("a", "b")).toDF("node", "group")
    all_nodes = held(cut(nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("group", "node").alias("group"))))
    # A row that is no node (its text stands before) drops out here.
    numbered = written(read.select(F.col("row").alias("node"), "n", "odd", "prefix").join(all_nodes, "node"), "shingle-nodes")
    # Most shingles are in one text alone; they go before anything but their places is read.
    places = numbered.select("node", F.posexplode("prefix").alias("place", "hash"))
    shared = cut(places.groupBy("hash").count().where("count > 1").select("hash"))
    found = written(places.join(shared, "hash").join(numbered.select("node", "group", "n", "odd"), "node"), "shared-shingles")
    # An entry whose place lets it share enough with not even the smallest set of its list is of no use.
    smallest = found.groupBy("hash").agg(F.min("n").alias("n_min"))
    enough = F.ceil((F.col("n") + F.greatest(F.col("n_min"), least * F.col("n"))) * (least / (1 + least)) - 1e-6)
    entries = written(found.join(smallest, "hash").where(F.col("n") - F.col("place") >= enough).drop("n_min"), "list-entries")
    discard(numbered, found)
    mix = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    lists = cut(entries.groupBy("hash").agg(F.count("*").alias("m"), mix(1).alias("all"), mix(2).alias("mix"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").drop("lo", "hi"))
    links = first.unionByName(judged(cut(prefix_pairs(lists, entries, least))))
    links = links.unionByName(long_links(lists, entries, read.select(F.col("row").alias("node"), "whole"), least))
    links = cut(links.toDF("a", "b"))
    discard(entries)
    linked = smallest_reachable(nodes.select(F.col("node").alias("print"), "least"), links).withColumnRenamed("print", "node")
    components = cut(nodes.join(linked, "node", "left").select("content", F.coalesce("component_id", "least").alias("component_id")))
    return read.select("doc_id", "content").join(components, "content", "left").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents of a group other than its smallest id; all columns stay, whatever their names.

    Groups are those of ``near_copies``: null and blank texts are one group. Rows with a null id stay; rows that repeat
    the smallest id all stay.
    """
    gone_id = fresh_name(docs)
    gone = near_copies(docs, shingle, least, id_col=id_col, text_col=text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs[id_col] == F.col(gone_id), "left_anti")
