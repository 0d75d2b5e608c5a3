"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) of a ring. A key belongs to the first point clockwise from its hash; keys
that meet a full shard go on clockwise to the first point whose shard has room. The ring is cut into a fixed number of
slots, so the placement is worked out from one count per slot, and each key finds its shard by its slot and its rank in
the slot. Balance is guaranteed by the capacities, and a shard more or less moves few keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Slots of the ring and points of each shard. Counts and runs of keys held by the driver number a few per slot at most.
SLOTS, POINTS = 1 << 16, 128


def ring(shards: int, points: int = POINTS) -> tuple[list[int], list[int]]:
    """Places (slots) and owners of all virtual nodes, clockwise."""
    placed = sorted((xxhash.xxh64_intdigest(f"{shard}:{k}", seed=7) % SLOTS, shard, k) for shard in range(shards) for k in range(points))
    return [p for p, _, _ in placed], [s for _, s, _ in placed]


def exact_capacities(total: int, shards: int) -> list[int]:
    """Row capacities that sum to ``total`` and are at most one apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def place(counts: dict[int, int], capacities: Sequence[int], points: int = POINTS) -> list[tuple[int, int, int, int, int]]:
    """Runs of keys (slot, first rank, rank after the last, shard, the first one's place in the shard), slots in clockwise order of arrival."""
    if sum(capacities) < sum(counts.values()):
        raise ValueError("the shards can't hold all keys")
    places, owners = ring(len(capacities), points)
    room, filled, n = list(capacities), [0] * len(capacities), len(places)
    onward = list(range(n))  # from a point to the first one clockwise that may have room

    def open_point(k: int) -> int:
        path = []
        while True:
            if onward[k] != k:
                path.append(k)
                k = onward[k]
            elif not room[owners[k]]:
                onward[k] = (k + 1) % n
            else:
                break
        for p in path:
            onward[p] = k
        return k

    first, k = {}, 0
    for slot in sorted(counts):
        while k < n and places[k] < slot:
            k += 1
        first[slot] = k % n
    runs = []
    for slot in sorted(counts):
        rank, count = 0, counts[slot]
        while rank < count:
            shard = owners[open_point(first[slot])]
            take = min(count - rank, room[shard])
            runs.append((slot, rank, rank + take, shard, filled[shard]))
            room[shard] -= take
            filled[shard] += take
            rank += take
    return runs


def shard_rows(docs: DataFrame, shards: int = 40, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and 16), text_crc32, shard, slot (gapless from 0 in each shard).

    With ``slack`` 0 row counts are at most one apart; with slack e no shard holds more than (1 + e) times its even share,
    rounded up, and fewer keys move when the shard count changes. Null texts count as empty, a null id is one more key,
    repeated rows take a slot each; an empty table gives no row. One shuffle of ids and sizes; texts stay where they are.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    keys = cut(docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(docs[id_col]).alias("key_hash")))
    keys = keys.withColumn("ring_slot", F.pmod("key_hash", F.lit(SLOTS)).cast("int"))
    counts = {r[0]: r[1] for r in keys.groupBy("ring_slot").count().collect()}  # at most SLOTS rows
    total = sum(counts.values())
    capacities = exact_capacities(total, shards) if not slack else [-(-int(total * (1 + slack)) // shards)] * shards
    runs = keys.sparkSession.createDataFrame(place(counts, capacities), "ring_slot int, first_rank long, end_rank long, shard int, first_place long")
    ranked = keys.withColumn("slot_rank", F.row_number().over(Window.partitionBy("ring_slot").orderBy("key_hash", "doc_id", "text_crc32", "size")) - 1)
    inside = (F.col("slot_rank") >= F.col("first_rank")) & (F.col("slot_rank") < F.col("end_rank"))
    # At most SLOTS runs and one more for each time a shard is full.
    joined = ranked.join(F.broadcast(runs), "ring_slot").where(inside)
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first_place") + F.col("slot_rank") - F.col("first_rank")).cast("long").alias("slot"))
