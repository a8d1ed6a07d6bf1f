"""Filling containers of fixed capacity by large-item matching over the histogram of sizes.

There are at most ``capacity`` different sizes, so the plan is made on the driver from their counts alone and its cost
does not grow with the number of items. Items above a third of the capacity go at most two to a container: the
largest is matched with the largest partner that still fits. The others go by descending size into the container
with the least room that holds them, and into new containers where none does. The plan is a list of slots (size, first rank,
count, first container); an item finds its slot by its rank among the items of its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import checkpoint

#: Items of one size are ranked in blocks of about this many, so that no task holds all items of a size.
BLOCK = 200_000


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Slots (size, first rank, count, first container) for sizes 1..capacity, and the number of containers."""
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    if any(s > capacity for s in left):
        raise ValueError("an item exceeds the capacity; split it first")
    used: dict[int, int] = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of containers (first, count)
    by_room: list[int] = []
    bins = 0

    def place(size: int, first: int, n: int) -> None:
        slots.append((size, used[size], n, first))
        used[size] += n
        left[size] -= n

    def keep(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in rooms:
                rooms[room] = []
                insort(by_room, room)
            rooms[room].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1
        while i >= 0 and (left[large[i]] < 1 or (large[i] == a and left[a] < 2)):
            i -= 1
        if i < 0:
            n = left[a]
            place(a, bins, n)
            keep(capacity - a, bins, n)
        else:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            place(a, bins, n)
            place(b, bins, n)
            keep(capacity - a - b, bins, n)
        bins += n
        large = [s for s in large if left[s]] if i >= 0 and not left[large[i]] else large
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            i = bisect_left(by_room, s)
            if i < len(by_room):
                room = by_room[i]
                first, have = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    by_room.pop(i)
                n = min(left[s], have)
                place(s, first, n)
                keep(room - s, first, n)
                keep(room, first + n, have - n)
            else:
                each = capacity // s
                n = max(1, left[s] // each)
                each = min(each, left[s])
                for _ in range(each):
                    place(s, bins, n)
                keep(capacity - each * s, bins, n)
                bins += n
    return slots, bins


def _rank_in_size(items: DataFrame, id_col: str) -> DataFrame:
    """rank: the place, from 0, of each item among those of its size; by blocks of the id's hash, then id and piece."""
    total = items.count()
    blocks = max(1, -(-total // BLOCK))
    blocked = items.withColumn("block", F.pmod(F.xxhash64(F.col(id_col), "piece_no"), F.lit(blocks)).cast("int"))
    sums = blocked.groupBy("tokens", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("tokens", "block").orderBy(id_col, "piece_no")) - 1
    return blocked.withColumn("inside", inside).join(sums.withColumn("before", before).drop("n"), ["tokens", "block"]).withColumn("rank", F.col("inside") + F.col("before")).drop("block", "inside", "before")


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = 2048) -> DataFrame:
    """Containers for items of the given sizes: (id_col, piece_no, token_start, tokens, container_id).

    An item above the capacity is cut into full pieces and a rest; no other is split. Null and negative sizes count as
    0; empty items take no room and are spread evenly over the containers (container 0 where there are none). Repeated
    ids are items of their own. Containers are numbered from 0 without gaps. Every item comes out.
    """
    n = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long")
    cap = F.lit(capacity).cast("long")
    last = F.greatest(F.ceil(n / cap) - 1, F.lit(0))
    items = checkpoint(
        sizes.select(F.col(id_col), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece_no"))
        .select(id_col, "piece_no", (F.col("piece_no") * cap).alias("token_start"), F.least(cap, F.col("_n") - F.col("piece_no") * cap).alias("tokens"))
    )
    # At most capacity + 1 rows come to the driver, whatever the number of items.
    counts = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    slots, bins = plan(counts, capacity)
    shift = np.int64(1) << 40
    slots.sort()
    key = np.array([s * shift + r for s, r, _, _ in slots], np.int64)
    rank0, bin0 = (np.array([s[i] for s in slots], np.int64) for i in (1, 3))
    ranked = _rank_in_size(items, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("tokens").to_numpy(zero_copy_only=False), np.int64)
            rank = np.asarray(batch.column("rank").to_numpy(zero_copy_only=False), np.int64)
            at = np.maximum(np.searchsorted(key, size * shift + rank, side="right") - 1, 0)
            where = bin0[at] + rank - rank0[at] if len(key) else np.zeros(len(rank), np.int64)
            where = np.where(size == 0, rank % max(bins, 1), where)
            columns = [batch.column(c) for c in (id_col, "piece_no", "token_start", "tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(where, pa.int64())], [id_col, "piece_no", "token_start", "tokens", "container_id"])

    kind = items.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece_no long, token_start long, tokens long, container_id long")
