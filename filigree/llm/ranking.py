"""One ranking from several scores on unlike scales, by a rank-walk Markov chain.

From an item the walk picks one of the scores the item carries, more often one that compares many items, and draws
an item of that score's list; it jumps there if the drawn item ranks higher, so that it jumps uniformly to
higher-ranked items, and an item near the top of all its scores is seldom left. With damping it starts anew at any
item. Only ranks count, so no scale or outlier dominates. Items are ordered by their share of the stationary
distribution, relieved of the weight of the scores they lack. One step of the chain is a prefix sum over the items
sorted by each score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import checkpoint

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-5
#: An item's share is divided by this power of the weight it carries: a missing score says nothing against it. An item
#: that lacks scores is drawn that much less often. Chosen on simulated lists with known relevance and scores missing at
#: random (tests/llm/test_ranking.py repeats it), where the order by the bare share loses relevant items.
NULL_RELIEF = 0.75
#: Lists with more entries than this are ranked by the distributed chain, others by one task for many lists.
LIST_ENTRIES = 200_000
#: Entries in one task of the small lists, and in one block of the distributed prefix sums.
TASK_ENTRIES, BLOCK = 400_000, 100_000
_DIGITS = 9


class Chain:
    """The walk over many lists at once; an entry is a score of an item in a channel of its list."""

    def __init__(self, channel: np.ndarray, item: np.ndarray, score: np.ndarray, list_of_item: np.ndarray):
        """channel numbers are distinct across lists; item numbers the rows of list_of_item, the list of each item."""
        order = np.lexsort((-score, channel))
        self.item, channel, score = item[order], channel[order], score[order]
        n = len(order)
        new_segment = np.ones(n, bool)
        new_segment[1:] = channel[1:] != channel[:-1]
        new_tie = new_segment.copy()
        new_tie[1:] |= score[1:] != score[:-1]
        position = np.arange(n)
        begins = lambda starts: np.maximum.accumulate(np.where(starts, position, 0)) if n else position
        ends = lambda starts: np.append(np.flatnonzero(starts)[1:], n)[np.cumsum(starts) - 1] if n else position
        segment, self.tie_end, self.segment_end = begins(new_segment), ends(new_tie), ends(new_segment)
        self.higher, self.compared = begins(new_tie) - segment, self.segment_end - segment
        self.list_of_item, self.lists = list_of_item, int(list_of_item.max(initial=-1)) + 1
        self.size = np.bincount(list_of_item, minlength=self.lists)[list_of_item].astype(float)
        weight = self.compared - 1.0
        self.carried = np.bincount(self.item, weight, minlength=len(list_of_item))
        self.pick = weight / np.maximum(self.carried[self.item], 1.0)

    def step(self, p: np.ndarray, damping: float) -> np.ndarray:
        share = p[self.item] * self.pick
        jump = share / self.compared
        upto = np.concatenate([[0.0], np.cumsum(jump)])
        into = upto[self.segment_end] - upto[self.tie_end] + share - jump * self.higher
        moved = np.bincount(self.item, into, minlength=len(p))
        # An item whose scores compare it with nothing starts anew.
        lost = np.bincount(self.list_of_item, np.where(self.carried > 0, 0.0, p), minlength=self.lists)
        return (1 - damping + damping * lost[self.list_of_item]) / self.size + damping * moved

    def shares(self, damping: float, rounds: int) -> np.ndarray:
        p = 1.0 / self.size
        for _ in range(rounds):
            p, before = self.step(p, damping), p
            if (np.abs(p - before) * self.size).max(initial=0.0) < TOLERANCE:
                break
        return relieved(p, self.carried, self.size)


def relieved(p, carried, size):
    """Shares per item of a list, corrected for the scores an item lacks; 0 for an item that is compared with nothing."""
    return np.where(carried > 0, np.round(p * size / np.maximum(carried / size, 1e-9) ** NULL_RELIEF, _DIGITS), 0.0)


def entries(df: DataFrame, list_col: str, item_col: str, scores: dict[str, list[str]]) -> DataFrame:
    """(list, item, channel, score): one row per score an item carries, the largest where an item comes repeatedly.

    ``scores`` maps a score column to the columns within whose equal values alone it is comparable. A null or NaN score
    is none; the channel of an item without any is null, so that the item stays.
    """
    channels = []
    for name, within in scores.items():
        value = F.col(name).cast("double")
        tag = F.concat_ws("|", F.lit(name), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in within))
        known = value.isNotNull() & ~F.isnan(value)
        channels.append(F.struct(F.when(known, tag).alias("channel"), F.when(known, value).alias("score")))
    rows = df.select(F.col(list_col).alias("list"), F.col(item_col).alias("item"), F.explode(F.array(*channels)).alias("c"))
    once = rows.groupBy("list", "item", F.col("c.channel").alias("channel")).agg(F.max("c.score").alias("score"))
    return once


def _small(rows: DataFrame, tasks: int) -> DataFrame:
    """Shares of the items of small lists; a task holds the lists of one hash value."""
    damping, rounds = DAMPING, ROUNDS

    def run(table: pa.Table) -> pa.Table:
        code = lambda c: c.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lists, channel, item = code(table["list"]), code(table["channel"]), code(table["item"])
        score = np.nan_to_num(table["score"].to_numpy().astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
        known = table["channel"].is_valid().to_numpy()
        _, first, number = np.unique(lists * (item.max(initial=0) + 1) + item, return_index=True, return_inverse=True)
        _, segment = np.unique(lists * (channel.max(initial=0) + 1) + channel, return_inverse=True)
        share = Chain(segment[known], number[known], score[known], lists[first]).shares(damping, rounds)
        at = pa.array(first)
        return pa.table({"list": table["list"].combine_chunks().take(at), "item": table["item"].combine_chunks().take(at), "share": share})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keyed = rows.select(F.pmod(F.xxhash64("list"), F.lit(tasks)).cast("int").alias("task"), "list", "item", "channel", "score")
    return keyed.groupBy("task").applyInArrow(run, f"list {kinds['list']}, item {kinds['item']}, share double")


def running_sum(df: DataFrame, keys: list[str], order: list, value: str, out: str, rows: int) -> DataFrame:
    """df with the running sum of ``value`` in each group of keys, however large: the sorted rows are cut into blocks
    by range, blocks are summed, and a row gets its block's offset plus the sum inside its block."""
    blocks = checkpoint(df.repartitionByRange(max(1, -(-rows // BLOCK)), *keys, *order).withColumn("_b", F.spark_partition_id()))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.groupBy(*keys, "_b").agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_s")
    inside = F.sum(value).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_in", inside).join(offsets, [*keys, "_b"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")


def _safe(df: DataFrame, *keys: str) -> DataFrame:
    """df with the keys wrapped, so that null equals null in joins as it does in groups."""
    return df.withColumns({k: F.struct(F.col(k).alias("k")) for k in keys})


def _bare(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumns({k: F.col(f"{k}.k") for k in keys})


def _large(rows: DataFrame) -> DataFrame:
    """Shares of the items of large lists: the same chain with its prefix sums spread over blocks."""
    rows = checkpoint(_safe(rows, "list", "item"))
    known = rows.filter("channel is not null")
    ties = known.groupBy("list", "channel", "score").agg(F.count("*").alias("n"))
    ranked = running_sum(ties, ["list", "channel"], [F.desc("score")], "n", "upto", known.count())
    sizes = known.groupBy("list", "channel").agg(F.count("*").alias("compared"))
    places = checkpoint(ranked.join(sizes, ["list", "channel"]).select("list", "channel", "score", (F.col("upto") - F.col("n")).alias("higher"), "compared"))
    linked = known.join(places, ["list", "channel", "score"])
    items = rows.select("list", "item").distinct()
    size = items.groupBy("list").agg(F.count("*").alias("size"))
    weight = (F.col("compared") - 1).cast("double")
    carried = linked.groupBy("list", "item").agg(F.sum(weight).alias("carried"))
    items = checkpoint(items.join(size, "list").join(carried, ["list", "item"], "left").na.fill(0.0, ["carried"]).withColumn("p", 1 / F.col("size")))
    linked = checkpoint(linked.join(items.filter("carried > 0").select("list", "item", "carried"), ["list", "item"]).withColumn("pick", weight / F.col("carried")).drop("carried"))
    count = places.count()
    state = items
    for k in range(1, ROUNDS + 1):
        flow = linked.join(state.select("list", "item", "p"), ["list", "item"]).withColumn("share", F.col("p") * F.col("pick"))
        # The mass of equal scores moves together, so that one frequent score is reduced map-side.
        by_score = flow.groupBy("list", "channel", "score").agg(F.sum("share").alias("mass"))
        lower = running_sum(by_score, ["list", "channel"], [F.asc("score")], "mass", "upto", count)
        lower = lower.select("list", "channel", "score", (F.col("upto") - F.col("mass")).alias("lower"))
        moved = (
            flow.join(lower, ["list", "channel", "score"])
            .groupBy("list", "item")
            .agg(F.sum(F.col("lower") / F.col("compared") + F.col("share") * (1 - F.col("higher") / F.col("compared"))).alias("moved"))
        )
        lost = state.groupBy("list").agg(F.sum(F.when(F.col("carried") > 0, 0.0).otherwise(F.col("p"))).alias("lost"))
        p = (1 - DAMPING + DAMPING * F.col("lost")) / F.col("size") + DAMPING * F.coalesce(F.col("moved"), F.lit(0.0))
        new = checkpoint(state.withColumnRenamed("p", "old").join(moved, ["list", "item"], "left").join(lost, "list").withColumn("p", p).drop("moved", "lost"))
        far = new.agg(F.max(F.abs(F.col("p") - F.col("old")) * F.col("size"))).first()[0]
        state = new.drop("old")
        if far is None or far < TOLERANCE:
            break
    relief = F.pow(F.greatest(F.col("carried") / F.col("size"), F.lit(1e-9)), F.lit(NULL_RELIEF))
    share = F.when(F.col("carried") > 0, F.round(F.col("p") * F.col("size") / relief, _DIGITS)).otherwise(0.0)
    return _bare(state.select("list", "item", share.alias("share")), "list", "item")


def fuse_scores(df: DataFrame, list_col: str, item_col: str, scores: dict[str, list[str]], top: int | None = None) -> DataFrame:
    """One ranking per list: (list_col, item_col, share, position), the best first, ties by item.

    Every item comes out once, whatever its scores; items without any score, or alone in all their scores, have the
    share 0 and come last. Null items and null lists are values like others. ``top`` keeps the first positions only.
    Lists of up to LIST_ENTRIES scores are ranked many to a task; a larger one, which may hold any part of all rows,
    by the same chain over distributed prefix sums. Rows are few enough after grouping that no list meets one task.
    """
    rows = entries(df, list_col, item_col, scores)
    counts = checkpoint(rows.groupBy("list").agg(F.count("*").alias("n")))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    tasks = max(1, -(-(total or 0) // TASK_ENTRIES))
    if (largest or 0) <= LIST_ENTRIES:
        shares = _small(rows, max(tasks, min(32, (total or 0) // 5_000)))
    else:
        big = counts.filter(F.col("n") > LIST_ENTRIES).select(F.col("list").alias("big"))
        same = F.col("list").eqNullSafe(F.col("big"))
        shares = _small(rows.join(big, same, "left_anti"), tasks).unionByName(_large(rows.join(big, same, "left_semi")))
    order = [F.desc("share"), F.asc("item")]
    if top is not None and (largest or 0) > LIST_ENTRIES:
        # The best of a list are among the best of its parts, so that no task orders a huge list.
        part = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-largest // BLOCK))))
        shares = shares.withColumn("_n", F.row_number().over(Window.partitionBy("list", part).orderBy(*order))).filter(F.col("_n") <= top).drop("_n")
    if top is not None or (largest or 0) <= LIST_ENTRIES:
        ranked = shares.withColumn("position", F.row_number().over(Window.partitionBy("list").orderBy(*order)))
        ranked = ranked if top is None else ranked.filter(F.col("position") <= top)
    else:
        ranked = _bare(running_sum(_safe(shares.withColumn("one", F.lit(1)), "list"), ["list"], order, "one", "position", total), "list")
    return ranked.select(F.col("list").alias(list_col), F.col("item").alias(item_col), "share", F.col("position").cast("long").alias("position"))
