"""Pairs of rows that meet by a key and lie within a distance of their bit sketches, in vectorized blocks.

Rows are shuffled once by key and sorted by it; tasks read them in batches, keep the rows of an unfinished key open, and
look at all pairs of a key in blocks of bounded size, whatever the number of rows of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs looked at at once.
BLOCK = 1 << 20


def close_pairs(key: np.ndarray, asks: np.ndarray, stored: np.ndarray, after: np.ndarray, sketch: np.ndarray, most: np.ndarray, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking row, stored row, distance) of pairs of one key whose sketches differ in at most ``most`` bits of the asker.

    Rows are ordered by key, keys whole. An asker with ``after`` meets only rows behind it. sketch has a row of 64-bit
    words each; a row may meet itself, unless ``after``.
    """
    if not len(key):
        return
    block = block or BLOCK
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    askers, holders = np.flatnonzero(asks), np.flatnonzero(stored)
    begin = np.searchsorted(holders, np.where(after[askers], askers + 1, first[group[askers]]))
    many = np.searchsorted(holders, np.append(first, len(key)))[group[askers] + 1] - begin
    begin, askers, many = begin[many > 0], askers[many > 0], many[many > 0]
    ends = np.cumsum(many)
    words = np.ascontiguousarray(sketch).view(np.uint64).reshape(len(key), -1)
    ours, theirs = ([np.ascontiguousarray(words[rows, k]) for k in range(words.shape[1])] for rows in (askers, holders))
    limit = most[askers].astype(np.int16)
    # An asker with more holders than a block meets them in several.
    for low in range(0, int(ends[-1]) if len(ends) else 0, block):
        high = min(low + block, int(ends[-1]))
        i, j = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right") + 1
        inside = np.minimum(ends[i:j], high) - np.maximum(ends[i:j] - many[i:j], low)
        y = np.arange(low, high) + np.repeat(begin[i:j] - (ends[i:j] - many[i:j]), inside)
        apart = np.zeros(len(y), np.int16)
        for k in range(min(2, len(ours))):
            apart += np.bitwise_count(np.repeat(ours[k][i:j], inside) ^ theirs[k][y])
        keep = np.flatnonzero(apart <= np.repeat(limit[i:j], inside))
        x, y, apart = np.repeat(np.arange(i, j), inside)[keep], y[keep], apart[keep]
        for k in range(2, len(ours)):
            apart = apart + np.bitwise_count(ours[k][x] ^ theirs[k][y])
        keep = apart <= limit[x]
        yield askers[x[keep]], holders[y[keep]], apart[keep]


def by_key(found: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function over rows sorted by their first column, that hands whole keys to ``found`` as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            # The last key may go on in the next batch; rows before it are complete, with what waits.
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield from found([np.concatenate(c) for c in zip(*waiting, [c[:cut] for c in columns])])
                waiting = []
            elif waiting and waiting[-1][0][-1] != columns[0][0]:
                yield from found([np.concatenate(c) for c in zip(*waiting)])
                waiting = []
            waiting.append([c[cut:] for c in columns])
        if waiting:
            yield from found([np.concatenate(c) for c in zip(*waiting)])

    return run
