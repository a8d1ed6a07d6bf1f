"""Cutting oversized texts into pieces at natural boundaries, with overlap.

Offsets are UTF-16 units: a prefix sum over the code points' widths maps between units and code points. Boundaries (ends
of paragraphs, lines, sentences, words) are sorted arrays; for each piece a binary search finds the last boundary
within the limit, the strongest kind first. The next piece begins at a boundary at most ``overlap`` units back. Where
no boundary lies in reach the cut is hard, but never inside a surrogate pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 800, 100
#: Boundaries from strong to weak: the end of each match is a place to cut.
_BOUNDARIES = [regex.compile(p) for p in (r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*", r"\r\n|\r|\n", r"[.!?…][\"'”’»)\]]*\s+|[。！？][」』）]*", r"[,;:]\s+|[、，；：]", r"\s+")]
#: A strong boundary counts only in the last part of the room, lest pieces become tiny.
_LEAST_FILL = 0.5


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text, in the JVM: two bytes each."""
    return F.coalesce(F.octet_length(F.encode(text, "UTF-16BE")) / 2, F.lit(0)).cast("long")


def cut(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str, str]]:
    """Pieces (char_start, char_end, cut kind, text) of a text, offsets in UTF-16 units, in order.

    Every piece has at most ``limit`` units, begins no later than its predecessor's end and at most ``overlap`` units
    before it; together they cover the text. The kind says how the piece ends: end, paragraph, line, sentence, clause,
    word or hard. An empty or null text gives no piece.
    """
    if limit < 2 or not 0 <= overlap <= limit // 2:
        raise ValueError("the limit must be 2 or more and the overlap at most half of it")
    if not text:
        return []
    wide = any(c > "￿" for c in text)
    units = np.fromiter(accumulate((1 + (c > "￿") for c in text), initial=0), np.int64) if wide else np.arange(len(text) + 1)
    total = int(units[-1])
    kinds = ("paragraph", "line", "sentence", "clause", "word")
    ends = [units[np.fromiter((m.end() for m in p.finditer(text)), np.int64)] for p in _BOUNDARIES] if total > limit else []
    every = np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
    point = lambda u: int(np.searchsorted(units, u))

    def last(bounds: np.ndarray, low: int, high: int) -> int:
        """The last boundary in (low, high], or -1."""
        i = int(np.searchsorted(bounds, high, side="right")) - 1
        return int(bounds[i]) if i >= 0 and bounds[i] > low else -1

    def following(at: int) -> int:
        """The next boundary, or the end."""
        i = int(np.searchsorted(every, at, side="right"))
        return int(every[i]) if i < len(every) else total

    pieces, start = [], 0
    while True:
        if total - start <= limit:
            pieces.append((start, total, "end", text[point(start) :]))
            return pieces
        stop, kind = -1, "hard"
        previous_end = pieces[-1][1] if pieces else start
        floor = max(previous_end, start + int(limit * _LEAST_FILL))
        for name, bounds in zip(kinds, ends):
            if (stop := last(bounds, floor, start + limit)) > 0:
                kind = name
                break
        if stop < 0 and (stop := last(every, max(previous_end, start + overlap), start + limit)) > 0:
            kind = "word"
        if stop < 0 and (near := last(every, max(previous_end, start), start + limit)) > 0 and following(near) - near <= limit:
            # A boundary near the start, if the run behind it then fits as a whole.
            stop, kind = near, "word"
        if stop < 0:
            # Hard cut: the last code point that still fits as a whole.
            stop = int(units[int(np.searchsorted(units, start + limit, side="right")) - 1])
        pieces.append((start, stop, kind, text[point(start) : point(stop)]))
        back = int(np.searchsorted(every, max(stop - overlap, start + 1)))
        begin = int(every[back]) if back < len(every) and every[back] <= stop else -1
        if begin < 0:
            begin = int(units[int(np.searchsorted(units, stop - overlap))])
        if kind != "hard" and following(stop) - stop <= limit < following(stop) - begin:
            # A shorter step back where the next run would not fit as a whole.
            begin = int(every[int(np.searchsorted(every, following(stop) - limit))])
        # Without overlap where a step back would leave no room for the next code point.
        fits = int(units[point(stop) + 1]) - begin <= limit
        start = begin if start < begin < stop and fits else stop


def split_texts(df: DataFrame, text_col: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text: the key columns, piece_no, char_start, char_end, cut_kind, piece_text and text_units.

    Texts within the limit pass as one piece without leaving the JVM; only longer ones are cut. A null or empty text
    gives one empty piece (0, 0). Rows with equal keys are cut each on their own; other columns are not read, and
    key columns may have any names, also those of the output's own columns but for piece_no and what follows it.
    """
    rows = df.select(*keys, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("text_units", utf16_length(F.col("_text")))
    short = rows.filter(F.col("text_units") <= limit).select(
        *keys, F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("char_start"), F.col("text_units").alias("char_end"), F.lit("end").alias("cut_kind"), F.col("_text").alias("piece_text"), "text_units"
    )

    names = short.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cuts = [cut(t, limit, overlap) for t in part.column("_text").to_pylist()]
                which = pa.array(np.repeat(np.arange(len(cuts)), [len(c) for c in cuts]), pa.int64())
                flat = [p for c in cuts for p in c]
                column = lambda i, kind: pa.array([p[i] for p in flat], kind)  # noqa: E731, B023
                numbers = pa.array([i for c in cuts for i in range(len(c))], pa.int64())
                arrays = [part.column(k).take(which) for k in keys] + [numbers, column(0, pa.int64()), column(1, pa.int64()), column(2, pa.string()), column(3, pa.string()), part.column("text_units").take(which)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    long = rows.filter(F.col("text_units") > limit).mapInArrow(run, short.schema)
    return short.unionByName(long)


def domain_items(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts of the blocks of ingestions and of chunks: item_kind, item_id, block_no (-1 for a chunk), text."""
    cut_up = blocks.select(F.lit("block").alias("item_kind"), F.col("ingest_id").alias("item_id"), F.posexplode("blocks").alias("block_no", "b"))
    cut_up = cut_up.select("item_kind", "item_id", F.col("block_no").cast("long").alias("block_no"), F.col("b.text").alias("text"))
    return cut_up.unionByName(chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.lit(-1).cast("long").alias("block_no"), "text"))
