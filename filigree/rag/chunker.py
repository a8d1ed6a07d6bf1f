"""Chunks of ingested blocks: offsets in UTF-16 units of the source text, which joins the block texts by two line feeds.

Headings set the heading path and end a chunk; tables and code are chunks of their own, cut only beyond ``max_chunk``;
small paragraphs are packed up to ``target``, larger ones cut into windows with overlap, at white space where there is any.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n"


@dataclass(frozen=True)
class Options:
    target: int = 800
    overlap: int = 100
    max_chunk: int = 0

    def __post_init__(self) -> None:
        if self.target < 1 or not 0 <= self.overlap < self.target or self.max_chunk < 0:
            raise ValueError("need target > overlap >= 0")


#: Whether each UTF-16 unit is white space.
_BLANK = np.array([chr(i).isspace() for i in range(1 << 16)])


class Source:
    """The joined block texts as an array of UTF-16 units, with the offsets of each block and of all white space."""

    def __init__(self, texts: Sequence[str]):
        self.raw = SEPARATOR.join(texts).encode("utf-16-le", "surrogatepass")
        self.units = np.frombuffer(self.raw, "<u2")
        sizes = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts], np.int64)
        self.low = np.cumsum(sizes + len(SEPARATOR)) - sizes - len(SEPARATOR)
        self.high = self.low + sizes
        self.gaps = np.flatnonzero(_BLANK[self.units])

    def text(self, low: int, high: int) -> str:
        return self.raw[2 * low : 2 * high].decode("utf-16-le", "replace")

    def blank(self, at: int) -> bool:
        return bool(_BLANK[self.units[at]])

    def inside_pair(self, at: int) -> bool:
        """Whether a cut at this offset parts a surrogate pair."""
        return 0 < at < len(self.units) and self.units[at - 1] >> 10 == 0x36 and self.units[at] >> 10 == 0x37

    def last_gap(self, low: int, high: int) -> int | None:
        """The last white space in [low, high)."""
        k = int(np.searchsorted(self.gaps, high)) - 1
        return int(self.gaps[k]) if k >= 0 and self.gaps[k] >= low else None

    def first_gap(self, low: int, high: int) -> int | None:
        k = int(np.searchsorted(self.gaps, low))
        return int(self.gaps[k]) if k < len(self.gaps) and self.gaps[k] < high else None

    def cut(self, low: int, limit: int) -> int:
        """Where a piece from low ends that may reach limit: there if no word is cut, else behind the last white space;
        a pair that alone exceeds the limit stays whole."""
        word = limit < len(self.units) and not self.blank(limit - 1) and not self.blank(limit)
        gap = self.last_gap(low + 1, limit) if word else None
        at = limit if gap is None else gap + 1
        at -= self.inside_pair(at)
        return at if at > low else limit + 1

    def resume(self, low: int, end: int, overlap: int) -> int:
        """Where the piece after [low, end) begins: the overlap back, or from there behind the first white space."""
        at = end - overlap
        if overlap == 0 or at <= low:
            return end
        gap = None if at == 0 or self.blank(at - 1) else self.first_gap(at, end)
        at = at if gap is None else gap + 1
        at += self.inside_pair(at)
        return at if at > low else end

    def pieces(self, low: int, high: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
        while low + size < high:
            end = self.cut(low, low + size)
            yield low, end
            if end >= high:
                return
            low = self.resume(low, end, overlap)
        yield low, high


def packed(low: np.ndarray, high: np.ndarray, target: int) -> Iterator[slice]:
    """Runs of neighbouring blocks that fit into the target together, each as long as can be."""
    at = 0
    while at < len(low):
        end = max(at + 1, int(np.searchsorted(high, low[at] + target, "right")))
        yield slice(at, end)
        at = end


def sections(blocks: Sequence[dict]) -> list[str]:
    """The heading path that holds for each block: the headings before it, of falling levels, without empty ones."""
    above: dict[int, str] = {}
    paths = []
    for b in blocks:
        if b.get("kind") == "Heading":
            level = b.get("heading_level") or 1
            above = {k: v for k, v in above.items() if k < level} | {level: b.get("text") or ""}
        paths.append(" > ".join(filter(None, above.values())))
    return paths


def chunk(blocks: list[dict] | None, options: Options = Options()) -> list[tuple[int, str, int | None, int, int, str]]:
    """(ordinal, heading_path, page, char_start, char_end, text) in reading order; empty chunks are left out."""
    blocks = [b or {} for b in blocks or []]
    source, paths = Source([b.get("text") or "" for b in blocks]), sections(blocks)
    limits = [options.max_chunk if b.get("kind") in ("Table", "Code") else options.target for b in blocks]
    # What is packed: paragraphs within the target; whatever else stands between them parts the packs.
    alone = [b.get("kind") in ("Heading", "Table", "Code") or high - low > options.target for b, low, high in zip(blocks, source.low, source.high)]
    found: list[tuple[int, int, int, int | None]] = []
    for _, run in groupby(range(len(blocks)), key=lambda i: (i, True) if alone[i] else (0, False)):
        some = [i for i in run if source.high[i] > source.low[i] and blocks[i].get("kind") != "Heading"]
        if some and alone[some[0]]:
            i = some[0]
            low, high, whole = int(source.low[i]), int(source.high[i]), blocks[i].get("kind") in ("Table", "Code")
            cuts = [(low, high)] if limits[i] == 0 else source.pieces(low, high, limits[i], 0 if whole else options.overlap)
            found += [(i, *c, blocks[i].get("page")) for c in cuts]
            continue
        for part in packed(source.low[some], source.high[some], options.target):
            first, last = some[part][0], some[part][-1]
            page = next((p for p in (blocks[i].get("page") for i in some[part]) if p is not None), None)
            found.append((first, int(source.low[first]), int(source.high[last]), page))
    return [(n, paths[i], page, low, high, source.text(low, high)) for n, (i, low, high, page) in enumerate(found)]


def chunk_documents(df: DataFrame, id_col: str, blocks_col: str, options: Options = Options()) -> DataFrame:
    """(id_col, ordinal, heading_path, page, char_start, char_end, text) of every document's blocks, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *c) for i, blocks in zip(pdf["id"], pdf["blocks"]) for c in chunk([dict(b) if b is not None else None for b in blocks] if blocks is not None else None, options)]
            out = pd.DataFrame(rows, columns=["id", "ordinal", "heading_path", "page", "char_start", "char_end", "text"])
            yield out.astype({"page": "Int32"})

    fields = F.transform(blocks_col, lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["heading_level"].cast("double").alias("heading_level"), b["page"].cast("double").alias("page")))
    rows = df.select(F.col(id_col).alias("id"), fields.alias("blocks"))
    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInPandas(_plain(run), f"id {kind}, ordinal int, heading_path string, page int, char_start int, char_end int, text string")
    return done.withColumnRenamed("id", id_col)


def _plain(run):
    """Arrow gives absent numbers of structs as NaN or None; both become None, present ones integers."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fix(b):
            if b is None:
                return None
            b = b.asDict() if hasattr(b, "asDict") else dict(b)
            return {k: None if v is None or v != v else int(v) if k in ("heading_level", "page") else v for k, v in b.items()}

        def clean() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(blocks=[None if bs is None else [fix(b) for b in bs] for bs in pdf["blocks"]])

        yield from run(clean())

    return wrapped
