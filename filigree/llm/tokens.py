"""Encoding of a corpus with a public byte-level BPE tokenizer through a minimal acyclic transducer.

The frequent words of the corpus (pieces of the tokenizer's own pre-tokenization) are compiled into a minimal acyclic
automaton: equal suffixes share states, and each edge carries the number of words that sort before it, so that the sum
along a path is the word's number, which points at its token ids. The automaton lies in one file in the shared folder;
workers memory-map it and walk it for all distinct words of a batch at once. A word outside it is merged exactly by
the tokenizer's ranks, so the result does not depend on which words the lexicon holds.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.session import shared_path

#: Where the vocabularies lie; every operator takes another folder.
TOKENIZERS = "/opt/tokenizers"
#: Words in the lexicon at most: the bound of what the driver holds and the automaton contains.
LEXICON_WORDS = 32_768
#: Words remembered by a worker at most before it starts afresh.
_MEMO_WORDS = 200_000
# Fixed value: the public pattern that splits text before the merges of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def merger(folder: str, name: str):
    """The exact encoder of one word: the rank file with a pattern that takes any text as a single piece."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


def words(text: str) -> list[str]:
    """The pieces that the merges never cross; joined they give the text."""
    return _SPLIT.findall(text)


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """The minimal acyclic transducer of words to ids as one int64 array, built by adding the words in sorted order.

    Sections after the header of six sizes: edge keys (state * 256 + byte, ascending), edge targets, edge skips (words
    before this edge), final states, id offsets by word number, ids.
    """
    register: dict[tuple, int] = {}
    edges: list[list] = [[]]  # by state: [byte, target] in ascending order
    final = [False]
    path = [0]
    previous = b""

    def freeze(depth: int) -> None:
        """Replace the states of the last word below depth by equal ones that are registered."""
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(map(tuple, edges[state])))
            same = register.setdefault(key, state)
            edges[path[-1]][-1][1] = same

    for word in sorted(entries):
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        freeze(shared)
        for byte in word[shared:]:
            edges.append([])
            final.append(False)
            edges[path[-1]].append([byte, len(edges) - 1])
            path.append(len(edges) - 1)
        final[path[-1]] = True
        previous = word
    freeze(0)

    count: dict[int, int] = {}
    order = [(0, False)]
    while order:
        state, ready = order.pop()
        if ready:
            count[state] = final[state] + sum(count[t] for _, t in edges[state])
        elif state not in count:
            order.append((state, True))
            order.extend((t, False) for _, t in edges[state])
    number = {state: i for i, state in enumerate(sorted(count))}
    keys, targets, skips = [], [], []
    for state in sorted(count):
        before = int(final[state])
        for byte, target in edges[state]:
            keys.append(number[state] * 256 + byte)
            targets.append(number[target])
            skips.append(before)
            before += count[target]
    finals = [int(final[state]) for state in sorted(count)]
    ids = [entries[w] for w in sorted(entries)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    flat = [i for x in ids for i in x]
    parts = [keys, targets, skips, finals, offsets, flat]
    return np.concatenate([np.array([len(p) for p in parts]), *(np.asarray(p, dtype=np.int64) for p in parts)]).astype(np.int64)


class Lexicon:
    """A compiled transducer, usually over a memory-mapped file."""

    def __init__(self, data: np.ndarray):
        sizes = data[:6]
        at = np.concatenate([[6], 6 + np.cumsum(sizes)]).astype(np.int64)
        self.keys, self.targets, self.skips, self.finals, self.offsets, self.ids = (data[a:b] for a, b in zip(at[:-1], at[1:]))

    def numbers(self, items: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if the lexicon lacks it; all words step through the automaton together."""
        out = np.full(len(items), -1, dtype=np.int64)
        if not len(self.keys) or not items:
            return out
        lengths = np.fromiter(map(len, items), np.int64, len(items))
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(items), dtype=np.uint8)
        alive, state, total = np.arange(len(items)), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        step = 0
        while len(alive):
            done = lengths[alive] == step
            if done.any():
                ended = done & (self.finals[state] == 1)
                out[alive[ended]] = total[ended]
                alive, state, total = alive[~done], state[~done], total[~done]
            want = state * 256 + raw[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            there = self.keys[at] == want
            alive, state, total = alive[there], self.targets[at[there]], total[there] + self.skips[at[there]]
            step += 1
        return out


@lru_cache(maxsize=4)
def _mapped(path: str) -> Lexicon:
    return Lexicon(np.load(path, mmap_mode="r"))


class Encoder:
    """Ids of texts: a memo of the words met, the lexicon for new ones, exact merges for the rest."""

    def __init__(self, lexicon: Lexicon | None, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        self.lexicon, self.merge = lexicon, merger(folder, name)
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.flat, self.start, self.length = (np.zeros(0, np.int64),) * 3

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        found = self.lexicon.numbers(raw) if self.lexicon else np.full(len(new), -1)
        # Word by word: the library's batch call hands each word to a pool of threads, which costs more than its merges.
        merge = self.merge.encode_ordinary
        ids = [merge(w) if n < 0 else self.lexicon.ids[self.lexicon.offsets[n] : self.lexicon.offsets[n + 1]] for w, n in zip(new, found)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, *(np.asarray(x, np.int64) for x in ids)])
        for w in new:
            self.code[w] = len(self.code)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by text and the ids of all texts one after another; a null and an empty text have none."""
        split = [words(t) if t else [] for t in texts]
        if len(self.code) > _MEMO_WORDS:
            self._forget()
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.code))
        if new:
            self._learn(new)
        code = self.code
        codes = np.fromiter((code[w] for ws in split for w in ws), np.int64)
        length = self.length[codes]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) - np.repeat(ends - length, length) + np.repeat(self.start[codes], length)
        by_text = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]).astype(np.int64)
        return np.concatenate([[0], ends])[by_text].astype(np.int64), self.flat[take]


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """How often each word occurs over all texts, reduced in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pack = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(words(text))
            if len(seen) > _MEMO_WORDS:
                yield pack(seen)
                seen = Counter()
        yield pack(seen)

    counted = df.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, text_col: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", size: int = LEXICON_WORDS) -> np.ndarray:
    """The transducer of the ``size`` most frequent words of all texts (ties by word), each met at least twice."""
    top = word_counts(df, text_col).filter("n > 1").orderBy(F.desc("n"), "word").limit(size).select("word")
    # As Arrow the tasks' tops meet in one more task; collect would send each of them to the driver.
    frequent = top.toArrow().column("word").to_pylist()
    merge = merger(folder, name).encode_ordinary
    return compile_lexicon({w.encode(): merge(w) for w in frequent})


def publish(spark: SparkSession, data: np.ndarray):
    """A function for workers that opens the lexicon: from the shared folder by memory map, or from a broadcast where
    that folder is on no mounted file system, as Hadoop resolves its path. Its size is bounded by LEXICON_WORDS."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "lexicon") + ".npy")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file":
        plain = path.toUri().getPath()
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        np.save(plain, data)
        return lambda: _mapped(plain)
    sent = spark.sparkContext.broadcast(data)
    return lambda: Lexicon(sent.value)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", size: int = LEXICON_WORDS, counts_only: bool = False) -> DataFrame:
    """Token ids of every text, without special tokens: (id_col, ids array<int>), or (id_col, n_tokens) if counts_only.

    Null and empty texts give an empty list (0 tokens). Strings that spell a special token are ordinary text. Repeated
    ids, ties and rows with null ids come out row by row; other columns are not read. No shuffle beyond the word counts.
    """
    lexicon = publish(df.sparkSession, build_lexicon(df, text_col, folder, name, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lexicon(), folder, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                offsets, ids = encoder.encode(part.column(1).to_pylist())
                if counts_only:
                    out = pa.array(np.diff(offsets), pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["id", "out"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    done = source.mapInArrow(run, f"id {kind}, out {'long' if counts_only else 'array<int>'}")
    return done.select(F.col("id").alias(id_col), F.col("out").alias("n_tokens" if counts_only else "ids"))
