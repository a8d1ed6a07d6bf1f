"""Near-duplicate texts by multiset overlap of words, with pigeonring filtering.

similarity(x, y) = words shared, with multiplicity / words of the longer text; as sets of (word, occurrence) tokens the
texts then differ in a bounded Hamming distance. Texts with equal multisets are one class and compared once.

1. Candidates by the pigeonhole over boxes. A text's rare tokens are boxes of their own: with more of them than a
   partner may lack, one is shared. If a text has fewer and none is shared, the rare ones have used up part of the
   allowed differences, and the common tokens of both differ in no more than what both have left. Divided into hashed
   segments, one more of them than that, the common tokens are equal in one segment at least; the text with more left
   asks for as many of its segments, those that the fewest texts hold by measure, the other one stores all of its own.
2. The pigeonring. Each text carries a ring of one-bit segments, the parity of its tokens in each; the chain around the
   whole ring must stay within the budget of differences where they meet. Pairs that do are held against a finer ring
   of counted segments: from some start every chain of consecutive segments must keep its differences within the
   proportional share of the budget.
3. The full Hamming check on the tokens of the rest.

No step loses a pair: parities and counts bound the distance from below, whatever the hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.meeting import by_key, close_pairs
from filigree.session import checkpoint, shared_path

SIMILARITY, MIN_WORDS = 0.8, 40
#: Counters of the word frequency sketch and of the segment sketch, and words of 64 bits of the filter that tells
#: segments some text has at its own level; fixed sizes that do not grow with the corpus. As they fill they choose
#: segments less well and leave out fewer, never too many.
SKETCH, SEGMENTS, FILTER = 1 << 20, 1 << 22, 1 << 19
#: Classes with several texts, and texts with candidates, are told from the rest by broadcast up to so many, beyond
#: that by a shuffle.
BROADCAST_CLASSES = 100_000
#: One-bit segments of the ring that travels with the tokens, and counted segments of the ring of the chain filter.
PARITY, RING = 192, 64
#: A word is rare in at most this share of the texts, and in at most so many. It decides only how texts meet.
RARE_SHARE, RARE_MOST = 0.003, 2_048
#: A segment held by more texts than this is split: askers are spread over as many parts, and the holders repeated.
HOT = 4_096
#: Texts signed at once by a task, and pairs checked at once.
_TEXTS, _PAIRS = 1_024, 2_048
#: Words whose hash a task remembers at once.
_REMEMBERED = 1 << 20
#: Parts in which the nodes of one component meet its label.
_SALTS = 16
ASKS, STORED, RARE = 1, 2, 4
_WORD = re.compile(r"[^\W_]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code(n: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact up to 15, beyond that in steps of an eighth of a power of two."""
    n = np.asarray(n, np.int64)
    return np.where(n < 16, n, 16 + np.round(8 * np.log2(np.maximum(n, 16) / 16))).astype(np.uint8)


#: The count of each code.
COUNT_OF = np.concatenate([np.arange(16), np.round(16 * 2.0 ** (np.arange(240) / 8))]).astype(np.int64)


def _first(flat: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where in sorted word hashes of one text after another a new word begins."""
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    return new


def tokens(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the (word, occurrence) tokens of texts, from their sorted word hashes one after another, and the text of each."""
    flat, doc, place = flat.astype(np.uint64), np.repeat(np.arange(len(counts)), counts), np.arange(len(flat))
    nth = place - np.maximum.accumulate(np.where(_first(flat, doc), place, 0)) if len(flat) else place
    return _mix(flat + nth.astype(np.uint64) * _GOLDEN), doc


def misses(n: int, similarity: float = SIMILARITY) -> int:
    """Tokens of a text of n words that any partner of the similarity may lack."""
    return n - int(np.ceil(similarity * n - 1e-9))


def levels(span: int, similarity: float = SIMILARITY) -> tuple[int, ...]:
    """Segments for texts of the span, by level. The first serves texts that may lack half of what the longest text of
    the span may lack, the last all; each is odd."""
    most = misses((2 * MIN_WORDS << span) - 1, similarity)
    return tuple(sorted({most | 1, most * 7 // 5 | 1, 2 * most + 1}))


def signatures(flat: np.ndarray, counts: np.ndarray, frequency: np.ndarray, limit: float, similarity: float = SIMILARITY, held: np.ndarray | None = None, owned: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, key, kind, texts that hold the key by measure) of a batch of texts: sorted word hashes, and words by text.

    kind adds ASKS and STORED, the sides on which a text meets another by the key, and RARE for a rare token. A text has
    the segments of its own level, and as a guest those of higher levels at which a partner may have its own. On the
    first level it asks for segments that few texts hold by measure, on the others, which few texts own, for those of
    the rarest words. Without ``held``, the measured number of texts by segment counter, come out the segments of own
    levels, above the first those asked for, to be counted; ``owned`` is the filter of these, and leaves out guests
    whom none of them meets. ``frequency`` and ``held`` are codes of counts.
    """
    keys, doc = tokens(flat, counts)
    often = COUNT_OF[frequency[(flat.astype(np.uint64) % np.uint64(SKETCH)).astype(np.int64)]]
    rare = often <= limit
    allowed = counts - np.ceil(similarity * counts - 1e-9).astype(np.int64)
    left = allowed - np.bincount(doc[rare], minlength=len(counts))
    out: list[tuple[np.ndarray, ...]] = []
    if held is not None:
        # The rarest first; one that no other text has meets nobody, but takes its place.
        at = np.flatnonzero(rare)
        at = at[np.lexsort((keys[at], often[at], doc[at]))]
        nth = np.arange(len(at)) - np.searchsorted(doc[at], doc[at])
        at = at[(nth <= allowed[doc[at]]) & (often[at] > 1)]
        out.append((doc[at], keys[at], np.full(len(at), ASKS + STORED + RARE), np.ones(len(at), np.int64)))
    mixed = _mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    scale = np.log(COUNT_OF[-1])

    def chosen(score: np.ndarray, texts: np.ndarray, m: int) -> np.ndarray:
        """Of the segments of each text as many as it has to ask for, of the least score."""
        order = np.argsort(score.reshape(-1, m), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(m)[None, :], axis=1)
        return place <= 2 * left[texts][:, None]

    span_of = lambda n: np.maximum(0, np.floor(np.log2(np.maximum(n, MIN_WORDS) / MIN_WORDS))).astype(np.int64)
    own_span, last_span = span_of(counts), span_of(counts / similarity + 1)
    for span in range(int(last_span.max(initial=-1)) + 1):
        sizes = np.array(levels(span, similarity))
        own_level = np.where(own_span == span, np.searchsorted(sizes, 2 * left + 1), -1)
        for level, m in enumerate(sizes.tolist()):
            mine = (own_level == level) & (left >= 0)
            there = mine if held is None else (left >= 0) & (own_span <= span) & (span <= last_span) & (own_level <= level)
            texts = np.flatnonzero(there)
            if not len(texts):
                continue
            number = np.full(len(counts), -1)
            number[texts] = np.arange(len(texts))
            at = np.flatnonzero(~rare & (number[doc] >= 0))
            sums = np.zeros(len(texts) * m, np.uint64)
            part = number[doc[at]] * m + ((keys[at] >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
            np.add.at(sums, part, mixed[at])
            salt = np.uint64((span * 64 + level) << 32)
            key = _mix(sums + _mix(np.tile(np.arange(m, dtype=np.uint64), len(texts)) + salt))
            who = np.repeat(texts, m)
            unusual = lambda: np.bincount(part, np.log(np.maximum(often[at], 1)) - scale, len(texts) * m)  # noqa: B023, E731
            if held is None:
                met = np.ones(len(who), bool) if level == 0 else chosen(unusual(), texts, m).reshape(-1)
                out.append((who[met], key[met], np.zeros(met.sum(), np.int64), np.zeros(met.sum(), np.int64)))
                continue
            holders = COUNT_OF[held[(key % np.uint64(SEGMENTS)).astype(np.int64)]]
            # Shorter texts may have more left than the owners of the first level, and ask there too.
            owner = mine[texts]
            asks = chosen(holders if level == 0 else unusual(), texts, m) & (owner | ((own_span[texts] < span) & (level == 0)))[:, None]
            # What no owner has, or above the first level asks for, needs no guest.
            keep = np.repeat(owner, m) | _in_filter(owned, key)
            out.append((who[keep], key[keep], STORED + ASKS * asks.reshape(-1)[keep], holders[keep]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter of each key, and its bit in the word."""
    at = _mix(key ^ np.uint64(0x2545F4914F6CDD1D))
    return ((at >> np.uint64(6)) % np.uint64(FILTER)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def _in_filter(owned: np.ndarray, key: np.ndarray) -> np.ndarray:
    word, bit = _bits(key)
    return (owned[word] & bit) != 0


def split(rep: np.ndarray, key: np.ndarray, kind: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, kind) with keys of more than HOT holders split: an asker has one part, by its id, a holder all parts."""
    parts = np.maximum(1, -(-holders // HOT))
    if parts.max(initial=1) == 1:
        return np.arange(len(key)), key, kind
    hot = np.flatnonzero(parts > 1)
    part_key = lambda k, part: _mix(k + _mix(part.astype(np.uint64) + np.uint64(1)))
    asks = hot[(kind[hot] & ASKS) > 0]
    stored = np.repeat(hot, parts[hot])
    part = np.arange(len(stored)) - np.repeat(np.cumsum(parts[hot]) - parts[hot], parts[hot])
    cold = np.flatnonzero(parts == 1)
    rows = np.concatenate([cold, asks, stored])
    keys = np.concatenate([key[cold], part_key(key[asks], _mix(rep[asks].astype(np.int64).view(np.uint64)) % parts[asks].astype(np.uint64)), part_key(key[stored], part)])
    return rows, keys, np.concatenate([kind[cold], np.full(len(asks), ASKS), np.full(len(stored), STORED)])


def _by_ring(keys: np.ndarray, doc: np.ndarray, texts: int, segments: int) -> np.ndarray:
    return np.bincount(doc * segments + ((keys >> np.uint64(40)) % np.uint64(segments)).astype(np.int64), minlength=texts * segments).reshape(texts, segments)


def ring(keys: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Tokens in each segment of the ring of each text, counted up to 255."""
    return np.minimum(_by_ring(keys, doc, texts, RING), 255).astype(np.uint8)


def parities(keys: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """The parity of the tokens in each one-bit segment, in two longs a text."""
    return np.packbits((_by_ring(keys, doc, texts, PARITY) & 1).astype(np.uint8), axis=1).view(np.int64).reshape(texts, PARITY // 64)


def chain_filter(a: np.ndarray, b: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Which pairs of rings have a start from which every chain stays within its share of the budget.

    a and b have a row per pair. Differences of capped counts bound the true ones from below, so no true pair is lost.
    """
    gaps = np.abs(a.astype(np.int32) - b.astype(np.int32))
    keep = np.flatnonzero(gaps.sum(axis=1) <= budget)
    gaps, budget = gaps[keep], budget[keep]
    turned = np.concatenate([np.zeros((len(keep), 1), np.int64), np.cumsum(np.concatenate([gaps, gaps], 1), axis=1)], 1)
    viable = np.ones((len(keep), RING), bool)
    starts = np.arange(RING)
    for length in range(1, RING + 1):
        viable &= (turned[:, starts + length] - turned[:, starts]) * RING <= length * budget[:, None]
        some = viable.any(axis=1)
        if not some.all():
            keep, turned, viable, budget = keep[some], turned[some], viable[some], budget[some]
    out = np.zeros(len(a), bool)
    out[keep] = True
    return out


def shared_words(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Words shared by pairs of texts, given as sorted word hashes one after another; 0 where the ring rules the pair out."""
    (ka, da), (kb, db) = tokens(a, na), tokens(b, nb)
    budget = na + nb - 2 * np.ceil(similarity * np.maximum(na, nb) - 1e-9).astype(np.int64)
    viable = chain_filter(ring(ka, da, len(na)), ring(kb, db, len(nb)), budget)
    keys, pair = np.concatenate([ka[viable[da]], kb[viable[db]]]), np.concatenate([da[viable[da]], db[viable[db]]])
    order = np.lexsort((keys, pair))
    keys, pair = keys[order], pair[order]
    same = (keys[1:] == keys[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][same], minlength=len(na))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column without nulls, and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _counted(texts: DataFrame, size: int, counters, words: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """How many of the keys that ``counters`` gives for batches of texts fall on each of ``size`` counters, a filter of
    so many ``words`` of 64 bits that holds them, and the number of texts.

    Counted in each task over arrays of fixed size; at most ``size`` and ``words`` rows come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bits, rows = np.zeros(size, np.int32), np.zeros(words, np.uint64), 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, _TEXTS):
                key = counters(*_lists(batch.slice(at, _TEXTS).column(0)))
                np.add.at(counts, (key % np.uint64(size)).astype(np.int64), 1)
                if words:
                    np.bitwise_or.at(bits, *_bits(key))
        at, some = np.flatnonzero(counts), np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, size + some, [-1]]).astype(np.int32)), pa.array(np.concatenate([counts[at].astype(np.int64), bits[some].view(np.int64), [rows]]))], ["counter", "n"])

    each = texts.select("hashes").mapInArrow(run, "counter int, n long").groupBy("counter")
    table = (each.agg(F.sum(F.when(F.col("counter") < size, F.col("n"))).alias("n"), F.bit_or("n").alias("bits")) if words else each.agg(F.sum("n").alias("n"))).toArrow()
    at, n = table["counter"].to_numpy(), table["n"].fill_null(0).to_numpy()
    out, owned = np.zeros(size, np.int32), np.zeros(words, np.uint64)
    counted, bits = (at >= 0) & (at < size), at >= size
    out[at[counted]] = np.minimum(n[counted], 2**31 - 1)
    if words:
        owned[at[bits] - size] = table["bits"].to_numpy()[bits].view(np.uint64)
    return out, owned, int(n[at == -1].sum())


def meetings(sign: np.ndarray, rep: np.ndarray, info: np.ndarray, parity: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts that meet in signature rows ordered by sign, whole signs, and whose parities stay in the budget."""
    n = info >> 3
    # No partner leaves a larger budget than one of about the same length.
    most = np.minimum(2 * (n - np.ceil(similarity * n - 1e-9)) + 2, 64 * parity.shape[1])
    # Texts with a rare token ask and store: each meets those after it.
    for x, y, apart in close_pairs(sign, (info & ASKS) > 0, (info & STORED) > 0, (info & RARE) > 0, parity, most):
        longer, shorter = np.maximum(n[x], n[y]), np.minimum(n[x], n[y])
        # Of the longer text at least ceil(similarity * n) words are shared, which leaves this many differences.
        keep = (apart <= longer + shorter - 2 * np.ceil(similarity * longer - 1e-9)) & (rep[x] != rep[y])
        x, y = x[keep], y[keep]
        yield np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])


def words(df: DataFrame) -> DataFrame:
    """df(id, ..., text) with the sorted hashes of the text's words and two digests of them instead of the text.

    A word is a maximal run of letters or digits, lower-cased.
    """
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            rows = [np.sort(np.fromiter(map(known.__getitem__, _WORD.findall(t.lower())), np.uint64)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            digests = np.frombuffer(b"".join(hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rows), np.int64).reshape(-1, 2)
            offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            hashes = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), hashes, *(pa.array(np.ascontiguousarray(digests[:, i])) for i in (0, 1))], [*kept, "hashes", "h1", "h2"])

    return df.filter(F.col("text").isNotNull()).mapInArrow(run, f"{schema}, hashes array<long>, h1 long, h2 long")


def classes(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, keep: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(class representatives, membership) of the texts of at least min_words words.

    Texts with the same multiset of words are a class, named by its smallest id: (rep, hashes) and (id, rep, and the
    columns of ``keep`` under their new names). Rows that share an id are repeats and count once; null and shorter
    texts and null ids belong to no class. The words are hashed once and written to the shared folder.
    """
    keep = keep or {}
    rows = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(name) for name, c in keep.items()), F.col(text_col).cast("string").alias("text"))
    rows = words(rows.filter(F.col("id").isNotNull())).filter(F.size("hashes") >= max(min_words, 1))
    path = shared_path(df.sparkSession, "words")
    # Rows are numbered as they are written, to tell exact repeats apart.
    rows.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    # Equal multisets meet by two 64-bit digests, reduced map-side; the words themselves stay where they are.
    several = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "row")).alias("head")).filter("n > 1").select("h1", "h2", F.col("head.id").alias("rep"), F.col("head.row").alias("head"))
    several = checkpoint(several)
    n = several.count()
    named = rows.join(F.broadcast(several) if n <= BROADCAST_CLASSES else several, ["h1", "h2"], "left")
    reps = named.filter(F.col("head").isNull() | (F.col("row") == F.col("head"))).select(F.col("id").alias("rep"), "hashes")
    if n > BROADCAST_CLASSES:
        written = shared_path(df.sparkSession, "classes")
        reps.write.option("compression", "zstd").parquet(written)
        reps = df.sparkSession.read.parquet(written)
    single, shared = (named.filter(c).select("id", F.coalesce("rep", "id").alias("rep"), *keep) for c in (F.col("head").isNull(), F.col("head").isNotNull()))
    return reps, checkpoint(single.unionByName(shared.dropDuplicates(["id"])))


def similar_pairs(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) with a < b: every pair of class representatives of at least this similarity."""
    spark = reps.sparkSession

    def by_word(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        flat = flat.astype(np.uint64)
        return flat[_first(flat, np.repeat(np.arange(len(counts)), counts))]

    often, _, n = _counted(reps, SKETCH, by_word)
    limit = min(max(RARE_SHARE * n, 4), RARE_MOST)
    frequency = spark.sparkContext.broadcast(code(often))
    measured = _counted(reps, SEGMENTS, lambda flat, counts: signatures(flat, counts, frequency.value, limit, similarity)[1], FILTER)
    held, owned = spark.sparkContext.broadcast(code(measured[0])), spark.sparkContext.broadcast(measured[1])
    parts = [f"r{i}" for i in range(PARITY // 64)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(at, _TEXTS)
                rep, (flat, counts) = batch.column(0).to_numpy(), _lists(batch.column(1))
                who, key, kind, holders = signatures(flat, counts, frequency.value, limit, similarity, held.value, owned.value)
                rows, key, kind = split(rep[who], key, kind, holders)
                # Rows of one text stand together, so that its parities compress.
                order = np.argsort(who[rows], kind="stable")
                who, key, kind, parity = who[rows][order], key[order], kind[order], parities(*tokens(flat, counts), len(counts))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rep[who]), pa.array((counts[who] * 8 + kind).astype(np.int32)), *(pa.array(parity[who, i]) for i in range(len(parts)))], ["sign", "rep", "info", *parts])

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in meetings(*columns[:3], np.stack(columns[3:], axis=1), similarity):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    signed = reps.select("rep", "hashes").mapInArrow(sign, f"sign long, rep long, info int, {', '.join(f'{r} long' for r in parts)}")
    met = checkpoint(signed.repartition("sign").sortWithinPartitions("sign").mapInArrow(by_key(found), "a long, b long").distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PAIRS):
                batch = whole.slice(at, _PAIRS)
                (a, na), (b, nb) = (_lists(batch.column(batch.schema.get_field_index(c))) for c in ("ha", "hb"))
                score = shared_words(a, na, b, nb, similarity) / np.maximum(na, nb)
                keep = pa.array(score >= similarity - 1e-9)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).filter(keep) for c in ("a", "b")), pa.array(score).filter(keep)], ["a", "b", "similarity"])

    # Only texts with candidates take part in the check.
    ids = checkpoint(met.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    needed = reps.join(F.broadcast(ids) if ids.count() <= BROADCAST_CLASSES else ids, "rep", "left_semi")
    full = met.join(needed.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a").join(needed.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
    return full.select("a", "b", "ha", "hb").mapInArrow(verify, "a long, b long, similarity double")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each connected component, for nodes(node) and links(a, b).

    Minimum labels spread over the links and jump along labels, so that rounds grow with the logarithm of a path's
    length; every round is written to the shared folder. A label that many nodes carry is met in _SALTS parts.
    """
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        hooked = checkpoint(labels.join(offered, "node", "left").select("node", F.least("component", F.coalesce("low", "component")).alias("hook"), F.col("component").alias("old")))
        # Where a label leads, looked up once a label and met by its nodes in parts.
        leads = hooked.select("hook").distinct().join(hooked.select(F.col("node").alias("hook"), F.col("hook").alias("next")), "hook").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        jumped = hooked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).join(leads, ["hook", "salt"], "left")
        new = checkpoint(jumped.select("node", F.least("hook", F.coalesce("next", "hook")).alias("component"), "old"))
        changed = new.filter("component != old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def groups(df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per text of at least min_words words: (id_col, class_id, group_id, links).

    class_id names the texts with the same words, group_id the classes linked by similarity, links counts the other
    classes that are similar to the text's own. Nothing is dropped: every similar pair of classes is linked.
    """
    reps, members = classes(df, id_col, text_col, min_words)
    pairs = checkpoint(similar_pairs(reps, similarity))
    joined = components(reps.select(F.col("rep").alias("node")), pairs)
    degree = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    by_class = joined.join(degree, "node", "left").select(F.col("node").alias("rep"), F.col("component").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(by_class, "rep").select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), "group_id", "links")


def pairs_across(df: DataFrame, id_col: str, text_col: str, source_col: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(id_a, id_b) with a < b: all similar texts of different sources, copies included, as the pairs are asked for.

    A null source differs from every other source but not from itself. Classes meet by source first and members only by
    sources that differ, so that every row of the last joins is a pair asked for; copies in one source alone meet nobody.
    """
    reps, members = classes(df, id_col, text_col, min_words, {"source": source_col})
    pairs = similar_pairs(reps, similarity).select("a", "b")
    held = members.select("rep", "source").distinct()
    several = held.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    side = lambda rows, rep, source, *more: rows.select(F.col("rep").alias(rep), F.col("source").alias(source), *more)
    met = pairs.unionByName(several).join(side(held, "a", "sx"), "a").join(side(held, "b", "sy"), "b").filter(~F.col("sx").eqNullSafe(F.col("sy")))
    left, right = side(members, "ra", "s1", F.col("id").alias("x")), side(members, "rb", "s2", F.col("id").alias("y"))
    met = met.join(left, (F.col("a") == F.col("ra")) & F.col("sx").eqNullSafe(F.col("s1"))).join(right, (F.col("b") == F.col("rb")) & F.col("sy").eqNullSafe(F.col("s2")))
    return met.filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
