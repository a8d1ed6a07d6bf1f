"""Most similar vectors for every vector, by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and hashed to
the nearest signed axis. Each table joins as many such hashes as keep its buckets small. Vectors of a bucket are
candidates of each other; a query may also probe the buckets of its next nearest axes. Candidates are reranked
exactly, in double precision. A bucket of any size is worked through in blocks, every block against every other.
Where only neighbours of a given similarity are wanted, buckets hold ids and bit sketches instead of vectors: signs of
further rotations, whose distance tells the angle; vectors are fetched for the pairs that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.meeting import by_key, close_pairs
from filigree.session import checkpoint

#: Vectors a bucket should hold on average, and at most in one block.
BUCKET, BLOCK = 600, 2_000
#: Ids of a bucket that meet in one task; larger buckets are cut into blocks.
HOT = 20_000
#: Share of pairs at the wanted similarity that may be missed, and the most tables to reach it with.
MISS, MOST_TABLES = 5e-4, 24
#: Vectors per group of which the probes are fitted; the fit only chooses how many buckets a query visits.
FIT_ROWS, FIT_QUERIES = 3_000, 100
_TRIALS = 400
#: Bits of a sketch, and standard deviations above the mean distance of a pair at the wanted similarity that are let through.
SKETCH_BITS, SLACK = 256, 6.0
#: Candidates are told from other vectors by broadcast up to so many ids, beyond that by a shuffle.
BROADCAST_IDS = 100_000


def valid(vector: str, dimensions: Column) -> Column:
    """Whether a vector has the given length, only finite numbers and not only zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep their norm."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / math.sqrt(n)


def rotate(unit: np.ndarray, table: int, part: int) -> np.ndarray:
    """The pseudo-rotation of a table's hash, equal for all workers; dimensions are padded to a power of two."""
    d = unit.shape[1]
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((len(unit), wide))
    x[:, :d] = unit
    signs = np.random.default_rng([table, part, d]).choice([-1.0, 1.0], (3, wide))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(unit: np.ndarray, table: int, part: int, probes: int = 1) -> np.ndarray:
    """The nearest signed axes of each vector, nearest first."""
    x = rotate(unit, table, part)
    both = np.concatenate([x, -x], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    probes = min(probes, both.shape[1])
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), axis=1, kind="stable"), 1)


def normalized(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def collision(d: int, similarity: float) -> float:
    """The share of rotations under which two unit vectors of this similarity have the same nearest axis."""
    rng = np.random.default_rng(d)
    a = normalized(rng.standard_normal((_TRIALS, d)))
    b = rng.standard_normal((_TRIALS, d))
    b = normalized(b - (a * b).sum(1, keepdims=True) * a)
    b = similarity * a + math.sqrt(max(0.0, 1 - similarity**2)) * b
    return float(np.mean([np.mean(axes(a, t, 0) == axes(b, t, 0)) for t in range(8)]))


def settings(count: int, d: int, similarity: float) -> tuple[int, int]:
    """(hashes a table, tables) that keep buckets near BUCKET and find a pair of the similarity but for MISS."""
    hashes = max(1, math.ceil(math.log(max(1.0, count / BUCKET)) / math.log(2 * d) - 0.5))
    p = max(collision(d, similarity), 1e-3)
    while hashes > 1 and math.log(MISS) / math.log1p(-min(p**hashes, 0.9999)) > MOST_TABLES:
        hashes -= 1
    return hashes, max(2, math.ceil(math.log(MISS) / math.log1p(-min(p**hashes, 0.9999))))


def sketches(unit: np.ndarray) -> np.ndarray:
    """The signs of rotations beyond those of any table, packed into 64-bit words."""
    wide = 1 << max(1, (unit.shape[1] - 1).bit_length())
    turned = np.concatenate([rotate(unit, -1 & 0xFFFF, part) for part in range(-(-SKETCH_BITS // wide))], axis=1)[:, :SKETCH_BITS]
    return np.packbits(turned > 0, axis=1).view(np.uint64).reshape(len(unit), SKETCH_BITS // 64)


def sketch_limit(d: int, similarity: float) -> int:
    """The distance of sketches that a pair of the similarity all but never exceeds, by trials."""
    rng = np.random.default_rng([d, 1])
    a = normalized(rng.standard_normal((4 * _TRIALS, d)))
    b = rng.standard_normal(a.shape)
    b = normalized(b - (a * b).sum(1, keepdims=True) * a)
    apart = np.bitwise_count(sketches(a) ^ sketches(similarity * a + math.sqrt(max(0.0, 1 - similarity**2)) * b)).sum(axis=1)
    return min(SKETCH_BITS, math.ceil(apart.mean() + SLACK * apart.std() + 1))


def fit_probes(sample: np.ndarray, k: int, tables: int, recall: float) -> int:
    """Buckets per table a query must visit, with one hash a table, for the wanted recall of the k nearest.

    Fitted on a bounded sample of one group; in the whole group the k nearest are nearer, so the recall is higher.
    """
    if len(sample) < 2:
        return 1
    unit = normalized(sample)
    queries = np.arange(min(FIT_QUERIES, len(unit)))
    near = unit[queries] @ unit.T
    near[queries, queries] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
    most = rotate(unit[:1], 0, 0).shape[1] * 2
    needed = np.full(best.shape, most)
    for t in range(tables):
        order = axes(unit[queries], t, 0, most)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(most)[None, :].repeat(len(queries), 0), 1)
        stored = axes(unit, t, 0)[:, 0]
        needed = np.minimum(needed, np.take_along_axis(place, stored[best], 1))
    return int(np.quantile(needed, recall, method="higher")) + 1


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)


def _hashed(rows: DataFrame, plan: dict[str, tuple[int, int, int]], vectors: bool) -> DataFrame:
    """A row per vector and bucket: grp, tbl, code, id, stored, query, and the vector where wanted. plan has (hashes,
    tables, probes) of each group; its size is the number of groups, which the caller bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), dtype=object)
            asks = batch.column("query").to_numpy(zero_copy_only=False)
            for group in dict.fromkeys(groups.tolist()):
                hashes, tables, probes = plan[group]
                at = np.flatnonzero(groups == group)
                part = batch.take(pa.array(at))
                d = len(part.column("vector")[0])
                unit = normalized(_matrix(part.column("vector"), d))
                query = asks[at].astype(bool)
                for t in range(tables):
                    code = np.zeros(len(at), np.int64)
                    for j in range(hashes - 1):
                        code = code * (4 * d) + axes(unit, t, j + 1)[:, 0]
                    near = axes(unit, t, 0, probes)
                    which, codes, stored, query_too = [np.arange(len(at))], [code * (4 * d) + near[:, 0]], [np.ones(len(at), bool)], [query]
                    for j in range(1, near.shape[1]):
                        q = np.flatnonzero(query)
                        which.append(q)
                        codes.append(code[q] * (4 * d) + near[q, j])
                        stored.append(np.zeros(len(q), bool))
                        query_too.append(np.ones(len(q), bool))
                    which = np.concatenate(which)
                    picked = part.take(pa.array(which))
                    arrays = [picked.column("grp"), pa.array(np.full(len(which), t, np.int32)), pa.array(np.concatenate(codes)), picked.column("id"), pa.array(np.concatenate(stored)), pa.array(np.concatenate(query_too))]
                    names = ["grp", "tbl", "code", "id", "stored", "query"]
                    if vectors:
                        arrays, names = [*arrays, picked.column("vector")], [*names, "vector"]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.select("grp", "id", "vector", "query").mapInArrow(run, "grp string, tbl int, code long, id long, stored boolean, query boolean" + (", vector array<float>" if vectors else ""))


def _near_pairs(unique: DataFrame, plan: dict[str, tuple[int, int, int]], dims: dict[str, int], least: float, everyone: bool) -> DataFrame:
    """(grp, a, b, score) of pairs of at least the similarity ``least`` that share a bucket, a being a query."""
    limits = {g: sketch_limit(d, least) for g, d in dims.items()}
    names = {g: i for i, g in enumerate(sorted(plan))}
    parts = [f"s{i}" for i in range(SKETCH_BITS // 64)]

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashed(batches, False):
            yield batch.select(["key"])

    def hashed(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), dtype=object)
            ids, asks = batch.column("id").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            for group in dict.fromkeys(groups.tolist()):
                hashes, tables, _ = plan[group]
                at = np.flatnonzero(groups == group)
                column = batch.column("vector").take(pa.array(at))
                d = dims[group]
                unit = normalized(_matrix(column, d))
                bits = sketches(unit).view(np.int64) if whole else np.zeros((len(at), len(parts)), np.int64)
                info = np.full(len(at), limits[group] * 2, np.int32) + asks[at]
                for t in range(tables):
                    code = np.zeros(len(at), np.int64)
                    for j in range(hashes):
                        code = code * (4 * d) + axes(unit, t, j)[:, 0]
                    # A key of its own for each group, table and code: the code in the low bits, spread by a odd factor.
                    key = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93 * (names[group] * 4096 + t + 1) % (1 << 64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at]), pa.array(info), pa.array(np.full(len(at), names[group], np.int32)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(parts)))], ["key", "id", "info", "g", *parts])

    keys = unique.mapInArrow(keys_only, "key long")
    rows = unique.mapInArrow(hashed, f"key long, id long, info int, g int, {', '.join(f'{p} long' for p in parts)}")
    # Buckets beyond HOT are cut into blocks, and every block meets every other in a task of its own.
    hot = checkpoint(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")))
    rows = rows.withColumn("role", F.lit(3))
    if not hot.isEmpty():
        rows = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        tasks = F.expr("array_union(transform(sequence(0, blocks - 1), j -> struct(own as i, j as j)), transform(sequence(0, blocks - 1), i -> struct(i as i, own as j)))")
        rows = rows.withColumn("own", own).withColumn("t", F.explode(tasks))
        role = F.when(F.col("t.i") == F.col("own"), 1).otherwise(0) + F.when(F.col("t.j") == F.col("own"), 2).otherwise(0)
        rows = rows.withColumn("role", role).withColumn("key", F.when(F.col("blocks") > 1, F.xxhash64("key", "t.i", "t.j")).otherwise(F.col("key")))
    rows = rows.select("key", "id", "info", "g", "role", *parts)

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, ids, info, g, role = columns[:5]
        asks, stored = ((info & 1) > 0) & ((role & 1) > 0), (role & 2) > 0
        # Where all ask, a row that asks and is stored meets the rows after it; both ways follow from one.
        after = asks & stored & everyone
        for x, y, _ in close_pairs(key, asks, stored, after, np.stack(columns[5:], axis=1), info >> 1):
            keep = (ids[x] != ids[y]) & (g[x] == g[y])
            a, b = ids[x[keep]], ids[y[keep]]
            if everyone:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(g[x[keep]]), pa.array(a), pa.array(b)], ["g", "a", "b"])

    met = checkpoint(rows.repartition("key").sortWithinPartitions("key").mapInArrow(by_key(found), "g int, a long, b long").distinct())
    back = {i: g for g, i in names.items()}
    known = unique.sparkSession.createDataFrame([(i, g) for i, g in back.items()], "g int, grp string") if back else None
    if known is None:
        return met.select(F.lit("").alias("grp"), "a", "b", F.lit(0.0).alias("score")).limit(0)
    met = met.join(F.broadcast(known), "g").drop("g")
    ids = checkpoint(met.select("grp", F.explode(F.array("a", "b")).alias("id")).distinct())
    needed = unique.select("grp", "id", "vector").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["grp", "id"], "left_semi")
    full = met.join(needed.withColumnsRenamed({"id": "a", "vector": "va"}), ["grp", "a"]).join(needed.withColumnsRenamed({"id": "b", "vector": "vb"}), ["grp", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            left, right = batch.column("va"), batch.column("vb")
            sizes = np.diff(left.offsets.to_numpy())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                score[at] = np.clip((normalized(_matrix(left.take(pa.array(at)), d)) * normalized(_matrix(right.take(pa.array(at)), d))).sum(axis=1), -1, 1)
            keep = pa.array(score >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("grp", "a", "b")] + [pa.array(score).filter(keep)], ["grp", "a", "b", "score"])

    pairs = full.select("grp", "a", "b", "va", "vb").mapInArrow(exact, "grp string, a long, b long, score double")
    return pairs.unionByName(pairs.select("grp", F.col("b").alias("a"), F.col("a").alias("b"), "score")) if everyone else pairs


def _rerank(k: int, least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = table["vector"].combine_chunks()
        unit = normalized(_matrix(vectors, len(vectors[0])))
        ids, stored, query = table["id"].to_numpy(), table["stored"].to_numpy().astype(bool), table["query"].to_numpy().astype(bool)
        s_ids, s_unit, found = ids[stored], unit[stored], []
        order = np.argsort(s_ids, kind="stable")
        s_ids, s_unit = s_ids[order], s_unit[order]
        for at in range(0, int(query.sum()), 512):
            q = np.flatnonzero(query)[at : at + 512]
            score = np.clip(unit[q] @ s_unit.T, -1, 1) if len(s_ids) else np.zeros((len(q), 0))
            score[ids[q][:, None] == s_ids[None, :]] = -2
            if score.shape[1] > k:
                # The k best, ties by id: everything above the k-th value and the first of those equal to it.
                bar = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                score = np.where(score >= np.maximum(bar - 1e-12, least), score, -2)
            i, j = np.nonzero((score >= least) & (score > -1.5))
            found.append((ids[q][i], s_ids[j], score[i, j]))
        a, b, c = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, t) for n, t in ((0, np.int64), (1, np.int64), (2, float)))
        return pa.table({"grp": pa.array([key[0].as_py()] * len(a), pa.string()), "a": a.astype(np.int64), "b": b.astype(np.int64), "score": c.astype(float)})

    return run


def nearest(df: DataFrame, id_col: str, vector_col: str, group_col: str, k: int = 10, least: float = -1.0, query: Column | None = None, recall: float = 0.93, tables: int = 4) -> DataFrame:
    """The k most similar vectors of the same group, by cosine, of every query: (grp, a, b, score, position).

    df holds valid vectors only (see ``valid``), all of one length in a group; rows that share group and id are repeats
    and count once. ``query`` says which rows ask, all by default; every row is in the index. With ``least`` only
    neighbours of that similarity are wanted: hashes and tables are set so that such a pair is found but for MISS.
    Without it each query visits as many buckets as reach ``recall`` on a sample of FIT_ROWS vectors a group.
    Ties go by id. Copies of a vector are hashed once, as their smallest id, and come back in the result, each with
    the k first of its neighbours; so no copy group of any size is compared with itself. A null group is its own group.
    """
    ask = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
    rows = df.select(F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), ask.alias("query"))
    rows = checkpoint(rows.dropDuplicates(["grp", "id"]).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")}))
    copies = ["grp", "h1", "h2"]
    reps = rows.groupBy(*copies).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.max("query").alias("asks"))
    doubled = checkpoint(reps.filter("n > 1"))
    # All but the later copies; the first stands for them.
    later = rows.join(doubled, copies).filter("id != rep").select("grp", "id", "rep", "query")
    unique = rows.join(doubled.select(*copies, "rep", "asks"), copies, "left").filter("rep is null or id = rep").select("grp", "id", "vector", F.coalesce("asks", "query").alias("query"), F.col("query").alias("own"))
    unique = checkpoint(unique)
    facts = {r.grp: r for r in unique.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).collect()}
    plan: dict[str, tuple[int, int, int]] = {}
    if least > -1.0:
        plan = {g: (*settings(r.n, r.d, least), 1) for g, r in facts.items()}
    else:
        for g, r in facts.items():
            sample = unique.filter(F.col("grp") == g).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").collect()
            plan[g] = (1, tables, fit_probes(np.array([x.vector for x in sample], float), k, tables, recall))
    if least > -1.0:
        found = _near_pairs(unique, plan, {g: r.d for g, r in facts.items()}, least, query is None)
    else:
        found = _visited(unique, plan, k)
    best = Window.partitionBy("grp", "a").orderBy(F.desc("score"), "b")
    near = found.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k).drop("position")
    if later.isEmpty():
        result = near
    else:
        result = _with_copies(near, checkpoint(later), unique, k, least)
    return result.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def _visited(unique: DataFrame, plan: dict[str, tuple[int, int, int]], k: int) -> DataFrame:
    """(grp, a, b, score) of the k best stored vectors for each query in the buckets it visits."""
    bucket = ["grp", "tbl", "code"]
    sizes = _hashed(unique, plan, False).groupBy(*bucket).agg(F.count("*").alias("n"))
    big = sizes.filter(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    spread = _hashed(unique, plan, True).join(big, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # Task (i, j) of a bucket holds block i's queries and block j's stored vectors.
    tasks = F.expr("array_union(transform(sequence(0, blocks - 1), j -> struct(own as i, j as j)), transform(sequence(0, blocks - 1), i -> struct(i as i, own as j)))")
    spread = spread.withColumn("own", own).withColumn("t", F.explode(tasks))
    spread = spread.withColumns({"query": F.col("query") & (F.col("t.i") == F.col("own")), "stored": F.col("stored") & (F.col("t.j") == F.col("own"))}).filter("query or stored")
    spread = spread.select(*bucket, F.col("t.i").alias("ti"), F.col("t.j").alias("tj"), "id", "stored", "query", "vector")
    found = spread.groupBy(*bucket, "ti", "tj").applyInArrow(_rerank(k, -1.0), "grp string, a long, b long, score double")
    return found.groupBy("grp", "a", "b").agg(F.max("score").alias("score"))


def _with_copies(near: DataFrame, later: DataFrame, unique: DataFrame, k: int, least: float) -> DataFrame:
    """Neighbours with the copies back: candidates of a vector are the first k + 1 ids of each neighbouring copy group."""
    first = Window.partitionBy("grp", "rep").orderBy("id")
    some = later.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).select("grp", "rep", "id")
    heads = some.select("grp", "rep").distinct()
    members = some.unionByName(heads.select("grp", "rep", F.col("rep").alias("id")))
    # A neighbour stands for itself and its copies; a copied vector's own copies are at similarity 1.
    others = near.join(members.withColumnRenamed("rep", "b"), ["grp", "b"], "left").select("grp", "a", F.coalesce("id", "b").alias("b"), "score")
    own = members.select("grp", F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    lists = others.unionByName(own)
    ranked = Window.partitionBy("grp", "a").orderBy(F.desc("score"), "b")
    lists = lists.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1).drop("place")
    alike = later.filter("query").select("grp", F.col("rep").alias("a"), "id").join(lists, ["grp", "a"]).select("grp", F.col("id").alias("a"), "b", "score")
    asking = unique.filter("own").select("grp", F.col("id").alias("a"))
    return lists.join(asking, ["grp", "a"], "left_semi").unionByName(alike).filter("a != b").filter(F.col("score") >= least)
