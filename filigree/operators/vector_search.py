"""Exact vector search: metrics, top-k, batches, rank fusion, user-defined scores.

Scores are computed in double precision; larger is better, ties go to the smaller id, non-finite scores are skipped,
and so are vectors of another length than the query's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_CONSTANT = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    """The negated distance, so that larger is nearer."""
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return -F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "dot": dot, "euclidean": euclidean}


def regions(a: Column, ranges: list[tuple[int, int]]) -> Column:
    """The parts [from, to) of a vector, one after another, for scores over regions."""
    return F.concat(*(F.slice(a, low + 1, high - low) for low, high in ranges))


def _k(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def top_k(df: DataFrame, id_col: str, key: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(id_col, score): the k best of df for one query vector; df is the candidate set, filtered before."""
    target = F.array(*(F.lit(float(x)) for x in query))
    rows = df.filter(F.size(key) == len(query)).select(id_col, METRICS[metric](F.col(key), target).alias("score"))
    return rows.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf")))).orderBy(F.desc("score"), id_col).limit(_k(k))


def _scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return queries @ rows.T
    if metric == "cosine":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        return np.divide(queries @ rows.T, norms, out=np.zeros((len(queries), len(rows))), where=norms > 0)
    gaps = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * queries @ rows.T
    return -np.sqrt(np.maximum(gaps, 0))


def _vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that hold d numbers, and these as a matrix, from the column's buffers."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy() == d)
    flat = column.take(pa.array(at)).flatten()
    whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
    return at[whole], flat.to_numpy(zero_copy_only=False).reshape(-1, d)[whole].astype(float)


def batch_top_k(df: DataFrame, id_col: str, key: str, queries: list[tuple[int, list[float]]], k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id_col, score, rank) of many queries in one scan of df.

    The query list is the caller's, so its size is known; it travels with the tasks. Each task keeps k rows a query,
    and only those meet in the shuffle.
    """
    _k(k)
    ids, matrix = np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pd.DataFrame] = []
        for batch in batches:
            found, vectors = _vectors(batch.column(1), matrix.shape[1])
            held = batch.column(0).to_numpy(zero_copy_only=False)[found]
            for at in range(0, len(held), 4096):
                names, rows = held[at : at + 4096].astype(np.int64), vectors[at : at + 4096]
                score = _scores(matrix, rows, metric)
                n = min(k, len(rows))
                ok = np.where(np.isfinite(score), score, -np.inf)
                # The n best by score, then id: everything not below the n-th value.
                bar = -np.partition(-ok, n - 1, axis=1)[:, n - 1 : n]
                q, j = np.nonzero((ok >= bar) & (ok > -np.inf))
                best.append(pd.DataFrame({"q": ids[q], "i": names[j], "s": ok[q, j]}))
            if len(best) > 8:
                best = [_cut(best, k)]
        if best:
            cut = _cut(best, k)
            yield pa.RecordBatch.from_arrays([pa.array(cut.q.to_numpy()), pa.array(cut.i.to_numpy()), pa.array(cut.s.to_numpy())], ["query_id", "id", "score"])

    found = df.select(F.col(id_col).cast("long"), key).mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", "rank")


def _cut(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    whole = pd.concat(parts).sort_values(["q", "s", "i"], ascending=[True, False, True], kind="stable")
    return whole.groupby("q", sort=False).head(k)


def fuse(channels: list[DataFrame], id_col: str, k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """(id_col, score): reciprocal rank fusion of channels (id_col, score), each ranked by score, then id."""
    total = None
    for c in channels:
        # A channel is a top-k list, so its one window holds k rows.
        ranked = c.select(id_col, (F.lit(1.0) / (constant + F.row_number().over(Window.orderBy(F.desc("score"), id_col)))).alias("part"))
        total = ranked if total is None else total.unionByName(ranked)
    return total.groupBy(id_col).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), id_col).limit(_k(k))


def hybrid(df: DataFrame, id_col: str, text_key: str, text: str, vector_key: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """Reciprocal rank fusion of the top k by BM25 and the top k by vector."""
    from filigree.operators.fulltext import search

    return fuse([search(df, id_col, text_key, text, k), top_k(df, id_col, vector_key, query, k, metric)], id_col, k)


def apply_monadic(df: DataFrame, key: str, op: Callable[[np.ndarray], np.ndarray], out: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """df with ``out``, the result of a unary operator on each vector, over regions where given: a function of a matrix
    of rows that gives a number or a vector for each. Null vectors give null; vectors of unlike length are taken apart."""
    vectors = F.col(key) if ranges is None else regions(F.col(key), ranges)

    @F.pandas_udf("array<double>")
    def applied(v: pd.Series) -> pd.Series:
        done: list = [None] * len(v)
        sizes = np.array([-1 if x is None else len(x) for x in v])
        for d in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == d)
            result = np.asarray(op(np.array([v.iloc[i] for i in at], float).reshape(len(at), d)), float).reshape(len(at), -1)
            for i, r in zip(at, result):
                done[i] = r
        return pd.Series(done)

    return df.withColumn(out, applied(vectors.cast("array<double>")))


def apply_dyadic(df: DataFrame, id_col: str, key: str, operand: list[float], op: str | Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(id_col, score): the k highest results of a binary operator with a fixed vector, over regions where given.

    A named operator is "dot", "cosine" or "distance"; the highest result wins, so "distance" returns the farthest, as
    its sign is the user's business. A function gets (rows, operand) as arrays; a NaN it returns is an error.
    """
    target = F.array(*(F.lit(float(x)) for x in operand))
    left, right = (F.col(key), target) if ranges is None else (regions(F.col(key), ranges), regions(target, ranges))
    rows = df.filter(F.size(key) == len(operand))
    if isinstance(op, str):
        score = {"dot": dot, "cosine": cosine, "distance": lambda a, b: -euclidean(a, b)}[op](left, right)
    else:
        fixed = np.array(operand, float) if ranges is None else np.concatenate([np.array(operand, float)[a:b] for a, b in ranges])

        @F.pandas_udf("double")
        def scored(v: pd.Series) -> pd.Series:
            return pd.Series(op(np.array(v.tolist(), float), fixed)) if len(v) else pd.Series([], dtype=float)

        score = scored(left.cast("array<double>"))
    # Arrow hands a NaN of a function back as null.
    checked = F.when(F.isnan("score") | F.col("score").isNull(), F.raise_error(F.lit("the operator returned NaN"))).otherwise(F.col("score"))
    return rows.select(id_col, score.alias("score")).withColumn("score", checked).orderBy(F.desc("score"), id_col).limit(_k(k))
