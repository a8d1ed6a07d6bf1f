"""Algorithms on directed nexuses: one role holds the tails, another the heads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.graph import PropertyGraph
from filigree.session import checkpoint, rounds


def _arcs(g: PropertyGraph, nexus_type: str | None, tail: str, head: str) -> tuple[DataFrame, DataFrame]:
    """(nexus_id, vertex_id, arity) of tails and (nexus_id, vertex_id) of heads; a nexus without tails never fires."""
    i = g.incidence
    if nexus_type is not None:
        i = i.join(g.nexuses.filter(F.col("type") == nexus_type).select(F.col("id").alias("nexus_id")), "nexus_id", "left_semi")
    tails = i.filter(F.col("role") == tail).select("nexus_id", "vertex_id").distinct()
    arity = tails.groupBy("nexus_id").agg(F.count("*").alias("arity"))
    return checkpoint(tails.join(arity, "nexus_id")), checkpoint(i.filter(F.col("role") == head).select("nexus_id", "vertex_id").distinct())


def reach(g: PropertyGraph, sources: DataFrame, nexus_type: str | None = None, tail: str = "tail", head: str = "head", max_rounds: int | None = None) -> DataFrame:
    """(vertex_id): the sources and every head of a nexus all of whose tails are reached, to the fixed point.

    Each round counts only tails newly reached, and adds them to what each nexus has. With ``max_rounds``, needing more is an error.
    """
    tails, heads = _arcs(g, nexus_type, tail, head)
    reached = new = checkpoint(sources.select("vertex_id").distinct())
    have = None
    for _ in rounds(max_rounds):
        hit = tails.join(new, "vertex_id").groupBy("nexus_id", "arity").agg(F.count("*").alias("n"))
        have = hit if have is None else have.unionByName(hit).groupBy("nexus_id", "arity").agg(F.sum("n").alias("n"))
        have = checkpoint(have)
        fired = have.filter("n = arity").select("nexus_id")
        new = checkpoint(heads.join(fired, "nexus_id", "left_semi").select("vertex_id").distinct().join(reached, "vertex_id", "left_anti"))
        if new.isEmpty():
            break
        reached = checkpoint(reached.unionByName(new))
    return reached


@dataclass(frozen=True)
class Derivation:
    """Preorder rows (depth, vertex, nexus or None for a source, cost) of one least derivation."""

    cost: float | None
    tree: list[tuple[int, int, int | None, float]]


def derivations(g: PropertyGraph, sources: DataFrame, cost: str | None = None, mode: str = "additive", nexus_type: str | None = None, tail: str = "tail", head: str = "head", max_rounds: int | None = None) -> DataFrame:
    """(vertex_id, cost, nexus_id): least costs of deriving each vertex, by relaxation; ties take the smaller nexus.

    additive adds the costs of all tails to the nexus's own; bottleneck takes the greatest of them. With ``max_rounds``, needing more is an error.
    """
    tails, heads = _arcs(g, nexus_type, tail, head)
    price = F.lit(1.0) if cost is None else F.coalesce(F.col(cost).cast("double"), F.lit(0.0))
    prices = checkpoint(g.nexuses.select(F.col("id").alias("nexus_id"), price.alias("price")))
    if prices.filter("price < 0").limit(1).count():
        raise ValueError("costs must not be negative")
    start = checkpoint(sources.select("vertex_id").distinct().select("vertex_id", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("nexus_id")))
    best = start
    for _ in rounds(max_rounds):
        known = tails.join(best.select("vertex_id", "cost"), "vertex_id").groupBy("nexus_id", "arity").agg(F.count("*").alias("n"), (F.sum if mode == "additive" else F.max)("cost").alias("c"))
        value = F.col("c") + F.col("price") if mode == "additive" else F.greatest("c", "price")
        offers = known.filter("n = arity").join(prices, "nexus_id").select("nexus_id", value.alias("cost")).join(heads, "nexus_id")
        least = offers.groupBy("vertex_id").agg(F.min(F.struct("cost", "nexus_id")).alias("m")).select("vertex_id", "m.cost", "m.nexus_id")
        old = best.select("vertex_id", F.col("cost").alias("old"), F.col("nexus_id").alias("was"))
        better = least.join(old, "vertex_id", "left").filter("old is null or cost < old or (cost = old and was is not null and nexus_id < was)").select("vertex_id", "cost", "nexus_id")
        better = checkpoint(better)
        if better.isEmpty():
            break
        best = checkpoint(best.join(better.select("vertex_id"), "vertex_id", "left_anti").unionByName(better))
    return best


def derivation_tree(g: PropertyGraph, best: DataFrame, target: int, nexus_type: str | None = None, tail: str = "tail", head: str = "head", most: int = 10_000) -> Derivation:
    """The least derivation of one vertex, preorder, tails by id; a shared vertex occurs wherever it is used."""
    row = best.filter(F.col("vertex_id") == target).head()
    if row is None:
        return Derivation(None, [])
    tree: list[tuple[int, int, int | None, float]] = []
    cache = {target: row}
    stack = [(0, target)]
    while stack:
        depth, v = stack.pop()
        r = cache[v]
        tree.append((depth, v, r.nexus_id, r.cost))
        if len(tree) > most:
            raise RuntimeError("the derivation tree exceeds its limit")
        if r.nexus_id is None:
            continue
        tails = [t.vertex_id for t in g.incidence.filter((F.col("nexus_id") == r.nexus_id) & (F.col("role") == tail)).select("vertex_id").distinct().collect()]
        missing = [t for t in tails if t not in cache]
        if missing:
            cache |= {x.vertex_id: x for x in best.filter(F.col("vertex_id").isin(missing)).collect()}
        stack.extend((depth + 1, t) for t in sorted(tails, reverse=True))
    return Derivation(row.cost, tree)
