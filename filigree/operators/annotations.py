"""Annotations of walks from a source: reachability, least sums, greatest products, numbers of walks.

All relax level by level over DataFrames. A result says how it ended; one that met a limit before its fixed point has no
values, for half-relaxed annotations mean nothing.
"""

from __future__ import annotations

import itertools
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.graph import PropertyGraph
from filigree.operators.paths import hops
from filigree.session import checkpoint

LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Limits:
    """What a search may use before it ends unfinished; None is no limit."""

    vertices: int | None = 100_000
    edges: int | None = 1_000_000
    results: int | None = 100_000
    relaxations: int | None = 10_000_000
    updates: int | None = 10_000_000
    seconds: float | None = 10.0


#: The whole graph, however large.
WHOLE = Limits(None, None, None, None, None, None)


@dataclass(frozen=True)
class Annotation:
    """values(id, value), None when unfinished; reason is completed, vertex_limit, edge_limit, relaxation_limit,
    update_limit, time_limit, cycle or overflow; exact is false if values were cut to the result limit."""

    values: DataFrame | None
    reason: str
    exact: bool
    rounds: int


def _loop(g: PropertyGraph, source: int, start, step, better, limits: Limits, acyclic: bool, edge_type: str | None, direction: str, weight: str | None) -> Annotation:
    """start is the source's value; step(value, w) the value of a longer walk; better aggregates walks that meet.

    With ``better`` an improvement replaces the value (label correcting). Without it the values of all walks of one
    length flow on and are summed over the lengths, which ends only on graphs without a cycle in reach.
    """
    spark, began = g.vertices.sparkSession, time.monotonic()
    steps = checkpoint(hops(g, direction, edge_type, weight).select("from", "to", "w"))
    if limits.edges is not None and steps.limit(limits.edges + 1).count() > limits.edges:
        return Annotation(None, "edge_limit", False, 0)
    total = spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(start).cast("double" if isinstance(start, float) else "decimal(38,0)").alias("value"))
    frontier, relaxed, updated, vertices = total, 0, 0, None
    for k in itertools.count(1):
        moved = frontier.join(steps, F.col("id") == F.col("from")).select(F.col("to").alias("id"), step(F.col("value"), F.col("w")).alias("value"))
        grouped = moved.groupBy("id").agg((better or F.sum)("value").alias("value"), F.count("*").alias("_n"))
        if better is not None:
            old = total.select("id", F.col("value").alias("_old"))
            least = grouped.join(old, "id", "left")
            improves = F.col("_old").isNull() | ((F.col("value") < F.col("_old")) if better is F.min else (F.col("value") > F.col("_old")))
            frontier = checkpoint(least.filter(improves).select("id", "value", "_n"))
        else:
            frontier = checkpoint(grouped.select("id", F.col("value").cast("decimal(38,0)").alias("value"), "_n"))
        n, walks, most = frontier.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0)), F.max("value")).first()
        if not n:
            break
        relaxed, updated = relaxed + walks, updated + n
        frontier = frontier.select("id", "value")
        if better is not None:
            total = checkpoint(total.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))
        else:
            total = checkpoint(total.unionByName(frontier).groupBy("id").agg(F.sum("value").cast("decimal(38,0)").alias("value")))
            if total.filter(F.col("value") > F.lit(LONG_MAX)).limit(1).count():
                return Annotation(None, "overflow", False, k)
        vertices = total.count()
        for name, now, most in (("vertex_limit", vertices, limits.vertices), ("relaxation_limit", relaxed, limits.relaxations), ("update_limit", updated, limits.updates)):
            if most is not None and now > most:
                return Annotation(None, name, False, k)
        if acyclic and k > vertices:
            return Annotation(None, "cycle", False, k)
        if limits.seconds is not None and time.monotonic() - began > limits.seconds:
            return Annotation(None, "time_limit", False, k)
    exact = limits.results is None or total.count() <= limits.results
    values = total if exact else total.orderBy("id").limit(limits.results)
    if better is None:
        values = values.select("id", F.col("value").cast("long").alias("value"))
    return Annotation(values, "completed", exact, k)


def reachable(g: PropertyGraph, source: int, limits: Limits = Limits(), edge_type: str | None = None, direction: str = "out") -> Annotation:
    """(id, 1.0) of every vertex in reach, the source included."""
    return _loop(g, source, 1.0, lambda v, w: v, F.max, limits, False, edge_type, direction, None)


def tropical(g: PropertyGraph, source: int, weight: str, policy: str = "label_setting", limits: Limits = Limits(), edge_type: str | None = None, direction: str = "out") -> Annotation:
    """Least sums of weights. label_setting refuses negative weights, acyclic refuses cycles, bounded_worklist takes both
    and stops at the limits."""
    if policy == "label_setting" and hops(g, direction, edge_type, weight).filter("w < 0").limit(1).count():
        raise ValueError("label setting needs weights of 0 or more")
    if policy == "acyclic" and (stopped := _stops(g, source, edge_type, direction, limits)):
        return stopped
    return _loop(g, source, 0.0, lambda v, w: v + w, F.min, limits, policy == "acyclic", edge_type, direction, weight)


def _stops(g: PropertyGraph, source: int, edge_type: str | None, direction: str, limits: Limits) -> Annotation | None:
    """The unfinished annotation if the limits do not let all in reach be seen; an error if there is a cycle in reach.

    Vertices without an arc into them are peeled off, round by round; what is left in the end lies on a cycle or behind one.
    """
    seen = reachable(g, source, replace(limits, results=limits.vertices), edge_type, direction)
    if seen.reason != "completed":
        return seen
    steps = hops(g, direction, edge_type, None).select("from", "to").distinct()
    arcs = checkpoint(steps.join(seen.values.select(F.col("id").alias("from")), "from", "left_semi"))
    left = arcs.count()
    while left:
        arcs = checkpoint(arcs.join(arcs.select(F.col("to").alias("from")).distinct(), "from", "left_semi"))
        before, left = left, arcs.count()
        if left == before:
            raise ValueError("the graph has a cycle in reach of the source")
    return None


def viterbi(g: PropertyGraph, source: int, weight: str, limits: Limits = Limits(), edge_type: str | None = None, direction: str = "out") -> Annotation:
    """Greatest products of weights in [0, 1], on graphs without a cycle in reach."""
    if hops(g, direction, edge_type, weight).filter("w < 0 or w > 1").limit(1).count():
        raise ValueError("weights must lie in [0, 1]")
    if stopped := _stops(g, source, edge_type, direction, limits):
        return stopped
    return _loop(g, source, 1.0, lambda v, w: v * w, F.max, limits, True, edge_type, direction, weight)


def walks(g: PropertyGraph, source: int, limits: Limits = Limits(), edge_type: str | None = None, direction: str = "out") -> Annotation:
    """The number of walks from the source to each vertex, the empty one included; a cycle in reach or a number beyond 64
    bits ends without values."""
    return _loop(g, source, 1, lambda v, w: v, None, limits, True, edge_type, direction, None)
