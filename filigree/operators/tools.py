"""Composed queries: a start by text, vector, label or ids followed by up to two filtered hops, and the graph's schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.predicates import P
from filigree.graph import PropertyGraph
from filigree.operators.traversal import Source, Traversal

MOST_HOPS = 2


def traverse(g: PropertyGraph, start: tuple, hops: Sequence[tuple[str, str | None, str | None, dict[str, P] | None]] = (), limit: int = 50) -> Traversal:
    """start is ("text", key, query, k), ("vector", key, vector, k), ("label", label) or ("ids", ids); a hop is
    (direction, edge type, label, predicates by key)."""
    if len(hops) > MOST_HOPS:
        raise ValueError(f"at most {MOST_HOPS} hops")
    source = Source(g)
    kind, *args = start
    t = {"text": lambda: source.search(*args), "vector": lambda: source.knn(*args), "label": lambda: source.vertices().has_label(*args), "ids": lambda: source.vertices(*args)}[kind]()
    for direction, edge_type, label, tests in hops:
        t = {"out": t.out, "in": t.in_, "both": t.both}[direction](edge_type)
        t = t if label is None else t.has_label(label)
        for key, test in (tests or {}).items():
            t = t.has(key, test)
        t = t.dedup()
    return t.limit(limit)


def schema(g: PropertyGraph) -> DataFrame:
    """(kind, name, properties): labels, edge types and nexus types with the properties their entities carry."""
    out = None
    for kind, column in (("vertex", "label"), ("edge", "type"), ("nexus", "type")):
        keys = g.property_keys(kind)
        present = [F.when(F.count(k) > 0, F.lit(k)) for k in keys]
        rows = g.table(kind).groupBy(column).agg((F.array_compact(F.array(*present)) if present else F.array().cast("array<string>")).alias("properties"))
        rows = rows.select(F.lit(kind).alias("kind"), F.col(column).alias("name"), "properties")
        out = rows if out is None else out.unionByName(rows)
    return out
