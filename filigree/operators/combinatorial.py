"""Exact algorithms of exponential nature over sets and points the caller has selected.

Spark extracts the input; the search itself runs on the driver under explicit limits on its size, nodes and time, and
reports how it ended. The H0 barcode's edges come from Spark; only the spanning tree's union-find is sequential.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_sets(incidence: DataFrame, role: str | None = None, most: int = 100_000) -> dict[int, frozenset[int]]:
    """nexus -> member vertices, of a selection of at most ``most`` incidences."""
    rows = incidence if role is None else incidence.filter(F.col("role") == role)
    got = rows.select("nexus_id", "vertex_id").distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"the selection exceeds {most} incidences")
    out: dict[int, set[int]] = {}
    for r in got:
        out.setdefault(r.nexus_id, set()).add(r.vertex_id)
    return {k: frozenset(v) for k, v in out.items()}


@dataclass(frozen=True)
class HittingSet:
    vertices: frozenset[int]
    lower_bound: int
    optimal: bool
    nodes: int
    reason: str


def _reduced(sets: list[frozenset[int]]) -> list[frozenset[int]]:
    """The sets without those that contain another."""
    out: list[frozenset[int]] = []
    for s in sorted(set(sets), key=lambda s: (len(s), sorted(s))):
        if not any(o <= s for o in out):
            out.append(s)
    return out


def _packing(sets: list[frozenset[int]]) -> int:
    """Disjoint sets picked greedily, each of which needs an element of its own."""
    used: set[int] = set()
    n = 0
    for s in sets:
        if not s & used:
            used |= s
            n += 1
    return n


def _coverage(sets: list[frozenset[int]]) -> int:
    """Elements needed if each hit as many sets as the best ones do."""
    counts: dict[int, int] = {}
    for s in sets:
        for v in s:
            counts[v] = counts.get(v, 0) + 1
    left, n = len(sets), 0
    for c in sorted(counts.values(), reverse=True):
        if left <= 0:
            break
        left, n = left - c, n + 1
    return n


def _greedy(sets: list[frozenset[int]]) -> frozenset[int]:
    left, out = list(sets), set()
    while left:
        counts: dict[int, int] = {}
        for s in left:
            for v in s:
                counts[v] = counts.get(v, 0) + 1
        v = min(counts, key=lambda x: (-counts[x], x))
        out.add(v)
        left = [s for s in left if v not in s]
    return frozenset(out)


def minimum_hitting_set(sets: Iterable[frozenset[int]], max_nodes: int = 1_000_000, seconds: float = 1.0) -> HittingSet:
    """A least set of elements meeting every set. Always feasible: under a limit the best found, with a lower bound."""
    start = _reduced(list(sets))
    if any(not s for s in start):
        raise ValueError("an empty set cannot be hit")
    best, began, nodes, reason = _greedy(start), time.monotonic(), 0, "optimal"
    low = max(_packing(start), _coverage(start))
    stack: list[tuple[list[frozenset[int]], frozenset[int]]] = [(start, frozenset())]
    while stack and reason == "optimal":
        left, picked = stack.pop()
        nodes += 1
        if nodes > max_nodes or time.monotonic() - began > seconds:
            reason = "node_limit" if nodes > max_nodes else "time_limit"
            break
        while left and len(left[0]) == 1:  # a single choice is forced
            picked = picked | left[0]
            left = [s for s in left if not s & left[0]]
        if not left:
            if (len(picked), sorted(picked)) < (len(best), sorted(best)):
                best = picked
            continue
        if len(picked) + max(_packing(left), _coverage(left)) >= len(best):
            continue
        counts = {v: sum(v in s for s in left) for v in left[0]}
        tried: set[int] = set()
        branches = []
        for v in sorted(left[0], key=lambda x: (-counts[x], x)):
            rest = [s - tried for s in left if v not in s]
            if all(rest):
                branches.append((_reduced(rest), picked | {v}))
            tried.add(v)
        stack.extend(reversed(branches))
    return HittingSet(best, len(best) if reason == "optimal" else low, reason == "optimal", nodes, reason)


@dataclass
class Context:
    """Objects with attributes, as bit sets; objects and attributes are ordered by id."""

    objects: list[int]
    attributes: list[str]
    rows: list[int] = field(default_factory=list)

    @staticmethod
    def of(pairs: Iterable[tuple[int, str]]) -> Context:
        pairs = set(pairs)
        objects, attributes = sorted({o for o, _ in pairs}), sorted({a for _, a in pairs})
        place = {a: i for i, a in enumerate(attributes)}
        rows = dict.fromkeys(objects, 0)
        for o, a in pairs:
            rows[o] |= 1 << place[a]
        return Context(objects, attributes, [rows[o] for o in objects])

    def extent(self, intent: int) -> int:
        return sum(1 << i for i, r in enumerate(self.rows) if r & intent == intent)

    def intent(self, extent: int) -> int:
        out = (1 << len(self.attributes)) - 1
        for i, r in enumerate(self.rows):
            if extent >> i & 1:
                out &= r
        return out


def context(g, role: str, most: int = 100_000) -> Context:
    """Nexus types as attributes of their role members."""
    rows = g.incidence.filter(F.col("role") == role).join(g.nexuses.select(F.col("id").alias("nexus_id"), "type"), "nexus_id").select("vertex_id", "type").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the selection exceeds {most} pairs")
    return Context.of((r.vertex_id, r.type) for r in rows)


def concepts(c: Context, after: int | None = None, min_extent: int = 0, min_intent: int = 0, most: int = 100_000) -> Iterator[tuple[list[int], list[str]]]:
    """Formal concepts in lectic order of their intents, from the one after intent ``after``; at most ``most``.

    The smallest sizes filter results only. An intent's bits can be given back as ``after`` to turn the page.
    """
    m, given = len(c.attributes), 0
    close = lambda b: c.intent(c.extent(b))
    current = close(0) if after is None else _next(after, m, close)
    while current is not None and given < most:
        extent = c.extent(current)
        if extent.bit_count() >= min_extent and current.bit_count() >= min_intent:
            given += 1
            yield [o for i, o in enumerate(c.objects) if extent >> i & 1], [a for i, a in enumerate(c.attributes) if current >> i & 1]
        current = _next(current, m, close)


def _next(b: int, m: int, close) -> int | None:
    """The lectically next closed set: attribute 0 weighs most."""
    for i in range(m - 1, -1, -1):
        if b >> i & 1:
            b &= ~(1 << i)
        else:
            d = close(b | 1 << i)
            if (d & ~b) & ((1 << i) - 1) == 0:
                return d
    return None


def concepts_close_by_one(c: Context) -> list[tuple[list[int], list[str]]]:
    """The same concepts, by extending intents attribute by attribute, in the order they are found."""
    m, out = len(c.attributes), []
    stack = [(c.intent((1 << len(c.objects)) - 1), 0)]
    while stack:
        b, start = stack.pop()
        extent = c.extent(b)
        out.append(([o for i, o in enumerate(c.objects) if extent >> i & 1], [a for i, a in enumerate(c.attributes) if b >> i & 1]))
        for i in range(m - 1, start - 1, -1):
            if not b >> i & 1:
                d = c.intent(c.extent(b | 1 << i))
                if (d & ~b) & ((1 << i) - 1) == 0:
                    stack.append((d, i + 1))
    return out


@dataclass(frozen=True)
class Barcode:
    """Deaths of components in rising order, and how many survive; approximate for a sparse filtration."""

    deaths: list[float]
    survivors: int
    points: int
    approximate: bool
    limited: bool


def h0_barcode(points: DataFrame, id_col: str, vector_col: str, k: int | None = None, max_scale: float | None = None, most: int = 20_000) -> Barcode:
    """The H0 persistence of points under Euclidean distance: the lengths at which components merge.

    Complete without k, else over each point's k nearest neighbours. A caller's selection of at most ``most`` points;
    distances are computed block by block and only a spanning forest of each block is kept.
    """
    rows = points.select(id_col, vector_col).orderBy(id_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the selection exceeds {most} points")
    n = len(rows)
    x = np.array([r[1] for r in rows], float).reshape(n, len(rows[0][1]) if n else 0)
    edges = np.zeros((0, 3))
    for at in range(0, n, 512):
        gaps = np.sqrt(np.maximum(((x[at : at + 512, None, :] - x[None, :, :]) ** 2).sum(-1), 0)) if n * x.shape[1] < 2_000_000 else np.stack([np.linalg.norm(x - row, axis=1) for row in x[at : at + 512]])
        i, j = np.meshgrid(np.arange(at, min(at + 512, n)), np.arange(n), indexing="ij")
        if k is not None:
            gaps[np.arange(len(gaps)), np.arange(at, at + len(gaps))] = np.inf
            near = np.argsort(gaps, axis=1, kind="stable")[:, :k]
            block = np.stack([np.repeat(np.arange(at, at + len(gaps)), near.shape[1]), near.ravel(), np.take_along_axis(gaps, near, 1).ravel()], 1)
        else:
            upper = j > i
            block = np.stack([i[upper], j[upper], gaps[upper]], 1)
        edges = _forest(np.concatenate([edges, block]), n)
    deaths = sorted(edges[:, 2].tolist())
    limited = max_scale is not None and any(d > max_scale for d in deaths)
    deaths = [d for d in deaths if max_scale is None or d <= max_scale]
    return Barcode(deaths, n - len(deaths), n, k is not None, limited)


def _forest(edges: np.ndarray, n: int) -> np.ndarray:
    """The least spanning forest, edges by length, then ends."""
    order = np.lexsort((np.maximum(edges[:, 0], edges[:, 1]), np.minimum(edges[:, 0], edges[:, 1]), edges[:, 2]))
    parent, kept = list(range(n)), []
    for e in order:
        a, b = int(edges[e, 0]), int(edges[e, 1])
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b and np.isfinite(edges[e, 2]):
            parent[max(a, b)] = min(a, b)
            kept.append(e)
    return edges[kept]


def cluster_estimate(b: Barcode) -> tuple[int, float | None]:
    """(clusters, scale): the components if several survive, else the split at the largest gap between deaths."""
    if b.limited:
        raise ValueError("a scale-limited barcode gives no estimate")
    if b.points == 0:
        return 0, None
    if b.survivors > 1:
        return b.survivors, None
    if len(b.deaths) < 2:
        return b.points, None
    gaps = [y - x for x, y in zip(b.deaths, b.deaths[1:])]
    i = max(range(len(gaps)), key=lambda k: (gaps[k], -k))
    return b.points - (i + 1), (b.deaths[i] + b.deaths[i + 1]) / 2
