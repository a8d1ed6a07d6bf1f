"""Pattern matching: a vertex, one edge between vertices, or the star of a nexus; and the cyclic triangle join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.predicates import P, condition
from filigree.graph import PropertyGraph


@dataclass(frozen=True)
class VertexPattern:
    name: str
    label: str | None = None


@dataclass(frozen=True)
class EdgePattern:
    """(source)-[name:type]->(target); ``reverse`` turns the arrow."""

    source: VertexPattern
    target: VertexPattern
    type: str | None = None
    name: str | None = None
    reverse: bool = False


@dataclass(frozen=True)
class NexusPattern:
    """A nexus of a type with members by role; a role given twice binds every ordered combination, also the same vertex."""

    name: str
    type: str | None
    members: tuple[tuple[str, VertexPattern], ...]


class Match:
    """A pattern with conditions on its variables; every variable becomes a column of ids."""

    def __init__(self, graph: PropertyGraph, patterns: tuple, tests: tuple = ()):
        if len(patterns) != 1:
            raise ValueError("exactly one pattern is matched at a time")
        self.graph, self.pattern, self.tests = graph, patterns[0], tests
        names = [n for n, _ in self._variables()]
        if len(names) != len(set(names)):
            raise ValueError("a variable is bound twice")
        if isinstance(self.pattern, NexusPattern) and (not self.pattern.members or not all(r for r, _ in self.pattern.members)):
            raise ValueError("a nexus pattern needs members, each with a role")

    def _variables(self) -> list[tuple[str, str]]:
        p = self.pattern
        if isinstance(p, VertexPattern):
            return [(p.name, "vertex")]
        if isinstance(p, EdgePattern):
            return [(p.source.name, "vertex"), (p.target.name, "vertex"), *([(p.name, "edge")] if p.name else [])]
        return [(p.name, "nexus"), *((v.name, "vertex") for _, v in p.members)]

    def where(self, name: str, key: str, predicate: P) -> Match:
        if name not in dict(self._variables()):
            raise KeyError(name)
        return Match(self.graph, (self.pattern,), (*self.tests, (name, key, predicate)))

    def _bound(self, name: str, kind: str, label: str | None = None) -> DataFrame:
        """The candidates of one variable: its table under its label and conditions, filtered before any join."""
        table = self.graph.table(kind)
        if label is not None:
            table = table.filter(F.col("label" if kind == "vertex" else "type") == label)
        return reduce(lambda df, t: df.filter(condition(df, t[1], t[2])), [t for t in self.tests if t[0] == name], table)

    def _needs(self, name: str, label: str | None) -> bool:
        return label is not None or any(t[0] == name for t in self.tests)

    def to_df(self) -> DataFrame:
        p = self.pattern
        if isinstance(p, VertexPattern):
            return self._bound(p.name, "vertex", p.label).select(F.col("id").alias(p.name))
        if isinstance(p, EdgePattern):
            a, b = (p.target, p.source) if p.reverse else (p.source, p.target)
            e = self._bound(p.name or "", "edge", p.type)
            rows = e.select(F.col("src").alias(a.name), F.col("dst").alias(b.name), *([F.col("id").alias(p.name)] if p.name else []))
            return self._restrict(rows, (p.source, p.target))
        base = self._bound(p.name, "nexus", p.type).select(F.col("id").alias(p.name))
        for role, v in p.members:
            some = self.graph.incidence.filter(F.col("role") == role).select(F.col("nexus_id").alias(p.name), F.col("vertex_id").alias(v.name))
            base = base.join(self._restrict(some, (v,)), p.name)
        return base

    def _restrict(self, rows: DataFrame, vertices: tuple) -> DataFrame:
        for v in vertices:
            if self._needs(v.name, v.label):
                rows = rows.join(self._bound(v.name, "vertex", v.label).select(F.col("id").alias(v.name)), v.name, "left_semi")
        return rows

    def select(self, *columns: tuple[str, str]) -> DataFrame:
        """Properties of variables: (variable, key) each becomes the column variable_key."""
        kinds, rows = dict(self._variables()), self.to_df()
        by: dict[str, list[str]] = {}
        for name, key in columns:
            by.setdefault(name, []).append(key)
        for name, keys in by.items():
            table = self.graph.table(kinds[name]).select(F.col("id").alias(name), *(F.col(k).alias(f"{name}_{k}") for k in keys))
            rows = rows.join(table, name)
        return rows.select(*(f"{n}_{k}" for n, k in columns))

    def count(self) -> int:
        return self.to_df().count()

    def first(self):
        return self.to_df().orderBy(*self.to_df().columns).head()


def triangle_join(r: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """(a, b, c) of R(a, b) join S(b, c) join T(c, a) as a bag.

    Rows that can close no triangle go first, by semi-joins on both shared variables; the wedge that is left joins T on
    both ends at once. Repeated pairs are counted before the joins and multiplied back after.
    """
    count = lambda df: df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    r, s, t = count(r.select("a", "b")), count(s.select("b", "c")), count(t.select("c", "a"))
    s = s.join(t.select("c").distinct(), "c", "left_semi")
    r = r.join(s.select("b").distinct(), "b", "left_semi").join(t.select("a").distinct(), "a", "left_semi")
    found = r.withColumnRenamed("n", "x").join(s.withColumnRenamed("n", "y"), "b").join(t.withColumnRenamed("n", "z"), ["c", "a"])
    return found.withColumn("_", F.explode(F.expr("sequence(1L, x * y * z)"))).select("a", "b", "c")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c: the triangles of the undirected simple graph of (src, dst).

    Each edge points to its end of higher degree (ties by id), so that no vertex has more than about the square root
    of twice the edges going out, hubs included, and the wedges stay few on any skew.
    """
    plain = edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    ends = plain.select(F.col("u").alias("id")).unionByName(plain.select(F.col("v").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("d"))
    both = plain.join(degree.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    low = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    arcs = both.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedges = arcs.alias("p").join(arcs.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    closed = wedges.join(plain.select(F.col("u").alias("y"), F.col("v").alias("z")), ["y", "z"])
    corners = F.array_sort(F.array("x", "y", "z"))
    return closed.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))
