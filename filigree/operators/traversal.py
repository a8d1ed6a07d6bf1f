"""The fluent traversal. Each step is a DataFrame transformation; Catalyst plans the whole chain.

State: a frame with ``cur`` (the current entity), alias columns and, after ``nexuses``, ``origin``; conditions on the
current entity wait in ``pending`` and reach its table in one go, so that they are pushed to the scan. A top-k leaf
waits with its conditions as well: conditions come first, then the top k. Rows form a bag.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.functions.predicates import P, condition
from filigree.graph import PropertyGraph

Branch = Callable[["Traversal"], "Traversal"]


class Source:
    """The seeds of a traversal."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    def vertices(self, ids: list[int] | None = None) -> Traversal:
        """All vertices, or the given ones in their order and as often as given; unknown ids drop out."""
        t = Traversal(self.graph, "vertex")
        if ids is None:
            return t
        frame = self.graph.vertices.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], "cur long, seq long")
        return t._with(frame=frame.join(self.graph.vertices.select(F.col("id").alias("cur")), "cur", "left_semi").orderBy("seq").select("cur"))

    def vertex(self, key: int) -> Traversal:
        return Traversal(self.graph, "vertex", pending=(lambda df: F.col("id") == key,))

    def edges(self) -> Traversal:
        return Traversal(self.graph, "edge")

    def nexuses(self, nexus_type: str | None = None) -> Traversal:
        return Traversal(self.graph, "nexus", pending=() if nexus_type is None else (lambda df: F.col("type") == nexus_type,))

    def nexus(self, key: int) -> Traversal:
        return Traversal(self.graph, "nexus", pending=(lambda df: F.col("id") == key,))

    def seek(self, key: str, value, kind: str = "vertex", label: str | None = None) -> Traversal:
        """Equality on a property of vertices, edges or nexuses, as a pushed-down filter."""
        t = Traversal(self.graph, kind).has(key, value)
        return t if label is None else t.has_label(label)

    def seek_range(self, key: str, low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = False, kind: str = "vertex") -> Traversal:
        """A range with independent inclusive flags, over integers, doubles or strings."""
        tests = []
        if low is not None:
            tests.append(F.col(key) >= F.lit(low) if low_inclusive else F.col(key) > F.lit(low))
        if high is not None:
            tests.append(F.col(key) <= F.lit(high) if high_inclusive else F.col(key) < F.lit(high))
        return Traversal(self.graph, kind, pending=tuple((lambda df, t=t: t) for t in tests))

    def knn(self, key: str, query: list[float], k: int, metric: str = "cosine") -> Traversal:
        from filigree.operators.vector_search import top_k

        return Traversal(self.graph, "vertex", leaf=lambda v: top_k(v, "id", key, query, k, metric).select("id"))

    def search(self, key: str, text: str, k: int) -> Traversal:
        """Top k by BM25 over all texts of the key; conditions that follow choose the candidates, not the statistics."""
        from filigree.operators.fulltext import search

        return Traversal(self.graph, "vertex", leaf=lambda v: search(self.graph.vertices.select("id", key), "id", key, text, k, candidates=v.select("id")).select("id"))

    def match(self, *patterns):
        from filigree.operators.match import Match

        return Match(self.graph, patterns)


class Traversal:
    def __init__(self, graph: PropertyGraph, kind: str, frame: DataFrame | None = None, pending: tuple = (), leaf=None, aliases: tuple[str, ...] = (), value: str | None = None, order: tuple[Column, ...] = ()):
        self.graph, self.kind, self.frame, self.pending, self.leaf = graph, kind, frame, pending, leaf
        self.aliases, self.value_key, self.order = aliases, value, order

    def _with(self, **changes) -> Traversal:
        state = {"graph": self.graph, "kind": self.kind, "frame": self.frame, "pending": self.pending, "leaf": self.leaf, "aliases": self.aliases, "value": self.value_key, "order": self.order}
        return Traversal(**(state | changes))

    # -- the current frame ------------------------------------------------------------------------------------

    def _entities(self) -> DataFrame:
        """The table of the current kind under the pending conditions."""
        table = self.graph.table(self.kind)
        return reduce(lambda df, p: df.filter(p(df)), self.pending, table)

    def _rows(self) -> DataFrame:
        """The frame with all conditions applied: cur, aliases, origin where kept."""
        if self.leaf is not None:
            return self.leaf(self._entities()).select(F.col("id").alias("cur"))
        if self.frame is None:
            return self._entities().select(F.col("id").alias("cur"))
        if not self.pending:
            return self.frame
        return self.frame.join(self._entities().select(F.col("id").alias("cur")), "cur", "left_semi")

    def _carried(self) -> list[str]:
        return [f"@{a}" for a in self.aliases]

    def _moved(self, frame: DataFrame, kind: str, keep: bool = True, extra: tuple[str, ...] = ()) -> Traversal:
        aliases = self.aliases if keep else ()
        return Traversal(self.graph, kind, frame.select("cur", *(f"@{a}" for a in aliases), *extra), aliases=aliases)

    # -- conditions -------------------------------------------------------------------------------------------

    def filter(self, test: Column | Callable[[DataFrame], Column]) -> Traversal:
        """Any condition over the columns of the current entity's table."""
        return self._with(pending=(*self.pending, (lambda df: test) if isinstance(test, Column) else test))

    def has_label(self, label: str) -> Traversal:
        """Vertices of a label; a second label is a further condition."""
        return self.filter(F.col("label" if self.kind == "vertex" else "type") == label)

    def has(self, key: str, value=None) -> Traversal:
        """A property equal to a value or fulfilling a predicate; without either, a present property."""
        test = P.present() if value is None else value if isinstance(value, P) else P.eq(value)
        return self.filter(lambda df: condition(df, key, test))

    def has_not(self, key: str) -> Traversal:
        return self.filter(lambda df: condition(df, key, P.missing()))

    def is_(self, value) -> Traversal:
        """Equality of the value projected last."""
        return self.has(self.value_key, value)

    # -- expansion --------------------------------------------------------------------------------------------

    def _adjacent(self, direction: str, edge_type: str | None, where: P | None = None, key: str | None = None) -> DataFrame:
        e = self.graph.edges
        e = e if edge_type is None else e.filter(F.col("type") == edge_type)
        e = e if where is None else e.filter(condition(e, key, where))
        out = e.select(F.col("src").alias("cur"), F.col("dst").alias("next"), F.col("id").alias("edge"))
        if direction == "out":
            return out
        into = (e.filter("src <> dst") if direction == "both" else e).select(F.col("dst").alias("cur"), F.col("src").alias("next"), F.col("id").alias("edge"))
        return into if direction == "in" else out.unionByName(into)

    def _expand(self, direction: str, edge_type: str | None, to: str = "next", where: P | None = None, key: str | None = None) -> Traversal:
        joined = self._rows().join(self._adjacent(direction, edge_type, where, key), "cur").withColumn("cur", F.col(to))
        return self._moved(joined, "edge" if to == "edge" else "vertex")

    def out(self, edge_type: str | None = None) -> Traversal:
        return self._expand("out", edge_type)

    def in_(self, edge_type: str | None = None) -> Traversal:
        return self._expand("in", edge_type)

    def both(self, edge_type: str | None = None) -> Traversal:
        return self._expand("both", edge_type)

    def out_where(self, edge_type: str | None, key: str, predicate: P) -> Traversal:
        """Expansion over edges whose property fulfils a predicate."""
        return self._expand("out", edge_type, where=predicate, key=key)

    def out_edges(self, edge_type: str | None = None) -> Traversal:
        return self._expand("out", edge_type, "edge")

    def in_edges(self, edge_type: str | None = None) -> Traversal:
        return self._expand("in", edge_type, "edge")

    def both_edges(self, edge_type: str | None = None) -> Traversal:
        return self._expand("both", edge_type, "edge")

    def expand_full(self, direction: str = "out", edge_type: str | None = None, weight: str | None = None) -> DataFrame:
        """(source, edge, neighbor, and the edges' weight where asked) of every current vertex."""
        pairs = self._rows().join(self._adjacent(direction, edge_type), "cur").select(F.col("cur").alias("source"), "edge", F.col("next").alias("neighbor"))
        return pairs if weight is None else pairs.join(self.graph.edges.select(F.col("id").alias("edge"), F.col(weight).alias("weight")), "edge")

    def _endpoint(self, side: str) -> Traversal:
        ends = self.graph.edges.select(F.col("id").alias("cur"), F.col(side).alias("next"))
        return self._moved(self._rows().join(ends, "cur").withColumn("cur", F.col("next")), "vertex", keep=False)

    def source_vertex(self) -> Traversal:
        return self._endpoint("src")

    def target_vertex(self) -> Traversal:
        return self._endpoint("dst")

    def other_vertex(self) -> Traversal:
        """The target always, also after in_edges: a documented limitation that is kept."""
        return self._endpoint("dst")

    def nexuses(self, nexus_type: str | None = None, role: str | None = None) -> Traversal:
        """The nexuses of each vertex, a row per incidence: a vertex in two roles gives two."""
        i = self.graph.incidence if role is None else self.graph.incidence.filter(F.col("role") == role)
        joined = self._rows().join(i.select(F.col("vertex_id").alias("cur"), F.col("nexus_id").alias("next")), "cur").withColumn("origin", F.col("cur")).withColumn("cur", F.col("next"))
        t = self._moved(joined, "nexus", extra=("origin",))
        return t if nexus_type is None else t.filter(F.col("type") == nexus_type)

    def members(self, role: str | None = None) -> Traversal:
        i = self.graph.incidence if role is None else self.graph.incidence.filter(F.col("role") == role)
        joined = self._rows().join(i.select(F.col("nexus_id").alias("cur"), F.col("vertex_id").alias("next")), "cur").withColumn("cur", F.col("next"))
        return self._moved(joined, "vertex")

    def other_members(self, role: str | None = None) -> Traversal:
        """Members but for the vertex the nexus was reached from, in whatever role."""
        rows = self._rows()
        if "origin" not in rows.columns:
            raise ValueError("other_members needs a step from a vertex to nexuses before it")
        i = self.graph.incidence if role is None else self.graph.incidence.filter(F.col("role") == role)
        joined = rows.join(i.select(F.col("nexus_id").alias("cur"), F.col("vertex_id").alias("next")), "cur").filter("next <> origin").withColumn("cur", F.col("next"))
        return self._moved(joined, "vertex")

    def repeat(self, step: str, times: int, emit: bool = False, edge_type: str | None = None, least: int = 1) -> Traversal:
        """Every vertex reached from a start, once, at its breadth-first depth: depth ``times``, or ``least`` to it with
        emit; at depth 0 a start reaches itself."""
        if not 0 <= least <= max(times, 1):
            raise ValueError("need 0 <= least <= times")
        from filigree.operators.paths import bfs

        starts = self._rows().select(F.col("cur").alias("start"))
        reached = bfs(self.graph, starts.distinct(), times, step, edge_type, include_start=least == 0 or times == 0)
        reached = reached.filter(F.col("depth") >= least) if emit else reached.filter(F.col("depth") == times)
        return self._moved(starts.join(reached, "start").select(F.col("end").alias("cur")), "vertex", keep=False)

    def shortest_path_to(self, target: int, max_depth: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
        """(source, target, distance) in hops; 0 for the target itself, unreachable pairs drop out."""
        from filigree.operators.paths import shortest_paths

        pairs = self._rows().select(F.col("cur").alias("source")).distinct().withColumn("target", F.lit(target).cast("long"))
        return shortest_paths(self.graph, pairs, max_depth, direction, edge_type)

    # -- existential sub-traversals and branches --------------------------------------------------------------

    def _seeds(self) -> Traversal:
        """A traversal over the distinct current entities that keeps the seed as an alias."""
        return Traversal(self.graph, self.kind, self._rows().select("cur").distinct().withColumn("@seed", F.col("cur")), aliases=("seed",))

    def _served(self, branch: Branch) -> DataFrame:
        return branch(self._seeds())._rows().select(F.col("@seed").alias("cur")).distinct()

    def where(self, branch: Branch) -> Traversal:
        """Keeps a row if the branch yields anything from it; decorrelated into one semi-join."""
        return self._with(frame=self._rows().join(self._served(branch), "cur", "left_semi"), pending=(), leaf=None)

    def not_(self, branch: Branch) -> Traversal:
        return self._with(frame=self._rows().join(self._served(branch), "cur", "left_anti"), pending=(), leaf=None)

    def and_(self, *branches: Branch) -> Traversal:
        return reduce(lambda t, b: t.where(b), branches, self)

    def or_(self, *branches: Branch) -> Traversal:
        served = reduce(DataFrame.unionByName, (self._served(b) for b in branches)).distinct()
        return self._with(frame=self._rows().join(served, "cur", "left_semi"), pending=(), leaf=None)

    def _branch_rows(self, branch: Branch) -> DataFrame:
        """(seed, next): what the branch yields from each distinct seed, as a bag."""
        return branch(self._seeds())._rows().select(F.col("@seed").alias("seed"), F.col("cur").alias("next"))

    def union(self, *branches: Branch) -> Traversal:
        """UNION ALL of the branches for every row."""
        rows = self._rows().select(F.col("cur").alias("seed"))
        parts = [rows.join(self._branch_rows(b), "seed").select(F.col("next").alias("cur")) for b in branches]
        return Traversal(self.graph, "vertex", reduce(DataFrame.unionByName, parts))

    def coalesce(self, *branches: Branch) -> Traversal:
        """Per row all rows of its first branch that yields any; a branch depends on the entity alone, so rows that share
        it share their branch, and no row needs a tag."""
        left, parts = self._rows().select(F.col("cur").alias("seed")), []
        for b in branches:
            found = self._branch_rows(b)
            parts.append(left.join(found, "seed").select(F.col("next").alias("cur")))
            left = left.join(found.select("seed").distinct(), "seed", "left_anti")
        return Traversal(self.graph, "vertex", reduce(DataFrame.unionByName, parts))

    def optional(self, branch: Branch) -> Traversal:
        """The branch's rows, or the vertex itself where there are none."""
        rows = self._rows().select(F.col("cur").alias("seed"))
        found = self._branch_rows(branch)
        own = rows.join(found.select("seed").distinct(), "seed", "left_anti").select(F.col("seed").alias("cur"))
        return Traversal(self.graph, "vertex", rows.join(found, "seed").select(F.col("next").alias("cur")).unionByName(own))

    # -- aliases, order, limits -------------------------------------------------------------------------------

    def as_(self, name: str) -> Traversal:
        return self._with(frame=self._rows().withColumn(f"@{name}", F.col("cur")), pending=(), leaf=None, aliases=(*self.aliases, name))

    def select(self, name: str) -> Traversal:
        """Back to the vertex pinned under an alias."""
        return self._with(kind="vertex", frame=self._rows().withColumn("cur", F.col(f"@{name}")), pending=(), leaf=None)

    def tuples(self, *names: str) -> DataFrame:
        """The pinned entities of each row."""
        return self._rows().select(*(F.col(f"@{n}").alias(n) for n in names))

    def dedup(self) -> Traversal:
        return self._with(frame=self._rows().dropDuplicates(["cur"]), pending=(), leaf=None)

    def order_by(self, key: str, descending: bool = False, absent_last: bool = True) -> Traversal:
        """By a property, ties by id; absent values last either way, or first when descending without absent_last."""
        frame = self._join_values([key])
        by = (F.desc_nulls_last if absent_last else F.desc_nulls_first)(key) if descending else F.asc_nulls_last(key)
        ordered = frame.withColumnRenamed(key, "#order")
        by = (F.desc_nulls_last("#order") if absent_last else F.desc_nulls_first("#order")) if descending else F.asc_nulls_last("#order")
        return self._with(frame=ordered.orderBy(by, "cur"), pending=(), leaf=None, order=(by, F.col("cur")))

    def range(self, low: int, high: int) -> Traversal:
        """Rows low to high - 1 in the order set before, by id where none is; negative bounds are errors."""
        if low < 0 or high < low:
            raise ValueError("a range needs 0 <= low <= high")
        frame = self._rows()
        order = self.order if self.order and "#order" in frame.columns else (F.col("cur"),)
        return self._with(frame=frame.orderBy(*order).offset(low).limit(high - low), pending=(), leaf=None)

    def limit(self, n: int) -> Traversal:
        if n < 0:
            raise ValueError("a limit must not be negative")
        return self.range(0, n)

    def skip(self, n: int) -> Traversal:
        if n < 0:
            raise ValueError("a skip must not be negative")
        frame = self._rows()
        order = self.order if self.order and "#order" in frame.columns else (F.col("cur"),)
        return self._with(frame=frame.orderBy(*order).offset(n), pending=(), leaf=None)

    # -- candidates of searches -------------------------------------------------------------------------------

    def filter_by_knn(self, key: str, query: list[float], k: int, metric: str = "cosine") -> Traversal:
        """The top k among the current vertices."""
        from filigree.operators.vector_search import top_k

        inside = self.graph.vertices.join(self._rows().select(F.col("cur").alias("id")).distinct(), "id", "left_semi")
        return Traversal(self.graph, "vertex", top_k(inside, "id", key, query, k, metric).select(F.col("id").alias("cur")))

    def filter_by_text(self, key: str, text: str, k: int) -> Traversal:
        """The top k by BM25 among the current vertices; document frequencies stay those of the whole index."""
        from filigree.operators.fulltext import search

        inside = self._rows().select(F.col("cur").alias("id")).distinct()
        return Traversal(self.graph, "vertex", search(self.graph.vertices.select("id", key), "id", key, text, k, candidates=inside).select(F.col("id").alias("cur")))

    # -- values and terminals ---------------------------------------------------------------------------------

    def _join_values(self, keys: list[str]) -> DataFrame:
        table = self.graph.table(self.kind)
        present = [F.col(k) if k in table.columns else F.lit(None).cast("string").alias(k) for k in keys]
        if self.frame is None and self.leaf is None:
            return self._entities().select(F.col("id").alias("cur"), *present)
        return self._rows().join(table.select(F.col("id").alias("cur"), *present), "cur")

    def values(self, *keys: str) -> DataFrame:
        """The rows with their properties; an absent property is null, the row stays."""
        return self._join_values(list(keys)).select(F.col("cur").alias("id"), *keys)

    def value(self, key: str) -> Traversal:
        """Projects a property for ``is_``."""
        return self._with(value=key)

    def label(self) -> DataFrame:
        name = "label" if self.kind == "vertex" else "type"
        rows = self._join_values([name])
        return rows.select(F.col("cur").alias("id"), F.coalesce(F.col(name), F.lit("")).alias("label"))

    def ids(self) -> DataFrame:
        return self._rows().select(F.col("cur").alias("id"))

    def to_df(self) -> DataFrame:
        """The rows with all columns of their entities."""
        table = self.graph.table(self.kind)
        if self.frame is None and self.leaf is None:
            return self._entities()
        return self._rows().select(F.col("cur").alias("id")).join(table, "id")

    def _numbers(self, key: str) -> tuple[DataFrame, T.DataType]:
        return self._join_values([key]), self.graph.table(self.kind).schema[key].dataType if key in self.graph.table(self.kind).columns else T.NullType()

    def _aggregate(self, key: str, f: Callable[[Column], Column], types: tuple, empty) -> DataFrame:
        rows, kind = self._numbers(key)
        element = F.col(key) if isinstance(kind, types) else F.lit(None)
        value = f(element.cast("double" if empty != 0 or isinstance(empty, float) else "long"))
        return rows.agg((value if empty is None else F.coalesce(value, F.lit(empty))).alias("value"))

    _NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType)

    def sum(self, key: str) -> DataFrame:
        """The sum as a double, 0.0 on nothing; values that are no numbers do not count."""
        return self._aggregate(key, F.sum, self._NUMERIC, 0.0)

    def sum_long(self, key: str) -> DataFrame:
        return self._aggregate(key, F.sum, (T.IntegerType, T.LongType, T.ShortType), 0)

    def max(self, key: str) -> DataFrame:
        return self._aggregate(key, F.max, self._NUMERIC, None)

    def min(self, key: str) -> DataFrame:
        return self._aggregate(key, F.min, self._NUMERIC, None)

    def mean(self, key: str) -> DataFrame:
        return self._aggregate(key, F.avg, self._NUMERIC, None)

    def count_df(self) -> DataFrame:
        return self._rows().agg(F.count("*").alias("value"))

    def group_count(self, key: str) -> DataFrame:
        """(key, n) over string values; absent and other values do not count. A Set property counts each value."""
        rows, kind = self._numbers(key)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            rows, kind = rows.withColumn(key, F.explode(key)), kind.elementType
        if not isinstance(kind, T.StringType):
            rows = rows.limit(0)
        return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self._rows().count()

    def to_list(self) -> list[int]:
        return [r.cur for r in self._rows().collect()]

    fold = to_list

    def cursor(self):
        """Pulls row after row from the executors."""
        return (r.cur for r in self._rows().toLocalIterator())

    def try_next(self) -> int | None:
        rows = self._rows().head(1)
        return rows[0].cur if rows else None

    def next(self) -> int:
        found = self.try_next()
        if found is None:
            raise LookupError("the traversal is empty")
        return found

    first = next

    def has_next(self) -> bool:
        return self.try_next() is not None


def top_within(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; each task keeps k a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
