"""Mutations: each returns a new graph over new plans; the old handle is the state before (rollback, savepoint).

``Versions`` keeps committed states as snapshot folders, numbered by markers that are written last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.graph import PropertyGraph, read_snapshot, write_snapshot
from filigree.session import checkpoint, shared_path


def next_id(df: DataFrame) -> int:
    return (df.agg(F.max("id")).first()[0] or 0) + 1


def _numbered(rows: DataFrame, first: int, order: list[str]) -> DataFrame:
    """New ids from ``first``, in a total order: rows are cut into ranges, and each range begins where the one before
    ends, so that no task numbers them all. Only a count per range comes to the driver."""
    parts = checkpoint(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    begins, at = [], first
    for r in parts.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        begins.append((r["_p"], at))
        at += r.n
    starts = F.broadcast(rows.sparkSession.createDataFrame(begins, "_p int, _first long"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.join(starts, "_p").withColumn("id", (place + F.col("_first")).cast("long")).drop("_p", "_first")


def add_vertices(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    return g.with_tables(vertices=g.vertices.unionByName(rows, allowMissingColumns=True))


def add_edges(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    return g.with_tables(edges=g.edges.unionByName(rows, allowMissingColumns=True))


def add_nexuses(g: PropertyGraph, rows: DataFrame, members: DataFrame) -> PropertyGraph:
    """Nexuses of at least two members, each (role, vertex) once in a nexus; others are errors."""
    counts = members.groupBy("nexus_id").agg(F.count("*").alias("n"), F.countDistinct("role", "vertex_id").alias("d"))
    bad = rows.select(F.col("id").alias("nexus_id")).join(counts, "nexus_id", "left").filter("n is null or n < 2 or n <> d")
    if bad.limit(1).count():
        raise ValueError("a nexus needs two or more members, each once in its role")
    return g.with_tables(nexuses=g.nexuses.unionByName(rows, allowMissingColumns=True), incidence=g.incidence.unionByName(members))


def delete_vertices(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Vertices (id) with their edges and every nexus they are a member of."""
    gone = ids.select("id").distinct()
    hit = g.incidence.join(gone.withColumnRenamed("id", "vertex_id"), "vertex_id", "left_semi").select("nexus_id").distinct()
    edges = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*g.edges.columns)
    return delete_nexuses(g.with_tables(vertices=g.vertices.join(gone, "id", "left_anti"), edges=edges), hit.withColumnRenamed("nexus_id", "id"))


def delete_edges(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    return g.with_tables(edges=g.edges.join(ids.select("id"), "id", "left_anti"))


def delete_nexuses(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    gone = ids.select("id")
    return g.with_tables(nexuses=g.nexuses.join(gone, "id", "left_anti"), incidence=g.incidence.join(gone.withColumnRenamed("id", "nexus_id"), "nexus_id", "left_anti"))


def _changed(df: DataFrame, key: str, values: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """df with ``key`` recomputed where values(id, value) has the id."""
    if key not in df.columns:
        df = df.withColumn(key, F.lit(None).cast(values.schema["value"].dataType))
    new = values.select("id", F.col("value").alias("_v"), F.lit(True).alias("_hit"))
    joined = df.join(new, "id", "left")
    return joined.withColumn(key, F.when(F.col("_hit"), combine(F.col(key), F.col("_v"))).otherwise(F.col(key))).select(*df.columns)


def _put(g: PropertyGraph, kind: str, df: DataFrame) -> PropertyGraph:
    return g.with_tables(**{{"vertex": "vertices", "edge": "edges", "nexus": "nexuses"}[kind]: df})


def _cardinality(g: PropertyGraph, kind: str, key: str, many: bool) -> None:
    table = g.table(kind)
    if key in table.columns and isinstance(table.schema[key].dataType, T.ArrayType) != many:
        raise TypeError(f"{key} is a {'Single' if many else 'Set'} property")


def set_property(g: PropertyGraph, kind: str, key: str, values: DataFrame) -> PropertyGraph:
    """Overwrites a Single property with values(id, value)."""
    _cardinality(g, kind, key, False)
    return _put(g, kind, _changed(g.table(kind), key, values, lambda old, new: new))


def remove_property(g: PropertyGraph, kind: str, key: str, ids: DataFrame) -> PropertyGraph:
    table = g.table(kind)
    gone = ids.select("id", F.lit(None).cast(table.schema[key].dataType).alias("value"))
    return _put(g, kind, _changed(table, key, gone, lambda old, new: new))


def add_value(g: PropertyGraph, kind: str, key: str, values: DataFrame) -> PropertyGraph:
    """Adds values(id, value) to a Set property; a value it has is no change."""
    _cardinality(g, kind, key, True)
    lists = values.groupBy("id").agg(F.array_sort(F.collect_set("value")).alias("value"))
    return _put(g, kind, _changed(g.table(kind), key, lists, lambda old, new: F.array_union(F.coalesce(old, F.slice(new, 1, 0)), new)))


def remove_value(g: PropertyGraph, kind: str, key: str, values: DataFrame) -> PropertyGraph:
    """Removes values(id, value) from a Set property; the last value's removal leaves it absent."""
    _cardinality(g, kind, key, True)
    lists = values.groupBy("id").agg(F.collect_set("value").alias("value"))
    return _put(g, kind, _changed(g.table(kind), key, lists, lambda old, new: F.when(F.size(F.array_except(old, new)) > 0, F.array_except(old, new))))


def merge_vertices(g: PropertyGraph, label: str, key: str, rows: DataFrame) -> PropertyGraph:
    """Get or create: rows(value, properties...) without a vertex of the label and key value become new vertices."""
    have = g.vertices.filter(F.col("label") == label).select(F.col(key).alias("value")).filter("value is not null").distinct()
    new = rows.dropDuplicates(["value"]).join(have, "value", "left_anti")
    return add_vertices(g, _numbered(new, next_id(g.vertices), ["value"]).withColumn("label", F.lit(label)).withColumnRenamed("value", key))


def merge_edges(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """Get or create by (src, dst, type)."""
    identity = ["src", "dst", "type"]
    new = rows.dropDuplicates(identity).join(g.edges.select(*identity).distinct(), identity, "left_anti")
    return add_edges(g, _numbered(new, next_id(g.edges), identity))


def member_key(incidence: DataFrame) -> DataFrame:
    """(nexus_id, members): the sorted member set of each nexus, its identity beside the type."""
    return incidence.groupBy("nexus_id").agg(F.array_sort(F.collect_set(F.struct("role", "vertex_id"))).alias("members"))


def merge_nexuses(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """Get or create by (type, member set), the members in any order: rows(type, members array<struct<role, vertex_id>>)."""
    have = member_key(g.incidence).join(g.nexuses.select(F.col("id").alias("nexus_id"), "type"), "nexus_id").select("type", "members")
    asked = rows.withColumn("members", F.array_sort(F.array_distinct("members"))).dropDuplicates(["type", "members"])
    new = asked.alias("n").join(have.alias("h"), (F.col("n.type") == F.col("h.type")) & (F.to_json("n.members") == F.to_json("h.members")), "left_anti")
    new = _numbered(new.withColumn("_k", F.to_json("members")), next_id(g.nexuses), ["type", "_k"]).drop("_k")
    members = new.select(F.col("id").alias("nexus_id"), F.explode("members").alias("m")).select("nexus_id", "m.role", "m.vertex_id")
    return add_nexuses(g, new.drop("members"), members)


def connect(g: PropertyGraph, pairs: DataFrame, edge_type: str, merge: bool = False) -> tuple[PropertyGraph, int]:
    """Edges for the pairs (src, dst) of a traversal, and how many were made; with merge only missing ones."""
    rows = pairs.select("src", "dst", F.lit(edge_type).alias("type"))
    new = merge_edges(g, rows) if merge else add_edges(g, _numbered(rows, next_id(g.edges), ["src", "dst"]))
    return new, new.edges.count() - g.edges.count()


def replace_vertices(g: PropertyGraph, mapping: DataFrame, label: str | None = None) -> PropertyGraph:
    """Vertices get the ids of mapping(old, new), all references follow; with a label they change it too."""

    def moved(df: DataFrame, column: str) -> DataFrame:
        m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
        return df.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)

    vertices = g.vertices
    if label is not None:
        hit = mapping.select(F.col("old").alias("id"), F.lit(True).alias("_hit"))
        vertices = vertices.join(hit, "id", "left").withColumn("label", F.when(F.col("_hit"), label).otherwise(F.col("label"))).select(*vertices.columns)
    return g.with_tables(vertices=moved(vertices, "id"), edges=moved(moved(g.edges, "src"), "dst"), incidence=moved(g.incidence, "vertex_id"))


def check_unique(g: PropertyGraph, label: str, key: str) -> None:
    """The opt-in constraint on a Single string property of a label."""
    same = g.vertices.filter((F.col("label") == label) & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    if same.limit(1).count():
        raise ValueError(f"{label}.{key} is not unique")


@dataclass
class Builder:
    """Fluent additions, made one or many at a time and applied together."""

    graph: PropertyGraph
    vertices: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    nexuses: list[tuple[dict, list[tuple[str, int]]]] = field(default_factory=list)

    def vertex(self, label: str, **properties) -> int:
        key = next_id(self.graph.vertices) + len(self.vertices)
        self.vertices.append({"id": key, "label": label, **properties})
        return key

    def edge(self, edge_type: str, source: int, target: int, **properties) -> int:
        key = next_id(self.graph.edges) + len(self.edges)
        self.edges.append({"id": key, "src": source, "dst": target, "type": edge_type, **properties})
        return key

    def nexus(self, nexus_type: str, *members: tuple[str, int], **properties) -> int:
        key = next_id(self.graph.nexuses) + len(self.nexuses)
        self.nexuses.append(({"id": key, "type": nexus_type, **properties}, list(members)))
        return key

    def apply(self) -> PropertyGraph:
        g, spark = self.graph, self.graph.vertices.sparkSession

        def frame(rows: list[dict], like: DataFrame) -> DataFrame:
            names = list(dict.fromkeys(k for r in rows for k in r))
            known = {f.name: f.dataType for f in like.schema.fields}
            guess = lambda n: known.get(n) or {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), list: T.ArrayType(T.StringType())}.get(type(next(r[n] for r in rows if r.get(n) is not None)), T.StringType())
            return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], T.StructType([T.StructField(n, guess(n)) for n in names]))

        if self.vertices:
            g = add_vertices(g, frame(self.vertices, g.vertices))
        if self.edges:
            g = add_edges(g, frame(self.edges, g.edges))
        if self.nexuses:
            members = spark.createDataFrame([(r["id"], role, v) for r, ms in self.nexuses for role, v in ms], "nexus_id long, role string, vertex_id long")
            g = add_nexuses(g, frame([r for r, _ in self.nexuses], g.nexuses), members)
        return g


class Versions:
    """Committed states in a folder; readers keep the version they opened.

    A state is written under a name of its own; a marker, renamed into place last, makes it version n and says which
    folder it is in, what batch of a feed it holds and which migrations it has seen. What a crash leaves before the
    marker is never read and stands in nobody's way.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "versions")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where, jvm

    def latest(self) -> int:
        """0 before the first commit."""
        fs, where, jvm = self._fs()
        if not fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return max((int(n.removeprefix("done-")) for n in names if n.startswith("done-")), default=0)

    def about(self, number: int | None = None) -> dict:
        """The marker of a version: folder, batch (-1 for none) and migrations."""
        number = self.latest() if number is None else number
        if not number:
            return {"folder": None, "batch": -1, "migrations": []}
        fs, _, jvm = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/done-{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, g: PropertyGraph) -> str:
        """The state under a fresh name, no version yet."""
        folder = f"state-{uuid.uuid4().hex}"
        write_snapshot(g, f"{self.path}/{folder}")
        return folder

    def commit(self, g: PropertyGraph, **about) -> int:
        """g as the next version; ``about`` replaces parts of what the last version's marker says."""
        number = self.latest() + 1
        marker = {**self.about(number - 1), **about, "folder": self.write(g)}
        fs, _, jvm = self._fs()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        draft = path(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        if fs.exists(path(f"done-{number}")) or not fs.rename(draft, path(f"done-{number}")):
            raise RuntimeError(f"version {number} was committed by another writer")
        return number

    def open(self, number: int | None = None) -> PropertyGraph:
        return read_snapshot(self.spark, f"{self.path}/{self.about(number)['folder']}")


@dataclass
class Migrator:
    """Versioned steps applied in order, each once; the history names what was applied."""

    steps: list[tuple[int, str, Callable[[PropertyGraph], PropertyGraph]]]

    def run(self, g: PropertyGraph, applied: int = 0) -> tuple[PropertyGraph, list[tuple[int, str]]]:
        history = []
        for number, name, step in sorted(self.steps, key=lambda s: s[0]):
            if number > applied:
                g, history = step(g), [*history, (number, name)]
        return g, history

    def apply(self, versions: Versions) -> list[tuple[int, str]]:
        """Runs what the latest version has not seen, commits the result with its history, and says what was run."""
        seen = [tuple(m) for m in versions.about()["migrations"]]
        g, ran = self.run(versions.open(), max((number for number, _ in seen), default=0))
        if ran:
            versions.commit(g, migrations=[*seen, *ran])
        return ran
