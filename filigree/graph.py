"""The property graph as DataFrames.

vertices(id, label, properties...), edges(id, src, dst, type, properties...), nexuses(id, type, properties...) and
incidence(nexus_id, role, vertex_id). Properties are wide nullable columns: a Single property is a scalar, a Set
property an array. A handle is immutable; every change gives a new one over new plans, so an old handle is a snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEXUS_SCHEMA, INCIDENCE_SCHEMA = "id long, type string", "nexus_id long, role string, vertex_id long"
TABLES = ("vertices", "edges", "nexuses", "incidence")


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    nexuses: DataFrame
    incidence: DataFrame

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, nexuses: DataFrame | None = None, incidence: DataFrame | None = None) -> PropertyGraph:
        spark = vertices.sparkSession
        return PropertyGraph(vertices, edges, spark.createDataFrame([], NEXUS_SCHEMA) if nexuses is None else nexuses, spark.createDataFrame([], INCIDENCE_SCHEMA) if incidence is None else incidence)

    def table(self, kind: str) -> DataFrame:
        return {"vertex": self.vertices, "edge": self.edges, "nexus": self.nexuses}[kind]

    def with_tables(self, **tables: DataFrame) -> PropertyGraph:
        return replace(self, **tables)

    def query(self):
        from filigree.operators.traversal import Source

        return Source(self)

    def property_keys(self, kind: str = "vertex") -> list[str]:
        fixed = {"vertex": {"id", "label"}, "edge": {"id", "src", "dst", "type"}, "nexus": {"id", "type"}}[kind]
        return [c for c in self.table(kind).columns if c not in fixed]

    def relabel(self, old: str, new: str) -> PropertyGraph:
        """Every vertex of one label gets another; ids and references stay."""
        return self.with_tables(vertices=self.vertices.withColumn("label", F.when(F.col("label") == old, new).otherwise(F.col("label"))))

    def rename_key(self, kind: str, old: str, new: str) -> PropertyGraph:
        name = {"vertex": "vertices", "edge": "edges", "nexus": "nexuses"}[kind]
        return self.with_tables(**{name: self.table(kind).withColumnRenamed(old, new)})

    def neighbors(self, vertex: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
        """(edge_id, neighbor) of one vertex. A self-loop counts once in each direction and once in both."""
        e = self.edges if edge_type is None else self.edges.filter(F.col("type") == edge_type)
        out = e.filter(F.col("src") == vertex).select(F.col("id").alias("edge_id"), F.col("dst").alias("neighbor"))
        into = e.filter(F.col("dst") == vertex)
        if direction == "out":
            return out
        if direction == "both":
            into = into.filter("src <> dst")
        into = into.select(F.col("id").alias("edge_id"), F.col("src").alias("neighbor"))
        return into if direction == "in" else out.unionByName(into)

    def nexuses_of(self, vertex: int, nexus_type: str | None = None, role: str | None = None) -> DataFrame:
        """(nexus_id), each nexus once, however many roles the vertex has in it."""
        i = self.incidence.filter(F.col("vertex_id") == vertex)
        i = i if role is None else i.filter(F.col("role") == role)
        ids = i.select("nexus_id").distinct()
        return ids if nexus_type is None else ids.join(self.nexuses.filter(F.col("type") == nexus_type).select(F.col("id").alias("nexus_id")), "nexus_id", "left_semi")

    def members_of(self, nexus: int, role: str | None = None) -> DataFrame:
        i = self.incidence.filter(F.col("nexus_id") == nexus)
        return (i if role is None else i.filter(F.col("role") == role)).select("role", "vertex_id")


def union_labels(frames: dict[str, DataFrame]) -> DataFrame:
    """Vertices of several labels, each frame with its own columns; a filter on the label prunes the others."""
    parts = [df.withColumn("label", F.lit(label)) for label, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pack_id(code: int, key) -> F.Column:
    """A vertex id unique across labels: the label's code above 40 bits of the natural key."""
    return F.lit(code << 40).cast("long") + F.col(key).cast("long") if isinstance(key, str) else F.lit(code << 40).cast("long") + key


def induced(g: PropertyGraph, vertices: DataFrame | None = None, edges: DataFrame | None = None, nexuses: DataFrame | None = None) -> PropertyGraph:
    """The subgraph of chosen vertices (id), the ends of chosen edges (id) and the members of chosen nexuses (id).

    Edges with both ends inside stay, and nexuses all of whose members are inside; a nexus without members stays out.
    """
    picked = []
    if vertices is not None:
        picked.append(vertices.select("id"))
    if edges is not None:
        chosen = g.edges.join(edges.select("id"), "id", "left_semi")
        picked += [chosen.select(F.col("src").alias("id")), chosen.select(F.col("dst").alias("id"))]
    if nexuses is not None:
        picked.append(g.incidence.join(nexuses.select(F.col("id").alias("nexus_id")), "nexus_id", "left_semi").select(F.col("vertex_id").alias("id")))
    inside = reduce(DataFrame.unionByName, picked).distinct()
    e = g.edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
    marked = g.incidence.join(inside.select(F.col("id").alias("vertex_id"), F.lit(1).alias("there")), "vertex_id", "left")
    whole = marked.groupBy("nexus_id").agg(F.count("*").alias("n"), F.count("there").alias("m")).filter("n = m").select("nexus_id")
    return PropertyGraph(
        g.vertices.join(inside, "id", "left_semi"), e.select(*g.edges.columns),
        g.nexuses.join(whole.withColumnRenamed("nexus_id", "id"), "id", "left_semi"), g.incidence.join(whole, "nexus_id", "left_semi"),
    )


def write_snapshot(g: PropertyGraph, path: str) -> None:
    """A consistent copy: edges lie sorted by source within files, so that row groups prune by vertex."""
    for name in TABLES:
        df = getattr(g, name)
        df = df.sortWithinPartitions("src") if name == "edges" else df.sortWithinPartitions("nexus_id") if name == "incidence" else df
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))
