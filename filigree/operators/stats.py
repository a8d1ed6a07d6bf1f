"""Graph statistics, cardinality estimates and consistency checks, each a few grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.graph import PropertyGraph

# Upper bounds of the degree histogram's buckets; the last bucket is open.
BUCKETS = (0, 1, 3, 7, 15, 31, 63, 127, 255)
POWER_DEGREE = 256


def label_counts(g: PropertyGraph) -> DataFrame:
    return g.vertices.groupBy("label").agg(F.count("*").alias("n"))


def edge_type_counts(g: PropertyGraph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count("*").alias("n"))


def nexus_type_counts(g: PropertyGraph) -> DataFrame:
    return g.nexuses.groupBy("type").agg(F.count("*").alias("n"))


def arity_histogram(g: PropertyGraph) -> DataFrame:
    """(arity, n): how many nexuses have how many members, those without any included."""
    arity = g.incidence.groupBy("nexus_id").agg(F.count("*").alias("arity"))
    every = g.nexuses.select(F.col("id").alias("nexus_id")).join(arity, "nexus_id", "left")
    return every.groupBy(F.coalesce("arity", F.lit(0)).alias("arity")).agg(F.count("*").alias("n"))


def degrees(g: PropertyGraph, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """(id, degree) of every vertex; a self-loop counts once. Counted map-side, so a hub is no hot task."""
    e = g.edges if edge_type is None else g.edges.filter(F.col("type") == edge_type)
    out, into = e.select(F.col("src").alias("id")), (e.filter("src <> dst") if direction == "both" else e).select(F.col("dst").alias("id"))
    ends = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return g.vertices.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def bucket(degree: Column) -> Column:
    """The upper bound of a degree's bucket, null for the open one."""
    return F.coalesce(*(F.when(degree <= b, F.lit(b)) for b in BUCKETS))


def degree_histogram(g: PropertyGraph, direction: str = "both", edge_type: str | None = None, by_label: bool = False) -> DataFrame:
    d = degrees(g, direction, edge_type).withColumn("bucket", bucket(F.col("degree")))
    d = d.join(g.vertices.select("id", "label"), "id") if by_label else d
    return d.groupBy(*(["label"] if by_label else []), "bucket").agg(F.count("*").alias("n"))


def power_vertices(g: PropertyGraph, above: int = POWER_DEGREE) -> DataFrame:
    return degrees(g).filter(F.col("degree") > above)


def property_stats(g: PropertyGraph, kind: str = "vertex", exact: bool = False) -> DataFrame:
    """(key, values, owners, lowest, highest, distinct_values) of each property, in one scan; the values of a Set each count."""
    table = g.table(kind)
    parts = []
    for key in g.property_keys(kind):
        dtype = table.schema[key].dataType
        many = isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, (T.FloatType, T.DoubleType))
        col = F.col(key)
        if isinstance(dtype, T.ArrayType) and not many:
            text = F.lit(None).cast("string")
        else:
            text = None if many else col.cast("string")
        low, high = (F.min(F.array_min(col)), F.max(F.array_max(col))) if many else (F.min(col), F.max(col)) if text is None or not isinstance(dtype, T.ArrayType) else (F.lit(None), F.lit(None))
        count = F.sum(F.size(col)) if many else F.count(col)
        distinct = (F.countDistinct(col) if exact else F.approx_count_distinct(col)) if not isinstance(dtype, T.ArrayType) else F.lit(None).cast("long")
        parts.append(F.struct(F.lit(key).alias("key"), F.coalesce(count, F.lit(0)).cast("long").alias("values"), F.count(col).alias("owners"), low.cast("string").alias("lowest"), high.cast("string").alias("highest"), distinct.alias("distinct_values")))
    if not parts:
        return table.sparkSession.createDataFrame([], "key string, values long, owners long, lowest string, highest string, distinct_values long")
    row = table.agg(*(p.alias(f"p{i}") for i, p in enumerate(parts)))
    return row.select(F.explode(F.array(*(F.col(f"p{i}") for i in range(len(parts))))).alias("s")).select("s.*")


def estimate_fanout(g: PropertyGraph, edge_type: str | None = None) -> float:
    """Edges of the type per vertex, for the order of hops."""
    e = g.edges if edge_type is None else g.edges.filter(F.col("type") == edge_type)
    n = g.vertices.count()
    return e.count() / n if n else 0.0


def order_hops(g: PropertyGraph, types: list[str]) -> list[str]:
    """Edge types by rising fan-out."""
    counts = {r.type: r.n for r in edge_type_counts(g).collect()}
    return sorted(types, key=lambda t: (counts.get(t, 0), t))


def dangling_edges(g: PropertyGraph) -> DataFrame:
    """(id, side, vertex): ends of edges that are no vertices."""
    ids = g.vertices.select(F.col("id").alias("vertex")).distinct()
    ends = g.edges.select("id", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("vertex")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("vertex")))).alias("e"))
    return ends.select("id", "e.side", "e.vertex").filter("vertex is not null").join(ids, "vertex", "left_anti").select("id", "side", "vertex")


def dangling_members(g: PropertyGraph) -> DataFrame:
    return g.incidence.filter("vertex_id is not null").join(g.vertices.select(F.col("id").alias("vertex_id")).distinct(), "vertex_id", "left_anti").select("nexus_id", "role", "vertex_id")


def orphan_index_entries(index_ids: DataFrame, g: PropertyGraph) -> DataFrame:
    """Ids an index (id) still holds though no vertex has them."""
    return index_ids.select("id").distinct().join(g.vertices.select("id"), "id", "left_anti")


def consistency(g: PropertyGraph) -> dict[str, int]:
    """Counts of what breaks the model: repeated ids, dangling ends and members, small nexuses."""
    repeated = lambda df: df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").count()
    arity = g.incidence.groupBy("nexus_id").agg(F.count("*").alias("n")).filter("n < 2")
    return {
        "repeated_vertices": repeated(g.vertices), "repeated_edges": repeated(g.edges), "dangling_edges": dangling_edges(g).count(),
        "dangling_members": dangling_members(g).count(), "small_nexuses": arity.count(),
    }


def collect(g: PropertyGraph) -> DataFrame:
    """(statistic, name, n): cardinalities by label and type, arities and the degree histogram in one frame."""
    parts = [
        label_counts(g).select(F.lit("label").alias("statistic"), F.col("label").alias("name"), "n"),
        edge_type_counts(g).select(F.lit("edge_type").alias("statistic"), F.col("type").alias("name"), "n"),
        nexus_type_counts(g).select(F.lit("nexus_type").alias("statistic"), F.col("type").alias("name"), "n"),
        arity_histogram(g).select(F.lit("arity").alias("statistic"), F.col("arity").cast("string").alias("name"), "n"),
        degree_histogram(g).select(F.lit("degree").alias("statistic"), F.coalesce(F.col("bucket").cast("string"), F.lit("more")).alias("name"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)
