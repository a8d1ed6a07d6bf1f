"""Bulk loading: append files of vertices, edges and properties to a graph without a driver in the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.graph import PropertyGraph


def load(spark: SparkSession, vertices: str, edges: str, nexuses: str | None = None, incidence: str | None = None, fmt: str = "parquet", **options: str) -> PropertyGraph:
    """A graph over files of any Spark format with the columns of the model; further columns are properties."""
    read = lambda path: spark.read.format(fmt).options(**options).load(path)
    return PropertyGraph.of(read(vertices), read(edges), read(nexuses) if nexuses else None, read(incidence) if incidence else None)


def write_adjacency(edges: DataFrame, path: str, files: int, by: str = "src") -> None:
    """Edges split by ranges of one end and sorted inside, so that a lookup or a join by range reads few row groups."""
    edges.repartitionByRange(files, by).sortWithinPartitions(by).write.parquet(path)


def bucketed(edges: DataFrame, table: str, buckets: int, by: str = "src") -> None:
    """Edges as a table bucketed and sorted by one end: joins on it need no shuffle of the edges."""
    edges.write.bucketBy(buckets, by).sortBy(by).mode("overwrite").saveAsTable(table)


def wide_properties(df: DataFrame, owner: str, properties: str, keys: dict[str, str]) -> DataFrame:
    """Property lists (prop_key, cardinality, value_type, prop_value) as columns, in the JVM and without a shuffle.

    keys maps a key to its type; ``array<...>`` makes a Set of distinct values, all others take the first value.
    """
    named = lambda key: lambda p: p["prop_key"] == key
    typed = lambda kind: lambda v: v.cast(kind)
    out = []
    for key, kind in keys.items():
        values = F.transform(F.filter(properties, named(key)), lambda p: p["prop_value"])
        if kind.startswith("array<"):
            cast = F.filter(F.array_distinct(F.transform(values, typed(kind[6:-1]))), lambda v: v.isNotNull())
            out.append(F.when(F.size(cast) > 0, cast).alias(key))
        else:
            out.append(F.get(values, 0).cast(kind).alias(key))
    return df.select("*", *out).drop(properties)
