"""The change feed: logical mutations as rows, replayed into a versioned graph by Structured Streaming.

A mutation is (seq, op, kind, id, src, dst, label, key, value, members). Each micro-batch is applied as a whole and
committed as a new version that holds the batch's number; Spark numbers batches by the stream's checkpoint, so a batch
that was committed before a failure is recognized after a restart and not repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.graph import PropertyGraph
from filigree.operators import mutations as M

SCHEMA = "seq long, op string, kind string, id long, src long, dst long, label string, key string, value string, members array<struct<role:string,vertex_id:long>>"
OPS = ("create", "delete", "set", "remove")


def apply_batch(g: PropertyGraph, batch: DataFrame) -> PropertyGraph:
    """The graph after a batch: of several mutations of one entity or one of its keys the last by seq counts, and a
    deletion takes all that came before it; deleting a vertex takes its edges and nexuses."""
    for kind in ("vertex", "edge", "nexus"):
        rows = batch.filter(F.col("kind") == kind)
        last = Window.partitionBy("id").orderBy(F.desc("seq"))
        states = rows.filter(F.col("op").isin("create", "delete")).withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        born = states.filter("op = 'create'")
        touched = states.select("id")
        if kind == "vertex":
            dead = states.filter("op = 'delete'").select("id")
            g = M.delete_vertices(g, dead)
            known = g.vertices.join(touched, "id", "left_anti")
            g = g.with_tables(vertices=known.unionByName(born.select("id", "label"), allowMissingColumns=True))
        elif kind == "edge":
            known = g.edges.join(touched, "id", "left_anti")
            g = g.with_tables(edges=known.unionByName(born.select("id", "src", "dst", F.col("label").alias("type")), allowMissingColumns=True))
        else:
            g = M.delete_nexuses(g, touched)
            members = born.select(F.col("id").alias("nexus_id"), F.explode("members").alias("m")).select("nexus_id", "m.role", "m.vertex_id")
            g = g.with_tables(nexuses=g.nexuses.unionByName(born.select("id", F.col("label").alias("type")), allowMissingColumns=True), incidence=g.incidence.unionByName(members))
        changes = rows.filter(F.col("op").isin("set", "remove"))
        alive = changes.join(states.select("id", F.col("seq").alias("_s")), "id", "left").filter("_s is null or seq > _s")
        newest = Window.partitionBy("id", "key").orderBy(F.desc("seq"))
        final = alive.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").withColumn("value", F.when(F.col("op") == "set", F.col("value")))
        # Keys are the schema's, a short list.
        for r in final.select("key").distinct().collect():
            table = g.table(kind)
            dtype = table.schema[r.key].dataType if r.key in table.columns else None
            mine = final.filter(F.col("key") == r.key).select("id", F.col("value").cast(dtype) if dtype is not None else F.col("value"))
            g = M._put(g, kind, M._changed(table, r.key, mine, lambda old, new: new))
    return g


def replay(spark: SparkSession, feed: DataFrame, versions: M.Versions, checkpoint_dir: str, trigger: dict | None = None):
    """A streaming query that applies each micro-batch of a feed to the latest version and commits the next one."""

    def commit(batch: DataFrame, number: int) -> None:
        if versions.about()["batch"] < number:
            versions.commit(apply_batch(versions.open(), batch), batch=number)

    return feed.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()
