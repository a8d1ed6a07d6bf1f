"""Queries of the shredding and reference operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import references as R
from filigree.operators.shred import graph_entities, list_items


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return list_items(_read(spark, d, "graph_exports"))


def p3_vertices(spark: SparkSession, d: str) -> DataFrame:
    once = _read(spark, d, "graph_exports").dropDuplicates(["export_id"])
    return graph_entities(once)["vertices"].select("export_id", F.col("item_pos"), F.col("id").alias("vertex_id"), F.col("label").alias("vertex_label"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    edges = R.references(_read(spark, d, "graph_edges"), "graph_edges", "edge_id", "created_at", {"source": "source_vertex_id", "target": "target_vertex_id"})
    nexuses = R.member_references(_read(spark, d, "graph_nexuses"), "graph_nexuses", "nexus_id", "created_at", "members", "role_name", "vertex_id")
    return edges.unionByName(nexuses)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "graph_vertices").select(F.col("vertex_id").alias("key"), F.col("arrived_at").alias("present_from"), F.col("deleted_at").alias("present_until"))
    topics = _read(spark, d, "topic_vertices").select(F.col("vertex_id").alias("key"), F.col("arrived_at").alias("present_from"), F.lit(None).cast(own.schema["present_until"].dataType).alias("present_until"))
    return own.unionByName(topics)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lost = R.orphans(_refs(spark, d), _parents(spark, d))
    return lost.select("ref_table", "owner_id", "ref_field", F.col("key").alias("vertex_id"), R.month(F.col("at")).alias("ref_month")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d).distinct()
    return R.orphan_report(refs, _parents(spark, d))


_REFS_SQL = """
refs as (
  select distinct * from (
    select 'graph_edges' as ref_table, edge_id as owner_id, 'source' as ref_field, source_vertex_id as k, created_at as t from graph_edges
    union all select 'graph_edges', edge_id, 'target', target_vertex_id, created_at from graph_edges
    union all select 'graph_nexuses', nexus_id, m.role_name, m.vertex_id, created_at
      from (select nexus_id, created_at, unnest(members) as m from graph_nexuses)
  ) where k is not null
),
parents as (
  select vertex_id as k, arrived_at as f, deleted_at as u from graph_vertices where arrived_at is not null
  union all select vertex_id, arrived_at, null from topic_vertices where arrived_at is not null
),
lost as (
  select * from refs r where not exists (select 1 from parents p where p.k = r.k and p.f <= r.t and (p.u is null or p.u > r.t))
)"""

_ITEMS_SQL = """
with docs as (select distinct export_id, payload from graph_exports where json_valid(payload)),
owners as (
  select export_id, 'vertex' as owner_kind, unnest(json_extract(case json_type(payload, '$.vertices') when 'ARRAY' then json_extract(payload, '$.vertices') else json_array(json_extract(payload, '$.vertices')) end, '$[*]')) as o
  from docs where json_type(payload, '$.vertices') in ('ARRAY', 'OBJECT')
  union all
  select export_id, 'nexus', unnest(json_extract(case json_type(payload, '$.nexuses') when 'ARRAY' then json_extract(payload, '$.nexuses') else json_array(json_extract(payload, '$.nexuses')) end, '$[*]'))
  from docs where json_type(payload, '$.nexuses') in ('ARRAY', 'OBJECT')
),
lists as (
  select export_id, owner_kind, try_cast(json_extract_string(o, '$.id') as bigint) as owner_id, 'properties' as child_list, json_extract(o, '$.properties') as l from owners
  union all
  select export_id, owner_kind, try_cast(json_extract_string(o, '$.id') as bigint), 'members', json_extract(o, '$.members') from owners where owner_kind = 'nexus'
),
items as (
  select export_id, owner_kind, owner_id, child_list, unnest(xs) as x, generate_subscripts(xs, 1) - 1 as item_pos
  from (select *, json_extract(case json_type(l) when 'ARRAY' then l else json_array(l) end, '$[*]') as xs from lists where json_type(l) in ('ARRAY', 'OBJECT'))
)
select export_id, owner_kind, owner_id, child_list, cast(item_pos as bigint) as item_pos,
  coalesce(json_extract_string(x, '$.role'), json_extract_string(x, '$.key')) as item_name,
  case when child_list = 'members' then try_cast(coalesce(json_extract_string(x, '$.vertex'), json_extract_string(x, '$.vertexId')) as bigint) else -1 end as vertex_id
from items"""

QUERIES = {"p3_found": p3_found, "p3_vertices": p3_vertices, "p4_found": p4_found, "p4_report": p4_report}

ORACLE = {
    "p3_found": _ITEMS_SQL,
    "p3_vertices": """
with docs as (select distinct export_id, payload from graph_exports where json_valid(payload)),
xs as (select export_id, json_extract(case json_type(payload, '$.vertices') when 'ARRAY' then json_extract(payload, '$.vertices') else json_array(json_extract(payload, '$.vertices')) end, '$[*]') as xs
  from docs where json_type(payload, '$.vertices') in ('ARRAY', 'OBJECT')),
o as (select export_id, unnest(xs) as x, generate_subscripts(xs, 1) - 1 as item_pos from xs)
select export_id, cast(item_pos as bigint) as item_pos, try_cast(json_extract_string(x, '$.id') as bigint) as vertex_id, json_extract_string(x, '$.label') as vertex_label from o""",
    "p4_found": f"with {_REFS_SQL} select distinct ref_table, owner_id, ref_field, k as vertex_id, strftime(t, '%Y-%m') as ref_month from lost",
    "p4_report": f"""with {_REFS_SQL},
l as (select ref_table, ref_field, strftime(t, '%Y-%m') as ref_month, count(*) as orphans, count(distinct k) as orphan_keys,
  count(*) filter (k not in (select vertex_id from graph_vertices union select vertex_id from topic_vertices)) as never_existed from lost group by all),
s as (select ref_table, ref_field, strftime(t, '%Y-%m') as ref_month, count(*) as refs from refs group by all)
select s.ref_table, s.ref_field, s.ref_month, s.refs, coalesce(orphans, 0) as orphans, coalesce(orphan_keys, 0) as orphan_keys, coalesce(never_existed, 0) as never_existed
from s left join l using (ref_table, ref_field, ref_month)""",
}
