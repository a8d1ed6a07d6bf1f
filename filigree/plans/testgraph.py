"""Two graphs over the test tables: the order graph with typed properties, and the domain graph of vertices, edges and
nexuses as they were recorded. Each has the SQL of its tables beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.graph import PropertyGraph, pack_id, union_labels
from filigree.sources.bulk import wide_properties

#: Label codes of the order graph's ids.
CODES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_graph(spark: SparkSession, d: str) -> PropertyGraph:
    t = lambda name: read(spark, d, name)
    at = lambda label, key: pack_id(CODES[label], key)
    vertices = union_labels({
        "Region": t("region").select(at("Region", "r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "Nation": t("nation").select(at("Nation", "n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "Customer": t("customer").select(at("Customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")),
        "Supplier": t("supplier").select(at("Supplier", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")),
        "Part": t("part").select(at("Part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")),
        "Order": t("orders").select(at("Order", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")),
    })
    edge = lambda df, kind, src, dst, *props: df.select(F.xxhash64(F.lit(kind), *df.columns).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), *props)
    line = t("lineitem")
    edges = edge(t("nation"), "IN_REGION", at("Nation", "n_nationkey"), at("Region", "n_regionkey"))
    for part in (
        edge(t("customer"), "CUST_IN_NATION", at("Customer", "c_custkey"), at("Nation", "c_nationkey")),
        edge(t("supplier"), "SUPP_IN_NATION", at("Supplier", "s_suppkey"), at("Nation", "s_nationkey")),
        edge(t("orders"), "PLACED", at("Customer", "o_custkey"), at("Order", "o_orderkey")),
        edge(line, "HAS_PART", at("Order", "l_orderkey"), at("Part", "l_partkey"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")),
        edge(line, "FROM_SUPPLIER", at("Order", "l_orderkey"), at("Supplier", "l_suppkey"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")),
    ):
        edges = edges.unionByName(part, allowMissingColumns=True)
    return PropertyGraph.of(vertices, edges)


_ID = lambda label, key: f"({CODES[label]} * 1099511627776 + {key})"

ORDER_SQL = f"""
v as (
  select {_ID('Region', 'r_regionkey')} as id, 'Region' as label, r_name as name, null::double as acctbal, null::varchar as segment, null::varchar as brand, null::int as size, null::double as price, null::varchar as status, null::varchar as priority from region
  union all select {_ID('Nation', 'n_nationkey')}, 'Nation', n_name, null, null, null, null, null, null, null from nation
  union all select {_ID('Customer', 'c_custkey')}, 'Customer', c_name, c_acctbal, c_mktsegment, null, null, null, null, null from customer
  union all select {_ID('Supplier', 's_suppkey')}, 'Supplier', s_name, s_acctbal, null, null, null, null, null, null from supplier
  union all select {_ID('Part', 'p_partkey')}, 'Part', p_name, null, null, p_brand, p_size, p_retailprice, null, null from part
  union all select {_ID('Order', 'o_orderkey')}, 'Order', null, null, null, null, null, o_totalprice, o_orderstatus, o_orderpriority from orders
),
e as (
  select {_ID('Nation', 'n_nationkey')} as src, {_ID('Region', 'n_regionkey')} as dst, 'IN_REGION' as type, null::double as quantity from nation
  union all select {_ID('Customer', 'c_custkey')}, {_ID('Nation', 'c_nationkey')}, 'CUST_IN_NATION', null from customer
  union all select {_ID('Supplier', 's_suppkey')}, {_ID('Nation', 's_nationkey')}, 'SUPP_IN_NATION', null from supplier
  union all select {_ID('Customer', 'o_custkey')}, {_ID('Order', 'o_orderkey')}, 'PLACED', null from orders
  union all select {_ID('Order', 'l_orderkey')}, {_ID('Part', 'l_partkey')}, 'HAS_PART', l_quantity from lineitem
  union all select {_ID('Order', 'l_orderkey')}, {_ID('Supplier', 'l_suppkey')}, 'FROM_SUPPLIER', l_quantity from lineitem
)"""


def domain_graph(spark: SparkSession, d: str, properties: bool = False) -> PropertyGraph:
    """Exact repeats count once; of a vertex that came back the rows are one vertex; edges and members without an end are
    left out. ``properties`` adds the Set property tags and the Single ones size and weight."""
    v, e, n = (read(spark, d, f"graph_{x}") for x in ("vertices", "edges", "nexuses"))
    topics = read(spark, d, "topic_vertices").select(F.col("vertex_id").alias("id"), F.col("vertex_label").alias("label"))
    if properties:
        wide = wide_properties(v, "vertex_id", "properties", {"tags": "array<string>", "size": "bigint", "weight": "double"})
        last = F.max(F.struct("arrived_at", F.col("vertex_label").alias("label"), "tags", "size", "weight")).alias("m")
        vertices = wide.groupBy(F.col("vertex_id").alias("id")).agg(last).select("id", "m.label", "m.tags", "m.size", "m.weight").unionByName(topics, allowMissingColumns=True)
    else:
        vertices = v.groupBy(F.col("vertex_id").alias("id")).agg(F.max("vertex_label").alias("label")).unionByName(topics)
    edges = e.filter("source_vertex_id is not null and target_vertex_id is not null").select(F.col("edge_id").alias("id"), F.col("source_vertex_id").alias("src"), F.col("target_vertex_id").alias("dst"), F.col("edge_type").alias("type")).distinct()
    nexuses = n.select(F.col("nexus_id").alias("id"), F.col("nexus_type").alias("type")).distinct()
    members = n.select("nexus_id", F.explode("members").alias("m")).select("nexus_id", F.col("m.role_name").alias("role"), F.col("m.vertex_id").alias("vertex_id")).filter("vertex_id is not null").distinct()
    return PropertyGraph(vertices, edges, nexuses, members)


DOMAIN_SQL = """
v as (select vertex_id as id, max(vertex_label) as label from graph_vertices group by 1 union all select vertex_id, vertex_label from topic_vertices),
e as (select distinct edge_id as id, source_vertex_id as src, target_vertex_id as dst, edge_type as type from graph_edges where source_vertex_id is not null and target_vertex_id is not null),
n as (select distinct nexus_id as id, nexus_type as type from graph_nexuses),
i as (select distinct nexus_id, m.role_name as role, m.vertex_id as vertex_id from (select nexus_id, unnest(members) as m from graph_nexuses) where m.vertex_id is not null)"""

PROPERTY_SQL = """
w as (select vertex_id, arrived_at, vertex_label, list_distinct(list_transform(list_filter(properties, lambda p: p.prop_key = 'tags' and p.prop_value is not null), lambda p: p.prop_value)) as tags from graph_vertices),
t as (select vertex_id as id, vertex_label as label, tags from (select *, row_number() over (partition by vertex_id order by arrived_at desc) as k from w) where k = 1)"""
