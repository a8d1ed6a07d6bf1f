"""Queries of the traversal, pattern, path and mutation operators over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.predicates import P
from filigree.graph import PropertyGraph, induced
from filigree.operators import annotations, directed_nexus, mutations, paths, stats
from filigree.operators.match import EdgePattern, NexusPattern, VertexPattern, triangle_join, triangles
from filigree.operators.tools import schema
from filigree.operators.traversal import Source
from filigree.plans.testgraph import CODES, DOMAIN_SQL, ORDER_SQL, PROPERTY_SQL, domain_graph, order_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _order(name: str, sql: str | None = None):
    return _register(name, sql and f"with recursive {ORDER_SQL}\n{sql}", order_graph)


def _domain(name: str, sql: str | None = None):
    return _register(name, sql and f"with recursive {DOMAIN_SQL}\n{sql}", domain_graph)


def _register(name: str, sql: str | None, graph):
    def note(f: Callable[[PropertyGraph, Source], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            g = graph(spark, d)
            return f(g, g.query())

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return note


def _id(label: str, key: int) -> int:
    return (CODES[label] << 40) + key


# -- scans and seeds ------------------------------------------------------------------------------------------

_order("s1_all_vertices", "select id from v")(lambda g, q: q.vertices().ids())
_order("s2_label_scan", "select id from v where label = 'Supplier'")(lambda g, q: q.vertices().has_label("Supplier").ids())
_order("s2_two_labels", "select id from v where false")(lambda g, q: q.vertices().has_label("Supplier").has_label("Part").ids())
_domain("s3_all_edges", "select id from e")(lambda g, q: q.edges().ids())
_domain("s4_nexus_scan", "select id from n where type = 'Fact'")(lambda g, q: q.nexuses("Fact").ids())
_order("s5_seek", "select id from v where label = 'Customer' and segment = 'BUILDING'")(lambda g, q: q.seek("segment", "BUILDING", label="Customer").ids())
_order("s6_range", "select id from v where acctbal > 100.0 and acctbal <= 900.0")(lambda g, q: q.seek_range("acctbal", 100.0, 900.0, low_inclusive=False, high_inclusive=True).ids())
_order("s6_string_range", "select id from v where name >= 'NATION_2' and name < 'NATION_5'")(lambda g, q: q.seek_range("name", "NATION_2", "NATION_5").ids())
_order("s7_seeds", f"select id from (values ({_id('Nation', 3)}), ({_id('Nation', 1)}), ({_id('Nation', 3)})) s(id)")(lambda g, q: q.vertices([_id("Nation", 3), _id("Nation", 1), _id("Nation", 3), 5]).ids())
_order("s13_edge_range", "select type, count(*) as n from e where quantity >= 10 and quantity < 12 group by type")(lambda g, q: q.seek_range("quantity", 10.0, 12.0, kind="edge").to_df().groupBy("type").agg(F.count("*").alias("n")))
_order("s14_neighbors", f"select dst as neighbor from e where src = {_id('Nation', 7)} union all select src from e where dst = {_id('Nation', 7)} and src <> dst")(lambda g, q: g.neighbors(_id("Nation", 7), "both").select("neighbor"))
_domain("s15_nexuses_of", "select distinct nexus_id from i join n on n.id = nexus_id where vertex_id = 17592186044417 and type = 'Fact'")(lambda g, q: g.nexuses_of(17592186044417, "Fact"))

# -- predicates -----------------------------------------------------------------------------------------------

_PREDICATES: dict[str, tuple[str, P, str]] = {
    "f4_has_int": ("size", P.eq(7), "size = 7"),
    "f4_int_on_double": ("acctbal", P.eq(7), "false"),
    "f5_eq_string": ("segment", P.eq("MACHINERY"), "segment = 'MACHINERY'"),
    "f6_gt": ("acctbal", P.gt(5000.0), "acctbal > 5000"),
    "f6_gte_int": ("size", P.gte(40), "size >= 40"),
    "f6_lt_widened": ("size", P.lt(7.5), "size < 7.5"),
    "f6_lte": ("price", P.lte(1000.0), "price <= 1000"),
    "f7_between": ("size", P.between(10, 20), "size >= 10 and size < 20"),
    "f8_within": ("brand", P.within(["Brand#4", "Brand#7"]), "brand in ('Brand#4', 'Brand#7')"),
    "f8_without": ("segment", P.without(["BUILDING", "FURNITURE"]), "segment is null or segment not in ('BUILDING', 'FURNITURE')"),
    "f9_starts_with": ("priority", P.starts_with("1-"), "starts_with(priority, '1-')"),
    "f9_ends_with": ("priority", P.ends_with("LOW"), "ends_with(priority, 'LOW')"),
    "f9_contains": ("name", P.contains("_1"), "contains(name, '_1')"),
    "f10_regex": ("brand", P.regex("#(1|2)[0-9]$"), "regexp_matches(brand, '#(1|2)[0-9]$')"),
    "f11_not": ("size", ~P.gt(10), "size is null or not size > 10"),
    "f11_and_or": ("size", (P.gt(5) & P.lt(9)) | P.eq(30), "(size > 5 and size < 9) or size = 30"),
    "f11_not_and": ("size", ~(P.gt(5) & P.lt(9)), "size is null or not (size > 5 and size < 9)"),
    "f12_has": ("acctbal", P.present(), "acctbal is not null"),
    "f12_has_not": ("acctbal", P.missing(), "acctbal is null"),
}
for _name, (_key, _p, _sql) in _PREDICATES.items():
    _order(_name, f"select id from v where {_sql}")(lambda g, q, key=_key, p=_p: q.vertices().has(key, p).ids())


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    g = domain_graph(spark, d, properties=True)
    return g.query().vertices().has("tags", P.contains("ra")).ids()


def _untagged(spark: SparkSession, d: str) -> DataFrame:
    g = domain_graph(spark, d, properties=True)
    return g.query().vertices().has("tags", ~P.starts_with("que")).ids()


QUERIES |= {"f14_set_any": _tagged, "f14_set_none": _untagged}
ORACLE["f14_set_any"] = f"with {PROPERTY_SQL} select id from t where len(list_filter(tags, lambda x: contains(x, 'ra'))) > 0"
ORACLE["f14_set_none"] = f"with {PROPERTY_SQL} select id from t where coalesce(len(list_filter(tags, lambda x: starts_with(x, 'que'))), 0) = 0 union all select vertex_id from topic_vertices"
_order("f15_out_where", "select dst as id from e where type = 'HAS_PART' and quantity > 45")(lambda g, q: q.vertices().has_label("Order").out_where("HAS_PART", "quantity", P.gt(45.0)).ids())
_order("f16_is", "select id from v where brand = 'Brand#11'")(lambda g, q: q.vertices().value("brand").is_("Brand#11").ids())
_order("f17_edge_predicate", "select type, count(*) as n from e where quantity is null or quantity < 3 group by type")(lambda g, q: q.edges().has("quantity", ~P.gte(3.0)).to_df().groupBy("type").agg(F.count("*").alias("n")))

# -- sub-traversals -------------------------------------------------------------------------------------------

_order("j1_where", "select id from v where label = 'Customer' and exists (select 1 from e join v o on o.id = e.dst where e.src = v.id and e.type = 'PLACED' and o.status = 'F')")(lambda g, q: q.vertices().has_label("Customer").where(lambda s: s.out("PLACED").has("status", "F")).ids())
_domain("j2_not", "select id from v where label in ('Document', 'Chunk') and not exists (select 1 from e where src = v.id and type = 'CITES')")(lambda g, q: q.vertices().filter(F.col("label").isin("Document", "Chunk")).not_(lambda s: s.out("CITES")).ids())
_domain("j3_and", "select id from v where exists (select 1 from e where src = v.id and type = 'CITES') and exists (select 1 from e where dst = v.id and type = 'MENTIONS')")(lambda g, q: q.vertices().and_(lambda s: s.out("CITES"), lambda s: s.in_("MENTIONS")).ids())
_domain("j4_or", "select id from v where exists (select 1 from e where src = v.id and type = 'OWNED_BY') or exists (select 1 from e where dst = v.id and type = 'CITES')")(lambda g, q: q.vertices().or_(lambda s: s.out("OWNED_BY"), lambda s: s.in_("CITES")).ids())

# -- expansion ------------------------------------------------------------------------------------------------

_order("e1_out", "select e.dst as id, count(*) as n from e join v on v.id = e.src where e.type = 'HAS_PART' and v.status = 'O' group by 1")(lambda g, q: q.vertices().has("status", "O").out("HAS_PART").ids().groupBy("id").agg(F.count("*").alias("n")))
_order("e1_in", "select e.src as id from e join v on v.id = e.dst where v.name = 'NATION_3'")(lambda g, q: q.vertices().has("name", "NATION_3").in_().ids())
_domain("e1_both", "select x as id, count(*) as n from (select dst as x from e join v on v.id = src where label = 'Team' union all select src from e join v on v.id = dst where label = 'Team' and src <> dst) group by 1")(lambda g, q: q.vertices().has_label("Team").both().ids().groupBy("id").agg(F.count("*").alias("n")))
_domain("e2_full", "select src as source, id as edge, dst as neighbor from e where type = 'CITES' and src in (select id from v)")(lambda g, q: q.vertices().expand_full("out", "CITES"))
_domain("e3_out_edges", "select e.id from e join v on v.id = src where label = 'Release'")(lambda g, q: q.vertices().has_label("Release").out_edges().ids())
_domain("e3_both_edges", "select e.id from e join v on v.id = src where label = 'Release' union all select e.id from e join v on v.id = dst where label = 'Release' and src <> dst")(lambda g, q: q.vertices().has_label("Release").both_edges().ids())
_domain("e5_endpoints", "select src as id from e where type = 'OWNED_BY'")(lambda g, q: q.edges().has_label("OWNED_BY").source_vertex().ids())
_domain("e5_other", "select e.dst as id from e join v on v.id = e.dst where label = 'Incident'")(lambda g, q: q.vertices().has_label("Incident").in_edges().other_vertex().ids())
_domain("e6_nexuses", "select i.nexus_id as id from i join v on v.id = vertex_id join n on n.id = nexus_id where label = 'Document' and type = 'Fact'")(lambda g, q: q.vertices().has_label("Document").nexuses("Fact").ids())
_domain("e7_members", "select vertex_id as id from i join n on n.id = nexus_id where type = 'Review' and role = 'reviewer'")(lambda g, q: q.nexuses("Review").members("reviewer").ids())
_domain("e8_other_members", "select b.vertex_id as id, count(*) as n from i a join v on v.id = a.vertex_id join i b on b.nexus_id = a.nexus_id where v.label = 'Team' and b.vertex_id <> a.vertex_id group by 1")(lambda g, q: q.vertices().has_label("Team").nexuses().other_members().ids().groupBy("id").agg(F.count("*").alias("n")))
_domain("e9_co_membership", "select a.vertex_id as a, b.vertex_id as b, count(*) as n from i a join n on n.id = a.nexus_id join i b on b.nexus_id = a.nexus_id where type = 'Fact' and a.role = 'subject' and b.role = 'object' and a.vertex_id <> b.vertex_id and a.vertex_id in (select id from v) group by all")(lambda g, q: q.vertices().as_("a").nexuses("Fact", "subject").other_members("object").as_("b").tuples("a", "b").groupBy("a", "b").agg(F.count("*").alias("n")))
_BFS = "r(s, x, d) as (select id, id, 0 from v where label = 'Release' union select s, e.dst, d + 1 from r join e on e.src = x where d < {}), b as (select s, x, min(d) as d from r where x <> s group by 1, 2)"
_domain("e10_repeat", f", {_BFS.format(2)} select x as id, count(*) as n from b where d = 2 group by 1")(lambda g, q: q.vertices().has_label("Release").repeat("out", 2).ids().groupBy("id").agg(F.count("*").alias("n")))
_domain("e10_repeat_emit", f", {_BFS.format(2)} select x as id, count(*) as n from b group by 1")(lambda g, q: q.vertices().has_label("Release").repeat("out", 2, emit=True).ids().groupBy("id").agg(F.count("*").alias("n")))
_domain("e11_typed", "select e.dst as id from e join v on v.id = e.dst where type = 'MENTIONS' and label = 'Component' and src in (select id from v)")(lambda g, q: q.vertices().out("MENTIONS").has_label("Component").ids())
_domain("e12_aliases", "select a.src as a, c.dst as c, count(*) as n from e a join e c on c.src = a.dst where a.type = 'HAS_CHUNK' and c.type = 'CITES' and a.src in (select id from v) group by all")(lambda g, q: q.vertices().as_("a").out("HAS_CHUNK").out("CITES").as_("c").tuples("a", "c").groupBy("a", "c").agg(F.count("*").alias("n")))
_domain("e12_select", "select a.src as id from e a join e c on c.src = a.dst where a.type = 'HAS_CHUNK' and c.type = 'CITES' and a.src in (select id from v)")(lambda g, q: q.vertices().as_("a").out("HAS_CHUNK").out("CITES").select("a").ids())
_domain("e10_repeat_zero", f", {_BFS.format(2)} select id, count(*) as n from (select x as id from b union all select id from v where label = 'Release') group by 1")(lambda g, q: q.vertices().has_label("Release").repeat("out", 2, emit=True, least=0).ids().groupBy("id").agg(F.count("*").alias("n")))
for _n in ("e10_repeat", "e10_repeat_emit", "e10_repeat_zero"):
    ORACLE[_n] = ORACLE[_n].replace("\n,", ",")

# -- paths ----------------------------------------------------------------------------------------------------

_domain("p1_bfs", f", {_BFS.format(3)} select s as start, x as end, d as depth from b".replace("as end", 'as "end"'))(lambda g, q: paths.bfs(g, q.vertices().has_label("Release").ids().withColumnRenamed("id", "start"), 3))
_domain("p3_shortest", ", r(s, x, d) as (select id, id, 0 from v where label = 'Team' union select s, e.dst, d + 1 from r join e on e.src = x where d < 4) select s as source, x as target, min(d) as distance from r join v on v.id = x where v.label = 'Release' group by 1, 2")(lambda g, q: paths.shortest_between(g, q.vertices().has_label("Team").ids().withColumnRenamed("id", "source"), q.vertices().has_label("Release").ids().withColumnRenamed("id", "target"), 4))
_domain("p5_weighted", ", m as (select src, dst, min(1 + id % 7) as w from e group by 1, 2), r(s, x, c, k) as (select id, id, 0::double, 0 from v where label = 'Team' union select s, m.dst, c + w, k + 1 from r join m on m.src = x where k < 12 and c + w <= 6) select s as source, x as target, min(c) as distance from r group by 1, 2")(
    lambda g, q: paths.weighted_paths(g.with_tables(edges=g.edges.withColumn("w", (1 + F.col("id") % 7).cast("double"))), q.vertices().has_label("Team").ids().withColumnRenamed("id", "source"), "w", max_distance=6.0).select("source", "target", "distance")
)
_domain("p8_frontier_limit", f", {_BFS.format(2)} select s as start, x as \"end\", d as depth from (select *, row_number() over (partition by s, d order by x) as k from b) where k <= 3")(lambda g, q: paths.frontier_limit(paths.bfs(g, q.vertices().has_label("Release").ids().withColumnRenamed("id", "start"), 2), 3))
for _n in ("p1_bfs", "p3_shortest", "p5_weighted", "p8_frontier_limit"):
    ORACLE[f"path_{_n[1:]}"] = ORACLE.pop(_n).replace("\n,", ",")
    QUERIES[f"path_{_n[1:]}"] = QUERIES.pop(_n)

_RANK = ", o as (select src, count(*) as d from e where src in (select id from v) and true group by 1), c as (select count(*) as n from v), r0 as (select id, 1.0::double / (select n from c) as r from v)"
for _k in range(1, 21):
    _RANK += f", r{_k} as materialized (select v.id, 0.15 / (select n from c) + 0.85 * (coalesce(f.s, 0) + (select coalesce(sum(r), 0) from r{_k - 1} where id not in (select src from o)) / (select n from c)) as r from v left join (select e.dst, sum(p.r / o.d) as s from e join o on o.src = e.src join r{_k - 1} p on p.id = e.src group by 1) f on f.dst = v.id)"
_domain("path_10_pagerank", f"{_RANK} select id, round(r * 1e6, 3) as rank from r20".replace(", o as", "@", 1))(lambda g, q: paths.pagerank(g).select("id", F.round(F.col("rank") * 1e6, 3).alias("rank")))
ORACLE["path_10_pagerank"] = ORACLE["path_10_pagerank"].replace("\n@", ", o as")

# -- projection, order, aggregates, branches ------------------------------------------------------------------

_order("r2_values", "select id, acctbal, segment from v where label in ('Supplier')")(lambda g, q: q.vertices().has_label("Supplier").values("acctbal", "segment"))
_domain("r4_label", "select e.dst as id, label from e join v on v.id = e.dst where type = 'OWNED_BY' and src in (select id from v)")(lambda g, q: q.vertices().out("OWNED_BY").label())
_order("r6_order_range", "select id from v where label = 'Part' order by price desc nulls last, id limit 40 offset 10")(lambda g, q: q.vertices().has_label("Part").order_by("price", descending=True).range(10, 50).ids())
_order("r6_order_absent", "select id from v where label in ('Customer', 'Supplier', 'Region') and label <> 'Customer' order by acctbal asc nulls last, id limit 5 offset 98")(lambda g, q: q.vertices().filter(F.col("label").isin("Supplier", "Region")).order_by("acctbal").range(98, 103).ids())
_order("r7_skip_limit", "select id from v where label = 'Nation' order by id limit 7 offset 5")(lambda g, q: q.vertices().has_label("Nation").skip(5).limit(7).ids())
_order("r8_dedup", "select distinct dst as id from e where type = 'FROM_SUPPLIER'")(lambda g, q: q.vertices().has_label("Order").out("FROM_SUPPLIER").dedup().ids())
_order("a1_count", "select count(*) as value from v where segment = 'BUILDING'")(lambda g, q: q.vertices().has("segment", "BUILDING").count_df())
_order("a2_sum", "select round(coalesce(sum(acctbal), 0), 2) as value from v where label = 'Supplier'")(lambda g, q: q.vertices().has_label("Supplier").sum("acctbal").select(F.round("value", 2).alias("value")))
_order("a2_sum_empty", "select 0.0::double as value")(lambda g, q: q.vertices().has_label("None").sum("acctbal"))
_order("a3_sum_long", "select cast(coalesce(sum(size), 0) as bigint) as value from v")(lambda g, q: q.vertices().sum_long("size"))
_order("a4_max_min", "select max(price) as hi, min(price) as lo from v where label = 'Part'")(lambda g, q: q.vertices().has_label("Part").max("price").select(F.col("value").alias("hi"), F.lit(1).alias("k")).join(q.vertices().has_label("Part").min("price").select(F.col("value").alias("lo"), F.lit(1).alias("k")), "k").drop("k"))
_order("a5_mean", "select round(avg(cast(size as double)), 6) as value from v")(lambda g, q: q.vertices().mean("size").select(F.round("value", 6).alias("value")))
_order("a6_group_count", "select brand as key, count(*) as n from e join v on v.id = dst where type = 'HAS_PART' and brand is not null group by 1")(lambda g, q: q.vertices().has_label("Order").out("HAS_PART").group_count("brand"))
_domain("b1_union", "select id, count(*) as n from (select dst as id from e join v on v.id = src where label = 'Chunk' and type = 'CITES' union all select src from e join v on v.id = dst where label = 'Chunk' and type = 'HAS_CHUNK') group by 1")(lambda g, q: q.vertices().has_label("Chunk").union(lambda s: s.out("CITES"), lambda s: s.in_("HAS_CHUNK")).ids().groupBy("id").agg(F.count("*").alias("n")))
_domain("b2_coalesce", "select id, count(*) as n from (select dst as id from e join v on v.id = src where label = 'Chunk' and type = 'CITES' union all select dst from e join v on v.id = src where label = 'Chunk' and type = 'MENTIONS' and src not in (select src from e where type = 'CITES')) group by 1")(lambda g, q: q.vertices().has_label("Chunk").coalesce(lambda s: s.out("CITES"), lambda s: s.out("MENTIONS")).ids().groupBy("id").agg(F.count("*").alias("n")))
_domain("b3_optional", "select id, count(*) as n from (select dst as id from e join v on v.id = src where label = 'Team' and type = 'OWNED_BY' union all select id from v where label = 'Team' and id not in (select src from e where type = 'OWNED_BY')) group by 1")(lambda g, q: q.vertices().has_label("Team").optional(lambda s: s.out("OWNED_BY")).ids().groupBy("id").agg(F.count("*").alias("n")))

# -- patterns -------------------------------------------------------------------------------------------------

_V = VertexPattern
_domain("m1_vertex", "select id as a from v where label = 'Incident'")(lambda g, q: q.match(_V("a", "Incident")).to_df())
_domain("m2_edge", "select src as a, dst as b, e.id as x from e join v s on s.id = src join v t on t.id = dst where type = 'MENTIONS' and s.label = 'Chunk' and t.label = 'Component'")(lambda g, q: q.match(EdgePattern(_V("a", "Chunk"), _V("b", "Component"), "MENTIONS", "x")).to_df())
_domain("m2_reverse", "select dst as a, src as b from e join v t on t.id = dst where type = 'CITES' and t.label = 'Document'")(lambda g, q: q.match(EdgePattern(_V("a", "Document"), _V("b"), "CITES", reverse=True)).to_df())
_domain("m3_star", "select n.id as f, s.vertex_id as s, o.vertex_id as o from n join i s on s.nexus_id = n.id and s.role = 'subject' join i o on o.nexus_id = n.id and o.role = 'object' join v on v.id = s.vertex_id where type = 'Fact' and label = 'Document'")(lambda g, q: q.match(NexusPattern("f", "Fact", (("subject", _V("s", "Document")), ("object", _V("o"))))).to_df())
_domain("m3_repeated_role", "select n.id as f, a.vertex_id as a, b.vertex_id as b from n join i a on a.nexus_id = n.id and a.role = 'tail' join i b on b.nexus_id = n.id and b.role = 'tail' where type = 'Rule'")(lambda g, q: q.match(NexusPattern("f", "Rule", (("tail", _V("a")), ("tail", _V("b"))))).to_df())
_order("m4_where", "select src as c, dst as o from e join v on v.id = src join v w on w.id = dst where type = 'PLACED' and v.segment = 'FURNITURE' and w.status = 'P'")(lambda g, q: q.match(EdgePattern(_V("c", "Customer"), _V("o"), "PLACED")).where("c", "segment", P.eq("FURNITURE")).where("o", "status", P.eq("P")).to_df())
_domain("m6_triangle_join", "select r.src as a, r.dst as b, s.dst as c from e r join e s on s.src = r.dst join e t on t.src = s.dst and t.dst = r.src")(lambda g, q: triangle_join(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), g.edges.select(F.col("src").alias("b"), F.col("dst").alias("c")), g.edges.select(F.col("src").alias("c"), F.col("dst").alias("a"))))
_domain("m6_triangles", ", u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst) select x.a, x.b, y.b as c from u x join u y on y.a = x.b join u z on z.a = x.a and z.b = y.b")(lambda g, q: triangles(g.edges))
ORACLE["m6_triangles"] = ORACLE["m6_triangles"].replace("\n,", ",")

# -- directed nexuses, statistics, subgraphs, mutations -------------------------------------------------------

_REACH = ", r0 as materialized (select distinct id as x from v where id % 4 <> 0)"
for _k in range(1, 9):
    _REACH += f", r{_k} as materialized (select x from r{_k - 1} union select h.vertex_id from i h join n on n.id = h.nexus_id where type = 'Rule' and h.role = 'head' and h.nexus_id in (select nexus_id from i where role = 'tail') and not exists (select 1 from i t where t.nexus_id = h.nexus_id and t.role = 'tail' and t.vertex_id not in (select x from r{_k - 1})))"
_domain("g6_nexus_reach", f"{_REACH} select x as vertex_id from r8")(lambda g, q: directed_nexus.reach(g, _most(g), "Rule"))
# Of every rule that fires, one of unit price: the least costs of its tails and 1, until nothing gets cheaper.
_COST = ", t as (select nexus_id, count(*) as a from (select distinct nexus_id, vertex_id from i where role = 'tail') group by 1), h as (select distinct i.nexus_id, i.vertex_id from i join n on n.id = i.nexus_id where n.type = 'Rule' and i.role = 'head'), c0 as materialized (select distinct id as x, 0.0::double as c from v where id % 4 <> 0)"
for _k in range(1, 9):
    _COST += f", c{_k} as materialized (select x, min(c) as c from (select x, c from c{_k - 1} union all select h.vertex_id, 1 + f.s from h join (select q.nexus_id, sum(p.c) as s, count(*) as k from (select distinct nexus_id, vertex_id from i where role = 'tail') q join c{_k - 1} p on p.x = q.vertex_id group by 1) f on f.nexus_id = h.nexus_id join t on t.nexus_id = f.nexus_id and t.a = f.k) group by 1)"
_domain("g7_derivations", f"{_COST} select x as vertex_id, c as cost from c8")(lambda g, q: directed_nexus.derivations(g, _most(g), None, "additive", "Rule").select("vertex_id", "cost"))
_domain("g1_reachable", ", r(id) as (select min(id) from v where label = 'Team' union select dst from r join e on src = r.id) select id from r")(lambda g, q: annotations.reachable(g, _team(g), annotations.WHOLE).values.select("id"))
# Citations towards greater ids have no cycle, and few walks.
_WALKS = ", s as (select min(src) as id from e where type = 'CITES' and src < dst), r(id, c, p) as (select id, 0.0::double, 1.0::double from s union all select dst, c + 1 + e.id % 7, p * (1 + e.id % 7) / 8.0 from r join e on src = r.id where type = 'CITES' and src < dst)"
_domain("g2_tropical", f"{_WALKS} select id, min(c) as value from r group by 1")(lambda g, q: annotations.tropical(_forward(g), _first(g), "w", "acyclic", annotations.WHOLE).values)
_domain("g3_viterbi", f"{_WALKS} select id, round(max(p), 9) as value from r group by 1")(lambda g, q: annotations.viterbi(_forward(g), _first(g), "p", annotations.WHOLE).values.select("id", F.round("value", 9).alias("value")))
_domain("g4_walks", f"{_WALKS} select id, count(*) as value from r group by 1")(lambda g, q: annotations.walks(_forward(g), _first(g), annotations.WHOLE).values)
for _n in ("g1_reachable", "g2_tropical", "g3_viterbi", "g4_walks", "g6_nexus_reach", "g7_derivations"):
    ORACLE[_n] = ORACLE[_n].replace("\n,", ",")
_domain("a7_labels", "select 'label' as statistic, label as name, count(*) as n from v group by 2 union all select 'edge_type', type, count(*) from e group by 2 union all select 'nexus_type', type, count(*) from n group by 2 union all select 'arity', cast(a as varchar), count(*) from (select n.id, count(vertex_id) as a from n left join i on nexus_id = n.id group by 1) group by 2 union all select 'degree', case when d <= 0 then '0' when d <= 1 then '1' when d <= 3 then '3' when d <= 7 then '7' when d <= 15 then '15' when d <= 31 then '31' when d <= 63 then '63' when d <= 127 then '127' when d <= 255 then '255' else 'more' end, count(*) from (select v.id, count(x.id) as d from v left join (select src as id from e union all select dst from e where src <> dst) x on x.id = v.id group by 1) group by 2")(lambda g, q: stats.collect(g))
_domain("a7_power_vertices", "select id, count(*) as degree from (select src as id from e union all select dst from e where src <> dst) join v using (id) group by 1 having count(*) > 100")(lambda g, q: stats.power_vertices(g, 100))
_order("a7_properties", "select 'acctbal' as key, count(acctbal) as owners, count(distinct acctbal) as distinct_values from v union all select 'brand', count(brand), count(distinct brand) from v union all select 'name', count(name), count(distinct name) from v union all select 'price', count(price), count(distinct price) from v union all select 'priority', count(priority), count(distinct priority) from v union all select 'segment', count(segment), count(distinct segment) from v union all select 'size', count(size), count(distinct size) from v union all select 'status', count(status), count(distinct status) from v")(lambda g, q: stats.property_stats(g, exact=True).select("key", "owners", "distinct_values"))
_domain("a8_dangling_edges", "select id, 'src' as side, src as vertex from e where src not in (select id from v) union all select id, 'dst', dst from e where dst not in (select id from v)")(lambda g, q: stats.dangling_edges(g))
_domain("a8_dangling_members", "select nexus_id, role, vertex_id from i where vertex_id not in (select id from v)")(lambda g, q: stats.dangling_members(g))
_domain("io2_induced_edges", "select id from e where src in (select id from v where label = 'Chunk') and dst in (select id from v where label = 'Chunk')")(lambda g, q: induced(g, q.vertices().has_label("Chunk").ids()).edges.select("id"))
_domain("io2_induced_nexuses", "select nexus_id as id from i group by 1 having bool_and(vertex_id in (select id from v where label in ('Chunk', 'Document')))")(lambda g, q: induced(g, q.vertices().filter(F.col("label").isin("Chunk", "Document")).ids()).nexuses.select("id"))
_order("io11_schema", "select 'vertex' as kind, label as name, case label when 'Region' then 'name' when 'Nation' then 'name' when 'Customer' then 'acctbal,name,segment' when 'Supplier' then 'acctbal,name' when 'Part' then 'brand,name,price,size' else 'price,priority,status' end as keys from v group by 2 union all select 'edge', type, case when count(quantity) > 0 then 'discount,quantity' else '' end from e group by 2")(lambda g, q: schema(g).filter("kind <> 'nexus'").select("kind", "name", F.array_join(F.array_sort("properties"), ",").alias("keys")))
_domain("w1_delete_vertex", "select 'e' as kind, id from e where src not in (select id from v where label = 'Team') and dst not in (select id from v where label = 'Team') union all select 'n', id from n where id not in (select nexus_id from i join v on v.id = vertex_id where label = 'Team') union all select 'v', id from v where label <> 'Team'")(
    lambda g, q: _ids(mutations.delete_vertices(g, q.vertices().has_label("Team").ids()))
)
_domain("w2_delete_edges", "select id from e where type <> 'CITES'")(lambda g, q: mutations.delete_edges(g, q.edges().filter(F.col("type") == "CITES").ids()).edges.select("id"))
_domain("w2_connect", "select distinct a.src, b.dst from e a join e b on b.src = a.dst where a.type = 'CITES' and b.type = 'OWNED_BY'")(
    lambda g, q: mutations.connect(g, g.edges.filter("type = 'CITES'").select("src", F.col("dst").alias("m")).join(g.edges.filter("type = 'OWNED_BY'").select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").distinct(), "SEES")[0].edges.filter("type = 'SEES'").select("src", "dst")
)
_domain("w3_delete_nexuses", "select nexus_id, role, vertex_id from i where nexus_id not in (select id from n where type = 'Fact')")(lambda g, q: mutations.delete_nexuses(g, q.nexuses("Fact").ids()).incidence.select("nexus_id", "role", "vertex_id"))
_domain("w4_set_property", "select id, case when label = 'Team' then label || '-' || id else label end as label from v")(lambda g, q: mutations.set_property(g, "vertex", "label", g.vertices.filter("label = 'Team'").select("id", F.concat_ws("-", "label", "id").alias("value"))).vertices.select("id", "label"))
_domain("w4_set_values", "select id, case when label = 'Team' and id % 2 = 0 then 'b,c' when label = 'Team' then 'a,b,c' else '' end as tags from v")(
    lambda g, q: _tags(mutations.remove_value(mutations.add_value(g.with_tables(vertices=g.vertices.withColumn("tags", F.array().cast("array<string>"))), "vertex", "tags", _teams(g, "a", "b", "c")), "vertex", "tags", _teams(g, "a").filter("id % 2 = 0")))
)
_domain("s8_nexus_seed", "select vertex_id as id from i where nexus_id = (select min(id) from n where type = 'Rule' and id in (select nexus_id from i))")(lambda g, q: q.nexus(g.incidence.join(g.nexuses.filter("type = 'Rule'").select(F.col("id").alias("nexus_id")), "nexus_id").agg(F.min("nexus_id")).first()[0]).members().ids())
_domain("w6_merge_edges", "select distinct c.src, a.dst, 'SEES' as type from e c join e a on a.src = c.dst where c.type = 'CITES' and a.type = 'OWNED_BY' and c.src in (select id from v)")(
    lambda g, q: mutations.merge_edges(g, q.vertices().as_("a").out("CITES").out("OWNED_BY").as_("b").tuples("a", "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SEES").alias("type"))).edges.filter("type = 'SEES'").select("src", "dst", "type")
)
_domain("w5_merge_vertices", "select type as name, 'Kind' as label from e group by 1")(
    lambda g, q: mutations.merge_vertices(g.with_tables(vertices=g.vertices.withColumn("name", F.lit(None).cast("string"))), "Kind", "name", g.edges.select(F.col("type").alias("value"))).vertices.filter("label = 'Kind'").select("name", "label")
)
_domain("w7_merge_nexuses", "select type, count(*) as n, sum(a) as members, sum(x) as total from (select n.id, type, count(vertex_id) as a, sum(vertex_id * 31 + length(role)) as x from n left join i on nexus_id = n.id group by 1, 2) group by 1 union all select 'Claim', count(*), sum(len(m)), sum(x) from (select distinct m, x from (select nexus_id, list(role || ':' || vertex_id order by role, vertex_id) as m, sum(vertex_id * 31 + length(role)) as x from i group by 1 having count(*) > 1))")(
    lambda g, q: _nexus_sums(mutations.merge_nexuses(g, _whole(g).unionByName(_whole(g).withColumn("type", F.lit("Claim")))))
)
_domain("w9_replace", "select id - 1 as id, 'Crew' as label from v where label = 'Team'")(lambda g, q: mutations.replace_vertices(g, q.vertices().has_label("Team").ids().select(F.col("id").alias("old"), (F.col("id") - 1).alias("new")), "Crew").vertices.filter("label = 'Crew'").select("id", "label"))


def _ids(g: PropertyGraph) -> DataFrame:
    one = lambda name, df: df.select(F.lit(name).alias("kind"), "id")
    return one("e", g.edges).unionByName(one("n", g.nexuses)).unionByName(one("v", g.vertices))


def _teams(g: PropertyGraph, *values: str) -> DataFrame:
    return g.vertices.filter("label = 'Team'").select("id", F.explode(F.array(*map(F.lit, values))).alias("value"))


def _tags(g: PropertyGraph) -> DataFrame:
    return g.vertices.select("id", F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ",").alias("tags"))


def _nexus_sums(g: PropertyGraph) -> DataFrame:
    """By type the number of nexuses, of their members, and a sum over both, which outgrows a long."""
    weight = (F.col("vertex_id") * 31 + F.length("role")).cast("decimal(20,0)")
    each = g.nexuses.select(F.col("id").alias("nexus_id"), "type").join(g.incidence, "nexus_id", "left").groupBy("nexus_id", "type").agg(F.count("vertex_id").alias("a"), F.sum(weight).alias("x"))
    return each.groupBy("type").agg(F.count("*").alias("n"), F.sum("a").alias("members"), F.sum("x").cast("decimal(38,0)").alias("total"))


def _team(g: PropertyGraph) -> int:
    return g.vertices.filter("label = 'Team'").agg(F.min("id")).first()[0]


def _forward(g: PropertyGraph) -> PropertyGraph:
    """Citations towards greater ids, with a weight and a probability."""
    w = 1 + F.col("id") % 7
    return g.with_tables(edges=g.edges.filter("type = 'CITES' and src < dst").withColumns({"w": w.cast("double"), "p": w / F.lit(8.0)}))


def _first(g: PropertyGraph) -> int:
    return _forward(g).edges.agg(F.min("src")).first()[0]


def _most(g: PropertyGraph) -> DataFrame:
    """Three vertices of four, from which rules fire in several rounds."""
    return g.vertices.filter("id % 4 <> 0").select(F.col("id").alias("vertex_id"))


def _whole(g: PropertyGraph) -> DataFrame:
    """The graph's own nexuses of two and more members, as they would be asked for again."""
    members = mutations.member_key(g.incidence).filter(F.size("members") > 1)
    return members.join(g.nexuses.select(F.col("id").alias("nexus_id"), "type"), "nexus_id").select("type", "members")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Brands bought by the customers of a segment, counted: a label scan, two expansions and a grouping."""
    q = order_graph(spark, d).query()
    return q.vertices().has_label("Customer").has("segment", "BUILDING").out("PLACED").out("HAS_PART").group_count("brand")


QUERIES["flagship"] = flagship
ORACLE["flagship"] = f"with {ORDER_SQL} select p.brand as key, count(*) as n from v c join e a on a.src = c.id and a.type = 'PLACED' join e b on b.src = a.dst and b.type = 'HAS_PART' join v p on p.id = b.dst where c.segment = 'BUILDING' and p.brand is not null group by 1"
