"""Graph JSON: export of a graph or subgraph, strict import of many documents, and semantic merge."""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.graph import PropertyGraph

FORMAT, VERSION = "graph-json", 1
_TYPES = {T.BooleanType: "bool", T.IntegerType: "int32", T.LongType: "int64", T.DoubleType: "double", T.FloatType: "double", T.StringType: "string", T.BinaryType: "bytes"}
_SPARK = {"bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "floatArray": T.ArrayType(T.FloatType())}


def _kind(dtype: T.DataType) -> tuple[str, str]:
    """(cardinality, type) of a property column; an array of floats is one vector."""
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, (T.FloatType, T.DoubleType)):
            return "single", "floatArray"
        return "set", _TYPES[type(dtype.elementType)]
    return "single", _TYPES.get(type(dtype), "string")


def _value(kind: str, value):
    """64-bit integers as decimal strings, bytes as base64, numbers that JSON lacks as strings."""
    if kind == "int64":
        return str(value)
    if kind == "bytes":
        return base64.b64encode(value).decode()
    if kind == "double" and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if kind == "floatArray":
        return [float(x) for x in value]
    return value


def entity_lines(g: PropertyGraph, keys: set[str] | None = None, drop_types: tuple[str, ...] = ()) -> DataFrame:
    """(section, id, line): one JSON text per vertex, edge and nexus, written in parallel; the envelope adds nothing but
    commas. ``keys`` whitelists properties, ``drop_types`` leaves out types such as bytes and floatArray."""

    def properties(kind: str):
        table = g.table(kind)
        chosen = [(k, *_kind(table.schema[k].dataType)) for k in sorted(g.property_keys(kind)) if keys is None or k in keys]
        chosen = [c for c in chosen if c[2] not in drop_types]

        @F.udf("string")
        def packed(row):
            out = []
            for key, cardinality, kind_ in chosen:
                value = row[key]
                if value is None:
                    continue
                for v in value if cardinality == "set" else [value]:
                    out.append({"key": key, "cardinality": cardinality, "type": kind_, "value": _value(kind_, v)})
            return json.dumps(out, ensure_ascii=False)

        return packed(F.struct(*(F.col(c[0]) for c in chosen))) if chosen else F.lit("[]")

    @F.udf("string")
    def line(fields, props):
        return json.dumps({**{k: v for k, v in fields.asDict(True).items() if v is not None}, "properties": json.loads(props)}, ensure_ascii=False)

    text = lambda c: F.col(c).cast("string")
    vertices = g.vertices.select(F.lit("vertices").alias("section"), "id", line(F.struct(text("id").alias("id"), "label"), properties("vertex")).alias("line"))
    edges = g.edges.select(F.lit("edges").alias("section"), "id", line(F.struct(text("id").alias("id"), "type", text("src").alias("source"), text("dst").alias("target")), properties("edge")).alias("line"))
    members = g.incidence.groupBy(F.col("nexus_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("role", F.col("vertex_id").cast("string").alias("vertex")))).alias("members"))
    some = g.nexuses.join(members, "id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<struct<role:string,vertex:string>>")))
    nexuses = some.select(F.lit("nexuses").alias("section"), "id", line(F.struct(text("id").alias("id"), "type", "members"), properties("nexus")).alias("line"))
    return vertices.unionByName(edges).unionByName(nexuses)


def schema_section(g: PropertyGraph, keys: set[str] | None = None, drop_types: tuple[str, ...] = ()) -> dict:
    names = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None)
    found: dict[str, str] = {}
    for kind in ("vertex", "edge", "nexus"):
        for k in g.property_keys(kind):
            cardinality, kind_ = _kind(g.table(kind).schema[k].dataType)
            if (keys is None or k in keys) and kind_ not in drop_types:
                found[k] = cardinality
    return {"labels": names(g.vertices, "label"), "edgeTypes": names(g.edges, "type"), "nexusTypes": names(g.nexuses, "type"), "roles": names(g.incidence, "role"), "propertyKeys": [{"name": k, "cardinality": found[k]} for k in sorted(found)]}


def export_text(g: PropertyGraph, database_id: str, snapshot: str, keys: set[str] | None = None, drop_types: tuple[str, ...] = (), fmt: str = FORMAT) -> str:
    """The whole document as one text, for graphs that fit one file; larger ones are written with ``export_lines``."""
    head = {"format": fmt, "version": VERSION, "source": {"databaseId": database_id, "snapshot": snapshot}, "schema": schema_section(g, keys, drop_types)}
    sections: dict[str, list[str]] = {"vertices": [], "edges": [], "nexuses": []}
    for r in entity_lines(g, keys, drop_types).orderBy("section", "id").toLocalIterator():
        sections[r.section].append(r.line)
    body = ", ".join(f'"{k}": [{", ".join(v)}]' for k, v in sections.items())
    return json.dumps(head, ensure_ascii=False)[:-1] + ", " + body + "}"


def export_lines(g: PropertyGraph, path: str, keys: set[str] | None = None, drop_types: tuple[str, ...] = ()) -> None:
    """One JSON line per entity in a folder per section, written by the executors."""
    entity_lines(g, keys, drop_types).select("section", "line").write.partitionBy("section").text(path)


class GraphJsonError(ValueError):
    pass


_TOP = ["format", "version", "source", "schema", "vertices", "edges", "nexuses"]


def _unique(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise GraphJsonError(f"{k} is given twice")
        out[k] = v
    return out


def _strict(value: dict, allowed: set[str], what: str) -> dict:
    if not isinstance(value, dict) or set(value) - allowed:
        raise GraphJsonError(f"unknown member in {what}")
    return value


def check_document(text: str, fmt: str = FORMAT) -> dict:
    """The parsed document, or an error: unknown, repeated, missing or misplaced members, trailing text, undeclared
    labels, types, roles or keys, and references to what the document lacks."""
    try:
        doc = json.loads(text, object_pairs_hook=_unique)
    except (ValueError, RecursionError) as e:
        raise GraphJsonError(str(e)) from None
    if not isinstance(doc, dict) or set(doc) - set(_TOP) or set(_TOP) - set(doc):
        raise GraphJsonError("the document's sections are not the seven of the format")
    order = list(doc)
    if max(order.index("source"), order.index("schema")) > min(order.index(s) for s in ("vertices", "edges", "nexuses")) or order.index("vertices") > min(order.index("edges"), order.index("nexuses")):
        raise GraphJsonError("source and schema come before the entities, vertices before edges and nexuses")
    if doc["format"] != fmt or doc["version"] != VERSION:
        raise GraphJsonError("unknown format or version")
    schema = _strict(doc["schema"], {"labels", "edgeTypes", "nexusTypes", "roles", "propertyKeys"}, "schema")
    labels, edge_types, nexus_types, roles = (set(schema[k]) for k in ("labels", "edgeTypes", "nexusTypes", "roles"))
    keys = {p["name"]: p["cardinality"] for p in schema["propertyKeys"]}
    seen: dict[str, set[str]] = {"vertices": set(), "edges": set(), "nexuses": set()}

    def common(section: str, e: dict, allowed: set[str]) -> None:
        _strict(e, allowed | {"id", "properties"}, section)
        if e["id"] in seen[section]:
            raise GraphJsonError(f"{section} {e['id']} is given twice")
        seen[section].add(e["id"])
        single = set()
        for p in e["properties"]:
            _strict(p, {"key", "cardinality", "type", "value"}, "a property")
            if keys.get(p["key"]) != p["cardinality"] or p["type"] not in _SPARK:
                raise GraphJsonError(f"property {p['key']} is not declared so")
            if p["cardinality"] == "single" and p["key"] in single:
                raise GraphJsonError(f"property {p['key']} is given twice")
            single.add(p["key"])

    def known(value: str, some: set[str], what: str) -> None:
        if value not in some:
            raise GraphJsonError(f"unknown {what} {value}")

    for v in doc["vertices"]:
        common("vertices", v, {"label"})
        known(v["label"], labels, "label")
    for e in doc["edges"]:
        common("edges", e, {"type", "source", "target"})
        known(e["type"], edge_types, "edge type")
        known(e["source"], seen["vertices"], "vertex")
        known(e["target"], seen["vertices"], "vertex")
    for x in doc["nexuses"]:
        common("nexuses", x, {"type", "members"})
        known(x["type"], nexus_types, "nexus type")
        for m in x["members"]:
            known(_strict(m, {"role", "vertex"}, "a member")["role"], roles, "role")
            known(m["vertex"], seen["vertices"], "vertex")
        if len({(m["role"], m["vertex"]) for m in x["members"]}) < max(2, len(x["members"])):
            raise GraphJsonError(f"nexus {x['id']} needs two or more members, each once")
    return doc


def _entities(doc: dict) -> list[tuple[str, str, str, str]]:
    """(database, kind, source id, canonical JSON) of a checked document; order of properties and members is no part."""
    out, database = [], doc["source"]["databaseId"]
    for section in ("vertices", "edges", "nexuses"):
        for e in doc[section]:
            e = dict(e)
            e["properties"] = sorted(e["properties"], key=lambda p: json.dumps(p, sort_keys=True))
            if "members" in e:
                e["members"] = sorted(e["members"], key=lambda m: (m["role"], m["vertex"]))
            out.append((database, section, e["id"], json.dumps(e, sort_keys=True, ensure_ascii=False)))
    return out


def import_documents(spark: SparkSession, documents: DataFrame, text_col: str = "payload", fmt: str = FORMAT) -> PropertyGraph:
    """One graph of all documents, each parsed and checked whole by a task.

    An entity is identified by database, kind and source id; equal repeats are one, unequal ones an error. New ids are
    dense ranks in the order of that identity.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for t in pdf[text_col] for r in _entities(check_document(t, fmt))]
            yield pd.DataFrame(rows, columns=["db", "section", "source_id", "line"])

    rows = documents.select(text_col).mapInPandas(run, "db string, section string, source_id string, line string").distinct()
    from filigree.session import checkpoint

    rows = checkpoint(rows)
    if rows.groupBy("db", "section", "source_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise GraphJsonError("documents disagree on an entity")
    return _assemble(rows)


def typed(kind: str, dtype: T.DataType):
    """The value of a property entry as its type."""
    if kind == "bytes":
        return lambda p: F.unbase64(p["value"])
    if kind == "floatArray":
        return lambda p: F.from_json(p["value"], "array<float>")
    return lambda p: p["value"].cast(dtype)


def _assemble(rows: DataFrame) -> PropertyGraph:
    """Wide tables from canonical entity lines."""
    member = "array<struct<role:string,vertex:string>>"
    prop = "array<struct<key:string,cardinality:string,type:string,value:string>>"
    parsed = rows.withColumn("e", F.from_json("line", f"struct<id:string,label:string,type:string,source:string,target:string,members:{member},properties:{prop}>"))
    # An id is a hash of the identity: it needs no shuffle and is the same in every run.
    key = lambda section, c: F.xxhash64(F.col("db"), F.lit(section), F.col(c)).bitwiseAND(F.lit(2**62 - 1))

    def wide(section: str, columns: list) -> DataFrame:
        part = parsed.filter(F.col("section") == section)
        kinds = part.select(F.explode("e.properties").alias("p")).select("p.key", "p.cardinality", "p.type").distinct().orderBy("key", "type").collect()
        named = lambda name: lambda p: p["key"] == name
        props = []
        for name in dict.fromkeys(r.key for r in kinds):
            r = next(x for x in kinds if x.key == name)
            dtype = _SPARK[r.type]
            values = F.transform(F.filter("e.properties", named(name)), typed(r.type, dtype))
            props.append((F.when(F.size(values) > 0, values) if r.cardinality == "set" else F.get(values, 0)).alias(name))
        return part.select(key(section, "source_id").alias("id"), *columns, *props)

    vertices = wide("vertices", [F.col("e.label").alias("label")])
    edges = wide("edges", [key("vertices", "e.source").alias("src"), key("vertices", "e.target").alias("dst"), F.col("e.type").alias("type")])
    nexuses = wide("nexuses", [F.col("e.type").alias("type")])
    some = parsed.filter("section = 'nexuses'").select("db", key("nexuses", "source_id").alias("nexus_id"), F.explode("e.members").alias("m"))
    incidence = some.select("nexus_id", F.col("m.role").alias("role"), key("vertices", "m.vertex").alias("vertex_id"))
    return PropertyGraph(vertices, edges, nexuses, incidence)


@dataclass(frozen=True)
class MergeRule:
    """Vertices of a label are the same if they agree on a Single key."""

    label: str
    key: str


def semantic_merge(target: PropertyGraph, incoming: PropertyGraph, rules: list[MergeRule], policy: str = "error") -> PropertyGraph:
    """target with incoming merged in: vertices by the rules, then edges by (src, dst, type) and nexuses by (type,
    members). Where a merged vertex's properties differ the policy is error, keep or overwrite. A key that names several
    vertices on one side is an error. Incoming ids must differ from the target's."""
    from filigree.operators import mutations as M

    mapping, vertices = None, target.vertices
    for rule in rules:
        side = lambda df, r=rule: df.filter((F.col("label") == r.label) & F.col(r.key).isNotNull())
        for df in (target.vertices, incoming.vertices):
            if rule.key in df.columns and side(df).groupBy(rule.key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
                raise GraphJsonError(f"{rule.label}.{rule.key} names several vertices")
        pairs = side(target.vertices).select(F.col("id").alias("new"), F.col(rule.key).alias("k")).join(side(incoming.vertices).select(F.col("id").alias("old"), F.col(rule.key).alias("k")), "k").select("old", "new")
        mapping = pairs if mapping is None else mapping.unionByName(pairs)
    if mapping is None:
        mapping = target.vertices.sparkSession.createDataFrame([], "old long, new long")
    shared = [k for k in incoming.property_keys() if k in target.property_keys()]
    met = mapping.join(incoming.vertices.select(F.col("id").alias("old"), *(F.col(k).alias(f"i_{k}") for k in shared)), "old").join(target.vertices.select(F.col("id").alias("new"), *(F.col(k).alias(f"t_{k}") for k in shared)), "new")
    if policy == "error":
        clash = [F.col(f"i_{k}").isNotNull() & F.col(f"t_{k}").isNotNull() & (F.col(f"i_{k}") != F.col(f"t_{k}")) for k in shared]
        if clash and met.filter(F.greatest(*(F.coalesce(c, F.lit(False)).cast("int") for c in clash), F.lit(0)) == 1).limit(1).count():
            raise GraphJsonError("merged vertices differ in a property")
    pick = lambda k: F.coalesce(*((f"i_{k}", f"t_{k}") if policy == "overwrite" else (f"t_{k}", f"i_{k}"))).alias(f"m_{k}")
    merged = met.select(F.col("new").alias("id"), *(pick(k) for k in shared), F.lit(True).alias("_m"))
    joined = vertices.join(merged, "id", "left")
    vertices = joined.select(*((F.when(F.col("_m"), F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c)) for c in target.vertices.columns))
    moved = M.replace_vertices(incoming, mapping)
    fresh = incoming.vertices.join(mapping.select(F.col("old").alias("id")), "id", "left_anti")
    out = target.with_tables(vertices=vertices.unionByName(fresh, allowMissingColumns=True))
    identity = ["src", "dst", "type"]
    new_edges = moved.edges.dropDuplicates(identity).join(target.edges.select(*identity).distinct(), identity, "left_anti")
    out = M.add_edges(out, new_edges)
    named = lambda g: M.member_key(g.incidence).join(g.nexuses.select(F.col("id").alias("nexus_id"), "type"), "nexus_id").withColumn("k", F.to_json("members"))
    new = named(moved).join(named(target).select("type", "k").distinct(), ["type", "k"], "left_anti").dropDuplicates(["type", "k"]).select("nexus_id")
    nexuses = moved.nexuses.join(new.withColumnRenamed("nexus_id", "id"), "id", "left_semi")
    return out.with_tables(nexuses=out.nexuses.unionByName(nexuses, allowMissingColumns=True), incidence=out.incidence.unionByName(moved.incidence.join(new, "nexus_id", "left_semi")))
