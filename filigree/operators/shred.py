"""Shredding of nested JSON into an adjacency table and flat entity tables.

``shred_json`` stores one row per JSON value: node, parent, owner, label, ordinal, kind and scalar. ``pivot_objects``
joins object nodes with their scalar children, one column per label; ``graph_entities`` builds the related tables
of graph JSON from it. The links between tables are (document, node) and (document, owner).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.session import shared_path

#: Labels whose value is a list of records; a lone record there counts as a list of one.
GRAPH_LISTS = ("vertices", "edges", "nexuses", "members", "properties")

_ADJACENCY = [
    ("node", pa.int64()), ("parent", pa.int64()), ("owner", pa.int64()), ("label", pa.string()),
    ("ordinal", pa.int64()), ("kind", pa.string()), ("scalar", pa.string()), ("path", pa.string()),
]


def _not_json(token: str) -> None:
    raise ValueError(f"{token} is no JSON value")


class _Digits(str):
    """An integer of more digits than Python converts, as it is written."""


def _integer(text: str) -> int | _Digits:
    return int(text) if len(text) <= 4_000 else _Digits(text)


def _clean(text: str) -> str:
    """text without lone surrogates, which a \\u escape may make and UTF-8 cannot hold."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
    return text


def _scalar(value: object) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "bool", "true" if value else "false"
    if isinstance(value, _Digits):
        return "int", str(value)
    if isinstance(value, str):
        return "string", _clean(value)
    return ("int" if isinstance(value, int) else "double"), str(value)


def walk_json(text: str | None, lists: Iterable[str] = GRAPH_LISTS, under: Iterable[str] | None = None) -> list[tuple]:
    """The adjacency rows of one document in document order; none for null, empty, cut-off or otherwise invalid JSON.

    A path names the labels from the root, with [] for a list item. ``under`` keeps only these labels of the root.
    """
    if not text or not text.strip():
        return []
    try:
        root = json.loads(text, parse_int=_integer, parse_constant=_not_json)
    except (ValueError, RecursionError):
        return []
    lists, only, rows = set(lists), None if under is None else set(under), []
    stack: list[tuple] = [(root, -1, -1, "", 0, "")]
    while stack:
        value, parent, owner, label, ordinal, path = stack.pop()
        if isinstance(value, dict) and label in lists and not path.endswith("[]"):
            value = [value]
        node = len(rows)
        if isinstance(value, dict):
            rows.append((node, parent, owner, label, ordinal, "object", None, path))
            items = [(x, node, node, _clean(k), i, f"{path}.{_clean(k)}" if path else _clean(k)) for i, (k, x) in enumerate(value.items()) if path or only is None or k in only]
            stack.extend(reversed(items))
        elif isinstance(value, list):
            rows.append((node, parent, owner, label, ordinal, "array", None, path))
            stack.extend((value[i], node, owner, label, i, f"{path}[]") for i in range(len(value) - 1, -1, -1))
        else:
            rows.append((node, parent, owner, label, ordinal, *_scalar(value), path))
    return rows


def shred_json(df: DataFrame, id_col: str, json_col: str, lists: Sequence[str] = GRAPH_LISTS, under: Sequence[str] | None = None, rows_a_batch: int = 50_000) -> DataFrame:
    """The adjacency table of a column of JSON texts.

    Columns: id_col, node (preorder number in the document), parent (node above, -1 at the root), owner (nearest object
    above, -1 at the root), label (field name, an item has its list's), ordinal (from 0), kind (object, array, string,
    int, double, bool, null), scalar (text of a scalar) and path. Null, empty and invalid JSON give no rows; documents
    nested deeper than the parser allows count as invalid; of a field given twice in one object the last counts. Other
    columns of df, whatever their names, are not read. Rows that share an id are shredded each on their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", *(n for n, _ in _ADJACENCY)]
        types = [None, *(t for _, t in _ADJACENCY)]
        for batch in batches:
            ids, held, keys = batch.column(0), [], []

            def flush() -> pa.RecordBatch:
                columns = list(zip(*held)) if held else [()] * len(_ADJACENCY)
                arrays = [ids.take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types[1:]))]
                return pa.RecordBatch.from_arrays(arrays, names)

            for i, text in enumerate(batch.column(1).to_pylist()):
                found = walk_json(text, lists, under)
                held += found
                keys += [i] * len(found)
                if len(held) >= rows_a_batch:
                    yield flush()
                    held, keys = [], []
            yield flush()

    source = df.select(F.col(id_col).alias("doc"), F.col(json_col).cast("string").alias("json"))
    kind = source.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, node long, parent long, owner long, label string, ordinal long, kind string, scalar string, path string"
    return source.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def pivot_objects(nodes: DataFrame, id_col: str, path: str, labels: dict[str, Sequence[str]], keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per node at a path, a null or scalar list item included: its node, owner, ordinal and a column for each label's scalar child.

    ``labels`` maps an output column to the labels that may hold it, the first present one counting. A node without
    scalar children stays, with nulls. Nodes meet their children in one shuffle keyed by (document, node), which
    spreads even one huge document.
    """
    scalars = F.col("kind").isin("string", "int", "double", "bool")
    at = F.col("path") == path
    child = F.col("path").isin([f"{path}.{x}" for some in labels.values() for x in some]) & scalars
    rows = nodes.filter(at | child).withColumn("_at", F.when(at, F.col("node")).otherwise(F.col("owner")))
    picked = [F.coalesce(*(F.max(F.when(child & (F.col("label") == x), F.col("scalar"))) for x in some)).alias(name) for name, some in labels.items()]
    own = [F.max(F.when(at, F.col(c))).alias(c) for c in ("owner", "ordinal")]
    out = rows.groupBy(id_col, F.col("_at").alias("node")).agg(*own, *picked, F.max(at.cast("int")).alias("_item"))
    return out.filter("_item = 1").drop("_item").withColumns(keep or {})


def graph_entities(df: DataFrame, id_col: str = "export_id", json_col: str = "payload") -> dict[str, DataFrame]:
    """The flat tables of graph JSON: vertices, edges, nexuses, members and the properties of each kind.

    Every table has (document, node); a child table also has ``owner``, the node of its parent row, and ``item_pos``,
    its place in the parent's list. Ids come as numbers or strings and become longs, or null when they are neither.
    """
    nodes = shred_json(df, id_col, json_col, under=("vertices", "edges", "nexuses"))
    # The documents are parsed once, whatever tables are read.
    stored = shared_path(df.sparkSession, "nodes")
    nodes.write.option("compression", "zstd").parquet(stored)
    nodes = df.sparkSession.read.schema(nodes.schema).parquet(stored)
    number = lambda *names: {n: F.expr(f"try_cast({n} as bigint)") for n in names}
    prop = {"prop_key": ["key"], "cardinality": ["cardinality"], "value_type": ["type"], "prop_value": ["value"]}
    out = {
        "vertices": pivot_objects(nodes, id_col, "vertices[]", {"id": ["id"], "label": ["label"]}, number("id")),
        "edges": pivot_objects(nodes, id_col, "edges[]", {"id": ["id"], "type": ["type"], "source": ["source"], "target": ["target"]}, number("id", "source", "target")),
        "nexuses": pivot_objects(nodes, id_col, "nexuses[]", {"id": ["id"], "type": ["type"]}, number("id")),
        "members": pivot_objects(nodes, id_col, "nexuses[].members[]", {"role_name": ["role"], "vertex_id": ["vertex", "vertexId"]}, number("vertex_id")),
    }
    for kind, plural in (("vertex", "vertices"), ("edge", "edges"), ("nexus", "nexuses")):
        out[f"{kind}_properties"] = pivot_objects(nodes, id_col, f"{plural}[].properties[]", prop)
    return {k: v.withColumnRenamed("ordinal", "item_pos") for k, v in out.items()}


def list_items(df: DataFrame, id_col: str = "export_id", json_col: str = "payload") -> DataFrame:
    """One row per item of every member and property list of vertices and nexuses, with its parent's id.

    Columns: id_col, owner_kind, owner_id, child_list, item_pos, item_name (role or key) and vertex_id (the member's
    vertex, -1 for a property); an item that is no object has no name. Documents that share an id are exact repeats and count once.
    """
    nodes = shred_json(df.select(id_col, json_col).dropDuplicates([id_col]), id_col, json_col, under=("vertices", "nexuses"))
    path, parts = F.col("path"), {"vertex": "vertices[]", "nexus": "nexuses[]"}
    lists = [(kind, root, child) for kind, root in parts.items() for child in ("members", "properties") if (kind, child) != ("vertex", "members")]
    items = {f"{root}.{child}[]": (kind, child) for kind, root, child in lists}
    fields = {"item_name": ("role", "key"), "vertex": ("vertex", "vertexId")}
    wanted = [f"{p}.{x}" for p in items for some in fields.values() for x in some]
    scalars = F.col("kind").isin("string", "int", "double", "bool")
    is_item = path.isin(list(items))
    is_child = path.isin(wanted) & scalars
    is_owner_id = path.isin([f"{r}.id" for r in parts.values()]) & scalars
    # The documents are parsed once: what both sides of the join below need is stored, and read by columns.
    stored = shared_path(df.sparkSession, "nodes")
    nodes.filter(is_item | is_child | is_owner_id).drop("parent").write.option("compression", "zstd").parquet(stored)
    nodes = df.sparkSession.read.schema(nodes.drop("parent").schema).parquet(stored)
    # Item nodes meet their scalar children; the item row alone knows its owner and place.
    joined = (
        nodes.filter(is_item | is_child)
        .groupBy(id_col, F.when(is_item, F.col("node")).otherwise(F.col("owner")).alias("item"))
        .agg(
            F.max(F.when(is_item, path)).alias("path"),
            F.max(F.when(is_item, F.col("owner"))).alias("owner"),
            F.max(F.when(is_item, F.col("ordinal"))).alias("item_pos"),
            *(F.coalesce(*(F.max(F.when(is_child & (F.col("label") == x), F.col("scalar"))) for x in some)).alias(name) for name, some in fields.items()),
        )
        .filter(F.col("path").isNotNull())
    )
    owners = nodes.filter(is_owner_id).select(id_col, "owner", F.expr("try_cast(scalar as bigint)").alias("owner_id"))
    named = lambda of: F.coalesce(*(F.when(F.col("path") == p, F.lit(of(v))) for p, v in items.items()))
    return joined.join(owners, [id_col, "owner"], "left").select(
        id_col,
        named(lambda v: v[0]).alias("owner_kind"),
        "owner_id",
        named(lambda v: v[1]).alias("child_list"),
        "item_pos",
        "item_name",
        F.when(F.col("path").endswith(".members[]"), F.expr("try_cast(vertex as bigint)")).otherwise(F.lit(-1)).alias("vertex_id"),
    )
