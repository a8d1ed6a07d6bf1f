import json

from filigree.operators.shred import graph_entities, list_items, shred_json, walk_json

DOC = {
    "vertices": [{"id": "7", "label": "A", "properties": {"key": "k", "value": [1, 2]}}, {"id": 8, "label": "A", "properties": None}],
    "nexuses": {"id": 7, "members": [{"role": "r", "vertexId": "8"}, {"role": "s", "vertex": None}], "properties": [{"key": "p", "value": 1.5}, {"key": "q"}]},
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "export_id long, payload string, node string, label string")


def test_list_items(spark):
    text = json.dumps(DOC)
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (2, None, "", ""), (3, "", "", ""), (4, text[:-9], "", ""), (5, "[]", "", ""), (6, '{"vertices": [], "nexuses": null}', "", "")]
    got = {tuple(r) for r in list_items(frame(spark, rows)).collect()}
    assert got == {
        (1, "vertex", 7, "properties", 0, "k", -1),
        (1, "nexus", 7, "members", 0, "r", 8),
        (1, "nexus", 7, "members", 1, "s", None),
        (1, "nexus", 7, "properties", 0, "p", -1),
        (1, "nexus", 7, "properties", 1, "q", -1),
    }


def test_entities_keep_links(spark):
    got = graph_entities(frame(spark, [(1, json.dumps(DOC), "", "")]))
    vertices = {r["node"]: r for r in got["vertices"].collect()}
    props = got["vertex_properties"].collect()
    assert [(vertices[p["owner"]]["id"], p["item_pos"], p["prop_key"], p["prop_value"]) for p in props] == [(7, 0, "k", None)]
    assert sorted((p["prop_key"], p["prop_value"]) for p in got["nexus_properties"].collect()) == [("p", "1.5"), ("q", None)]
    assert [r["role_name"] for r in got["members"].orderBy("item_pos").collect()] == ["r", "s"]
    assert got["edges"].count() == 0


def test_adjacency_rebuilds_the_document():
    rows = walk_json(json.dumps(DOC), lists=())
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)

    def build(r):
        if r[5] == "object":
            return {c[3]: build(c) for c in kids.get(r[0], [])}
        if r[5] == "array":
            return [build(c) for c in sorted(kids.get(r[0], []), key=lambda c: c[4])]
        return {"null": lambda x: None, "int": int, "double": float, "string": str, "bool": lambda x: x == "true"}[r[5]](r[6])

    assert build(rows[0]) == DOC


def test_hostile_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert walk_json(deep) == [] and walk_json('{"a": NaN}') == [] and walk_json('{"a": 1} x') == []
    assert walk_json('{"a": "\\ud800"}')[1][6] == "?"
    assert walk_json('{"a": 1, "a": 2}')[1][6] == "2"
    wide = json.dumps({"vertices": [{"id": i} for i in range(3000)]})
    got = shred_json(frame(spark, [(1, wide, "", "")]), "export_id", "payload", rows_a_batch=500)
    assert got.count() == 2 + 2 * 3000 and got.select("node").distinct().count() == got.count()
    assert list_items(frame(spark, [])).count() == 0


def test_items_of_any_kind_and_long_integers(spark):
    long = "9" * 5_000
    text = '{"vertices": [null, {"id": 1, "big": %s, "properties": [null, 5, {"key": "k"}]}], "nexuses": [{"id": 2, "members": ["x", {"role": "r", "vertex": 1}]}]}' % long
    df = frame(spark, [(1, text, "", "")])
    assert sorted((r.owner_kind, r.owner_id, r.item_pos, r.item_name or "", r.vertex_id) for r in list_items(df).collect()) == [
        ("nexus", 2, 0, "", None), ("nexus", 2, 1, "r", 1), ("vertex", 1, 0, "", -1), ("vertex", 1, 1, "", -1), ("vertex", 1, 2, "k", -1)
    ]
    assert sorted((r.item_pos, r.id) for r in graph_entities(df)["vertices"].collect()) == [(0, None), (1, 1)]
    assert [r[5:7] for r in walk_json(text) if r[3] == "big"] == [("int", long)]
