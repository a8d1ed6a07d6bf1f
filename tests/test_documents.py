import json
import shutil

import pytest
from pyspark.sql import functions as F

from filigree.graph import PropertyGraph
from filigree.operators import mutations as M
from filigree.rag.chunker import Options, chunk, chunk_documents
from filigree.rag.store import Store, merge_ranges, metadata_of
from filigree.sources import graph_json as J
from filigree.streaming.replay import SCHEMA, apply_batch, replay


def block(kind, text, level=None, page=None):
    return {"kind": kind, "text": text, "heading_level": level, "page": page}


def test_chunker():
    blocks = [block("Heading", "A", 1), block("Paragraph", "one", None, 3), block("Paragraph", "two"), block("Heading", "B", 2), block("Table", "t" * 30), block("Paragraph", ""), block("Paragraph", "word " * 20), block("Heading", "C", 1), block("Paragraph", "😀" * 25), None]
    source = "\n\n".join((b or {}).get("text") or "" for b in blocks).encode("utf-16-le")
    got = chunk(blocks, Options(target=40, overlap=10))
    for _, _, _, a, b, text in got:
        assert source[2 * a : 2 * b].decode("utf-16-le") == text and (b - a <= 40 or text[0] == "t")
    assert got[0][1:3] == ("A", 3) and got[0][5] == "one\n\ntwo" and got[1][1] == "A > B" and got[1][5] == "t" * 30 and got[-1][1] == "C"
    words = [g for g in got if g[5].startswith("word")]
    assert all(g[5].endswith(" ") for g in words[:-1]) and all(b[3] < a[4] for a, b in zip(words, words[1:]))
    assert len(chunk(blocks, Options(40, 10, 16))) > len(got) and chunk(None) == [] and chunk([]) == []
    with pytest.raises(ValueError):
        Options(10, 10)


def ingested(spark, rows):
    return spark.createDataFrame(rows, "source_id string, title string, metadata map<string,string>, content_revision string, blocks array<struct<kind:string,text:string,heading_level:int,page:int>>")


def test_store(spark):
    rows = [("s1", "One", {"k": "x"}, "r1", [("Heading", "Head", 1, None), ("Paragraph", "graph engine " * 8, None, 1), ("Table", "vector table", None, None), ("Paragraph", "tail words", None, None)]), ("s2", "Two", None, None, [("Paragraph", "a vector engine", None, None)]), ("s3", None, {}, None, None)]
    store = Store.ingest(ingested(spark, rows))
    assert sorted((r.source_id, r.ordinal) for r in store.chunks.collect()) == [("s1", 0), ("s1", 1), ("s1", 2), ("s2", 0)]
    hit = store.search("vector", k=5).collect()
    assert {r.source_id for r in hit} == {"s1", "s2"}
    assert [r.source_id for r in store.search("vector", k=5, metadata_equals={"k": "x"}).collect()] == ["s1"]
    assert [r.source_id for r in store.search("vector", k=5, metadata_filter=F.col("title") == "Two").collect()] == ["s2"]
    wide = store.search("vector", k=5, neighbours=1, metadata_equals={"k": "x"}).collect()
    near = merge_ranges(spark.createDataFrame([("s1", 0, 2.0), ("s1", 1, 5.0), ("s2", 0, 1.0)], "source_id string, ordinal int, score double"), store.chunks, 0)
    assert sorted((r.source_id, r.first, r.last, r.score) for r in near.collect()) == [("s1", 0, 1, 5.0), ("s2", 0, 0, 1.0)]
    assert [(r.first, r.last) for r in wide] == [(0, 2)] and wide[0].text.endswith("vector table\n\ntail words")
    embedded = store.with_embeddings(lambda s: s.map(lambda t: [float(len(t)), 1.0]))
    assert embedded.search("engine", vector=[1.0, 0.0], k=3).count() > 0
    ids = lambda s: {(r.source_id, r.ordinal): r.chunk_id for r in s.chunks.collect()}
    same = store.upsert(ingested(spark, [(rows[1][0], "Zwei", *rows[1][2:])]))
    assert ids(same) == ids(store) and same.documents.filter("source_id = 's2'").first().title == "Zwei"
    other = store.upsert(ingested(spark, [("s2", "Two", None, None, [("Paragraph", "new text", None, None)])]))
    assert ids(other)["s2", 0] != ids(store)["s2", 0] and ids(other)["s1", 0] == ids(store)["s1", 0]
    assert store.delete(spark.createDataFrame([("s1",)], "source_id string")).chunks.count() == 1
    assert chunk_documents(ingested(spark, []), "source_id", "blocks").count() == 0
    m = spark.createDataFrame([('{"a": "b"}',), ("{",), (None,)], "j string").select(metadata_of(F.col("j")).alias("m")).collect()
    assert [r.m for r in m] == [{"a": "b"}, {}, {}]


def small(spark):
    v = spark.createDataFrame([(1, "P", "Ann", 2**40, [1.5, float("inf")], ["x", "y"], bytearray(b"\x01"), True), (2, "P", None, None, None, None, None, None)], "id long, label string, name string, big long, vec array<float>, tags array<string>, raw binary, ok boolean")
    e = spark.createDataFrame([(1, 1, 2, "R", 2.5)], "id long, src long, dst long, type string, w double")
    n = spark.createDataFrame([(1, "F")], "id long, type string")
    i = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "nexus_id long, role string, vertex_id long")
    return PropertyGraph(v, e, n, i)


def test_graph_json_round_trip(spark):
    g = small(spark)
    text = J.export_text(g, "db1", "s1", drop_types=("floatArray",))
    doc = json.loads(text)
    assert [p for p in doc["vertices"][0]["properties"] if p["key"] == "tags"] == [{"key": "tags", "cardinality": "set", "type": "string", "value": x} for x in "xy"]
    assert list(doc) == ["format", "version", "source", "schema", "vertices", "edges", "nexuses"] and doc["edges"][0]["source"] == "1"
    docs = spark.createDataFrame([(text,), (text,), (text.replace("db1", "db2"),)], "payload string")
    back = J.import_documents(spark, docs)
    assert back.vertices.count() == 4 and back.edges.count() == 2 and back.incidence.count() == 4
    rows = sorted((r.name, r.big, r.tags, bytes(r.raw), r.ok) for r in back.vertices.collect() if r.name)
    assert rows == [("Ann", 2**40, ["x", "y"], b"\x01", True)] * 2
    assert back.edges.join(back.vertices.select(F.col("id").alias("src")), "src").count() == 2
    only = json.loads(J.export_text(g, "d", "s", keys={"name"}))
    assert {p["key"] for v in only["vertices"] for p in v["properties"]} == {"name"}


def test_strict_import(spark):
    doc = json.loads(J.export_text(small(spark), "db1", "s1"))

    def broken(change):
        d = json.loads(json.dumps(doc))
        change(d)
        return json.dumps(d)

    bad = [
        broken(lambda d: d.update(extra=1)), broken(lambda d: d.pop("edges")), broken(lambda d: d["vertices"][0].update(label="Q")), broken(lambda d: d["edges"][0].update(target="9")),
        broken(lambda d: d["nexuses"][0]["members"].pop()), broken(lambda d: d["vertices"].append(d["vertices"][0])), broken(lambda d: d.update(version=2)), json.dumps(doc) + "x", json.dumps(doc)[:-5],
        broken(lambda d: d["vertices"][0]["properties"][0].update(cardinality="odd")), '{"format": 1, "format": 2}', json.dumps({k: doc[k] for k in ("vertices", *[x for x in doc if x != "vertices"])}),
    ]
    for text in bad:
        with pytest.raises(J.GraphJsonError):
            J.check_document(text)
    clash = broken(lambda d: d["vertices"][1].update(properties=[{"key": "name", "cardinality": "single", "type": "string", "value": "Z"}]))
    with pytest.raises(J.GraphJsonError):
        J.import_documents(spark, spark.createDataFrame([(json.dumps(doc),), (clash,)], "payload string"))


def test_semantic_merge(spark):
    kind = "id long, label string, name string, age int"
    edges = "id long, src long, dst long, type string"
    a = PropertyGraph.of(spark.createDataFrame([(1, "P", "Ann", 3), (2, "P", "Bob", None)], kind), spark.createDataFrame([(1, 1, 2, "R")], edges))
    b = PropertyGraph.of(spark.createDataFrame([(11, "P", "Ann", 4), (12, "P", "Cid", 5)], kind), spark.createDataFrame([(11, 11, 12, "R")], edges))
    rule = [J.MergeRule("P", "name")]
    with pytest.raises(J.GraphJsonError):
        J.semantic_merge(a, b, rule)
    for policy, age in (("keep", 3), ("overwrite", 4)):
        m = J.semantic_merge(a, b, rule, policy)
        assert {r.name: r.age for r in m.vertices.collect()} == {"Ann": age, "Bob": None, "Cid": 5}
        assert sorted((r.src, r.dst) for r in m.edges.collect()) == [(1, 2), (1, 12)]
    with pytest.raises(J.GraphJsonError):
        J.semantic_merge(a, b.with_tables(vertices=b.vertices.unionByName(b.vertices.withColumn("id", F.col("id") + 100))), rule, "keep")


def test_change_feed(spark, tmp_path):
    rows = [
        (1, "create", "vertex", 10, None, None, "P", None, None, None), (2, "create", "vertex", 11, None, None, "P", None, None, None), (3, "create", "edge", 5, 10, 11, "R", None, None, None),
        (4, "set", "vertex", 10, None, None, None, "name", "old", None), (5, "set", "vertex", 10, None, None, None, "name", "new", None), (6, "create", "nexus", 7, None, None, "F", None, None, [("a", 10), ("b", 11)]),
    ]
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    empty = PropertyGraph.of(spark.createDataFrame([], "id long, label string, name string"), spark.createDataFrame([], "id long, src long, dst long, type string"))
    g = apply_batch(empty, frame(rows))
    assert {r.id: r.name for r in g.vertices.collect()} == {10: "new", 11: None} and g.edges.count() == 1 and g.incidence.count() == 2
    g = apply_batch(g, frame([(7, "delete", "vertex", 11, None, None, None, None, None, None), (8, "remove", "vertex", 10, None, None, None, "name", None, None)]))
    assert [(r.id, r.name) for r in g.vertices.collect()] == [(10, None)] and g.edges.count() == 0 and g.nexuses.count() == 0
    versions = M.Versions(spark, str(tmp_path / "v"))
    versions.commit(empty)
    frame(rows[:3]).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "feed"))
    replay(spark, feed, versions, str(tmp_path / "c")).awaitTermination(120)
    frame(rows[3:]).write.mode("append").parquet(str(tmp_path / "feed"))
    replay(spark, feed, versions, str(tmp_path / "c")).awaitTermination(120)
    assert versions.latest() == 3 and versions.open().vertices.filter("name = 'new'").count() == 1 and versions.open().nexuses.count() == 1
    # A restart after a batch was committed and before the stream knew: the batch comes again and changes nothing.
    shutil.copytree(tmp_path / "c", tmp_path / "c2")
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "c2" / name).unlink(missing_ok=True)
    replay(spark, feed, versions, str(tmp_path / "c2")).awaitTermination(120)
    assert versions.latest() == 3 and versions.about()["batch"] == 1


def test_a_crash_before_the_marker_blocks_nobody(spark, tmp_path):
    versions = M.Versions(spark, str(tmp_path / "v"))
    g = PropertyGraph.of(spark.createDataFrame([(1, "P")], "id long, label string"), spark.createDataFrame([], "id long, src long, dst long, type string"))
    assert versions.latest() == 0 and versions.about()["batch"] == -1
    versions.write(g)
    (tmp_path / "v" / "draft-x").write_text("{")
    assert versions.latest() == 0 and versions.commit(g) == 1 and versions.open().vertices.count() == 1
    steps = M.Migrator([(2, "rename", lambda g: g.relabel("P", "Q")), (1, "same", lambda g: g)])
    assert steps.apply(versions) == [(1, "same"), (2, "rename")] and steps.apply(versions) == [] and versions.latest() == 2
    assert versions.about()["migrations"] == [[1, "same"], [2, "rename"]] and versions.open().vertices.first().label == "Q"
    assert versions.commit(versions.open()) == 3 and versions.about()["migrations"] == [[1, "same"], [2, "rename"]]


def test_new_ids_are_numbered_over_ranges(spark):
    g = PropertyGraph.of(spark.createDataFrame([(5, "P")], "id long, label string"), spark.createDataFrame([(7, 5, 5, "R")], "id long, src long, dst long, type string"))
    pairs = spark.range(3000).selectExpr("id % 100 as src", "id as dst").repartition(7)
    made, n = M.connect(g, pairs, "S")
    rows = sorted((r.src, r.dst, r.id) for r in made.edges.filter("type = 'S'").collect())
    assert n == 3000 and [r[2] for r in rows] == list(range(8, 3008)) and M.connect(g, pairs.limit(0), "S")[1] == 0
