import pytest
from pyspark.sql import functions as F

from filigree.functions.predicates import P
from filigree.graph import PropertyGraph, induced, read_snapshot, write_snapshot
from filigree.operators import mutations as M
from filigree.operators import paths, stats
from filigree.operators.match import EdgePattern, Match, NexusPattern, VertexPattern, triangle_join, triangles
from filigree.operators.tools import schema, traverse

ALICE, BOB, CAROL, ACME = 1, 2, 3, 4


@pytest.fixture(scope="module")
def people(spark):
    v = spark.createDataFrame([(ALICE, "Person", "Alice", 30, ["a", "b"]), (BOB, "Person", "Bob", None, None), (CAROL, "Person", "Carol", 25, ["b"]), (ACME, "Company", "Acme", None, None)], "id long, label string, name string, age int, tags array<string>")
    e = spark.createDataFrame([(1, ALICE, BOB, "KNOWS", 10.0), (2, BOB, CAROL, "KNOWS", 1.0), (3, ALICE, ACME, "WORKS_AT", None), (4, ALICE, BOB, "KNOWS", 3.0), (5, CAROL, CAROL, "KNOWS", 1.0)], "id long, src long, dst long, type string, w double")
    n = spark.createDataFrame([(1, "Fact"), (2, "Event"), (3, "Fact")], "id long, type string")
    i = spark.createDataFrame([(1, "subject", ALICE), (1, "object", BOB), (2, "actor", ALICE), (2, "target", ALICE), (3, "subject", ALICE), (3, "object", BOB), (3, "object", CAROL)], "nexus_id long, role string, vertex_id long")
    return PropertyGraph(v, e, n, i)


def ids(t):
    return sorted(t.to_list())


def test_expansion_is_a_bag(people):
    q = people.query()
    assert ids(q.vertex(ALICE).out("KNOWS")) == [BOB, BOB]
    assert ids(q.vertex(CAROL).both()) == [BOB, CAROL] and ids(q.vertex(CAROL).in_()) == [BOB, CAROL] and ids(q.vertex(CAROL).out()) == [CAROL]
    assert ids(q.vertex(ALICE).out_edges("KNOWS")) == [1, 4] and ids(q.vertex(BOB).in_edges().other_vertex()) == [BOB, BOB]
    assert ids(q.vertices([BOB, ALICE, BOB, 99])) == [ALICE, BOB, BOB] and q.vertices([BOB, ALICE]).to_list() == [BOB, ALICE]
    assert ids(q.vertices().out_where("KNOWS", "w", P.gt(2.0))) == [BOB, BOB]
    assert {r.weight for r in q.vertex(ALICE).expand_full("out", None, "w").collect()} == {10.0, 3.0, None}


def test_order_puts_absent_values_last(people):
    q = people.query().vertices().has_label("Person")
    assert q.order_by("age").to_list() == [CAROL, ALICE, BOB] and q.order_by("age", descending=True).to_list() == [ALICE, CAROL, BOB]
    assert q.order_by("age", descending=True, absent_last=False).to_list() == [BOB, ALICE, CAROL]
    assert q.order_by("age").range(1, 3).to_list() == [ALICE, BOB] and q.order_by("age").skip(2).to_list() == [BOB]
    with pytest.raises(ValueError):
        q.limit(-1)
    with pytest.raises(LookupError):
        q.has("name", "Nobody").next()
    assert q.has("name", "Bob").first() == BOB and not q.has("age", P.gt(90)).has_next() and list(q.has("age", P.gt(26)).cursor()) == [ALICE]


def test_terminals(people):
    q = people.query().vertices()
    one = lambda df: df.first()[0]
    assert one(q.sum("age")) == 55.0 and one(q.sum_long("age")) == 55 and one(q.max("age")) == 30.0 and one(q.mean("age")) == 27.5
    assert one(q.has_label("X").sum("age")) == 0.0 and one(q.has_label("X").max("age")) is None and one(q.sum("name")) == 0.0 and one(q.sum_long("missing")) == 0
    assert {tuple(r) for r in q.group_count("tags").collect()} == {("a", 1), ("b", 2)} and q.group_count("age").count() == 0
    assert {tuple(r) for r in q.values("age").collect()} == {(1, 30), (2, None), (3, 25), (4, None)}
    assert q.label().filter("label = 'Company'").first().id == ACME and q.count() == 4


def test_sub_traversals_and_branches(people):
    q = people.query().vertices([ALICE, BOB, BOB, CAROL, ACME])
    assert ids(q.where(lambda s: s.out("WORKS_AT"))) == [ALICE] and ids(q.not_(lambda s: s.out("KNOWS"))) == [ACME]
    assert ids(q.and_(lambda s: s.out("KNOWS"), lambda s: s.in_("KNOWS").has("name", "Alice"))) == [BOB, BOB]
    assert ids(q.or_(lambda s: s.out("WORKS_AT"), lambda s: s.in_("WORKS_AT"))) == [ALICE, ACME]
    assert ids(q.union(lambda s: s.out("KNOWS"), lambda s: s.out("WORKS_AT"))) == [BOB, BOB, CAROL, CAROL, CAROL, ACME]
    assert ids(q.coalesce(lambda s: s.out("WORKS_AT"), lambda s: s.out("KNOWS"))) == [CAROL, CAROL, CAROL, ACME]
    assert ids(q.optional(lambda s: s.out("WORKS_AT"))) == [BOB, BOB, CAROL, ACME, ACME]


def test_nexus_steps(people):
    q = people.query()
    assert ids(q.vertex(ALICE).nexuses()) == [1, 2, 2, 3] and ids(q.vertex(ALICE).nexuses("Fact", "subject")) == [1, 3]
    assert ids(q.nexus(3).members("object")) == [BOB, CAROL] and ids(q.vertex(ALICE).nexuses("Fact").other_members()) == [BOB, BOB, CAROL]
    assert ids(q.vertex(ALICE).nexuses("Event").other_members()) == []
    assert sorted(r.nexus_id for r in people.nexuses_of(ALICE).collect()) == [1, 2, 3] and people.members_of(3, "object").count() == 2
    with pytest.raises(ValueError):
        q.nexuses().other_members()


def test_aliases(people):
    rows = people.query().vertices().as_("a").out("KNOWS").as_("b").out("KNOWS").as_("c").tuples("a", "b", "c").collect()
    assert sorted(map(tuple, rows)) == [(ALICE, BOB, CAROL)] * 2 + [(BOB, CAROL, CAROL), (CAROL, CAROL, CAROL)]
    assert ids(people.query().vertices().as_("a").out("WORKS_AT").select("a")) == [ALICE]


def test_match(people):
    V = VertexPattern
    assert Match(people, (V("a", "Person"),)).count() == 3
    rows = Match(people, (EdgePattern(V("a", "Person"), V("b", "Person"), "KNOWS", "x"),)).where("x", "w", P.gte(2.0)).to_df().collect()
    assert sorted((r.a, r.b, r.x) for r in rows) == [(ALICE, BOB, 1), (ALICE, BOB, 4)]
    star = Match(people, (NexusPattern("f", "Fact", (("object", V("x")), ("object", V("y")))),))
    assert sorted((r.f, r.x, r.y) for r in star.to_df().collect()) == [(1, BOB, BOB), (3, BOB, BOB), (3, BOB, CAROL), (3, CAROL, BOB), (3, CAROL, CAROL)]
    names = Match(people, (EdgePattern(V("a"), V("b"), "WORKS_AT"),)).select(("a", "name"), ("b", "name")).collect()
    assert [tuple(r) for r in names] == [("Alice", "Acme")]
    for bad in ((EdgePattern(V("a"), V("a")),), (NexusPattern("f", None, (("", V("x")),)),), (V("a"), V("b"))):
        with pytest.raises(ValueError):
            Match(people, bad)
    with pytest.raises(KeyError):
        Match(people, (V("a"),)).where("z", "name", P.present())


def test_triangles(spark):
    n = 6
    r = spark.createDataFrame([(a, 100 + b) for a in range(n) for b in range(n)] + [(0, 100)], "a long, b long")
    s = spark.createDataFrame([(100 + b, 200 + c) for b in range(n) for c in range(n)], "b long, c long")
    t = spark.createDataFrame([(200 + c, c) for c in range(n)], "c long, a long")
    got = triangle_join(r, s, t).collect()
    assert len(got) == n * n + 1 and len(set(got)) == n * n
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (4, 1), (4, 2), (5, 5), (4, 3)], "src long, dst long")
    assert sorted(map(tuple, triangles(e).collect())) == [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]


def test_paths(spark, people):
    start = spark.createDataFrame([(ALICE,)], "start long")
    assert {(r.end, r.depth) for r in paths.bfs(people, start, 5, edge_type="KNOWS").collect()} == {(BOB, 1), (CAROL, 2)}
    assert ids(people.query().vertex(ALICE).repeat("out", 2)) == [CAROL] and ids(people.query().vertex(ALICE).repeat("out", 2, emit=True)) == [BOB, CAROL, ACME]
    assert [tuple(r) for r in people.query().vertices([ALICE, ACME]).shortest_path_to(CAROL, 3).select("source", "target", "distance").collect()] == [(ALICE, CAROL, 2)]
    same = paths.shortest_paths(people, spark.createDataFrame([(BOB, BOB)], "source long, target long"), 3).collect()
    assert [r.distance for r in same] == [0]
    tree = paths.weighted_paths(people, spark.createDataFrame([(ALICE,)], "source long"), "w")
    assert {r.target: r.distance for r in tree.collect()} == {ALICE: 0.0, BOB: 3.0, CAROL: 4.0, ACME: 1.0}
    assert paths.path_of(tree, ALICE, CAROL) == ([ALICE, BOB, CAROL], [4, 2]) and paths.path_of(tree, ALICE, 77) == ([], [])
    assert {r.target for r in paths.weighted_paths(people, spark.createDataFrame([(ALICE,)], "source long"), "w", max_distance=3.5).collect()} == {ALICE, BOB, ACME}
    bad = people.with_tables(edges=people.edges.withColumn("w", F.lit(-1.0)))
    with pytest.raises(ValueError):
        paths.weighted_paths(bad, spark.createDataFrame([(ALICE,)], "source long"), "w")
    ranks = {r.id: r.rank for r in paths.pagerank(people).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[CAROL] == max(ranks.values())
    far = spark.range(1).select(paths.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("m")).first().m
    assert abs(far - 3.141592653589793 / 2 * paths.EARTH_RADIUS_M) < 1


def test_coordinates_cut_the_search(spark):
    v = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "id long, x double, y double").withColumn("label", F.lit("P"))
    e = spark.createDataFrame([(10 + i, i, j, "R", 1.0) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "id long, src long, dst long, type string, w double")
    g = PropertyGraph.of(v, e)
    bound = paths.coordinate_potential(g, 5, "x", "y")
    found = paths.weighted_paths(g, spark.createDataFrame([(2,)], "source long"), "w", max_distance=3.0, potential=bound)
    assert {r.target: r.distance for r in found.collect()} == {2: 0.0, 3: 1.0, 4: 2.0, 5: 3.0}
    with pytest.raises(ValueError):
        paths.coordinate_potential(g.with_tables(vertices=v.withColumn("x", F.lit(None).cast("double"))), 5, "x", "y")


def test_mutations(spark, people):
    frame = spark.createDataFrame
    g = M.delete_vertices(people, frame([(BOB,)], "id long"))
    assert sorted(r.id for r in g.edges.collect()) == [3, 5] and sorted(r.id for r in g.nexuses.collect()) == [2] and g.vertices.count() == 3
    g = M.set_property(people, "vertex", "age", frame([(BOB, 40)], "id long, value int"))
    assert g.vertices.filter("id = 2").first().age == 40 and people.vertices.filter("id = 2").first().age is None
    g = M.add_value(people, "vertex", "tags", frame([(BOB, "z"), (ALICE, "a"), (ALICE, "c")], "id long, value string"))
    assert {r.id: r.tags for r in g.vertices.collect()} == {ALICE: ["a", "b", "c"], BOB: ["z"], CAROL: ["b"], ACME: None}
    g = M.remove_value(g, "vertex", "tags", frame([(BOB, "z"), (ALICE, "a")], "id long, value string"))
    assert {r.id: r.tags for r in g.vertices.collect()} == {ALICE: ["b", "c"], BOB: None, CAROL: ["b"], ACME: None}
    assert M.remove_property(people, "vertex", "age", frame([(ALICE,)], "id long")).vertices.filter("age is not null").count() == 1
    with pytest.raises(TypeError):
        M.set_property(people, "vertex", "tags", frame([(1, "x")], "id long, value string"))
    g = M.merge_edges(people, frame([(ALICE, BOB, "KNOWS"), (BOB, ALICE, "KNOWS"), (BOB, ALICE, "KNOWS")], "src long, dst long, type string"))
    assert g.edges.count() == 6 and g.edges.filter("id > 5").first().src == BOB
    g, made = M.connect(people, frame([(ALICE, CAROL), (ALICE, CAROL)], "src long, dst long"), "SAW", merge=True)
    assert made == 1 and M.connect(people, frame([(ALICE, CAROL)] * 2, "src long, dst long"), "SAW")[1] == 2
    g = M.merge_vertices(people, "Person", "name", frame([("Bob",), ("Dora",), ("Dora",)], "value string"))
    assert sorted(r.name for r in g.vertices.filter("label = 'Person'").collect()) == ["Alice", "Bob", "Carol", "Dora"]
    kind = "type string, members array<struct<role:string,vertex_id:long>>"
    g = M.merge_nexuses(people, frame([("Fact", [("object", BOB), ("subject", ALICE)]), ("Fact", [("object", CAROL), ("subject", ALICE)])], kind))
    assert g.nexuses.count() == 4
    g = M.replace_vertices(people, frame([(BOB, 50)], "old long, new long"))
    assert g.edges.filter("dst = 50").count() == 2 and g.incidence.filter("vertex_id = 50").count() == 2
    M.check_unique(people, "Person", "name")
    with pytest.raises(ValueError):
        M.check_unique(M.set_property(people, "vertex", "name", frame([(BOB, "Alice")], "id long, value string")), "Person", "name")
    b = M.Builder(people)
    x = b.vertex("Person", name="Eve", age=5)
    b.edge("KNOWS", x, ALICE, w=2.0)
    b.nexus("Fact", ("subject", x), ("object", ALICE))
    g = b.apply()
    assert ids(g.query().vertices().has("name", "Eve").out("KNOWS")) == [ALICE] and g.nexuses.count() == 4
    with pytest.raises(ValueError):
        bad = M.Builder(people)
        bad.nexus("Fact", ("subject", ALICE))
        bad.apply()
    _, done = M.Migrator([(2, "b", lambda g: g), (1, "a", lambda g: g.relabel("Person", "Human"))]).run(people, 1)
    assert done == [(2, "b")] and people.relabel("Person", "Human").vertices.filter("label = 'Human'").count() == 3


def test_versions_and_snapshots(spark, people, tmp_path):
    v = M.Versions(spark, str(tmp_path / "versions"))
    assert v.latest() == 0 and v.commit(people) == 1
    changed = M.delete_vertices(v.open(), spark.createDataFrame([(BOB,)], "id long"))
    assert v.commit(changed) == 2 and v.open().vertices.count() == 3 and v.open(1).vertices.count() == 4
    write_snapshot(people, str(tmp_path / "s"))
    assert read_snapshot(spark, str(tmp_path / "s")).edges.count() == 5


def test_induced_and_statistics(spark, people):
    sub = induced(people, spark.createDataFrame([(ALICE,), (BOB,)], "id long"))
    assert sorted(r.id for r in sub.edges.collect()) == [1, 4] and sorted(r.id for r in sub.nexuses.collect()) == [1, 2]
    assert induced(people, nexuses=spark.createDataFrame([(3,)], "id long")).vertices.count() == 3
    assert {r.id: r.degree for r in stats.degrees(people).collect()} == {ALICE: 3, BOB: 3, CAROL: 2, ACME: 1}
    assert stats.consistency(people) == {"repeated_vertices": 0, "repeated_edges": 0, "dangling_edges": 0, "dangling_members": 0, "small_nexuses": 0}
    broken = people.with_tables(vertices=people.vertices.filter("id <> 2"))
    assert stats.consistency(broken)["dangling_edges"] == 3 and stats.dangling_members(broken).count() == 2
    assert stats.order_hops(people, ["KNOWS", "WORKS_AT"]) == ["WORKS_AT", "KNOWS"] and stats.estimate_fanout(people, "KNOWS") == 1.0
    rows = {r.key: r for r in stats.property_stats(people, exact=True).collect()}
    assert rows["age"].owners == 2 and rows["age"].lowest == "25" and rows["tags"]["values"] == 3
    assert {(r.kind, r["name"]) for r in schema(people).collect()} >= {("vertex", "Person"), ("edge", "KNOWS"), ("nexus", "Event")}
    assert ids(traverse(people, ("label", "Person"), [("out", "KNOWS", None, {"age": P.lt(29)})])) == [CAROL]
