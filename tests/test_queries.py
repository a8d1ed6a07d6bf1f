"""Registered queries over small tables of the shapes that only larger ones had."""

import pytest
from pyspark.sql import functions as F

from filigree.operators import fulltext
from filigree.plans.catalog import QUERIES

PROPERTIES = "array<struct<prop_key: string, cardinality: string, value_type: string, prop_value: string>>"
SCHEMAS = {
    "graph_vertices": f"vertex_id long, vertex_label string, properties {PROPERTIES}, arrived_at timestamp",
    "topic_vertices": "vertex_id long, vertex_label string",
    "graph_edges": "edge_id long, source_vertex_id long, target_vertex_id long, edge_type string",
    "graph_nexuses": "nexus_id long, nexus_type string, members array<struct<role_name: string, vertex_id: long>>",
}


@pytest.fixture
def domain(spark, tmp_path):
    """Writes the domain tables; those not given are empty."""

    def write(**tables):
        for name, schema in SCHEMAS.items():
            df = tables.get(name, [])
            df = spark.createDataFrame(df, schema) if isinstance(df, list) else df
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def most_rows(df):
    """The rows of df, and the most rows that any operator of its plan gave."""
    rows = df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from walk(node.plan())
        else:
            if node.metrics().contains("numOutputRows"):
                yield node.metrics().apply("numOutputRows").value()
            for i in range(node.children().size()):
                yield from walk(node.children().apply(i))

    return rows, max(walk(df._jdf.queryExecution().executedPlan()))


def test_sums_over_members_outgrow_a_long(spark, domain):
    big = 1 << 57
    d = domain(graph_nexuses=[(k, "Fact", [("subject", big + k), ("object", big + 9)]) for k in range(3)])
    total = sum((big + k) * 31 + 7 + (big + 9) * 31 + 6 for k in range(3))
    assert total > 2**63
    assert sorted((r.type, r.n, r.members, int(r.total)) for r in QUERIES["w7_merge_nexuses"](spark, d).collect()) == [("Claim", 3, 6, total), ("Fact", 3, 6, total)]


def test_reachability_has_no_limit(spark, domain):
    """More vertices than the limit an interactive search has."""
    n = 100_050
    d = domain(
        graph_vertices=spark.createDataFrame([(0, "Team", None, None)], SCHEMAS["graph_vertices"]),
        graph_edges=spark.range(1, n).select(F.col("id").alias("edge_id"), (F.col("id") % 3 * (F.col("id") > 9).cast("long")).alias("source_vertex_id"), F.col("id").alias("target_vertex_id"), F.lit("CITES").alias("edge_type")),
    )
    got = QUERIES["g1_reachable"](spark, d)
    assert got.count() == got.distinct().count() == n


def test_pairs_without_a_path_are_never_made(spark, domain):
    n = 400
    teams, releases, middle = (list(range(base, base + n)) for base in (1000, 2000, 3000))
    links = [*zip(teams, middle), *zip(middle, releases), (teams[0], releases[0]), *zip(releases[:4], releases[1:5])]
    d = domain(
        graph_vertices=[(v, label, None, None) for label, vs in (("Team", teams), ("Release", releases), ("Chunk", middle)) for v in vs],
        graph_edges=[(k, a, b, "CITES") for k, (a, b) in enumerate(links)],
    )
    rows, most = most_rows(QUERIES["path_3_shortest"](spark, d))
    want = {(t, r): 2 for t, r in zip(teams, releases)} | {(teams[0], releases[k]): k + 1 for k in range(4)}
    want |= {(teams[k], releases[j]): 2 + j - k for k in (1, 2, 3) for j in range(k, 5) if 2 + j - k <= 4}
    assert {(r.source, r.target): r.distance for r in rows} == want and len(rows) == len(want)
    assert most < 20 * n


def test_equal_queries_are_searched_once(spark, tmp_path):
    texts = [" ".join(["vector"] * (1 + i % 7) + ["b", f"w{i}"] * (1 + i % 5)) for i in range(300)] + ["", None, "reader vector-reader"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows, most = most_rows(QUERIES["t13_batch_search"](spark, str(tmp_path)))
    want = {}
    for place, word in ((0, "vector"), (2, "reader")):
        best = fulltext.search(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text", word, 5).collect()
        want |= {(q, rank): r.doc_id for q in range(place, 3000, 10) for rank, r in enumerate(best, 1)}
    assert {(r.query_id, r["rank"]): r.id for r in rows} == want and len(rows) == len(want) == 300 * 6
    assert most < 10_000


def test_postings_count_terms_within_a_document(spark):
    texts = ["b a b", "", None, "a", "c b c b c"]
    index = fulltext.build_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    assert sorted((r.id, r.term, r.tf) for r in index["postings"].collect()) == [(0, "a", 1), (0, "b", 2), (3, "a", 1), (4, "b", 2), (4, "c", 3)]
    assert sorted(map(tuple, index["norms"].collect())) == [(0, 3), (1, 0), (3, 1), (4, 5)] and sorted(map(tuple, index["terms"].collect())) == [("a", 2), ("b", 2), ("c", 1)]
