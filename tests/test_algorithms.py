import itertools
import random

import numpy as np
import pytest

from filigree.graph import PropertyGraph
from filigree.operators import annotations as A
from filigree.operators import combinatorial as C
from filigree.operators import directed_nexus as D
from filigree.operators import paths


def graph(spark, edges):
    rows = [(i, a, b, "R", float(w)) for i, (a, b, w) in enumerate(edges, 1)]
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    return PropertyGraph.of(spark.createDataFrame([(i, "V") for i in ids], "id long, label string"), spark.createDataFrame(rows, "id long, src long, dst long, type string, w double"))


def values(result):
    return {r.id: r.value for r in result.values.collect()}


def test_annotations(spark):
    g = graph(spark, [(1, 2, 0.5), (1, 3, 0.9), (2, 4, 0.5), (3, 4, 0.5), (4, 5, 1.0)])
    slow = A.Limits(seconds=300)
    assert set(values(A.reachable(g, 1, slow))) == {1, 2, 3, 4, 5}
    assert values(A.tropical(g, 1, "w", limits=slow)) == pytest.approx({1: 0, 2: 0.5, 3: 0.9, 4: 1.0, 5: 2.0})
    assert values(A.viterbi(g, 1, "w", limits=slow)) == pytest.approx({1: 1, 2: 0.5, 3: 0.9, 4: 0.45, 5: 0.45})
    assert values(A.walks(g, 1, slow)) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2}
    cycle = graph(spark, [(1, 2, 1), (2, 1, 1), (2, 3, 1)])
    assert A.walks(cycle, 1, slow).values is None and A.walks(cycle, 1, slow).reason == "cycle"
    assert values(A.tropical(cycle, 1, "w", limits=slow)) == {1: 0, 2: 1, 3: 2}
    for bad in (lambda: A.viterbi(cycle, 1, "w", slow), lambda: A.tropical(cycle, 1, "w", "acyclic", slow), lambda: A.tropical(graph(spark, [(1, 2, -1)]), 1, "w")):
        with pytest.raises(ValueError):
            bad()
    assert values(A.tropical(g, 1, "w", "acyclic", slow)) == values(A.tropical(g, 1, "w", limits=slow))
    small = A.reachable(g, 1, A.Limits(vertices=2, seconds=300))
    assert small.values is None and small.reason == "vertex_limit" and A.reachable(g, 1, A.Limits(edges=2)).reason == "edge_limit"
    cut = A.reachable(g, 1, A.Limits(results=2, seconds=300))
    assert not cut.exact and cut.values.count() == 2


def test_many_walks_are_no_cycle(spark, monkeypatch):
    """A chain of diamonds has more walks than a count may hold, and no cycle."""
    monkeypatch.setattr(A, "LONG_MAX", 20)
    g = graph(spark, [e for k in range(0, 18, 3) for e in ((k, k + 1, 0.5), (k, k + 2, 1.0), (k + 1, k + 3, 1.0), (k + 2, k + 3, 1.0))])
    slow = A.Limits(seconds=300)
    assert A.walks(g, 0, slow).reason == "overflow"
    assert values(A.viterbi(g, 0, "w", slow))[18] == 1.0 and values(A.tropical(g, 0, "w", "acyclic", slow))[18] == 9.0
    assert A.viterbi(g, 0, "w", A.Limits(vertices=3, seconds=300)).reason == "vertex_limit"


def rules(spark, some):
    n = spark.createDataFrame([(i, "Rule", float(c)) for i, (_, _, c) in enumerate(some, 1)], "id long, type string, cost double")
    i = spark.createDataFrame([(k, r, v) for k, (t, h, _) in enumerate(some, 1) for r, vs in (("tail", t), ("head", h)) for v in vs], "nexus_id long, role string, vertex_id long")
    ids = sorted({v for t, h, _ in some for v in (*t, *h)})
    return PropertyGraph(spark.createDataFrame([(v, "Item") for v in ids], "id long, label string"), spark.createDataFrame([], "id long, src long, dst long, type string"), n, i)


def test_nexus_reachability(spark):
    a, b, c, d, e = range(1, 6)
    g = rules(spark, [((a, b), (c,), 1), ((c,), (d,), 1), ((d,), (d,), 1), ((d, e), (a,), 1), ((), (9,), 1)])
    seeds = lambda *v: spark.createDataFrame([(x,) for x in v], "vertex_id long")
    got = lambda *v: sorted(r.vertex_id for r in D.reach(g, seeds(*v), "Rule").collect())
    assert got(a) == [a] and got(a, b, e) == [a, b, c, d, e]


def test_derivations(spark):
    seed, shared, left, right, target = 1, 2, 3, 4, 5
    g = rules(spark, [((seed,), (shared,), 2.5), ((shared,), (left,), 0), ((shared,), (right,), 0), ((left, right), (target,), 10), ((left, right), (target,), 10)])
    start = spark.createDataFrame([(seed,)], "vertex_id long")
    add = D.derivations(g, start, "cost", "additive", "Rule")
    tree = D.derivation_tree(g, add, target, "Rule")
    assert tree.cost == 15 and sum(v == shared for _, v, *_ in tree.tree) == 2 and tree.tree[0] == (0, target, 4, 15.0)
    assert D.derivation_tree(g, D.derivations(g, start, "cost", "bottleneck", "Rule"), target, "Rule").cost == 10
    assert D.derivation_tree(g, add, 99, "Rule").cost is None


def test_rounds_used_up_are_an_error(spark):
    g = rules(spark, [((v,), (v + 1,), 1) for v in range(1, 4)])
    start = spark.createDataFrame([(1,)], "vertex_id long")
    assert D.reach(g, start, "Rule").count() == D.derivations(g, start, "cost", "additive", "Rule").count() == 4
    with pytest.raises(RuntimeError):
        D.reach(g, start, "Rule", max_rounds=2)
    with pytest.raises(RuntimeError):
        D.derivations(g, start, "cost", "additive", "Rule", max_rounds=2)
    line = PropertyGraph.of(spark.createDataFrame([(v, "V") for v in range(1, 5)], "id long, label string"), spark.createDataFrame([(v, v, v + 1, "E", 1.0) for v in range(1, 4)], "id long, src long, dst long, type string, w double"))
    source = spark.createDataFrame([(1,)], "source long")
    assert paths.weighted_paths(line, source, "w").count() == 4
    with pytest.raises(RuntimeError):
        paths.weighted_paths(line, source, "w", max_rounds=2)
    assert all(f.__defaults__[-1] is None for f in (D.reach, D.derivations))


def test_hitting_sets_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sets = [frozenset(rng.sample(range(8), rng.randrange(1, 4))) for _ in range(rng.randrange(1, 9))]
        got = C.minimum_hitting_set(sets, seconds=20)
        best = next(k for k in range(9) for c in itertools.combinations(range(8), k) if all(s & set(c) for s in sets))
        assert got.optimal and len(got.vertices) == best == got.lower_bound and all(s & got.vertices for s in sets)
    limited = C.minimum_hitting_set([frozenset(rng.sample(range(40), 4)) for _ in range(60)], max_nodes=3)
    assert limited.reason == "node_limit" and limited.lower_bound <= len(limited.vertices)
    with pytest.raises(ValueError):
        C.minimum_hitting_set([frozenset()])


def test_concepts_match_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        pairs = {(o, a) for o in range(5) for a in "pqrst" if rng.random() < 0.5} or {(0, "p")}
        c = C.Context.of(pairs)
        has = {o: {a for x, a in pairs if x == o} for o in c.objects}
        closed = set()
        for k in range(len(c.attributes) + 1):
            for some in itertools.combinations(c.attributes, k):
                extent = [o for o in c.objects if has[o] >= set(some)]
                closed.add((tuple(extent), tuple(sorted(set.intersection(*(has[o] for o in extent)) if extent else set(c.attributes)))))
        lectic = [(tuple(o), tuple(a)) for o, a in C.concepts(c)]
        assert len(lectic) == len(set(lectic)) and set(lectic) == closed
        assert {(tuple(o), tuple(a)) for o, a in C.concepts_close_by_one(c)} == closed
        bits = lambda names: sum(1 << c.attributes.index(a) for a in names)
        assert [(tuple(o), tuple(a)) for o, a in C.concepts(c, after=bits(lectic[0][1]))] == lectic[1:]
        assert all(len(o) >= 2 for o, _ in C.concepts(c, min_extent=2))


def test_h0_is_the_spanning_tree(spark):
    x = np.random.default_rng(3).random((12, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    b = C.h0_barcode(df, "id", "v")
    gaps = np.linalg.norm(x[:, None] - x[None], axis=2)
    inside, deaths = {0}, []
    while len(inside) < 12:
        d, j = min((gaps[i, j], j) for i in inside for j in range(12) if j not in inside)
        inside.add(j)
        deaths.append(d)
    assert np.allclose(b.deaths, sorted(deaths)) and b.survivors == 1 and not b.approximate
    cut = C.h0_barcode(df, "id", "v", max_scale=b.deaths[3])
    assert cut.survivors == 12 - 4 and cut.limited
    with pytest.raises(ValueError):
        C.cluster_estimate(cut)
    far = spark.createDataFrame([(i, [float(i % 3) + 100 * (i // 3), 0.0]) for i in range(9)], "id long, v array<double>")
    assert C.cluster_estimate(C.h0_barcode(far, "id", "v"))[0] == 3 and C.h0_barcode(far, "id", "v", k=2).survivors == 3
    assert C.cluster_estimate(C.h0_barcode(far.limit(0), "id", "v")) == (0, None)
