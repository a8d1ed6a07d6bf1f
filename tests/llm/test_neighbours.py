import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.llm import neighbours as nb

KINDS = "id long, vector array<float>, grp string, score string"


def exact(rows, k, least=-1.0):
    """Brute force: (group, id) to its neighbours."""
    out = {}
    for g in {r[2] for r in rows}:
        ids = np.array([r[0] for r in rows if r[2] == g])
        unit = nb.normalized(np.array([r[1] for r in rows if r[2] == g], np.float32).astype(float))
        sim = unit @ unit.T
        for i, a in enumerate(ids):
            order = sorted((j for j in range(len(ids)) if j != i and sim[i, j] >= least - 1e-12), key=lambda j: (-round(sim[i, j], 9), ids[j]))
            out[g or "", int(a)] = [int(ids[j]) for j in order[:k]]
    return out


def make(seed, n=300, d=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g, dim in (("one", d), (None, 5)):
        base = rng.standard_normal((n, dim))
        base[: n // 3] = base[0] + 0.12 * rng.standard_normal((n // 3, dim))
        base[10:26] = base[10]
        rows += [(i, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist() if not 10 <= i < 26 else v.astype(np.float32).tolist(), g, "x") for i, v in enumerate(base)]
    return rows


def test_rotation_keeps_angles():
    x = nb.normalized(np.random.default_rng(1).standard_normal((20, 13)))
    y = nb.rotate(x, 2, 1)
    assert np.allclose(y @ y.T, x @ x.T) and y.shape[1] == 16
    assert (nb.axes(x, 0, 0, 5)[:, :1] == nb.axes(x, 0, 0)).all()


@pytest.mark.parametrize("block", [20_000, 20])
def test_similar_pairs_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(nb, "HOT", block)
    rows = make(2)
    df = spark.createDataFrame(rows + rows[:3], KINDS)
    got = {}
    for r in nb.nearest(df, "id", "vector", "grp", 10, least=0.92).orderBy("position").collect():
        got.setdefault((r.grp, r.a), []).append(r.b)
    expected = {k: v for k, v in exact(rows, 10, 0.92).items() if v}
    pairs = lambda x: {(k, b) for k, v in x.items() for b in v}
    assert len(pairs(got) & pairs(expected)) >= 0.995 * len(pairs(expected))
    assert len(pairs(got)) <= len(pairs(expected)) * 1.005
    assert got["one", 12][:10] == [i for i in range(10, 26) if i != 12][:10]


def test_recall_of_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), "g", "") for i, v in enumerate(rng.standard_normal((1200, 48)).astype(np.float32))]
    df = spark.createDataFrame(rows, KINDS)
    got = {}
    for r in nb.nearest(df, "id", "vector", "grp", 10, query=F.col("id") % 20 == 0).collect():
        got.setdefault(r.a, set()).add(r.b)
    best = exact(rows, 10)
    assert set(got) == set(range(0, 1200, 20))
    assert np.mean([len(got[i] & set(best["g", i])) / 10 for i in got]) >= 0.9


def test_valid(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0], [], None, [1.0, None], [0.0, -1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, vector array<float>")
    assert [r.id for r in df.filter(nb.valid("vector", F.lit(2))).orderBy("id").collect()] == [0, 8]


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", ""), (2, [1.0, 0.0], "b", "")], KINDS)
    assert nb.nearest(df, "id", "vector", "grp", 3).count() == 0
    assert nb.nearest(df.limit(0), "id", "vector", "grp", 3, least=0.5).count() == 0


def test_queries_of_similar_pairs(spark):
    rows = make(4)
    df = spark.createDataFrame(rows, KINDS)
    got = {(r.grp, r.a, r.b) for r in nb.nearest(df, "id", "vector", "grp", 10, least=0.92, query=F.col("id") % 7 == 0).collect()}
    expected = {(*k, b) for k, v in exact(rows, 10, 0.92).items() if k[1] % 7 == 0 for b in v}
    assert len(got & expected) >= 0.99 * len(expected) and len(got) <= 1.01 * len(expected) and len(expected) > 50


def test_sketches_tell_angles():
    rng = np.random.default_rng(7)
    for d in (5, 24, 64, 300):
        a = nb.normalized(rng.standard_normal((3000, d)))
        b = nb.normalized(a + rng.standard_normal((3000, d)) * 0.4 / np.sqrt(d))
        alike = (a * b).sum(axis=1) >= 0.92
        apart = np.bitwise_count(nb.sketches(a) ^ nb.sketches(b)).sum(axis=1)
        assert alike.sum() > 1000 and (apart[alike] <= nb.sketch_limit(d, 0.92)).mean() >= 0.9999
        assert np.bitwise_count(nb.sketches(a[:1]) ^ nb.sketches(a[1:])).sum(axis=1).mean() > nb.sketch_limit(d, 0.92) or d == 5


@pytest.mark.parametrize("block", [20, 2_000])
def test_visits_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(nb, "BLOCK", block)
    rows = make(6, n=150)
    df = spark.createDataFrame(rows, KINDS)
    got = {}
    for r in nb.nearest(df, "id", "vector", "grp", 5, recall=1.0).collect():
        got.setdefault((r.grp, r.a), set()).add(r.b)
    best = exact(rows, 5)
    assert set(got) == set(best) and np.mean([len(got[k] & set(v)) / len(v) for k, v in best.items()]) > 0.9
