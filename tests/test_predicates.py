from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filigree.functions.predicates import P, condition

LEAVES = {
    "gt": (P.gt(3), lambda v: v is not None and v > 3),
    "lt": (P.lt(7), lambda v: v is not None and v < 7),
    "eq": (P.eq(5), lambda v: v == 5),
    "between": (P.between(2, 6), lambda v: v is not None and 2 <= v < 6),
    "within": (P.within([1, 9]), lambda v: v in (1, 9)),
    "present": (P.present(), lambda v: v is not None),
}


def trees():
    leaf = st.sampled_from(sorted(LEAVES)).map(lambda n: LEAVES[n])
    join = lambda c: st.one_of(
        st.tuples(c, c).map(lambda p: (p[0][0] & p[1][0], lambda v: p[0][1](v) and p[1][1](v))),
        st.tuples(c, c).map(lambda p: (p[0][0] | p[1][0], lambda v: p[0][1](v) or p[1][1](v))),
        c.map(lambda p: (~p[0], lambda v: not p[1](v))),
    )
    return st.recursive(leaf, join, max_leaves=6)


@settings(max_examples=12, deadline=None)
@given(st.lists(trees(), min_size=1, max_size=6))
def test_two_valued_logic(spark, some):
    values = [None, *range(11)]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    row = df.select("x", *(p.value(F.col("x"), df.schema["x"].dataType).alias(f"p{i}") for i, (p, _) in enumerate(some))).collect()
    for r in row:
        for i, (_, truth) in enumerate(some):
            assert r[f"p{i}"] == truth(r.x)
    for p, truth in some:
        assert sorted((r.x for r in df.filter(condition(df, "x", p)).collect()), key=str) == sorted((v for v in values if truth(v)), key=str)


def test_types_and_sets(spark):
    df = spark.createDataFrame([(1, 1.0, True, ["a", "b"]), (2, None, None, None), (3, 3.0, False, [])], "i long, d double, b boolean, s array<string>")
    got = lambda key, p: sorted(r.i for r in df.filter(condition(df, key, p)).collect())
    assert got("d", P.eq(1)) == [] and got("i", P.eq(1.0)) == [] and got("i", P.gt(1.5)) == [2, 3] and got("d", P.eq(3.0)) == [3]
    assert got("b", P.eq(True)) == [1] and got("b", ~P.eq(True)) == [2, 3]
    assert got("s", P.eq("a")) == [1] and got("s", ~P.eq("a")) == [2, 3] and got("none", P.eq("a")) == [] and got("none", P.missing()) == [1, 2, 3]


def test_positive_leaves_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.filter(condition(df, "x", P.gt(3) & P.lt(9)))._jdf.queryExecution().toString()
    assert "GreaterThan(x,3)" in plan and "LessThan(x,9)" in plan
