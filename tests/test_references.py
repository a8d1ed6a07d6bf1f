import random
from datetime import datetime, timedelta

from filigree.operators import references as R

T = datetime(2024, 1, 1)
REF = "ref_table string, owner_id long, ref_field string, key long, at timestamp, hot string, salt int"
PAR = "key long, present_from timestamp, present_until timestamp, extra string"


def brute(refs, parents):
    there = lambda k, t: any(p[0] == k and p[1] is not None and (t is None or (p[1] <= t and (p[2] is None or p[2] > t))) for p in parents)
    return list(r for r in refs if r[3] is not None and not there(r[3], r[4]))


def random_case(n, seed):
    rng = random.Random(seed)
    day = lambda: T + timedelta(days=rng.randrange(40))
    key = lambda: rng.choice([None, 1, 1, 1, *range(2, 12)])
    refs = [(rng.choice("ab"), i % (n - 3), rng.choice(["s", "t"]), key(), rng.choice([day(), day(), None]), "h", 1) for i in range(n)]
    parents = [(rng.choice([None, *range(1, 9)]), rng.choice([day(), None]), rng.choice([day(), None]), "x") for _ in range(14)]
    return refs, parents + parents[:2]


def frames(spark, refs, parents):
    return spark.createDataFrame(refs, REF).select("ref_table", "owner_id", "ref_field", "key", "at"), spark.createDataFrame(parents, PAR)


def test_orphans_match_brute_force(spark, monkeypatch):
    for seed, least in ((1, 20_000), (2, 5), (3, 5)):
        monkeypatch.setattr(R, "HOT_LEAST", least)
        refs, parents = random_case(200, seed)
        order = lambda rows: sorted([tuple(r)[:5] for r in rows], key=str)
        assert order(R.orphans(*frames(spark, refs, parents)).collect()) == order(brute(refs, parents))


def test_report_adds_up(spark):
    refs, parents = random_case(150, 5)
    r, p = frames(spark, refs, parents)
    report = R.orphan_report(r, p).collect()
    assert sum(x["refs"] for x in report) == sum(x[3] is not None for x in refs)
    assert sum(x["orphans"] for x in report) == len(brute(refs, parents))
    known = {x[0] for x in parents}
    assert sum(x["never_existed"] for x in report) == sum(x[3] is not None and x[3] not in known for x in refs)


def test_empty_tables(spark):
    refs, parents = random_case(30, 7)
    r, p = frames(spark, refs, parents)
    assert R.orphans(r.limit(0), p).count() == 0
    assert R.orphans(r, p.limit(0)).count() == sum(x[3] is not None for x in refs)


def test_members(spark):
    df = spark.createDataFrame([(1, T, [("a", 5), ("b", None), ("a", 5)]), (2, T, None), (3, T, [])], "nexus_id long, created_at timestamp, members array<struct<role_name:string,vertex_id:long>>")
    got = R.member_references(df, "n", "nexus_id", "created_at", "members", "role_name", "vertex_id").collect()
    assert [(x["ref_field"], x["key"]) for x in got] == [("a", 5), ("a", 5)]
