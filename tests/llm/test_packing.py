import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.llm import packing


def expand(slots):
    fill, ranks = Counter(), {}
    for size, rank, n, first in slots:
        for i in range(n):
            fill[first + i] += size
            assert ranks.setdefault((size, rank + i), first + i) == first + i
    return fill, ranks


def first_fit_decreasing(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        for i, room in enumerate(bins):
            if room >= s:
                bins[i] -= s
                break
        else:
            bins.append(capacity - s)
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_plan_places_everything_once(sizes):
    slots, bins = packing.plan(Counter(sizes), 60)
    fill, ranks = expand(slots)
    assert Counter(s for s, _ in ranks) == Counter(sizes)
    assert not fill or (max(fill.values()) <= 60 and set(fill) == set(range(bins)))
    assert -(-sum(sizes) // 60) <= bins <= max(first_fit_decreasing(sizes, 60) * 11 // 9 + 1, 1) if sizes else bins == 0


def test_large_items_pair():
    slots, bins = packing.plan({40: 3, 20: 5}, 60)
    fill, _ = expand(slots)
    assert bins == 4 and sorted(fill.values()) == [40, 60, 60, 60]
    assert packing.plan({31: 4, 29: 4}, 60)[1] == 4


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)
    rng = random.Random(1)
    rows = [(i % 50, rng.choice([None, 0, -3, 5, 5, 5, rng.randrange(1, 300)]), "a", 1) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container_id string, tokens int")
    got = packing.pack(df, "doc_id", "n_tokens", 100).collect()
    fill = Counter()
    for r in got:
        fill[r.container_id] += r.tokens
    assert max(fill.values()) <= 100
    total = Counter()
    for i, n, _, _ in rows:
        total[i] += max(n or 0, 0)
    seen = Counter()
    for r in got:
        seen[r.doc_id] += r.tokens
        assert r.token_start == r.piece_no * 100
    assert +seen == +total and set(seen) == set(total)
    assert sum(r.piece_no == 0 for r in got) == len(rows)
    assert all(r.tokens == 100 for r in got if (r.doc_id, r.piece_no + 1) in {(x.doc_id, x.piece_no) for x in got} and r.piece_no == 0 and total[r.doc_id] > 100 and Counter(i for i, *_ in rows)[r.doc_id] == 1)


def test_pack_nothing_or_only_empty(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens long")
    assert [(r.container_id, r.tokens) for r in packing.pack(df, "doc_id", "n_tokens").collect()] == [(0, 0), (0, 0)]
    assert packing.pack(df.limit(0), "doc_id", "n_tokens").count() == 0
