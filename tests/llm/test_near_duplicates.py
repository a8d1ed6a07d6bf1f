import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.llm import meeting
from filigree.llm import near_duplicates as nd

WORD = re.compile(r"[^\W_]+")


def similarity(a, b):
    x, y = Counter(WORD.findall(a.lower())), Counter(WORD.findall(b.lower()))
    return sum((x & y).values()) / max(sum(x.values()), sum(y.values()), 1)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 14)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(3))
            if rng.random() < 0.5:
                rng.shuffle(words)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=rng.randrange(30, 90))))
    return texts + [texts[0].upper(), texts[1], texts[1]]


def test_pairs_equal_brute_force(spark, monkeypatch):
    for seed, limit in ((1, 100_000), (2, 0)):
        monkeypatch.setattr(nd, "BROADCAST_CLASSES", limit)
        texts = corpus(seed)
        rows = [(i, f"s{i % 5}" if i % 7 else None, t, "x") for i, t in enumerate(texts)]
        extra = [(900, "s", None, ""), (901, "t", "", ""), (902, "u", "short text", ""), rows[3]]
        df = spark.createDataFrame(rows + extra, "id long, source string, text string, rep string")
        size = lambda t: len(WORD.findall(t.lower()))
        expected = {(i, j) for i, si, t, _ in rows for j, sj, u, _ in rows if i < j and si != sj and size(t) >= 40 <= size(u) and similarity(t, u) >= 0.8}
        got = [tuple(r) for r in nd.pairs_across(df, "id", "text", "source").collect()]
        assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 20


def test_levels_cover_any_similarity():
    assert nd.levels(0) == (15, 21, 31) and nd.levels(1) == (31, 43, 63)
    for similarity in (0.9, 0.8, 0.75, 0.7, 0.55):
        for n in range(40, 640):
            span = (n // 40).bit_length() - 1
            assert 2 * nd.misses(n, similarity) + 1 <= nd.levels(span, similarity)[-1]
            # What a shorter text asks for as a guest fits into the first level of the next span.
            assert 2 * nd.misses(n, similarity) + 1 <= nd.levels(span + 1, similarity)[0]


def meet(first, second, frequency, limit, similarity=0.8):
    both = [(np.sort(x), np.array([len(x)])) for x in (first, second)]
    held, owned = np.zeros(nd.SEGMENTS, np.int32), np.zeros(nd.FILTER, np.uint64)
    for flat, n in both:
        key = nd.signatures(flat, n, frequency, limit, similarity)[1]
        np.add.at(held, (key % np.uint64(nd.SEGMENTS)).astype(np.int64), 1)
        np.bitwise_or.at(owned, *nd._bits(key))
    found = [{}, {}]
    for (flat, n), kinds in zip(both, found):
        for key, kind in zip(*(x.tolist() for x in nd.signatures(flat, n, frequency, limit, similarity, nd.code(held), owned)[1:3])):
            kinds[key] = kinds.get(key, 0) | kind
    return any((a & nd.ASKS and b & nd.STORED) or (b & nd.ASKS and a & nd.STORED) for a, b in ((found[0][k], found[1][k]) for k in found[0].keys() & found[1].keys()))


def test_short_and_long_text_without_rare_words_meet_at_low_similarity():
    long = np.random.default_rng(1).integers(1, 1 << 62, 78)
    assert meet(long, long[:55], np.zeros(nd.SKETCH, np.int64), -1, 0.7)


def test_low_similarity_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(40):
        first = rng.choices(vocabulary, k=79)
        second = list(first)
        for k in rng.sample(range(79), rng.randrange(17, 24)):
            second[k] = rng.choice(vocabulary)
        texts += [" ".join(first), " ".join(second)]
    df = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "id long, source string, text string")
    expected = {(i, j) for i, t in enumerate(texts) for j, u in enumerate(texts) if i < j and similarity(t, u) >= 0.7}
    assert {tuple(r) for r in nd.pairs_across(df, "id", "text", "source", similarity=0.7).collect()} == expected and len(expected) > 20


def test_groups(spark):
    texts = corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in nd.groups(df, "id", "text").collect()}
    long = [i for i, t in enumerate(texts) if len(WORD.findall(t)) >= 40]
    assert set(got) == set(long)
    parent = {i: i for i in long}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in long:
        for j in long:
            if i < j and similarity(texts[i], texts[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert all(got[i].group_id == root(i) for i in long)
    key = lambda i: tuple(sorted(WORD.findall(texts[i].lower())))
    for i in long:
        assert got[i].class_id == min(j for j in long if key(j) == key(i))
        assert got[i].links == len({key(j) for j in long if key(j) != key(i) and similarity(texts[i], texts[j]) >= 0.8})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=20, max_size=180), st.lists(st.integers(0, 60), max_size=30), st.integers(0, 30), st.integers(-1, 6))
def test_filters_lose_no_pair(words, added, dropped, limit):
    other = words[dropped:] + added
    x, y = (np.sort(nd._mix(np.array(w, np.uint64) + np.uint64(1))) for w in (words, other))
    n, m = (np.array([len(h)]) for h in (x, y))
    shared, longer = sum((Counter(words) & Counter(other)).values()), max(len(x), len(y))
    if not len(y) or shared < np.ceil(0.8 * longer - 1e-9):
        return
    # Neither ring rules the pair out, and the words are counted.
    budget = len(x) + len(y) - 2 * int(np.ceil(0.8 * longer - 1e-9))
    a, b = (nd.parities(*nd.tokens(h, k), 1) for h, k in ((x, n), (y, m)))
    assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in (a ^ b).ravel()) <= budget
    assert nd.shared_words(x, n, y, m).tolist() == [shared]
    # The texts meet by some signature, whatever counts as rare.
    frequency = np.arange(nd.SKETCH) % 7 + 2
    assert meet(x, y, frequency, limit + 2)


def test_codes_of_counts():
    n = np.concatenate([np.arange(3000), 1 << np.arange(12, 31)])
    back = nd.COUNT_OF[nd.code(n)]
    assert (back[:16] == np.arange(16)).all() and (np.abs(back - n) <= 0.06 * n).all() and (np.diff(back) >= 0).all()


def test_meetings_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(meeting, "BLOCK", 7)
    rng = np.random.default_rng(3)
    sign, rep = np.sort(rng.integers(0, 12, 90)), rng.permutation(90)
    info, parity = (rng.integers(40, 60, 90) * 8 + rng.integers(1, 8, 90)).astype(np.int32), rng.choice([-1, 1], (90, 2)) * rng.integers(0, 1 << 7, (90, 2))
    expected = set()
    for x in range(90):
        for y in range(90):
            n, m = sorted((int(info[x]) >> 3, int(info[y]) >> 3))
            apart = sum(bin(int(v) & (2**64 - 1)).count("1") for v in parity[x] ^ parity[y])
            if sign[x] == sign[y] and rep[x] != rep[y] and info[x] & nd.ASKS and info[y] & nd.STORED and apart <= n + m - 2 * int(np.ceil(0.8 * m - 1e-9)) and (x < y or not info[x] & nd.RARE):
                expected.add((min(rep[x], rep[y]), max(rep[x], rep[y])))
    got = {p for a, b in nd.meetings(sign, rep, info, parity) for p in zip(a.tolist(), b.tolist())}
    assert got == expected and len(got) > 20
    assert not list(nd.meetings(sign[:0], rep[:0], info[:0], parity[:0]))


def test_hot_segments_are_split():
    rep, key = np.arange(9), np.full(9, 5, np.uint64)
    kind = np.array([nd.ASKS | nd.STORED] * 4 + [nd.STORED] * 5)
    rows, keys, kinds = nd.split(rep, key, kind, np.full(9, 3 * nd.HOT))
    assert len(set(keys.tolist())) == 3 and (kinds == nd.ASKS).sum() == 4 and (kinds == nd.STORED).sum() == 27
    for asker in rows[kinds == nd.ASKS]:
        mine = keys[(rows == asker) & (kinds == nd.ASKS)][0]
        assert set(rows[(keys == mine) & (kinds == nd.STORED)]) == set(range(9))
    assert nd.split(rep, key, kind, np.full(9, 4))[1].tolist() == key.tolist()


def test_copies_in_one_source_meet_nobody(spark):
    text = " ".join(f"word{i}" for i in range(50))
    df = spark.range(10_000).selectExpr("id", "'s' AS source", f"'{text}' AS text")
    assert nd.pairs_across(df, "id", "text", "source").count() == 0
    one = spark.createDataFrame([(-1, "t", text)], "id long, source string, text string")
    assert nd.pairs_across(df.unionByName(one), "id", "text", "source").filter("id_a = -1").count() == 10_000


def test_chain_filter_prunes():
    a, b = np.zeros((3, nd.RING), np.uint8), np.zeros((3, nd.RING), np.uint8)
    b[0, :] = 1
    b[1, 5] = 9
    b[2, 7:30] = 1
    assert nd.chain_filter(a, b, np.array([nd.RING - 1, 9, 23])).tolist() == [False, True, True]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 100)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 100, 101, 102, 200]], "node long")
    got = dict(map(tuple, nd.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string, source string")
    assert nd.pairs_across(df, "id", "text", "source").count() == 0 and nd.groups(df, "id", "text").count() == 0
