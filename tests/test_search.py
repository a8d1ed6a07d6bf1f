import pytest
from pyspark.sql import functions as F

from filigree.functions import text as T
from filigree.functions.text import REGISTRY, mixed_bigrams, normalize
from filigree.operators import fulltext as ft
from filigree.operators import vector_search as vs

DOCS = ["engine", "engine engine", "engine database graph", "engine engine engine search", "database graph search"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")


def test_bm25_scores(spark):
    got = [(r.id, round(r.score, 4)) for r in ft.search(docs(spark, DOCS), "id", "text", "engine", 10).collect()]
    assert [i for i, _ in got] == [2, 4, 1, 3] and [s for _, s in got] == pytest.approx([0.4230, 0.4053, 0.3844, 0.2707], abs=2e-4)
    some = ft.search(docs(spark, DOCS), "id", "text", "engine", 10, candidates=spark.createDataFrame([(3,), (1,)], "id long")).collect()
    assert [(r.id, round(r.score, 4)) for r in some] == [g for g in got if g[0] in (1, 3)]
    index = ft.build_index(docs(spark, DOCS), "id", "text")
    many = ft.search_many(index, spark.createDataFrame([(7, "engine Engine"), (8, "search zzz")], "query_id long, text string"), 10).collect()
    assert [(r.id, round(r.score, 4)) for r in sorted(many, key=lambda r: r["rank"]) if r.query_id == 7] == got and {r.id for r in many if r.query_id == 8} == {4, 5}


def test_boolean_prefix_fuzzy(spark):
    d = docs(spark, ["graph database engine", "graph visualization tool", "database migration tool", None, ""])
    hit = lambda q: sorted(r.id for r in ft.search(d, "id", "text", q, 10).collect())
    assert hit("graph AND database") == [1] and hit("graph database AND tool") == [3] and hit("graph NOT tool") == [1] and hit("NOT graph") == []
    assert hit("datab*") == [1, 3] and hit("databas~") == [1, 3] and hit("grahp~") == [] and hit("grahp~2") == [1, 2] and hit("x-AND-y") == [] and hit("") == []
    assert [c.must for c in ft.parse("a AND b OR c")] == ["required", "required", "optional"]
    assert ft.search(d.limit(0), "id", "text", "graph", 3).count() == 0
    with pytest.raises(ValueError):
        ft.search(d, "id", "text", "graph", 0)


def test_queries_are_tokenized_like_texts(spark):
    d = docs(spark, ["東京都庁の検索", "京都の検索", "Ｇraph ﬁle", "graph 東", "file"])
    hit = lambda q, t=None: [r.id for r in ft.search(d, "id", "text", q, 10, tokenizer=t).collect()]
    assert hit("東京都庁")[0] == 1 and sorted(hit("検索")) == [1, 2] and hit("庁") == [1] and sorted(hit("東")) == [1, 4]
    assert hit("東京都庁", "mixed-bigram")[0] == 1 and sorted(hit("graph")) == [3, 4] and sorted(hit("ＦＩＬＥ")) == [3, 5]
    assert hit("東京 AND 検索", "mixed-bigram") == [1] and hit("検索 NOT 東京", "mixed-bigram") == [2] and hit("zzz* AND 都庁") == [1, 2]
    assert ft.parse("検索* 東京~")[0].tokens == ("検索",) and [c.kind for c in ft.parse("a* b~ c~0 d~9")] == ["prefix", "fuzzy", "term", "fuzzy"]
    assert [c.must for c in ft.parse("a AND NOT b OR c AND d")] == ["required", "excluded", "required", "required"]


def test_tokens_in_the_jvm_equal_the_tokenizer(spark):
    texts = ["", " ", "東", "東京x1京", "a😀b ½ ﬁ", "e\u0301a", "ÀÖ ß İ", "ー々〇", "한국어 ok", "㈱ ＡＢ", "𠮷野家", None, "x" * 5000 + "都" * 3000]
    got = {r.id: (sorted(r.tokens), r.length) for r in ft.documents(docs(spark, texts), "id", "text").collect()}
    assert got == {i: (sorted(mixed_bigrams(t)[0]), mixed_bigrams(t)[1]) for i, t in enumerate(texts, 1) if t is not None}


def test_tokenizers(spark):
    assert mixed_bigrams("Ｇraph 東京都 A1") == (["graph", "東京", "京都", "東", "京", "都", "a1"], 4)
    assert mixed_bigrams("都x", False) == (["都", "x"], 2) and mixed_bigrams("a😀b ½") == (["a", "b", "1", "2"], 4)
    assert normalize("  A\tＢ—c\x07 ") == "a b-c" and T.minimal("Äé") == "Äé"
    assert T.variants()(["渡邉", "x"]) == ["渡邉", "渡辺", "渡邊", "x"]
    REGISTRY.register("stop", lambda t: mixed_bigrams(t, False), T.stopwords(["the"]), T.lowercase)
    d = docs(spark, ["the 東京 graph", "京都 the"])
    assert [r.id for r in ft.search(d, "id", "text", "東京", 5, tokenizer="stop").collect()] == [1]
    assert {tuple(r.tokens) for r in ft.documents(d, "id", "text", "stop").collect()} == {("東京", "graph"), ("京都",)}


def test_knn(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None), (7, [float("nan"), 1.0])]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    top = lambda m, k=9: [(r.id, round(r.score, 6)) for r in vs.top_k(d, "id", "v", [1.0, 0.0], k, m).collect()]
    assert top("cosine") == [(1, 1.0), (3, 1.0), (2, 0.0), (4, 0.0)] and top("dot", 1) == [(3, 2.0)]
    assert top("euclidean", 2) == [(1, 0.0), (3, -1.0)]
    batch = vs.batch_top_k(d, "id", "v", [(10, [1.0, 0.0]), (11, [0.0, 1.0])], 2).collect()
    assert sorted((r.query_id, r.id, r["rank"]) for r in batch) == [(10, 1, 1), (10, 3, 2), (11, 1, 2), (11, 2, 1)]
    assert [r.id for r in vs.apply_dyadic(d.filter("id < 5"), "id", "v", [1.0, 0.0], "distance", 1).collect()] == [2]
    with pytest.raises(Exception, match="NaN"):
        vs.apply_dyadic(d.filter("id < 5"), "id", "v", [1.0, 0.0], lambda a, b: a @ b * float("nan"), 1).collect()
    with pytest.raises(ValueError):
        vs.top_k(d, "id", "v", [1.0], 0)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.1)], "id long, score double")
    got = [(r.id, r.score) for r in vs.fuse([a, b], "id", 3).collect()]
    assert got == [(2, pytest.approx(1 / 62 + 1 / 61)), (1, pytest.approx(1 / 61)), (3, pytest.approx(1 / 62))]
    e = spark.createDataFrame([(1, "graph engine", [1.0, 0.0]), (2, "graph", [0.0, 1.0])], "id long, text string, v array<float>")
    assert [r.id for r in vs.hybrid(e, "id", "text", "engine", "v", [1.0, 0.1], 2).collect()] == [1, 2]
    assert e.select(vs.dot(vs.regions(F.col("v"), [(0, 1)]), F.array(F.lit(2.0))).alias("s")).first().s == 2.0
