"""Queries of vector, full-text, hybrid and document search over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import fulltext, vector_search
from filigree.operators.vector_search import regions
from filigree.plans.testgraph import read
from filigree.rag.chunker import chunk_documents
from filigree.rag.store import Store
from filigree.sources.bulk import wide_properties

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The fixed query vectors.
VECTOR = [((i * 37) % 17 - 8) / 8.0 for i in range(64)]
BATCH = [(q, [((i * (11 + 2 * q)) % 19 - 9) / 9.0 for i in range(64)]) for q in range(16)]
_SQL_VECTOR = f"{VECTOR}::double[]"


def _note(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


_METRIC_SQL = {
    "cosine": "list_cosine_similarity(embedding::double[], {q})", "dot": "list_inner_product(embedding::double[], {q})", "euclidean": "-list_distance(embedding::double[], {q})",
}
for _m, _s in _METRIC_SQL.items():
    _note(f"v2_knn_{_m}", f"select vec_id, round({_s.format(q=_SQL_VECTOR)}, 6) as score from embeddings order by {_s.format(q=_SQL_VECTOR)} desc, vec_id limit 20")(
        lambda spark, d, m=_m: vector_search.top_k(read(spark, d, "embeddings"), "vec_id", "embedding", VECTOR, 20, m).select("vec_id", F.round("score", 6).alias("score"))
    )
_note("v3_filtered_knn", f"select vec_id from embeddings where label = 3 order by {_METRIC_SQL['cosine'].format(q=_SQL_VECTOR)} desc, vec_id limit 10")(
    lambda spark, d: vector_search.top_k(read(spark, d, "embeddings").filter("label = 3"), "vec_id", "embedding", VECTOR, 10).select("vec_id")
)
_BATCH_SQL = "q as (select * from (values " + ", ".join(f"({q}, {v}::double[])" for q, v in BATCH) + ") q(query_id, w))"
_note("v4_batch_knn", f"with {_BATCH_SQL}, s as (select query_id, vec_id, list_cosine_similarity(embedding::double[], w) as s from q, embeddings) select query_id, vec_id, rank from (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from s) where rank <= 10")(
    lambda spark, d: vector_search.batch_top_k(read(spark, d, "embeddings"), "vec_id", "embedding", BATCH, 10).select("query_id", "vec_id", "rank")
)
_note("v7_dyadic_distance", f"select vec_id from embeddings order by list_distance(embedding::double[], {_SQL_VECTOR}) desc, vec_id limit 10")(lambda spark, d: vector_search.apply_dyadic(read(spark, d, "embeddings"), "vec_id", "embedding", VECTOR, "distance", 10).select("vec_id"))
_note("v7_dyadic_function", f"select vec_id from embeddings order by list_inner_product(embedding::double[], {_SQL_VECTOR}) desc, vec_id limit 10")(lambda spark, d: vector_search.apply_dyadic(read(spark, d, "embeddings"), "vec_id", "embedding", VECTOR, lambda rows, b: rows @ b, 10).select("vec_id"))
_note("v10_monadic", "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as norm, round(list_sum(embedding[1:8]::double[]), 5) as head from embeddings")(
    lambda spark, d: vector_search.apply_monadic(vector_search.apply_monadic(read(spark, d, "embeddings"), "embedding", lambda m: np.linalg.norm(m, axis=1), "n"), "embedding", lambda m: m.sum(axis=1), "h", [(0, 8)]).select("vec_id", F.round(F.get("n", 0), 5).alias("norm"), F.round(F.get("h", 0), 5).alias("head"))
)
_note("v8_regions", f"select vec_id, round(list_inner_product(embedding[1:8]::double[], ({_SQL_VECTOR})[1:8]) + list_inner_product(embedding[33:40]::double[], ({_SQL_VECTOR})[33:40]), 6) as score from embeddings")(
    lambda spark, d: read(spark, d, "embeddings").select("vec_id", F.round(vector_search.dot(regions(F.col("embedding"), [(0, 8), (32, 40)]), regions(F.array(*map(F.lit, VECTOR)), [(0, 8), (32, 40)])), 6).alias("score"))
)

# DuckDB lacks NFKC, so the compatibility forms in the texts stand in the translation. Runs of CJK signs give overlapping pairs and single signs, a lone sign itself; other runs of letters and digits are words.
_CJK = "々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿가-힣"
_FTS = f"""
c as (select doc_id as id, translate(nfc_normalize(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ𝛼º０１２３４５６７８９', 'abcdefghijklmnopqrstuvwxyzαo0123456789') as x from documents where text is not null),
b as (select id, regexp_extract_all(regexp_replace(x, '[{_CJK}]+', ' ', 'g'), '[\\p{{L}}\\p{{Nd}}]+') as words, regexp_extract_all(x, '[{_CJK}]+') as runs from c),
d as (select id, len(words) + coalesce(list_sum(list_transform(runs, lambda r: greatest(1, length(r) - 1))), 0) as l,
  list_concat(words, flatten(list_transform(runs, lambda r: case when length(r) = 1 then [r] else list_concat(list_transform(range(1, length(r)), lambda i: substring(r, i, 2)), list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1))) end))) as w from b),
s as (select count(*) as n, avg(l) as a from d),
p as (select id, term, count(*) as tf from (select id, unnest(w) as term from d) group by 1, 2),
f as (select term, count(*) as df from p group by 1)"""
_BM25 = "ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.l / s.a))"


def _bm25(terms: str, where: str = "true", k: int = 20) -> str:
    return f"with {_FTS} select p.id as doc_id, round(sum({_BM25}), 5) as score from p join f using (term) join d on d.id = p.id, s where ({terms}) and {where} group by 1 order by sum({_BM25}) desc, 1 limit {k}"


def _search(name: str, query: str, terms: str, where: str = "true", k: int = 20) -> None:
    _note(name, _bm25(terms, where, k))(lambda spark, d: fulltext.search(read(spark, d, "documents"), "doc_id", "text", query, k).select("doc_id", F.round("score", 5).alias("score")))


_has = lambda t: f"exists (select 1 from p x where x.id = p.id and x.term = '{t}')"
_search("t7_search", "Vector index scan", "term in ('vector', 'index', 'scan')")
_search("t7_japanese", "グラフの検索 索引", "term in ('グラ', 'ラフ', 'フの', 'の検', '検索', 'グ', 'ラ', 'フ', 'の', '検', '索', '索引', '引')")
_note("t2_tokens", f"with {_FTS} select id as doc_id, len(w) as n, l as length, md5(array_to_string(list_sort(w), ' ')) as tokens from d")(
    lambda spark, d: fulltext.documents(read(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n"), F.col("length").cast("long").alias("length"), F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("tokens"))
)
_search("t9_prefix", "tenan*", "term like 'tenan%'")
_search("t10_fuzzy", "vectr~", "levenshtein(term, 'vectr') <= 1")
_search("t10_fuzzy_2", "tanant~2", "levenshtein(term, 'tanant') <= 2")
_search("t11_and", "vector AND index", "term in ('vector', 'index')", f"{_has('vector')} and {_has('index')}")
_search("t11_not", "vector OR chunk NOT index", "term in ('vector', 'chunk')", f"not {_has('index')}")
_search("t9_prefix_and", "tenan* AND vect* NOT zzz*", "(term like 'tenan%' or term like 'vect%')", "p.id in (select id from p where term like 'tenan%') and p.id in (select id from p where term like 'vect%')")
_search("t11_mixed", "reader vector AND index", "term in ('reader', 'vector', 'index')", f"{_has('vector')} and {_has('index')}")
_note("t11_only_not", "select 1::bigint as doc_id, 0.0::double as score where false")(lambda spark, d: fulltext.search(read(spark, d, "documents"), "doc_id", "text", "NOT vector", 10))
_note("t8_filtered_search", _bm25("term in ('vector', 'index')", "p.id in (select doc_id from documents where lang = 'en')"))(
    lambda spark, d: fulltext.search(read(spark, d, "documents"), "doc_id", "text", "vector index", 20, read(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))).select("doc_id", F.round("score", 5).alias("score"))
)
_note("t14_corpus_statistics", f"with {_FTS} select n, round(a, 6) as mean, (select count(*) from f) as terms from s")(
    lambda spark, d: (lambda index: index["norms"].agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean")).withColumn("k", F.lit(1)).join(index["terms"].agg(F.count("*").alias("terms")).withColumn("k", F.lit(1)), "k").drop("k"))(fulltext.build_index(read(spark, d, "documents"), "doc_id", "text"))
)
_note("t13_batch_search", f"with {_FTS}, q as (select supplier.s_suppkey as query_id, ['vector', 'index', 'reader', 'chunk', 'edge', 'label', 'cache', 'scan', 'queue', 'tenant'][1 + s_suppkey % 10] as term from supplier), r as (select query_id, p.id, {_BM25} as score from q join p using (term) join f using (term) join d on d.id = p.id, s) select query_id, id, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from r) where rank <= 5")(
    lambda spark, d: fulltext.search_many(fulltext.build_index(read(spark, d, "documents"), "doc_id", "text"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.element_at(F.array(*map(F.lit, ("vector", "index", "reader", "chunk", "edge", "label", "cache", "scan", "queue", "tenant"))), (1 + F.col("s_suppkey") % 10).cast("int")).alias("text")), 5).select("query_id", "id", "rank")
)


def _channels(spark: SparkSession, d: str) -> list[DataFrame]:
    e = read(spark, d, "embeddings")
    return [vector_search.top_k(e, "vec_id", "embedding", VECTOR, 30, m) for m in ("cosine", "euclidean")]


_CHANNEL = "select vec_id, row_number() over (order by {0} desc, vec_id) as r from (select * from embeddings order by {0} desc, vec_id limit 30)"
_note("v6_rank_fusion", f"select vec_id, round(sum(1.0 / (60 + r)), 9) as score from ({_CHANNEL.format(_METRIC_SQL['cosine'].format(q=_SQL_VECTOR))} union all {_CHANNEL.format(_METRIC_SQL['euclidean'].format(q=_SQL_VECTOR))}) group by 1 order by sum(1.0 / (60 + r)) desc, 1 limit 20")(
    lambda spark, d: vector_search.fuse(_channels(spark, d), "vec_id", 20).select("vec_id", F.round("score", 9).alias("score"))
)


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "document_drafts").filter("index_name = 'title_compact'").dropDuplicates(["draft_id"])


_note("v6_hybrid")(lambda spark, d: vector_search.hybrid(_drafts(spark, d), "draft_id", "body", "index reader", "vector", VECTOR, 20))


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "ingested_documents").dropDuplicates(["ingest_id"])


_note("k1_chunks")(lambda spark, d: chunk_documents(_ingested(spark, d), "ingest_id", "blocks"))
_note("k4_search")(lambda spark, d: Store.ingest(_ingested(spark, d)).search("vector index tenant", k=10, neighbours=1).select("source_id", "first", "last", "score", "text"))
_note("k4_metadata_search")(lambda spark, d: Store.ingest(_ingested(spark, d)).search("Index Vektor", k=10, metadata_filter=F.col("metadata").isNotNull()).select("source_id", "first", "last", "score", "text"))
_note("io7_wide_properties", """
select vertex_id, list_filter(list_transform(properties, lambda p: case when p.prop_key = 'title' then p.prop_value end), lambda x: x is not null)[1] as title,
  try_cast(list_filter(list_transform(properties, lambda p: case when p.prop_key = 'size' then p.prop_value end), lambda x: x is not null)[1] as bigint) as size from graph_vertices""")(
    lambda spark, d: wide_properties(read(spark, d, "graph_vertices").withColumn("properties", F.filter("properties", lambda p: p["prop_value"].isNotNull())), "vertex_id", "properties", {"title": "string", "size": "bigint"}).select("vertex_id", "title", "size")
)
