"""Queries of the training-data operators over whole tables, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.llm import near_duplicates, neighbours, packing, personal, ranking, splitting, tokens


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_SCORES = {"bm25_score": [], "vector_similarity": [], "fused_score": ["fusion_method", "reciprocal_rank_constant"]}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse_scores(_read(spark, d, "rag_scores"), "query_id", "chunk_id", _SCORES, top=5).select("query_id", "chunk_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse_scores(_read(spark, d, "rag_scores"), "query_id", "chunk_id", _SCORES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.pairs_across(_read(spark, d, "chunk_drafts"), "chunk_id", "text", "source_id")
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(_read(spark, d, "chunk_drafts"), "chunk_id", "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    kinds = _read(spark, d, "vector_index_descriptors").select("index_name", "dimensions").distinct()
    return _read(spark, d, "document_drafts").join(kinds, "index_name").filter(neighbours.valid("vector", F.col("dimensions")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(_vectors(spark, d), "draft_id", "vector", "index_name", 10, least=0.92)
    return near.select(F.least("a", "b").alias("draft_id_a"), F.greatest("a", "b").alias("draft_id_b")).distinct()


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every draft whose id is divisible by 100, against all drafts."""
    near = neighbours.nearest(_vectors(spark, d), "draft_id", "vector", "index_name", 10, query=F.col("draft_id") % 100 == 0)
    return near.select(F.col("a").alias("draft_id"), F.col("b").alias("neighbour_id"), "position", F.round("score", 6).alias("similarity"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.domain_items(_read(spark, d, "ingested_documents"), _read(spark, d, "chunk_drafts"))
    return splitting.split_texts(items, "text", ["item_kind", "item_id", "block_no"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that were cut into more than one piece; rows that share an id are exact repeats and count once."""
    return _pieces(spark, d).filter("piece_no = 1").select("item_kind", "item_id", "block_no").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).dropDuplicates(["item_kind", "item_id", "block_no", "piece_no"])


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item reach from and to, and whether all keep the limit and the overlap and leave no gap."""
    item = ["item_kind", "item_id", "block_no"]
    before = F.lag("char_end").over(Window.partitionBy(*item).orderBy("piece_no"))
    pieces = p5_pieces(spark, d).withColumn("before", before)
    joined = F.col("before").isNull() | F.col("char_start").between(F.col("before") - 100, F.col("before"))
    fits = (F.col("char_end") - F.col("char_start")).between(1, 800) & joined
    out = pieces.groupBy(*item).agg(F.min("char_start").cast("long").alias("first_start"), F.max("char_end").cast("long").alias("last_end"), F.bool_and(fits).alias("fits"))
    return out.filter("last_end > 0")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_read(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.encode_corpus(_read(spark, d, "documents"), "doc_id", "text", counts_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct mention of a document."""
    found = personal.recognize(_read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.explode("mentions").alias("m"))
    return found.select("doc_id", F.col("m.kind").alias("pii_kind"), F.col("m.mention").alias("mention")).distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.recognize(_read(spark, d, "documents"), "doc_id", "text").select("doc_id", "redacted", F.size("mentions").alias("mentions"))


QUERIES = {"p1_found": p1_found, "p1_ranking": p1_ranking, "p2_found": p2_found, "p2_groups": p2_groups, "p6_found": p6_found, "p6_nearest": p6_nearest, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_cover": p5_cover, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_redacted": p9_redacted}

_UNITS = "(length({0}) + length(regexp_replace({0}, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')))"
ORACLE = {
    "p6_found": """
with v as (select distinct draft_id, index_name, vector, dimensions from document_drafts join vector_index_descriptors using (index_name)
  where len(vector) = dimensions and not list_contains(list_transform(vector, lambda x: x is null or not isfinite(x)), true) and list_contains(list_transform(vector, lambda x: x <> 0), true)),
u as (select draft_id, index_name, cast(vector as double[]) as w from v),
p as (select a.draft_id as x, b.draft_id as y, list_cosine_similarity(a.w, b.w) as s from u a join u b on a.index_name = b.index_name and a.draft_id <> b.draft_id),
r as (select x, y, s, row_number() over (partition by x order by s desc, y) as n from p)
select distinct least(x, y) as draft_id_a, greatest(x, y) as draft_id_b from r where n <= 10 and s >= 0.92""",
    "p5_found": f"""
with items as (
  select 'block' as item_kind, ingest_id as item_id, cast(generate_subscripts(blocks, 1) - 1 as bigint) as block_no, unnest(blocks).text as x from ingested_documents
  union all select 'chunk', chunk_id, -1, text from chunk_drafts)
select distinct item_kind, item_id, block_no from items where {_UNITS.format('x')} > 800""",
    "p5_cover": f"""
with items as (
  select 'block' as item_kind, ingest_id as item_id, cast(generate_subscripts(blocks, 1) - 1 as bigint) as block_no, unnest(blocks).text as x from ingested_documents
  union all select 'chunk', chunk_id, -1, text from chunk_drafts)
select distinct item_kind, item_id, block_no, 0 as first_start, {_UNITS.format('x')} as last_end, true as fits from items where length(x) > 0""",
}
