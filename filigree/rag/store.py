"""The document store: documents and chunks as plain tables, upserts by content hash, deletes, and hybrid search.

documents(source_id, title, metadata, revision, fingerprint) and chunks(chunk_id, source_id, ordinal, heading_path, page,
char_start, char_end, text, search_text, embedding). NEXT_CHUNK is the order of ordinals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.fulltext import search as text_search
from filigree.operators.vector_search import fuse, top_k
from filigree.rag.chunker import Options, chunk_documents


# Names of the layer's labels, edge types and indexes.
DOCUMENT, CHUNK, HAS_CHUNK, NEXT_CHUNK = "Document", "Chunk", "HAS_CHUNK", "NEXT_CHUNK"


@dataclass(frozen=True)
class Profile:
    """Corpus-wide settings that every ingestion must share."""

    options: Options = Options()
    dimensions: int = 0
    tokenizer: str | None = None

    def check(self, other: Profile) -> None:
        if self != other:
            raise ValueError("the corpus was ingested under another profile")


def content_hash(blocks: Column) -> Column:
    return F.sha2(F.to_json(F.struct(blocks.alias("b"))), 256)


def prepare(incoming: DataFrame, profile: Profile = Profile()) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of incoming(source_id, title, metadata, content_revision, blocks); the last of repeats counts."""
    order = Window.partitionBy("source_id").orderBy(F.desc("ingested_at"), F.desc("ingest_id")) if "ingested_at" in incoming.columns else None
    rows = incoming if order is None else incoming.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    rows = rows.withColumn("content", content_hash(F.col("blocks")))
    attributes = F.to_json(F.struct("title", F.array_sort(F.map_entries("metadata")).alias("metadata"), "content_revision"))
    documents = rows.select("source_id", "title", "metadata", F.col("content_revision").alias("revision"), "content", F.sha2(F.concat_ws("|", "content", attributes), 256).alias("fingerprint"))
    chunks = chunk_documents(rows, "source_id", "blocks", profile.options)
    chunks = chunks.withColumn("search_text", F.concat("heading_path", F.lit("\n"), "text"))
    return documents, chunks


@dataclass(frozen=True)
class Store:
    documents: DataFrame
    chunks: DataFrame
    profile: Profile = field(default_factory=Profile)

    @staticmethod
    def ingest(incoming: DataFrame, profile: Profile = Profile()) -> Store:
        documents, chunks = prepare(incoming, profile)
        ids = chunks.withColumn("chunk_id", F.xxhash64("source_id", "ordinal", "text").bitwiseAND(F.lit(2**62 - 1)))
        return Store(documents.withColumn("generation", F.lit(0)), ids.withColumn("generation", F.lit(0)), profile)

    def upsert(self, incoming: DataFrame) -> Store:
        """Equal fingerprints change nothing; equal content keeps chunks and ids and takes the new attributes; other
        content replaces document and chunks under new ids."""
        documents, chunks = prepare(incoming, self.profile)
        old = self.documents.select("source_id", F.col("content").alias("o_content"), F.col("generation").alias("o_generation"))
        joined = documents.join(old, "source_id", "left")
        same = F.col("content").eqNullSafe(F.col("o_content"))
        new = joined.withColumn("generation", F.when(F.col("o_content").isNull(), 0).when(same, F.col("o_generation")).otherwise(F.col("o_generation") + 1))
        changed = new.filter(F.col("o_content").isNull() | ~same).select("source_id", "generation")
        fresh = chunks.join(changed, "source_id").withColumn("chunk_id", F.xxhash64("source_id", "ordinal", "text", "generation").bitwiseAND(F.lit(2**62 - 1)))
        kept = self.documents.join(documents.select("source_id"), "source_id", "left_anti")
        kept_chunks = self.chunks.join(changed.select("source_id"), "source_id", "left_anti")
        return Store(kept.unionByName(new.drop("o_content", "o_generation")), kept_chunks.unionByName(fresh.select(*[c for c in self.chunks.columns if c in fresh.columns]), allowMissingColumns=True), self.profile)

    def delete(self, source_ids: DataFrame) -> Store:
        gone = source_ids.select("source_id")
        return Store(self.documents.join(gone, "source_id", "left_anti"), self.chunks.join(gone, "source_id", "left_anti"), self.profile)

    def with_embeddings(self, embedder) -> Store:
        """Chunks with the vectors of a pandas function from texts to lists of floats."""

        @F.pandas_udf("array<float>")
        def embed(s):
            return embedder(s)

        return Store(self.documents, self.chunks.withColumn("embedding", embed("search_text")), self.profile)

    def search(self, text: str | None = None, vector: list[float] | None = None, k: int = 10, metadata_equals: dict[str, str] | None = None, metadata_filter: Column | None = None, neighbours: int = 0, metric: str = "cosine") -> DataFrame:
        """(source_id, first, last, score, text, title, metadata), the best first.

        metadata_equals chooses the candidates before both searches; metadata_filter drops hits after them. One channel
        keeps its score, two are fused by rank. Hits are widened by neighbouring chunks, ranges of a document
        that overlap or follow each other become one with the best score, and their text is joined without what overlaps.
        """
        if text is None and vector is None:
            raise ValueError("a search needs a text or a vector")
        docs = self.documents
        for key, value in (metadata_equals or {}).items():
            docs = docs.filter(F.col("metadata")[key] == value)
        inside = self.chunks.join(docs.select("source_id"), "source_id", "left_semi") if metadata_equals else self.chunks
        channels = []
        if text is not None:
            channels.append(text_search(self.chunks, "chunk_id", "search_text", text, k, inside.select(F.col("chunk_id").alias("id")), self.profile.tokenizer))
        if vector is not None:
            channels.append(top_k(inside, "chunk_id", "embedding", vector, k, metric))
        hits = channels[0] if len(channels) == 1 else fuse(channels, "chunk_id", k)
        hits = hits.join(self.chunks.select("chunk_id", "source_id", "ordinal"), "chunk_id")
        about = self.documents.select("source_id", "title", "metadata")
        if metadata_filter is not None:
            hits = hits.join(about.filter(metadata_filter).select("source_id"), "source_id", "left_semi")
        return merge_ranges(hits, self.chunks, neighbours).join(about, "source_id", "left").orderBy(F.desc("score"), "source_id", "first")


def merge_ranges(hits: DataFrame, chunks: DataFrame, neighbours: int) -> DataFrame:
    """(source_id, first, last, score, text): hits widened by neighbours, ranges that overlap or follow each other joined. Hits are a top-k list."""
    ranges = hits.select("source_id", F.greatest(F.col("ordinal") - neighbours, F.lit(0)).alias("lo"), (F.col("ordinal") + neighbours).alias("hi"), "score")
    order = Window.partitionBy("source_id").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("island", F.sum(F.when(before + 1 >= F.col("lo"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("source_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("score").alias("score"))
    parts = chunks.join(islands, "source_id").filter((F.col("ordinal") >= F.col("lo")) & (F.col("ordinal") <= F.col("hi")))
    listed = parts.groupBy("source_id", "island", "score").agg(F.array_sort(F.collect_list(F.struct("ordinal", "char_start", "char_end", "text"))).alias("parts"))

    def text_of(parts: list[dict]) -> str:
        out, end = "", None
        for p in parts:
            units = p["text"].encode("utf-16-le", "surrogatepass")
            skip = 0 if end is None or p["char_start"] >= end else min(end - p["char_start"], len(units) // 2)
            glue = "" if end is None or p["char_start"] <= end else "\n\n"
            out += glue + units[2 * skip :].decode("utf-16-le", "replace")
            end = p["char_end"] if end is None else max(end, p["char_end"])
        return out

    @F.pandas_udf("string")
    def joined(column: pd.Series) -> pd.Series:
        return column.map(text_of)

    return listed.select("source_id", F.get("parts", 0)["ordinal"].alias("first"), F.element_at("parts", -1)["ordinal"].alias("last"), "score", joined("parts").alias("text"))


def metadata_of(column: Column) -> Column:
    """Flat JSON metadata as a map of its string values; malformed text gives an empty map."""
    parsed = F.from_json(column, "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))
