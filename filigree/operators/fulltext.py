"""BM25 full-text search: plain, prefix, fuzzy and boolean queries, over a column or over written postings.

N, document frequencies and the mean length are those of all documents whose text is not null, whatever the candidates.
A query of plain words counts its terms inside each document's token array; statistics are one aggregate. Prefix and
fuzzy words keep the terms they match in rows, however many these are.
For many queries ``build_index`` writes the terms of each document with their counts, and ``search_many`` joins them.
"""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.text import tokenized, tokens_of
from filigree.session import checkpoint, shared_path

K1, B, MOST_TF = 1.2, 0.75, 65_535


@dataclass(frozen=True)
class Clause:
    """One word of a query by its tokens: kind is term, prefix or fuzzy, the last two with one token; must is required,
    optional or excluded."""

    tokens: tuple[str, ...]
    kind: str = "term"
    distance: int = 0
    must: str = "optional"

    def matches(self, term: Column) -> Column:
        if not self.tokens:
            return F.lit(False)
        if self.kind == "prefix":
            return term.startswith(self.tokens[0])
        if self.kind == "fuzzy":
            return F.levenshtein(term, F.lit(self.tokens[0]), self.distance) >= 0
        return term.isin(*self.tokens)


# A word of a query, with a star, or a tilde and a digit.
_QUERY_WORD = re.compile(r"([^\W_]+)(?:(\*)|(~)(\d?))?")
_MUST = {"AND": "required", "OR": "optional", "NOT": "excluded"}


def parse(query: str, tokenizer: str | None = None) -> list[Clause]:
    """Words with AND, OR, NOT in upper case; ``word*`` is a prefix, ``word~`` and ``word~2`` fuzzy (distance 1, at most 2).

    Words are tokenized as the texts are; a word of several tokens is met by any of them, a prefix or fuzzy word by its
    first. AND makes the clause before it and the next one required, NOT excludes the next; all others are optional.
    """
    words = [m.groups("") for m in _QUERY_WORD.finditer(query)]
    joins = [word in _MUST and not (star or tilde) for word, star, tilde, _ in words]
    clauses: list[Clause] = []
    for i, (word, star, tilde, digit) in enumerate(words):
        if joins[i]:
            continue
        must = _MUST[words[i - 1][0]] if i and joins[i - 1] else "optional"
        # An AND anywhere in the operators that follow reaches back.
        after = next((j for j in range(i + 1, len(words)) if not joins[j]), len(words))
        if must == "optional" and any(words[j][0] == "AND" for j in range(i + 1, after)):
            must = "required"
        tokens = tuple(tokens_of(word, tokenizer))
        kind = "prefix" if star else "fuzzy" if tilde and digit != "0" else "term"
        clauses.append(Clause(tokens if kind == "term" else tokens[:1], kind, min(int(digit or 1), 2) if kind == "fuzzy" else 0, must))
    return clauses


def documents(df: DataFrame, id_col: str, key: str, tokenizer: str | None = None) -> DataFrame:
    """(id, tokens, length) of every document; a null text is none, an empty one counts with length 0."""
    rows = df.filter(F.col(key).isNotNull()).select(F.col(id_col).alias("id"), F.col(key).cast("string").alias("_text"))
    tokens, length = tokenized(F.col("_text"), tokenizer, F.col("tokens"))
    return rows.withColumn("tokens", tokens).select("id", "tokens", length.cast("int").alias("length"))


def search(df: DataFrame, id_col: str, key: str, query: str, k: int, candidates: DataFrame | None = None, tokenizer: str | None = None) -> DataFrame:
    """(id_col, score): the k best documents, ties by id; of the candidates (a column ``id``) where given.

    Boolean words hold after scoring over all wanted terms; a required word that matches no term of the corpus asks
    nothing; a query of excluded words alone finds nothing.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    docs = documents(df, id_col, key, tokenizer)
    clauses = parse(query, tokenizer)
    wanted = [c for c in clauses if c.must != "excluded" and c.tokens]
    nothing = docs.select(F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    if not wanted:
        return nothing
    hits = _exact(docs, clauses) if all(c.kind == "term" for c in clauses) else _open(docs, clauses)
    if hits is None:
        return nothing
    if candidates is not None:
        hits = hits.join(candidates.select("id"), "id", "left_semi")
    return hits.select(F.col("id").alias(id_col), "score").orderBy(F.desc("score"), id_col).limit(k)


def _saturation(tf: Column, mean: float) -> Column:
    t = tf.cast("double")
    return t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))


def _exact(docs: DataFrame, clauses: list[Clause]) -> DataFrame | None:
    """(id, score) for words without wildcards: their few terms are counted inside each document's tokens."""
    terms = list(dict.fromkeys(t for c in clauses for t in c.tokens))
    equal = lambda t: lambda x: x == t
    place = {t: f"t{i}" for i, t in enumerate(terms)}
    # Statistics and scores read what is counted; the texts are tokenized once.
    counted = checkpoint(docs.select("id", "length", *(F.least(F.size(F.filter("tokens", equal(t))), F.lit(MOST_TF)).alias(c) for t, c in place.items())))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col(c) > 0).cast("int")).alias(c) for c in place.values())).head()
    if not stats.n:
        return None
    score = F.lit(0.0)
    for t in dict.fromkeys(t for c in clauses if c.must != "excluded" for t in c.tokens):
        score = score + F.lit(math.log(1 + (stats.n - stats[place[t]] + 0.5) / (stats[place[t]] + 0.5))) * _saturation(F.col(place[t]), stats.mean or 1.0)
    holds = lambda c: reduce(operator.or_, (F.col(place[t]) > 0 for t in c.tokens), F.lit(False))
    hits = counted.filter(reduce(operator.or_, (holds(c) for c in clauses if c.must != "excluded")))
    for c in clauses:
        if c.must == "excluded" and c.tokens:
            hits = hits.filter(~holds(c))
        elif c.must == "required" and c.tokens:
            hits = hits.filter(holds(c))
    return hits.select("id", score.alias("score"))


def _open(docs: DataFrame, clauses: list[Clause]) -> DataFrame | None:
    """(id, score) with prefix and fuzzy words, which may match any number of terms: what matches stays in rows.

    Which clauses a term matches is seen from the term, so terms meet only their own document frequencies.
    """
    matched = lambda term: reduce(operator.or_, (c.matches(term) for c in clauses))
    # Statistics, frequencies and scores read what matched; the texts are tokenized once.
    some = checkpoint(docs.select("id", "length", F.filter("tokens", matched).alias("terms")))
    stats = some.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).head()
    if not stats.n:
        return None
    found = some.select("id", "length", F.explode("terms").alias("term")).groupBy("id", "length", "term").agg(F.least(F.count("*"), F.lit(MOST_TF)).alias("tf"))
    flags = [c.matches(F.col("term")).alias(f"c{i}") for i, c in enumerate(clauses)]
    terms = found.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", *flags)
    seen = terms.agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(len(clauses)))).head()
    positive = reduce(operator.or_, (F.col(f"c{i}") for i, c in enumerate(clauses) if c.must != "excluded"))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(positive, idf * _saturation(F.col("tf"), stats.mean or 1.0))
    by_doc = found.join(terms, "term").groupBy("id").agg(F.sum(part).alias("score"), *(F.max(f"c{i}").alias(f"c{i}") for i in range(len(clauses))))
    hits = by_doc.filter("score is not null")
    for i, c in enumerate(clauses):
        if c.must == "excluded":
            hits = hits.filter(~F.col(f"c{i}"))
        elif c.must == "required" and seen[f"c{i}"]:
            hits = hits.filter(F.col(f"c{i}"))
    return hits.select("id", "score")


def build_index(df: DataFrame, id_col: str, key: str, tokenizer: str | None = None) -> dict[str, DataFrame]:
    """postings(term, id, tf, length), norms(id, length) and terms(term, df), read from one file set in the shared folder;
    copy it elsewhere to keep it.

    A document's tokens are sorted and counted where they are, without a shuffle, and lie in its row as terms with their
    counts; Parquet keeps a term once per file, and an id and a length once per document.
    """
    held = documents(df, id_col, key, tokenizer).select("id", "length", F.sort_array("tokens").alias("s"))
    # A term begins where a token differs from the one before it, and its count ends where the next begins.
    begins = F.filter(F.transform("s", lambda t, i: F.when(~t.eqNullSafe(F.get("s", i - 1)), i)), lambda i: i.isNotNull())
    held = held.withColumn("b", begins)
    entry = lambda i, k: F.struct(F.get("s", i).alias("term"), F.least(F.coalesce(F.get("b", k + 1), F.size("s")) - i, F.lit(MOST_TF)).alias("tf"))
    path = shared_path(df.sparkSession, "postings")
    held.select("id", "length", F.transform("b", entry).alias("terms")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    postings = rows.select("id", "length", F.explode("terms").alias("t")).select("t.term", "id", "t.tf", "length")
    return {"postings": postings, "norms": rows.select("id", "length"), "terms": postings.groupBy("term").agg(F.count("*").alias("df"))}


def search_many(index: dict[str, DataFrame], queries: DataFrame, k: int, tokenizer: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) for queries(query_id, text) of plain words, a word counting once a query.

    Queries of the same words are searched once and share the result. Their terms meet the postings in a join on the
    term; AQE splits a frequent term's postings, and each task keeps k rows a search before the last shuffle.
    """
    words, _ = tokenized(F.col("text"), tokenizer)
    each = queries.select("query_id", F.array_distinct(words).alias("words"))
    # A query may come in several rows, and a word then counts once a row.
    asked = checkpoint(each.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("words"))).alias("words")))
    searches = checkpoint(asked.select("words").distinct().withColumn("_s", F.monotonically_increasing_id()))
    terms = searches.select("_s", F.explode("words").alias("term"))
    stats = index["norms"].agg(F.count("*").alias("n"), F.avg("length").alias("mean")).head()
    n, mean = stats.n, float(stats.mean or 1.0)
    # Only postings that some query asks for are counted, and written for the scores to read.
    found = checkpoint(index["postings"].join(terms.select("term").distinct(), "term", "left_semi"))
    hits = terms.join(found, "term").join(found.groupBy("term").agg(F.count("*").alias("df")), "term")
    t = F.col("tf").cast("double")
    part = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / mean))
    scored = hits.groupBy("_s", "id").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("_s").orderBy(F.desc(F.round("score", 9)), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.join(searches, "words").join(best, "_s").select("query_id", "id", "score", "rank")
