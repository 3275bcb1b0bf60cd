"""Inverted index tables and batch BM25 over a table of queries.

Layout. The texts are hash-partitioned by document once. Every later grouping
that contains the document key (term counts per chunk, chunk scores per query,
best chunk per document) is then local to its partition; only per-term counts
and the top rows of each query travel. The query terms join without a hint, so
Spark itself checks their size before broadcasting and falls back to a shuffled
join with skew splitting when they are large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import let, tokens
from folioscan.operators.chunks import chunk

K1 = 1.5
B = 0.75
# Scores are sums of doubles in no fixed order; ranking compares them at this precision.
TIE_DIGITS = 9


@dataclass
class LexicalIndex:
    """postings(doc_id, chunk_index, length, ..., term, tf) and the per-library statistics."""

    chunks: DataFrame
    postings: DataFrame
    corpus_stats: DataFrame
    term_stats: DataFrame


def tokenize_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its tokens (repeats kept) and their number."""
    return chunks.withColumn("terms", tokens(F.col("search_text"))).withColumn(
        "length", F.size("terms")
    )


def postings(chunks: DataFrame) -> DataFrame:
    """Term frequency per chunk, counted inside the chunk's own short token list.

    Neither a shuffle nor a hash table is needed, and the document
    partitioning of the input stays.
    """
    return counted_terms(chunks).where(F.col("term").isNotNull())


def term_counts(terms: Column) -> Column:
    """(term, tf) of each distinct token of a token list."""
    return F.transform(
        F.array_distinct(terms),
        lambda t: F.struct(t.alias("term"), (F.size(terms) - F.size(F.array_remove(terms, t))).cast("bigint").alias("tf")),
    )


def counted_terms(chunks: DataFrame) -> DataFrame:
    """Postings, and one row without a term for each chunk that has no token."""
    return tokenize_chunks(chunks).select(
        "ruleset_id",
        "source_id",
        "doc_id",
        "chunk_index",
        "length",
        # The outer form keeps the optimizer from repeating the tokenizer in a size filter.
        F.inline_outer(let(F.col("terms"), term_counts)),
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Number of chunks and mean chunk length per library (at least 1)."""
    return (
        tokenize_chunks(chunks)
        .groupBy("ruleset_id")
        .agg(
            F.count("*").alias("chunk_count"),
            F.greatest(F.avg("length"), F.lit(1.0)).alias("average_length"),
        )
    )


def term_stats(postings_df: DataFrame, stats: DataFrame) -> DataFrame:
    """Document frequency and idf per term over the whole library, before any source filter."""
    counts = postings_df.groupBy("ruleset_id", "term").agg(F.count("*").alias("df"))
    n, df = F.col("chunk_count"), F.col("df")
    return counts.join(stats, "ruleset_id").select(
        "ruleset_id",
        "term",
        "df",
        F.log(1.0 + (n - df + 0.5) / (df + 0.5)).alias("idf"),
        "average_length",
    )


def build_index(docs: DataFrame, size: int = 500, overlap: int = 50, persist: bool = True) -> LexicalIndex:
    """All index tables of a corpus from one shuffle of the texts by document.

    Every chunk counts in the number of chunks and in their mean length, with or without tokens.
    """
    spread = docs.repartition("id")
    chunks = chunk(spread, size, overlap)
    counted = counted_terms(chunks)
    if persist:
        counted = counted.persist()
    posting_rows = counted.where(F.col("term").isNotNull())
    stats = (
        counted.groupBy("ruleset_id", "doc_id", "chunk_index", "length")
        .agg(F.count("*").alias("terms"))
        .groupBy("ruleset_id")
        .agg(
            F.count("*").alias("chunk_count"),
            F.greatest(F.avg("length"), F.lit(1.0)).alias("average_length"),
        )
    )
    return LexicalIndex(chunks, posting_rows, stats, term_stats(posting_rows, stats))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, ruleset_id, term, weight) with the repeat count capped at 2."""
    return (
        queries.select("query_id", "ruleset_id", F.explode(tokens(F.col("query"))).alias("term"))
        .groupBy("query_id", "ruleset_id", "term")
        .agg(F.least(F.count("*"), F.lit(2)).alias("weight"))
    )


def bm25_chunk_scores(
    queries: DataFrame, index: LexicalIndex, sources: list[str] | None = None, k1: float = K1, b: float = B
) -> DataFrame:
    """Score of every chunk sharing a term with a query."""
    wanted = query_terms(queries)
    vocabulary = wanted.select("ruleset_id", "term").distinct()
    asked = index.postings.join(vocabulary, ["ruleset_id", "term"], "left_semi")
    statistics = term_stats(asked, index.corpus_stats)
    weights = wanted.join(statistics, ["ruleset_id", "term"]).select(
        "query_id",
        "ruleset_id",
        "term",
        (F.col("weight") * F.col("idf") * (k1 + 1.0)).alias("gain"),
        "average_length",
    )
    rows = index.postings
    if sources:
        rows = rows.where(F.col("source_id").isin(sources))
    tf = F.col("tf")
    norm = k1 * (1.0 - b + b * F.col("length") / F.col("average_length"))
    return (
        rows.join(weights, ["ruleset_id", "term"])
        .groupBy("doc_id", "chunk_index", "query_id")
        .agg(F.sum(F.col("gain") * tf / (tf + norm)).alias("score"))
    )


def max_child(chunk_scores: DataFrame) -> DataFrame:
    """Best chunk per (query, document); the earliest chunk wins a tie; zero scores drop out."""
    ranked = F.struct(
        F.round("score", TIE_DIGITS).alias("s"), (-F.col("chunk_index")).alias("i")
    )
    return (
        chunk_scores.where(F.round("score", TIE_DIGITS) > 0)
        .groupBy("doc_id", "query_id")
        .agg(F.max(ranked).alias("best"))
        .select(
            "query_id",
            "doc_id",
            (-F.col("best.i")).alias("chunk_index"),
            F.col("best.s").alias("match_score"),
        )
    )


def top_k(scored: DataFrame, k: int, order: list) -> DataFrame:
    """Rank within each query and keep the first k; partial limits run before the shuffle."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
