"""Search over a table of queries as one plan: candidates, fusion, rerank, prune, present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.rules import MarkerRules, RerankRules
from folioscan.operators import fusion, lexical, markers, rerank, scan, stored_index, vectors
from folioscan.operators.hits import EXCERPT_LIMIT

#: The lexical side: an index written and opened again, tables of the running job, or documents that are read for the questions at hand.
Index = lexical.LexicalIndex | stored_index.StoredIndex | scan.ScannedLibrary
#: Takes questions, documents, index, limit, sources and marker rules; returns ranked (query_id, doc_id, chunk_index, score, rank).
Ranker = Callable[[DataFrame, DataFrame, Index, int, list[str] | None, MarkerRules], DataFrame]

SERVICE_LIMITS = (1, 10)
LIBRARY_LIMITS = (1, 20)


def clamp_limit(limit: int, bounds: tuple[int, int] = LIBRARY_LIMITS) -> int:
    """The rows a caller may ask for per query."""
    return max(bounds[0], min(bounds[1], limit))


def require_queries(queries: DataFrame) -> DataFrame:
    """Fail the job on an empty query text."""
    blank = F.length(F.trim("query")) == 0
    return queries.withColumn(
        "query", F.when(blank, F.raise_error(F.lit("query must not be empty"))).otherwise(F.col("query"))
    )


def lexical_search(
    queries: DataFrame,
    docs: DataFrame,
    index: Index,
    limit: int,
    sources: list[str] | None = None,
    rules: MarkerRules = MarkerRules(),
) -> DataFrame:
    """BM25 per chunk, best chunk per document, boosts, then the first `limit` per query; an empty query fails the job."""
    queries = require_queries(queries)
    if isinstance(index, stored_index.StoredIndex):
        return stored_index.search_index(queries, index, limit, sources, rules)
    if isinstance(index, scan.ScannedLibrary):
        found = scan.search_scan(queries, index, limit, sources, rules)
        if found is not None:
            return found
        index = lexical.build_index(docs, index.size, index.overlap)
    best = lexical.max_child(lexical.bm25_chunk_scores(queries, index, sources))
    doc_side = markers.document_flags(docs, rules).select(
        "doc_id", "priority", "is_reference", "is_favored", "is_multiclass",
        markers.text_key(F.col("compact_title")).alias("title_key"),
    )
    query_side = markers.query_flags(queries, rules).select(
        "query_id", "multiclass_intent", "favored_intent", markers.text_key(F.col("compact_query")).alias("query_key")
    )
    scored = (
        best.join(doc_side, "doc_id")
        .join(query_side, "query_id")
        .withColumn("score", F.round(F.col("match_score") + markers.lexical_adjustment(), lexical.TIE_DIGITS))
        .select("query_id", "doc_id", "chunk_index", "match_score", "score")
    )
    return lexical.top_k(scored, limit, [F.col("score").desc(), F.col("doc_id").asc()])


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    index: Index,
    query_vectors: DataFrame,
    chunk_vectors: DataFrame,
    limit: int,
    sources: list[str] | None = None,
    rules: MarkerRules = MarkerRules(),
) -> DataFrame:
    """Both channels over-fetch, fuse by rank, then the small bonuses decide."""
    fetch = max(limit, fusion.CANDIDATES)
    vector_hits = vectors.knn_search(query_vectors, chunk_vectors, 100, fetch, sources)
    lexical_hits = lexical_search(queries, docs, index, fetch, sources, rules)
    fused = fusion.preserve_leader(fusion.rrf_fuse(vector_hits, lexical_hits))
    return fusion_rerank(fused, docs, queries, limit, rules)


def fusion_rerank(
    fused: DataFrame, docs: DataFrame, queries: DataFrame, limit: int, rules: MarkerRules = MarkerRules()
) -> DataFrame:
    scored = (
        fused.join(markers.document_flags(docs, rules), "doc_id")
        .join(markers.query_flags(queries, rules), "query_id")
        .withColumn(
            "score",
            F.round(
                F.col("score")
                + F.greatest(F.lit(0), F.col("priority")) / F.lit(fusion.PRIORITY_SCALE)
                + markers.fusion_bonus(),
                lexical.TIE_DIGITS,
            ),
        )
        .select("query_id", "doc_id", "chunk_index", "vector_rank", "lexical_rank", "score")
    )
    order = [F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank").asc()]
    return lexical.top_k(scored, limit, order)


def with_excerpts(hits: DataFrame, index: Index) -> DataFrame:
    """Fetch the excerpts of ranked chunks last, so no text travels through the ranking; only chunks of hit documents are joined."""
    wanted = hits.select("doc_id").distinct()
    chunks = index.chunks_of(wanted) if isinstance(index, stored_index.StoredIndex | scan.ScannedLibrary) else index.chunks.join(wanted, "doc_id", "left_semi")
    texts = chunks.select(
        "doc_id", "chunk_index", F.substring("content", 1, EXCERPT_LIMIT).alias("excerpt")
    )
    return hits.join(texts, ["doc_id", "chunk_index"], "left")


def hybrid_ranker(query_vectors: DataFrame, chunk_vectors: DataFrame) -> Ranker:
    """Both channels over the given vectors, as a ranker of `coordinated_search`."""

    def rank(queries: DataFrame, docs: DataFrame, index: Index, limit: int, sources: list[str] | None, rules: MarkerRules) -> DataFrame:
        return hybrid_search(queries, docs, index, query_vectors, chunk_vectors, limit, sources, rules)

    return rank


def coordinated_search(
    queries: DataFrame,
    docs: DataFrame,
    index: Index,
    limit: int,
    ranker: Ranker = lexical_search,
    sources: list[str] | None = None,
    marker_rules: MarkerRules = MarkerRules(),
    rules: RerankRules = RerankRules(),
) -> DataFrame:
    """Expansion, base ranking, heading rerank and lookup pruning, cut to `limit` (at most 20); an empty query fails the job.

    Any ranker serves as the base: `lexical_search`, `hybrid_ranker(...)`, or a caller's own.
    """
    limit = clamp_limit(limit)
    expanded = rerank.expand_queries(require_queries(queries), rules)
    asked = expanded.withColumn("query", F.col("retrieval_query"))
    base = ranker(asked, docs, index, max(limit, fusion.CANDIDATES), sources, marker_rules)
    ranked = rerank.heading_rerank(with_excerpts(base, index), docs, expanded, rules)
    return rerank.direct_lookup_prune(ranked, expanded, rules).where(F.col("rank") <= limit)
