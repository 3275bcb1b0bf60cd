"""Reading and presenting parent documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metadata keys that may leave the library, in flattened form.
PUBLIC_METADATA = (
    "source_file", "original_file", "page", "pages", "heading_path", "entry_type", "entry_name",
    "source_kind", "official_status", "publication_date", "printing", "supersedes", "errata_for", "clarifies",
)
TEXT_LIMIT = 500
LIST_LIMIT = 20
EXCERPT_LIMIT = 240


def read_documents_by_id(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents in the order asked for; unknown or foreign ids are skipped, repeats repeated."""
    wanted = requests.select(
        "request_id", "ruleset_id", F.posexplode("ids").alias("position", "id")
    )
    return wanted.join(docs, ["ruleset_id", "id"])


def project_hits(hits: DataFrame) -> DataFrame:
    """Public form of hits: no content, no priority, metadata limited to allowed keys.

    Texts are cut to 500 characters, lists to 20 items.
    """
    kept = []
    for name, kind in hits.dtypes:
        if name in PUBLIC_METADATA:
            if kind == "string":
                kept.append(F.substring(name, 1, TEXT_LIMIT).alias(name))
            elif kind == "array<string>":
                kept.append(
                    F.transform(F.slice(name, 1, LIST_LIMIT), lambda v: F.substring(v, 1, TEXT_LIMIT)).alias(name)
                )
            else:
                kept.append(F.col(name))
    fixed = [
        c
        for c in (
            "query_id", "rank", "id", "ruleset_id", "source_id", "source_title", "title", "full_path",
            "version", "excerpt", "chunk_id", "chunk_index",
        )
        if c in hits.columns
    ]
    scores = [
        F.round(F.coalesce(F.col(c), F.col("score")), 6).alias(c)
        for c in ("score", "match_score", "parent_score")
        if c in hits.columns
    ]
    return hits.select(*fixed, *scores, *kept)


def sources(docs: DataFrame, order_by: str = "id") -> DataFrame:
    """Per source: title, version and priority of its first document, and the document count."""
    first = F.struct("source_title", "version", "priority")
    return (
        docs.groupBy("ruleset_id", "source_id")
        .agg(F.min_by(first, F.col(order_by)).alias("first"), F.count("*").alias("document_count"))
        .select("ruleset_id", "source_id", "first.*", "document_count")
    )


def corpus_health(docs: DataFrame) -> DataFrame:
    """Document count and the sorted list of libraries, from one partial aggregate per library."""
    return (
        docs.groupBy("ruleset_id")
        .agg(F.count("*").alias("n"))
        .agg(
            F.sum("n").alias("document_count"),
            F.array_join(F.array_sort(F.collect_set("ruleset_id")), ",").alias("rulesets"),
        )
    )
