"""Marker flags of documents and queries, and the score adjustments built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.rules import MarkerRules
from folioscan.functions.text import compact, contains_any
from folioscan.schemas import conform

PROSE_WINDOW = 800


def _clean(markers: tuple[str, ...]) -> list[str]:
    kept = ("".join(c for c in m.casefold() if c.isalnum()) for m in markers)
    return [m for m in kept if m]


def document_flags(docs: DataFrame, rules: MarkerRules = MarkerRules()) -> DataFrame:
    """One row per document: compact title and names, and its marker groups.

    Labels are title, path and the label-like metadata; prose counts only in
    the opening part and only when the labels do not name the opposite group.
    """
    docs = conform(docs)
    labels = F.concat_ws(
        " ", "title", "full_path", F.array_join("heading_path", " "), "document_type", "kind", "category", "type"
    )
    base = docs.select(
        F.col("id").alias("doc_id"),
        "priority",
        compact(F.col("title")).alias("compact_title"),
        compact(labels).alias("_labels"),
        compact(F.substring("content", 1, PROSE_WINDOW)).alias("_prose"),
        compact(F.coalesce("entry_name_zh", F.lit(""))).alias("_entry_zh"),
        compact(F.coalesce("entry_name_en", F.lit(""))).alias("_entry_en"),
        compact(F.coalesce("name_zh", F.lit(""))).alias("_zh"),
        compact(F.coalesce("name_en", F.lit(""))).alias("_en"),
        F.coalesce("is_index", F.lit(False)).alias("_i"),
        F.coalesce("is_navigation", F.lit(False)).alias("_n"),
        F.coalesce("is_update_log", F.lit(False)).alias("_u"),
        F.lower(F.coalesce("document_type", F.lit(""))).alias("_kind"),
    )
    multi, favored = _clean(rules.multiclass), _clean(rules.favored)
    label_multi = contains_any(F.col("_labels"), multi)
    label_favored = contains_any(F.col("_labels"), favored)
    return base.select(
        "doc_id",
        "priority",
        "compact_title",
        F.array("_entry_zh", "_entry_en", "_zh", "_en").alias("compact_names"),
        (
            contains_any(F.col("_labels"), _clean(rules.reference))
            | F.col("_i") | F.col("_n") | F.col("_u")
            | F.col("_kind").isin(list(rules.reference_types))
        ).alias("is_reference"),
        (label_favored | (contains_any(F.col("_prose"), favored) & ~label_multi)).alias("is_favored"),
        (label_multi | (contains_any(F.col("_prose"), multi) & ~label_favored)).alias("is_multiclass"),
    )


def query_flags(queries: DataFrame, rules: MarkerRules = MarkerRules()) -> DataFrame:
    folded = queries.select("query_id", compact(F.col("query")).alias("compact_query"))
    return folded.select(
        "query_id",
        "compact_query",
        contains_any(F.col("compact_query"), _clean(rules.multiclass)).alias("multiclass_intent"),
        contains_any(F.col("compact_query"), _clean(rules.favored)).alias("favored_intent"),
    )


def text_key(col: Column) -> Column:
    """Sixteen bytes that stand for a text in an equality test on very many rows."""
    return F.unhex(F.md5(col))


def lexical_adjustment() -> Column:
    """Boosts added to a BM25 score: priority, exact title, and marker groups.

    Expects `query_key` and `title_key`, so that no text travels with the hits.

    A level-mixing document is lifted whether or not the query asks for one.
    """
    title = F.when(
        F.col("query_key") == F.col("title_key"),
        F.when(F.col("is_reference"), F.lit(-4.0)).otherwise(F.lit(5.0)),
    ).otherwise(F.lit(0.0))
    groups = (
        F.when(F.col("favored_intent") & F.col("is_favored"), F.lit(1.0))
        .when(F.col("is_favored"), F.when(F.col("multiclass_intent"), F.lit(-2.5)).otherwise(F.lit(0.0)))
        .when(F.col("is_multiclass"), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return F.greatest(F.lit(0), F.col("priority")) / F.lit(10000.0) + title + groups


def fusion_bonus() -> Column:
    """Small bonuses after rank fusion: title or entry name in the query, marker groups."""
    q = F.col("compact_query")
    title = F.when(
        (F.col("compact_title") != "") & F.contains(q, F.col("compact_title")), F.lit(0.12)
    ).otherwise(F.lit(0.0))
    named = F.when(
        F.exists("compact_names", lambda n: (n != "") & F.contains(q, n)), F.lit(0.10)
    ).otherwise(F.lit(0.0))

    def gated(intent: str, flag: str, amount: float) -> Column:
        return F.when(F.col(intent) & F.col(flag), F.lit(amount)).otherwise(F.lit(0.0))

    return (
        title
        + named
        + gated("multiclass_intent", "is_multiclass", 0.08)
        + gated("multiclass_intent", "is_favored", -0.08)
        + gated("favored_intent", "is_favored", 0.08)
        + gated("favored_intent", "is_multiclass", -0.05)
    )
