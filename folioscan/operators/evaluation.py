"""Retrieval evaluation: relevance pairs, first relevant rank, hit rate and reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"(?U)[\p{L}\p{N}]+"


def contained_passages(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, doc_id) for every document that contains a passage as a substring.

    Candidates share the passage's rarest inner word (the outer words may be
    cut out of longer ones), so the join is an equi-join on the least frequent
    key instead of a nested loop; `contains` then decides. Passages without an
    inner word are few and short-circuit to a direct test.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    inner = passages.withColumn("w", words).withColumn(
        "inner", F.array_distinct(F.expr("slice(w, 2, greatest(size(w) - 2, 0))"))
    )
    keyed = inner.where(F.size("inner") > 0).select("case_id", "text", F.explode("inner").alias("word"))
    vocabulary = keyed.select("word").distinct()
    doc_words = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).join(
        vocabulary, "word", "left_semi"
    )
    # A word no document holds keeps frequency 0: such a passage has no match at all.
    frequency = doc_words.groupBy("word").agg(F.count("*").alias("df"))
    rarest = (
        keyed.select("case_id", "word")
        .join(frequency, "word", "left")
        .groupBy("case_id")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("pick"))
        .select("case_id", F.col("pick.word").alias("word"))
    )
    texts = docs.select("doc_id", F.col("text").alias("body"))
    candidates = rarest.join(doc_words, "word").select("case_id", "doc_id")
    found = (
        candidates.join(passages, "case_id")
        .join(texts, "doc_id")
        .where(F.contains("body", F.col("text")))
        .select("case_id", "doc_id")
    )
    short = inner.where(F.size("inner") == 0).select("case_id", "text")
    direct = short.join(texts, F.contains("body", F.col("text"))).select("case_id", "doc_id")
    return found.unionByName(direct)


def relevance_rows(cases: DataFrame) -> DataFrame:
    """Explode listed ids to (case_id, key); a case without ids is an error."""
    ids = F.when(F.size("relevant_ids") > 0, F.col("relevant_ids")).otherwise(
        F.raise_error(F.concat(F.lit("case without relevant ids: "), F.col("case_id").cast("string"))).cast(
            "array<string>"
        )
    )
    return cases.select("case_id", F.explode(F.array_distinct(ids)).alias("key"))


def case_rows(hits: DataFrame, relevant: DataFrame, must_not_lead: DataFrame | None = None) -> DataFrame:
    """First relevant rank per case (null on a miss) and must-not-lead violations.

    A hit matches by its own id or its legacy parent id; exploding both keys
    keeps this an equi-join.
    """
    legacy = F.col("legacy_parent_id") if "legacy_parent_id" in hits.columns else F.lit(None).cast("string")
    keys = hits.select(
        "case_id", "rank", F.explode(F.array_distinct(F.array_compact(F.array(F.col("doc_id"), legacy)))).alias("key")
    )
    first = keys.join(relevant, ["case_id", "key"]).groupBy("case_id").agg(F.min("rank").alias("rank"))
    rows = relevant.select("case_id").distinct().join(first, "case_id", "left")
    if must_not_lead is None:
        return rows.withColumn("must_not_lead_violation", F.lit(False))
    blocked = must_not_lead.select("case_id", F.col("doc_id").alias("key"))
    violating = (
        keys.where(F.col("rank") == 1)
        .join(blocked, ["case_id", "key"], "left_semi")
        .select("case_id", F.lit(True).alias("bad"))
        .distinct()
    )
    return rows.join(violating, "case_id", "left").select(
        "case_id", "rank", F.coalesce("bad", F.lit(False)).alias("must_not_lead_violation")
    )


def summarize_cases(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("case_count"),
        F.round(F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1.0)), 4).alias("hit_rate"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 4).alias("mrr"),
        F.count_if("must_not_lead_violation").alias("must_not_lead_violations"),
        (~F.bool_or("must_not_lead_violation")).alias("constraint_pass"),
    )
