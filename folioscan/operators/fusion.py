"""Weighted reciprocal-rank fusion of a vector ranking and a lexical ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60
VECTOR_WEIGHT = 1.0
LEXICAL_WEIGHT = 1.2
CANDIDATES = 50
PRIORITY_SCALE = 3333.0


def rrf_fuse(
    vector_hits: DataFrame,
    lexical_hits: DataFrame,
    k: int = RRF_K,
    vector_weight: float = VECTOR_WEIGHT,
    lexical_weight: float = LEXICAL_WEIGHT,
) -> DataFrame:
    """Sum of weight / (k + rank) per (query, document).

    The chunk shown comes from the vector channel when it has the document.
    """
    columns = ["query_id", "doc_id", "rank", "chunk_index"]
    both = vector_hits.select(*columns, F.lit(0).alias("channel")).unionByName(
        lexical_hits.select(*columns, F.lit(1).alias("channel"))
    )
    weight = F.when(F.col("channel") == 0, F.lit(vector_weight)).otherwise(F.lit(lexical_weight))
    return both.groupBy("query_id", "doc_id").agg(
        F.sum(weight / (k + F.col("rank"))).alias("score"),
        F.min_by("chunk_index", "channel").alias("chunk_index"),
        F.min(F.when(F.col("channel") == 0, F.col("rank"))).alias("vector_rank"),
        F.min(F.when(F.col("channel") == 1, F.col("rank"))).alias("lexical_rank"),
    )


def preserve_leader(
    fused: DataFrame,
    k: int = RRF_K,
    vector_weight: float = VECTOR_WEIGHT,
    lexical_weight: float = LEXICAL_WEIGHT,
) -> DataFrame:
    """A channel's first document that the other channel lacks gets the other's first-rank weight.

    Both ranks are already columns of the fused row, so the "absent in the
    other channel" test needs no anti join.
    """
    bonus = (
        F.when((F.col("vector_rank") == 1) & F.col("lexical_rank").isNull(), F.lit(lexical_weight / (k + 1)))
        .when((F.col("lexical_rank") == 1) & F.col("vector_rank").isNull(), F.lit(vector_weight / (k + 1)))
        .otherwise(F.lit(0.0))
    )
    return fused.withColumn("score", F.col("score") + bonus)
