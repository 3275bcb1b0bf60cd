"""Cosine search of a query table against a table of chunk vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A query matrix up to this size is shipped to every task; larger ones go through the grid.
BROADCAST_BYTES = 32 * 1024 * 1024
GRID_QUERIES = 4096
# Queries and vectors that are multiplied at once: a similarity matrix has TILE x TILE entries at most.
TILE = 2048
GRID_VECTORS = 200_000


def _unit_rows(rows: pd.Series) -> np.ndarray:
    matrix = np.array(rows.tolist(), dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0.0, 1.0, norms)


def _best(similarity: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column positions of the k best entries of each row; equal scores go to the smaller id."""
    rounded = np.round(similarity, 9)
    width = rounded.shape[1]
    if width > k:
        kth = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(rounded >= kth)
    else:
        rows, cols = np.nonzero(np.ones_like(rounded, dtype=bool))
    order = np.lexsort((ids[cols], -rounded[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(rounded.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def _scorer(query_ids: np.ndarray, query_matrix: np.ndarray, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            units, ids = _unit_rows(batch["embedding"]), batch["chunk_id"].to_numpy()
            for q in range(0, len(query_matrix), TILE):
                kept_rows, kept_cols, kept = [], [], []
                for v in range(0, len(units), TILE):
                    similarity = query_matrix[q : q + TILE] @ units[v : v + TILE].T
                    rows, cols = _best(similarity, ids[v : v + TILE], k)
                    kept_rows.append(rows + q)
                    kept_cols.append(cols + v)
                    kept.append(similarity[rows, cols])
                rows, cols = np.concatenate(kept_rows), np.concatenate(kept_cols)
                yield pd.DataFrame({"query_id": query_ids[rows], "chunk_id": ids[cols], "similarity": np.concatenate(kept)})

    return score


def nearest_children(
    queries: DataFrame, vectors: DataFrame, k: int = 100, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Exact k nearest chunks per query: (query_id, chunk_id, similarity, rank).

    Each Arrow batch of vectors is scored as one matrix product and reduced to
    its own top k before anything is shuffled. A query matrix beyond the
    checked size is cut into blocks, and every (block, shard) cell is scored
    as its own bounded group, which gives the same exact result.
    """
    id_type = dict(vectors.dtypes)["chunk_id"]
    qid_type = dict(queries.dtypes)["query_id"]
    schema = f"query_id {qid_type}, chunk_id {id_type}, similarity double"
    facts = queries.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")
    ).first()
    narrow = vectors.select("chunk_id", "embedding")
    if facts.n * facts.dim * 8 <= broadcast_bytes:
        local = queries.select("query_id", "embedding").toPandas()
        if local.empty:
            return queries.sparkSession.createDataFrame([], schema + ", rank int")
        ids, matrix = local["query_id"].to_numpy(), _unit_rows(local["embedding"])
        found = narrow.mapInPandas(_scorer(ids, matrix, k), schema)
    else:
        blocks = math.ceil(facts.n / GRID_QUERIES)
        shards = max(1, math.ceil(narrow.count() / GRID_VECTORS))
        left = queries.select(
            "query_id",
            "embedding",
            F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        )
        right = narrow.select(
            "chunk_id",
            "embedding",
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long").alias("block"),
            F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"),
        )

        def cell(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"query_id": [], "chunk_id": [], "similarity": []})
            if q.empty or v.empty:
                return empty
            run = _scorer(q["query_id"].to_numpy(), _unit_rows(q["embedding"]), k)
            parts = [p for s in range(0, len(v), 8192) for p in run(iter([v.iloc[s : s + 8192]]))]
            return pd.concat(parts)

        found = (
            left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(cell, schema)
        )
    window = Window.partitionBy("query_id").orderBy(
        F.round("similarity", 9).desc(), F.col("chunk_id").asc()
    )
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def parent_scores(children: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Roll children up to their best parent: similarity plus max(0, priority) / 10000."""
    facts = vectors.select("chunk_id", "doc_id", "chunk_index", "priority")
    scored = children.withColumnRenamed("rank", "child_rank").join(facts, "chunk_id").withColumn(
        "score",
        F.round(F.col("similarity") + F.greatest(F.lit(0), F.col("priority")) / F.lit(10000.0), 9),
    )
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), F.col("child_rank").asc())
    first_seen = Window.partitionBy("query_id", "doc_id")
    tops = (
        scored.withColumn("pick", F.row_number().over(best))
        .withColumn("first_rank", F.min("child_rank").over(first_seen))
        .where(F.col("pick") == 1)
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first_rank").asc())
    return (
        tops.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("query_id", "doc_id", "chunk_id", "chunk_index", "score", "rank")
    )


def knn_search(
    queries: DataFrame, vectors: DataFrame, k: int = 100, limit: int = 10, sources: list[str] | None = None
) -> DataFrame:
    """Parents ranked by their best child vector; the source filter reaches the scan."""
    if sources:
        vectors = vectors.where(F.col("source_id").isin(sources))
    return parent_scores(nearest_children(queries, vectors, k), vectors, limit)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key value, summed element-wise with partial aggregation."""
    return (
        vectors.select(key, F.posexplode("embedding").alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"))
        .select(key, F.transform("parts", lambda p: p["x"]).alias("embedding"))
    )
