"""Overlapping child chunks of parent documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import strip
from folioscan.schemas import conform


def chunk(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of `size` characters stepping `size - overlap`, per structural block.

    Everything happens inside the document's own row, so no shuffle is needed
    and the chunk index simply is the position in the flattened array.
    """
    if size <= overlap:
        raise ValueError("size must be larger than overlap")
    step = size - overlap
    docs = conform(docs)
    whole = F.array(
        F.struct(
            F.array().cast("array<string>").alias("heading_path"),
            F.col("content").alias("content"),
            F.lit(None).cast("int").alias("table_index"),
            F.lit(None).cast("int").alias("row_index"),
        )
    )
    blocks = F.when(F.size("structural_blocks") > 0, F.col("structural_blocks")).otherwise(whole)
    trimmed = F.transform(
        blocks,
        lambda b: F.struct(
            F.coalesce(strip(b["content"]), F.lit("")).alias("content"),
            F.coalesce(
                F.nullif(
                    F.array_join(F.filter(b["heading_path"], lambda h: h != ""), " > "), F.lit("")
                ),
                F.col("full_path"),
            ).alias("path"),
        ),
    )
    windows = F.flatten(
        F.transform(
            F.filter(trimmed, lambda b: b["content"] != ""),
            lambda b: F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.length(b["content"]), F.lit(step)),
                    lambda s: (s == 0) | (s < F.length(b["content"]) - overlap),
                ),
                lambda s: F.struct(
                    b["path"].alias("path"),
                    F.substring(b["content"], s + 1, F.lit(size)).alias("content"),
                ),
            ),
        )
    )
    exploded = docs.select(
        F.col("id").alias("doc_id"),
        "ruleset_id",
        "source_id",
        "title",
        "priority",
        F.posexplode(windows).alias("chunk_index", "w"),
    )
    return exploded.select(
        F.format_string("%s:%05d", "doc_id", "chunk_index").alias("chunk_id"),
        "doc_id",
        "chunk_index",
        "ruleset_id",
        "source_id",
        "priority",
        F.col("w.content").alias("content"),
        F.concat_ws("\n", "title", "w.path", "w.content").alias("search_text"),
    )
