"""Corpus preparation: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import table
from folioscan.llm.packing import pack_online
from folioscan.llm.pii import replace_personal_data
from folioscan.llm.quality import fit_quality, keep_good
from folioscan.llm.simhash import keep_one_of_each
from folioscan.session import ensure_checkpoint_dir

#: The key of the surrogates is a secret of whoever runs the job; this one is for the driver's invented tables.
PII_KEY = b"folioscan example key"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learnt from the given labels, does not reject; null texts count as empty."""
    return keep_good(docs, fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays, the one with the smallest doc_id; rows without an id stay."""
    return keep_one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts with surrogates; n_chars follows the new text. Columns of any name stay, null texts stay null."""
    columns = docs.columns
    new = replace_personal_data(docs, PII_KEY, spans_column=None)
    return new.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*columns) if "n_chars" in columns else new


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each piece of each document stands in the packed sequences."""
    return pack_online(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", drop_bad_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: No SQL says these stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`; what each keeps is written in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
