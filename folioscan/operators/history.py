"""Conversation windows: citation labels, history trimming, tool receipts, candidate order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.scale import running_sum
from folioscan.functions.text import token_estimate

# Texts of tool receipts.
RECEIPT_READ = "compacted_read_evidence"
RECEIPT_SEARCH = "compacted_search_results"
RECEIPT_PLAIN = "compacted_tool_result"
NOTE_READ = "正文已注册，最终回答会重新获得完整已读证据。"
NOTE_SEARCH = "完整候选已在上一决策中展示；仍可按 ID 读取。"
NOTE_PLAIN = "完整结果已在上一决策中展示。"


def number_citations(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Label S1, S2, ... by first read of each document; later reads keep the label."""
    firsts = reads.groupBy(*keys, "doc_id").agg(F.min("position").alias("position"))
    order = Window.partitionBy(*keys).orderBy("position", "doc_id")
    return firsts.withColumn("label", F.concat(F.lit("S"), F.row_number().over(order)))


def message_tokens(role: Column, content: Column) -> Column:
    """Token estimate of a message as it is sent: its JSON text."""
    return token_estimate(F.to_json(F.struct(role.alias("role"), content.alias("content"))))


def trim_history(messages: DataFrame, budgets: DataFrame, keys: list[str]) -> DataFrame:
    """Newest messages whose running token sum fits; the newest one always stays.

    Token counts are positive, so the kept rows form a suffix and the first
    overflow ends it. `budgets` has the keys and `budget`.
    """
    summed = running_sum(
        messages, keys, "turn", message_tokens(F.col("role"), F.col("content")), "_sum", descending=True
    )
    newest = messages.groupBy(*keys).agg(F.max("turn").alias("_last"), F.count("*").alias("_n"))
    return (
        summed.join(newest, keys)
        .join(budgets, keys)
        .where((F.col("_sum") <= F.col("budget")) | (F.col("turn") == F.col("_last")))
        .drop("_last", "_n", "budget")
        .withColumnRenamed("_sum", "running_tokens")
    )


def trim_report(messages: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    total = messages.groupBy(*keys).agg(F.count("*").alias("messages"))
    left = kept.groupBy(*keys).agg(F.count("*").alias("kept"), F.max("running_tokens").alias("kept_tokens"))
    return total.join(left, keys).withColumn("dropped", F.col("messages") - F.col("kept"))


ITEM = "array<struct<id:string,citation:string,content:string>>"


def receipt(content: Column) -> Column:
    """Short form of a tool result: its ids and citations, or a bare note if it is no JSON."""
    wrapped = F.when(F.ltrim(content).startswith("["), content).otherwise(F.concat(F.lit("["), content, F.lit("]")))
    items = F.from_json(wrapped, ITEM)
    ids = F.array_distinct(F.filter(F.transform(items, lambda i: i["id"]), lambda v: v.isNotNull() & (v != "")))
    labels = F.array_distinct(
        F.filter(F.transform(items, lambda i: i["citation"]), lambda v: v.isNotNull() & (v != ""))
    )
    is_read = (F.size(labels) > 0) | F.exists(items, lambda i: i["content"].isNotNull())
    parsed = F.to_json(
        F.struct(
            F.when(is_read, F.lit(RECEIPT_READ)).otherwise(F.lit(RECEIPT_SEARCH)).alias("status"),
            ids.alias("resultIds"),
            labels.alias("citations"),
            F.when(is_read, F.lit(NOTE_READ)).otherwise(F.lit(NOTE_SEARCH)).alias("instruction"),
        )
    )
    plain = F.to_json(F.struct(F.lit(RECEIPT_PLAIN).alias("status"), F.lit(NOTE_PLAIN).alias("instruction")))
    return F.when(F.expr("true") & items.isNotNull() & F.try_parse_json(content).isNotNull(), parsed).otherwise(plain)


def compact_tool_messages(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Replace tool results at or before the last assistant message by receipts."""
    last = messages.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("turn"))), F.lit(-1)).alias("_last")
    )
    old = (F.col("role") == "tool") & (F.col("turn") <= F.col("_last"))
    return (
        messages.join(last, keys)
        .withColumn("compacted", old)
        .withColumn("original_tokens", token_estimate(F.col("content")))
        .withColumn("content", F.when(old, receipt(F.col("content"))).otherwise(F.col("content")))
        .drop("_last")
    )


def compaction_report(compacted: DataFrame, keys: list[str]) -> DataFrame:
    tool = F.col("role") == "tool"
    return compacted.groupBy(*keys).agg(
        F.count_if("compacted").alias("compacted_messages"),
        F.coalesce(F.sum(F.when(tool, F.col("original_tokens"))), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum(F.when(tool, token_estimate(F.col("content")))), F.lit(0)).alias("tokens_after"),
    )


def round_robin_candidates(batches: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    """Unread results of several searches interleaved by rank, first occurrence only."""
    firsts = (
        batches.join(registered, [*keys, "doc_id"], "left_anti")
        .groupBy(*keys, "doc_id")
        .agg(F.min(F.struct("rank", "batch")).alias("first"))
    )
    order = Window.partitionBy(*keys).orderBy("first.rank", "first.batch")
    return firsts.withColumn("position", F.row_number().over(order)).select(*keys, "doc_id", "position")


def user_messages(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Latest and previous user message of each conversation."""
    newest = Window.partitionBy(*keys).orderBy(F.col("turn").desc())
    top = (
        messages.where(F.col("role") == "user")
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= 2)
    )
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("content"))).alias("latest"),
        F.max(F.when(F.col("_r") == 2, F.col("content"))).alias("previous"),
    )
