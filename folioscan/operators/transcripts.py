"""Event logs of turns, transcripts, redaction and model reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
# Headings of a transcript.
LIBRARY_LINE, USER_HEAD, ASSISTANT_HEAD = "规则库：", "## 用户", "## 助手"
MODEL_LINE, SOURCES_LINE = "模型：", "来源："


def reconcile_models(conversations: DataFrame, models: DataFrame) -> DataFrame:
    """Conversations with an unknown model move to the first listed one; models(model_id, ord)."""
    first = models.agg(F.min_by("model_id", "ord").alias("_first"))
    known = models.select("model_id", F.lit(True).alias("_known"))
    return (
        conversations.join(known, "model_id", "left")
        .crossJoin(first)
        .withColumn("model_id", F.when(F.col("_known") | F.col("_first").isNull(), F.col("model_id")).otherwise(F.col("_first")))
        .drop("_known", "_first")
    )


def export_transcripts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, markdown). messages: conv_id, turn, role, content, model_label, sources array<string>.

    A transcript is one file by definition; its messages gather per conversation.
    """
    numbered = F.transform("sources", lambda s, i: F.concat(F.concat((i + 1).cast("string"), F.lit(". ")), s))
    lines = F.concat(
        F.array(
            F.when(F.col("role") == "user", USER_HEAD).otherwise(ASSISTANT_HEAD), F.lit(""), F.col("content"), F.lit("")
        ),
        F.when(
            F.coalesce("model_label", F.lit("")) != "", F.array(F.concat(F.lit(MODEL_LINE), "model_label"), F.lit(""))
        ).otherwise(F.array().cast("array<string>")),
        F.when(
            F.coalesce(F.size("sources"), F.lit(0)) > 0, F.concat(F.array(F.lit(SOURCES_LINE), F.lit("")), numbered, F.array(F.lit("")))
        ).otherwise(F.array().cast("array<string>")),
    )
    bodies = messages.select("conv_id", "turn", F.array_join(lines, "\n").alias("text")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m")
    )
    head = F.array(
        F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit(LIBRARY_LINE), "library_id"), F.lit("")
    )
    return conversations.join(bodies, "conv_id", "left").select(
        "conv_id",
        F.array_join(
            F.concat(head, F.coalesce(F.transform("m", lambda x: x["text"]), F.array().cast("array<string>"))), "\n"
        ).alias("markdown"),
    )


def redact(df: DataFrame, column: str, secrets: list[str]) -> DataFrame:
    """Replace every occurrence of each non-empty secret; secrets are a short configured list."""
    text = reduce(
        lambda col, s: F.replace(col, F.lit(s), F.lit(REDACTED)), [s for s in secrets if s], F.col(column)
    )
    return df.withColumn(column, text)


def commit_turns(events: DataFrame) -> DataFrame:
    """Turns without an error commit and raise their session's version by one; others roll back whole.

    events(session_id, turn, type).
    """
    turns = events.groupBy("session_id", "turn").agg(
        F.bool_or(F.col("type") == "error").alias("failed"), F.count_if(F.col("type") == "message").alias("messages")
    )
    order = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = turns.where(~F.col("failed"))
    return kept.select("session_id", "turn", "messages", F.count("*").over(order).alias("version"))


def tool_timeline(events: DataFrame) -> DataFrame:
    """State of each tool entry of a turn.

    Every start adds an entry, and so does an error of a call that has none yet; an end without an
    entry leaves no trace. Ends and errors change the first entry of their call: the last of them
    is its status, and the last error's text stays, whatever follows it.
    events(turn_id, seq, type, call_id, tool_name, error).
    """
    entry = F.col("type").isin("tool_start", "tool_error")
    change = F.col("type").isin("tool_end", "tool_error")
    tools = events.where(entry | change)
    calls = tools.groupBy("turn_id", "call_id").agg(
        F.min(F.when(entry, F.struct("seq", "tool_name"))).alias("first"),
        F.max(F.when(change, F.struct("seq", "type"))).alias("change"),
        F.max(F.when(F.col("type") == "tool_error", F.struct("seq", "error"))).alias("failure"),
    ).where(F.col("first").isNotNull())
    changed = F.coalesce(F.col("change.seq") >= F.col("first.seq"), F.lit(False))
    firsts = calls.select(
        "turn_id", "call_id", F.col("first.seq").alias("seq"), F.col("first.tool_name").alias("tool_name"),
        F.when(changed, F.substring_index("change.type", "_", -1)).otherwise("start").alias("status"),
        F.col("failure.error").alias("error"),
    )
    begun = calls.select(F.col("turn_id").alias("_turn"), F.col("call_id").alias("_call"), F.col("first.seq").alias("_first"))
    later = tools.where(F.col("type") == "tool_start").join(
        begun, F.col("turn_id").eqNullSafe(F.col("_turn")) & F.col("call_id").eqNullSafe(F.col("_call")) & (F.col("seq") > F.col("_first"))
    )
    return firsts.unionByName(
        later.select("turn_id", "call_id", "seq", "tool_name", F.lit("start").alias("status"), F.lit(None).cast("string").alias("error"))
    )


def fold_turn_events(events: DataFrame) -> DataFrame:
    """Per turn: the text of all deltas in order, last sources, tool count, final error.

    events(turn_id, seq, type, delta, sources, error, call_id, tool_name).
    """
    base = events.groupBy("turn_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "text_delta", F.struct("seq", "delta")))).alias("d"),
        F.max_by("sources", F.when(F.col("type") == "sources", F.col("seq"))).alias("sources"),
        F.max_by("error", F.when(F.col("type") == "error", F.col("seq"))).alias("error"),
    )
    tools = tool_timeline(events).groupBy("turn_id").agg(
        F.count("*").alias("tools"), F.count_if(F.col("status") == "error").alias("failed_tools")
    )
    return base.join(tools, "turn_id", "left").select(
        "turn_id",
        F.array_join(F.transform("d", lambda x: x["delta"]), "").alias("text"),
        "sources",
        "error",
        F.coalesce("tools", F.lit(0)).alias("tools"),
        F.coalesce("failed_tools", F.lit(0)).alias("failed_tools"),
    )
