"""Turn metrics, state, tool loops and privacy filters as streams, with their batch forms."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from folioscan.operators.metrics import _long_form
from folioscan.operators.quantiles import exact_percentiles
from folioscan.operators.state import StateRules, observations
from folioscan.operators.transcripts import redact
from folioscan.operators.understanding import hash_query
from folioscan.streaming.limits import whole_key


#: Size of the quantile sketch of a stream's windows; its ranks are off by about 0.4 % of the values at most.
SKETCH = 800
PERCENTILES = {"p50": 0.50, "p95": 0.95}


def metric_windows(records: DataFrame, length: str = "1 hour", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """count, mean, max, p50, p95 per metric and event-time window.

    Of a table, percentiles are exact nearest ranks. Of a stream they come from a mergeable sketch, as
    open windows must not hold their values; `settle_windows` replaces them by exact ones when the
    watermark has closed a window.
    """
    stamped = records.withColumn("ts", F.col("ts").cast("timestamp")) if watermark else records
    source = stamped.withWatermark("ts", watermark) if watermark else stamped
    values = _long_form(source, ["ts"]).where(F.col("value").isNotNull())
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    if records.isStreaming:
        sketch = F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(SKETCH))
        found = values.groupBy(window.alias("w"), "metric").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.max("value").alias("max"), sketch.alias("s"))
        quantiles = [F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(name) for name, p in PERCENTILES.items()]
        return found.select(F.col("w.start").alias("started"), "metric", "count", "mean", "max", *quantiles)
    placed = values.select(window.alias("w"), "metric", "value").select(F.col("w.start").alias("started"), "metric", "value")
    basics = placed.groupBy("started", "metric").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return basics.join(exact_percentiles(placed, ["started", "metric"], "value", PERCENTILES), ["started", "metric"])


def settle_windows(
    records: DataFrame, stored: Callable[[], DataFrame], write: Callable[[DataFrame], None], length: str = "1 hour", watermark: str = "1 hour"
) -> DataStreamWriter:
    """Write exact windows as the watermark closes them: the stream says which, the stored records (see `metrics_sink`) say what."""
    closed = metric_windows(records, length, watermark=watermark).select("started")

    def exact(batch: DataFrame, _: int) -> None:
        started = batch.distinct()
        write(metric_windows(stored(), length).join(started, "started", "left_semi"))

    return closed.writeStream.outputMode("append").foreachBatch(exact)


def unique_requests(records: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated request ids that arrive within the watermark; older rows count as late."""
    stamped = records.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def metrics_sink(records: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append records as JSON lines, partitioned by day."""
    return (
        records.withColumn("day", F.to_date("ts"))
        .writeStream.format("json")
        .partitionBy("day")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def private_metrics(turns: DataFrame, secrets: list[str]) -> DataFrame:
    """Counts and hashes only: redacted length and query hash stay, the texts go."""
    clean = redact(turns, "content", secrets)
    return clean.select(
        *[c for c in turns.columns if c not in ("content",)],
        hash_query(F.col("content")).alias("query_hash"),
        F.length("content").alias("characters"),
    )


def state_values(messages: DataFrame, keys: list[str], rules: StateRules = StateRules()) -> DataFrame:
    """Last value per (conversation, kind, key); on a stream run it in update or complete mode.

    A composition's older members keep an older turn and are dropped by
    `current_state` when the table is read.
    """
    return (
        observations(messages, keys, rules)
        .groupBy(*keys, "kind", "key")
        .agg(F.max(F.struct("turn", "pos", "value")).alias("w"))
        .select(*keys, "kind", "key", F.col("w.value").alias("value"), F.col("w.turn").alias("turn"))
    )


def current_state(values: DataFrame, keys: list[str]) -> DataFrame:
    newest = values.where("kind = 'class'").groupBy(*keys).agg(F.max("turn").alias("_t"))
    return (
        values.join(newest, keys, "left")
        .where((F.col("kind") != "class") | (F.col("turn") == F.col("_t")))
        .drop("_t")
    )


# --- tool loops ---------------------------------------------------------------------------------

MAX_DECISIONS = 10
MAX_SEARCHES = 6
MAX_UNREAD_SEARCHES = 2
MAX_EVIDENCE_SEARCHES = 3
MAX_INVALID = 2
LOOP_SCHEMA = "turn_id string, stop_reason string, decisions int, searches int, documents int"


def tool_loop(steps: DataFrame, max_documents: int = 8) -> DataFrame:
    """Why each turn's tool loop stops, and what it had done by then.

    steps(turn_id, seq, type search|read|other, query (normalised), result_ids).
    Only the first ten decisions of a turn can matter, so the fold runs over at
    most ten short rows.
    """
    order = Window.partitionBy("turn_id").orderBy("seq")
    first = steps.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_DECISIONS)
    strings = "array<string>"
    none = F.array().cast(strings)
    start = F.struct(
        F.lit("").alias("stop"), F.lit(0).alias("decisions"), F.lit(0).alias("searches"), F.lit(0).alias("unread"),
        F.lit(0).alias("invalid"), none.alias("queries"), none.alias("results"), none.alias("documents"),
    )

    def step(s: Column, r: Column) -> Column:
        search, read = r["type"] == "search", r["type"] == "read"
        refused = (
            F.when(r["query"] == "", "empty_query")
            .when(F.array_contains(s["queries"], r["query"]), "repeated_query")
            .when(s["unread"] >= MAX_UNREAD_SEARCHES, "searches_without_read")
            .when(s["searches"] >= MAX_SEARCHES, "search_budget")
        )
        searched = search & refused.isNull()
        fresh_results = F.size(F.array_except(r["ids"], s["results"]))
        after = (
            F.when(F.size(r["ids"]) == 0, "no_results")
            .when(fresh_results == 0, "repeated_results")
            .when((F.size(s["documents"]) > 0) & (s["searches"] + 1 >= MAX_EVIDENCE_SEARCHES), "evidence_saturation")
        )
        room = F.greatest(F.lit(max_documents) - F.size(s["documents"]), F.lit(0))
        asked = F.slice(r["ids"], 1, room)
        admitted = F.array_distinct(F.array_except(asked, s["documents"]))
        read_stop = F.when(room == 0, "answer_document_limit").when(F.size(admitted) == 0, "repeated_documents")
        ok_read = read & read_stop.isNull()
        invalid = F.when(~search & ~read, s["invalid"] + 1).when(searched | ok_read, 0).otherwise(s["invalid"])
        stop = F.coalesce(
            F.when(search, F.coalesce(refused, after)).when(read, read_stop).otherwise(
                F.when(s["invalid"] + 1 >= MAX_INVALID, "invalid_tool_calls")
            ),
            F.lit(""),
        )
        moved = F.struct(
            stop.alias("stop"),
            (s["decisions"] + 1).alias("decisions"),
            (s["searches"] + F.when(searched, 1).otherwise(0)).alias("searches"),
            F.when(searched, s["unread"] + 1).when(ok_read, 0).otherwise(s["unread"]).alias("unread"),
            invalid.alias("invalid"),
            F.when(search & (refused.isNull() | (refused == "search_budget")), F.concat(s["queries"], F.array(r["query"])))
            .otherwise(s["queries"]).alias("queries"),
            F.when(searched, F.array_union(s["results"], r["ids"])).otherwise(s["results"]).alias("results"),
            F.when(ok_read, F.concat(s["documents"], admitted)).otherwise(s["documents"]).alias("documents"),
        )
        return F.when(s["stop"] != "", s).otherwise(moved)

    rows = first.select(
        "turn_id",
        F.struct(
            "seq", "type", F.coalesce("query", F.lit("")).alias("query"),
            F.coalesce("result_ids", none).alias("ids"),
        ).alias("r"),
    )
    folded = rows.groupBy("turn_id").agg(F.aggregate(F.array_sort(F.collect_list("r")), start, step).alias("s"))
    return folded.select(
        "turn_id",
        F.when(F.col("s.stop") != "", F.col("s.stop"))
        .when(F.col("s.decisions") >= MAX_DECISIONS, "decision_limit")
        .otherwise("open")
        .alias("stop_reason"),
        F.col("s.decisions").alias("decisions"),
        F.col("s.searches").alias("searches"),
        F.size("s.documents").alias("documents"),
    )


class ToolLoop(StatefulProcessor):
    """The loop rules on a stream of steps; emits one row when a turn stops."""

    def __init__(self, max_documents: int) -> None:
        self.max_documents = max_documents

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("loop", "body string")

    def _stop(self, s: dict, kind: str, query: str, ids: list[str]) -> str:
        s["decisions"] += 1
        if kind == "search":
            if not query:
                return "empty_query"
            if query in s["queries"]:
                return "repeated_query"
            if s["unread"] >= MAX_UNREAD_SEARCHES:
                return "searches_without_read"
            s["queries"].append(query)
            if s["searches"] >= MAX_SEARCHES:
                return "search_budget"
            s["searches"] += 1
            s["unread"] += 1
            s["invalid"] = 0
            fresh = set(ids) - set(s["results"])
            s["results"] += sorted(fresh)
            if not ids:
                return "no_results"
            if not fresh:
                return "repeated_results"
            return "evidence_saturation" if s["documents"] and s["searches"] >= MAX_EVIDENCE_SEARCHES else ""
        if kind == "read":
            room = max(self.max_documents - len(s["documents"]), 0)
            if not room:
                return "answer_document_limit"
            new = [i for i in dict.fromkeys(ids[:room]) if i not in s["documents"]]
            if not new:
                return "repeated_documents"
            s["documents"] += new
            s["unread"] = s["invalid"] = 0
            return ""
        s["invalid"] += 1
        return "invalid_tool_calls" if s["invalid"] >= MAX_INVALID else ""

    def handleInputRows(self, key, rows, timerValues):
        s = json.loads(self.state.get()[0]) if self.state.exists() else {
            "stop": "", "decisions": 0, "searches": 0, "unread": 0, "invalid": 0, "queries": [], "results": [], "documents": []
        }
        for batch in whole_key(rows, ["seq"]):
            for row in batch.itertuples():
                if s["stop"]:
                    continue
                ids = [str(i) for i in row.result_ids] if row.result_ids is not None else []
                stop = self._stop(s, row.type, row.query or "", ids)
                if not stop and s["decisions"] >= MAX_DECISIONS:
                    stop = "decision_limit"
                if stop:
                    s["stop"] = stop
                    yield pd.DataFrame(
                        [(key[0], stop, s["decisions"], s["searches"], len(s["documents"]))],
                        columns=["turn_id", "stop_reason", "decisions", "searches", "documents"],
                    )
        self.state.update((json.dumps(s),))

    def close(self) -> None:
        pass


def stream_tool_loop(steps: DataFrame, max_documents: int = 8) -> DataFrame:
    return steps.groupBy("turn_id").transformWithStateInPandas(ToolLoop(max_documents), LOOP_SCHEMA, "Append", "None")
