"""Rollups of per-turn metric records: distributions, dimensions, usage and message counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import token_estimate
from folioscan.operators.quantiles import exact_percentiles

# Metric name -> path in the record.
METRIC_PATHS = {
    "latency.totalSeconds": "phases_seconds.total",
    "latency.routingSeconds": "phases_seconds.routing",
    "latency.decisionSeconds": "phases_seconds.decision",
    "latency.retrievalSeconds": "phases_seconds.retrieval",
    "latency.readSeconds": "phases_seconds.read",
    "latency.finalGenerationSeconds": "phases_seconds.finalGeneration",
    "latency.plannerSeconds": "context.plannerSeconds",
    "latency.executorSeconds": "context.executorSeconds",
    "context.historyTokens": "context.historyTokens",
    "context.originalHistoryTokens": "context.originalHistoryTokens",
    "context.systemTokens": "context.systemTokens",
    "context.stateTokens": "context.stateTokens",
    "context.stateFieldCount": "context.stateFieldCount",
    "context.recentHistoryBudgetTokens": "context.recentHistoryBudgetTokens",
    "context.decisionToolBudgetTokens": "context.decisionToolBudgetTokens",
    "context.evidenceBudgetTokens": "context.evidenceBudgetTokens",
    "policy.maxSearches": "context.evidencePolicyMaxSearches",
    "policy.maxAnswerDocuments": "context.evidencePolicyMaxAnswerDocuments",
    "policy.maxEvidenceTokens": "context.evidencePolicyMaxTokens",
    "policy.usedTopics": "context.evidencePolicyUsedTopics",
    "routing.domainCount": "context.routeDomainCount",
    "routing.questionCount": "context.decompositionQuestionCount",
    "routing.coveredQuestionCount": "context.decompositionCoveredQuestionCount",
    "routing.sourcedQuestionCount": "context.decompositionSourcedQuestionCount",
    "planner.taskCount": "context.plannerTaskCount",
    "planner.completedTaskCount": "context.plannerCompletedTaskCount",
    "planner.failedTaskCount": "context.plannerFailedTaskCount",
    "synthesis.checkCount": "context.synthesisCheckCount",
    "synthesis.unresolvedFieldCount": "context.synthesisUnresolvedFieldCount",
    "synthesis.missingEvidenceCheckCount": "context.synthesisMissingEvidenceCheckCount",
    "factLedger.recordCount": "context.factLedgerRecordCount",
    "factLedger.knownCount": "context.factLedgerKnownCount",
    "factLedger.unknownCount": "context.factLedgerUnknownCount",
    "factLedger.conflictingCount": "context.factLedgerConflictingCount",
    "factLedger.validationIssueCount": "context.factValidationIssueCount",
    "latency.factLedgerBuildSeconds": "context.factLedgerBuildSeconds",
    "latency.factLedgerValidationSeconds": "context.factLedgerValidationSeconds",
    "context.compactedToolMessages": "context.compactedToolMessages",
    "context.decisionToolTokensBeforeMax": "context.decisionToolTokensBeforeMax",
    "context.decisionToolTokensAfterMax": "context.decisionToolTokensAfterMax",
    "context.outputReserveTokens": "context.outputReserveTokens",
    "context.finalAnswerTokens": "context.finalAnswerTokens",
    "usage.promptTokens": "usage.promptTokens",
    "usage.completionTokens": "usage.completionTokens",
    "usage.totalTokens": "usage.totalTokens",
    "evidence.characters": "evidence_characters",
    "evidence.tokens": "evidence_tokens",
    "tools.searchCount": "search_count",
    "tools.readDocuments": "read_documents",
    "context.droppedMessages": "dropped_messages",
}
DIMENSION_PATHS = {
    "model_id": "model_id",
    "library_id": "library_id",
    "intent": "intent",
    "stop_reason": "stop_reason",
    "routeComplexity": "context.routeComplexity",
    "routeReasonCode": "context.routeReasonCode",
    "complexPlannerUsed": "context.complexPlannerUsed",
    "synthesisContractVersion": "context.synthesisContractVersion",
    "factLedgerVersion": "context.factLedgerVersion",
    "factLedgerStatus": "context.factLedgerStatus",
    "factLedgerAdapterId": "context.factLedgerAdapterId",
    "factLedgerAdapterVersion": "context.factLedgerAdapterVersion",
}

TURN_METRICS = (
    "request_id string, model_id string, library_id string, intent string, query_hashes array<string>, "
    "phases_seconds struct<routing:double,decision:double,retrieval:double,read:double,"
    "finalGeneration:double,total:double>, context map<string,string>, "
    "usage struct<promptTokens:bigint,completionTokens:bigint,totalTokens:bigint,calls:bigint,"
    "reportedCalls:bigint,estimatedCalls:bigint>, search_count int, read_documents int, "
    "evidence_characters bigint, evidence_tokens bigint, stop_reason string, dropped_messages int"
)


def _raw(path: str, df: DataFrame) -> tuple[Column, str] | None:
    """The column at a path and its type, or None when the records have no such path."""
    head, _, leaf = path.partition(".")
    kinds = dict(df.dtypes)
    if head not in kinds:
        return None
    if not leaf:
        return F.col(head), kinds[head]
    if kinds[head].startswith("struct"):
        field = {f.name: f.dataType.simpleString() for f in df.schema[head].dataType.fields}
        return (F.col(path), field[leaf]) if leaf in field else None
    return F.element_at(F.col(head), F.lit(leaf)), "string"


def _at(path: str, df: DataFrame) -> Column:
    found = _raw(path, df)
    return F.lit(None).cast("string") if found is None else found[0].cast("string")


def _number(col: Column, kind: str) -> Column:
    """Numbers and booleans as doubles; anything else as null."""
    if kind != "string":
        return col.cast("double")
    return F.coalesce(col.try_cast("double"), col.try_cast("boolean").cast("double"))


def _long_form(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, value) of every finite value that is present; absent metrics give no rows."""
    cells = []
    for name, path in METRIC_PATHS.items():
        found = _raw(path, records)
        if found is not None:
            cells.append(F.struct(F.lit(name).alias("metric"), _number(*found).alias("value")))
    present = F.filter(
        F.array(*cells),
        lambda m: m["value"].isNotNull() & ~F.isnan(m["value"]) & (F.abs(m["value"]) < float("inf")),
    )
    return records.select(*(keys or []), F.inline_outer(present)).where(F.col("metric").isNotNull())


def rollup_turn_metrics(records: DataFrame) -> DataFrame:
    """count, mean, p50, p95, max per metric; zeros for a metric nobody reported."""
    values = _long_form(records)
    names = records.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(m) for m in METRIC_PATHS])).alias("metric")
    )
    basics = values.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
    )
    ranks = exact_percentiles(values, ["metric"], "value", {"p50": 0.50, "p95": 0.95})
    found = names.join(basics, "metric", "left").join(ranks, "metric", "left")
    return found.select(
        "metric",
        F.coalesce("count", F.lit(0)).alias("count"),
        *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("mean", "p50", "p95", "max")],
    )


def metric_dimensions(records: DataFrame) -> DataFrame:
    """Value counts of every dimension in one pass; a missing value counts as '-'."""
    cells = [
        F.struct(F.lit(name).alias("dimension"), F.coalesce(_at(path, records), F.lit("-")).alias("value"))
        for name, path in DIMENSION_PATHS.items()
    ]
    return (
        records.select(F.explode(F.array(*cells)).alias("d"))
        .groupBy("d.dimension", "d.value")
        .agg(F.count("*").alias("count"))
    )


def usage_coverage(records: DataFrame) -> DataFrame:
    reported = F.coalesce(F.sum("usage.reportedCalls"), F.lit(0))
    estimated = F.coalesce(F.sum("usage.estimatedCalls"), F.lit(0))
    return records.agg(
        F.count("*").alias("turn_count"),
        reported.alias("reported_calls"),
        estimated.alias("estimated_calls"),
        F.round(reported / F.greatest(reported + estimated, F.lit(1)), 4).alias("reported_rate"),
        F.round(
            F.count_if(F.coalesce("dropped_messages", F.lit(0)) > 0) / F.greatest(F.count("*"), F.lit(1)), 4
        ).alias("truncation_rate"),
    )


def compare_rollups(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of mean, p50, p95 and max for metrics both rollups have."""
    base = baseline.select("metric", *[F.col(s).alias(f"b_{s}") for s in ("mean", "p50", "p95", "max")])
    return current.join(base, "metric").select(
        "metric", *[F.round(F.col(s) - F.col(f"b_{s}"), 4).alias(f"delta_{s}") for s in ("mean", "p50", "p95", "max")]
    )


def usage_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Provider token counts when both are present, else the estimates, never negative."""
    reported = F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()

    def total(kind: str) -> Column:
        picked = F.when(reported, F.col(f"{kind}_tokens")).otherwise(F.col(f"estimated_{kind}_tokens"))
        return F.sum(F.greatest(F.lit(0), picked))

    return calls.groupBy(*keys).agg(
        total("prompt").alias("prompt_tokens"),
        total("completion").alias("completion_tokens"),
        (total("prompt") + total("completion")).alias("total_tokens"),
        F.count("*").alias("calls"),
        F.count_if(reported).alias("reported_calls"),
        F.count_if(~reported).alias("estimated_calls"),
    )


def message_summary(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Token estimate and message count per key and role; no content is kept."""
    return messages.groupBy(*keys, F.coalesce("role", F.lit("unknown")).alias("role")).agg(
        F.count("*").alias("messages"),
        F.sum(token_estimate(F.col("content"))).alias("tokens"),
    )
