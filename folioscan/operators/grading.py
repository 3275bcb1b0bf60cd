"""Grading of answers, state and ledgers, and the summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import nfkc_casefold

TOOL_CALL_BUDGET = 12


def normalise_answer(text: Column) -> Column:
    """NFKC case fold, dashes unified, white space removed."""
    return F.regexp_replace(F.regexp_replace(nfkc_casefold(text), "[–—−]", "-"), r"(?U)\s+", "")


def grade_answers(answers: DataFrame, required: DataFrame, sources: DataFrame, relevant: DataFrame, source_groups: DataFrame) -> DataFrame:
    """Pass or fail per turn.

    answers(turn_id, answer, error), required(turn_id, group_id, option): each
    group needs one option in the answer. sources(turn_id, doc_id,
    legacy_parent_id) must cover every source group(turn_id, group_id, doc_id)
    if there are any, else hold any relevant(turn_id, doc_id).
    """
    texts = answers.select("turn_id", normalise_answer(F.coalesce("answer", F.lit(""))).alias("_a"))
    options = required.select("turn_id", "group_id", normalise_answer(F.col("option")).alias("_o"))
    groups = (
        options.join(texts, "turn_id")
        .groupBy("turn_id", "group_id")
        .agg(F.bool_or(F.contains("_a", F.col("_o"))).alias("ok"))
        .groupBy("turn_id")
        .agg(F.count_if(~F.col("ok")).alias("missing_required"))
    )
    ids = sources.select(
        "turn_id", F.explode(F.array_compact(F.array("doc_id", "legacy_parent_id"))).alias("doc_id")
    ).distinct()
    covered = (
        source_groups.join(ids.withColumn("_hit", F.lit(True)), ["turn_id", "doc_id"], "left")
        .groupBy("turn_id", "group_id")
        .agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("ok"))
        .groupBy("turn_id")
        .agg(F.count_if(~F.col("ok")).alias("missing_groups"))
    )
    any_relevant = relevant.join(ids, ["turn_id", "doc_id"], "left_semi").select("turn_id", F.lit(True).alias("_any")).distinct()
    rows = (
        answers.join(groups, "turn_id", "left").join(covered, "turn_id", "left").join(any_relevant, "turn_id", "left")
    )
    source_match = F.when(F.col("missing_groups").isNotNull(), F.col("missing_groups") == 0).otherwise(
        F.coalesce("_any", F.lit(False))
    )
    missing = F.coalesce("missing_required", F.lit(0))
    return rows.withColumn("missing_required", missing).withColumn("source_match", source_match).withColumn(
        "passed",
        F.col("error").isNull()
        & (F.trim(F.coalesce("answer", F.lit(""))) != "")
        & (F.col("missing_required") == 0)
        & F.col("source_match"),
    ).drop("_any", "missing_groups")


def parse_verdict(raw: Column) -> Column:
    """struct<factual_correct, hallucination_free> from a judge's text; null where unreadable."""
    body = F.from_json(
        F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1), "factual_correct string, hallucination_free string"
    )

    def truth(value: Column) -> Column:
        low = F.lower(F.trim(value))
        return F.when(value.isNotNull(), low.isin("true", "yes", "1", "1.0"))

    return F.struct(truth(body["factual_correct"]).alias("factual_correct"), truth(body["hallucination_free"]).alias("hallucination_free"))


def summarize_answers(turns: DataFrame) -> DataFrame:
    """Rates over graded turns; verdict rates are null when nothing was judged."""
    answered = F.trim(F.coalesce("answer", F.lit(""))) != ""
    unsupported = answered & ~F.col("source_match") & F.col("error").isNull()
    judged = F.col("factual_correct").isNotNull()

    def rate(part: Column, whole: Column) -> Column:
        return F.round(F.count_if(part) / F.greatest(F.count_if(whole), F.lit(1)), 4)

    return turns.agg(
        F.count("*").alias("turn_count"),
        F.count_if("passed").alias("passed_turns"),
        rate(F.col("passed"), F.lit(True)).alias("pass_rate"),
        F.sum("tool_calls").alias("tool_call_total"),
        F.max("tool_calls").alias("tool_call_max"),
        F.count_if(F.col("tool_calls") <= TOOL_CALL_BUDGET).alias("within_budget"),
        F.count_if(unsupported).alias("unsupported_turns"),
        rate(unsupported, answered).alias("unsupported_rate"),
        F.count_if(judged).alias("judged_turns"),
        F.when(F.count_if(judged) > 0, rate(judged & F.col("factual_correct"), judged)).alias("factual_pass_rate"),
        F.when(F.count_if(judged) > 0, rate(judged & ~F.col("hallucination_free"), judged)).alias("hallucination_rate"),
    )


def case_results(turns: DataFrame, expected: DataFrame) -> DataFrame:
    """A case passes when all its expected turns ran and passed."""
    ran = turns.groupBy("case_id").agg(F.count("*").alias("_n"), F.bool_and("passed").alias("_ok"))
    return expected.join(ran, "case_id", "left").select(
        "case_id", (F.coalesce("_n", F.lit(0)) == F.col("expected_turns")).alias("complete"),
        ((F.coalesce("_n", F.lit(0)) == F.col("expected_turns")) & F.coalesce("_ok", F.lit(False))).alias("passed"),
    )


def reference_text(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """Relevant documents of each case joined in listed order, each under its id; unknown ids drop out."""
    rows = cases.select("case_id", F.posexplode("relevant_ids").alias("position", "id")).join(
        docs.select("id", "content"), "id"
    )
    parts = F.array_sort(
        F.collect_list(F.struct("position", F.concat(F.lit("["), "id", F.lit("]\n"), "content").alias("text")))
    )
    return rows.groupBy("case_id").agg(parts.alias("p")).select(
        "case_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("reference")
    )


def evaluate_state(expected: DataFrame, actual: DataFrame, forbidden: DataFrame, overwrites: DataFrame, cases: DataFrame) -> DataFrame:
    """Retention, overwrite, contamination, revision and probe rates over flattened state paths.

    expected(case_id, path, value), actual(case_id, path, value),
    forbidden(case_id, path, value or null for 'must not exist'),
    overwrites(case_id, path), cases(case_id, truncated, expect_truncation,
    latest_kept, revision_ok, probe_ok nullable, history_turns).
    """
    found = actual.select("case_id", "path", F.col("value").alias("_v"), F.lit(True).alias("_p"))
    held = expected.join(found, ["case_id", "path"], "left").withColumn("ok", F.col("value").eqNullSafe(F.col("_v")) & F.col("_p"))
    per_expected = held.groupBy("case_id").agg(F.count("*").alias("expected"), F.count_if("ok").alias("correct"))
    over = overwrites.join(held.where("ok").select("case_id", "path", F.lit(True).alias("_ok")), ["case_id", "path"], "left")
    per_over = over.groupBy("case_id").agg(F.count("*").alias("overwrites"), F.count_if("_ok").alias("overwritten"))
    broken = forbidden.join(found, ["case_id", "path"], "left").withColumn(
        "bad", F.coalesce(F.col("_p"), F.lit(False)) & (F.col("value").isNull() | F.col("value").eqNullSafe(F.col("_v")))
    )
    per_bad = broken.groupBy("case_id").agg(F.count("*").alias("forbidden"), F.count_if("bad").alias("violations"))
    rows = cases.join(per_expected, "case_id", "left").join(per_over, "case_id", "left").join(per_bad, "case_id", "left").fillna(
        0, ["expected", "correct", "overwrites", "overwritten", "forbidden", "violations"]
    )
    passed = (
        (F.col("correct") == F.col("expected"))
        & (F.col("violations") == 0)
        & (F.col("truncated") == F.col("expect_truncation"))
        & F.col("latest_kept")
        & F.col("revision_ok")
        & F.coalesce("probe_ok", F.lit(True))
    )

    def share(part: str, whole: str) -> Column:
        return F.round(F.sum(part) / F.greatest(F.sum(whole), F.lit(1)), 4)

    return rows.withColumn("passed", passed).agg(
        F.count("*").alias("case_count"),
        F.count_if("passed").alias("passed_cases"),
        F.round(F.count_if("truncated") / F.count("*"), 4).alias("truncation_rate"),
        share("correct", "expected").alias("retention_accuracy"),
        share("overwritten", "overwrites").alias("overwrite_accuracy"),
        share("violations", "forbidden").alias("contamination_rate"),
        F.round(F.count_if("revision_ok") / F.count("*"), 4).alias("revision_accuracy"),
        F.round(F.count_if("probe_ok") / F.greatest(F.count("probe_ok"), F.lit(1)), 4).alias("probe_accuracy"),
    )


def evaluate_ledger(cases: DataFrame, issues: DataFrame, expect_rejected: bool = False) -> DataFrame:
    """cases(answer_id, records); a case passes when no check raised an issue."""
    per_case = issues.groupBy("answer_id").agg(F.count("*").alias("_n"))
    rows = cases.join(per_case, "answer_id", "left").withColumn("passed", F.col("_n").isNull())
    met = ~F.col("passed") if expect_rejected else F.col("passed")
    return rows.agg(
        F.count("*").alias("case_count"),
        F.count_if("passed").alias("passed_cases"),
        F.count_if(~F.col("passed")).alias("rejected_cases"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("ledger_records"),
        F.count_if(met).alias("expectation_passed_cases"),
    )
