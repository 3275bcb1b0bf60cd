"""Token budgets and greedy admission of evidence documents."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARACTERS = 80_000
MAX_TOKENS = 40_000

# Intent -> (searches, documents, token cap, topic shares).
PROFILES = {
    "RULE_FACT": (3, 4, 12_000, {"rule": 1.0}),
    "RULE_FACT_FOLLOW_UP": (5, 6, 24_000, {"rule": 1.0}),
    "PROCEDURE": (4, 6, 24_000, {"steps": 1.0}),
    "COMPARE_OPTIONS": (5, 8, 32_000, {"option_a": 0.45, "option_b": 0.45, "shared": 0.10}),
    "BUILD_ADVICE": (6, 8, 40_000, {"class": 0.34, "feat_spell": 0.33, "multiclass": 0.33}),
}
FOLLOW_UP = "^(?:如果|那么|那|它|这个|这种|前者|后者|上述|刚才)"
# End of fixed values.


@dataclass(frozen=True)
class Limits:
    documents: int = 24
    characters: int = MAX_CHARACTERS
    tokens: int = MAX_TOKENS
    shares: dict[str, float] = field(default_factory=dict)
    strict: bool = False


def allocate_context(turns: DataFrame) -> DataFrame:
    """Split a context window into output, tool, evidence and history budgets.

    Input: context_window, output_reserve, system_tokens, state_tokens.
    """
    window, system, state = F.col("context_window"), F.col("system_tokens"), F.col("state_tokens")
    output = F.least(
        F.greatest(F.lit(1), F.col("output_reserve")), F.greatest(F.lit(1), F.floor(window / 2).cast("int"))
    )
    capacity = F.greatest(F.lit(0), window - F.col("output_tokens"))
    target = F.least(F.lit(40_000), F.floor(F.col("_capacity") / 3).cast("int"))
    return (
        turns.withColumn("output_tokens", output)
        .withColumn("_capacity", capacity)
        .withColumn("_free", F.greatest(F.lit(0), F.col("_capacity") - system - state))
        .withColumn("_target", target)
        .withColumn(
            "tool_tokens",
            F.least(F.lit(48_000), F.col("_target") + 8_000, F.floor(F.col("_free") / 2).cast("int")),
        )
        .withColumn("evidence_tokens", F.least("_target", "tool_tokens"))
        .withColumn("history_tokens", F.col("_free") - F.col("tool_tokens"))
        .drop("_capacity", "_free", "_target")
    )


def evidence_profile(queries: DataFrame, follow_up: str = FOLLOW_UP) -> DataFrame:
    """Search, document and token limits by intent, capped by the available evidence tokens.

    Input: query, intent, evidence_tokens. Facts that lead with a pronoun get
    the wider follow-up limits.
    """
    key = F.when(
        (F.col("intent") == "RULE_FACT") & F.regexp_like(F.trim("query"), F.lit(follow_up)),
        F.lit("RULE_FACT_FOLLOW_UP"),
    ).otherwise(F.col("intent"))

    def pick(index: int) -> Column:
        out = F.lit(None).cast("int")
        for name, row in PROFILES.items():
            out = F.when(F.col("_profile") == name, F.lit(row[index])).otherwise(out)
        return out

    shares = F.lit(None).cast("map<string,double>")
    for name, row in PROFILES.items():
        pairs = [part for topic, share in row[3].items() for part in (F.lit(topic), F.lit(share))]
        shares = F.when(F.col("_profile") == name, F.create_map(*pairs)).otherwise(shares)
    return (
        queries.withColumn("_profile", key)
        .withColumn("max_searches", pick(0))
        .withColumn("max_documents", pick(1))
        .withColumn("max_tokens", F.least(pick(2), F.greatest(F.lit(0), F.col("evidence_tokens"))))
        .withColumn("shares", shares)
        .drop("_profile")
    )


def admit_evidence(reads: DataFrame, limits: Limits, keys: list[str]) -> DataFrame:
    """Greedy admission in read order; one row per read with its reason or 'accepted'.

    Input: keys, position, doc_id, characters, tokens, topic. An oversized
    document is skipped and later ones are still considered. Sequential per
    turn, so it is a fold over the turn's own short list of sizes; texts never
    enter it.
    """
    topics = list(limits.shares)
    shares = list(limits.shares.values())
    n = len(topics)
    token_caps = [max(1, int(limits.tokens * s)) for s in shares]
    recycled = [int(limits.tokens * s) for s in shares]
    doc_caps = [max(1, math.ceil(limits.documents * s)) for s in shares]

    def at(values: list[int], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), index)

    def step(state: Column, row: Column) -> Column:
        index = row["topic_index"]
        known = index > 0
        own_docs = F.coalesce(F.when(known, F.element_at(state["topic_documents"], index)), F.lit(0))
        own_tokens = F.coalesce(F.when(known, F.element_at(state["topic_tokens"], index)), F.lit(0).cast("bigint"))
        if n == 0:
            over_docs = over_tokens = unassigned = F.lit(False)
            if limits.strict:
                unassigned = F.lit(True)
        elif limits.strict:
            unassigned = ~known
            over_docs = own_docs >= at(doc_caps, index)
            over_tokens = own_tokens + row["tokens"] > at(token_caps, index)
        else:
            unassigned = F.lit(False)
            others_empty = sum(
                (
                    F.when((F.lit(j + 1) != index) & (state["topic_documents"][j] == 0), 1).otherwise(0)
                    for j in range(n)
                ),
                F.lit(0),
            )
            spare = sum(
                (
                    F.when((F.lit(j + 1) != index) & (state["topic_documents"][j] > 0), recycled[j]).otherwise(0)
                    for j in range(n)
                ),
                F.lit(0),
            )
            over_docs = own_docs >= F.greatest(F.lit(1), F.lit(limits.documents) - others_empty)
            over_tokens = own_tokens + row["tokens"] > F.greatest(F.lit(1), at(recycled, index) + spare)
        reason = (
            F.when(state["documents"] >= limits.documents, "document_limit")
            .when(unassigned, "unassigned_topic")
            .when(known & over_docs, "topic_document_limit")
            .when(known & over_tokens, "topic_token_budget")
            .when(state["characters"] + row["characters"] > limits.characters, "evidence_budget")
            .when(state["tokens"] + row["tokens"] > limits.tokens, "evidence_token_budget")
            .otherwise("accepted")
        )
        ok = reason == "accepted"
        one = F.when(ok, 1).otherwise(0)
        return F.struct(
            (state["documents"] + one).alias("documents"),
            (state["characters"] + F.when(ok, row["characters"]).otherwise(0)).cast("bigint").alias("characters"),
            (state["tokens"] + F.when(ok, row["tokens"]).otherwise(0)).cast("bigint").alias("tokens"),
            F.transform(
                state["topic_documents"], lambda v, j: F.when(ok & (j + 1 == index), v + 1).otherwise(v)
            ).alias("topic_documents"),
            F.transform(
                state["topic_tokens"], lambda v, j: F.when(ok & (j + 1 == index), v + row["tokens"]).otherwise(v)
            ).alias("topic_tokens"),
            F.concat(
                state["out"],
                F.array(F.struct(row["position"].alias("position"), row["doc_id"].alias("doc_id"), reason.alias("reason"))),
            ).alias("out"),
        )

    position_type = dict(reads.dtypes)["position"]
    doc_type = dict(reads.dtypes)["doc_id"]
    start = F.struct(
        F.lit(0).alias("documents"),
        F.lit(0).cast("bigint").alias("characters"),
        F.lit(0).cast("bigint").alias("tokens"),
        F.array_repeat(F.lit(0), n).alias("topic_documents"),
        F.array_repeat(F.lit(0).cast("bigint"), n).alias("topic_tokens"),
        F.array().cast(f"array<struct<position:{position_type},doc_id:{doc_type},reason:string>>").alias("out"),
    )
    index = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic")) if topics else F.lit(0)
    rows = reads.select(
        *keys,
        F.struct(
            "position",
            "doc_id",
            F.col("characters").cast("bigint").alias("characters"),
            F.col("tokens").cast("bigint").alias("tokens"),
            F.coalesce(index, F.lit(0)).cast("int").alias("topic_index"),
        ).alias("row"),
    )
    folded = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("rows")).select(
        *keys, F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("o")
    )
    return folded.select(*keys, "o.*")


def admit_documents(reads: DataFrame, documents: int, characters: int, keys: list[str]) -> DataFrame:
    """Admission by document count and characters only."""
    return admit_evidence(reads, Limits(documents=documents, characters=characters, tokens=2**62), keys)
