"""Status propagation over plan tasks and the rollups that judge routing and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.quantiles import exact_percentiles
from folioscan.operators.understanding import MAX_TASKS

TASK_TIMEOUT = 30.0
DEADLINE = 90.0
MAX_SEARCHES = 6


def run_plans(
    tasks: DataFrame, results: DataFrame, max_searches: int = MAX_SEARCHES, timeout: float = TASK_TIMEOUT, deadline: float | None = None
) -> DataFrame:
    """Status and sources of each task, given what its own search found.

    `tasks` has plan_id, position, task_id, type, domain, depends_on; `results`
    has plan_id, task_id, source_ids, seconds. Only tasks that really run use
    up searches and time. A plan has at most six tasks, so its rows fold in
    order inside one short array.
    """
    rows = tasks.join(results, ["plan_id", "task_id"], "left").select(
        "plan_id",
        F.struct(
            "position", "task_id", "type", "domain", "depends_on",
            F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"),
            F.coalesce("seconds", F.lit(0.0)).cast("double").alias("seconds"),
        ).alias("t"),
    )
    done_type = "array<struct<task_id:string,status:string,source_ids:array<string>,domain:string,type:string>>"
    start = F.struct(
        F.lit(0).alias("searches"), F.lit(0.0).cast("double").alias("elapsed"), F.array().cast(done_type).alias("done")
    )

    def step(state, t):
        completed = F.transform(
            F.filter(state["done"], lambda d: d["status"] == "completed"), lambda d: d["task_id"]
        )
        blocked = F.size(F.array_except(t["depends_on"], completed)) > 0
        late = F.lit(False) if deadline is None else state["elapsed"] >= deadline
        selection = t["type"] == "selection"
        inherited = F.array_distinct(
            F.flatten(
                F.transform(
                    F.filter(state["done"], lambda d: F.array_contains(t["depends_on"], d["task_id"])),
                    lambda d: d["source_ids"],
                )
            )
        )
        exhausted = state["searches"] >= max_searches
        has = F.size(F.when(selection, inherited).otherwise(t["source_ids"])) > 0
        status = (
            F.when(blocked, "blocked_dependency")
            .when(late, "deadline_exceeded")
            .when(~selection & exhausted, "budget_exhausted")
            .when(~selection & (t["seconds"] > timeout), "task_timeout")
            .when(has, "completed")
            .otherwise("missing_evidence")
        )
        ran = ~blocked & ~late & ~selection & ~exhausted
        sources = (
            F.when(blocked | late, F.array().cast("array<string>"))
            .when(selection, inherited)
            .when(ran, F.array_sort(t["source_ids"]))
            .otherwise(F.array().cast("array<string>"))
        )
        return F.struct(
            (state["searches"] + F.when(ran, 1).otherwise(0)).alias("searches"),
            (state["elapsed"] + F.when(ran, t["seconds"]).otherwise(0.0)).alias("elapsed"),
            F.concat(
                state["done"],
                F.array(
                    F.struct(
                        t["task_id"].alias("task_id"), status.alias("status"), sources.alias("source_ids"),
                        t["domain"].alias("domain"), t["type"].alias("type"),
                    )
                ),
            ).alias("done"),
        )

    folded = rows.groupBy("plan_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    bounded = folded.withColumn(
        "ts",
        F.when(F.size("ts") <= MAX_TASKS, F.col("ts")).otherwise(
            F.raise_error(F.lit("plan has more than six tasks")).cast(dict(folded.dtypes)["ts"])
        ),
    )
    return bounded.select("plan_id", F.explode(F.aggregate("ts", start, step, lambda s: s["done"])).alias("d")).select(
        "plan_id", "d.*"
    )


def synthesis_readiness(checks: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Whether each check can rest on evidence, with the ordered distinct sources."""
    order = tasks.select("plan_id", "task_id", "position")
    done = (
        results.where(F.col("status") == "completed")
        .join(order, ["plan_id", "task_id"])
        .select("plan_id", F.col("domain").alias("_domain"), "position", F.col("source_ids").alias("_sources"))
    )
    matched = checks.join(done, "plan_id", "left").withColumn(
        "_hit",
        F.col("_domain").isNotNull()
        & ((F.size("required_domains") == 0) | F.array_contains("required_domains", F.col("_domain"))),
    )
    grouped = matched.groupBy("plan_id", "check_id", "kind").agg(
        F.array_sort(F.collect_list(F.when(F.col("_hit"), F.struct("position", "_sources")))).alias("parts")
    )
    sources = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["_sources"])))
    missing = F.col("kind") == "missing_input"
    return grouped.select(
        "plan_id",
        "check_id",
        F.when(missing, "requires_user_branching")
        .when(F.size(sources) > 0, "evidence_available")
        .otherwise("missing_evidence")
        .alias("readiness"),
        F.when(missing, F.array().cast("array<string>")).otherwise(sources).alias("source_ids"),
    )


def evaluate_routing(cases: DataFrame) -> DataFrame:
    """Pass counts, mis-split rate, domain coverage, sub-question counts and latency."""
    covered = F.size(F.array_intersect("expected_domains", "domains"))
    count = F.size("questions")
    rows = cases.select(
        "expected_complexity",
        "need_decomposition",
        F.size("expected_domains").alias("targets"),
        covered.alias("covered"),
        count.alias("count"),
        "routing_seconds",
        (
            (F.col("complexity") == F.col("expected_complexity"))
            & (count == F.col("expected_count"))
            & (covered == F.size("expected_domains"))
            & (count <= 4)
        ).alias("passed"),
    )
    simple = F.col("expected_complexity") == "simple"
    summary = rows.agg(
        F.count("*").alias("case_count"),
        F.count_if("passed").alias("passed_cases"),
        F.round(F.count_if(simple & F.col("need_decomposition")) / F.greatest(F.count_if(simple), F.lit(1)), 4).alias(
            "simple_mis_split_rate"
        ),
        F.round(F.sum("covered") / F.greatest(F.sum("targets"), F.lit(1)), 4).alias("target_coverage_rate"),
        F.round(F.avg("count"), 4).alias("average_subquestions"),
        F.max("count").alias("max_subquestions"),
        F.round(F.avg("routing_seconds") * 1000, 4).alias("latency_mean_ms"),
    )
    p95 = exact_percentiles(rows, [], "routing_seconds", {"p95": 0.95})
    return summary.crossJoin(p95.select(F.round(F.col("p95") * 1000, 4).alias("latency_p95_ms")))


GAPS = ("routing_gap", "domain_capacity_gap", "task_capacity_gap", "dependency_graph_gap", "conditional_branch_gap")


def planning_gaps(cases: DataFrame) -> DataFrame:
    """Why decomposition alone does not suffice for a case, as one flag per reason."""
    got = F.transform("questions", lambda q: q["domain"])
    return (
        cases.withColumn("routing_gap", F.col("complexity") != "complex")
        .withColumn("domain_capacity_gap", F.size(F.array_except("required_domains", got)) > 0)
        .withColumn("task_capacity_gap", F.col("task_count") > F.size("questions"))
        .withColumn("dependency_graph_gap", F.col("dependency_edges") > 0)
        .withColumn("conditional_branch_gap", F.col("conditional"))
        .withColumn("sufficient", ~(F.col(GAPS[0]) | F.col(GAPS[1]) | F.col(GAPS[2]) | F.col(GAPS[3]) | F.col(GAPS[4])))
    )


def evaluate_planning(cases: DataFrame) -> DataFrame:
    rows = planning_gaps(cases)
    expected = F.col("expected_sufficient")
    return rows.agg(
        F.count("*").alias("case_count"),
        F.count_if(F.col("sufficient") == expected).alias("passed_cases"),
        F.count_if("sufficient").alias("sufficient_cases"),
        F.count_if(~F.col("sufficient") & expected).alias("false_triggers"),
        F.count_if(F.col("sufficient") & ~expected).alias("missed_needs"),
        F.count_if("planner_valid").alias("planner_ready_cases"),
        *[F.count_if(g).alias(g) for g in GAPS],
    )
