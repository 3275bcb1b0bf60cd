"""Jobs over a table of questions: intent, search plans, routing, decomposition, plans, checks.

Every rule is a column expression built from `QueryRules`; all of a question's
segments, domains and tasks stay in its own row until they are exploded, so
none of this shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.query_rules import (
    FORBIDDEN_QUERY, GENERIC_ALIASES, OPTION_TERMS, PLAN_SELECTION, SURVIVAL, TASK_ID, QueryRules,
)
from folioscan.functions.scale import settle
from folioscan.functions.text import collapse_spaces, contains_any, let, ngrams, nfkc_casefold, strip

MAX_QUESTIONS = 4
MAX_TASKS = 6
MAX_QUERY_CHARACTERS = 500
PLANNER_VERSION = 1
ALIAS_GRAM = 4
PAIR = "array<struct<question:string,domain:string>>"
STRINGS = "array<string>"


def _like(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(pattern))


def _none() -> Column:
    return F.array().cast(STRINGS)


# --- intent and search plans --------------------------------------------------------------------


def classify_intent(query: Column, rules: QueryRules = QueryRules()) -> Column:
    """First rule all of whose patterns occur, else a plain rule question."""
    chain = F
    for name, patterns in rules.intents:
        chain = chain.when(reduce(lambda a, b: a & b, [_like(query, p) for p in patterns]), F.lit(name))
    return chain.otherwise(F.lit("RULE_FACT"))


def entry_focus(query: Column, rules: QueryRules = QueryRules()) -> Column:
    """Leading entry name of a fact question, or the empty string."""
    value = strip(query)
    for lead in rules.focus_lead:
        value = F.regexp_replace(value, lead, "")
    focus = F.regexp_replace(F.trim(F.regexp_extract(value, rules.focus, 1)), rules.focus_tail, "")
    return F.when(F.length(focus) >= 2, focus).otherwise(F.lit(""))


def plan_queries(queries: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """Adds intent and the ordered distinct `searches` of each question.

    Optional state columns: current_classes and planned_dips (joined text),
    role_preference.
    """
    intent = classify_intent(F.col("query"), rules)
    original = strip(F.col("query"))
    focus = F.when(F.col("intent") == "RULE_FACT", entry_focus(F.col("query"), rules)).otherwise(F.lit(""))
    simple = F.array_distinct(F.filter(F.array(focus, original), lambda v: v != ""))

    def state(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in queries.columns else F.lit("")

    role = state("role_preference")
    suffix = F.array_join(
        F.filter(F.array(state("current_classes"), state("planned_dips"), role), lambda v: v != ""), " "
    )
    goal = F.when(F.contains(role, F.lit(SURVIVAL)), F.lit(SURVIVAL)).otherwise(role)
    searches = [F.concat(F.col("query"), F.lit(" " + s)) for s in rules.build_searches]
    build = F.array_distinct(
        F.array(*[F.when(suffix != "", F.concat(s, F.lit(" "), suffix, F.lit(" "), goal)).otherwise(s) for s in searches])
    )
    return queries.withColumn("intent", intent).withColumn(
        "searches", F.when(F.col("intent") == "BUILD_ADVICE", build).otherwise(simple)
    )


def is_follow_up(query: Column, rules: QueryRules = QueryRules()) -> Column:
    return _like(strip(query), rules.follow_up)


def merge_follow_up(messages: DataFrame, keys: list[str], rules: QueryRules = QueryRules()) -> DataFrame:
    """Plans per user message; a pronoun-led one starts from the previous message's plan.

    Needs keys, turn, role, content.
    """
    users = messages.where(F.col("role") == "user").withColumnRenamed("content", "query")
    planned = plan_queries(users, rules)
    before = Window.partitionBy(*keys).orderBy("turn")
    linked = planned.withColumn("_q", F.lag("query").over(before)).withColumn("_s", F.lag("searches").over(before))
    follows = (F.coalesce("_q", F.lit("")) != "") & is_follow_up(F.col("query"), rules)
    merged = F.array_distinct(
        F.concat("_s", F.array(F.concat_ws(" ", "_q", "query")), "searches")
    )
    return (
        linked.withColumn("follow_up", follows)
        .withColumn("searches", F.when(F.col("follow_up"), merged).otherwise(F.col("searches")))
        .drop("_q", "_s")
    )


# --- routing and decomposition ------------------------------------------------------------------


def domains_of(query: Column, rules: QueryRules = QueryRules()) -> Column:
    found = F.array_compact(F.array(*[F.when(_like(query, p), F.lit(n)) for n, p in rules.domains]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("rule")))


def primary_domain(query: Column, rules: QueryRules = QueryRules()) -> Column:
    chain = F
    for name, pattern in rules.domains:
        chain = chain.when(_like(query, pattern), F.lit(name))
    return chain.otherwise(F.lit("rule"))


def _with_sign(value: Column, rules: QueryRules) -> Column:
    ends = f"[{rules.sentence_end}]$"
    return F.when(_like(value, ends), F.regexp_replace(value, f"[{rules.sentence_trim}]+$", "")).otherwise(
        F.concat(value, F.lit(rules.question_sign))
    )


def segments_of(query: Column, rules: QueryRules = QueryRules()) -> Column:
    """Sentences of a question; a single sentence may still split at joined goals.

    Joined goals count only if at least two parts carry a question word: a
    list of fields of one table stays one question.
    """
    joined_words = "|".join(rules.joiners)

    def split_all(text: Column) -> Column:
        sentences = F.filter(
            F.transform(F.split(text, rf"(?U)(?<=[{rules.sentence_end}])\s*"), strip), lambda s: s != ""
        )
        parts = F.filter(
            F.transform(
                F.split(text, rf"(?U)\s*[,，]\s*(?=(?:{joined_words}))|\s+(?=(?:{joined_words}))"),
                lambda s: F.regexp_replace(s, "^[ ，,]+|[ ，,]+$", ""),
            ),
            lambda s: s != "",
        )
        marked = F.size(F.filter(parts, lambda s: _like(s, rules.question_marker)))
        single = F.when(text == "", _none()).otherwise(F.array(text))
        return (
            F.when(F.size(sentences) >= 2, F.transform(sentences, lambda s: _with_sign(s, rules)))
            .when((F.size(parts) >= 2) & (marked >= 2), F.transform(parts, lambda s: _with_sign(s, rules)))
            .otherwise(single)
        )

    return let(strip(query), split_all)


def route_queries(queries: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """Adds intent, domains, segments, complexity, reason and the planner flag."""
    value = strip(F.col("query"))
    progression = dict(rules.domains)["progression"]
    others = F.size(F.array_except("domains", F.array(F.lit("progression"))))
    is_complex = (
        _like(value, rules.goal) & _like(value, rules.constraint) & _like(value, progression) & (others >= 2)
    )
    read = settle(
        queries.withColumn("intent", classify_intent(value, rules))
        .withColumn("domains", domains_of(value, rules))
        .withColumn("segments", segments_of(F.col("query"), rules))
    )
    routed = settle(
        read.withColumn(
            "complexity",
            F.when(is_complex, "complex").when(F.size("segments") >= 2, "compound").otherwise("simple"),
        )
    )
    reasons = {
        "complex": "constrained_multi_domain_progression",
        "compound": "explicit_multi_goal",
        "simple": "single_goal_or_uncertain",
    }
    reason = F
    for name, text in reasons.items():
        reason = reason.when(F.col("complexity") == name, F.lit(text))
    return (
        routed.withColumn("reason", reason)
        .withColumn("need_decomposition", F.col("complexity") != "simple")
        .withColumn("need_planner", (F.col("complexity") == "complex") & _like(value, rules.planner))
    )


def _found(query: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)))


def _present(query: Column, words: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(query, F.lit(w)), F.lit(w)) for w in words]))


def domain_terms(query: Column, domain: str, rules: QueryRules = QueryRules()) -> Column:
    """Search terms of one domain that a question names itself."""
    if domain == "class":
        level = F.regexp_extract(query, rules.class_level, 1)
        names = F.transform(
            _found(query, rules.class_names),
            lambda n: F.when(level != "", F.concat(level, F.lit(rules.level_word), n)).otherwise(n),
        )
        tail = F.when(F.size(names) > 0, F.array(F.lit(rules.class_suffix))).otherwise(_none())
        mixed = F.when(
            contains_any(query, list(rules.mixing)), F.array(*[F.lit(w) for w in rules.mixing])
        ).otherwise(_none())
        return F.array_distinct(F.concat(names, tail, mixed))
    pattern = dict(rules.terms).get(domain)
    if pattern is None:
        return _none()
    terms = _found(query, pattern)
    if domain == "spell":
        named = _present(query, rules.named_spells)
        pace, circle = rules.caster_words[0], rules.caster_words[1]
        casting = F.array_distinct(
            F.concat(
                _present(query, rules.casters),
                F.when(
                    F.contains(query, F.lit(pace)) | contains_any(query, list(rules.mixing)), F.array(F.lit(pace))
                ).otherwise(_none()),
                F.when(F.contains(query, F.lit(circle[-2:])), F.array(F.lit(circle))).otherwise(_none()),
            )
        )
        return (
            F.when(F.size(named) > 0, named)
            .when(contains_any(query, list(rules.caster_words)), casting)
            .otherwise(terms)
        )
    if domain == "progression":
        words, extra = rules.progression_mixing
        return F.concat(
            terms,
            F.when(contains_any(query, list(words)), F.array(*[F.lit(e) for e in extra])).otherwise(_none()),
        )
    return terms


def domain_question(query: Column, domain: str, rules: QueryRules = QueryRules()) -> Column:
    terms = domain_terms(query, domain, rules)
    label = dict(rules.labels).get(domain, domain)
    return F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(
        F.concat(F.lit(label + "："), query)
    )


def _first_by_key(pairs: Column) -> Column:
    """Drop later pairs whose question, ignoring blanks and case, and domain are known."""

    def key(p: Column) -> Column:
        text = F.replace(F.lower(F.regexp_replace(p["question"], r"(?U)\s+", "")), F.lit("ß"), F.lit("ss"))
        return F.concat_ws("\u0001", text, p["domain"])

    def distinct(rows: Column) -> Column:
        return let(
            F.transform(rows, key),
            lambda keys: F.filter(rows, lambda p, i: F.array_position(keys, keys[i]) == i + 1),
        )

    return let(pairs, distinct)


def _pair(question: Column, domain: Column) -> Column:
    return F.struct(question.alias("question"), domain.alias("domain"))


def comparison_sides(segment: Column, rules: QueryRules = QueryRules()) -> Column:
    """Two side questions of a comparison, or an empty array."""
    left = F.regexp_replace(F.regexp_extract(segment, rules.comparison_sides, 1), rules.comparison_prefix, "")
    right = F.regexp_extract(segment, rules.comparison_sides, 2)
    ok = (
        _like(segment, rules.comparison)
        & ~F.contains(segment, F.lit(rules.comparison_list))
        & (F.length(left) >= 2)
        & (F.length(right) >= 2)
    )
    ask = F.lit(rules.comparison_question)
    return F.when(ok, F.array(F.concat(left, ask), F.concat(right, ask))).otherwise(_none())


def decompose(routes: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """Adds `questions`: at most four distinct (question, domain) pairs, ids q1...

    A compound question gives one per segment, comparisons one per side; a
    complex one gives one per domain in a fixed priority.
    """
    by_segment = F.flatten(
        F.transform(
            "segments",
            lambda s: let(
                comparison_sides(s, rules),
                lambda sides: F.when(
                    F.size(sides) > 0, F.transform(sides, lambda q: _pair(q, primary_domain(q, rules)))
                ).otherwise(F.array(_pair(s, primary_domain(s, rules)))),
            ),
        )
    )
    query = strip(F.col("query"))
    by_domain = F.array_compact(
        F.array(
            *[
                F.when(
                    F.array_contains("domains", d), _pair(domain_question(query, d, rules), F.lit(d))
                )
                for d in rules.priority
                if d != "rule"
            ]
        )
    )
    pairs = F.when(F.col("complexity") == "complex", by_domain).otherwise(by_segment)
    return settle(
        routes.withColumn(
            "questions",
            F.when(F.col("need_decomposition"), F.slice(_first_by_key(pairs), 1, MAX_QUESTIONS)).otherwise(
                F.array().cast(PAIR)
            ),
        )
    )


def subqueries(decomposed: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """One row per sub-question with its search text."""
    rows = decomposed.select("query_id", F.posexplode("questions").alias("pos", "q")).select(
        "query_id",
        F.concat(F.lit("q"), F.col("pos") + 1).alias("question_id"),
        F.col("q.question").alias("question"),
        F.col("q.domain").alias("domain"),
    )
    return rows.withColumn("search", rewrite(F.col("question"), F.col("domain"), rules))


def rewrite(question: Column, domain: Column, rules: QueryRules = QueryRules()) -> Column:
    """First rewrite rule whose domain and words fit, else the question itself."""
    chain = F
    for wanted, every, some, text in rules.rewrites:
        fits = reduce(lambda a, b: a & b, [F.contains(question, F.lit(w)) for w in every], F.lit(True))
        if some:
            fits = fits & contains_any(question, list(some))
        if wanted is not None:
            fits = fits & (domain == wanted)
        chain = chain.when(fits, F.lit(text))
    return chain.otherwise(question) if rules.rewrites else question


# --- plans ------------------------------------------------------------------------------------


def build_plans(decomposed: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """Bounded task lists for complex questions that need one; columns `tasks` of id, type, query, domain, depends_on.

    Evidence tasks first, progression tasks depending on all of them, and for
    conditional goals a last selection task depending on everything.
    """
    goal = strip(F.col("query"))
    conditional = _like(F.col("query"), rules.conditional)
    limit = F.when(conditional, MAX_TASKS - 1).otherwise(MAX_TASKS)
    extra = F.array_compact(
        F.array(
            *[
                F.when(
                    F.array_contains("domains", d)
                    & ~F.array_contains(F.transform("questions", lambda q: q["domain"]), d),
                    _pair(domain_question(F.col("query"), d, rules), F.lit(d)),
                )
                for d, _ in rules.domains
            ]
        )
    )
    evidence = F.when(
        F.size("questions") < limit, F.slice(F.concat("questions", extra), 1, limit)
    ).otherwise(F.col("questions"))

    def search(q: Column) -> Column:
        whole = F.lit(False)
        for words, fits in rules.whole_goal:
            every = reduce(lambda a, b: a & b, [F.contains(F.col("query"), F.lit(w)) for w in words])
            whole = whole | (every & q["domain"].isin(list(fits)))
        return F.when(whole, rewrite(F.col("query"), q["domain"], rules)).otherwise(
            rewrite(q["question"], q["domain"], rules)
        )

    def task(q: Column, number: Column, kind: Column, needs: Column) -> Column:
        return F.struct(
            F.concat(F.lit("t"), number).alias("id"),
            kind.alias("type"),
            search(q).alias("query"),
            q["domain"].alias("domain"),
            needs.alias("depends_on"),
        )

    def ids(count: Column) -> Column:
        return F.when(
            count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda n: F.concat(F.lit("t"), n))
        ).otherwise(_none())

    def arrange(rows: Column) -> Column:
        foundations = F.filter(rows, lambda q: q["domain"] != "progression")
        progressions = F.filter(rows, lambda q: q["domain"] == "progression")
        base = F.size(foundations)
        first = F.transform(
            foundations,
            lambda q, i: task(
                q, i + 1, F.when(_like(q["question"], rules.compare), "compare").otherwise("rule_research"), _none()
            ),
        )
        second = F.transform(
            progressions, lambda q, i: task(q, base + i + 1, F.lit("progression"), ids(base))
        )
        total = F.size(rows)
        last = F.when(
            conditional & (total < MAX_TASKS),
            F.array(
                F.struct(
                    F.concat(F.lit("t"), total + 1).alias("id"),
                    F.lit("selection").alias("type"),
                    F.lit(PLAN_SELECTION).alias("query"),
                    F.lit("rule").alias("domain"),
                    ids(total).alias("depends_on"),
                )
            ),
        ).otherwise(
            F.array().cast("array<struct<id:string,type:string,query:string,domain:string,depends_on:array<string>>>")
        )
        return F.concat(first, second, last)

    return settle(
        decomposed.where(F.col("need_planner")).select(
            F.col("query_id").alias("plan_id"), goal.alias("goal"), F.lit(PLANNER_VERSION).alias("planner_version"),
            let(evidence, arrange).alias("tasks"),
        )
    )


def plan_tasks(plans: DataFrame) -> DataFrame:
    return plans.select("plan_id", F.posexplode("tasks").alias("position", "t")).select(
        "plan_id", (F.col("position") + 1).alias("position"), F.col("t.id").alias("task_id"), "t.type", "t.query",
        "t.domain", "t.depends_on",
    )


def validate_plans(plans: DataFrame) -> DataFrame:
    """(plan_id, error) with the first violated rule, null for a valid plan.

    Tasks may depend only on earlier ones, which already rules cycles out;
    everything is decided inside the plan's own row.
    """
    tasks = F.col("tasks")
    ids = F.transform(tasks, lambda t: t["id"])

    def first_error(all_ids: Column) -> Column:
        def fault(t: Column, i: Column) -> Column:
            query = F.trim(t["query"])
            needs = t["depends_on"]
            earlier = F.slice(all_ids, 1, i)
            return (
                F.when(~_like(t["id"], TASK_ID), "invalid task id")
                .when((query == "") | (F.length(query) > MAX_QUERY_CHARACTERS), "invalid task query length")
                .when(_like(query, FORBIDDEN_QUERY), "task query contains forbidden capability")
                .when(
                    F.array_contains(needs, t["id"]) | (F.size(F.array_except(needs, all_ids)) > 0),
                    "task dependency is invalid",
                )
                .when(F.size(F.array_except(needs, earlier)) > 0, "tasks must be topologically ordered")
            )

        return F.element_at(F.concat(F.array_compact(F.transform(tasks, fault)), F.array(F.lit(None).cast("string"))), 1)

    error = (
        F.when(F.col("planner_version") != PLANNER_VERSION, "unsupported planner version")
        .when(F.trim("goal") == "", "goal must not be empty")
        .when((F.size(tasks) < 1) | (F.size(tasks) > MAX_TASKS), "task count exceeds bounded plan limit")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "task ids must be unique")
        .otherwise(let(ids, first_error))
    )
    return plans.select("plan_id", error.alias("error"))


def synthesis_checks(goals: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """Up to six ordered checks per goal: (plan_id, check_id, kind, required_domains, unresolved_field).

    `valid` says whether the plan's `domains` can back the check.
    """
    made = F.array_compact(
        F.array(
            *[
                F.when(
                    _like(F.col("goal"), pattern),
                    F.struct(
                        F.lit(kind).alias("kind"),
                        F.array(*[F.lit(d) for d in domains]).cast(STRINGS).alias("required_domains"),
                        F.lit(field).alias("unresolved_field"),
                    ),
                )
                for kind, pattern, domains, field in rules.synthesis
            ]
        )
    )
    rows = goals.select("plan_id", "domains", F.posexplode(F.slice(made, 1, 6)).alias("pos", "c"))
    return rows.select(
        "plan_id",
        F.concat(F.lit("c"), F.col("pos") + 1).alias("check_id"),
        "c.*",
        (
            (F.size("c.required_domains") == 0) | F.arrays_overlap("domains", "c.required_domains")
        ).alias("valid"),
    )


# --- topics, assignment, libraries, hashes --------------------------------------------------------


def comparison_options(query: Column, rules: QueryRules = QueryRules()) -> tuple[Column, Column]:
    value = F.regexp_replace(strip(query), "[？?]+$", "")
    left = F.trim(F.regexp_extract(value, rules.options, 1))
    right = F.trim(F.regexp_replace(F.trim(F.regexp_extract(value, rules.options, 2)), rules.option_lead, ""))
    return left, right


def classify_topics(hits: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """Adds the evidence topic of each hit: query, intent, search, title, full_path, content in."""
    left, right = comparison_options(F.col("query"), rules)
    rows = hits.withColumn("_left", left).withColumn("_right", right)
    text = F.concat_ws(" ", "title", "full_path", "content")
    searchable = F.concat_ws(" ", "search", "title", "full_path", "content")

    def matches(option: str) -> Column:
        plain = F.contains(text, F.col(option))
        for name, other in OPTION_TERMS.items():
            plain = F.when(F.col(option) == name, F.contains(F.col("title"), F.lit(other))).otherwise(plain)
        return plain

    known = (F.col("_left") != "") & (F.col("_right") != "")
    compared = (
        F.when(known & matches("_left") & ~matches("_right"), "option_a")
        .when(known & matches("_right") & ~matches("_left"), "option_b")
        .otherwise("shared")
    )
    build = (
        F.when(_like(searchable, rules.topic_mixing), "multiclass")
        .when(_like(searchable, rules.topic_feats), "feat_spell")
        .otherwise("class")
    )
    topic = (
        F.when(F.col("intent") == "RULE_FACT", "rule")
        .when(F.col("intent") == "PROCEDURE", "steps")
        .when(F.col("intent") == "BUILD_ADVICE", build)
        .otherwise(compared)
    )
    return rows.withColumn("topic", topic).drop("_left", "_right")


def missing_sides(queries: DataFrame, covered: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """Search texts for comparison sides no covered topic stands for."""
    left, right = comparison_options(F.col("query"), rules)
    sides = (
        queries.where(F.col("intent") == "COMPARE_OPTIONS")
        .withColumn("_l", left)
        .withColumn("_r", right)
        .where((F.col("_l") != "") & (F.col("_r") != ""))
        .select(
            "query_id",
            F.explode(
                F.array(
                    F.struct(F.lit("option_a").alias("topic"), F.col("_l").alias("option")),
                    F.struct(F.lit("option_b").alias("topic"), F.col("_r").alias("option")),
                )
            ).alias("s"),
        )
        .select("query_id", "s.*")
    )
    search = F.col("option")
    for name, other in OPTION_TERMS.items():
        search = F.when(F.col("option") == name, F.lit(other)).otherwise(search)
    return sides.join(covered, ["query_id", "topic"], "left_anti").select("query_id", "topic", search.alias("search"))


def normalise_query(query: Column) -> Column:
    """NFKC case fold, letters and digits only."""
    return F.regexp_replace(nfkc_casefold(query), r"[^\p{L}\p{N}]+", "")


def hash_query(query: Column) -> Column:
    """Twelve hex digits of the normalised text's digest; 'empty' when nothing is left."""
    return let(
        normalise_query(query),
        lambda v: F.when(v == "", F.lit("empty")).otherwise(F.substring(F.sha2(v, 256), 1, 12)),
    )


def assign_subquestions(searches: DataFrame, questions: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """The sub-question each search serves, by containment, then a shared run of 4 characters, then domain.

    Input: searches(key, search_id, search), questions(key, question_id,
    question, domain, searched). A plan has at most four questions, so the join
    per key stays bounded; a shared run of four characters is a shared 4-gram.
    """
    left = searches.select("key", "search_id", "search", normalise_query(F.col("search")).alias("_s"))
    right = questions.select(
        "key", "question_id", "domain", "searched", normalise_query(F.col("question")).alias("_q")
    )
    pairs = left.join(right, "key")
    contained = F.contains("_q", F.col("_s")) | F.contains("_s", F.col("_q"))
    shared = F.arrays_overlap(ngrams(F.col("_s"), 4), ngrams(F.col("_q"), 4))
    by_domain = ~F.col("searched") & (F.col("domain") != "rule") & F.array_contains(
        domains_of(F.col("search"), rules), F.col("domain")
    )
    number = F.regexp_extract("question_id", r"(\d+)", 1).cast("int")
    picked = pairs.groupBy("key", "search_id").agg(
        F.min_by("question_id", F.when(contained, number)).alias("_exact"),
        F.min_by("question_id", F.when(shared, number)).alias("_shared"),
        F.count_if(by_domain).alias("_n"),
        F.max(F.when(by_domain, F.col("question_id"))).alias("_domain"),
    )
    return picked.select(
        "key",
        "search_id",
        F.coalesce("_exact", "_shared", F.when(F.col("_n") == 1, F.col("_domain")), F.lit("")).alias("question_id"),
    )


ALIAS_MARKS = r"[^0-9a-z\x{3400}-\x{9fff}]"
EDGE = r"^[ \-–—_/|,，:：;；]+|[ \-–—_/|,，:：;；]+$"


def library_aliases(catalog: DataFrame) -> DataFrame:
    """(library_id, ord, alias) of specific names; catalog has id, ord, name, system, aliases.

    Long enough, not a generic word even without its trailing number.
    """
    pieces = F.flatten(
        F.transform(
            F.array(F.col("id"), F.col("name"), F.col("system")),
            lambda v: F.concat(
                F.array(v, F.regexp_replace(v, r"[(（][^()（）]*[)）]", " ")),
                F.regexp_extract_all(v, F.lit(r"[(（]([^()（）]*)[)）]"), F.lit(1)),
            ),
        )
    )
    rows = catalog.select(
        F.col("id").alias("library_id"),
        "ord",
        F.explode(
            F.concat(
                F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(4).alias("minimum"))),
                F.transform(
                    F.coalesce("aliases", _none()), lambda p: F.struct(p.alias("text"), F.lit(3).alias("minimum"))
                ),
            )
        ).alias("a"),
    ).where(F.col("a.text").isNotNull())
    alias = collapse_spaces(F.regexp_replace(collapse_spaces(nfkc_casefold(F.col("a.text"))), EDGE, ""))
    kept = rows.select("library_id", "ord", alias.alias("alias"), F.col("a.minimum").alias("minimum")).withColumn(
        "_c", F.regexp_replace("alias", ALIAS_MARKS, "")
    )
    generic = list(GENERIC_ALIASES)
    return (
        kept.where(
            (F.length("_c") >= F.col("minimum"))
            & ~F.col("_c").isin(generic)
            & ~F.regexp_replace("_c", r"\d+$", "").isin(generic)
        )
        .select("library_id", "ord", "alias", F.length("_c").alias("length"))
        .distinct()
    )


def detect_other_library(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(message_id, library_id) of another library a message names; message has current_library.

    Only aliases owned by one library count, and naming the current library
    wins; otherwise the longest alias, then the earliest library, then the
    alias text. Messages meet aliases by the first characters of the alias.
    """
    aliases = library_aliases(catalog)
    owned = (
        aliases.groupBy("alias")
        .agg(
            F.count_distinct("library_id").alias("_owners"),
            F.min(F.struct("ord", "library_id", "length")).alias("o"),
        )
        .where(F.col("_owners") == 1)
        .select("alias", "o.ord", "o.library_id", "o.length")
    )
    folded = messages.select(
        "message_id", "current_library", collapse_spaces(nfkc_casefold(F.col("content"))).alias("_m")
    )
    # A name can only occur where its first characters do: the join is on these, of ids without texts.
    keyed = settle(owned.withColumn("_gram", F.left("alias", F.lit(ALIAS_GRAM))))
    lengths = sorted(r[0] for r in keyed.select(F.length("_gram")).distinct().collect())  # at most ALIAS_GRAM of them
    if not lengths:
        return folded.select("message_id", F.lit(None).cast("string").alias("library_id")).limit(0)

    def grams(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("_m") - size + 1, F.lit(1))), lambda i: F.substring(F.col("_m"), i, size))

    spread = folded.select("message_id", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, lengths))))).alias("_gram"))
    options = spread.join(keyed, "_gram").groupBy("message_id").agg(F.collect_set(F.struct("alias", "ord", "library_id", "length")).alias("_options"))

    # Each message meets its few possible names once, in its own row.
    def named(o: Column) -> Column:
        left = F.when(F.regexp_like(F.left(o["alias"], F.lit(1)), F.lit("[a-z0-9]")), F.lit("(?<![A-Za-z0-9])")).otherwise("")
        right = F.when(F.regexp_like(F.right(o["alias"], F.lit(1)), F.lit("[a-z0-9]")), F.lit("(?![A-Za-z0-9])")).otherwise("")
        quoted = F.regexp_replace(o["alias"], r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        return F.contains(F.col("_m"), o["alias"]) & F.regexp_like("_m", F.concat(left, quoted, right))

    hits = folded.join(options, "message_id").select("message_id", "current_library", F.inline(F.filter("_options", named)))
    best = F.max(F.struct(F.col("length"), (-F.col("ord")).alias("o"), "alias", "library_id"))
    return (
        hits.groupBy("message_id")
        .agg(best.alias("best"), F.bool_or(F.coalesce(F.col("library_id") == F.col("current_library"), F.lit(False))).alias("own"))
        .where(~F.col("own"))
        .select("message_id", F.col("best.library_id").alias("library_id"))
    )
