"""Question understanding over the user messages of `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions.query_rules import PLAN_SELECTION, QueryRules
from folioscan.operators import planning, understanding
from folioscan.registry.common import compact_sql, query, table

# Latin-script rules of the same shapes for the Latin-script test tables.
RULES = QueryRules(
    intents=(
        ("BUILD_ADVICE", ("hand|eauen|keiten",)),
        ("BUILD_ADVICE", ("tion", "anth|eaux|ung")),
        ("COMPARE_OPTIONS", ("ering|elle|schein",)),
        ("PROCEDURE", ("th.+on|le|und",)),
    ),
    focus_lead=("^(?:The |La )+", "^(?:Of|De)"),
    focus="^([A-Za-z ,.]{2,24}?)(?:th|de|er)",
    focus_tail="(?:e|s)$",
    build_searches=("alpha", "beta gamma", "delta"),
    follow_up="^(?:The|Th|La|Le|De|Die|Er)",
    domains=(
        ("class", "tion"), ("race", "eau|the"), ("feat", "ung|ble"), ("spell", "ing|que"), ("equipment", "ent|and"),
        ("progression", "er"),
    ),
    goal="(?i)in|le",
    constraint="on|de",
    planner="that|que|und",
    sentence_end="?.;",
    sentence_trim=".;",
    question_sign="?",
    joiners=("the", "le", "der"),
    question_marker="(?:on|que|ie)",
    comparison="an|ie",
    comparison_list=":",
    comparison_sides="([a-z]{2,20}?)(?: of | de | der )([a-z]{2,20}?)(?: |,)",
    comparison_prefix="^(?:an|re)",
    comparison_question=" rules?",
    labels=(("class", "Classes"), ("race", "Races"), ("feat", "Feats"), ("spell", "Spells"), ("equipment", "Gear"), ("progression", "Growth")),
    terms=(("race", "eau[a-z]*|theun"), ("feat", "[a-z]{0,6}ung"), ("spell", "[a-z]{2,8}ing"), ("equipment", "[a-z]{0,6}ent")),
    class_names="tionhe|tionth|tionan",
    class_level="(on)(?:th)?e",
    class_suffix="skills",
    level_word="-",
    mixing=("queeau", "andth"),
    named_spells=("thing", "quevi"),
    caster_words=("onthe", "erin", "quele"),
    casters=("her", "vie"),
    progression_mixing=(("andth",), ("rise", "each")),
    rewrites=(
        ("class", ("skills",), (), "class skills table"),
        (None, ("er", "tion"), ("ble", "eux"), "growth table"),
        ("spell", ("ing",), (), "spell list"),
        (None, ("quevi",), (), "named entry"),
    ),
    whole_goal=((("tionhe",), ("class", "spell")), (("that",), ("equipment",))),
    conditional="thin|que|sch",
    compare="ing|eau",
    synthesis=(
        ("missing_input", "thr", (), "target"),
        ("conditional_branch", "thin|que|sch", (), ""),
        ("level_arithmetic", "er", ("class", "progression"), ""),
        ("feat_eligibility", "(?i)UNG|ble", ("feat", "class", "race"), ""),
        ("spell_progression", "ing|que", ("spell", "class", "progression"), ""),
        ("equipment_stat", "ent", ("equipment", "rule"), ""),
    ),
    topic_mixing="andth|queeau",
    topic_feats="ung|ble",
    options="([a-z ]{1,30}?)(?: of | de | der )([a-z ]{1,30}?)(?: |,)",
    option_lead="^(?:the |la )",
)


def asked(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", F.col("text").alias("query")
    )


ASKED = """ql AS (
  SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, text AS query,
         regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS v FROM conversations WHERE role = 'user')"""


def intent_sql(v: str) -> str:
    arms = " ".join(
        "WHEN " + " AND ".join(f"regexp_matches({v}, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in RULES.intents
    )
    return f"CASE {arms} ELSE 'RULE_FACT' END"


def focus_sql(v: str) -> str:
    for lead in RULES.focus_lead:
        v = f"regexp_replace({v}, '{lead}', '')"
    f = f"regexp_replace(trim(regexp_extract({v}, '{RULES.focus}', 1)), '{RULES.focus_tail}', '')"
    return f"CASE WHEN length({f}) >= 2 THEN {f} ELSE '' END"


def distinct_sql(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


PLANNED = ASKED + f""",
qi AS (SELECT *, {intent_sql("v")} AS intent, {focus_sql("v")} AS focus FROM ql),
planned AS (
  SELECT *, CASE WHEN intent = 'BUILD_ADVICE' THEN [{", ".join(f"query || ' {s}'" for s in RULES.build_searches)}]
    WHEN intent = 'RULE_FACT' THEN {distinct_sql("list_filter([focus, v], lambda x: x <> '')")}
    ELSE list_filter([v], lambda x: x <> '') END AS searches FROM qi)"""


@query("classify_intent", f"WITH {PLANNED} SELECT intent, count(*) AS questions FROM planned GROUP BY intent")
def _intent(spark, sf):
    rows = asked(spark, sf).select(understanding.classify_intent(F.col("query"), RULES).alias("intent"))
    return rows.groupBy("intent").agg(F.count("*").alias("questions"))


@query("plan_queries", f"WITH {PLANNED} SELECT query_id, intent, array_to_string(searches, '|') AS searches FROM planned")
def _plan(spark, sf):
    return understanding.plan_queries(asked(spark, sf), RULES).select(
        "query_id", "intent", F.array_join("searches", "|").alias("searches")
    )


@query(
    "merge_follow_up",
    f"""WITH {PLANNED}, l AS (SELECT *, lag(query) OVER w AS pq, lag(searches) OVER w AS ps FROM planned WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    f AS (SELECT *, coalesce(pq, '') <> '' AND regexp_matches(v, '{RULES.follow_up}') AS follow_up FROM l),
    m AS (SELECT conv_id, turn, follow_up, CASE WHEN follow_up THEN list_concat(ps, [pq || ' ' || query], searches) ELSE searches END AS s FROM f)
    SELECT conv_id, turn, follow_up, array_to_string({distinct_sql("s")}, '|') AS searches FROM m""",
)
def _merge(spark, sf):
    messages = table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return understanding.merge_follow_up(messages, ["conv_id"], RULES).select(
        "conv_id", "turn", "follow_up", F.array_join("searches", "|").alias("searches")
    )


_END, _TRIM = RULES.sentence_end, RULES.sentence_trim
_JOIN = "|".join(RULES.joiners)


def sign_sql(s: str) -> str:
    return (
        f"CASE WHEN regexp_matches({s}, '[{_END}]$') THEN regexp_replace({s}, '[{_TRIM}]+$', '') ELSE {s} || '?' END"
    )


def domains_sql(v: str) -> str:
    found = "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches({v}, '{p}') THEN '{n}' END" for n, p in RULES.domains
    ) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['rule'] END"


def primary_sql(v: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({v}, '{p}') THEN '{n}'" for n, p in RULES.domains) + " ELSE 'rule' END"


ROUTED = ASKED + f""",
seg AS (
  SELECT *, {intent_sql("v")} AS intent, {domains_sql("v")} AS domains,
    list_filter(list_transform(string_split(regexp_replace(v, '([{_END}])\\s*', '\\1' || chr(1), 'g'), chr(1)),
      lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS sentences,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(v, '\\s*[,，]\\s*({_JOIN})', chr(1) || '\\1', 'g'),
      '\\s+({_JOIN})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^[ ，,]+|[ ，,]+$', '', 'g')), lambda x: x <> '') AS parts
  FROM ql),
seg2 AS (
  SELECT *, CASE WHEN len(sentences) >= 2 THEN list_transform(sentences, lambda x: {sign_sql("x")})
    WHEN len(parts) >= 2 AND len(list_filter(parts, lambda x: regexp_matches(x, '{RULES.question_marker}'))) >= 2
      THEN list_transform(parts, lambda x: {sign_sql("x")}) WHEN v = '' THEN [] ELSE [v] END AS segments FROM seg),
routes AS (
  SELECT *, CASE WHEN regexp_matches(v, '{RULES.goal}') AND regexp_matches(v, '{RULES.constraint}') AND regexp_matches(v, 'er')
      AND len(list_filter(domains, lambda d: d <> 'progression')) >= 2 THEN 'complex'
    WHEN len(segments) >= 2 THEN 'compound' ELSE 'simple' END AS complexity FROM seg2),
routed AS (
  SELECT *, CASE complexity WHEN 'complex' THEN 'constrained_multi_domain_progression' WHEN 'compound' THEN 'explicit_multi_goal'
      ELSE 'single_goal_or_uncertain' END AS reason, complexity <> 'simple' AS need_decomposition,
    complexity = 'complex' AND regexp_matches(v, '{RULES.planner}') AS need_planner FROM routes)"""


def _routed(spark, sf):
    return understanding.route_queries(asked(spark, sf), RULES)


@query(
    "route_queries",
    f"""WITH {ROUTED} SELECT query_id, intent, array_to_string(domains, ',') AS domains, array_to_string(segments, '|') AS segments,
    complexity, reason, need_planner FROM routed""",
)
def _route(spark, sf):
    return _routed(spark, sf).select(
        "query_id", "intent", F.array_join("domains", ",").alias("domains"), F.array_join("segments", "|").alias("segments"),
        "complexity", "reason", "need_planner",
    )


def found_sql(v: str, pattern: str) -> str:
    return distinct_sql(f"regexp_extract_all({v}, '{pattern}')")


def present_sql(v: str, words) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({v}, '{w}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


def any_in(v: str, words) -> str:
    return "(" + " OR ".join(f"contains({v}, '{w}')" for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def terms_sql(v: str, domain: str) -> str:
    if domain == "class":
        names = found_sql(v, RULES.class_names)
        level = f"regexp_extract({v}, '{RULES.class_level}', 1)"
        lev = f"list_transform({names}, lambda x: CASE WHEN {level} <> '' THEN {level} || '{RULES.level_word}' || x ELSE x END)"
        return (
            f"list_concat({lev}, CASE WHEN len({names}) > 0 THEN ['{RULES.class_suffix}'] ELSE [] END, "
            f"CASE WHEN {any_in(v, RULES.mixing)} THEN {_list(RULES.mixing)} ELSE [] END)"
        )
    pattern = dict(RULES.terms).get(domain)
    if pattern is None:
        return "CAST([] AS VARCHAR[])"
    found = found_sql(v, pattern)
    if domain == "spell":
        named = present_sql(v, RULES.named_spells)
        pace, circle = RULES.caster_words[0], RULES.caster_words[1]
        casting = (
            f"list_concat({present_sql(v, RULES.casters)}, CASE WHEN contains({v}, '{pace}') OR {any_in(v, RULES.mixing)} "
            f"THEN ['{pace}'] ELSE [] END, CASE WHEN contains({v}, '{circle[-2:]}') THEN ['{circle}'] ELSE [] END)"
        )
        return f"CASE WHEN len({named}) > 0 THEN {named} WHEN {any_in(v, RULES.caster_words)} THEN {casting} ELSE {found} END"
    return found


def domain_question_sql(v: str, domain: str) -> str:
    t = terms_sql(v, domain)
    return f"CASE WHEN len({t}) > 0 THEN array_to_string({t}, ' ') ELSE '{dict(RULES.labels)[domain]}：' || {v} END"


def rewrite_sql(q: str, d: str) -> str:
    arms = []
    for wanted, every, some, text in RULES.rewrites:
        test = " AND ".join(f"contains({q}, '{w}')" for w in every)
        if some:
            test += f" AND {any_in(q, some)}"
        if wanted:
            test += f" AND {d} = '{wanted}'"
        arms.append(f"WHEN {test} THEN '{text}'")
    return f"CASE {' '.join(arms)} ELSE {q} END"


_L = f"regexp_replace(regexp_extract(segment, '{RULES.comparison_sides}', 1), '{RULES.comparison_prefix}', '')"
_R = f"regexp_extract(segment, '{RULES.comparison_sides}', 2)"
DECOMPOSED = ROUTED + f""",
by_segment AS (
  SELECT query_id, i * 10 + j AS ord, question, {primary_sql("question")} AS domain FROM (
    SELECT query_id, i, unnest(qs) AS question, generate_subscripts(qs, 1) AS j FROM (
      SELECT query_id, i, CASE WHEN regexp_matches(segment, '{RULES.comparison}') AND NOT contains(segment, '{RULES.comparison_list}')
          AND length({_L}) >= 2 AND length({_R}) >= 2 THEN [{_L} || '{RULES.comparison_question}', {_R} || '{RULES.comparison_question}'] ELSE [segment] END AS qs
      FROM (SELECT query_id, unnest(segments) AS segment, generate_subscripts(segments, 1) AS i FROM routed WHERE complexity = 'compound')))),
by_domain AS (
  {" UNION ALL ".join(
      f"SELECT query_id, {i} AS ord, {domain_question_sql('v', d)} AS question, '{d}' AS domain FROM routed WHERE complexity = 'complex' AND list_contains(domains, '{d}')"
      for i, d in enumerate(RULES.priority) if d != "rule")}),
pairs AS (SELECT * FROM by_segment UNION ALL SELECT * FROM by_domain),
once AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, domain, replace(lower(regexp_replace(question, '\\s+', '', 'g')), 'ß', 'ss') ORDER BY ord) AS copy FROM pairs)
  WHERE copy = 1),
subs AS (SELECT query_id, 'q' || n AS question_id, n, question, domain, {rewrite_sql("question", "domain")} AS search FROM once WHERE n <= 4)"""


def _decomposed(spark, sf):
    return understanding.decompose(_routed(spark, sf), RULES)


@query("decompose", f"WITH {DECOMPOSED} SELECT query_id, question_id, question, domain FROM subs")
def _decompose(spark, sf):
    return understanding.subqueries(_decomposed(spark, sf), RULES).drop("search")


@query("rewrite_subqueries", f"WITH {DECOMPOSED} SELECT query_id, question_id, search FROM subs")
def _rewrite(spark, sf):
    return understanding.subqueries(_decomposed(spark, sf), RULES).select("query_id", "question_id", "search")


def _whole_sql() -> str:
    tests = [
        "(" + " AND ".join(f"contains(query, '{w}')" for w in words) + f" AND domain IN ({', '.join(repr(d) for d in fits)}))"
        for words, fits in RULES.whole_goal
    ]
    return " OR ".join(tests)


PLANS = DECOMPOSED + f""",
need AS (SELECT *, regexp_matches(query, '{RULES.conditional}') AS conditional FROM routed WHERE need_planner),
extra AS (
  {" UNION ALL ".join(
      f"SELECT query_id, {100 + i} AS ord, {domain_question_sql('query', d)} AS question, '{d}' AS domain FROM need WHERE list_contains(domains, '{d}') AND NOT EXISTS (SELECT 1 FROM subs s WHERE s.query_id = need.query_id AND s.domain = '{d}')"
      for i, (d, _) in enumerate(RULES.domains))}),
everything AS (
  SELECT n.query_id, n.query, n.conditional, e.ord, e.question, e.domain,
         row_number() OVER (PARTITION BY n.query_id ORDER BY e.ord) AS r
  FROM need n JOIN (SELECT query_id, n AS ord, question, domain FROM subs UNION ALL SELECT * FROM extra) e USING (query_id)),
evidence AS (SELECT *, domain = 'progression' AS late FROM everything WHERE r <= CASE WHEN conditional THEN 5 ELSE 6 END),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, r) AS position,
         count(*) FILTER (NOT late) OVER (PARTITION BY query_id) AS base, count(*) OVER (PARTITION BY query_id) AS total FROM evidence),
tasks AS (
  SELECT query_id AS plan_id, position, 't' || position AS task_id,
    CASE WHEN late THEN 'progression' WHEN regexp_matches(question, '{RULES.compare}') THEN 'compare' ELSE 'rule_research' END AS type,
    CASE WHEN {_whole_sql()} THEN {rewrite_sql("query", "domain")} ELSE {rewrite_sql("question", "domain")} END AS query, domain,
    CASE WHEN late THEN list_transform(range(1, base + 1), lambda x: 't' || x) ELSE [] END AS depends_on
  FROM numbered
  UNION ALL
  SELECT query_id, total + 1, 't' || (total + 1), 'selection', '{PLAN_SELECTION}', 'rule', list_transform(range(1, total + 1), lambda x: 't' || x)
  FROM (SELECT DISTINCT query_id, total FROM numbered WHERE conditional AND total < 6))"""


def _plans(spark, sf):
    return understanding.build_plans(_decomposed(spark, sf), RULES)


@query(
    "build_plans",
    f"WITH {PLANS} SELECT plan_id, position, task_id, type, query, domain, array_to_string(depends_on, ',') AS depends_on FROM tasks",
)
def _build(spark, sf):
    return understanding.plan_tasks(_plans(spark, sf)).withColumn("depends_on", F.array_join("depends_on", ","))


def _broken_plans(spark, sf):
    """Every user message as a two-task plan whose fields follow the message, so all rules fire."""
    q = asked(spark, sf)
    n = F.length("query")
    ids = F.array(F.lit("t1"), F.lit("T2"), F.lit("t1"), F.lit("t3"))
    second = F.element_at(ids, (n % 4 + 1).cast("int"))
    return q.select(
        F.col("query_id").alias("plan_id"),
        F.when(n % 11 == 0, " ").otherwise("goal").alias("goal"),
        F.when(n % 13 == 0, 2).otherwise(1).alias("planner_version"),
        F.array(
            F.struct(
                F.lit("t1").alias("id"), F.lit("compare").alias("type"), F.lit("lookup").alias("query"),
                F.lit("class").alias("domain"),
                F.when(n % 5 == 0, F.array(F.lit("t3"))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
            ),
            F.struct(
                second.alias("id"), F.lit("compare").alias("type"),
                F.when(n % 7 == 0, "run bash now").otherwise(F.col("query")).alias("query"),
                F.lit("class").alias("domain"), F.array(F.lit("t1")).alias("depends_on"),
            ),
        ).alias("tasks"),
    )


@query(
    "validate_plans",
    f"""WITH {ASKED}, n AS (SELECT *, length(query) AS n, ['t1', 'T2', 't1', 't3'][length(query) % 4 + 1] AS second FROM ql),
    e AS (SELECT query_id AS plan_id,
      CASE WHEN n % 13 = 0 THEN 'unsupported planner version' WHEN n % 11 = 0 THEN 'goal must not be empty'
        WHEN second = 't1' THEN 'task ids must be unique'
        WHEN n % 5 = 0 AND second <> 't3' THEN 'task dependency is invalid' WHEN n % 5 = 0 THEN 'tasks must be topologically ordered'
        WHEN second = 'T2' THEN 'invalid task id'
        WHEN n % 7 = 0 THEN 'task query contains forbidden capability'
        WHEN trim(query) = '' OR length(trim(query)) > 500 THEN 'invalid task query length' END AS error FROM n)
    SELECT coalesce(error, 'valid') AS error, count(*) AS plans FROM e GROUP BY ALL""",
)
def _validate(spark, sf):
    return (
        understanding.validate_plans(_broken_plans(spark, sf))
        .groupBy(F.coalesce("error", F.lit("valid")).alias("error"))
        .agg(F.count("*").alias("plans"))
    )


@query(
    "synthesis_checks",
    f"""WITH {ROUTED}, c AS (
      {" UNION ALL ".join(
          f"SELECT query_id AS plan_id, domains, {i} AS ord, '{k}' AS kind, CAST({_list(d)} AS VARCHAR[]) AS required, '{f}' AS unresolved_field FROM routed WHERE regexp_matches(v, '{p}')"
          for i, (k, p, d, f) in enumerate(RULES.synthesis))})
    SELECT plan_id, 'c' || row_number() OVER (PARTITION BY plan_id ORDER BY ord) AS check_id, kind, array_to_string(required, ',') AS required_domains,
      unresolved_field, len(required) = 0 OR list_has_any(domains, required) AS valid FROM c""",
)
def _checks(spark, sf):
    goals = _routed(spark, sf).select(F.col("query_id").alias("plan_id"), "domains", F.trim("query").alias("goal"))
    return understanding.synthesis_checks(goals, RULES).withColumn(
        "required_domains", F.array_join("required_domains", ",")
    )


_OV = "regexp_replace(v, '[？?]+$', '')"
_OL = f"trim(regexp_extract({_OV}, '{RULES.options}', 1))"
_OR = f"trim(regexp_replace(trim(regexp_extract({_OV}, '{RULES.options}', 2)), '{RULES.option_lead}', ''))"
TOPICS = PLANNED + f""",
prev AS (SELECT planned.*, {_OL} AS l, {_OR} AS r, lead(text) OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS answer, a.role
         FROM conversations a LEFT JOIN planned USING (conv_id, turn)),
told AS (SELECT * FROM prev WHERE query_id IS NOT NULL AND answer IS NOT NULL),
topics AS (
  SELECT query_id, intent, l, r, CASE intent WHEN 'RULE_FACT' THEN 'rule' WHEN 'PROCEDURE' THEN 'steps'
    WHEN 'BUILD_ADVICE' THEN CASE WHEN regexp_matches(s, '{RULES.topic_mixing}') THEN 'multiclass' WHEN regexp_matches(s, '{RULES.topic_feats}') THEN 'feat_spell' ELSE 'class' END
    ELSE CASE WHEN l <> '' AND r <> '' AND contains(t, l) AND NOT contains(t, r) THEN 'option_a'
              WHEN l <> '' AND r <> '' AND contains(t, r) AND NOT contains(t, l) THEN 'option_b' ELSE 'shared' END END AS topic
  FROM (SELECT *, 'T P ' || answer AS t, query || ' T P ' || answer AS s FROM told))"""


def _topics(spark, sf):
    """The message after a question stands for a document found for it."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    answers = c.select("conv_id", "turn", following.alias("content"))
    rows = understanding.plan_queries(asked(spark, sf), RULES).join(answers, ["conv_id", "turn"])
    rows = rows.where(F.col("content").isNotNull()).select(
        "query_id", "query", "intent", F.col("query").alias("search"), F.lit("T").alias("title"),
        F.lit("P").alias("full_path"), "content",
    )
    return understanding.classify_topics(rows, RULES)


@query("classify_topics", f"WITH {TOPICS} SELECT query_id, topic FROM topics")
def _classify_topics(spark, sf):
    return _topics(spark, sf).select("query_id", "topic")


@query(
    "missing_sides",
    f"""WITH {TOPICS}, sides AS (
      SELECT query_id, 'option_a' AS topic, l AS search FROM topics WHERE intent = 'COMPARE_OPTIONS' AND l <> '' AND r <> ''
      UNION ALL SELECT query_id, 'option_b', r FROM topics WHERE intent = 'COMPARE_OPTIONS' AND l <> '' AND r <> '')
    SELECT query_id, topic, search FROM sides s WHERE NOT EXISTS (SELECT 1 FROM topics t WHERE t.query_id = s.query_id AND t.topic = s.topic)""",
)
def _missing(spark, sf):
    rows = _topics(spark, sf)
    return understanding.missing_sides(
        rows.select("query_id", "query", "intent"), rows.select("query_id", "topic"), RULES
    )


def norm_sql(v: str) -> str:
    return f"regexp_replace(replace(lower({v}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query(
    "hash_queries",
    f"WITH {ASKED} SELECT query_id, CASE WHEN {norm_sql('query')} = '' THEN 'empty' ELSE substring(sha256({norm_sql('query')}), 1, 12) END AS query_hash FROM ql",
)
def _hash(spark, sf):
    return asked(spark, sf).select("query_id", understanding.hash_query(F.col("query")).alias("query_hash"))


def _searches(spark, sf):
    """Searches of a question: the texts of its own sub-questions' searches and the whole message."""
    subs = understanding.subqueries(_decomposed(spark, sf), RULES)
    questions = subs.select(
        F.col("query_id").alias("key"), "question_id", "question", "domain", (F.col("question_id") == "q1").alias("searched")
    )
    searches = subs.select(
        F.col("query_id").alias("key"), F.col("question_id").alias("search_id"), F.reverse("search").alias("search")
    ).unionByName(
        subs.select(F.col("query_id").alias("key"), F.concat(F.lit("s"), "question_id").alias("search_id"), "search")
    )
    return searches, questions


@query(
    "assign_subquestions",
    f"""WITH {DECOMPOSED}, sr AS (
      SELECT query_id, question_id AS search_id, reverse(search) AS search FROM subs UNION ALL SELECT query_id, 's' || question_id, search FROM subs),
    p AS (SELECT s.query_id AS key, s.search_id, q.question_id, q.n, q.domain, {domains_sql("s.search")} AS sd, {norm_sql("s.search")} AS a, {norm_sql("q.question")} AS b
          FROM sr s JOIN subs q USING (query_id)),
    m AS (SELECT *, contains(a, b) OR contains(b, a) AS exact_,
        len(list_filter(range(1, greatest(length(a) - 2, 1)), lambda i: contains(b, substring(a, i, 4)))) > 0 AS shared_,
        question_id <> 'q1' AND domain <> 'rule' AND list_contains(sd, domain) AS dom_ FROM p),
    g AS (SELECT key, search_id, arg_min(question_id, n) FILTER (exact_) AS e, arg_min(question_id, n) FILTER (shared_) AS s,
        count(*) FILTER (dom_) AS k, max(question_id) FILTER (dom_) AS d FROM m GROUP BY ALL)
    SELECT key, search_id, coalesce(e, s, CASE WHEN k = 1 THEN d END, '') AS question_id FROM g""",
)
def _assign(spark, sf):
    return understanding.assign_subquestions(*_searches(spark, sf), RULES)


@query(
    "detect_other_library",
    """WITH cat AS (SELECT n_nationkey AS ord, 'lib-' || lower(n_name) AS id, n_name || ' (Rules)' AS name, 'the' AS system, [substring(w, 1, 9)] AS aliases
      FROM nation JOIN (SELECT item_id, regexp_extract(text, '([a-z]{6,9})', 1) AS w FROM benchmark) b ON b.item_id = n_nationkey),
    owned AS (SELECT a AS alias, min(ord) AS ord, min(id) AS id, length(regexp_replace(a, '[^0-9a-z]', '', 'g')) AS len FROM (
        SELECT ord, id, unnest([id, lower(name), trim(replace(lower(name), '(rules)', '')), lower(aliases[1])]) AS a FROM cat)
      WHERE length(regexp_replace(a, '[^0-9a-z]', '', 'g')) >= 4 AND a <> 'rules' GROUP BY a HAVING count(DISTINCT id) = 1),
    msg AS (SELECT conv_id * 1000 + turn AS message_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS m,
        (SELECT id FROM cat WHERE ord = conv_id % 25) AS cur FROM conversations),
    hit AS (SELECT message_id, cur, owned.* FROM msg JOIN owned ON contains(m, alias)
        AND regexp_matches(' ' || m || ' ', '[^A-Za-z0-9]' || regexp_replace(alias, '([\\(\\)\\-])', '\\\\\\1', 'g') || '[^A-Za-z0-9]'))
    SELECT message_id, arg_max(id, struct_pack(a := len, b := -ord, c := alias)) AS library_id FROM hit GROUP BY message_id
    HAVING NOT bool_or(coalesce(id = cur, false))""",
)
def _libraries(spark, sf):
    """`nation` names as libraries that claim words of the benchmark passages as aliases."""
    words = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.regexp_extract("text", "([a-z]{6,9})", 1).alias("w")
    )
    catalog = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("ord"),
        F.concat(F.lit("lib-"), F.lower("n_name")).alias("id"),
        F.concat("n_name", F.lit(" (Rules)")).alias("name"),
        F.lit("the").alias("system"),
    ).join(words, "ord").withColumn("aliases", F.array("w")).drop("w")
    current = catalog.select(F.col("ord").alias("_o"), F.col("id").alias("current_library"))
    messages = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("text").alias("content"),
        (F.col("conv_id") % 25).alias("_o"),
    ).join(current, "_o", "left")
    return understanding.detect_other_library(messages, catalog)


# --- plan execution and its evaluations -------------------------------------------------------


def _results(spark, sf):
    tasks = understanding.plan_tasks(_plans(spark, sf))
    found = tasks.where(F.col("type") != "selection").select(
        "plan_id", "task_id",
        F.when(F.length("query") % 3 > 0, F.array(F.concat("domain", F.lit("-1")), F.concat("type", F.lit("-2"))))
        .otherwise(F.array().cast("array<string>")).alias("source_ids"),
        (F.length("query") % 17 * 2.0).alias("seconds"),
    )
    return tasks, found


RUN = PLANS + """,
found AS (SELECT plan_id, task_id, CASE WHEN length(query) % 3 > 0 THEN [domain || '-1', type || '-2'] ELSE [] END AS src, (length(query) % 17) * 2.0 AS secs FROM tasks WHERE type <> 'selection'),
own AS (
  SELECT t.*, src, CASE WHEN type = 'selection' THEN NULL WHEN row_number() OVER (PARTITION BY t.plan_id, type = 'selection' ORDER BY position) > 6 THEN 'budget_exhausted'
      WHEN secs > 30 THEN 'task_timeout' WHEN len(src) > 0 THEN 'completed' ELSE 'missing_evidence' END AS st
  FROM tasks t LEFT JOIN found USING (plan_id, task_id)),
base_ AS (SELECT plan_id, bool_and(st = 'completed') AS ok FROM own WHERE len(depends_on) = 0 GROUP BY plan_id),
mid AS (SELECT own.*, CASE WHEN type = 'selection' THEN NULL WHEN len(depends_on) > 0 AND NOT ok THEN 'blocked_dependency' ELSE st END AS status
        FROM own LEFT JOIN base_ USING (plan_id)),
all_ok AS (SELECT plan_id, bool_and(status = 'completed') AS ok, list_sort(list_distinct(flatten(list(src)))) AS every FROM mid WHERE type <> 'selection' GROUP BY plan_id),
run AS (SELECT plan_id, task_id, domain, type, CASE WHEN type <> 'selection' THEN status WHEN NOT ok THEN 'blocked_dependency' ELSE 'completed' END AS status,
    CASE WHEN type = 'selection' THEN CASE WHEN ok THEN every ELSE [] END WHEN status IN ('completed', 'task_timeout') THEN list_sort(src) ELSE [] END AS source_ids
  FROM mid JOIN all_ok USING (plan_id))"""


@query("run_plans", f"WITH {RUN} SELECT plan_id, task_id, status, array_to_string(source_ids, ',') AS source_ids FROM run")
def _run(spark, sf):
    tasks, found = _results(spark, sf)
    return planning.run_plans(tasks, found).select(
        "plan_id", "task_id", "status", F.array_join(F.array_sort("source_ids"), ",").alias("source_ids")
    )


@query(
    "synthesis_readiness",
    f"""WITH {RUN}, c AS (
      {" UNION ALL ".join(
          f"SELECT query_id AS plan_id, {i} AS ord, '{k}' AS kind, CAST({_list(d)} AS VARCHAR[]) AS required FROM need WHERE regexp_matches(v, '{p}')"
          for i, (k, p, d, f) in enumerate(RULES.synthesis))}),
    n AS (SELECT *, 'c' || row_number() OVER (PARTITION BY plan_id ORDER BY ord) AS check_id FROM c),
    s AS (SELECT n.plan_id, check_id, any_value(kind) AS kind, count(*) FILTER (r.status = 'completed' AND len(r.source_ids) > 0 AND (len(required) = 0 OR list_contains(required, r.domain))) AS good
          FROM n LEFT JOIN run r USING (plan_id) GROUP BY ALL)
    SELECT plan_id, check_id, CASE WHEN kind = 'missing_input' THEN 'requires_user_branching' WHEN good > 0 THEN 'evidence_available' ELSE 'missing_evidence' END AS readiness FROM s""",
)
def _readiness(spark, sf):
    tasks, found = _results(spark, sf)
    goals = _routed(spark, sf).where("need_planner").select(
        F.col("query_id").alias("plan_id"), "domains", F.trim("query").alias("goal")
    )
    checks = understanding.synthesis_checks(goals, RULES)
    return planning.synthesis_readiness(checks, tasks, planning.run_plans(tasks, found)).select(
        "plan_id", "check_id", "readiness"
    )


EXPECTED = DECOMPOSED + """,
cases AS (
  SELECT r.*, ['simple', 'compound', 'complex'][query_id % 3 + 1] AS expected, domains[1:2] AS expected_domains,
    (SELECT count(*) FROM subs s WHERE s.query_id = r.query_id) AS questions, (query_id % 4) AS expected_count, length(query) / 1000.0 AS secs FROM routed r)"""


def _cases(spark, sf):
    rows = _decomposed(spark, sf)
    kinds = F.array(F.lit("simple"), F.lit("compound"), F.lit("complex"))
    return rows.select(
        "*",
        F.element_at(kinds, (F.col("query_id") % 3 + 1).cast("int")).alias("expected_complexity"),
        F.slice("domains", 1, 2).alias("expected_domains"),
        (F.col("query_id") % 4).alias("expected_count"),
        (F.length("query") / 1000.0).alias("routing_seconds"),
    )


@query(
    "evaluate_routing",
    f"""WITH {EXPECTED}, p AS (SELECT *, complexity = expected AND questions = expected_count AND len(list_intersect(expected_domains, domains)) = len(expected_domains) AS passed FROM cases)
    SELECT count(*) AS case_count, count(*) FILTER (passed) AS passed_cases,
      round(count(*) FILTER (expected = 'simple' AND need_decomposition) / greatest(count(*) FILTER (expected = 'simple'), 1), 4) AS simple_mis_split_rate,
      round(sum(len(list_intersect(expected_domains, domains))) / greatest(sum(len(expected_domains)), 1), 4) AS target_coverage_rate,
      round(avg(questions), 4) AS average_subquestions, max(questions) AS max_subquestions,
      round(avg(secs) * 1000, 4) AS latency_mean_ms, round(quantile_disc(secs, 0.95) * 1000, 4) AS latency_p95_ms FROM p""",
)
def _evaluate_routing(spark, sf):
    return planning.evaluate_routing(_cases(spark, sf))


@query(
    "evaluate_planning",
    f"""WITH {EXPECTED}, actual AS (SELECT query_id, list(DISTINCT domain) AS got FROM subs GROUP BY query_id),
    t AS (SELECT c.*, coalesce(got, []) AS got, query_id % 5 AS task_count, query_id % 3 AS edges, query_id % 2 = 0 AS cond, query_id % 7 < 2 AS expect
          FROM cases c LEFT JOIN actual USING (query_id)),
    r AS (SELECT *, complexity <> 'complex' AS routing_gap, len(list_filter(domains, lambda d: NOT list_contains(got, d))) > 0 AS domain_gap,
        task_count > questions AS task_gap, edges > 0 AS edge_gap FROM t),
    p AS (SELECT *, NOT (routing_gap OR domain_gap OR task_gap OR edge_gap OR cond) AS sufficient FROM r)
    SELECT count(*) AS case_count, count(*) FILTER (sufficient = expect) AS passed_cases, count(*) FILTER (sufficient) AS sufficient_cases,
      count(*) FILTER (NOT sufficient AND expect) AS false_triggers, count(*) FILTER (sufficient AND NOT expect) AS missed_needs,
      count(*) FILTER (need_planner) AS planner_ready_cases,
      count(*) FILTER (routing_gap) AS routing_gap, count(*) FILTER (domain_gap) AS domain_capacity_gap, count(*) FILTER (task_gap) AS task_capacity_gap,
      count(*) FILTER (edge_gap) AS dependency_graph_gap, count(*) FILTER (cond) AS conditional_branch_gap FROM p""",
)
def _evaluate_planning(spark, sf):
    rows = _cases(spark, sf).select(
        "*",
        F.col("domains").alias("required_domains"),
        (F.col("query_id") % 5).alias("task_count"),
        (F.col("query_id") % 3).alias("dependency_edges"),
        (F.col("query_id") % 2 == 0).alias("conditional"),
        (F.col("query_id") % 7 < 2).alias("expected_sufficient"),
        F.col("need_planner").alias("planner_valid"),
    )
    return planning.evaluate_planning(rows)
