from pyspark.sql import functions as F

from folioscan.operators import facts, state, understanding


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_intents(spark):
    wanted = {"怎么构筑法师": "BUILD_ADVICE", "兼职战士有什么收益": "BUILD_ADVICE", "法师和术士的区别": "COMPARE_OPTIONS", "如何创建角色": "PROCEDURE", "火球术的距离": "RULE_FACT"}
    rows = asked(spark, *wanted).select("query", understanding.classify_intent(F.col("query")).alias("i")).collect()
    assert {r.query: r.i for r in rows} == wanted


def test_focus_of_a_fact_question(spark):
    got = understanding.plan_queries(asked(spark, "请问强韧专长选择后有什么效果")).first()
    assert got.searches == ["强韧", "请问强韧专长选择后有什么效果"]


def test_routing_and_decomposition(spark):
    texts = ("火球术距离多少？油腻术持续多久？", "我想规划5到10级的法师，必须兼职战士并保持法术进度，先确认专长", "火球术距离")
    rows = understanding.decompose(understanding.route_queries(asked(spark, *texts))).orderBy("query_id").collect()
    assert [r.complexity for r in rows] == ["compound", "complex", "simple"]
    assert [q.question for q in rows[0].questions] == ["火球术距离多少？", "油腻术持续多久？"]
    assert [q.domain for q in rows[1].questions] == ["class", "progression", "spell", "feat"]
    assert rows[1].need_planner and not rows[2].questions
    assert rows[1].questions[0].question == "5级法师 5级战士 职业能力 兼职 多职业"


def test_plans_are_valid(spark):
    rows = understanding.decompose(understanding.route_queries(asked(spark, "我想规划5到10级的法师，必须兼职战士并保持法术进度，先确认专长")))
    plans = understanding.build_plans(rows)
    tasks = understanding.plan_tasks(plans).orderBy("position").collect()
    assert [t.type for t in tasks][-1] == "progression"
    assert tasks[-1].depends_on == [t.task_id for t in tasks[:-1]]
    assert understanding.validate_plans(plans).first().error is None


def messages(spark, *texts):
    return spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id int, turn int, role string, content string")


def test_state_replaces_compositions_and_merges_maps(spark):
    m = messages(spark, "我想创建一个角色，力量为16", "法师5/战士1", "种族为精灵，敏捷14", "现在7级法师")
    got = state.fold_state(m, ["conv_id"]).first()
    assert got.task == "创建角色"
    assert got.class_levels == {"法师": 7} and got.character_level == 7
    assert got.ability_scores == {"力量": 16, "敏捷": 14}
    assert got.race == "精灵"


def test_planned_dips_stay_out_of_the_composition(spark):
    got = state.fold_state(messages(spark, "法师5，兼职1级战士"), ["conv_id"]).first()
    assert got.class_levels == {"法师": 5} and got.planned_dip_levels == {"战士": 1}


def test_progression_claims(spark):
    row = "| 5 | +2 | +1 | +1 | +4 | x | 4 | 4 | 3 | 2 | - | - | - | - | - | - |"
    ev = spark.createDataFrame([("a", 0, "S1", "法师", "表：法师\n" + row)], "ledger_id string, position int, label string, title string, content string")
    found = facts.extract_facts(ev).withColumnRenamed("ledger_id", "answer_id")
    level = found.where("kind = 'class_level'").first()
    assert (level.level, level.value) == (5, "3")
    answers = spark.createDataFrame([("a", "5级法师最高可施展4环法术，5级法师每天可以施放3个2环法术", "g")], "answer_id string, answer string, goal string")
    assert {r.code for r in facts.check_progression(answers, found).collect()} == {"spell_progression"}


def test_option_windows_may_overlap(spark):
    from folioscan.operators.facts import check_options

    text = "法师5级时获得奖励专长。" + "。" * 150 + "法师5级奖励专长" + "。" * 40 + "战斗专长"
    answers = spark.createDataFrame([("a", text, "g")], "answer_id string, answer string, goal string")
    known = spark.createDataFrame(
        [("a", "bonus_scope", "法师", 5, "超魔专长", "")], "answer_id string, kind string, subject string, level int, value string, detail string"
    ).withColumn("level", F.col("level").cast("string"))
    assert [r.code for r in check_options(answers, known).collect()] == ["bonus_feat_scope"]


def test_chunks_without_tokens_count(spark):
    from folioscan.operators.lexical import build_index
    from folioscan.schemas import conform

    rows = [(i, "lib", "s", "t", None, c) for i, c in (("a", "alpha beta"), ("b", "¿¡"), ("c", "…"))]
    docs = spark.createDataFrame(rows, "id string, ruleset_id string, source_id string, title string, full_path string, content string")
    docs = docs.withColumn("title", F.lit("")).withColumn("full_path", F.lit(""))
    got = build_index(conform(docs), persist=False).corpus_stats.first()
    assert (got.chunk_count, got.average_length) == (3, 1.0)


def test_tool_entries_keep_errors_and_repeat(spark):
    from folioscan.operators.transcripts import tool_timeline

    rows = [("t", 1, "tool_start", "a", None), ("t", 2, "tool_error", "a", "boom"), ("t", 3, "tool_end", "a", None)]
    rows += [("u", 1, "tool_start", "a", None), ("u", 2, "tool_end", "a", None), ("u", 3, "tool_start", "a", None)]
    rows += [("v", 1, "tool_end", "a", None), ("v", 2, "tool_error", "a", "late")]
    events = spark.createDataFrame([(*r, "x") for r in rows], "turn_id string, seq long, type string, call_id string, error string, tool_name string")
    got = sorted((r.turn_id, r.seq, r.status, r.error) for r in tool_timeline(events).collect())
    assert got == [("t", 1, "end", "boom"), ("u", 1, "end", None), ("u", 3, "start", None), ("v", 2, "error", "late")]


def test_state_queries_match_sql_when_a_planned_class_has_no_level(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    said = [
        (1, 0, "user", "tzzu den th xx on, the a"), (2, 0, "user", "tzzu den"), (3, 0, "user", "tzzupf 5 an abc"), (4, 0, "user", "tion of wood"),
    ]
    schema = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(said, schema).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    docs = spark.createDataFrame([(k, f"src{k}") for k in range(1, 5)], "doc_id long, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("fold_state", "streamed_state", "state_field_count", "enrich_queries", "evaluate_state"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
