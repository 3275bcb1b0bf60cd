"""Facts read from evidence documents, and checks of answers against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import match_starts, strip

# --- Fixed values -----------------------------------------------------------------------------
CLASS_TITLE, CLASS_TABLE = "法师", "表：法师"
TABLE_ROW = r"^\s*\|?\s*\d+\s*\|"
SLOT_COLUMNS = (6, 10)
BONUS_SCOPE = r"(?s)奖励专长：在5，10，15，20级时.*?挑选([^。]+)"
BONUS_LEVELS = (5, 10, 15, 20)
BONUS_WORDS = ("超魔专长", "物品制造专长", "法术掌握")
REQUIREMENTS = (r"(?s)^.*?进阶要求(.*)$", r"(?s)本职技能.*$")
CLASS_NAMES = ("法师", "战士", "奥法骑士")
FEAT_TITLE, FEAT_LIST = "专长", "专长列表"
FEAT_HEADS = ("施法专长", "造物专长", "专长")
FEAT_NOT = "等级|基本攻击|豁免|特殊能力|每日法术"
CITATION = r"\[(?:\^)?(S\d+)]"
ALLOCATION = r"(?:法师|战士|奥法骑士)\s*\d+(?:\s*[/／]\s*(?:法师|战士|奥法骑士)\s*\d+)+"
ALLOCATION_LEVEL = r"(?:法师|战士|奥法骑士)\s*(\d+)"
LEVEL_TARGET = r"(?:角色\s*)?(?:达到|等级|至)\s*(\d+)\s*级|(?<![到至\-—~])(\d+)\s*级时"
SPELL_CLAIMS = (
    r"(\d+)\s*级法师[^\n。；]{0,45}?(?:最高(?:可)?|获得|解锁|可以施展|可施展|能施展)[^\n。；]{0,20}?(\d+)\s*环",
    r"(?m)^\s*(\d+)\s*级[：:][^\n。；]{0,45}?(?:获得|解锁|可以|可|能)[^\n。；]{0,20}?(\d+)\s*环",
)
SLOT_CLAIM = r"(\d+)\s*级法师[^\n。；]{0,45}?(?:每天|每日)[^\n。；]{0,20}?(\d+)\s*个\s*(\d+)\s*环"
NUMERIC_STAT = r"(?i)\d+\s*gp|\d+d\d+|[+-]\d+%|[+-]\d+\s*(?:AC|攻击|伤害)"
SENTENCE_END = r"(?<=[。；\n])"
RECOMMENDED = r"(?:建议选择|可选择|选择[：:]|替代专长[：:为])\s*(?:\*\*|[‘’“”])?([\x{4e00}-\x{9fff}A-Za-z]+)"
NOT_NAMES = ("一个", "其他", "任意", "符合", "新的")
ALWAYS_BONUS = ("法术掌握", "法术熟稔")
BONUS_CATEGORIES = ("超魔", "造物")
ATTACK_BONUS = "(?i)BAB|基本攻击"
DEMAND = "要求|进阶条件|条件满足|满足.*条件"
WRONG_SCOPE = "战斗专长"
CHOOSE = "选择|建议|可选"
REFUSALS = (
    "(?i)the request was rejected", "(?i)considered high risk", "(?i)request (?:has been |was )?blocked",
    "模型服务拒绝了本次请求", "请求(?:被|已被).{0,12}(?:拒绝|拦截)",
)
TRANSIENT = ("模型服务当前繁忙", "模型响应超时", "暂时无法连接模型服务", "(?i)service (?:is )?(?:busy|unavailable)")
UNFINISHED = (
    r"^\s*(?:让我|我会|我将|接下来(?:我会)?).{0,12}(?:继续)?(?:搜索|检索|读取|查找)",
    r"(?i)^\s*(?:let me|i(?:'ll| will)).{0,20}(?:search|retrieve|read)",
)
CITATION_SUFFIX = "\n\n依据："
# --- End of fixed values ------------------------------------------------------------------------


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), strip)


def extract_facts(evidence: DataFrame) -> DataFrame:
    """(ledger_id, kind, subject, level, value, detail, label) from evidence documents in label order.

    Evidence has ledger_id, position, label, title, content. Of repeated level
    rows the last wins, of repeated options the first.
    """
    docs = evidence.select("ledger_id", "position", "label", "title", "content")
    lines = docs.select(
        "ledger_id", "position", "label", "title", "content", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line")
    )
    tables = lines.where(
        F.contains("title", F.lit(CLASS_TITLE)) & F.contains("content", F.lit(CLASS_TABLE)) & F.regexp_like("line", F.lit(TABLE_ROW))
    ).withColumn("c", _cells(F.col("line"))).where((F.size("c") >= 16) & F.regexp_like(F.col("c")[0], F.lit(r"^\d+$")))
    first, count = SLOT_COLUMNS
    slots = F.transform(F.slice("c", first + 1, count), lambda v: v.try_cast("int"))
    available = F.filter(
        F.transform(slots, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull()
    )
    order = Window.partitionBy("ledger_id", "subject", "level").orderBy(F.col("position").desc(), F.col("n").desc())
    levels = (
        tables.select(
            "ledger_id", "position", "n", "label",
            F.lit("class_level").alias("kind"),
            F.lit(CLASS_TITLE).alias("subject"),
            F.col("c")[0].cast("int").alias("level"),
            F.array_max(available).cast("string").alias("value"),
            F.array_join(slots, ",", "-").alias("detail"),
        )
        .withColumn("_r", F.row_number().over(order))
        .where("_r = 1")
    )
    scope = F.regexp_extract("content", BONUS_SCOPE, 1)
    scopes = docs.where(
        F.contains("title", F.lit(CLASS_TITLE)) & F.contains("content", F.lit(CLASS_TABLE)) & (scope != "")
    ).select(
        "ledger_id", "label",
        F.lit("bonus_scope").alias("kind"),
        F.lit(CLASS_TITLE).alias("subject"),
        F.explode(F.array(*[F.lit(v) for v in BONUS_LEVELS])).alias("level"),
        F.array_join(F.array_compact(F.array(*[F.when(F.contains(scope, F.lit(w)), F.lit(w)) for w in BONUS_WORDS])), ",").alias("value"),
        F.lit("").alias("detail"),
    )
    section = F.regexp_replace(F.regexp_extract("content", REQUIREMENTS[0], 1), REQUIREMENTS[1], "")
    wanted = F.filter(F.transform(F.split(section, "\n"), strip), lambda v: v != "")
    name = F.coalesce(*[F.when(F.contains("title", F.lit(c)), F.lit(c)) for c in CLASS_NAMES], strip(F.col("title")))
    needs = docs.withColumn("_w", wanted).where(F.size("_w") > 0).select(
        "ledger_id", "label",
        F.lit("requirements").alias("kind"), name.alias("subject"), F.lit(None).cast("int").alias("level"),
        F.array_join("_w", "\n").alias("value"), F.lit("").alias("detail"),
    )
    options = lines.where(
        (F.contains("title", F.lit(FEAT_TITLE)) | F.contains("content", F.lit(FEAT_LIST)))
        & F.contains("line", F.lit("|"))
        & ~F.regexp_like("line", F.lit(r"^\s*\|?\s*---"))
    ).withColumn("c", _cells(F.col("line"))).where(
        (F.size("c") >= 4)
        & ~F.col("c")[0].isin(list(FEAT_HEADS))
        & ~F.regexp_like(F.col("c")[0], F.lit(r"^\d+$"))
        & ~F.regexp_like(F.col("c")[0], F.lit(FEAT_NOT))
    )
    local = strip(F.regexp_replace(F.col("c")[0], r"[A-Za-z][A-Za-z '\-’]+", ""))
    earliest = Window.partitionBy("ledger_id", "subject").orderBy("position", "n")
    feats = (
        options.select(
            "ledger_id", "position", "n", "label",
            F.lit("option").alias("kind"),
            F.when(local != "", local).otherwise(F.col("c")[0]).alias("subject"),
            F.lit(None).cast("int").alias("level"),
            F.col("c")[1].alias("value"),
            F.col("c")[3].alias("detail"),
        )
        .where(F.col("subject") != "")
        .withColumn("_r", F.row_number().over(earliest))
        .where("_r = 1")
    )
    columns = ["ledger_id", "kind", "subject", "level", "value", "detail", "label"]
    return (
        levels.select(*columns)
        .unionByName(scopes.select(*columns))
        .unionByName(needs.select(*columns))
        .unionByName(feats.select(*columns))
    )


def validate_ledger(ledgers: DataFrame, evidence: DataFrame, facts: DataFrame, adapters: DataFrame) -> DataFrame:
    """Status of each ledger build: unregistered, incompatible, build_failed, no_facts or matched.

    Ledgers name (library_id, system, edition); adapters register the exact
    triple with their protocol version. Problems become statuses, not errors.
    """
    key = ["library_id", "system", "edition"]
    known = ledgers.join(adapters.select(*key, "protocol_version", F.lit(True).alias("_a")), key, "left")
    ev = evidence.join(ledgers.select("ledger_id", "library_id"), "ledger_id")
    checks = ev.groupBy("ledger_id").agg(
        (
            (F.count_distinct("label") < F.count("*"))
            | (F.count_distinct("document_id") < F.count("*"))
            | (F.count_if(F.coalesce(F.trim("document_id"), F.lit("")) == "") > 0)
            | (F.count_if(~F.col("document_library").eqNullSafe(F.col("library_id"))) > 0)
        ).alias("_bad"),
        F.count("*").alias("_evidence"),
    )
    refs = facts.select("ledger_id", "label", "status")
    loose = refs.join(evidence.select("ledger_id", "label"), ["ledger_id", "label"], "left_anti").where(
        F.col("label").isNotNull() | F.col("status").isin("known", "conflicting")
    )
    per_fact = facts.groupBy("ledger_id").agg(F.count("*").alias("_facts"))
    bad_refs = loose.select("ledger_id", F.lit(True).alias("_loose")).distinct()
    rows = known.join(checks, "ledger_id", "left").join(per_fact, "ledger_id", "left").join(bad_refs, "ledger_id", "left")
    status = (
        F.when(F.col("_a").isNull(), "unregistered")
        .when(F.col("protocol_version") != 1, "incompatible")
        .when(F.coalesce("_bad", F.lit(False)), "build_failed")
        .when(F.coalesce("_evidence", F.lit(0)) == 0, "no_facts")
        .when(F.coalesce("_loose", F.lit(False)), "build_failed")
        .when(F.coalesce("_facts", F.lit(0)) == 0, "no_facts")
        .otherwise("matched")
    )
    return rows.select("ledger_id", status.alias("status"), F.coalesce("_facts", F.lit(0)).alias("records"))


def fact_status_counts(facts: DataFrame) -> DataFrame:
    status = F.col("status")
    return facts.groupBy("ledger_id").agg(
        F.count_if(status == "known").alias("known"),
        F.count_if(status == "unknown").alias("unknown"),
        F.count_if(status == "conflicting").alias("conflicting"),
    )


def _issue(df: DataFrame, code: str, detail: Column) -> DataFrame:
    return df.select("answer_id", F.lit(code).alias("code"), detail.cast("string").alias("detail")).distinct()


def check_citations(answers: DataFrame, evidence: DataFrame, pattern: str = CITATION) -> DataFrame:
    """Labels cited but not registered as evidence of the answer."""
    cited = answers.select(
        "answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(pattern), F.lit(1)))).alias("label")
    )
    return _issue(cited.join(evidence, ["answer_id", "label"], "left_anti"), "unknown_citation", F.col("label"))


def plain_answer(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer, r"\[(?:\^)?S\d+]", ""), "[*_`#]", "")


def check_level_sums(
    answers: DataFrame, target: str = LEVEL_TARGET, allocation: str = ALLOCATION, part: str = ALLOCATION_LEVEL
) -> DataFrame:
    """Allocations of levels whose sum is not the last level their line states."""
    lines = answers.select("answer_id", F.explode(F.split(plain_answer(F.col("answer")), r"\r?\n")).alias("line"))
    full = F.regexp_extract_all("line", F.lit(target), F.lit(0))
    stated = F.regexp_extract(F.try_element_at(full, F.lit(-1)), r"(\d+)", 1).try_cast("int")
    rows = lines.select(
        "answer_id", stated.alias("stated"), F.explode(F.regexp_extract_all("line", F.lit(allocation), F.lit(0))).alias("text")
    ).where(F.col("stated").isNotNull())
    total = F.aggregate(
        F.regexp_extract_all("text", F.lit(part), F.lit(1)), F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint")
    )
    wrong = rows.withColumn("total", total).where(F.col("total") != F.col("stated"))
    return _issue(wrong, "class_level_sum", F.concat_ws("|", "text", F.col("total").cast("string"), F.col("stated").cast("string")))


def check_numeric_support(
    answers: DataFrame, evidence: DataFrame, stat: str = NUMERIC_STAT, citation: str = CITATION, end: str = SENTENCE_END
) -> DataFrame:
    """Numbers with a unit in a cited sentence that none of its cited documents contain.

    Evidence joins by (answer, label); its blanks are removed before the join.
    """
    sentences = answers.select("answer_id", F.posexplode(F.split("answer", end)).alias("n", "s")).select(
        "answer_id", "n",
        F.array_distinct(F.regexp_extract_all("s", F.lit(citation), F.lit(1))).alias("labels"),
        F.array_distinct(F.regexp_extract_all("s", F.lit(stat), F.lit(0))).alias("stats"),
    ).where((F.size("labels") > 0) & (F.size("stats") > 0))
    texts = evidence.select(
        "answer_id", "label", F.lower(F.regexp_replace("content", r"(?U)\s+", "")).alias("_t")
    )
    cited = sentences.select("answer_id", "n", "stats", F.explode("labels").alias("label")).join(
        texts, ["answer_id", "label"], "left"
    )
    each = cited.select("answer_id", "n", F.explode("stats").alias("stat"), "_t")
    found = F.contains(F.coalesce("_t", F.lit("")), F.lower(F.regexp_replace("stat", r"(?U)\s+", "")))
    unsupported = each.groupBy("answer_id", "n", "stat").agg(F.bool_or(found).alias("ok")).where(~F.col("ok"))
    return _issue(unsupported, "unsupported_numeric_stat", F.col("stat"))


def check_progression(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Claimed top spell level or slot count that differs from the level fact."""
    plain = answers.withColumn("_p", plain_answer(F.col("answer"))).where(F.contains("_p", F.lit(CLASS_TITLE)))

    def claims(pattern: str, groups: int) -> Column:
        cols = [F.regexp_extract_all("_p", F.lit(pattern), F.lit(g + 1)).alias(f"g{g}") for g in range(groups)]
        return F.arrays_zip(*cols)

    level_facts = facts.where("kind = 'class_level'").select(
        "answer_id", F.col("level"), F.col("value").cast("int").alias("top"), F.split("detail", ",").alias("slots")
    )
    tops = plain.select(
        "answer_id", F.explode(F.concat(*[F.transform(claims(p, 2), lambda z: F.struct(z["g0"].alias("a"), z["g1"].alias("b"))) for p in SPELL_CLAIMS])).alias("c")
    ).select("answer_id", F.col("c.a").cast("int").alias("level"), F.col("c.b").cast("int").alias("claimed"))
    wrong = tops.join(level_facts, ["answer_id", "level"]).where(F.col("claimed") != F.col("top"))
    counts = plain.select("answer_id", F.explode(claims(SLOT_CLAIM, 3)).alias("c")).select(
        "answer_id", F.col("c.g0").cast("int").alias("level"), F.col("c.g1").cast("int").alias("claimed"), F.col("c.g2").cast("int").alias("circle")
    )
    expected = F.try_element_at("slots", F.col("circle") + 1).try_cast("int")
    slots = counts.join(level_facts, ["answer_id", "level"]).withColumn("expected", expected).where(
        F.col("expected").isNotNull() & (F.col("claimed") != F.col("expected"))
    )
    return _issue(wrong, "spell_progression", F.concat_ws("|", F.col("level").cast("string"), F.col("claimed").cast("string"), F.col("top").cast("string"))).unionByName(
        _issue(slots, "spell_slot_count", F.concat_ws("|", F.col("level").cast("string"), F.col("circle").cast("string"), F.col("claimed").cast("string")))
    )


def check_options(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Recommended names no fact lists, options outside a bonus scope, invented requirements."""
    named = answers.where(F.contains("goal", F.lit(FEAT_TITLE))).select(
        "answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(RECOMMENDED), F.lit(1)))).alias("subject")
    ).where(~F.col("subject").isin(list(NOT_NAMES)))
    scopes = facts.where("kind = 'bonus_scope'")
    mastered = scopes.where(F.contains("value", F.lit(ALWAYS_BONUS[0]))).select("answer_id").distinct()
    excused = named.where(F.col("subject").isin(list(ALWAYS_BONUS))).join(mastered, "answer_id", "left_semi")
    options = facts.where("kind = 'option'").select("answer_id", "subject", F.col("value").alias("_v"), F.col("detail").alias("category"))
    missing = named.join(excused, ["answer_id", "subject"], "left_anti").join(options, ["answer_id", "subject"], "left_anti")
    plain = answers.select("answer_id", plain_answer(F.col("answer")).alias("_p"))
    windows = (
        scopes.select("answer_id", "subject", "level").distinct().join(plain, "answer_id")
        .where(F.contains("_p", F.col("subject")))
        .withColumn(
            "_pattern",
            F.concat(F.col("level"), F.lit(r"\s*级[^\n]{0,30}奖励专长|奖励专长[^\n]{0,30}"), F.col("level"), F.lit(r"\s*级")),
        )
        .withColumn("_found", F.arrays_zip(match_starts(F.col("_p"), F.col("_pattern")).alias("at"), F.regexp_extract_all("_p", F.col("_pattern"), F.lit(0)).alias("hit")))
        .select("answer_id", "level", "_p", F.inline("_found"))
        # the windows of neighbouring mentions may overlap
        .select(
            "answer_id", "level",
            F.expr("substring(_p, greatest(1, at - 40), at + length(hit) + 180 - greatest(1, at - 40))").alias("w"),
        )
    )
    fights = windows.where(F.contains("w", F.lit(WRONG_SCOPE)))
    allowed = F.col("subject").isin(list(ALWAYS_BONUS))
    for c in BONUS_CATEGORIES:
        allowed = allowed | F.contains("category", F.lit(c))
    outside = windows.where(F.regexp_like("w", F.lit(CHOOSE))).join(options, "answer_id").where(
        F.contains("w", F.col("subject")) & ~allowed
    )
    silent = facts.where((F.col("kind") == "requirements") & ~F.regexp_like("value", F.lit(ATTACK_BONUS))).select("answer_id", "subject")
    lines = plain.select("answer_id", F.explode(F.split("_p", r"\r?\n")).alias("line")).where(
        F.regexp_like("line", F.lit(ATTACK_BONUS)) & F.regexp_like("line", F.lit(DEMAND))
    )
    invented = silent.join(lines, "answer_id").where(F.contains("line", F.col("subject")))
    return (
        _issue(missing, "unsupported_named_option", F.col("subject"))
        .unionByName(_issue(fights, "bonus_feat_scope", F.concat_ws("|", F.col("level").cast("string"), F.lit(WRONG_SCOPE))))
        .unionByName(_issue(outside, "bonus_feat_scope", F.concat_ws("|", F.col("level").cast("string"), "subject")))
        .unionByName(_issue(invented, "invented_prestige_requirement", F.col("subject")))
    )


def answer_quality(
    answers: DataFrame,
    refusals: tuple[str, ...] = REFUSALS,
    transient: tuple[str, ...] = TRANSIENT,
    unfinished: tuple[str, ...] = UNFINISHED,
) -> DataFrame:
    """Adds `quality`: empty, provider_refusal, transient_provider_output, unfinished_process or null."""
    text = strip(F.col("answer"))

    def hit(patterns: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | F.regexp_like(text, F.lit(p))
        return out

    return answers.withColumn(
        "quality",
        F.when(text == "", "empty")
        .when(hit(refusals), "provider_refusal")
        .when(hit(transient), "transient_provider_output")
        .when(hit(unfinished), "unfinished_process"),
    )


def missing_citation_suffix(answers: DataFrame) -> DataFrame:
    """Adds `suffix` naming every label when a sound answer cites none; needs quality and labels."""
    used = F.regexp_extract_all("answer", F.lit(r"\[(S\d+)]"), F.lit(1))
    needed = (F.size("labels") > 0) & F.col("quality").isNull() & ~F.arrays_overlap(used, "labels")
    listed = F.array_join(F.transform("labels", lambda v: F.concat(F.lit("["), v, F.lit("]"))), "")
    return answers.withColumn("suffix", F.when(needed, F.concat(F.lit(CITATION_SUFFIX), listed)).otherwise(""))
