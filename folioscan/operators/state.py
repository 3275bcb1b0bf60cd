"""Explicit conversation state: observations per user message, folded by last writer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.scale import settle
from folioscan.functions.text import contains_any, let, match_starts, strip

# --- Fixed values -----------------------------------------------------------------------------
FIELDS = (
    "基本特性", "基本特技", "追加特技", "角色类型", "职业", "种族", "真身", "正体", "弱点", "专长", "技能",
)
FIELD_ALIASES = {"基本特性": "基本特技", "正体": "真身"}
ENTITY_FIELDS = ("真身", "职业", "种族", "角色类型")
CATEGORY_TERMS = ("弱点", "特技", "技能", "专长", "能力", "属性")
ABILITIES = ("力量", "敏捷", "体质", "智力", "感知", "魅力")
CLASS_HINTS = (
    "吟游诗人", "圣武士", "野蛮人", "德鲁伊", "游侠", "术士", "牧师", "法师", "战士", "盗贼", "武僧",
)
TASK = ("(?:创建|建立|做|构筑).{0,6}(?:角色|人物)", "创建角色")
STOP = r"[^，。！？,.!?\n]"
FACT_PATTERNS = (
    (r"(?:我)?(?:现在)?选择(?:了)?({fields})为(" + STOP + "+)", 1, 2),
    (r"(?:我)?(?:现在)?选择(?:了)?(" + STOP + "+?)(?:作为|为)({fields})", 2, 1),
    (r"({fields})为(" + STOP + "+)", 1, 2),
)
VALUE_HEAD, VALUE_TAIL = "^(?:了|一个|一种)", "(?:作为)?$"
LEVEL_PATTERNS = (
    r"(?:角色|人物|总)?(?:等级|级别)\s*(?:为|是|=|：|:)\s*(\d+)",
    r"(\d+)\s*级?\s*(?:{hints})",
    r"(\d+)\s*级(?:角色|人物)",
)
DIP = r"兼职\s*(\d+)\s*级?\s*([^/／，,。！？!?\s]+)"
SEGMENT = r"[/／，,。！？!?]+"
LEVEL_CLASS = r"(\d+)\s*级?\s*([^\s\d][^\s]*)"
CLASS_LEVEL = r"({hints})\s*(\d+)\s*级?(?=$|[/／，,、。！？!?\s])"
PLANNED = (
    r"(?:继续|计划|打算|准备|想要)\s*(?:升|提升|玩|练|走)?\s*"
    r"(法师|战士|盗贼|牧师|游侠|术士|武僧|圣武士|德鲁伊|吟游诗人)(?:到\s*(\d+)\s*级?)?"
)
PREFERENCES = (
    r"(?:我(?:主要)?想|希望|倾向于|偏好|更注重|目标是)\s*([^，。！？!?\n]+)",
    r"(不考虑[^，。！？!?\n]+)",
    r"(避免[^，。！？!?\n]+)",
)
NOT_PREFERENCE = "^(?:创建|建立|做(?:一个|个)?|构筑)"
ABILITY_SCORE = r"({abilities})\s*(?:为|是|=|：|:)?\s*(\d+)"
FEAT_WORDS, SPELL_WORDS = ("专长", "特技"), ("法术", "咒语")
CHOICE_PATTERNS = (
    r"(?:选择(?:了)?\s*)?([^，。！？!?\n]+?)\s*(?:作为|为|是)\s*(?:{words})",
    r"(?:{words})\s*(?:为|是|：|:)\s*([^，。！？!?\n]+)",
)
CHOICE_SPLIT = r"[、,，和]\s*"
CLASS_EDGE = "[ \t\r\n，,、。；;：:为是作]"
CLASS_LEAD = "^(?:我|现在|选择|职业|角色|想|继续|升|提升|计划|打算|准备)+"
SELECTION = "选择(?:了)?.+(?:作为|为).+"
POINTER = "(?:它|这个|该角色)"
NEXT_STEP = "(?:下一步|接下来)"
LOOKUP = "(?:哪|什么|可选|选择|列出|种类)"
RACE = "种族"
# --- End of fixed values ------------------------------------------------------------------------


@dataclass(frozen=True)
class StateRules:
    fields: tuple[str, ...] = FIELDS
    aliases: tuple = tuple(FIELD_ALIASES.items())
    entity_fields: tuple[str, ...] = ENTITY_FIELDS
    categories: tuple[str, ...] = CATEGORY_TERMS
    abilities: tuple[str, ...] = ABILITIES
    hints: tuple[str, ...] = CLASS_HINTS
    task: tuple[str, str] = TASK
    facts: tuple = FACT_PATTERNS
    value_head: str = VALUE_HEAD
    value_tail: str = VALUE_TAIL
    levels: tuple[str, ...] = LEVEL_PATTERNS
    dip: str = DIP
    segment: str = SEGMENT
    level_class: str = LEVEL_CLASS
    class_level: str = CLASS_LEVEL
    planned: str = PLANNED
    preferences: tuple[str, ...] = PREFERENCES
    not_preference: str = NOT_PREFERENCE
    ability_score: str = ABILITY_SCORE
    feat_words: tuple[str, ...] = FEAT_WORDS
    spell_words: tuple[str, ...] = SPELL_WORDS
    choices: tuple[str, ...] = CHOICE_PATTERNS
    choice_split: str = CHOICE_SPLIT
    race: str = RACE
    selection: str = SELECTION
    pointer: str = POINTER
    next_step: str = NEXT_STEP
    lookup: str = LOOKUP

    def fill(self, pattern: str, words: tuple[str, ...] = ()) -> str:
        return (
            pattern.replace("{fields}", "|".join(self.fields))
            .replace("{hints}", "|".join(self.hints))
            .replace("{abilities}", "|".join(self.abilities))
            .replace("{words}", "|".join(words))
        )


OBSERVED = "array<struct<kind:string,key:string,value:string,pos:bigint>>"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _clean_value(value: Column, rules: StateRules) -> Column:
    bare = F.regexp_replace(strip(value), rules.value_head, "")
    return F.substring(strip(F.regexp_replace(bare, rules.value_tail, "")), 1, 40)


def _clean_class(value: Column, rules: StateRules) -> Column:
    trimmed = F.regexp_replace(value, f"^{CLASS_EDGE}+|{CLASS_EDGE}+$", "")
    chain = F
    for hint in sorted(rules.hints, key=len, reverse=True):
        chain = chain.when(F.contains(trimmed, F.lit(hint)), F.lit(hint))
    return chain.otherwise(F.substring(strip(F.regexp_replace(trimmed, CLASS_LEAD, "")), 1, 12))


def _seen(kind: str, key: Column, value: Column, pos: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("string").alias("value"),
        pos.cast("bigint").alias("pos"),
    )


def _pairs(kind: str, text: Column, pattern: str, key_group: int, value_group: int, base: int, key=None, value=None) -> Column:
    """Observations of every match of a two-group pattern, in text order."""
    zipped = F.arrays_zip(
        _all(text, pattern, key_group).alias("k"), _all(text, pattern, value_group).alias("v")
    )
    named = F.transform(zipped, lambda z: F.struct(z["k"].alias("k"), z["v"].alias("v")))
    return F.transform(
        named,
        lambda z, i: _seen(
            kind, key(z["k"]) if key else z["k"], value(z["v"]) if value else z["v"], i.cast("bigint") + F.lit(base << 40)
        ),
    )


def _one(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(_seen(kind, F.lit(""), value, F.lit(0)))).otherwise(F.array().cast(OBSERVED))


def _first_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def observations(messages: DataFrame, keys: list[str], rules: StateRules = StateRules()) -> DataFrame:
    """(keys, turn, kind, key, value, pos) of everything user messages state explicitly."""
    users = messages.where(F.col("role") == "user").select(*keys, "turn", F.col("content").alias("_c"))
    c = F.col("_c")

    def alias(name: Column) -> Column:
        out = name
        for k, v in rules.aliases:
            out = F.when(name == k, v).otherwise(out)
        return out

    facts = [
        _pairs("fact", c, rules.fill(p), k, v, n, alias, lambda x: _clean_value(x, rules))
        for n, (p, k, v) in enumerate(rules.facts)
    ]
    task = _one("task", F.when(F.regexp_like(c, F.lit(rules.task[0])), F.lit(rules.task[1])))
    level = _one("level", _first_match(c, [rules.fill(p) for p in rules.levels]))
    dips = _pairs("dip", c, rules.dip, 2, 1, 0, lambda x: _clean_class(x, rules))
    # Dip phrases are cut out before class levels are read; the cut keeps segments apart. A search starts
    # at the segments' first characters only: from every character, it would walk the rest of its segment each time.
    rest = F.regexp_replace(c, rf"(?:\G|(?<![^/／，,。！？!?]))[^/／，,。！？!?]*(?:{rules.dip})[^/／，,。！？!?]*", "，")

    def level_of(segment: Column) -> Column:
        direct_name = _clean_class(F.regexp_extract(segment, rules.level_class, 2), rules)
        direct = F.regexp_extract(segment, rules.level_class, 1)
        hinted = rules.fill(rules.class_level)
        return (
            F.when((direct != "") & (direct_name != ""), F.struct(direct_name.alias("k"), direct.alias("v")))
            .when(
                F.regexp_extract(segment, hinted, 2) != "",
                F.struct(F.regexp_extract(segment, hinted, 1).alias("k"), F.regexp_extract(segment, hinted, 2).alias("v")),
            )
        )

    composition = let(
        F.array_compact(F.transform(F.transform(F.split(rest, rules.segment), strip), level_of)),
        lambda found: F.transform(found, lambda z, i: _seen("class", z["k"], z["v"], i)),
    )
    planned = _pairs("planned", c, rules.planned, 1, 2, 0, lambda x: _clean_class(x, rules), lambda v: F.nullif(v, F.lit("")))
    wishes = F.flatten(
        F.array(
            *[
                F.transform(
                    F.arrays_zip(_all(c, p, 1).alias("v"), match_starts(c, F.lit(p)).alias("at"), _all(c, p, 0).alias("hit")),
                    lambda m: F.struct((m["at"] + F.instr(m["hit"], m["v"]) - 1).alias("at"), strip(m["v"]).alias("v")),
                )
                for p in rules.preferences
            ]
        )
    )
    usable = F.filter(wishes, lambda w: ~F.regexp_like(w["v"], F.lit(rules.not_preference)))
    preference = _one("preference", F.array_max(usable)["v"])
    scores = _pairs("ability", c, rules.fill(rules.ability_score), 1, 2, 0)

    def choice(kind: str, words: tuple[str, ...]) -> Column:
        value = _first_match(c, [rules.fill(p, words) for p in rules.choices])
        items = F.filter(
            F.transform(F.split(_clean_value(value, rules), rules.choice_split), strip), lambda v: v != ""
        )
        return _one(kind, F.when(F.size(items) > 0, F.array_join(items, "\u0001")))

    found = F.concat(
        task, level, *facts, dips, composition, planned, preference, scores,
        choice("feats", rules.feat_words), choice("spells", rules.spell_words),
    )
    seen = settle(users.withColumn("_o", found).drop("_c"))
    return seen.select(*keys, "turn", F.explode("_o").alias("o")).select(*keys, "turn", "o.*").where(
        (F.col("kind").isin("task", "level", "preference", "feats", "spells"))
        | ((F.col("key") != "") & ((F.col("kind") == "planned") | (F.coalesce("value", F.lit("")) != "")))
    )


def fold_observations(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Field values (keys, kind, key, value): the last one written wins.

    A message that states a class composition replaces the older one as a
    whole; the other maps merge by key.
    """
    newest = observed.where("kind = 'class'").groupBy(*keys).agg(F.max("turn").alias("_t"))
    current = observed.where("kind = 'class'").join(newest, keys).where(F.col("turn") == F.col("_t")).drop("_t")
    others = observed.where("kind <> 'class'")
    return (
        others.unionByName(current)
        .groupBy(*keys, "kind", "key")
        .agg(F.max(F.struct("turn", "pos", "value")).alias("w"))
        .select(*keys, "kind", "key", F.col("w.value").alias("value"), F.col("w.turn").alias("turn"))
    )


def fold_state(messages: DataFrame, keys: list[str], rules: StateRules = StateRules()) -> DataFrame:
    """One row per conversation that has any state."""
    return assemble_state(fold_observations(observations(messages, keys, rules), keys), keys, rules)


def assemble_state(values: DataFrame, keys: list[str], rules: StateRules = StateRules()) -> DataFrame:
    """One row per conversation of the field values that `fold_observations` gives."""

    def scalar(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("value")))

    def mapped(kind: str, value: Column) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct(F.col("key"), value.alias("value")))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    number = F.col("value").try_cast("int")
    grouped = values.groupBy(*keys).agg(
        scalar("task").alias("task"),
        mapped("fact", F.col("value")).alias("facts"),
        scalar("level").try_cast("int").alias("_level"),
        F.max(F.when(F.col("kind") == "level", F.col("turn"))).alias("_level_turn"),
        mapped("class", number).alias("class_levels"),
        F.max(F.when(F.col("kind") == "class", F.col("turn"))).alias("_class_turn"),
        F.sum(F.when(F.col("kind") == "class", number)).cast("int").alias("_class_sum"),
        mapped("planned", number).alias("planned_class_levels"),
        mapped("dip", number).alias("planned_dip_levels"),
        scalar("preference").alias("role_preference"),
        mapped("ability", number).alias("ability_scores"),
        F.split(F.coalesce(scalar("feats"), F.lit("")), "\u0001").alias("feats"),
        F.split(F.coalesce(scalar("spells"), F.lit("")), "\u0001").alias("spells"),
    )
    # Within one message the composition is applied after the stated level.
    level = F.when(
        F.col("_class_turn").isNotNull()
        & (F.col("_level_turn").isNull() | (F.col("_class_turn") >= F.col("_level_turn"))),
        F.col("_class_sum"),
    ).otherwise(F.col("_level"))
    return grouped.select(
        *keys,
        "task",
        "facts",
        level.alias("character_level"),
        "class_levels",
        "planned_class_levels",
        "planned_dip_levels",
        "role_preference",
        F.try_element_at("facts", F.lit(rules.race)).alias("race"),
        "ability_scores",
        F.filter("feats", lambda v: v != "").alias("feats"),
        F.filter("spells", lambda v: v != "").alias("spells"),
    )


def state_field_count(state: DataFrame) -> DataFrame:
    def one(name: str) -> Column:
        return F.when(F.col(name).isNotNull() & (F.col(name).cast("string") != ""), 1).otherwise(0)

    sized = ("class_levels", "planned_class_levels", "planned_dip_levels", "ability_scores", "feats", "spells", "facts")
    total = one("task") + one("character_level") + one("role_preference") + one("race")
    for name in sized:
        total = total + F.size(name)
    return state.withColumn("field_count", total)


def answer_guidance(questions: DataFrame, rules: StateRules = StateRules()) -> DataFrame:
    """Adds target_field (the last one mentioned), entity constraints and the other facts of the state."""
    spots = F.array_compact(
        F.array(
            *[
                F.when(
                    F.contains("question", F.lit(f)),
                    F.struct(
                        F.length(F.substring_index("question", f, -1)).alias("tail"),
                        F.lit(dict(rules.aliases).get(f, f)).alias("field"),
                    ),
                )
                for f in rules.fields
            ]
        )
    )
    entities = F.map_filter("facts", lambda k, v: k.isin(list(rules.entity_fields)) & (v != ""))
    placed = F.transform(
        spots,
        lambda s: F.struct((F.length("question") - s["tail"] - F.length(s["field"])).alias("at"), s["field"].alias("field")),
    )
    target = F.array_max(placed)["field"]
    return (
        questions.withColumn("target_field", target)
        .where(F.col("target_field").isNotNull())
        .withColumn("entity_constraints", entities)
        .withColumn(
            "parallel_state",
            F.map_filter(
                "facts", lambda k, v: (k != F.col("target_field")) & ~F.array_contains(F.map_keys("entity_constraints"), k)
            ),
        )
    )


def enrich_queries(searches: DataFrame, rules: StateRules = StateRules()) -> DataFrame:
    """Adds `enriched`: the user's own words plus the state a search depends on.

    Needs search, latest_user_message, task (nullable), facts (map).
    """
    strings = "array<string>"
    none = F.array().cast(strings)
    latest, search = strip(F.col("latest_user_message")), strip(F.col("search"))
    combined = F.concat_ws(" ", "latest_user_message", "search")
    entity = F.coalesce(*[F.nullif(F.try_element_at("facts", F.lit(f)), F.lit("")) for f in rules.entity_fields])
    stated = F.col("task").isNotNull() | (F.size("facts") > 0)
    by_rule = (
        F.when(
            F.regexp_like("latest_user_message", F.lit(rules.selection)),
            F.concat(F.map_values("facts"), F.map_keys("facts")),
        )
        .when(
            entity.isNotNull()
            & (contains_any(combined, list(rules.categories)) | F.regexp_like(combined, F.lit(rules.pointer))),
            F.array(entity),
        )
        .when(F.col("task").isNotNull() & F.regexp_like(combined, F.lit(rules.next_step)), F.array("task"))
        .otherwise(none)
    )
    scoped = F.when(
        F.col("task").isNotNull()
        & contains_any(combined, list(rules.entity_fields))
        & F.regexp_like(combined, F.lit(rules.lookup)),
        F.array("task"),
    ).otherwise(none)
    base = F.when(stated & (latest != ""), latest).otherwise(search)
    rows = settle(searches.withColumn("_base", base).withColumn("_add", F.concat(by_rule, scoped)))
    lead = F.when((search != "") & ~F.contains("_base", search), F.array(search)).otherwise(none)
    extra = F.filter(F.array_distinct(F.concat(lead, "_add")), lambda v: ~F.contains(F.col("_base"), v))
    return rows.withColumn("enriched", strip(F.concat_ws(" ", "_base", extra))).drop("_base", "_add")


def revision_mismatch(conversations: DataFrame, libraries: DataFrame) -> DataFrame:
    """Conversations of a known library whose stored revision is not its current one."""
    current = libraries.select("library_id", F.col("revision").alias("current_revision"))
    return conversations.join(current, "library_id").where(
        ~F.col("library_revision").eqNullSafe(F.col("current_revision"))
    )
