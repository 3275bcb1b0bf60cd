"""Vocabulary of query understanding as data; replaceable per library."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------------------------

INTENT_RULES = (
    ("BUILD_ADVICE", ("(?i)(?:怎么BD|怎么构筑|构筑|build|推荐.+职业|生存能力)",)),
    ("BUILD_ADVICE", ("(?:兼职|多职业)", "(?:相比|收益|损失|推荐|提高|继续升|怎么)")),
    ("COMPARE_OPTIONS", ("(?:区别|比较|哪个更好|优劣|相比|和.+有什么不同)",)),
    ("PROCEDURE", ("(?:如何创建|怎么创建|创建.+步骤|流程|步骤|如何进行)",)),
)
FOCUS_LEAD = (r"^(?:(?:请问|想知道|关于)\s*)+", "^(?:有|没有)")
FOCUS = (
    r"^([\x{4e00}-\x{9fff}A-Za-z0-9·（）()／/+-]{2,24}?)(?:选择|获得|使用|把|将|且|时|后|在)"
)
FOCUS_TAIL = "(?:专长|规则|效果)$"
BUILD_SEARCHES = ("职业等级 职业能力", "属性依赖 专长 法术", "多职业 兼职收益 损失")
SURVIVAL = "生存"
FOLLOW_UP = "^(?:如果|那么|那|它|这个|这种|前者|后者|上述|刚才)"

DOMAIN_PATTERNS = (
    ("class", "职业|兼职|多职业|法师|术士|战士|牧师|游荡者|职业能力"),
    ("race", "种族|族裔|人类|精灵|矮人|半身人"),
    ("feat", "专长|专攻|武器格斗"),
    ("spell", "法术|施法|法术位|环法术|戏法|奥术|神术|法师护甲"),
    ("equipment", "装备|武器|(?<!法师)护甲|盾牌|物品|金币|购买"),
    ("progression", r"\d+\s*(?:到|至|[-~—])\s*\d+\s*级|成长|升级|前期|中期|后期|每级"),
)
GOAL = "(?i)想要|我想|目标|构筑|build|推荐|规划|提高|兼顾"
CONSTRAINT = "必须|不能|不要|只(?:能|用)|限定|限制|预算|保持|至少|最多"
PLANNER = "必须先|先(?:核对|确认|计算)|只有|否则|如果|未达到|根据.{0,24}(?:再|决定|选择)"
SENTENCE_END = "？?；;。"
SENTENCE_TRIM = "。；;"
QUESTION_SIGN = "？"
JOINERS = ("并", "同时", "另外", "还要", "以及")
QUESTION_MARKER = "(?:如何|怎么|什么|哪些|多少|是否|能否|何时|哪里|为何|说明|比较|推荐|规划|选择)"
COMPARISON = "区别|比较|优劣|分别|收益|损失|哪个更好"
COMPARISON_LIST = "、"
COMPARISON_SIDES = (
    r"([\x{4e00}-\x{9fff}A-Za-z0-9·（）()]{2,20}?)(?:和|与)"
    r"([\x{4e00}-\x{9fff}A-Za-z0-9·（）()]{2,20}?)"
    r"(?:分别|有什么|有何|的区别|的优劣|的收益|的损失|相比)"
)
COMPARISON_PREFIX = "^(?:并比较|比较)"
COMPARISON_QUESTION = "的规则效果是什么？"
DOMAIN_LABELS = {
    "class": "职业与职业能力", "race": "种族", "feat": "专长", "spell": "法术与施法",
    "equipment": "装备", "progression": "成长阶段",
}
DOMAIN_PRIORITY = ("class", "progression", "race", "spell", "feat", "equipment", "rule")
DOMAIN_TERMS = {
    "race": "人类|精灵|矮人|半身人|种族|族裔",
    "feat": r"猛力攻击|大顺势斩|顺势斩|法术专攻|[\x{4e00}-\x{9fff}]{0,6}专长",
    "spell": r"法师护甲|油腻术|[\x{4e00}-\x{9fff}]{2,8}(?:法术|术)",
    "equipment": r"[\x{4e00}-\x{9fff}]{0,6}(?:装备|武器|护甲|盾牌|物品)",
    "progression": r"\d+\s*(?:到|至|[-~—])\s*\d+\s*级|职业升级|成长|升级|前期|中期|后期|施法进度",
}
CLASS_NAMES = "奥法骑士|法师|术士|战士|牧师|游荡者"
CLASS_LEVEL = r"(\d+)\s*(?:到|至|[-~—])?\s*\d*\s*级"
CLASS_SUFFIX = "职业能力"
MIXING_WORDS = ("兼职", "多职业")
NAMED_SPELLS = ("法师护甲", "油腻术")
CASTER_WORDS = ("施法进度", "法术环级", "法术环位")
CASTERS = ("法师", "术士", "牧师")
PROGRESSION_MIXING = (("兼职", "多职业", "混职"), ("角色升级", "兼职", "每级选择职业"))

# (domain or any, all of these, any of these, search text); the first match wins.
REWRITE_RULES = (
    ("class", ("奥法骑士",), (), "奥法骑士 进阶要求 所有军用武器 3级奥术"),
    ("spell", ("奥法骑士",), (), "奥法骑士 从2级 每日法术 现有奥术施法职业等级+1"),
    ("equipment", ("奥法骑士",), (), "奥法骑士 所有军用武器 擅长"),
    ("progression", ("奥法骑士",), (), "奥法骑士 1级 2级 每日法术 施法进度"),
    (None, ("奥法骑士",), (), "奥法骑士 进阶要求 所有军用武器 3级奥术"),
    (None, ("猛力攻击", "顺势斩", "大顺势斩"), (), "大顺势斩（Great Cleave） BAB+4"),
    (None, ("油腻术",), (), "油腻术"),
    ("equipment", ("奥术失败",), (), "护甲 盾牌 奥术失败率"),
    ("spell", ("法师护甲",), (), "法师护甲"),
    ("spell", ("法师",), ("施法进度", "法术环级", "每日法术"), "法师（Wizard） 每日法术 表"),
    (None, ("铁门",), ("硬度", "生命值", "破坏DC"), "铁门 硬度 生命值 破坏DC"),
    (None, ("防御式战斗",), (), "防御式战斗"),
    (None, ("全防御",), (), "全防御"),
    (None, ("准备动作", "打断"), ("施法", "法术"), "准备动作 打断施法"),
)
# A plan task searches by the whole goal when the goal holds these words.
WHOLE_GOAL_RULES = (
    (("奥法骑士",), ("class", "spell", "equipment", "progression")),
    (("奥术失败",), ("equipment",)),
    (("猛力攻击", "顺势斩", "大顺势斩"), ("feat",)),
)
PLAN_CONDITIONAL = "必须先|先核对|只有|否则|如果|根据|未达到|满足.*才"
PLAN_COMPARE = "比较|收益|损失|优劣|区别"
PLAN_SELECTION = "根据已核对规则完成条件分支、选择与缺失信息"
FORBIDDEN_QUERY = (
    r"(?i)https?://|www\.|系统命令|执行命令|工具名|模型|规则库|"
    r"\b(?:search_rules|read_rules|finish_answer|system|shell|bash|python|curl)\b"
)
TASK_ID = "^[a-z][a-z0-9_-]{0,31}$"

# (kind, goal pattern, domains that can back it, field the user must still give)
SYNTHESIS_RULES = (
    ("missing_input", "指定(?:的)?法术环级|指定环级", (), "目标法术环级"),
    ("conditional_branch", "必须先|先核对|只有|否则|如果|未达到|满足.*才", (), ""),
    ("level_arithmetic", r"\d+\s*(?:到|至|[-—~])\s*\d+\s*级|升级|成长|兼职|进阶", ("class", "progression"), ""),
    ("feat_eligibility", "(?i)专长|feat", ("feat", "class", "race"), ""),
    ("spell_progression", r"(?i)法术|施法|奥术|神术|\d+\s*环|spell", ("spell", "class", "progression"), ""),
    ("equipment_stat", "装备|武器|盔甲|护甲|盾牌|价格|伤害", ("equipment", "rule"), ""),
)
TOPIC_MIXING = "兼职|多职业|收益|损失"
TOPIC_FEATS = "属性|专长|法术"
OPTIONS = (
    r"([^，。；]{1,30}?)(?:和|与|相比)([^，。；]{1,30}?)(?:有什么)?(?:区别|不同|优劣|哪个更好)"
)
OPTION_LEAD = "^(?:以)?(?:标准动作|整轮动作)?进行"
OPTION_TERMS = {"防御式战斗": "攻击（Attack）", "防御式攻击": "攻击（Attack）"}

GENERIC_ALIASES = (
    "basicrules", "corerules", "game", "gamerules", "rpg", "rules", "ruleset", "system",
    "中文版", "中文规则", "中文规则库", "中文", "基础规则", "核心规则", "游戏规则", "游戏系统",
    "游戏", "规则库", "规则",
)

# --- End of fixed values ----------------------------------------------------------------------


@dataclass(frozen=True)
class QueryRules:
    intents: tuple = INTENT_RULES
    focus_lead: tuple[str, ...] = FOCUS_LEAD
    focus: str = FOCUS
    focus_tail: str = FOCUS_TAIL
    build_searches: tuple[str, ...] = BUILD_SEARCHES
    follow_up: str = FOLLOW_UP
    domains: tuple = DOMAIN_PATTERNS
    goal: str = GOAL
    constraint: str = CONSTRAINT
    planner: str = PLANNER
    sentence_end: str = SENTENCE_END
    sentence_trim: str = SENTENCE_TRIM
    question_sign: str = QUESTION_SIGN
    joiners: tuple[str, ...] = JOINERS
    question_marker: str = QUESTION_MARKER
    comparison: str = COMPARISON
    comparison_list: str = COMPARISON_LIST
    comparison_sides: str = COMPARISON_SIDES
    comparison_prefix: str = COMPARISON_PREFIX
    comparison_question: str = COMPARISON_QUESTION
    labels: tuple = tuple(DOMAIN_LABELS.items())
    priority: tuple[str, ...] = DOMAIN_PRIORITY
    terms: tuple = tuple(DOMAIN_TERMS.items())
    class_names: str = CLASS_NAMES
    class_level: str = CLASS_LEVEL
    class_suffix: str = CLASS_SUFFIX
    level_word: str = "级"
    mixing: tuple[str, ...] = MIXING_WORDS
    named_spells: tuple[str, ...] = NAMED_SPELLS
    caster_words: tuple[str, ...] = CASTER_WORDS
    casters: tuple[str, ...] = CASTERS
    progression_mixing: tuple = PROGRESSION_MIXING
    rewrites: tuple = REWRITE_RULES
    whole_goal: tuple = WHOLE_GOAL_RULES
    conditional: str = PLAN_CONDITIONAL
    compare: str = PLAN_COMPARE
    synthesis: tuple = SYNTHESIS_RULES
    topic_mixing: str = TOPIC_MIXING
    topic_feats: str = TOPIC_FEATS
    options: str = OPTIONS
    option_lead: str = OPTION_LEAD
