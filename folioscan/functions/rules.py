"""Domain vocabulary as data. Every job takes its rules as an argument; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------------------------

MULTICLASS_MARKERS = (
    "兼职", "多职业", "职业等级组合", "混合职业", "混职", "兼职系统", "次要职业", "跨职业",
    "multiclass", "multiclassing", "multipleclasses", "classlevelcombination", "takinglevels",
)
FAVORED_CLASS_MARKERS = ("天赋职业", "favoredclass", "favoredclassbonus", "preferredclass", "升级奖励")
REFERENCE_MARKERS = (
    "职业法术", "法术列表", "spelllist", "classspell", "出处速查", "速查", "sourcequickreference",
    "quickreference", "目录", "tableofcontents", "contents", "索引", "index", "更新记录", "更新日志",
    "变更记录", "changelog", "updatelog",
)
REFERENCE_DOCUMENT_TYPES = ("index", "contents", "changelog", "reference")

QUERY_ALIASES = {
    "创建": ("建立",),
    "建立": ("创建",),
    "基本特性": ("基本特技",),
    "基本特技": ("基本特性",),
    "人物": ("角色",),
    "照亮": ("照明半径",),
    "燃烧多久": ("持续时间",),
    "多职业": ("兼职", "混职", "混职系统", "职业等级组合"),
    "兼职": ("多职业", "混职", "混职系统", "职业等级组合"),
}
SAFE_EXPANSIONS = ("照亮", "燃烧多久")
MULTICLASS_QUERY_MARKERS = ("兼职", "多职业", "混职", "混合职业", "职业等级组合")
RULE_CATEGORIES = (
    "弱点", "特技", "技能", "能力", "属性", "职业", "动作", "法术",
    "装备", "武器", "防具", "检定", "费用", "消耗", "条件", "效果",
)
CREATION_VERBS = ("创建", "建立")
CREATION_SUBJECTS = ("角色", "人物")
CREATION_SUBTOPICS = (
    "属性", "能力值", "技能", "专长", "装备", "法术", "弱点", "特技", "生命值", "购点",
)
LOOKUP_PATTERN = "(?:有哪些|有什么|是什么|列出|多少|效果)"
LOOKUP_EXCEPTION = "(?:是否|能否|可否|为什么|为何|如何).*(?:与|和|同时|影响)"

# --- End of fixed values ----------------------------------------------------------------------


@dataclass(frozen=True)
class MarkerRules:
    """Word groups that separate level-mixing rules from reward rules and reference pages."""

    multiclass: tuple[str, ...] = MULTICLASS_MARKERS
    favored: tuple[str, ...] = FAVORED_CLASS_MARKERS
    reference: tuple[str, ...] = REFERENCE_MARKERS
    reference_types: tuple[str, ...] = REFERENCE_DOCUMENT_TYPES


@dataclass(frozen=True)
class RerankRules:
    """Vocabulary of query expansion, heading matching and pruning."""

    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(QUERY_ALIASES))
    expansion_gates: tuple[str, ...] = SAFE_EXPANSIONS + MULTICLASS_QUERY_MARKERS
    categories: tuple[str, ...] = RULE_CATEGORIES
    creation_verbs: tuple[str, ...] = CREATION_VERBS
    creation_subjects: tuple[str, ...] = CREATION_SUBJECTS
    creation_subtopics: tuple[str, ...] = CREATION_SUBTOPICS
    lookup: str = LOOKUP_PATTERN
    lookup_exception: str = LOOKUP_EXCEPTION
