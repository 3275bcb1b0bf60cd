"""Labels and markers of structured entries (fixed values)."""

FIELD_LABELS = {
    "spell": (
        "school", "level", "casting time", "components", "range", "target", "effect", "area", "duration",
        "saving throw", "spell resistance", "学派", "法术等级", "施法时间", "成分", "距离", "目标", "效果", "范围",
        "持续时间", "豁免", "法术抗力",
    ),
    "feat": ("prerequisites", "benefit", "normal", "special", "先决条件", "好处", "正常", "特殊"),
    "magic_item": (
        "aura", "caster level", "slot", "price", "weight", "requirements", "construction", "cost", "灵光",
        "施法者等级", "部位", "价格", "重量", "制作要求", "制作", "成本",
    ),
    "class_ability": (
        "level", "class skill", "class skills", "class features", "requirements", "special", "description",
        "weapon and armor proficiency", "等级", "职业技能", "职业能力", "需求", "特殊", "效果", "描述",
    ),
    "archetype": (
        "replaces", "replaced", "modified", "altered", "requirements", "替代", "替换", "修改", "改变", "需求",
    ),
}
STRONG_LABELS = {
    "spell": (
        "school", "casting time", "components", "range", "target", "duration", "学派", "施法时间", "成分", "距离",
        "目标", "持续时间",
    ),
    "feat": ("prerequisites", "benefit", "先决条件", "好处"),
    "magic_item": ("aura", "caster level", "slot", "price", "灵光", "施法者等级", "部位", "价格"),
    "archetype": ("replaces", "replaced", "modified", "altered", "替代", "替换", "修改", "改变"),
    "class_ability": (
        "class skill", "class skills", "class features", "description", "职业技能", "职业能力", "描述",
    ),
}
CATEGORY_MARKERS = {
    "spell": ("法术", "spell", "spells"),
    "feat": ("专长", "feat", "feats"),
    "magic_item": ("魔法物品", "magic item", "magic items"),
    "archetype": ("职业变体", "archetype", "variant"),
    "class_ability": ("职业能力", "职业特性", "class feature", "class ability", "class features"),
}
ENTRY_ORDER = ("spell", "feat", "magic_item", "archetype", "class_ability")
CLASS_WORDS = ("职业", "class")
CATALOG_LABELS = ("列表", "目录", "表格", "list", "catalog", "table", "index")
CATALOG_PATHS = ("法术", "专长", "装备", "魔法物品", "职业")
ABILITY_TAG = r"(?i)\b(?:ex|su|sp)\b|（[^）]*(?:ex|su|sp)[^）]*）"
ENTRY_TITLE = r"^.{1,160}\s*[\(（][^()（）\n]{2,160}[\)）]$"
FIELD_START = r"^\s*等级\s*[：:]"
TABLE_START_LABELS = (("学派", "school"), ("先决条件", "prerequisites"), ("灵光", "aura"), ("替代", "replaces"))
START_LABELS = {
    "feat": ("先决条件", "prerequisites", "好处", "benefit"),
    "magic_item": ("灵光", "aura", "价格", "price"),
    "archetype": ("替代", "replaces", "修改", "modified"),
}
TABLE_WORD = "表格"
EVIDENCE_LIMIT = 80_000
OVERVIEW_LIMIT = 8_000

# Paged sources.
BULLETS = "⚫•"
HEADING_STOPS = "[。！？.!?；;]$"
HEADING_SKIPS = "^[-|※]"
NUMBERS_ONLY = r"^[\d\s/＋+－—-]+$"
NUMBERED_LINE = r"^\d+[.、]"
LONG_HEADING = r"^(?:第.+[章节篇部]|\d+(?:\.\d+)*[、.]?)"
TITLE_BRACKETS = "[《》【】]"
NOT_PRIMARY_MARKS = "[《》【】（）()：:]"
NOT_PRIMARY_WORDS = "弱点|特技|技能|能力|表格|步骤|说明"
