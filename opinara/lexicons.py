"""Default word lists and labels.

Fixed values: degree weights, negation words, exceptions, dimension labels and
seeds are inputs of the scores, so they are stated here as data. Other
vocabularies can be read with ``sources.readers``.
"""

from __future__ import annotations

from .operators.lexicon import Rules, Seed

# Affective dimension labels and codes.
AFFECTIVE_DIMENSIONS = {
    "高级-廉价": "ME1",
    "厚重-轻薄": "ME2",
    "简约大气-复杂凌乱": "ME3",
    "精致美观-粗糙难看": "ME4",
    "时尚科技-传统老气": "ME5",
}

# Functional dimension labels and codes.
FUNCTIONAL_DIMENSIONS = {
    "升降功能": "MF1",
    "噪音控制": "MF2",
    "稳定性承重": "MF3",
    "材质做工": "MF4",
    "异味环保": "MF5",
    "操控智能": "MF6",
    "空间尺寸": "MF7",
}

# Degree words before the hit.
DEGREES = {
    **dict.fromkeys([
        "非常", "特别", "超级", "超", "很", "十分", "极", "极其", "太", "真的", "真是", "格外", "尤其", "无比", "极度", "巨",
        "贼", "老",
    ], 1.0),
    **dict.fromkeys(["比较", "挺", "蛮", "还算", "相当", "颇为", "颇", "够"], 0.7),
    **dict.fromkeys(["有点", "稍微", "略微", "略", "稍", "有些", "有一点"], 0.4),
}

# Weak degree words after the hit.
DEGREES_AFTER = dict.fromkeys(["还行", "还可以", "还是可以", "尚可", "过得去"], 0.4)

# Negation words and phrases that look like negation.
NEGATIONS = ["不", "没", "无", "并不", "并没", "毫无", "未", "从不", "绝不"]
NEGATION_EXCEPTIONS = ["不错", "不少", "不止", "不仅", "不但", "不光", "无论", "无比"]

# Affective seeds (positive, negative, excluded) per dimension.
AFFECTIVE_SEEDS = {
    "高级-廉价": (
        ["高级", "高档", "高端", "档次", "上档次", "高级感", "高大上", "贵气", "气派"],
        ["廉价", "低端", "便宜货", "廉价感", "次品", "很次", "比较次", "低档", "看着廉价"],
        [],
    ),
    "厚重-轻薄": (
        ["厚重", "厚实", "扎实", "结实", "敦实", "沉稳", "沉甸甸", "实在", "厚", "牢固"],
        ["轻薄", "单薄", "轻飘", "飘", "不结实", "薄", "轻飘飘"],
        ["稳", "稳当", "很稳", "挺稳", "稳定", "稳固", "稳如", "用料足", "用料实在", "用料"],
    ),
    "简约大气-复杂凌乱": (
        ["简约", "简洁", "干净", "利落", "清爽", "纯粹", "极简", "大气", "大方", "简单大方", "素雅"],
        ["复杂", "凌乱", "繁琐", "累赘", "花哨", "杂乱", "繁复"],
        [],
    ),
    "精致美观-粗糙难看": (
        [
            "精致", "精细", "细致", "精美", "精巧", "细腻", "做工细", "做工好", "工艺好", "做工扎实", "细节到位", "好看", "漂亮", "美观",
            "颜值高", "颜值", "款式好", "颜色好看", "外观好看", "耐看", "百搭",
        ],
        ["粗糙", "毛糙", "做工差", "粗制", "毛刺", "工艺差", "做工粗糙", "难看", "丑", "丑陋", "不好看", "颜色丑", "色差大"],
        [],
    ),
    "时尚科技-传统老气": (
        ["时尚", "现代", "酷炫", "炫酷", "酷", "潮", "潮流", "新潮", "前卫", "电竞风", "科技感", "未来感", "炫", "未来装甲"],
        ["老气", "过时", "土", "俗气", "老套", "传统呆板"],
        [],
    ),
}

# Functional phrases with the attitude they express (positive, negative, excluded).
FUNCTIONAL_PHRASES = {
    "升降功能": (
        ["丝滑", "顺滑", "顺畅", "灵活", "扭力大", "遇阻停止", "防夹", "回弹", "保护"],
        ["卡顿", "卡住", "失灵", "故障", "无反应", "没反应", "无法升降", "升降不了", "不升降"],
        [],
    ),
    "噪音控制": (
        ["安静", "静音", "无声", "没有声音", "没有噪音", "无异响"],
        ["吵", "响", "嗡", "声音大", "噪音大", "有异响"],
        [],
    ),
    "稳定性承重": (
        ["稳", "稳当", "很稳", "挺稳", "稳固", "稳定", "不晃", "承重大", "稳如"],
        ["晃", "晃动", "摇", "摇晃", "抖", "不稳"],
        ["沉稳", "稳重"],
    ),
    "材质做工": (
        [
            "用料厚", "用料扎实", "耐磨", "耐用", "板材好", "实木", "质量好", "质量不错", "质量还行", "皮实", "结实耐用", "板厚足够",
            "质量很好", "质量真的好", "产品质量可以", "质量没问题", "做工质量不差", "桌面光滑", "板材厚实", "碳纤维感很足",
        ],
        ["材质差", "容易划痕", "板薄", "不耐用", "质量差", "板厚不够"],
        ["看着质量不错", "看着质量还行", "感觉质量还行", "看起来有质感", "看着不廉价"],
    ),
    "异味环保": (
        ["无味", "没有异味", "没有味道", "无甲醛", "环保"],
        ["异味", "刺鼻", "有甲醛", "臭", "有味儿"],
        [],
    ),
    "操控智能": (
        ["灵敏", "智能", "方便", "带USB", "带杯架"],
        ["不灵敏", "操作麻烦", "没遥控器", "走线乱", "无法隐藏", "电线无法隐藏"],
        [],
    ),
    "空间尺寸": (
        ["宽敞", "够大", "桌面大", "空间足", "尺寸合适"],
        ["太小", "桌面小", "空间紧", "不够"],
        [],
    ),
}


def _seeds(table: dict[str, tuple[list[str], list[str], list[str]]]) -> list[Seed]:
    out = []
    for dim, (pos, neg, skip) in table.items():
        out += [Seed(w, dim, 1) for w in pos]
        out += [Seed(w, dim, -1) for w in neg]
        out += [Seed(w, dim, 0, excluded=True) for w in skip]
    return out


def affective_rules() -> Rules:
    return Rules(_seeds(AFFECTIVE_SEEDS), DEGREES, DEGREES_AFTER, NEGATIONS, NEGATION_EXCEPTIONS)


def functional_rules() -> Rules:
    return Rules(_seeds(FUNCTIONAL_PHRASES), DEGREES, DEGREES_AFTER, NEGATIONS, NEGATION_EXCEPTIONS)
