"""Word lists and patterns of the document checks.

Everything here is a fixed value that results depend on; packs are parameters of the operators, these the defaults.
Patterns are in the common part of Java and RE2 syntax unless they carry a boundary, which ``{L}`` and ``{R}`` mark.
"""

from __future__ import annotations

# Clause lists of a tender, in match order.
REJECT_WORDS = ["否决", "废标", "无效投标", "取消投标资格", "作废", "不予受理", "拒绝受理", "丧失资格", "取消资格", "视为无效", "否决其投标", "不得参加", "取消中标资格", "重新招标", "拒收"]
REJECT_NEGATIVE = ["不否决", "不予否决", "不应否决", "不得否决", "不视为无效"]
FORMAT_WORDS = ["暗标", "字体", "字号", "行距", "页边距", "页眉", "页脚", "页码", "宋体", "仿宋", "黑体", "楷体", "磅", "四号", "小四", "五号", "三号", "加粗", "彩色", "明示", "隐去", "不得出现", "单位名称", "法定代表人", "logo", "标识", "页数"]
SCORE_WORDS = ["评分", "分值", "权重", "评分标准", "评标办法", "综合评估", "综合评分", "合理低价", "技术分", "商务分", "价格分", "资信分", "业绩分", "得分"]
QUALIFICATION_WORDS = ["资质", "证书", "注册建造师", "安全生产许可证", "业绩要求", "类似业绩", "信用等级", "体系认证", "执业资格", "专业承包", "施工总承包"]
CLAUSES = {"reject": (REJECT_WORDS, REJECT_NEGATIVE), "format": (FORMAT_WORDS, []), "scoring": (SCORE_WORDS, []), "qualification": (QUALIFICATION_WORDS, [])}

# Weights, duration and amounts; groups are number and unit.
WEIGHTS = {
    "技术": r"技术(?:标|部分|分)?[^\d]{0,12}(\d{1,3})\s*(?:分|%|％)",
    "商务": r"商务(?:标|部分|分)?[^\d]{0,12}(\d{1,3})\s*(?:分|%|％)",
    "价格": r"价格(?:分)?[^\d]{0,12}(\d{1,3})\s*(?:分|%|％)",
    "资信": r"资信(?:标|部分|分)?[^\d]{0,12}(\d{1,3})\s*(?:分|%|％)",
    "业绩": r"业绩(?:分)?[^\d]{0,12}(\d{1,3})\s*(?:分|%|％)",
}
DURATION = r"(?:工期|工期要求)[^\d]{0,15}(\d+)\s*(?:个)?\s*(?:日历天|天|日)"
COMMITTED_DURATION = r"(?:工期|工期承诺|计划工期|总工期)[^\d]{0,15}(\d+)\s*(?:个)?\s*(?:日历天|天|日)"
BOND = r"(?:投标)?保证金[^\d]{0,15}(\d+(?:\.\d+)?)\s*(亿元|万元|万|元)"
CONTROL_PRICE = r"(?:最高投标限价|最高限价|拦标价|招标控制价|控制价)[^\d]{0,15}(\d+(?:\.\d+)?)\s*(亿元|万元|万|元)"
BID_PRICE = r"(?:投标报价|投标总价|总报价|报价总额)[^\d]{0,15}(\d+(?:\.\d+)?)\s*(亿元|万元|万|元)"

# Personal data, in the order of masking.
PLACEHOLDER = "＊＊＊＊＊＊"
PII = [
    ("手机号码", r"1[3-9]\d{9}"),
    ("电子邮箱", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("身份证号", r"{L}\d{17}[\dXx]{R}"),
    ("银行账号", r"{L}\d{16,19}{R}"),
    ("统一社会信用代码", r"{L}[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}{R}"),
]

# The twelve facts of a project, as key and pattern; the value is the whole match.
FACTS = [
    ("工期", r"工期\s*(?:为\s*)?(\d+)\s*(日历天|天|日)"),
    ("最高投标限价", r"(?:最高投标限价|最高限价|招标控制价)\s*(?:约\s*)?([\d,]+(?:\.\d+)?)\s*万元"),
    ("投标保证金", r"投标保证金\s*([\d,]+(?:\.\d+)?)\s*万元"),
    ("质量保证金", r"质量保证金\s*(\d+(?:\.\d+)?)\s*%"),
    ("缺陷责任期", r"缺陷责任期\s*(\d+)\s*个月"),
    ("混凝土等级", r"混凝土(?:设计强度等级(?:为|：)?)?\s*(C\d+(?:\.\d+)?)"),
    ("抗渗等级", r"抗渗等级\s*(W\d+)"),
    ("资质等级", r"(?:总承包|专业承包)\s*([一二三四五]级|特级)"),
    ("项目经理", r"(?:一级|二级)\s*建造师(?:[（(]([^)）]+)[)）])?"),
    ("技术标分值", r"技术标\s*(\d+)\s*分"),
    ("商务标分值", r"商务标\s*(\d+)\s*分"),
    ("价格分分值", r"价格分\s*(\d+)\s*分"),
]
QUANTITY = r"(\d+(?:\.\d+)?)\s*(日历天|天|日|万元|个月|分|级|C\d+|W\d+|m|cm|mm|℃|%)"
UNIT = r"(日历天|天|日|万元|个月|分|级|℃|%|m|cm|mm)"

# Statements of fact and what can vouch for them.
FACT_NUMBER = r"(\d+(?:\.\d+)?\s*(?:%|％|年|月|日|天|m|km|km²|㎡|吨|t|万元|元|MPa|℃|°C|cm|mm|度|级|倍|次|项))"
FACT_STANDARD = r"(SL\s?\d+|GB/?T?\s?\d+|DL/T\s?\d+|JGJ\s?\d+|CJJ\s?\d+|规范|标准|规程|法|条例|主席令|部令)"
NARRATIVE = r"^(本章|本节|根据|依据|综上|因此|故|综上所|我方|本单位|投标人|说明：|注：)"
CITATION = r"(SL\s?\d+|GB/?T?\s?\d+|DL/T\s?\d+|JGJ\s?\d+|CJJ\s?\d+|\d+(?:\.\d+)?\s*(?:%|％|年|MPa|℃|°C|m|km|吨|t|万元|元|度|级|倍|次|项))"

# Requirement categories; the first of MANDATORY ones and the fallback are by name.
CATEGORIES = ["废标条款", "资质门槛", "评分标准", "格式要求", "商务条款"]
FALLBACK_CATEGORY = "商务条款"
MANDATORY = ["废标条款", "资质门槛"]

# What a requirement's check can come to.
STATUSES = ["完全响应", "部分响应", "缺失"]
MISSING = "缺失"
