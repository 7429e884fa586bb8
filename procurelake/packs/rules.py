"""Rule packs: disclosure, format templates, fair competition, industries, price methods, prechecks.

Ids, patterns, word lists, limits and scopes are fixed values that verdicts depend on.  A rule is
(id, category, severity, detect, expect); HARD rules have severity REJECT, SOFT ones WARN.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    detect: str
    expect: dict = field(default_factory=dict)
    auto_fixable: bool = False
    needs_review: bool = False

    @property
    def hard(self) -> bool:
        return self.severity == "REJECT"


@dataclass(frozen=True)
class Template:
    id: str
    region: str
    city: tuple[str, ...]
    industry: tuple[str, ...]
    tender_type: tuple[str, ...]
    level: str
    effective_from: date | None
    effective_to: date | None
    rules: tuple[Rule, ...]
    supersedes: tuple[str, ...] = ()
    status: str = "ACTIVE"


def _text(id: str, patterns: list[str], exclude: tuple[str, ...] = (), fix: bool = True, review: bool = False, category: str = "DISCLOSURE") -> Rule:
    return Rule(id, category, "REJECT", "text.pattern", {"patterns": patterns, "occurrences": 0, "exclude": list(exclude)}, fix, review)


NEUTRAL = ["", "author", "user"]
# What must not show who the bidder is.
DISCLOSURE = (
    _text("LEAK.CREDIT_CODE", ["[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}"]),
    _text("LEAK.MOBILE", ["1[3-9][0-9]{9}"]),
    _text("LEAK.EMAIL", [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"]),
    _text("LEAK.BANK_ACCOUNT", ["[0-9]{16,19}"], fix=False, review=True),
    _text(
        "LEAK.COMPANY_NAME",
        ["[一-龥]{2,15}(有限公司|股份有限公司|有限责任公司|集团公司|总公司)", "[一-龥]{2,15}(集团|公司)(承建|承修|承制|施工)"],
        ("招标人", "采购人", "招标代理", "监理单位", "设计单位", "发包人"),
        review=True,
    ),
    _text("LEAK.ADDRESS", ["[一-龥]{2,8}(省|自治区)[一-龥]{2,8}市[一-龥]{2,8}(区|县)[一-龥]{2,15}(路|街|道|大道)[0-9]{1,4}号"]),
    _text(
        "LEAK.PERSON",
        [
            r"(?:项目经理|项目总监|技术负责人|总工程师|法定代表人|法人代表|授权代表|联系人|项目负责人)\s*[:：]\s*[一-龥]{2,4}",
            r"(?:姓名|名字)\s*[:：为]\s*[一-龥]{2,4}",
            r"[一-龥]{2,4}\s*[（(]\s*(?:签字|签章|签名|盖章)\s*[)）]",
            r"(?:注册建造师|注册造价师|注册监理工程师)\s*[:：]?\s*(?:证书编号)?\s*[一-龥]{2,4}[0-9]{4,}",
        ],
        review=True,
    ),
    _text("LEAK.CULTURE", ["企业使命", "企业愿景", "核心价值观", "企业精神", "公司口号", "服务宗旨", "荣获.*称号", "连续.*年.*被评为"], fix=False),
    Rule("META.CREATOR", "METADATA", "REJECT", "metadata.creator", {"neutral": NEUTRAL}, True),
    Rule("META.LAST_MODIFIED_BY", "METADATA", "REJECT", "metadata.lastModifiedBy", {"neutral": NEUTRAL}, True),
    Rule("META.COMPANY", "METADATA", "REJECT", "metadata.company", {"must_be_empty": True}, True),
    Rule("META.REVISIONS", "METADATA", "REJECT", "marks.revisions", {"max": 0}, True),
    Rule("META.COMMENTS", "METADATA", "REJECT", "marks.comments", {"max": 0}, True),
    Rule("META.HIDDEN_TEXT", "METADATA", "REJECT", "marks.hidden_text", {"max": 0}, True),
    Rule("META.RSID", "METADATA", "WARN", "marks.rsid_count", {"max": 0}, True),
    Rule("IMG.EXIF", "METADATA", "REJECT", "images.exif", {"max": 0}, True),
    Rule("IMG.COLOR", "FORMAT", "WARN", "images.color", {"allowed": ["gray", "grayscale", "GRAY"]}, True),
)
SONG = ["宋体", "SimSun"]
HEADED = ["标题", "Heading"]


def _layout(size: float, spacing: dict, margins: tuple[float, float, float, float], *, pages: str | None, soft_margins: bool = False, indent: bool = False) -> tuple[Rule, ...]:
    """The rules on layout that templates share, with what differs between them."""
    top, bottom, left, right = margins
    rules = [
        Rule("FONT.FAMILY.BODY", "FORMAT", "REJECT", "run.font.name", {"allowed": SONG}, True),
        Rule("FONT.SIZE.BODY", "FORMAT", "REJECT", "run.font.size", {"pt": size, "tolerance": 0.01, "exclude_styles": [*HEADED, "表头"]}, True),
        Rule("PARA.LINE_SPACING", "FORMAT", "REJECT", "paragraph.line_spacing", spacing, True),
        Rule("PAGE.MARGIN", "FORMAT", "WARN" if soft_margins else "REJECT", "doc.page.margins", {"top_cm": top, "bottom_cm": bottom, "left_cm": left, "right_cm": right, "tolerance": 0.05}, True),
        Rule("FONT.COLOR", "FORMAT", "REJECT", "run.color", {"allowed": ["000000", "auto", ""]}, True),
        Rule("DOC.NO_HEADER_FOOTER", "DISCLOSURE", "REJECT", "doc.marks.headers_footers", {"max": 0}, True),
        Rule("DOC.NO_WATERMARK", "DISCLOSURE", "REJECT", "doc.marks.watermark", {"max": 0}, True),
    ]
    if pages:
        rules.append(Rule("DOC.PAGE_COUNT", "STRUCTURE", pages, "doc.page_count", {"max": 100}))
    if indent:
        rules.append(Rule("PARA.FIRST_LINE_INDENT", "FORMAT", "WARN", "paragraph.first_line_indent", {"chars": 2.0, "tolerance": 0.3, "exclude_styles": HEADED}, True))
    return tuple(rules)


ONE_AND_HALF = {"multiple": 1.5, "rule": "auto", "tolerance": 0.02}
COMMON_ID = "common-disclosure-v1"
BUILDING = ("工程", "房建", "市政")
# Templates by region, scope and time.
TEMPLATES = (
    Template(COMMON_ID, "*", ("*",), ("*",), ("*",), "NORMATIVE", date(2023, 8, 1), None, DISCLOSURE),
    Template(
        "hebei-provincial-v3", "河北省", ("*",), BUILDING, ("工程",), "NORMATIVE", date(2024, 4, 1), None,
        _layout(14.0, {"pt": 30.0, "rule": "exact", "tolerance": 0.5}, (2.5, 2.0, 2.0, 2.0), pages="REJECT", indent=True)
        + (
            Rule("PARA.ALIGN", "FORMAT", "WARN", "paragraph.alignment", {"value": "justify", "exclude_styles": HEADED}, True),
            Rule("PARA.SPACING", "FORMAT", "WARN", "paragraph.spacing", {"before_pt": 0.0, "after_pt": 0.0, "tolerance": 0.5}, True),
        ),
        ("hebei-provincial-v1", "hebei-provincial-v2"),
    ),
    Template("hebei-baoding-v2", "河北省", ("保定市",), BUILDING, ("工程",), "NORMATIVE", date(2024, 1, 1), None, _layout(12.0, ONE_AND_HALF, (2.5, 2.5, 2.5, 2.5), pages="WARN", indent=True), ("hebei-baoding-v1",)),
    Template(
        "hebei-transport-2026", "河北省", ("*",), ("交通", "公路", "水运"), ("工程",), "NORMATIVE", date(2026, 6, 1), date(2031, 5, 31),
        _layout(14.0, ONE_AND_HALF, (2.5, 2.5, 2.5, 2.5), pages="REJECT", soft_margins=True)
        + (_text("DOC.NO_SPECIAL_METHOD", ["工法名称", "专利号", "专有技术", "独家", "独有", "我公司专利"], fix=False),),
        ("hebei-transport-2024",),
    ),
    Template("hebei-zhangjiakou-v2", "河北省", ("张家口市", "承德市", "秦皇岛市", "廊坊市"), BUILDING, ("工程",), "NORMATIVE", date(2024, 1, 1), None, _layout(14.0, ONE_AND_HALF, (2.5, 2.0, 2.0, 2.0), pages=None, indent=True), ("hebei-zhangjiakou-v1",)),
)
# Weight of a template's legal level, and of a match of city, industry and type.
LEVELS = {"LAW": 100, "ADMIN_REG": 90, "MINISTERIAL_RULE": 80, "LOCAL_REG": 70, "NORMATIVE": 60, "STANDARD": 50}
MATCH_CITY, MATCH_INDUSTRY, MATCH_TYPE, DATED = 40, 30, 10, 5


@dataclass(frozen=True)
class FairRule:
    id: str
    type: str
    category: str
    keywords: tuple[str, ...]
    patterns: tuple[str, ...] = ()


# Clauses that shut bidders out.
FAIRNESS = (
    FairRule("FAIR.SPECIFY_BRAND", "HARD", "量身定制", ("指定品牌", "指定型号", "指定产地", "指定供应商", "指定专利", "唯一指定", "仅限品牌", "只能采用", "必须为", "须指定", "须为品牌", "非指定不得", "指定产品", "原装进口限定"), (r"(?:指定|仅限|只能|必须|须)(?:采用|使用)?[^，。；\n]{0,20}(?:品牌|牌|型号|产地|供应商)",)),
    FairRule("FAIR.REGION_PERFORMANCE", "HARD", "地域限制", ("本地业绩", "本市业绩", "本省业绩", "省内业绩", "当地业绩", "市域内业绩", "省域内业绩", "本地项目业绩", "本地类似业绩", "在本省承接", "在本市承接"), (r"(?:本地|本省|本市|省内|市域|省域|当地)[^，。；\n]{0,10}业绩",)),
    FairRule("FAIR.LOCAL_BRANCH", "HARD", "地域限制", ("设立本地分支机构", "设立分公司", "本地纳税", "当地纳税", "在本地缴税", "本地社保", "在当地注册", "须本地注册", "注册地在本", "本地公司", "聘用本地人员", "本地用工"), (r"(?:须|必须|应)在(?:本地|当地|本市|本省)(?:设立|注册|纳税|缴纳|聘用)",)),
    FairRule("FAIR.OWNERSHIP_RESTRICT", "HARD", "所有制限制", ("须为国有企业", "限国有企业", "央企", "国有企业优先", "民营企业不得", "不得为民营企业", "须为上市公司", "限上市公司", "所有制形式"), (r"(?:须|限|仅限|只限)(?:为)?(?:国有|民营|上市|外资|中央|地方国有)企业",)),
    FairRule("FAIR.SPECIFIC_AWARD", "SOFT", "奖项限制", ("鲁班奖", "詹天佑奖", "国家优质工程奖", "优质工程奖", "省优质工程", "省级优质工程", "市优质工程", "市级优质工程", "本地奖项", "奖项加分", "获奖加分", "获得奖项加分"), (r"(?:获得|取得|具备|具有)[^，。；\n]{0,25}(?:奖|奖项)[^，。；\n]{0,12}(?:加分|得分|优先)",)),
    FairRule("FAIR.QUALIFICATION_MISMATCH", "SOFT", "量身定制", ("特级资质", "一级资质", "甲级资质"), (r"(?:造价|预算|金额|投资)[^，。；\n]{0,10}(?:万元|亿元)[^，。；\n]{0,30}(?:特级|一级|甲级)",)),
    FairRule("FAIR.DISCRIMINATE_OUTSIDER", "HARD", "地域限制", ("外地企业不得", "拒绝外地", "非本地企业不得", "本地企业优先", "本地企业加分", "外地企业须", "外地企业需", "本地企业同等条件下优先"), (r"(?:外地|非本地|外省|市外|省外)企业[^，。；\n]{0,15}(?:不得|不能|优先|加分|排除)",)),
    FairRule("FAIR.SENSITIVE_WORD", "SOFT", "错敏词", ("量身定制", "内定", "萝卜招标", "歧视", "排斥", "暗中指定", "暗示中标", "倾向某")),
    FairRule("FAIR.RESTRICT_TRADE_TOOL", "SOFT", "量身定制", ("指定交易平台", "必须使用某某平台", "指定CA", "指定电子认证", "指定投标工具", "指定制作软件", "强制购买"), (r"(?:指定|必须|强制)[^，。；\n]{0,15}(?:平台|工具|软件|认证|CA)",)),
)

# Industries in order, with the pack key and the key words.
INDUSTRIES = (
    ("建筑工程", "construction", ("房建", "房屋建筑", "住宅", "办公楼", "商业综合体", "施工总承包", "安装工程", "装饰装修", "钢结构", "地下室", "主体结构", "装配式", "剪力墙", "框架结构", "竣工验收")),
    ("市政道路与给排水", "municipal", ("市政道路", "给排水", "排水管道", "污水管网", "桥梁", "交通导改", "扬尘治理", "顶管", "沥青", "水稳基层", "人行道", "路灯照明", "综合管廊", "泵站")),
    ("水利水电", "water", ("水利", "河道治理", "水库除险加固", "堤防", "灌区", "施工导流", "度汛", "防渗墙", "大体积混凝土", "帷幕灌浆", "水电站", "水土保持", "节水改造", "泵站更新")),
    ("机电安装与装饰装修", "mep", ("机电安装", "装饰装修", "暖通", "空调", "电气", "消防", "给排水", "智能化", "深化设计", "BIM", "调试", "成品保护", "洁净室", "机房工程")),
    ("新能源", "new_energy", ("光伏", "风电", "储能", "并网", "逆变器", "组件", "PCS", "升压站", "分布式光伏", "集中式", "支架", "容配比", "发电效率", "碳排放")),
    ("城市更新", "urban_renewal", ("老旧小区", "城市更新", "管网改造", "棚改", "加装电梯", "适老化", "雨污分流", "海绵城市", "外立面整治", "背街小巷", "既有建筑改造", "节能改造")),
    ("材料设备采购", "material_equipment", ("设备采购", "材料采购", "货物招标", "技术参数响应", "型式试验", "售后服务", "备品备件", "供货周期", "质保期", "验收标准", "原产地", "授权代理")),
    ("公路交通", "transport", ("公路", "交通工程", "路基", "路面", "沥青", "桥梁", "隧道", "涵洞", "交安设施", "双随机", "JTG", "养护工程", "改扩建", "标志标线", "护栏")),
    ("EPC工程总承包", "epc", ("EPC", "工程总承包", "设计施工一体化", "限额设计", "BIM", "采购管理", "界面管理", "联合体", "交钥匙", "设计采购施工", "全过程咨询", "项目经理负责制")),
    ("信息化与IT", "it_informatization", ("信息化", "软件", "系统开发", "平台建设", "运维服务", "数据治理", "网络安全", "等保", "信创", "国产化", "云资源", "大数据", "人工智能", "智慧园区", "接口对接", "源代码")),
    ("政府采购与货物服务", "gov_procurement", ("政府采购", "公开招标", "竞争性磋商", "询价", "单一来源", "货物", "服务", "财政性资金", "采购代理", "中小企业", "节能产品", "环境标志", "进口产品", "履约验收")),
)
UNKNOWN_INDUSTRY, DEFAULT_PACK = "未识别", "construction"

# Price methods with their parameters.
METHODS = {
    "BASE_PRICE_LINEAR": {"base": "AVG_DROP", "drop_n": 1, "above_penalty": 1.0, "below_penalty": 0.5},
    "LOWEST_FULL": {"base": "MIN_PRICE"},
    "BASE_PRICE_RATIO": {"base": "AVG_ALL", "drop_n": 0},
    "REASONABLE_LOW": {"base": "AVG_DROP", "drop_n": 1, "lower_pct": 0.05, "upper_pct": 0.03, "out_penalty": 2.0},
    "HEBEI_DUAL_RANDOM": {"candidates": ["AVG_ALL", "AVG_DROP", "AVG_DROP_LOWER", "MIN_PRICE"], "drop_n": 1, "above_penalty": 1.0, "below_penalty": 0.5},
}
# Prechecks by code, and the industries to which the starred parameters apply.
PRECHECKS = {
    "P01": "投标文件签字盖章", "P02": "联合体协议书", "P03": "资格条件满足", "P04": "唯一投标报价", "P05": "报价未超最高限价且不低于成本", "P06": "实质性要求响应",
    "P07": "无串标、弄虚作假、行贿行为", "P08": "投标保证金", "P09": "技术暗标无身份泄露", "P10": "技术暗标格式合规", "P11": "★号关键参数零负偏离", "P12": "工期与质量承诺响应",
}
STARRED_INDUSTRIES = ["material_equipment", "new_energy"]
