"""Queries over every document as a Chinese tender or bid: sentences by the document's id, then its own text.

The tables hold no Chinese, so each document is given one of a few texts with numbers of its own; the SQL reads the same
lists.  Every row of documents takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.operators import clauses, evidence, precheck, retrieval, rules
from procurelake.packs import lexicons as L
from procurelake.packs.rules import FAIRNESS, INDUSTRIES, PRECHECKS
from procurelake.queries import core, oracle
from procurelake.queries.core import _docs
from procurelake.queries.paths import _by, _finding_select, _layout_parts, _matched, _pick, _scopes_sql, _templates_sql, layout_facts, scoped

TENDERS = [t for _, t in core.TENDERS]
DRAFTS = [d[1] for d in core.DRAFTS]
CONTROLS, DAYS, DRAFT_INDUSTRIES = [9e6, None, 2e7, 2e6, 100.0], [120, None, 90, 180, 10], ["construction", "", "new_energy", "新能源", None]
SECTIONS = [t for _, t in core.SECTIONS] + ["占位＊＊＊＊＊＊两处＊＊＊＊＊＊，水位 35 m 以下。坝高 35 m 左右的坝体。"]
CITED = ["SL 303-2017 水利水电工程施工组织设计规范 防洪标准 20 年", "GB 50300", "坝高 35 m"]
MORE = ["混凝土设计强度等级为 C30，抗渗等级 W8，缺陷责任期 24 个月", "水利水电施工总承包一级，一级建造师（水利），质量保证金 3 %", "技术标 40 分，商务标 20 分，价格分 40 分"]
CHECKED = ["本工程工期为 180 日历天，保证金 20 万元，缺陷责任期 24 个月。养护 180 天。", "工期 180 天，保证金 200 万元", "没有数量"]
EXPECTED = ["工期 180 日历天", "投标保证金 20 万元", "无数字", "缺陷责任期 24 个月"]


def _id() -> Column:
    return F.col("doc_id")


def numbered(texts: list[str]) -> Column:
    """The document's text of the list, with its own number of days and its own sum."""
    days, sum_ = (_id() % 400).cast("string"), F.concat((_id() % 97).cast("string"), F.lit(" 万元"))
    return F.replace(F.replace(_by(texts, "string"), F.lit("180"), days), F.lit("20 万元"), sum_)


def with_own(texts: list[str]) -> Column:
    return F.concat(numbered(texts), F.lit("\n"), F.coalesce("text", F.lit("")))


def _numbered(texts: list[str]) -> str:
    return f"replace(replace({_pick(texts)}, '180', (doc_id % 400)::varchar), '20 万元', (doc_id % 97) || ' 万元')"


def _with_own(texts: list[str], name: str = "text") -> str:
    return f"(select doc_id, {_numbered(texts)} || chr(10) || coalesce(text, '') {name} from documents)"


def _tenders(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", with_own(TENDERS).alias("text"))


def constraint_params(spark: SparkSession, sf: str) -> DataFrame:
    """Weights, duration and amounts of every document's tender."""
    got = clauses.constraint_params(_tenders(spark, sf))
    money = lambda c: F.array_join(F.transform(c, lambda a: F.format_string("%.2f", a["value_yuan"])), "|")
    return got.select("doc_id", *[F.coalesce(F.col("weights")[k], F.lit("")).alias(f"w{i}") for i, k in enumerate(L.WEIGHTS)], "duration_days", money("bid_bond").alias("bond"), money("control_price").alias("control"))


def clause_match_cn(spark: SparkSession, sf: str) -> DataFrame:
    """The four standing lists over every document's tender."""
    return clauses.clause_match(_tenders(spark, sf)).select("doc_id", "list_name", F.col("sent_no").cast("long").alias("sent_no"), "sentence", F.array_join("matched", "|").alias("matched"))


def fairness_cn(spark: SparkSession, sf: str) -> DataFrame:
    """The standing fairness rules over every document's tender."""
    return clauses.fairness_hits(_tenders(spark, sf)).select("doc_id", "rule_id", "type", "category", F.col("sent_no").cast("long").alias("sent_no"), F.array_join("matched", "|").alias("matched"))


def industry_detect(spark: SparkSession, sf: str) -> DataFrame:
    """The standing industries over every document's tender."""
    return clauses.detect_industry(_tenders(spark, sf)).select("doc_id", "name", "pack_key", "confidence", F.array_join("matched_keywords", "|").alias("matched"))


def extract_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve facts of every document, from two requirements each."""
    docs = _docs(spark, sf)
    first = docs.select(_id().alias("project_id"), F.lit(0).alias("ord"), with_own(TENDERS).alias("content"))
    reqs = first.unionByName(docs.select(_id().alias("project_id"), F.lit(1).alias("ord"), _by(MORE, "string").alias("content")))
    return evidence.extract_facts(reqs).select("project_id", F.explode("facts").alias("fact_key", "value"))


FACTS_SOURCE = f"(select doc_id project_id, 0 ord, text as content from {_with_own(TENDERS)} union all select doc_id, 1, {_pick(MORE)} from documents)"


def facts_check(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities of every document's text against two facts of its own."""
    docs = _docs(spark, sf)
    texts = docs.select("doc_id", F.concat(numbered(CHECKED), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    fact = lambda key, shift: F.struct(F.lit(key).alias("fact_key"), F.replace(F.get(F.array(*map(F.lit, EXPECTED)), ((_id() + shift) % len(EXPECTED)).cast("int")), F.lit("180"), (_id() % 400).cast("string")).alias("expected"))
    facts = docs.select("doc_id", F.inline(F.array(fact("a", 0), fact("b", 1))))
    return evidence.check_facts(texts, facts).select("doc_id", "fact_key", "expected", "found_in_text", "verdict")


def _facts_check_sql() -> str:
    listed = "[" + ", ".join(map(oracle._q, EXPECTED)) + "]"
    facts = " union all ".join(f"select doc_id, '{k}' fact_key, replace(({listed})[(doc_id + {i}) % {len(EXPECTED)} + 1], '180', (doc_id % 400)::varchar) expected from documents" for i, k in enumerate("ab"))
    return oracle._facts_check(f"({facts})", _with_own(CHECKED), "doc_id, ")


def precheck_items(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve checks of every document's draft, with item and prices."""
    drafts = _docs(spark, sf).select("doc_id", F.concat(_by(DRAFTS, "string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("draft_text"), _by(CONTROLS, "double").alias("control"), _by(DAYS, "int").alias("days"), _by(DRAFT_INDUSTRIES, "string").alias("industry"))
    got = precheck.precheck(drafts, control_col="control", days_col="days", industry_col="industry")
    return got.select("doc_id", "code", "item", "status", F.when(F.col("code") != "P04", F.col("detail")).otherwise(F.size(F.split("detail", "/")).cast("string")).alias("detail"))


def _precheck_sql() -> str:
    t = "draft_text"
    sign, seal = oracle._any(t, "签字", "签署", "签章"), oracle._any(t, "盖章", "公章", "印鉴")
    detail = {
        "P01": f"concat_ws('/', case when {sign} then '签字' end, case when {seal} then '盖章' end)", "P04": "greatest(1, len(list_distinct(prices)))::varchar",
        "P05": "coalesce(array_to_string(list_transform(prices, lambda p: case when p >= 1e7 then format('{:.1f}E7', p / 1e7) else p::varchar end), '/'), '')", "P12": "coalesce(said::varchar, '')",
    }
    extra = {c: f", {oracle._q(item)} item, {detail.get(c, chr(39) * 2)} detail" for c, item in PRECHECKS.items()}
    source = f"(select doc_id, {_pick(DRAFTS)} || chr(10) || coalesce(text, '') draft_text, ({_pick(CONTROLS)})::double control, ({_pick(DAYS)})::int as days, {_pick(DRAFT_INDUSTRIES)} industry from documents)"
    return oracle._statuses(source, extra)


def _sections(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every document's section, and a citation of its own."""
    docs = _docs(spark, sf)
    sections = docs.select(_id().alias("section_id"), F.concat(_by(SECTIONS, "string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    cites = docs.select(_id().alias("section_id"), F.lit("").alias("source"), F.get(F.array(*map(F.lit, CITED)), (F.floor(_id() / 3) % len(CITED)).cast("int")).alias("content"))
    return sections, cites


def _sections_sql() -> tuple[str, str]:
    listed = "[" + ", ".join(map(oracle._q, CITED)) + "]"
    sections = f"(select doc_id section_id, {_pick(SECTIONS)} || chr(10) || coalesce(text, '') as text from documents)"
    return sections, f"(select doc_id section_id, '' source, ({listed})[(doc_id // 3) % {len(CITED)} + 1] as content from documents)"


def fact_check_cn(spark: SparkSession, sf: str) -> DataFrame:
    """Statements, citations and placeholders of every document's section, counted."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return evidence.fact_summary(*_sections(spark, sf)).select("section_id", *[long(c) for c in ("total_sentences", "factual_sentences", "cited", "uncited", "placeholder_count")])


def _fact_check_sql() -> str:
    sections, cites = _sections_sql()
    return f"""with {oracle._cited(sections, cites)}, n as (select section_id, len(regexp_extract_all(text, {oracle._q(L.PLACEHOLDER)}))::bigint placeholder_count from {sections})
select x.section_id, len(x.l)::bigint total_sentences, count(c.s) factual_sentences, count(c.s) filter (c.cited) cited, count(c.s) filter (not c.cited) uncited, placeholder_count from x join n using (section_id) left join c using (section_id) group by x.section_id, x.l, placeholder_count"""


def kb_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """A knowledge pack of every document, as documents of its entries."""
    entry = lambda title, tags: F.struct(title.alias("title"), F.substring("text", 1, 40).alias("content"), tags.alias("tags"))
    none = F.lit(None).cast("array<struct<title:string,content:string,tags:array<string>>>")
    packs = _docs(spark, sf).select(
        F.concat(F.lit("k"), _id().cast("string")).alias("pack_key"), F.col("source").alias("name"), F.when(_id() % 2 == 0, F.col("lang")).alias("overview"),
        F.array(entry(F.col("lang"), F.array("source")), entry(F.lit("第二"), F.lit(None).cast("array<string>"))).alias("outline"),
        F.when(_id() % 3 == 0, F.array(entry(F.lit("工法"), F.array().cast("array<string>")))).otherwise(none).alias("methods"), none.alias("risks"),
    )
    return retrieval.flatten_pack(packs).select("doc_id", "kind", "title", F.array_join("tags", "|").alias("tags"), "content")


FLAT_SQL = """with p as (select 'k' || doc_id k, source, lang, doc_id, substr(text, 1, 40) c from documents)
select k || '/overview' doc_id, 'overview' kind, source title, k tags, case when doc_id % 2 = 0 then coalesce(lang, '') else '' end as content from p
union all select k || '/outline/0', 'outline', lang, concat_ws('|', k, 'outline', source), c from p
union all select k || '/outline/1', 'outline', '第二', k || '|outline', c from p
union all select k || '/methods/0', 'methods', '工法', k || '|methods', c from p where doc_id % 3 = 0"""


def findings_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of every document in the order of a report."""
    found = rules.validate(layout_facts(_docs(spark, sf)), core.date(2025, 1, 1), industry="工程")[0]
    return rules.ranked_findings(found).select("doc_id", F.col("no").cast("long").alias("no"), "rule_id", "severity")


def _ranked_sql() -> str:
    d, common, every = _layout_parts()
    parts = [_finding_select("''", p) for p in common + every["hebei-provincial-v3"]]
    order = "case severity when 'REJECT' then 0 when 'WARN' then 1 when 'INFO' then 2 else 9 end"
    return f"with {d}, x as ({' union all '.join(parts)}) select doc_id, row_number() over (partition by doc_id order by {order}, rule_id) as no, rule_id, severity from x"


def compliance_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against every benchmark item of its remainder by 31, with the first two pending ones to judge."""
    docs = _docs(spark, sf).select(_id().alias("project_id"), F.col("text").alias("draft"))
    asked = core.table(spark, sf, "benchmark").select((F.col("item_id") % 31).alias("k"), F.col("item_id").alias("req_id"), F.split("text", " ").alias("keywords"))
    reqs = docs.select("project_id", (F.col("project_id") % 31).alias("k")).join(asked, "k").drop("k")
    return evidence.check_compliance(reqs, docs, most_pending=2).select("project_id", "req_id", "status", F.col("n_hit").cast("long").alias("n_hit"), "to_judge")


CAPPED_SQL = """with r as (select doc_id project_id, item_id req_id, string_split(b.text, ' ') k, lower(coalesce(d.text, '')) draft from documents d join benchmark b on d.doc_id % 31 = b.item_id % 31),
h as (select project_id, req_id, len(k) n, len(list_filter(k, lambda w: contains(draft, lower(w)))) n_hit from r),
s as (select *, case when n > 0 and n_hit >= greatest(1, n // 2) then '完全响应' else '缺失' end status from h)
select project_id, req_id, status, n_hit::bigint n_hit, status = '缺失' and row_number() over (partition by project_id, status order by req_id) <= 2 as to_judge from s"""



def template_match(spark: SparkSession, sf: str) -> DataFrame:
    """The standing template of every document's own scope and date."""
    requests = scoped(_docs(spark, sf)).select(_id().alias("req_id"), "region", "city", "industry", "tender_type", "as_of")
    return rules.match_template(requests, rules.template_frame(spark))


def fact_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every statement of every document's section, cited or not."""
    got = evidence.fact_check(*_sections(spark, sf))
    return got.select("section_id", F.col("index").cast("long").alias("index"), "has_number", "cited", "status")


def geometry_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on the layout of every document under the provincial template."""
    verdict = rules.validate(layout_facts(_docs(spark, sf)), core.date(2025, 1, 1), industry="工程")[1]
    long = lambda c: F.col(c).cast("long").alias(c)
    return verdict.select("doc_id", "verdict", "score", *[long(c) for c in ("rule_count", "checked", "skipped", "reject", "warn", "info", "rules_triggered")])


def _geometry_sql() -> str:
    d, common, every = _layout_parts()
    parts = [_finding_select("''", p) for p in common + every["hebei-provincial-v3"]]
    total = len(rules.effective_rules(rules.choose_template(core.date(2025, 1, 1), industry="工程")))
    return f"""with {d}, x as ({" union all ".join(parts)}), n as (select doc_id, count(*) filter (severity = 'REJECT') reject, count(*) filter (severity = 'WARN') warn, count(distinct rule_id) rules_triggered from x group by 1)
select doc_id, case when reject > 0 then 'REJECT' else 'WARN' end verdict, greatest(0, 100 - least(15 * reject, 60) - least(3 * warn, 30))::double score, {total}::bigint rule_count, {total}::bigint checked, 0::bigint skipped, reject, warn, 0::bigint info, rules_triggered from n"""


# Names under which the core module has the same checks over a few inline rows, for its tests; registered is the one over all documents.
QUERIES = {
    "constraint_params": constraint_params, "clause_match_cn": clause_match_cn, "fairness_cn": fairness_cn, "industry_detect": industry_detect, "extract_facts": extract_facts, "facts_check": facts_check,
    "precheck_items": precheck_items, "fact_check": fact_check, "fact_check_cn": fact_check_cn, "kb_flatten": kb_flatten, "template_match": template_match, "geometry_verdict": geometry_verdict,
    "findings_ranked": findings_ranked, "compliance_capped": compliance_capped,
}
ORACLE_SQL = {
    "constraint_params": oracle._params(_with_own(TENDERS)),
    "clause_match_cn": oracle._clauses(_with_own(TENDERS), L.CLAUSES, "s sentence"),
    "fairness_cn": oracle._fair(_with_own(TENDERS), FAIRNESS, "select doc_id, rule_id, type, category, sent_no, array_to_string(w, '|') matched from h"),
    "industry_detect": oracle._industry(_with_own(TENDERS), INDUSTRIES),
    "extract_facts": oracle._extract_facts(FACTS_SOURCE),
    "facts_check": _facts_check_sql(),
    "precheck_items": _precheck_sql(),
    "fact_check": f"with {oracle._cited(*_sections_sql())} select section_id, (i - 1)::bigint as index, has_number, cited, case when cited then '已引用' else '待人工补充' end status from c",
    "fact_check_cn": _fact_check_sql(),
    "kb_flatten": FLAT_SQL,
    "template_match": f"with {_matched(_templates_sql(), _scopes_sql())} select q.req_id, b.template_id, b.score::double score from q left join b on b.req_id = q.req_id and r = 1",
    "geometry_verdict": _geometry_sql(),
    "findings_ranked": _ranked_sql(),
    "compliance_capped": CAPPED_SQL,
}
