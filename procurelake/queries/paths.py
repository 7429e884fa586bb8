"""Queries that take operators through their whole path over the driver's tables, each with its SQL."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.functions.text import clip
from procurelake.operators import evidence, pii, retrieval, rules, search
from procurelake.packs.rules import DISCLOSURE, TEMPLATES, Rule, Template
from procurelake.plans.requirements import extract_requirements
from procurelake.queries import oracle
from procurelake.queries.core import _docs, compliance
from procurelake.sources import sinks
from procurelake.sources.docx import facts
from procurelake.sources.tables import json_list, table
from procurelake.storage import Scratch

# Facts that documents are given by the remainder of their id; the SQL reads the same lists.
CREATORS, EDITORS, COMPANIES = ["author", "Bob", "", None], ["USER", "Ann"], ["", "ACME", None]
SPACES, FONTS = ["gray", "rgb", "unknown", None, "cmyk"], [["宋体"], ["SimSun", "楷体", "楷体"], [], ["Arial", ""]]
SIZES, COLORS = [[14.0], [12.0, 12.0, 16.0], []], [["000000"], ["auto", "FF0000"], [""], ["AUTO", "00FF00"]]
LINES = [("exact", 30.0, None), (None, None, 1.5), ("auto", None, 1.2), ("atLeast", 18.0, None), ("exact", 30.4, None)]
INDENTS, ALIGNS, TOPS = [2.0, 0.0, None, 2.25, -1.0], ["justify", "left", None], [2.5, 3.0, None]
HEADING = ("Heading1", "黑体", 22.0)


def _by(values: list, kind: str) -> Column:
    """The value of the list that the remainder of doc_id points at."""
    made = [F.array(*map(F.lit, v)).cast(kind) if isinstance(v, list) else F.lit(v).cast(kind) for v in values]
    return F.get(F.array(*made), (F.col("doc_id") % len(values)).cast("int"))


def layout_facts(docs: DataFrame) -> DataFrame:
    """Facts of an OOXML file for every document: a heading, one paragraph, two images, and the rest by its id."""
    d = F.col("doc_id")
    whole = lambda c: c.cast("int")
    heading = F.struct(
        F.lit(0).alias("index"), F.lit("t").alias("text"), F.lit(HEADING[0]).alias("style"), F.lit(True).alias("is_heading"), F.array(F.lit(HEADING[1])).alias("fonts_eastAsia"), F.array(F.lit(HEADING[2])).alias("sizes_pt"), F.array(F.lit("000000")).alias("colors"),
        F.lit("exact").alias("line_rule"), F.lit(30.0).alias("line_spacing_pt"), F.lit(None).cast("double").alias("line_multiple"), F.lit(None).cast("double").alias("first_line_indent_chars"), F.lit("center").alias("alignment"), F.lit(0.0).alias("space_before_pt"), F.lit(0.0).alias("space_after_pt"),
    )
    rule, points, multiple = zip(*LINES, strict=True)
    body = F.struct(
        F.lit(1).alias("index"), F.when(d % 11 == 0, " ").otherwise("x").alias("text"), F.lit(None).cast("string").alias("style"), F.lit(False).alias("is_heading"), _by(FONTS, "array<string>").alias("fonts_eastAsia"), _by(SIZES, "array<double>").alias("sizes_pt"), _by(COLORS, "array<string>").alias("colors"),
        _by(list(rule), "string").alias("line_rule"), _by(list(points), "double").alias("line_spacing_pt"), _by(list(multiple), "double").alias("line_multiple"), _by(INDENTS, "double").alias("first_line_indent_chars"), _by(ALIGNS, "string").alias("alignment"),
        (d % 2 * 6).cast("double").alias("space_before_pt"), (d % 7).cast("double").alias("space_after_pt"),
    )
    margins = F.struct(_by(TOPS, "double").alias("top_cm"), F.lit(2.0).alias("bottom_cm"), (2 + d % 2 / 2).alias("left_cm"), F.lit(2.0).alias("right_cm"))
    none = F.lit(None).cast("double")
    doc = F.struct(
        margins.alias("margins_cm"), none.alias("page_width_cm"), none.alias("page_height_cm"), whole(d % 2).alias("header_count"), F.lit(0).alias("footer_count"), whole(d % 2).alias("headers_footers"), whole(F.when(d % 5 == 0, 1).otherwise(0)).alias("watermark"),
        whole(d % 140).alias("page_count"), F.lit("estimated").alias("page_count_source"), (d % 3 == 0).alias("page_count_estimated"),
    )
    image = lambda name, exif, space: F.struct(F.lit(name).alias("name"), exif.alias("has_exif"), space.alias("color_space"))
    return docs.select(
        "doc_id",
        F.struct(_by(CREATORS, "string").alias("creator"), _by(EDITORS, "string").alias("lastModifiedBy"), _by(COMPANIES, "string").alias("company")).alias("metadata"),
        F.struct(whole(d % 3).alias("revisions"), whole(d % 2).alias("comments"), whole(F.when(d % 5 == 0, 2).otherwise(0)).alias("hidden_text"), whole(d % 4).alias("rsid_count")).alias("marks"),
        F.array(image("a", d % 2 == 0, _by(SPACES, "string")), image("b", F.lit(None).cast("boolean"), F.lit("rgb"))).alias("images"),
        F.array(heading, body).alias("paragraphs"),
        doc.alias("doc"),
    )


def layout_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of every document under two templates, by all detectors but that of texts."""
    given = layout_facts(_docs(spark, sf))
    found = None
    for name, scope in (("provincial", {}), ("city", {"city": "保定市"})):
        rows = rules.validate(given, date(2025, 1, 1), industry="工程", **scope)[0].withColumn("template", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found.select("template", "doc_id", "rule_id", "category", "severity", F.col("n").cast("long").alias("n"), "actual")


def _pick(values: list) -> str:
    lit = lambda v: "[" + ", ".join(map(oracle._q, v)) + "]" if isinstance(v, list) else oracle._q(v)
    return f"([{', '.join(map(lit, values))}])[doc_id % {len(values)} + 1]"


#: What the layout rules of a template are, for the SQL: size, top margin, other margins, exact spacing, severity of margins and of pages, indent, alignment.
LAYOUTS = {
    "hebei-provincial-v3": (14, 2.5, 2.0, True, "REJECT", "REJECT", True, True),
    "hebei-baoding-v2": (12, 2.5, 2.5, False, "REJECT", "WARN", True, False),
    "hebei-transport-2026": (14, 2.5, 2.5, False, "WARN", "REJECT", False, False),
    "hebei-zhangjiakou-v2": (14, 2.5, 2.0, False, "REJECT", None, True, False),
}


def _layout_parts() -> tuple[str, list[tuple], dict[str, list[tuple]]]:
    """The documents' facts as a step of SQL, and (rule_id, category, severity, n, actual, condition) of common and templates' findings."""
    shown = "coalesce(rule, 'null') || '/' || coalesce(pt::varchar, 'null') || '/' || coalesce(multiple::varchar, 'null')"
    distinct = "array_to_string(list_transform(list_filter({l}, lambda v, i: list_position({l}, v) = i), lambda v: v::varchar), '/')"
    rule, points, multiple = (_pick([x[i] for x in LINES]) for i in range(3))
    names = {"creator": _pick(CREATORS), "editor": _pick(EDITORS), "company": _pick(COMPANIES), "space": _pick(SPACES), "fonts": f"{_pick(FONTS)}::varchar[]", "sizes": f"{_pick(SIZES)}::double[]", "colors": f"{_pick(COLORS)}::varchar[]", "rule": rule, "pt": f"({points})::double", "multiple": f"({multiple})::double", "indent": f"({_pick(INDENTS)})::double", "align": _pick(ALIGNS), "top": f"({_pick(TOPS)})::double"}
    d = "d as (select doc_id, " + ", ".join(f"{v} {k}" for k, v in names.items()) + ", doc_id % 11 <> 0 written, (doc_id % 2 * 6)::double before, (doc_id % 7)::double after, 2 + doc_id % 2 / 2.0 lft, doc_id % 140 pages, doc_id % 3 = 0 unsure from documents)"
    common = [
        ("META.CREATOR", "METADATA", "REJECT", "1", "creator", "lower(creator) not in ('', 'author', 'user')"), ("META.LAST_MODIFIED_BY", "METADATA", "REJECT", "1", "editor", "lower(editor) not in ('', 'author', 'user')"), ("META.COMPANY", "METADATA", "REJECT", "1", "company", "company <> ''"),
        ("META.REVISIONS", "METADATA", "REJECT", "doc_id % 3", "doc_id % 3", "doc_id % 3 > 0"), ("META.COMMENTS", "METADATA", "REJECT", "1", "1", "doc_id % 2 > 0"), ("META.HIDDEN_TEXT", "METADATA", "REJECT", "2", "2", "doc_id % 5 = 0"), ("META.RSID", "METADATA", "WARN", "doc_id % 4", "doc_id % 4", "doc_id % 4 > 0"),
        ("IMG.EXIF", "METADATA", "REJECT", "1", "1", "doc_id % 2 = 0"), ("IMG.COLOR", "FORMAT", "WARN", "1 + (coalesce(space, '') not in ('gray', 'unknown'))::int", "1 + (coalesce(space, '') not in ('gray', 'unknown'))::int", "true"),
    ]
    fonts, colors = "list_filter(fonts, lambda v: v not in ('', '宋体', 'SimSun'))", "list_filter(colors, lambda v: lower(v) not in ('000000', 'auto', ''))"
    every = {}
    for template, (size, tops, others, exact, margins, pages, indent, align) in LAYOUTS.items():
        sizes = f"list_filter(sizes, lambda v: abs(v - {size}) > 0.01)"
        sides = f"list_filter([case when top is null or abs(top - {tops}) > 0.05 then 'top_cm=' || coalesce(top::varchar, 'null') end, case when abs(2.0 - {others}) > 0.05 then 'bottom_cm=2.0' end, case when abs(lft - {others}) > 0.05 then 'left_cm=' || lft::double end, case when abs(2.0 - {others}) > 0.05 then 'right_cm=2.0' end], lambda v: v is not null)"
        own = [
            ("FONT.FAMILY.BODY", "FORMAT", "REJECT", f"len({fonts})", distinct.format(l=fonts), f"len({fonts}) > 0"), ("FONT.FAMILY.BODY", "FORMAT", "WARN", "0", "'未显式设置'", "len(fonts) = 0"),
            ("FONT.SIZE.BODY", "FORMAT", "REJECT", f"len({sizes})", distinct.format(l=sizes), f"len({sizes}) > 0"), ("FONT.SIZE.BODY", "FORMAT", "WARN", "0", "'未显式设置'", "len(sizes) = 0"),
            ("FONT.COLOR", "FORMAT", "REJECT", f"len({colors})", distinct.format(l=colors), f"len({colors}) > 0"),
            ("PAGE.MARGIN", "FORMAT", margins, f"len({sides})", f"array_to_string({sides}, ' / ')", f"len({sides}) > 0"),
            ("DOC.NO_HEADER_FOOTER", "DISCLOSURE", "REJECT", "1", "1", "doc_id % 2 > 0"), ("DOC.NO_WATERMARK", "DISCLOSURE", "REJECT", "1", "1", "doc_id % 5 = 0"),
        ]
        if indent:
            own.append(("PARA.FIRST_LINE_INDENT", "FORMAT", "WARN", "1", "indent", "written and abs(indent - 2) > 0.3"))
        if exact:
            ok = "coalesce(rule = 'exact' and abs(pt - 30) <= 0.5, false)"
            own.append(("PARA.LINE_SPACING", "FORMAT", "REJECT", "1", shown, f"written and not {ok}"))
        else:
            bad = "(written and not coalesce(coalesce(rule, 'auto') = 'auto' and abs(multiple - 1.5) <= 0.02, false))"
            own.append(("PARA.LINE_SPACING", "FORMAT", "REJECT", f"1 + {bad}::int", f"'exact/30.0/null' || case when {bad} and {shown} <> 'exact/30.0/null' then '/' || {shown} else '' end", "true"))
        if align:
            own += [("PARA.ALIGN", "FORMAT", "WARN", "1", "align", "written and align <> 'justify'"), ("PARA.SPACING", "FORMAT", "WARN", "1", "1", "written and (before > 0.5 or after > 0.5)")]
        if pages:
            own.append(("DOC.PAGE_COUNT", "STRUCTURE", f"case when unsure and pages <= 125 then 'WARN' else '{pages}' end", "pages", "pages", "pages > 100"))
        every[template] = own
    return d, common, every


def _finding_select(template: str, part: tuple, extra: str = "true", source: str = "d") -> str:
    rule_id, category, severity, n, actual, where = part
    severity = severity if " " in severity else f"'{severity}'"
    return f"select {template} as template, doc_id, '{rule_id}' rule_id, '{category}' category, {severity} severity, ({n})::bigint n, ({actual})::varchar actual from {source} where ({where}) and {extra}"


def _layout_sql() -> str:
    d, common, every = _layout_parts()
    parts = [_finding_select(f"'{name}'", p) for name, key in (("provincial", "hebei-provincial-v3"), ("city", "hebei-baoding-v2")) for p in common + every[key]]
    return f"with {d} " + " union all ".join(parts)


# Scopes that documents are given by the remainder of their id.
SCOPE_REGIONS, SCOPE_CITIES = ["河北省", None, "河北省", "山西省", "河北省"], ["", "保定市", "承德市", None, "廊坊市", "石家庄市"]
SCOPE_INDUSTRIES, SCOPE_TYPES, SCOPE_DATES = ["工程", "房建", "公路", "光伏"], ["工程", None, "货物", "工程", "工程", "工程", "工程"], ["2023-12-31", "2024-03-31", "2025-01-01", "2026-06-01", None, "2031-05-31", "2031-06-01"]


def scoped(docs: DataFrame) -> DataFrame:
    """``docs`` with a region, city, industry, type and date of their own."""
    return docs.withColumns({"region": _by(SCOPE_REGIONS, "string"), "city": _by(SCOPE_CITIES, "string"), "industry": _by(SCOPE_INDUSTRIES, "string"), "tender_type": _by(SCOPE_TYPES, "string"), "as_of": F.get(F.array(*[F.lit(x).cast("date") for x in SCOPE_DATES]), F.floor(F.col("doc_id") / 4).cast("int") % len(SCOPE_DATES))})


def rules_each(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of every document under the template of its own region, city, industry, type and date."""
    found, _, chosen = rules.validate_each(scoped(layout_facts(_docs(spark, sf))))
    told = found.join(chosen.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"))
    return told.select(F.coalesce("template_id", F.lit("")).alias("template"), "doc_id", "rule_id", "category", "severity", F.col("n").cast("long").alias("n"), "actual")


def verdict_each(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts over texts and layout under each document's own template."""
    given = scoped(layout_facts(_docs(spark, sf))).withColumn("text", F.lit("我公司专利，电话13900001111")).drop("paragraphs")
    verdict = rules.validate_each(given)[1]
    long = lambda c: F.col(c).cast("long").alias(c)
    return verdict.select("doc_id", "verdict", "score", *[long(c) for c in ("rule_count", "checked", "skipped", "reject", "warn", "rules_triggered")])


def _matched(templates: str, requests: str) -> str:
    """(req_id, template_id, score) by the definition: ``templates`` t and ``requests`` q are steps of SQL."""
    scope = lambda s, v: f"(list_contains({s}, '*') or ({v} <> '' and list_contains({s}, {v})))"
    points = lambda s, n: f"case when list_contains({s}, '*') then 0 else {n} end"
    return f"""t as ({templates}), q as ({requests}),
m as (select req_id, template_id, lvl + case when f is not null then {oracle.DATED} else 0 end + {points('cities', oracle.MATCH_CITY)} + {points('industries', oracle.MATCH_INDUSTRY)} + {points('types', oracle.MATCH_TYPE)} score, f
      from q, t where t.region in ('*', coalesce(q.region, '河北省')) and as_of is not null and (f is null or f <= as_of) and (u is null or u >= as_of)
      and {scope('cities', 'city')} and {scope('industries', 'industry')} and {scope('types', "coalesce(tender_type, '工程')")}),
b as (select *, row_number() over (partition by req_id order by score desc, f desc nulls last, template_id) r from m)"""


def _templates_sql() -> str:
    rows = ", ".join(f"({oracle._q(t.id)}, {oracle._q(t.region)}, {oracle._list(t.city)}, {oracle._list(t.industry)}, {oracle._list(t.tender_type)}, {oracle.LEVELS[t.level] / 10}::double, {oracle._q(t.effective_from)}::date, {oracle._q(t.effective_to)}::date)" for t in rules.active(TEMPLATES) if t.id != oracle.COMMON_ID and t.status == "ACTIVE")
    return f"select * from (values {rows}) v(template_id, region, cities, industries, types, lvl, f, u)"


def _scopes_sql() -> str:
    picked = ", ".join(f"{_pick(v)} {k}" for k, v in (("region", SCOPE_REGIONS), ("city", SCOPE_CITIES), ("industry", SCOPE_INDUSTRIES), ("tender_type", SCOPE_TYPES)))
    dates = ", ".join(f"{oracle._q(x)}::date" for x in SCOPE_DATES)
    return f"select doc_id req_id, {picked}, ([{dates}])[(doc_id // 4) % {len(SCOPE_DATES)} + 1] as_of from documents"


def _rules_each_sql() -> str:
    d, common, every = _layout_parts()
    parts = [_finding_select("coalesce(template_id, '')", p, source="c") for p in common]
    parts += [_finding_select("template_id", p, f"template_id = '{key}'", "c") for key, own in every.items() for p in own]
    return f"with {d}, {_matched(_templates_sql(), _scopes_sql())}, c as (select d.*, b.template_id from d left join b on b.req_id = d.doc_id and r = 1) " + " union all ".join(parts)


def _verdict_each_sql() -> str:
    d, common, every = _layout_parts()
    out = ["DOC.NO_HEADER_FOOTER", "DOC.NO_WATERMARK", "PAGE.MARGIN", "DOC.PAGE_COUNT"]
    parts = [_finding_select("template_id", p, source="c") for p in common]
    parts += [_finding_select("template_id", p, f"template_id = '{key}'", "c") for key, own in every.items() for p in own if p[0] in out]
    text = [("LEAK.MOBILE", "", "REJECT", "1", "''", "true"), ("DOC.NO_SPECIAL_METHOD", "", "REJECT", "1", "''", "template_id = 'hebei-transport-2026'")]
    parts += [_finding_select("template_id", p, source="c") for p in text]
    counts = ", ".join(f"('{t.id}', {len(rules.effective_rules(t))}, {sum(r.detect.startswith(('run.', 'paragraph.')) for r in t.rules)})" for t in TEMPLATES if t.id != oracle.COMMON_ID)
    return f"""with {d}, {_matched(_templates_sql(), _scopes_sql())}, c as (select d.*, b.template_id from d left join b on b.req_id = d.doc_id and r = 1),
x as ({" union all ".join(parts)}), n as (select doc_id, count(*) filter (severity = 'REJECT') reject, count(*) filter (severity = 'WARN') warn, count(distinct rule_id) rules_triggered from x group by 1),
k as (select * from (values {counts}) v(template_id, rule_count, skipped))
select n.doc_id, case when reject > 0 then 'REJECT' else 'WARN' end verdict, greatest(0, 100 - least(15 * reject, 60) - least(3 * warn, 30))::double score, coalesce(rule_count, {len(DISCLOSURE)})::bigint rule_count,
  (coalesce(rule_count, {len(DISCLOSURE)}) - coalesce(skipped, 0))::bigint checked, coalesce(skipped, 0)::bigint skipped, reject, warn, rules_triggered from n join c using (doc_id) left join k using (template_id)"""


def template_registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A template of every customer, and a request of every order."""
    key, n = F.col("c_custkey"), F.col("c_nationkey")
    star = lambda every, c: F.when(key % every == 0, F.array(F.lit("*"))).otherwise(F.array(c.cast("string"), F.lit("other")))
    start = F.date_add(F.lit("1992-01-01").cast("date"), (key * 37 % 2400).cast("int"))
    templates = table(spark, sf, "customer").select(
        F.concat(F.lit("t"), key.cast("string")).alias("template_id"), F.when(key % 50 == 0, "*").otherwise(F.concat(F.lit("n"), n.cast("string"))).alias("region"), star(2, key % 7).alias("city"), star(3, F.col("c_mktsegment")).alias("industry"),
        star(5, F.lit("工程")).alias("tender_type"), _level(key).alias("level"), F.when(key % 17 > 0, start).alias("effective_from"), F.when(key % 19 > 0, F.date_add(start, (key % 90).cast("int"))).alias("effective_to"), F.when(key % 13 == 0, "DRAFT").otherwise("ACTIVE").alias("status"),
    )
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == key)
    requests = orders.select(F.col("o_orderkey").alias("req_id"), F.concat(F.lit("n"), n.cast("string")).alias("region"), (F.col("o_orderkey") % 7).cast("string").alias("city"), F.col("c_mktsegment").alias("industry"), F.when(F.col("o_orderkey") % 2 == 0, "工程").alias("tender_type"), F.col("o_orderdate").cast("date").alias("as_of"))
    return requests, templates


def _level(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, oracle.LEVELS)), (key % len(oracle.LEVELS) + 1).cast("int"))


def template_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The template in force for every order, from a registry that grows with the customers."""
    return rules.match_template(*template_registry(spark, sf))


def _orders_sql() -> str:
    star = lambda every, c: f"case when c_custkey % {every} = 0 then ['*'] else [{c}, 'other'] end"
    start = "date '1992-01-01' + (c_custkey * 37 % 2400)::int"
    levels = ", ".join(f"{v / 10}::double" for v in oracle.LEVELS.values())
    templates = f"""select 't' || c_custkey template_id, case when c_custkey % 50 = 0 then '*' else 'n' || c_nationkey end region, {star(2, '(c_custkey % 7)::varchar')} cities, {star(3, 'c_mktsegment')} industries, {star(5, "'工程'")} types,
([{levels}])[c_custkey % {len(oracle.LEVELS)} + 1] lvl, case when c_custkey % 17 > 0 then {start} end f, case when c_custkey % 19 > 0 then {start} + (c_custkey % 90)::int end u from customer where c_custkey % 13 > 0"""
    requests = "select o_orderkey req_id, 'n' || c_nationkey region, (o_orderkey % 7)::varchar city, c_mktsegment industry, case when o_orderkey % 2 = 0 then '工程' end tender_type, o_orderdate::date as_of from orders join customer on o_custkey = c_custkey"
    return f"with {_matched(templates, requests)} select q.req_id, b.template_id, b.score::double score from q left join b on b.req_id = q.req_id and r = 1"


def docx_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as an OOXML file with all parts, and its facts read back."""
    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("markdown"), F.lit("t").alias("title"), F.col("source").alias("who"), F.col("lang").alias("head"), F.when(F.col("doc_id") % 2 == 0, "foot").alias("foot"))
    got = facts(sinks.render(rows, author_col="who", header_col="head", footer_col="foot"), content_col="docx")
    return got.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("paragraphs").cast("long").alias("n_paragraphs"), F.md5("text").alias("digest"), "metadata.creator", F.col("doc.header_count").cast("long").alias("headers"), F.col("doc.footer_count").cast("long").alias("footers"), "doc.margins_cm.top_cm", "doc.page_count_source"
    )


_MARKED = r"regexp_replace(l, '\*\*(.+?)\*\*|\*(.+?)\*', '\1\2', 'g')"
DOCX_SQL = f"""with x as (select *, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: case when trim(l, ' ' || chr(9) || chr(13)) = '' then '' else {_MARKED} end) p from documents)
select doc_id, len(p)::bigint n_paragraphs, md5(replace(replace(replace(array_to_string(p, chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) digest, coalesce(source, '') creator,
       (coalesce(lang, '') <> '')::bigint headers, (doc_id % 2 = 0)::bigint footers, 2.5::double top_cm, 'estimated' page_count_source from x"""


def _heads(chunk: str) -> str:
    """In a model's place: a chunk's first sixty characters, and an entry that is too short."""
    return json.dumps([{"category": "资质门槛", "content": chunk[:60], "keywords": ["a"]}, {"category": "x", "content": "abc"}])


def requirements_extracted(spark: SparkSession, sf: str) -> DataFrame:
    tenders = _docs(spark, sf).select(F.col("doc_id").alias("tender_id"), "text")
    got = extract_requirements(tenders, _heads, most_chars=None)
    return got.select("tender_id", "id", F.col("source_chunk").cast("long").alias("source_chunk"), "category", F.md5("content").alias("digest"), "mandatory", F.array_join("keywords", "|").alias("keywords"))


def _extracted_sql() -> str:
    pieces = oracle._chunks().rsplit("\nselect", 1)[0]
    return f"""{pieces}, h as (select doc_id, chunk_no, {oracle._trim("substr(text, pos + 1, least(60, e - pos))")} content from c where trim(text) <> ''), k as (select *, row_number() over (partition by doc_id, substr({oracle._bare("content")}, 1, 40) order by chunk_no) n from h where length(content) >= 4)
select doc_id tender_id, printf('R%03d', row_number() over (partition by doc_id order by chunk_no)) id, chunk_no source_chunk, '资质门槛' category, md5(content) digest, true mandatory, 'a' keywords from k where n = 1"""


def _flaky(chunk: str) -> str:
    """In a model's place: prose around the list, and no list for chunks that begin with a letter from N on."""
    if chunk[:1].upper() >= "N":
        return "I found nothing"
    return f"Sure, here it is: {_heads(chunk)} - anything else?"


def requirements_failed(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every document by what came of asking: requirements, or the failure that shows."""
    from procurelake.plans.requirements import ask_chunks, failed_chunks, requirements_of

    tenders = _docs(spark, sf).select(F.col("doc_id").alias("tender_id"), "text")
    asked = Scratch(spark, "asked").save(ask_chunks(tenders, _flaky, most_chars=None, attempts=2), "asked")
    kept = requirements_of(asked).groupBy("tender_id").agg(F.count("*").alias("n_requirements"))
    failed = failed_chunks(asked).groupBy("tender_id").agg(F.count("*").alias("n_failed"), F.max(F.col("attempts").cast("long")).alias("attempts"), F.max("error").alias("error"))
    n = asked.groupBy("tender_id").agg(F.count("*").alias("n_chunks"))
    return n.join(kept, "tender_id", "left").join(failed, "tender_id", "left").fillna(0, ["n_requirements", "n_failed"])


def _failed_sql() -> str:
    pieces = oracle._chunks().rsplit("\nselect", 1)[0]
    return f"""{pieces}, p as (select doc_id, chunk_no, substr(text, pos + 1, e - pos) piece from c where trim(text) <> ''), q as (select *, upper(substr(piece, 1, 1)) >= 'N' bad, {oracle._trim("substr(piece, 1, 60)")} content from p),
k as (select *, row_number() over (partition by doc_id, substr({oracle._bare("content")}, 1, 40) order by chunk_no) n from q where not bad and length(content) >= 4)
select q.doc_id tender_id, count(*) n_chunks, coalesce(any_value(r.n), 0)::bigint n_requirements, count(*) filter (bad) n_failed, case when count(*) filter (bad) > 0 then 2::bigint end attempts, case when count(*) filter (bad) > 0 then 'no list in the answer' end error
from q left join (select doc_id, count(*) n from k where n = 1 group by 1) r using (doc_id) group by q.doc_id"""


def chunk_sql(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_text`` as a table function that SQL calls."""
    retrieval.register_table_functions(spark)
    docs = _docs(spark, sf).select("doc_id", "text")
    return spark.sql("select doc_id, cast(c.chunk_no as long) chunk_no, cast(length(c.chunk) as long) len, md5(c.chunk) digest from {docs}, lateral chunk_text(text, 6000, 400) c", docs=docs)


def chunk_window(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every document by the rule that looks for empty lines within a window."""
    got = retrieval.chunk(_docs(spark, sf), window=True)
    return got.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("len"), F.md5("chunk").alias("digest"))


def _window_sql() -> str:
    seen = "substr(text, pos + 5201, 800)"
    line = f"case when pos + 6000 < length(text) and contains({seen}, chr(10) || chr(10)) then pos + 5200 + length({seen}) - instr(reverse({seen}), chr(10) || chr(10)) - 1 else least(pos + 6000, length(text)) end"
    return f"""with recursive c as (select doc_id, text, 0::bigint as chunk_no, 0::bigint as pos, ({line.replace("pos", "0")})::bigint as e from documents where length(text) > 0
union all select doc_id, text, chunk_no + 1, pos, ({line})::bigint from (select doc_id, text, chunk_no, greatest(e - 400, pos + 1) as pos from c where e < length(text)))
select doc_id, chunk_no, e - pos as len, md5(substr(text, pos + 1, e - pos)) digest from c"""


def fairness_docx(spark: SparkSession, sf: str) -> DataFrame:
    """Fairness of every document, written as an OOXML file and read back."""
    from procurelake.operators.clauses import fairness_hits
    from procurelake.queries.core import LATIN_FAIRNESS

    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("markdown"), F.lit("t").alias("title"))
    read = facts(sinks.render(rows), content_col="docx").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fairness_hits(read, LATIN_FAIRNESS).select("doc_id", "rule_id", F.col("sent_no").cast("long").alias("sent_no"), F.array_join("matched", "|").alias("matched"))


def _fairness_docx_sql() -> str:
    from procurelake.queries.core import LATIN_FAIRNESS

    lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: case when trim(l, ' ' || chr(9) || chr(13)) = '' then '' else {_MARKED} end)"
    source = f"(select doc_id, replace(replace(replace(array_to_string({lines}, chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as text from documents)"
    return oracle._fair(source, LATIN_FAIRNESS, "select doc_id, rule_id, sent_no, array_to_string(w, '|') matched from h")


#: Heads of image files: grey and coloured PNG, JPEG of three and four colours, and no image.
MEDIA = [b"\x89PNG\r\n\x1a\n" + bytes(17) + b"\x00", b"\x89PNG\r\n\x1a\n" + bytes(17) + b"\x02", b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x01\x00\x01\x03", b"\xff\xd8\xff\xc2\x00\x11\x08\x00\x01\x00\x01\x04", b"GIF89a"]


def docx_media(spark: SparkSession, sf: str) -> DataFrame:
    """Images and revision ids of every document's file, to which both were added."""
    import io
    import zipfile

    import pyarrow as pa

    from procurelake.functions.batches import pieces

    def add(batches):
        for b in pieces(batches):
            out = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("docx").to_pylist(), strict=True):
                i, made = int(path), io.BytesIO()
                with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(made, "w") as new:
                    for name in old.namelist():
                        new.writestr(name, old.read(name) if name != "word/settings.xml" else "<w:settings>" + "".join(f'<w:rsid w:val="{k % 4:08X}"/>' for k in range(i % 6)) + "</w:settings>")
                    for k in range(i % 3):
                        new.writestr(f"word/media/image{k}.bin", MEDIA[(i + k) % len(MEDIA)] + (b"Exif\x00" if i % 4 == 0 else b""))
                out.append(made.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], names=["path", "docx"])

    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("markdown"), F.lit("t").alias("title"))
    got = facts(sinks.render(rows).select("path", "docx").mapInArrow(add, "path string, docx binary"), content_col="docx")
    images = F.col("images")
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(images).cast("long").alias("n_images"), F.size(F.filter(images, lambda x: x["has_exif"])).cast("long").alias("n_exif"), F.array_join(F.transform(images, lambda x: x["color_space"]), "|").alias("spaces"), F.col("marks.rsid_count").cast("long").alias("n_rsid"))


MEDIA_SQL = """select doc_id, doc_id % 3 n_images, case when doc_id % 4 = 0 then doc_id % 3 else 0 end n_exif,
coalesce(array_to_string(list_transform(range(0, doc_id % 3), lambda k: (['gray', 'rgb', 'rgb', 'cmyk', 'unknown'])[(doc_id + k) % 5 + 1]), '|'), '') spaces, least(doc_id % 6, 4) n_rsid from documents"""


def score_places(spark: SparkSession, sf: str) -> DataFrame:
    """The table of every tender's bids in order, bids over the limit last."""
    from procurelake.operators import pricing
    from procurelake.queries.core import _bids_limited

    got = pricing.placed_scores(pricing.score_prices(_bids_limited(spark, sf), "REASONABLE_LOW", control_col="control"))
    return got.select("group_id", "bid_no", "price", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


PLACES_SQL = f"select group_id, bid_no, price, rank, row_number() over (partition by group_id order by rank = 0, rank, bid_no, price) place from ({oracle.ORACLE_SQL['price_score_reasonable']})"


def archived(spark: SparkSession, sf: str) -> DataFrame:
    """Every document archived as a final under its industry and year, and counted from the files."""
    finals = _docs(spark, sf).select("doc_id", "text", F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("industry"), F.when(F.col("doc_id") % 3 > 0, 2020 + F.col("doc_id") % 5).alias("year"))
    place = Scratch(spark, "archive").path("finals")
    sinks.archive_finals(finals, place)
    return spark.read.parquet(place).groupBy("industry", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


ARCHIVED_SQL = "select industry, y as \"year\", count(*) n, sum(length(text))::bigint n_chars from (select text, case when doc_id % 4 > 0 and trim(source) <> '' then source else 'unknown' end industry, case when doc_id % 3 > 0 then 2020 + doc_id % 5 else 0 end::bigint y from documents) group by 1, 2"


def kb_ingested(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the documents put into a knowledge base, then all of them; what it holds."""
    place = Scratch(spark, "kb").path("base")
    docs = _docs(spark, sf).select(F.col("source").alias("dataset"), "doc_id", F.col("lang").alias("title"), F.col("text").alias("content"))
    sinks.ingest(docs.where("doc_id % 2 = 0"), place)
    told = sinks.ingest(docs, place)
    held = spark.read.parquet(place).groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))
    return held.join(told.groupBy("dataset").agg(F.count_if(F.col("run") == "DONE").alias("done")), "dataset")


INGESTED_SQL = "select case when trim(source) <> '' then source else 'unknown' end dataset, count(*) n, sum(length(coalesce(text, '')))::bigint n_chars, count(*) done from documents group by 1"


def json_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments as bare arrays, as lists in an object, and as neither."""
    item = F.array(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")))
    given = F.when(F.col("doc_id") % 3 == 0, F.to_json(item)).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(item.alias("documents")))).otherwise(F.lit("7"))
    read = _docs(spark, sf).select("doc_id", json_list(given, "struct<id:string,content:string>", "documents").alias("l"))
    return read.select("doc_id", F.get("l", F.lit(0))["id"].alias("id"), F.md5(F.get("l", F.lit(0))["content"]).alias("digest"), F.col("l").isNull().alias("neither"))


JSON_SQL = "select doc_id, case when doc_id % 3 < 2 then doc_id::varchar end id, case when doc_id % 3 < 2 then md5(text) end digest, doc_id % 3 = 2 neither from documents"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Objects in a model's answers, clipped texts, and sources of retrieved chunks."""
    t, d = F.col("text"), F.col("doc_id")
    body = F.to_json(F.struct(F.concat(F.lit('}"{'), t).alias("t")))
    said = F.when(d % 3 == 0, F.concat(F.lit("Well: ```json\n"), body, F.lit("\n``` done }"))).when(d % 3 == 1, F.concat(F.lit("{ open "), F.regexp_replace(t, '[{}"]', ""))).otherwise(body)
    rows = _docs(spark, sf).select("doc_id", said.alias("said"), clip(t, 700).alias("clipped"), t.alias("content"), F.when(d % 2 == 0, F.col("source")).otherwise("").alias("document_keyword"), F.when(d % 3 == 0, F.col("lang")).alias("docnm_kwd"))
    got = retrieval.salvage_json(evidence.format_chunks(rows), "said")
    held = F.from_json("json", "struct<t:string>")["t"]
    return got.select("doc_id", "source", F.length("content").cast("long").alias("n_content"), F.md5("clipped").alias("clipped"), F.md5(held).alias("held"))


ANSWERS_SQL = """select doc_id, coalesce(case when doc_id % 2 = 0 then nullif(source, '') end, case when doc_id % 3 = 0 then nullif(lang, '') end, '未知文档') source, least(length(text), 2000)::bigint n_content,
       md5(case when length(text) > 700 then substr(text, 1, 700) || chr(10) || '…[截断]' else text end) clipped, case when doc_id % 3 <> 1 and text is not null then md5('}"{' || text) end held from documents"""


def compliance_judged(spark: SparkSession, sf: str) -> DataFrame:
    """The counts by document after a model has judged two thirds of the pending requirements, some untidily."""
    checked = compliance(spark, sf).withColumn("comment", F.lit(""))
    r = F.col("req_id") % 3
    told = checked.where(r < 2).select("project_id", "req_id", F.when(r == 0, " 部分响应 ").otherwise("maybe").alias("status"), F.lit(None).cast("string").alias("evidence"), F.lit("c").alias("comment"))
    done = evidence.compliance_summary(evidence.judge_pending(checked, told))
    return done.select("project_id", "total", "met", "partial", "missing")


JUDGED_SQL = f"select project_id, count(*) total, count(*) filter (status = '完全响应') met, count(*) filter (status <> '完全响应' and req_id % 3 = 0) partial, count(*) filter (status <> '完全响应' and req_id % 3 > 0) missing from ({oracle._compliance()}) group by 1"

#: The standing packs, an own rule in place of a common one, and an older template that a standing one supersedes.
OWN = Template("own-building", "河北省", ("承德市",), ("工程",), ("工程",), "LAW", date(2024, 6, 1), None, (Rule("LEAK.MOBILE", "DISCLOSURE", "WARN", "text.pattern", {"patterns": ["[0-9]{3}"], "occurrences": 1, "exclude": []}), Rule("OWN.WORD", "FORMAT", "INFO", "text.pattern", {"patterns": ["token"], "occurrences": 0, "exclude": []})))
OLDER = Template("hebei-baoding-v1", "河北省", ("承德市",), ("工程",), ("工程",), "LAW", date(2024, 7, 1), None, ())


def rules_overridden(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on every document where a template's rule replaces a common one; the superseded template has no say."""
    docs = _docs(spark, sf).select("doc_id", "text")
    found = rules.validate(docs, date(2025, 1, 1), templates=(*TEMPLATES, OLDER, OWN), city="承德市", industry="工程")[1]
    long = lambda c: F.col(c).cast("long").alias(c)
    return found.select("doc_id", "verdict", long("rule_count"), long("checked"), long("warn"), long("info"))


def _overridden_sql() -> str:
    hits = f"(select distinct doc_id, rule_id from ({oracle._disclosure_rows()}) where rule_id <> 'LEAK.MOBILE')"
    return f"""with h as (select doc_id, count(*) n from {hits} group by 1), d as (select doc_id, coalesce(n, 0) reject, (len(regexp_extract_all(coalesce(text, ''), '[0-9]{{3}}')) > 1)::bigint warn, contains(coalesce(text, ''), 'token')::bigint info from documents left join h using (doc_id))
select doc_id, case when reject > 0 then 'REJECT' when warn > 0 then 'WARN' else 'PASS' end verdict, {len(DISCLOSURE) + 1}::bigint rule_count, {len(DISCLOSURE) + 1}::bigint checked, warn, info from d"""


#: A template as its file holds it: patterns of JavaScript, invalid ones, a rule that can't be decided, one without a detector.
ODD_RULES = [
    ("ODD.WORD", "REJECT", "text.pattern", {"patterns": [r"\btoken\b", "([a-z", "a++"], "occurrences": 1}), ("ODD.ANY", "WARN", "text.pattern", {"patterns": [r"\.[^][A-Z]{2}", "*"]}), ("ODD.NONE", "REJECT", "text.pattern", {"patterns": ["(?>a)", "[b-a]"]}),
    ("ODD.EMPTY", "REJECT", "text.pattern", {"patterns": ["q*"]}), ("ODD.LIMIT", "REJECT", "marks.comments", {"max": "many"}), ("ODD.KIND", "REJECT", "no.such.detector", {}),
]


def odd_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Findings on every document under a template from a file with odd patterns."""
    from procurelake.packs import files

    folder = Scratch(spark, "packs").path("odd")
    given = [{"id": i, "category": "X", "severity": s, "detect": d, "expect": json.dumps(e)} for i, s, d, e in ODD_RULES]
    files.write_packs(spark, folder, {"odd": {"key": "odd", "dialect": "javascript", "region": "*", "level": "LAW", "effective_from": "2024-01-01", "rules": given}})
    templates = files.templates(files.read_packs(spark, folder, "template"))
    found = rules.validate(_docs(spark, sf).select("doc_id", "text"), date(2025, 1, 1), templates=templates, text_most=(1 << 31) - 1)[0]
    return found.select("doc_id", "rule_id", "severity", F.col("n").cast("long").alias("n"))


ODD_SQL = r"""with x as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '\btoken\b')) a, len(regexp_extract_all(coalesce(text, ''), '\.[\s\S][A-Z]{2}')) b from documents)
select doc_id, 'ODD.WORD' rule_id, 'REJECT' severity, a::bigint n from x where a > 1 union all select doc_id, 'ODD.ANY', 'WARN', b::bigint from x where b > 0
union all select doc_id, 'ODD.EMPTY', 'WARN', 0 from x union all select doc_id, 'ODD.LIMIT', 'WARN', 0 from x"""


def disclosure_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with disclosures, how many, and what masking makes of their personal data."""
    hits, masked = pii.scan_and_mask(_docs(spark, sf))
    each = pii.leak_summary(hits).groupBy("doc_id").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_rules"))
    return masked.join(each, "doc_id").select("doc_id", "n_hits", "n_rules", F.col("n_matches").cast("long").alias("n_masked"), F.md5("masked_text").alias("digest"))


def _masked_sql() -> str:
    return f"with h as (select doc_id, count(*) n_hits, count(distinct rule_id) n_rules from ({oracle._disclosure_rows()}) group by 1) select doc_id, n_hits, n_rules, n_matches n_masked, md5(masked_text) digest from ({oracle._pii_mask()}) join h using (doc_id)"


def kb_search(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that share most words with the start of each benchmark item; texts have no vectors here."""
    none = F.lit(None).cast("array<double>").alias("vec")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), none, F.slice(F.split("text", " "), 1, 8).alias("terms"))
    corpus = _docs(spark, sf).select("doc_id", none, F.array_distinct(F.split("text", " ")).alias("terms"))
    index = search.build_index(corpus, Scratch(spark, "kb-index").path("index"), asked.select(F.explode("terms").alias("term")))
    got = search.search(asked, index)
    return got.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


SEARCH_SQL = """with q as (select item_id query_id, list_distinct(string_split(text, ' ')[1:8]) w from benchmark), s as (select query_id, doc_id, 0.7::double * (len(list_intersect(w, string_split(text, ' ')))::double / len(w)) similarity from q, documents),
r as (select *, row_number() over (partition by query_id order by similarity desc, doc_id) as "rank" from s where similarity >= 0.2) select query_id, doc_id, round(similarity, 6) similarity, "rank" from r where "rank" <= 8"""


def _audit_sql() -> str:
    """``docx_audit``: what the writer leaves unset, the leaks of the text, and pages of 34 lines of 37 signs."""
    total = len(rules.effective_rules(rules.choose_template(date(2025, 1, 1), industry="工程")))
    escaped = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    signs = f"(1 + length(replace(array_to_string(list_transform(string_split({escaped}, chr(10)), lambda l: case when trim(l) = '' then '' else {_MARKED} end), chr(10)), chr(10), '')))"
    return f"""with l as (select doc_id, count(distinct rule_id) leaks from ({oracle._disclosure_rows(None)}) group by 1),
p as (select doc_id, text, coalesce(leaks, 0) leaks, coalesce(ceil({signs} / (34 * 37.0)), 1) pages from documents left join l using (doc_id)),
n as (select doc_id, (leaks + (text is not null)::int + (pages > 125)::int)::int reject, (2 + (pages > 100 and pages <= 125)::int)::int warn from p)
select doc_id::varchar doc_id, case when reject > 0 then 'REJECT' else 'WARN' end verdict, greatest(0, 100 - least(15 * reject, 60) - least(3 * warn, 30))::double score, {total} rule_count, {total} checked, 0 skipped, reject, warn, 0 info, reject + warn rules_triggered from n"""


QUERIES = {
    "layout_findings": layout_findings, "docx_roundtrip": docx_roundtrip, "requirements_extracted": requirements_extracted, "archived": archived, "kb_ingested": kb_ingested,
    "json_arguments": json_arguments, "answers": answers, "compliance_judged": compliance_judged, "rules_overridden": rules_overridden, "disclosure_masked": disclosure_masked, "kb_search": kb_search,
    "rules_each": rules_each, "verdict_each": verdict_each, "template_orders": template_orders, "odd_patterns": odd_patterns, "requirements_failed": requirements_failed, "chunk_sql": chunk_sql, "chunk_window": chunk_window, "fairness_docx": fairness_docx, "docx_media": docx_media, "score_places": score_places,
}
ORACLE_SQL = {
    "docx_audit": _audit_sql(),
    "layout_findings": _layout_sql(), "docx_roundtrip": DOCX_SQL, "requirements_extracted": _extracted_sql(), "archived": ARCHIVED_SQL, "kb_ingested": INGESTED_SQL,
    "json_arguments": JSON_SQL, "answers": ANSWERS_SQL, "compliance_judged": JUDGED_SQL, "rules_overridden": _overridden_sql(), "disclosure_masked": _masked_sql(), "kb_search": SEARCH_SQL,
    "rules_each": _rules_each_sql(), "verdict_each": _verdict_each_sql(), "template_orders": _orders_sql(), "odd_patterns": ODD_SQL, "requirements_failed": _failed_sql(), "chunk_sql": oracle._chunks(), "chunk_window": _window_sql(), "fairness_docx": _fairness_docx_sql(), "docx_media": MEDIA_SQL, "score_places": PLACES_SQL,
}
