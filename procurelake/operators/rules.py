"""Rule templates and the verdict over a document's facts.

Rules become column expressions, so a check is one pass over the facts.  Where all documents have one scope and date, the
template is chosen on the driver; else ``validate_each`` chooses one for each, and rows carry a bitmap of their rules.  Facts are a nested row; a part that wasn't collected is null:

``text STRING, metadata STRUCT<creator, lastModifiedBy, company>, marks STRUCT<revisions, comments, hidden_text,
rsid_count>, images ARRAY<STRUCT<has_exif, color_space>>, paragraphs ARRAY<STRUCT<index, text, style, is_heading,
fonts_eastAsia, sizes_pt, colors, line_rule, line_spacing_pt, line_multiple, first_line_indent_chars, alignment,
space_before_pt, space_after_pt>>, doc STRUCT<margins_cm STRUCT<top_cm, bottom_cm, left_cm, right_cm>, page_count,
page_count_estimated, headers_footers, watermark>``
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.functions.text import present, surrounded, trim
from procurelake.packs.rules import COMMON_ID, DATED, LEVELS, MATCH_CITY, MATCH_INDUSTRY, MATCH_TYPE, TEMPLATES, Rule, Template

#: Characters on either side of a match in which a text rule looks for what excuses it.
REACH = 25
NOT_SET = "未显式设置"
#: What rules expect as numbers.
NUMBERS = ("occurrences", "max", "pt", "tolerance", "multiple", "mult_tolerance", "chars", "before_pt", "after_pt", "top_cm", "bottom_cm", "left_cm", "right_cm")
#: What the finding of a rule that can't be decided shows.
FAILED = "判定失败"
#: Days for which the best templates are kept in one row.
SPAN = 32
#: Region and type of a request that names none.
HOME_REGION, HOME_TYPE = "河北省", "工程"

PARAGRAPH = "struct<index:int,text:string,style:string,is_heading:boolean,fonts_eastAsia:array<string>,sizes_pt:array<double>,colors:array<string>,line_rule:string,line_spacing_pt:double,line_multiple:double,first_line_indent_chars:double,alignment:string,space_before_pt:double,space_after_pt:double>"
FACTS = (
    "text string, metadata struct<creator:string,lastModifiedBy:string,company:string>, marks struct<revisions:int,comments:int,hidden_text:int,rsid_count:int>, "
    f"images array<struct<name:string,has_exif:boolean,color_space:string>>, paragraphs array<{PARAGRAPH}>, "
    "doc struct<margins_cm:struct<top_cm:double,bottom_cm:double,left_cm:double,right_cm:double>,page_width_cm:double,page_height_cm:double,header_count:int,footer_count:int,headers_footers:int,watermark:int,page_count:int,page_count_source:string,page_count_estimated:boolean>"
)
FINDING = "array<struct<rule_id:string,category:string,severity:string,n:int,expected:string,actual:string>>"


def active(templates: tuple[Template, ...]) -> tuple[Template, ...]:
    """Templates that are active once those that active ones supersede are abolished."""
    gone = {i for t in templates if t.status == "ACTIVE" for i in t.supersedes}
    return tuple(replace(t, status="ABOLISHED") if t.id in gone else t for t in templates)


def template_frame(spark, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The templates as a table, each once: (template_id, region, city, industry, tender_type, level, effective_from, effective_to, status, rules)."""
    rows = [(t.id, t.region, list(t.city), list(t.industry), list(t.tender_type), t.level, t.effective_from, t.effective_to, t.status, len(t.rules)) for t in active(templates)]
    return spark.createDataFrame(rows, "template_id string, region string, city array<string>, industry array<string>, tender_type array<string>, level string, effective_from date, effective_to date, status string, rules int")


def match_template(requests: DataFrame, templates: DataFrame, always_on: str = COMMON_ID) -> DataFrame:
    """(req_id, template_id, score): for each request (req_id, region, city, industry, tender_type, as_of) the best template.

    A template applies if it is active, of the region or of any, in force on ``as_of``, and each of its scopes is open or
    has the request's value.  Matched scopes, legal level and a start date add to the score; of equal scores the later
    start wins, then the id.  Requests that nothing fits, or without a date, have a null template; a request that is there
    twice is answered twice.  Any number of templates and requests: of templates with equal region and scopes only the best of
    each day counts, which ``_calendar`` works out first, so a request meets one row for each different scope of its region
    and not every template in force.
    """
    t = templates.where((F.col("status") == "ACTIVE") & (F.col("template_id") != always_on))
    level = F.coalesce(*[F.when(F.col("level") == k, F.lit(v / 10)) for k, v in LEVELS.items()], F.lit(5.0)) + F.when(F.col("effective_from").isNotNull(), DATED).otherwise(0)
    start = F.coalesce(F.unix_date("effective_from").cast("long"), F.lit(-(1 << 40)))
    plain = lambda c: F.array_sort(F.array_distinct(c))
    # the least is the best: greatest score, latest start, least id
    t = t.select(F.col("region").alias("t_region"), plain("city").alias("cities"), plain("industry").alias("industries"), plain("tender_type").alias("types"), "effective_from", "effective_to", F.struct((-level.cast("double")).alias("s"), (-start).alias("d"), "template_id").alias("own"))
    asked = requests.where("as_of is not null").select(F.struct("region", "city", "industry", "tender_type", "as_of").alias("scope")).distinct()
    regions = F.array_distinct(F.array(F.lit("*"), F.coalesce(F.col("scope.region"), F.lit(HOME_REGION))))
    day = F.unix_date("scope.as_of")
    asked = asked.select("scope", F.explode(regions).alias("t_region"), F.floor(day / SPAN).cast("int").alias("span"), F.pmod(day, F.lit(SPAN)).alias("day"))
    bounds = requests.agg(F.min(F.unix_date("as_of")), F.max(F.unix_date("as_of"))).first()
    joined = asked.join(_calendar(t, *bounds), ["t_region", "span"]).select("*", F.get("best", F.col("day")).alias("own")).where("own is not null")
    score = -F.col("own.s")
    kind = F.coalesce(F.col("scope.tender_type"), F.lit(HOME_TYPE))
    for scope, value, points in (("cities", F.col("scope.city"), MATCH_CITY), ("industries", F.col("scope.industry"), MATCH_INDUSTRY), ("types", kind, MATCH_TYPE)):
        open_ = F.array_contains(scope, "*")
        has = F.coalesce((value != "") & F.array_contains(F.col(scope), value), F.lit(False))
        joined = joined.where(open_ | has)
        score = score + F.when(open_, 0).otherwise(points)
    ranked = joined.select("t_region", "span", "scope", F.struct((-score).alias("s"), "own.d", "own.template_id").alias("b"))
    # rows of a scope lie together by region and span, so only the best of each region is shuffled
    best = ranked.groupBy("t_region", "span", "scope").agg(F.min("b").alias("b")).groupBy("scope").agg(F.min("b").alias("b"))
    best = best.select("scope", "b.template_id", (-F.col("b.s")).alias("score"))
    told = requests.select("req_id", F.struct("region", "city", "industry", "tender_type", "as_of").alias("__s"))
    return told.join(best, F.col("__s").eqNullSafe(F.col("scope")), "left").select("req_id", "template_id", "score")


def _calendar(templates: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """(t_region, span, cities, industries, types, best): for each day of a span, the least ``own`` of the templates
    (t_region, cities, industries, types, effective_from, effective_to, own) of equal region and scopes in force, or null.

    Spans are of SPAN days from 1970 on; those between the days ``low`` and ``high`` are given.
    """
    low, high = (0, -1) if low is None else (low, high)
    first, last = (F.coalesce(F.unix_date(c), F.lit(x)) for c, x in (("effective_from", low), ("effective_to", high)))
    held = templates.select("t_region", "cities", "industries", "types", "own", F.greatest(first, F.lit(low)).alias("a"), F.least(last, F.lit(high)).alias("e")).where("a <= e")
    span = lambda c: F.floor(F.col(c) / SPAN).cast("int")
    held = held.select("*", F.explode(F.sequence(span("a"), span("e"))).alias("span"))
    since, until = F.col("a") - F.col("span") * SPAN, F.col("e") - F.col("span") * SPAN
    keys = ["t_region", "span", "cities", "industries", "types"]
    # of equal scopes and days in the span the best stays; then each day's
    parts = held.groupBy(*keys, F.greatest(since, F.lit(0)).alias("a"), F.least(until, F.lit(SPAN - 1)).alias("e")).agg(F.min("own").alias("own"))
    parts = parts.repartition(*keys)  # before the partial aggregate, whose rows are of SPAN structs
    days = [F.min(F.when((F.col("a") <= d) & (F.col("e") >= d), F.col("own"))).alias(f"d{d}") for d in range(SPAN)]
    return parts.groupBy(*keys).agg(*days).select(*keys, F.array(*[f"d{d}" for d in range(SPAN)]).alias("best"))


def choose_template(as_of: date, region: str = HOME_REGION, city: str = "", industry: str = "", tender_type: str = HOME_TYPE, templates: tuple[Template, ...] = TEMPLATES, always_on: str = COMMON_ID) -> Template | None:
    """The same choice for one request, on the driver, to build rules from."""
    best = None
    for t in active(templates):
        fits = t.status == "ACTIVE" and t.id != always_on and t.region in ("*", region) and (t.effective_from is None or t.effective_from <= as_of) and (t.effective_to is None or t.effective_to >= as_of)
        score = LEVELS.get(t.level, 50) / 10 + (DATED if t.effective_from else 0)
        for scope, value, points in ((t.city, city, MATCH_CITY), (t.industry, industry, MATCH_INDUSTRY), (t.tender_type, tender_type, MATCH_TYPE)):
            if "*" not in scope:
                fits = fits and bool(value) and value in scope
                score += points
        key = (score, t.effective_from or date.min, [-ord(c) for c in t.id])
        if fits and (best is None or key > best[0]):
            best = (key, t)
    return best[1] if best else None


def effective_rules(primary: Template | None, templates: tuple[Template, ...] = TEMPLATES, always_on: str = COMMON_ID) -> tuple[Rule, ...]:
    """The always-on rules with those of the primary template, which win by id."""
    merged = {r.id: r for t in active(templates) if t.id == always_on and t.status == "ACTIVE" for r in t.rules}
    merged |= {r.id: r for r in (primary.rules if primary else ())}
    return tuple(merged.values())


def _skip(p: Column, rule: Rule) -> Column:
    """Headings and excluded styles."""
    style = F.coalesce(p["style"], F.lit(""))
    out = F.coalesce(p["is_heading"], F.lit(False))
    for word in rule.expect.get("exclude_styles", []):
        out = out | F.contains(style, F.lit(word))
    return out


def _samples(values: Column) -> Column:
    return F.array_join(F.slice(F.array_distinct(values.cast("array<string>")), 1, 5), "/")


def _finding(rule: Rule, n: Column, expected: str, actual: Column, severity: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.category).alias("category"), (severity if severity is not None else F.lit(rule.severity)).alias("severity"),
        n.cast("int").alias("n"), F.lit(expected).alias("expected"), actual.cast("string").alias("actual"),
    )


def _hits(text: Column, rule: Rule, most: int | None) -> Column:
    """ARRAY<STRING>: the matches of a text rule's patterns, without those whose context excuses them."""
    excuses, per_pattern = rule.expect.get("exclude", []), []
    for pattern in rule.expect["patterns"]:
        # contexts are put together only for rules that have excuses
        hits = surrounded(text, pattern, REACH) if excuses else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        hits = hits if most is None else F.slice(hits, 1, most)
        if excuses:
            hits = F.transform(F.filter(hits, lambda h: F.size(present(h["context"], excuses)) == 0), lambda h: h["match"])
        per_pattern.append(hits)
    return F.concat(*per_pattern)


def _one(rule: Rule, text_most: int | None) -> Column:
    """The rule's findings over the facts of a row: an array of none or one, null if its facts weren't collected.

    A rule that can't be decided, as what it expects is malformed, gives a WARN finding that says so.
    """
    try:
        if "failed" in rule.expect:
            raise ValueError(rule.expect["failed"])
        if odd := [k for k in NUMBERS if not isinstance(rule.expect.get(k, 0), int | float)]:
            raise TypeError(f"no numbers: {odd}")
        return _decided(rule, text_most)
    except (KeyError, TypeError, ValueError, AttributeError):
        failed = F.array(_finding(rule, F.lit(0), "", F.lit(FAILED), F.lit("WARN")))
        paragraphs = F.coalesce(F.size("paragraphs") > 0, F.lit(False)) if rule.detect.startswith(("run.", "paragraph.")) else F.col("doc").isNotNull()
        return F.when(paragraphs, failed) if rule.detect.startswith(("run.", "paragraph.", "doc.")) else failed


def _decided(rule: Rule, text_most: int | None) -> Column:
    e, d = rule.expect, rule.detect
    none = F.array().cast(FINDING)
    when = lambda cond, finding: F.when(F.coalesce(cond, F.lit(False)), F.array(finding)).otherwise(none)
    paragraphs = F.coalesce("paragraphs", F.array().cast(f"array<{PARAGRAPH}>"))
    written = F.filter(paragraphs, lambda p: trim(F.coalesce(p["text"], F.lit(""))) != "")
    body = lambda ps: F.filter(ps, lambda p: ~_skip(p, rule))
    flat = lambda ps, field: F.flatten(F.transform(ps, lambda p: F.coalesce(p[field], F.array())))
    unset = _finding(rule, F.lit(0), "", F.lit(NOT_SET), F.lit("WARN"))
    if d == "text.pattern":
        text, most = F.coalesce("text", F.lit("")), int(e.get("occurrences", 0))
        if not e["patterns"]:
            return none
        quoted = lambda hits: F.array_join(F.transform(F.slice(hits, 1, 3), lambda h: F.concat(F.lit("「"), h, F.lit("」"))), "、")
        # hits are written once, and worked out only where one of the patterns occurs
        tested = F.transform(F.array(_hits(text, rule, text_most)), lambda hits: _finding(rule, F.size(hits), f"≤ {most}", quoted(hits)))
        some = text.rlike("|".join(f"(?:{p})" for p in e["patterns"]))
        return F.when(some, F.filter(tested, lambda f: f["n"] > most)).otherwise(none)
    if d.startswith("metadata."):
        got = F.coalesce(F.col("metadata")[d.split(".")[1]], F.lit(""))
        bad = got != "" if e.get("must_be_empty") else (got != "") & ~F.lower(got).isin([v.lower() for v in e["neutral"]])
        return when(bad, _finding(rule, F.lit(1), "空" if e.get("must_be_empty") else "空或中性值", got))
    if d.startswith("marks."):
        got = F.coalesce(F.col("marks")[d.split(".")[1]], F.lit(0))
        return when(got > e["max"], _finding(rule, got, f"≤ {e['max']}", got))
    if d in ("images.exif", "images.color"):
        images = F.coalesce("images", F.array().cast("array<struct<name:string,has_exif:boolean,color_space:string>>"))
        if d == "images.exif":
            bad, most = F.filter(images, lambda i: F.coalesce(i["has_exif"], F.lit(False))), e["max"]
        else:
            bad, most = F.filter(images, lambda i: ~F.coalesce(i["color_space"], F.lit("")).isin([*e["allowed"], "unknown"])), 0
        return when(F.size(bad) > most, _finding(rule, F.size(bad), f"≤ {most}", F.size(bad)))
    if d == "run.font.name":
        fonts = flat(body(paragraphs), "fonts_eastAsia")
        bad = F.filter(fonts, lambda f: (f != "") & ~f.isin(e["allowed"]))
        out = F.when(F.size(bad) > 0, F.array(_finding(rule, F.size(bad), "/".join(e["allowed"]), _samples(bad))))
        out = (out.when(F.size(fonts) == 0, F.array(unset)) if rule.hard else out).otherwise(none)
    elif d == "run.font.size":
        sizes = flat(body(paragraphs), "sizes_pt")
        bad = F.filter(sizes, lambda s: F.abs(s - e["pt"]) > e["tolerance"])
        out = F.when(F.size(bad) > 0, F.array(_finding(rule, F.size(bad), f"{e['pt']}pt", _samples(bad))))
        out = (out.when(F.size(sizes) == 0, F.array(unset)) if rule.hard else out).otherwise(none)
    elif d == "run.color":
        bad = F.filter(flat(paragraphs, "colors"), lambda c: (c != "") & ~F.lower(c).isin([a.lower() for a in e["allowed"]]))
        out = when(F.size(bad) > 0, _finding(rule, F.size(bad), "黑色(auto)", _samples(bad)))
    elif d == "paragraph.line_spacing":
        if e["rule"] == "exact":
            ok = lambda p: (p["line_rule"] == "exact") & (F.abs(p["line_spacing_pt"] - e["pt"]) <= e["tolerance"])
        else:
            ok = lambda p: (F.coalesce(p["line_rule"], F.lit("auto")) == "auto") & (F.abs(p["line_multiple"] - e["multiple"]) <= e.get("mult_tolerance", 0.02))
        bad = F.filter(written, lambda p: ~F.coalesce(ok(p), F.lit(False)))
        shown = F.transform(bad, lambda p: F.concat_ws("/", F.coalesce(p["line_rule"], F.lit("null")), F.coalesce(p["line_spacing_pt"].cast("string"), F.lit("null")), F.coalesce(p["line_multiple"].cast("string"), F.lit("null"))))
        out = when(F.size(bad) > 0, _finding(rule, F.size(bad), f"固定值 {e['pt']} 磅" if e["rule"] == "exact" else f"{e['multiple']} 倍行距", _samples(shown)))
    elif d == "paragraph.first_line_indent":
        values = F.filter(F.transform(body(written), lambda p: p["first_line_indent_chars"]), lambda v: v.isNotNull())
        bad = F.filter(values, lambda v: F.abs(v - e["chars"]) > e["tolerance"])
        out = F.when(F.size(bad) > 0, F.array(_finding(rule, F.size(bad), f"{e['chars']} 字符", _samples(bad))))
        out = (out.when(F.size(values) == 0, F.array(unset)) if rule.hard else out).otherwise(none)
    elif d == "paragraph.alignment":
        bad = F.filter(F.transform(body(written), lambda p: p["alignment"]), lambda v: v != e["value"])
        out = when(F.size(bad) > 0, _finding(rule, F.size(bad), e["value"], _samples(bad)))
    elif d == "paragraph.spacing":
        off = lambda v, want: F.coalesce(F.abs(v - want) > e["tolerance"], F.lit(False))
        bad = F.filter(written, lambda p: off(p["space_before_pt"], e["before_pt"]) | off(p["space_after_pt"], e["after_pt"]))
        out = when(F.size(bad) > 0, _finding(rule, F.size(bad), f"段前 {e['before_pt']}pt / 段后 {e['after_pt']}pt", F.size(bad)))
    elif d == "doc.page.margins":
        sides = ("top_cm", "bottom_cm", "left_cm", "right_cm")
        got = {s: F.col("doc.margins_cm")[s] for s in sides}
        wrong = [F.when(got[s].isNull() | (F.abs(got[s] - e[s]) > e["tolerance"]), F.concat(F.lit(f"{s}="), F.coalesce(got[s].cast("string"), F.lit("null")))) for s in sides]
        bad = F.filter(F.array(*wrong), lambda x: x.isNotNull())
        out = when(F.size(bad) > 0, _finding(rule, F.size(bad), " / ".join(f"{s}={e[s]}" for s in sides), F.array_join(bad, " / ")))
    elif d == "doc.page_count":
        pages = F.col("doc.page_count")
        unsure = F.coalesce(F.col("doc.page_count_estimated"), F.lit(False)) & (pages <= e["max"] * 1.25)
        out = when(pages > e["max"], _finding(rule, pages, f"≤ {e['max']} 页", pages, F.when(unsure, "WARN").otherwise(rule.severity)))
    elif d in ("doc.marks.headers_footers", "doc.marks.watermark"):
        got = F.coalesce(F.col("doc")[d.split(".")[-1]], F.lit(0))
        out = when(got > e["max"], _finding(rule, got, f"≤ {e['max']}", got))
    else:
        return F.lit(None).cast(FINDING)
    there = F.size(paragraphs) > 0 if d.startswith(("run.", "paragraph.")) else F.col("doc").isNotNull()
    return F.when(there, out)


def findings(facts: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_most: int | None = None, gate: str | None = None) -> DataFrame:
    """(id, checked, skipped, found): found is the array of findings; a rule whose facts are missing is skipped.

    A text rule looks at every match of its patterns, or with ``text_most`` at the first so many of each: n is then at most
    that for each of them, and leaks behind so many excused matches aren't found.  ``gate`` names a column of bitmaps
    (ARRAY<BIGINT>, 63 rules in each): a row is held to the rules whose bit is set, and no other is worked out for it.
    """
    columns = {f.split()[0]: f.split(None, 1)[1] for f in _split_fields(FACTS)}
    have = facts.select(id_col, *([gate] if gate else []), *[(F.col(c).cast(t) if c in facts.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])
    on = lambda i: F.get(F.col(gate), F.lit(i // 63)).bitwiseAND(F.lit(1 << i % 63)) != 0 if gate else F.lit(True)
    each = F.array(*[F.struct(on(i).alias("on"), (F.when(on(i), _one(r, text_most)) if gate else _one(r, text_most)).alias("f")) for i, r in enumerate(rules)]) if rules else F.array().cast(f"array<struct<on:boolean,f:{FINDING}>>")
    got = have.select(id_col, F.filter(each, lambda x: x["on"]).alias("e"))
    none = lambda x: x["f"].isNull()
    return got.select(id_col, F.size(F.filter("e", lambda x: ~none(x))).alias("checked"), F.size(F.filter("e", none)).alias("skipped"), F.flatten(F.transform(F.filter("e", lambda x: ~none(x)), lambda x: x["f"])).alias("found"))


def _split_fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def finding_rows(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each finding: (id, rule_id, category, severity, n, expected, actual)."""
    return found.select(id_col, F.explode("found").alias("f")).select(id_col, "f.*")


def verdicts(found: DataFrame, rules: tuple[Rule, ...] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, verdict, score, rule_count, checked, skipped, reject, warn, info, rules_triggered) of every document.

    Without ``rules`` the count is of those that the row was held to.
    """
    n = lambda s: F.size(F.filter("found", lambda f: f["severity"] == s))
    out = found.select(id_col, "checked", "skipped", n("REJECT").alias("reject"), n("WARN").alias("warn"), n("INFO").alias("info"), F.size(F.array_distinct(F.transform("found", lambda f: f["rule_id"]))).alias("rules_triggered"))
    score = F.greatest(F.lit(0.0), 100.0 - F.least(15 * F.col("reject"), F.lit(60)) - F.least(3 * F.col("warn"), F.lit(30)))
    count = F.lit(len(rules)) if rules is not None else F.col("checked") + F.col("skipped")
    return out.select(id_col, F.when(F.col("reject") > 0, "REJECT").when(F.col("warn") > 0, "WARN").otherwise("PASS").alias("verdict"), score.alias("score"), count.alias("rule_count"), "checked", "skipped", "reject", "warn", "info", "rules_triggered")


def by_category(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, category, reject, warn, info) of findings."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return rows.groupBy(id_col, "category").agg(n("REJECT").alias("reject"), n("WARN").alias("warn"), n("INFO").alias("info"))


def validate(facts: DataFrame, as_of: date, id_col: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES, text_most: int | None = None, **scope: str) -> tuple[DataFrame, DataFrame]:
    """Findings and verdicts under the rules in force on ``as_of`` for a region, city, industry and tender_type.

    Findings are sorted by severity and rule when collected in that order: see ``finding_rows``.
    """
    rules = effective_rules(choose_template(as_of, templates=templates, **scope), templates)
    found = findings(facts, rules, id_col, text_most)
    return finding_rows(found, id_col), verdicts(found, rules, id_col)


def compiled_rules(templates: tuple[Template, ...] = TEMPLATES, always_on: str = COMMON_ID) -> tuple[tuple[Rule, ...], dict[str | None, list[int]]]:
    """Every different rule of the active templates once, and for each template the bitmap of the rules in force under it.

    The bitmap of None is that of documents without a template: the always-on rules.
    """
    sets = {None: effective_rules(None, templates, always_on)}
    sets |= {t.id: effective_rules(t, templates, always_on) for t in active(templates) if t.status == "ACTIVE" and t.id != always_on}
    every: list[Rule] = []
    for members in sets.values():
        every += [r for r in members if r not in every]
    maps = {}
    for name, members in sets.items():
        words = [0] * (-(-len(every) // 63) or 1)
        for r in members:
            i = every.index(r)
            words[i // 63] |= 1 << i % 63
        maps[name] = words
    return tuple(every), maps


def validate_each(facts: DataFrame, id_col: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES, always_on: str = COMMON_ID, text_most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, verdicts and templates (id, template_id) where each row of ``facts`` has its own scope and date.

    The scope is in the columns region, city, industry, tender_type and as_of.  A template is matched once for each
    different scope, and the rules of all templates are compiled once; a row's bitmap says which it is held to.
    Rows that no template fits, or without a date, are held to the always-on rules.  Rows that repeat an id each have
    their findings and verdict.
    """
    spark = facts.sparkSession
    scope = F.struct(*[F.col(c) for c in ("region", "city", "industry", "tender_type", "as_of")])
    asked = facts.select(scope.alias("req_id")).distinct().select("req_id", "req_id.*")
    every, maps = compiled_rules(templates, always_on)
    chosen = match_template(asked, template_frame(spark, templates), always_on)
    masks = F.create_map(*[x for name, words in maps.items() for x in (F.lit(name or ""), F.array(*[F.lit(w).cast("long") for w in words]))])
    gated = chosen.select(F.col("req_id").alias("__scope"), F.col("template_id").alias("__template"), F.element_at(masks, F.coalesce("template_id", F.lit(""))).alias("__rules"))
    met = facts.join(gated, scope.eqNullSafe(F.col("__scope")), "left")
    found = findings(met, every, id_col, text_most, "__rules")
    return finding_rows(found, id_col), verdicts(found, None, id_col), met.select(id_col, F.col("__template").alias("template_id"))


def _report_order() -> list[Column]:
    """REJECT before WARN before INFO before others, then rule."""
    return [F.when(F.col("severity") == "REJECT", 0).when(F.col("severity") == "WARN", 1).when(F.col("severity") == "INFO", 2).otherwise(9), F.col("rule_id")]


def sorted_findings(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings by document, in the order of a report; ``ranked_findings`` numbers them instead of sorting all rows."""
    return rows.orderBy(id_col, *_report_order())


def ranked_findings(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``no``: the place of a finding in its document's report, from 1; equal ones in any order."""
    return rows.withColumn("no", F.row_number().over(Window.partitionBy(id_col).orderBy(*_report_order())))
