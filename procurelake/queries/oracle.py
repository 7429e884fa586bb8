"""DuckDB SQL with the rows of the registered queries, written apart from the operators."""

from __future__ import annotations

from procurelake.packs import lexicons as L
from procurelake.packs.rules import COMMON_ID, DATED, DISCLOSURE, FAIRNESS, INDUSTRIES, LEVELS, MATCH_CITY, MATCH_INDUSTRY, MATCH_TYPE, STARRED_INDUSTRIES
from procurelake.queries import core

WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _q(value) -> str:
    """A literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]::VARCHAR[]"


def _values(rows: list, columns: str) -> str:
    return "(select * from (values " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + f") v({columns}))"


def _re2(pattern: str) -> str:
    """The pattern with plain word boundaries, as RE2 has them."""
    return _q(pattern.replace("{L}", r"\b").replace("{R}", r"\b"))


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _bare(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+', '', 'g')"


def _sentences(c: str, least: int) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[。；;！？\\n]+'), lambda s: {_trim('s')}), lambda s: length(s) >= {least})"


def _present(text: str, words) -> str:
    return f"list_filter({_list(words)}, lambda w: contains({text}, w))"


def _masked() -> tuple[str, str]:
    """Steps of masking as nested selects: the text after all kinds, and the matches of each kind."""
    sql = "select doc_id, text t0 from documents"
    for i, (_, p) in enumerate(L.PII):
        keep = ", ".join(f"m{k}" for k in range(i))
        sql = f"select doc_id, {keep + ', ' if keep else ''}coalesce(regexp_extract_all(t{i}, {_re2(p)}), []) m{i}, regexp_replace(t{i}, {_re2(p)}, '{L.PLACEHOLDER}', 'g') t{i + 1} from ({sql})"
    return sql, f"t{len(L.PII)}"


def _pii_mask() -> str:
    sql, last = _masked()
    return f"select doc_id, {last} masked_text, ({' + '.join(f'len(m{i})' for i in range(len(L.PII)))})::bigint n_matches from ({sql})"


def _pii_types() -> str:
    sql, _ = _masked()
    return "select type, sum(n)::bigint n from (" + " union all ".join(f"select {_q(k)} as type, len(m{i}) n from ({sql})" for i, (k, _) in enumerate(L.PII)) + ") where n > 0 group by type"


def _disclosure_rows(most: int | None = 200) -> str:
    """(doc_id, rule_id, pattern_no, place, match, ctx) of every hit that isn't excused, among ``most`` matches of a pattern or all."""
    parts, last = [], "len(m)" if most is None else f"least(len(m), {most})"
    for rule in [r for r in DISCLOSURE if r.detect == "text.pattern"]:
        for no, p in enumerate(rule.expect["patterns"]):
            excused = " and ".join(f"not contains(ctx, {_q(x)})" for x in rule.expect["exclude"]) or "true"
            parts.append(
                f"""select doc_id, '{rule.id}' rule_id, {no} pattern_no, i, match, ctx from (
  select doc_id, i, m[i] as match, substr(text, greatest(off - 25, 0) + 1, least(off, 25) + length(m[i]) + 25) ctx from (
    select doc_id, text, m, i, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as off
    from (select doc_id, text, regexp_extract_all(text, {_q(p)}) m, regexp_split_to_array(text, {_q(p)}) g from documents), unnest(range(1, {last} + 1)) t(i)))
where {excused}"""
            )
    return " union all ".join(parts)


def _squeeze(c: str) -> str:
    return _trim(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def _clauses(source: str, lists: dict, sentence: str) -> str:
    parts = []
    for name, (words, negative) in lists.items():
        no = f" and len({_present('s', negative)}) = 0" if negative else ""
        parts.append(f"select doc_id, '{name}' list_name, i - 1 as sent_no, s, ({_present('s', words)})[1:3] w from e where len({_present('s', words)}) > 0{no}")
    return f"with x as (select doc_id, {_sentences('text', 6)} l from {source}), e as (select doc_id, i, l[i] s from x, unnest(range(1, len(l) + 1)) t(i)) select doc_id, list_name, sent_no::bigint sent_no, {sentence}, array_to_string(w, '|') matched from (" + " union all ".join(parts) + ")"


def _fair(source: str, pack, extra: str = "") -> str:
    parts = []
    for r in pack:
        marks = "".join(f" || case when regexp_matches(s, {_q(p)}) then ['匹配：' || substr(regexp_extract(s, {_q(p)}), 1, 40)] else [] end" for p in r.patterns)
        parts.append(f"select doc_id, '{r.id}' rule_id, '{r.type}' as type, '{r.category}' category, (i - 1)::bigint sent_no, {_present('s', r.keywords)}{marks} w from e")
    return f"with x as (select doc_id, {_sentences('text', 6)} l from {source}), e as (select doc_id, i, l[i] s from x, unnest(range(1, len(l) + 1)) t(i)), h as (select * from (" + " union all ".join(parts) + f") where len(w) > 0) {extra}"


def _industry(source: str, pack) -> str:
    rows = ", ".join(f"({i}, {_q(n)}, {_q(k)}, {_list(w)})" for i, (n, k, w) in enumerate(pack))
    return f"""with p as (select * from (values {rows}) v(ord, name, pack_key, kw)),
h as (select doc_id, ord, name, pack_key, len(kw) total, list_filter(kw, lambda w: contains(text, w)) hit from {source}, p),
b as (select *, row_number() over (partition by doc_id order by len(hit) desc, ord) r from h where len(hit) > 0),
k as (select doc_id, array_to_string((flatten(list(hit order by ord)))[1:12], '|') matched from h where len(hit) > 0 group by 1)
select t.doc_id, coalesce(b.name, '未识别') as name, coalesce(b.pack_key, 'construction') pack_key, coalesce(floor(len(b.hit) / b.total::double * 100 + 0.5) / 100, 0)::double confidence, coalesce(k.matched, '') matched
from {source} t left join b on b.doc_id = t.doc_id and r = 1 left join k on k.doc_id = t.doc_id"""


def _amounts(text: str, pattern: str, most: int) -> str:
    num, unit = f"regexp_extract_all({text}, {_q(pattern)}, 1)", f"regexp_extract_all({text}, {_q(pattern)}, 2)"
    return f"list_transform(range(1, least(len({num}), {most}) + 1), lambda i: floor(({num})[i]::double * case when ({unit})[i] in ('亿', '亿元') then 1e8 when ({unit})[i] in ('万', '万元') then 1e4 else 1 end * 100 + 0.5) / 100)"


def _money(text: str, pattern: str) -> str:
    return f"coalesce(array_to_string(list_transform({_amounts(text, pattern, 3)}, lambda v: format('{{:.2f}}', v)), '|'), '')"


def _params(source: str | None = None) -> str:
    weights = ", ".join(f"regexp_extract(text, {_q(p)}, 1) w{i}" for i, p in enumerate(L.WEIGHTS.values()))
    return f"select doc_id, {weights}, try_cast(nullif(regexp_extract(text, {_q(L.DURATION)}, 1), '') as int) duration_days, {_money('text', L.BOND)} bond, {_money('text', L.CONTROL_PRICE)} control from {source or _values(core.TENDERS, 'doc_id, text')}"


def _verdict() -> str:
    return f"""with h as ({_disclosure_rows()}), r as (select doc_id, count(distinct rule_id) n from h group by 1)
select d.doc_id, case when coalesce(n, 0) > 0 then 'REJECT' else 'PASS' end verdict, greatest(0, 100 - least(15 * coalesce(n, 0), 60))::double score, coalesce(n, 0)::bigint reject from documents d left join r using (doc_id)"""


def _templates() -> str:
    rows = ", ".join(f"({_q(t.id)}, {_q(t.region)}, {_list(t.city)}, {_list(t.industry)}, {_list(t.tender_type)}, {LEVELS[t.level] / 10}::double, {_q(t.effective_from)}::date, {_q(t.effective_to)}::date)" for t in core.rules.active(core.rules.TEMPLATES) if t.id != COMMON_ID and t.status == "ACTIVE")
    requests = ", ".join("(" + ", ".join(f"{_q(x)}::date" if i == 5 else _q(x) for i, x in enumerate(r)) + ")" for r in core.REQUESTS)
    scope = lambda s, v: f"(list_contains({s}, '*') or ({v} <> '' and list_contains({s}, {v})))"
    points = lambda s, n: f"case when list_contains({s}, '*') then 0 else {n} end"
    return f"""with t as (select * from (values {rows}) v(template_id, region, cities, industries, types, lvl, f, u)),
q as (select * from (values {requests}) v(req_id, region, city, industry, tender_type, as_of)),
m as (select req_id, template_id, lvl + case when f is not null then {DATED} else 0 end + {points('cities', MATCH_CITY)} + {points('industries', MATCH_INDUSTRY)} + {points('types', MATCH_TYPE)} score, f
      from q, t where t.region in ('*', q.region) and (f is null or f <= as_of) and (u is null or u >= as_of)
      and {scope('cities', 'city')} and {scope('industries', 'industry')} and {scope('types', "coalesce(tender_type, '工程')")}),
b as (select *, row_number() over (partition by req_id order by score desc, f desc, template_id) r from m)
select q.req_id, b.template_id, b.score::double score from q left join b on b.req_id = q.req_id and r = 1"""


FINGERPRINTS = r"""e as (select doc_id, source, regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g') t from documents where length(regexp_replace(text, '\s', '', 'g')) >= 30),
g as (select doc_id, substr(t, i, 2) pair, count(*) n from e, unnest(range(1, length(t))) u(i) group by all),
h as (select doc_id, n, ('0x' || substr(md5(pair), 1, 16))::ubigint h from g),
s as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then n else -n end) v from h, unnest(range(0, 64)) u(b) group by all),
f as (select e.doc_id, e.source, coalesce(sum(case when v > 0 then (1::ubigint << b)::hugeint else 0 end), 0)::ubigint fp from e left join s using (doc_id) group by all)"""

BIDS = "select l_partkey group_id, l_orderkey * 10 + l_linenumber bid_no, l_extendedprice price from lineitem"


def _pattern() -> str:
    cases = [(-1, 0, 29.1e6), (-1, 1, 29.2e6), (-1, 2, 29.3e6), (-1, 3, 29.4e6), (-2, 0, 10.0), (-2, 1, 11.0), (-2, 2, 12.1), (-2, 3, 13.31), (-3, 0, 28.5e6), (-3, 1, 26.8e6), (-3, 2, 30.1e6), (-3, 3, 24.7e6), (-4, 0, 1.0), (-4, 1, 2.0), (-5, 0, 7.0), (-5, 1, 7.0), (-5, 2, 7.0)]
    return f"""with b as ({BIDS} union all select * from {_values(cases, 'group_id, bid_no, price')}),
l as (select group_id, price, price - lag(price) over w d, price / lag(price) over w r from b where price > 0 window w as (partition by group_id order by price, bid_no)),
s as (select group_id, count(*) n, min(d) least, case when avg(d) = 0 then null else stddev_pop(d) / avg(d) end cd, stddev_pop(r) / avg(r) cr from l group by 1),
k as (select *, n >= 3 and least > 0 and cd < 0.05 a, n >= 3 and cr < 0.01 g from s)
select group_id, n, coalesce(a or g, false) detected, case when a then '等差规律' when g then '等比规律' else '' end as type, case when a then round(cd, 6) when g then round(cr, 6) end cv from k"""


R2 = "floor(({}) * 100 + 0.5) / 100"


def _drop(n: int) -> str:
    return f"case when len(p) < {2 * n + 1} then {R2.format('list_sum(p) / len(p)')} else {R2.format(f'list_sum(p[{n + 1}:len(p) - {n}]) / (len(p) - {2 * n})')} end"


BASES = {
    "AVG_ALL": R2.format("list_sum(p) / len(p)"),
    "AVG_DROP": _drop(1),
    "AVG_DROP_LOWER": f"case when len(p) < 2 then {R2.format('list_sum(p) / len(p)')} else {R2.format('list_sum(p[2:]) / (len(p) - 1)')} end",
    "MIN_PRICE": "p[1]",
}
LINEAR = f"case when price = base_price then 100.0 when price > base_price then greatest(0, {R2.format('100 - (price - base_price) / base_price * 100 * 1.0')}) else greatest(0, {R2.format('100 - (base_price - price) / base_price * 100 * 0.5')}) end"


def _score(base: str, score: str, limit: bool = False) -> str:
    bids = "select b.*, p_retailprice * 40 control from b join part on p_partkey = group_id" if limit else "select *, null::double control from b"
    return f"""with b as ({BIDS}), c as ({bids}), g as (select group_id, list_sort(list(price)) p from c group by 1), a as (select group_id, {BASES[base]} base_price from g),
s as (select group_id, bid_no, price, base_price, case when price > control then 0 else ({score})::double end::double score from c join a using (group_id))
select *, (case when score > 0 then row_number() over (partition by group_id, score > 0 order by score desc, bid_no, price) else 0 end)::bigint as rank from s"""


def _matrix() -> str:
    each = " union all ".join(f"select group_id, '{a}' algorithm, ({BASES[a]})::double base_price from g" for a in ("AVG_ALL", "AVG_DROP", "AVG_DROP_LOWER", "MIN_PRICE"))
    return f"with b as ({BIDS}), g as (select group_id, list_sort(list(price)) p from b group by 1), a as ({each}) select group_id, algorithm, base_price, bid_no, price, ({LINEAR})::double score from b join a using (group_id)"


def _any(text: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _statuses(source: str, extra: dict[str, str] | None = None) -> str:
    """The twelve checks; ``extra`` has further columns by code, and for all other codes under ''."""
    extra = extra or {}
    starred = _list([*STARRED_INDUSTRIES, *[n for n, k, _ in INDUSTRIES if k in STARRED_INDUSTRIES]])
    t = "draft_text"
    status = {
        "P01": f"case when {_any(t, '签字', '签署', '签章')} and {_any(t, '盖章', '公章', '印鉴')} then 'PASS' else 'WARN' end",
        "P02": f"case when {_any(t, '联合体')} and not {_any(t, '联合体协议')} then 'WARN' else 'PASS' end",
        "P03": "'MANUAL'",
        "P04": "case when len(list_distinct(prices)) > 1 then 'REJECT_RISK' else 'PASS' end",
        "P05": "case when not coalesce(control > 0, false) or len(prices) = 0 then 'MANUAL' when list_max(prices) > control then 'REJECT_RISK' when list_min(prices) < control * 0.7 then 'WARN' else 'PASS' end",
        "P06": "'MANUAL'",
        "P07": "'MANUAL'",
        "P08": f"case when {_any(t, '保证金')} then 'PASS' else 'WARN' end",
        "P09": "'MANUAL'",
        "P10": "'MANUAL'",
        "P11": f"case when list_contains({starred}, coalesce(industry, '')) and {_any(t, '★')} then 'WARN' else 'PASS' end",
        "P12": "case when days > 0 and said is null then 'MANUAL' when days > 0 and said > days then 'REJECT_RISK' when not coalesce(days > 0, false) and said is null then 'WARN' else 'PASS' end",
    }
    base = f"select *, {_amounts(t, L.BID_PRICE, 8)} prices, try_cast(nullif(regexp_extract({t}, {_q(L.COMMITTED_DURATION)}, 1), '') as int) said from {source} where {_trim(t)} <> ''"
    return f"with d as ({base}) " + " union all ".join(f"select doc_id, '{c}' code, {s} status{extra.get(c, extra.get('', ''))} from d" for c, s in status.items())


def _cited(sections: str, citations: str) -> str:
    return f"""x as (select section_id, {_sentences('text', 8)} l from {sections}), e as (select section_id, i, l[i] s from x, unnest(range(1, len(l) + 1)) t(i)),
k as (select section_id, lower({_bare('u.tok')}) tok from {citations} c, unnest(regexp_extract_all(source || ' ' || content, {_q(L.CITATION)})) u(tok)),
f as (select *, regexp_matches(s, {_q(L.FACT_NUMBER)}) has_number from e where (regexp_matches(s, {_q(L.FACT_NUMBER)}) or regexp_matches(s, {_q(L.FACT_STANDARD)})) and not regexp_matches(s, {_q(L.NARRATIVE)})),
c as (select f.*, exists (select 1 from k where k.section_id = f.section_id and contains(lower({_bare('f.s')}), k.tok)) cited from f)"""


def _facts_check(facts: str | None = None, texts: str | None = None, more: str = "") -> str:
    q, u = _q(L.QUANTITY), _q(L.UNIT)
    unit = lambda c: f"regexp_extract({c}, {u}, 1)"
    return f"""with f as (select *, regexp_extract(expected, '(\\d+(?:\\.\\d+)?)', 1) num from {facts or _values(core.FACT_ROWS, 'doc_id, fact_key, expected')}),
t as (select doc_id, regexp_extract_all(text, {q}) m from {texts or _values(core.CHECKED_TEXT, 'doc_id, text')}),
h as (select {more}fact_key, expected, list_filter(m, lambda v: contains(v, num)) hit from f join t using (doc_id) where num <> '')
select {more}fact_key, expected, coalesce(hit[1], '') found_in_text, case when len(hit) = 0 then '缺失' when len(list_filter(hit, lambda v: {unit('v')} <> {unit('expected')})) = 0 then '一致' else '偏离' end verdict from h"""


def _extract_facts(source: str | None = None) -> str:
    rows = [(i, 0, t) for i, t in core.TENDERS] + [(1, 1, "混凝土设计强度等级为 C30，抗渗等级 W8，缺陷责任期 24 个月")]
    parts = " union all ".join(f"select project_id, {_q(k)} fact_key, {_trim(f'regexp_extract(t, {_q(p)})')} as value from x" for k, p in L.FACTS)
    return f"with x as (select project_id, string_agg(content, chr(10) order by ord) t from {source or _values(rows, 'project_id, ord, content')} group by 1) select * from ({parts}) where value <> ''"


def _compliance() -> str:
    off = "instr(lower(draft), lower(hit[1])) - 1"
    return f"""with r as (select doc_id project_id, item_id req_id, string_split(b.text, ' ')[1:5] k, coalesce(d.text, '') draft from documents d join benchmark b on d.doc_id % 7 = b.item_id % 7),
h as (select project_id, req_id, draft, len(k) n, list_filter(k, lambda w: contains(lower(draft), lower(w))) every, list_filter(k, lambda w: w <> '' and contains(lower(draft), lower(w))) hit from r),
s as (select *, n > 0 and len(every) >= greatest(1, n // 2) met, {off} p from h)
select project_id, req_id, case when met then '完全响应' else '缺失' end status,
       case when met and len(hit) > 0 then {_squeeze("substr(draft, greatest(p - 80, 0) + 1, least(p, 80) + length(hit[1]) + 80)")} else '' end evidence, len(every)::bigint n_hit from s"""


def _risk() -> str:
    return f"""with {FINGERPRINTS}, x as (select doc_id // 8 project, doc_id, fp from f),
p as (select a.project, bit_count(xor(a.fp, b.fp))::bigint d from x a join x b on a.project = b.project and a.doc_id < b.doc_id),
t as (select project, count(*) filter (d <= 3) high, count(*) filter (d > 3 and d <= 10) medium, max(d) max_distance from p group by 1),
pr as (select group_id project, detected as pattern from ({_pattern()}) where group_id >= 0),
k as (select doc_id // 8 project, count(*) filter (length({_bare("coalesce(text, '')")}) < 30) skipped_short from documents group by 1)
select k.project::bigint project_id, coalesce(high, 0)::bigint high, coalesce(medium, 0)::bigint medium, coalesce(max_distance, 0)::bigint max_distance, coalesce(pattern, false) as pattern,
       case when coalesce(high, 0) > 0 or coalesce(pattern, false) then 'HIGH' when coalesce(medium, 0) > 0 then 'MEDIUM' else 'LOW' end risk, skipped_short from k left join t using (project) left join pr using (project)"""


def _chunks() -> str:
    size, overlap, back = 6000, 400, 800
    line = "case when contains({p}, chr(10) || chr(10)) then length({p}) - instr(reverse({p}), chr(10) || chr(10)) - 1 else -1 end".replace("{p}", f"substr(text, 1, pos + {size} + 2)")
    stop = f"case when pos + {size} >= length(text) then length(text) when {line} > greatest(pos, pos + {size} - {back}) then {line} else pos + {size} end"
    return f"""with recursive c as (select doc_id, text, 0::bigint as chunk_no, 0::bigint as pos, ({stop.replace("pos", "0")})::bigint as e from documents where length(text) > 0
union all select doc_id, text, chunk_no + 1, pos, ({stop})::bigint from (select doc_id, text, chunk_no, greatest(e - {overlap}, pos + 1) as pos from c where e < length(text)))
select doc_id, chunk_no, e - pos as len, md5(substr(text, pos + 1, e - pos)) digest from c"""


def _flat() -> str:
    """The pack of the query, list by list."""
    return """with p as (select 'water' k, [{'t': '施工导流', 'c': '导流方案', 'g': ['导流']}, {'t': '度汛', 'c': '度汛方案', 'g': []}] outline, [{'t': '防渗墙', 'c': '工法', 'g': []::varchar[]}] methods)
select k || '/overview' doc_id, 'overview' kind, '水利水电' title, k tags, '概述' as content from p
union all select k || '/outline/' || (i - 1), 'outline', outline[i].t, array_to_string([k, 'outline'] || outline[i].g::varchar[], '|'), outline[i].c from p, unnest(range(1, len(outline) + 1)) u(i)
union all select k || '/methods/' || (i - 1), 'methods', methods[i].t, array_to_string([k, 'methods'] || methods[i].g::varchar[], '|'), methods[i].c from p, unnest(range(1, len(methods) + 1)) u(i)"""


def _geometry() -> str:
    """The inline documents with one paragraph each, against the limits of the provincial template."""
    names = "doc_id, font, size, color, rule, pt, indent, align, before, after, top, rest, pages"
    rows = [("good", "宋体", 14.0, "000000", "exact", 30.0, 2.0, "justify", 0.0, 0.0, 2.5, 2.0, 10), ("bad", "Arial", 12.0, "00FF00", None, None, 0.0, "left", 6.0, 0.0, 3.0, 2.0, 200), ("near", "宋体", 14.0, "000000", "exact", 30.0, 2.0, "justify", 0.0, 0.0, 2.5, 2.0, 110)]
    total, common = len(core.rules.effective_rules(core.rules.choose_template(core.date(2025, 1, 1), industry="工程"))), len(DISCLOSURE)
    reject = ["font not in ('宋体', 'SimSun')", "abs(size - 14) > 0.01", "coalesce(rule <> 'exact' or abs(pt - 30) > 0.5, true)", "abs(top - 2.5) > 0.05 or abs(rest - 2) > 0.05", "color not in ('000000', 'auto', '')", "pages > 125"]
    warn = ["pages > 100 and pages <= 125", "abs(indent - 2) > 0.3", "align <> 'justify'", "abs(before) > 0.5 or abs(after) > 0.5"]
    n = lambda conditions: " + ".join(f"({c})::int" for c in conditions)
    return f"""with d as (select *, {n(reject)} reject, {n(warn)} warn from {_values(rows, names)}),
e as (select doc_id, {total} checked, 0 skipped, reject, warn from d union all select 'none', {common}, {total - common}, 0, 0)
select doc_id, case when reject > 0 then 'REJECT' when warn > 0 then 'WARN' else 'PASS' end verdict, greatest(0, 100 - least(15 * reject, 60) - least(3 * warn, 30))::double score, {total} rule_count, checked, skipped, reject, warn, 0 info, reject + warn rules_triggered from e"""


ORACLE_SQL = {
    "pii_mask": _pii_mask(),
    "pii_type_counts": _pii_types(),
    "disclosure_hits": f"select doc_id, rule_id, pattern_no, row_number() over (partition by doc_id, rule_id order by pattern_no, i) hit_no, match, {_squeeze('ctx')} context from ({_disclosure_rows()})",
    "sentence_stats": f"with x as (select doc_id, {_sentences('text', 6)} l from documents), e as (select doc_id, unnest(l) s from x) select doc_id, count(*) n_sentences, max(length(s)) longest, sum(length(s))::bigint n_chars from e group by 1",
    "clause_match": _clauses("documents", core.LATIN_CLAUSES, "length(s) len"),
    "clause_match_cn": _clauses(_values(core.TENDERS, "doc_id, text"), L.CLAUSES, "s sentence"),
    "fairness_hits": _fair("documents", core.LATIN_FAIRNESS, "select doc_id, rule_id, sent_no, array_to_string(w, '|') matched from h"),
    "fairness_cn": _fair(_values(core.TENDERS, "doc_id, text"), FAIRNESS, "select doc_id, rule_id, type, category, sent_no, array_to_string(w, '|') matched from h"),
    "fairness_summary": _fair("documents", core.LATIN_FAIRNESS, "select doc_id, count(*) total_hits, count(*) filter (type = 'HARD') hard_count, count(*) filter (type = 'SOFT') soft_count from h group by 1"),
    "industry_detect": _industry(_values(core.TENDERS, "doc_id, text"), INDUSTRIES),
    "industry_docs": _industry("documents", core.LATIN_INDUSTRIES),
    "constraint_params": _params(),
    "rule_verdict": _verdict(),
    "template_match": _templates(),
    "simhash_pairs": f"with {FINGERPRINTS}, d as (select a.source, a.doc_id, b.doc_id other, bit_count(xor(a.fp, b.fp)) n from f a join f b on a.source = b.source) select source, doc_id, min(other) filter (n = 0) class_id, count(*) filter (n <= 3) - 1 n_high, count(*) filter (n between 4 and 10) n_medium from d group by all",
    "simhash_groups": f"with recursive {FINGERPRINTS}, n as (select a.doc_id a, b.doc_id b from f a join f b on bit_count(xor(a.fp, b.fp)) <= 3), r as (select a, b from n union select r.a, n.b from r join n on r.b = n.a) select a doc_id, min(b) group_id from r group by 1 having count(*) > 1",
    "price_pattern": _pattern(),
    "price_score_linear": _score("AVG_DROP", LINEAR),
    "price_score_lowest": _score("MIN_PRICE", f"greatest(0, {R2.format('100 * (base_price / price)')})"),
    "price_score_ratio": _score("AVG_ALL", f"greatest(0, {R2.format('least(100.0, 100 * (base_price / price))')})"),
    "price_score_reasonable": _score("AVG_DROP", f"case when price >= base_price * (1 - 0.05::double) and price <= base_price * (1 + 0.03::double) then 100.0 when price < base_price * (1 - 0.05::double) then greatest(0, {R2.format('100 - (base_price * (1 - 0.05::double) - price) / base_price * 100 * 2.0')}) else greatest(0, {R2.format('100 - (price - base_price * (1 + 0.03::double)) / base_price * 100 * 2.0')}) end", limit=True),
    "price_matrix": _matrix(),
    "precheck_items": _statuses(_values(core.DRAFTS, "doc_id, draft_text, control, days, industry")),
    "precheck_summary": "select doc_id, count(*) filter (status = 'PASS') pass, count(*) filter (status = 'WARN') warn, count(*) filter (status = 'REJECT_RISK') reject_risk, count(*) filter (status = 'MANUAL') manual from (" + _statuses("(select doc_id, text draft_text, null::double control, null::int as days, '' as industry from documents)") + ") group by 1",
    "fact_check": f"with {_cited(_values(core.SECTIONS, 'section_id, text'), _values(core.CITATIONS, 'section_id, source, content'))} select section_id, (i - 1)::bigint as index, has_number, cited, case when cited then '已引用' else '待人工补充' end status from c",
    "fact_check_docs": f"with {_cited('(select doc_id section_id, text from documents)', chr(40) + 'select item_id section_id, ' + chr(39) * 2 + ' source, text as content from benchmark)')} select x.section_id, len(x.l)::bigint total_sentences, count(c.s) factual_sentences, count(c.s) filter (c.cited) cited, count(c.s) filter (not c.cited) uncited from x left join c using (section_id) group by 1, 2",
    "facts_check": _facts_check(),
    "extract_facts": _extract_facts(),
    "compliance": _compliance(),
    "rule_categories": f"select doc_id, 'DISCLOSURE' category, count(distinct rule_id)::bigint reject, 0::bigint warn, 0::bigint info from ({_disclosure_rows()}) group by 1",
    "leak_summary": f"select doc_id, rule_id, count(*) n from ({_disclosure_rows()}) group by 1, 2",
    "constraints_docs": f"with x as (select doc_id, text, {_sentences('text', 6)} l from documents) select doc_id, try_cast(nullif(regexp_extract(text, {_q(L.DURATION)}, 1), '') as int) duration_days, length(text) n_chars, len(l) sentence_count, " + ", ".join(f"len(list_filter(l, lambda s: len({_present('s', w)}) > 0 and len({_present('s', n)}) = 0)) {k}_count" for k, (w, n) in core.LATIN_CLAUSES.items()) + " from x",
    "collusion_risk": _risk(),
    "facts_merged": "select doc_id project_id, unnest(['lang', 'source']) fact_key, unnest([coalesce(lang, ''), case when n_chars > 500 then upper(coalesce(source, '')) else coalesce(source, '') end]) as value from documents union all select doc_id, 'size', n_chars::varchar from documents where n_chars > 500",
    "requirements_normalized": f"with x as (select doc_id, {_trim('text')} t, string_split(text, ' ') k, case when doc_id % 3 = 0 then '资质门槛' when list_contains({_list(L.CATEGORIES)}, source) then source else '商务条款' end category from documents) select doc_id tender_id, 'R001' id, category, md5(t) digest, list_contains({_list(L.MANDATORY)}, category) mandatory, array_to_string(k[1:5], '|') keywords from x where length(t) >= 4",
    "industry_packs": _industry("documents", core.LATIN_INDUSTRIES),
    "score_table": f"select group_id, count(*) filter (rank > 0) n_ranked, max(rank) last_rank, max(score) best from ({_score('AVG_DROP', LINEAR)}) group by 1",
    "geometry_verdict": _geometry(),
    "kb_flatten": _flat(),
    "chunk_text": _chunks(),
    "requirement_dedup": f"with i as (select conv_id % 11 tender_id, conv_id chunk_no, turn item_no, substr({_bare('text')}, 1, 40) k from conversations), f as (select *, row_number() over (partition by tender_id, k order by chunk_no, item_no) n from i) select tender_id, chunk_no, item_no, format('R{{:03d}}', row_number() over (partition by tender_id order by chunk_no, item_no)) id from f where n = 1",
    "chunk_fixed": "select doc_id, i::bigint chunk_no, md5(substr(text, i * 900 + 1, 1000)) digest, length(substr(text, i * 900 + 1, 1000)) len from documents, unnest(range(0, greatest(ceil((length(text) - 100) / 900.0), 1)::bigint)) t(i) where length(text) > 0",
    "hybrid_topk": "with q as (select * from embeddings where vec_id % 100 = 0), s as (select q.vec_id query_id, d.vec_id doc_id, 0.3 * list_cosine_similarity(q.embedding::double[], d.embedding::double[]) + 0.7 * case when q.label = d.label then 1 else 0 end similarity from q, embeddings d), r as (select *, row_number() over (partition by query_id order by similarity desc, doc_id) as rank from s where similarity >= 0.2) select query_id, doc_id, round(similarity, 6) similarity, rank from r where rank <= 8",
    "event_windows": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2",
}
