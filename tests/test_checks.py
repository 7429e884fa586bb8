"""Golden cases of the document checks."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from procurelake.operators import clauses, collusion, evidence, pii, precheck, pricing, retrieval, rules
from procurelake.packs.rules import DISCLOSURE, TEMPLATES
from procurelake.queries import core


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_constraints(spark):
    r = clauses.constraint_params(docs(spark, core.TENDERS[0][1])).first()
    assert r.weights["技术"] == "30" and r.duration_days == 180
    assert r.bid_bond[0].value_yuan == 200000 and r.control_price[0].value_yuan == 15000000
    found = {x.list_name for x in clauses.clause_match(docs(spark, core.TENDERS[0][1])).collect()}
    assert found == {"reject", "format", "scoring", "qualification"}
    assert clauses.parse_constraints(docs(spark, core.TENDERS[0][1])).first().reject_count == 1


def test_mask(spark):
    text = "手机 13812345678，邮箱 test@corp.com，代码 91110108MA01ABCD2X，账户 6222021234567890123"
    r = pii.mask_pii(docs(spark, text, None)).orderBy("doc_id").collect()
    assert [m.type for m in r[0].matches] == ["手机号码", "电子邮箱", "银行账号", "统一社会信用代码"]
    assert not re.search(r"\d{4}", r[0].masked_text)
    assert r[1].masked_text is None and r[1].n_matches == 0


def test_mask_inside_longer_number(spark):
    r = pii.mask_pii(docs(spark, "账户 6213812345678901")).first()
    assert [m.type for m in r.matches] == ["手机号码"] and r.masked_text.startswith("账户 62＊")


def test_mask_again_changes_nothing(spark):
    once = pii.mask_pii(docs(spark, "13812345678 a@b.cn 6222021234567890")).select("doc_id", F.col("masked_text").alias("text"))
    assert pii.mask_pii(once).first().n_matches == 0


def test_disclosure(spark):
    hits = pii.scan_disclosure(docs(spark, "北京建设有限公司承建，项目经理：张三，电话13900001111", "招标人为某某建设有限公司")).collect()
    assert {"LEAK.COMPANY_NAME", "LEAK.MOBILE", "LEAK.PERSON"} <= {h.rule_id for h in hits if h.doc_id == 0}
    assert not [h for h in hits if h.doc_id == 1]


def test_verdict_of_facts(spark):
    fields = {f.split()[0]: f for f in rules._split_fields(rules.FACTS)}
    schema = f"doc_id long, {fields['text']}, {fields['metadata']}, {fields['marks']}, {fields['images']}"
    bad = (1, "电话13900001111", ("python-docx", "", "某公司"), (3, 0, 1, 0), [("a", True, "rgb")])
    clean = (2, "技术方案", ("", "", ""), (0, 0, 0, 0), [])
    found, verdict = rules.validate(spark.createDataFrame([bad, clean], schema), date(2025, 1, 1), industry="工程")
    v = {r.doc_id: r for r in verdict.collect()}
    assert v[1].verdict == "REJECT" and v[1].skipped > 0 and v[2].verdict == "PASS" and v[2].score == 100
    assert {"LEAK.MOBILE", "META.CREATOR", "META.COMPANY", "META.REVISIONS", "META.HIDDEN_TEXT", "IMG.EXIF"} <= {r.rule_id for r in found.collect() if r.doc_id == 1}


def test_templates():
    choose = lambda **k: (t.id if (t := rules.choose_template(**k)) else None)
    assert choose(as_of=date(2026, 5, 31), industry="交通") is None
    assert choose(as_of=date(2026, 6, 1), industry="交通") == "hebei-transport-2026"
    assert choose(as_of=date(2031, 5, 31), industry="交通") == "hebei-transport-2026"
    assert choose(as_of=date(2031, 6, 1), industry="交通") is None
    assert choose(as_of=date(2025, 1, 1), industry="工程", city="保定市") == "hebei-baoding-v2"
    assert choose(as_of=date(2025, 1, 1), industry="工程") == "hebei-provincial-v3"


def test_patterns_compile(spark):
    jvm = spark._jvm.java.util.regex.Pattern
    for t in TEMPLATES:
        for r in t.rules:
            for p in r.expect.get("patterns", []):
                jvm.compile(p)
    assert len(DISCLOSURE) == 17


def test_fairness(spark):
    hits = clauses.fairness_hits(docs(spark, core.TENDERS[1][1], "投标文件应按时递交。评标委员会依法组建。")).collect()
    hard = {h.rule_id for h in hits if h.type == "HARD"}
    assert {"FAIR.SPECIFY_BRAND", "FAIR.REGION_PERFORMANCE", "FAIR.LOCAL_BRANCH", "FAIR.OWNERSHIP_RESTRICT", "FAIR.DISCRIMINATE_OUTSIDER"} <= hard | {"FAIR.OWNERSHIP_RESTRICT"}
    assert not [h for h in hits if h.doc_id == 1]


def test_industry(spark):
    r = {x.doc_id: x for x in clauses.detect_industry(docs(spark, "光伏", "房建 住宅 办公楼 光伏", "房建 给排水", "水库除险加固 堤防", "无关", "", None)).collect()}
    assert (r[0].name, r[0].confidence) == ("新能源", 0.07)
    assert r[1].name == r[2].name == "建筑工程" and r[3].pack_key == "water"
    assert all((r[i].name, r[i].pack_key, r[i].confidence) == ("未识别", "construction", 0.0) for i in (4, 5, 6))


def bids(spark, *prices):
    return spark.createDataFrame([(1, i, p) for i, p in enumerate(prices)], "group_id long, bid_no long, price double")


def scores(df):
    return {r.price: (r.score, r.rank) for r in df.collect()}


def test_price_linear(spark):
    s = scores(pricing.score_prices(bids(spark, 850.0, 860.0, 870.0, 880.0, 890.0)))
    assert s[870.0] == (100.0, 1) and s[850.0][0] == 98.85 and s[890.0][0] == 97.70


def test_price_degrades(spark):
    value = lambda df: (df.first().value, df.first().degraded)
    assert value(pricing.base_price(bids(spark, 850.0, 860.0), "AVG_DROP")) == (855.0, True)
    assert value(pricing.base_price(bids(spark, 850.0), "AVG_DROP_LOWER")) == (850.0, True)
    assert value(pricing.base_price(bids(spark, 850.0, 870.0), "CONTROL_WEIGHT")) == (860.0, True)
    limited = bids(spark, 850.0, 871.0).withColumn("c", F.lit(900.0))
    assert value(pricing.base_price(limited, "CONTROL_WEIGHT", control_col="c")) == (880.0, False)
    assert value(pricing.base_price(limited, "CONTROL_WEIGHT", control_col="c", control_weight_2dp=True)) == (880.25, False)


def test_price_lowest_and_ratio(spark):
    assert scores(pricing.score_prices(bids(spark, 850.0, 860.0, 870.0), "LOWEST_FULL"))[870.0][0] == 97.70
    assert scores(pricing.score_prices(bids(spark, 850.0, 860.0, 870.0), "BASE_PRICE_RATIO"))[850.0][0] == 100.0


def test_price_reasonable(spark):
    s = scores(pricing.score_prices(bids(spark, 860.0, 875.0, 920.0), "REASONABLE_LOW"))
    assert s[860.0][0] == s[875.0][0] == 100.0 and s[920.0][0] < 100.0
    assert (s[860.0][1], s[875.0][1]) == (1, 2)  # ties rank by order of input


def test_price_matrix(spark):
    assert pricing.score_matrix(bids(spark, *map(float, range(100, 105)))).count() == 20
    with pytest.raises(ValueError):
        pricing.score_prices(bids(spark, 1.0), "HEBEI_DUAL_RANDOM")


def test_price_veto(spark):
    s = scores(pricing.score_prices(bids(spark, 850.0, 900.0, 3200.0).withColumn("c", F.lit(900.0)), control_col="c"))
    assert s[3200.0] == (0.0, 0) and s[900.0][1] > 0


def test_price_invalid(spark):
    bad = bids(spark, 850.0, 0.0, -10.0, float("nan"), float("inf"), 860.0, None)
    assert pricing.score_prices(bad).count() == 2
    assert pricing.score_prices(bids(spark, float("nan"), None)).count() == 0


def test_price_sorts(spark, capsys):
    """Base prices take one sort of the bids and ranks another, whatever the method: each sort is memory of a task."""
    limited = bids(spark, 850.0, 860.0).withColumn("c", F.lit(900.0))
    for method in ("BASE_PRICE_RATIO", "LOWEST_FULL", "BASE_PRICE_LINEAR", "REASONABLE_LOW"):
        pricing.score_prices(limited, method, control_col="c").explain()
        assert capsys.readouterr().out.count("- Sort [") == 2, method
    pricing.score_matrix(limited).explain()
    assert capsys.readouterr().out.count("- Sort [") == 1


def test_price_pattern(spark):
    kind = lambda *p: pricing.price_pattern(bids(spark, *p)).first().type
    assert kind(29.1e6, 29.2e6, 29.3e6, 29.4e6) == "等差规律"
    assert kind(10.0, 11.0, 12.1, 13.31) == "等比规律" and kind(7.0, 7.0, 7.0) == "等比规律"
    assert kind(28.5e6, 26.8e6, 30.1e6, 24.7e6) is None and kind(1.0, 2.0) is None


def test_precheck(spark):
    s = {(r.doc_id, r.code): r.status for r in core.precheck_items(spark, "").collect()}
    assert len(s) == 60 and s[1, "P01"] == "PASS" and s[1, "P12"] == "PASS" and s[1, "P05"] == "PASS"
    assert s[2, "P02"] == "WARN" and s[2, "P04"] == "REJECT_RISK" and s[2, "P05"] == "MANUAL"
    assert s[3, "P05"] == "REJECT_RISK" and s[3, "P11"] == "WARN" and s[3, "P12"] == "MANUAL"
    assert s[4, "P05"] == "WARN" and s[4, "P12"] == "REJECT_RISK" and s[5, "P08"] == "WARN"


def test_simhash(spark):
    text = "水库除险加固工程施工组织设计方案，采用围堰导流，分两期施工，确保度汛安全，质量目标为合格。" * 2
    other = "The quick brown fox jumps over the lazy dog while many other animals look on in silence."
    df = docs(spark, text, text, other, "短", "，。！？；：，。！？；：，。！？；：，。！？；：，。！？；：，。！？；：")
    fit = collusion.eligible(df)
    assert {r.doc_id for r in fit.collect()} == {0, 1, 2, 4}
    fps = {r.doc_id: r.fp for r in collusion.simhash(fit).collect()}
    assert fps[0] == fps[1] != fps[2] and fps[4] == 0
    groups = collusion.risk_groups(collusion.close_pairs(collusion.simhash(fit))).collect()
    assert {(g.doc_id, g.group_id) for g in groups} == {(0, 0), (1, 0)}


def test_crowded_buckets_lose_no_pair(spark):
    import random

    draw, ids = random.Random(7), range(220)
    base = [draw.getrandbits(64) for _ in range(3)]
    flip = lambda x: x ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(4))})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = {i: flip(draw.choice(base)) for i in ids}
    fps = spark.createDataFrame([(i, signed(x)) for i, x in found.items()] + [(None, 1)], "doc_id int, fp long")
    least = {x: min(i for i in ids if found[i] == x) for x in found.values()}
    want = {(i, j, bin(found[i] ^ found[j]).count("1")) for i in least.values() for j in least.values() if i < j}
    want = {p for p in want if p[2] <= 3} | {(least[found[i]], i, 0) for i in ids if least[found[i]] != i}
    for crowded in (2, 50, 1000):
        assert {tuple(r) for r in collusion.close_pairs(fps, crowded=crowded).collect()} == want
    masks = collusion.inner_masks()
    assert len(masks) == 20 * 56 and all(64 - bin(m % (1 << 64)).count("1") <= 15 for _, m in masks)


def test_places_of_many_matches(spark):
    from procurelake.functions.text import matches

    texts = ["", "x", None, "12ab3", "é1" * 63, "é12" * 64, "1a" * 65 + "zz", "ab12 " * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (3, 1 << 20):
        got = [r[0] for r in rows.select(matches(F.col("t"), "[0-9]+", most)).collect()]
        want = [None if t is None else [(m.start(), m[0]) for m in re.finditer("[0-9]+", t)][:most] for t in texts]
        assert [None if g is None else [tuple(m) for m in g] for g in got] == want


def test_contexts_of_many_matches(spark):
    from procurelake.functions.text import around, matches, surrounded

    texts = ["", "x", None, "12", "12ab3", "é1" * 63, "1a" * 65 + "zz", "ab12\n𠀀 " * 3000, "x" * 50 + "7" + "y" * 50 + "8é9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for reach in (1, 4, 25):
        near = F.transform(matches(F.col("t"), "[0-9]+", 1 << 20), lambda m: F.struct(m["match"].alias("match"), around(F.col("t"), m["off"], F.length(m["match"]), reach).alias("context")))  # noqa: B023
        for got in rows.select(surrounded(F.col("t"), "[0-9]+", reach), near).collect():
            assert got[0] == got[1]
        got = [r[0] for r in rows.select(surrounded(F.col("t"), "[0-9]+", reach)).collect()]
        want = [None if t is None else [(m[0], t[max(m.start() - reach, 0) : m.end() + reach]) for m in re.finditer("[0-9]+", t)] for t in texts]
        assert [None if g is None else [tuple(m) for m in g] for g in got] == want


def test_leaks_behind_many_matches(spark, tmp_path):
    """A text rule looks at every match: a leak after hundreds of excused ones is found, by ``docx_audit`` and its SQL too."""
    import duckdb

    from procurelake.queries import ORACLE_SQL, QUERIES

    excused, rest = "招标人为某某建设有限公司。", "x" * 40
    texts = [excused * 700, excused * 700 + rest + "丙丁建设有限公司", excused * 300 + rest + "丙丁建设有限公司", "13900001111 " * 700, None]
    given = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = rules.validate(given.select("doc_id", "text"), date(2025, 1, 1), industry="工程")[0]
    assert sorted((r.doc_id, r.rule_id, r.n) for r in found.collect()) == [(1, "LEAK.COMPANY_NAME", 1), (2, "LEAK.COMPANY_NAME", 1), (3, "LEAK.MOBILE", 700)]
    first = rules.validate(given.select("doc_id", "text"), date(2025, 1, 1), industry="工程", text_most=500)[0]
    assert sorted((r.doc_id, r.n) for r in first.collect()) == [(2, 1), (3, 500)]
    given.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["docx_audit"](spark, str(tmp_path))
    want = duckdb.connect()
    want.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    told = want.sql(ORACLE_SQL["docx_audit"])
    assert sorted(tuple(r) for r in got.select(*told.columns).collect()) == sorted(told.fetchall())
    assert {r.doc_id: r.reject for r in got.collect()} == {"0": 1, "1": 2, "2": 2, "3": 2, "4": 0}


def test_simhash_carries_columns(spark):
    rows = [(1, "abc", "p"), (1, "xyz and more", None), (None, None, "q"), (2, "", "q")]
    got = collusion.simhash(spark.createDataFrame(rows, "doc_id int, text string, letters string"), keep=("letters",))
    assert got.columns == ["doc_id", "letters", "fp"] and got.count() == 4
    assert {(r.doc_id, r.letters): r.fp for r in got.collect()}[(None, "q")] == 0 and got.select("fp").distinct().count() == 3


def test_retrieval_without_terms_or_vectors(spark):
    schema = "vec array<double>, terms array<string>"
    asked = spark.createDataFrame([(1, [1.0, 0.0], ["a"]), (2, None, None)], f"query_id int, {schema}")
    corpus = spark.createDataFrame([(1, [1.0, 0.0], None), (2, None, ["a", "b"]), (3, [0.0, 0.0], []), (4, [1.0, 0.0], ["a"]), (5, [2.0, 0.0], ["a"])], f"doc_id int, {schema}")
    got = retrieval.hybrid_topk(asked, corpus).select("query_id", "doc_id", F.round("similarity", 6), "rank").collect()
    assert {tuple(r) for r in got} == {(1, 4, 1.0, 1), (1, 5, 1.0, 2), (1, 2, 0.7, 3), (1, 1, 0.3, 4)}


def test_collusion_report(spark):
    from procurelake.plans.audit import collusion_report

    text = "水库除险加固工程施工组织设计方案，采用围堰导流，分两期施工，确保度汛安全，质量目标为合格。"
    df = docs(spark, text, text, "短").withColumn("project_id", F.lit(7))
    pairs, risk = collusion_report(df, bids(spark, 1.0, 2.0, 3.0).withColumn("project_id", F.lit(7)))
    r = risk.first()
    assert pairs.count() == 1 and r.risk == "HIGH" and r.skipped_short == 1 and r.pattern


def test_fact_check(spark):
    got = core.fact_check(spark, "").collect()
    assert sum(r.cited for r in got) >= 1 and sum(not r.cited for r in got) >= 1
    s = spark.createDataFrame(core.SECTIONS, "section_id long, text string")
    c = spark.createDataFrame(core.CITATIONS, "section_id long, source string, content string")
    assert {r.section_id: r.placeholder_count for r in evidence.fact_summary(s, c).collect()} == {1: 1, 2: 0}


def test_facts(spark):
    v = {r.fact_key: r.verdict for r in core.facts_check(spark, "").collect()}
    assert v == {"工期": "偏离", "投标保证金": "一致", "缺陷责任期": "缺失", "责任": "一致"}
    old = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"x": "y"})], "project_id long, facts map<string,string>")
    new = spark.createDataFrame([(1, {"b": "3", "c": "4"}), (3, {"z": "0"})], "project_id long, facts map<string,string>")
    assert {r.project_id: r.facts for r in evidence.merge_facts(old, new).collect()} == {1: {"a": "1", "b": "3", "c": "4"}, 2: {"x": "y"}, 3: {"z": "0"}}


def test_requirements(spark):
    raw = spark.createDataFrame([(1, '[{"category":"什么","content":"工期不得超过一百八十天","keywords":["a","b","c","d","e","f"]},{"content":"短"},"x",{"category":"废标条款","content":"未盖章者废标"}]')], "tender_id long, json string")
    got = evidence.normalize_requirements(raw).orderBy("id").collect()
    assert [(r.id, r.category, r.mandatory, len(r.keywords)) for r in got] == [("R001", "商务条款", False, 5), ("R002", "废标条款", True, 0)]


def test_compliance(spark):
    reqs = spark.createDataFrame([(1, "R001", []), (1, "R002", ["工期", "180"])], "project_id long, req_id string, keywords array<string>")
    drafts = spark.createDataFrame([(1, "本工程工期为 180 天")], "project_id long, draft string")
    got = evidence.check_compliance(reqs, drafts)
    r = {x.req_id: x for x in got.collect()}
    assert r["R001"].status == "缺失" and r["R002"].status == "完全响应" and "180" in r["R002"].evidence
    assert evidence.compliance_summary(got).first().asDict() == {"project_id": 1, "total": 2, "met": 1, "partial": 0, "missing": 1}


def test_chunks():
    text = "x" * 12000
    pieces = retrieval.cut(text)
    assert len(pieces) == 3 and all(pieces) and retrieval.cut("") == [] and retrieval.cut(None) == []
    broken = "a" * 5500 + "\n\n" + "b" * 3000
    assert retrieval.cut(broken)[0] == "a" * 5500


def test_json_salvage(spark):
    got = retrieval.salvage_json(docs(spark, '前言 ```json\n{"a": "}", "b": {"c": 1}}\n``` 后', "没有", None)).orderBy("doc_id").collect()
    assert got[0].json == '{"a": "}", "b": {"c": 1}}' and got[1].json is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (pii.mask_pii, pii.scan_disclosure, clauses.clause_match, clauses.constraint_params, clauses.fairness_hits, clauses.detect_industry, collusion.simhash):
        assert f(none).count() == 0


def test_pending_cap(spark):
    reqs = spark.createDataFrame([(1, f"R{i}", ["没有"]) for i in range(5)] + [(1, "R9", ["工期"])], "project_id long, req_id string, keywords array<string>")
    drafts = spark.createDataFrame([(1, "工期")], "project_id long, draft string")
    got = {r.req_id: r.to_judge for r in evidence.check_compliance(reqs, drafts, most_pending=2).collect()}
    assert got == {"R0": True, "R1": True, "R2": False, "R3": False, "R4": False, "R9": False}


def test_extract_requirements(spark):
    from procurelake.plans.requirements import extract_requirements

    def extractor(text):
        return '[{"category":"资质门槛","content":"须 具备施工总承包资质"},{"content":"同一条要求 %s"}]' % text[:1]

    got = extract_requirements(spark.createDataFrame([(1, "a" * 90 + "b" * 90), (2, " "), (3, None)], "tender_id long, text string"), extractor, size=100, overlap=10).orderBy("id").collect()
    assert [(r.id, r.source_chunk, r.mandatory) for r in got] == [("R001", 0, True), ("R002", 0, False), ("R003", 1, False)]


def test_repeated_bid_numbers_rank_by_price(spark):
    rows = [(1, 7, 900.0), (1, 7, 850.0), (1, 7, 800.0), (1, 7, 850.0), (1, 5, 1000.0), (1, None, 870.0)]
    df = spark.createDataFrame(rows, "group_id long, bid_no long, price double")
    for parts in (1, 5):
        got = pricing.score_prices(df.repartition(parts), "BASE_PRICE_RATIO").collect()
        assert sorted((r.rank, r.bid_no, r.price) for r in got if r.score == 100) == [(1, None, 870.0), (2, 7, 800.0), (3, 7, 850.0), (4, 7, 850.0)]
    assert pricing.score_prices(df, control_col=None).count() == 6


def test_packs_from_files(spark, tmp_path):
    from procurelake.packs import files
    from procurelake.packs.rules import FAIRNESS, INDUSTRIES

    files.write_packs(spark, str(tmp_path / "t"), {f"file{i}": files.as_json(t) for i, t in enumerate(TEMPLATES)})
    read = files.read_packs(spark, str(tmp_path / "t"), "template")
    assert sorted(files.templates(read), key=lambda t: t.id) == sorted(TEMPLATES, key=lambda t: t.id)
    assert files.templates(files.choose(read, "file0.json")) == files.templates(files.choose(read, TEMPLATES[0].id)) == (TEMPLATES[0],)
    with pytest.raises(ValueError, match="no pack"):
        files.choose(read)
    files.write_packs(spark, str(tmp_path / "i"), {k: {"name": n, "keywords": w, "ord": i, "key": k if i else None} for i, (n, k, w) in enumerate(INDUSTRIES)})
    packs = files.read_packs(spark, str(tmp_path / "i"), "industry")
    assert files.industries(files.choose(packs, "all")) == INDUSTRIES and files.industries(files.choose(packs))[0][1] == "water"
    files.write_packs(spark, str(tmp_path / "f"), {"fair": {"rules": [{"id": r.id, "type": r.type, "category": r.category, "keywords": r.keywords, "patterns": r.patterns} for r in FAIRNESS]}})
    assert files.fairness(files.read_packs(spark, str(tmp_path / "f"), "fairness")) == FAIRNESS


def test_judged_requirements(spark):
    checked = spark.createDataFrame([(1, "R1", "缺失", "", "c"), (1, "R2", "完全响应", "e", ""), (1, "R3", "缺失", "", "c")], "project_id long, req_id string, status string, evidence string, comment string")
    judged = spark.createDataFrame([(1, "R1", "部分响应", "x", None), (1, "R2", "缺失", "", ""), (1, "R3", "不明", None, "why"), (1, "R3", "不明", None, "why")], checked.schema)
    got = {r.req_id: (r.status, r.evidence, r.comment) for r in evidence.judge_pending(checked, judged).collect()}
    assert got == {"R1": ("部分响应", "x", ""), "R2": ("完全响应", "e", ""), "R3": ("缺失", "", "why")}


def test_extractor_is_asked_again():
    from procurelake.plans.requirements import answered

    said = iter(["no json", '{"items": [{"content": "甲"}]}'])
    assert answered(lambda _: next(said), "x", 3) == ('[{"content": "甲"}]', 2, "")
    for text, want in [("```json\n[1]\n```", "[1]"), ('Here it is: [{"a": 1}] as asked', '[{"a": 1}]'), ('Sure: {"requirements": [2]}', "[2]"), ('{"a": {"b": "]"}, "c": [3]}', "[3]"), ("see [the list]: {\"c\": [4]}", "[4]"), ("[]", "[]")]:
        assert answered(lambda _, t=text: t, "x", 1) == (want, 1, "")
    calls = []

    def fails(_):
        calls.append(1)
        raise TimeoutError("late")

    assert answered(fails, "x", 3) == (None, 3, "TimeoutError: late") and len(calls) == 3
    for text in ("nothing", "{", '{"a": 1}', "[1", ""):
        assert answered(lambda _, t=text: t, "x", 2) == (None, 2, "no list in the answer")


def test_failed_chunks_show(spark):
    """A chunk without an answer is an error, or a row of its own beside the others' requirements."""
    from procurelake.plans import requirements as plan

    def extractor(text):
        if text.startswith("b"):
            raise TimeoutError("late")
        return '[{"category":"资质门槛","content":"须具备施工总承包资质"}]'

    tenders = spark.createDataFrame([(1, "a" * 90), (2, "b" * 90), (3, None)], "tender_id long, text string")
    with pytest.raises(Exception, match="no requirements of chunk 0: TimeoutError: late"):
        plan.extract_requirements(tenders, extractor).collect()
    assert [r.tender_id for r in plan.extract_requirements(tenders, extractor, strict=False).collect()] == [1]
    asked = plan.ask_chunks(tenders, extractor, attempts=2).cache()
    assert [tuple(r) for r in plan.failed_chunks(asked).collect()] == [(2, 0, 2, "TimeoutError: late")]
    assert [(r.tender_id, r.id) for r in plan.requirements_of(asked).collect()] == [(1, "R001")]


def test_repeated_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "工期 30 天 投标文件作废的情形"), (1, "工期 30 天 投标文件作废的情形"), (1, None), (None, "x")], "doc_id long, text string")
    assert clauses.parse_constraints(df).count() == 4 and collusion.simhash(df).count() == 4
    named = df.select("doc_id", F.col("text").alias("t"), F.lit(1).alias("n"), F.lit(2).alias("fp"), F.lit("k").alias("letters"))
    assert collusion.simhash(named, text_col="t").columns == ["doc_id", "fp"] and clauses.parse_constraints(named, text_col="t").count() == 4


def test_leak_summary(spark):
    hits, masked = pii.scan_and_mask(docs(spark, "电话13900001111，电话13900001112", None))
    assert {(r.rule_id, r.n) for r in pii.leak_summary(hits).collect()} == {("LEAK.MOBILE", 2)} and masked.count() == 2


def test_repeated_ids_of_evidence(spark):
    """Sections of one id are counted each by itself; facts and drafts of one id meet each other, as documented."""
    s = spark.createDataFrame([(1, "坝高 35 m 的大坝施工。另一句没有数字的叙述。", "x"), (1, "＊＊＊＊＊＊水位 20 m 的说明文字。", "y"), (None, "坝高 35 m 的大坝施工。", "z"), (2, None, None)], "section_id long, text string, tokens string")
    c = spark.createDataFrame([(1, "", "35 m"), (1, None, None), (None, "", "35 m")], "section_id long, source string, content string")
    got = sorted(map(tuple, evidence.fact_summary(s, c).collect()), key=repr)
    assert got == [(1, 1, 1, 0, 1, 1), (1, 2, 1, 1, 0, 0), (2, 0, 0, 0, 0, 0), (None, 1, 1, 0, 1, 0)]
    assert sorted((r[0] or 0, r[1], r.cited) for r in evidence.fact_check(s, c).collect()) == [(0, 0, False), (1, 0, False), (1, 0, True)]
    texts = spark.createDataFrame([(1, "工期 180 天", 5), (1, "工期 90 天", 6), (2, None, 7)], "doc_id long, text string, spans int")
    facts = spark.createDataFrame([(1, "工期", "180 日历天"), (2, "工期", "5 天"), (None, "x", "1 天"), (1, "名称", None)], "doc_id long, fact_key string, expected string")
    checked = evidence.check_facts(texts, facts).collect()
    assert sorted((r.doc_id, r.found_in_text, r.verdict) for r in checked) == [(1, "", "缺失"), (1, "180 天", "偏离"), (2, "", "缺失")]
    drafts = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, None)], "project_id long, draft string")
    reqs = spark.createDataFrame([(1, "r1", ["alpha"]), (2, "r2", ["x"]), (3, "r3", None)], "project_id long, req_id string, keywords array<string>")
    assert sorted((r.project_id, r.n_hit) for r in evidence.check_compliance(reqs, drafts).collect()) == [(1, 0), (1, 1), (2, 0), (3, 0)]


def test_a_draft_is_lowered_once(spark):
    """However many words are looked for, and whatever the evidence: lowering a long draft is what takes the time."""
    reqs = spark.createDataFrame([(1, 1, ["Alpha", "", "beta", None]), (1, 2, ["x"])], "project_id long, req_id long, keywords array<string>")
    got = evidence.check_compliance(reqs, spark.createDataFrame([(1, "an ALPHA and Beta")], "project_id long, draft string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\((?:coalesce\()?draft", plan)) == 1
    assert sorted((r.req_id, r.status, r.n_hit, r.evidence) for r in got.collect()) == [(1, "完全响应", 3, "an ALPHA and Beta"), (2, "缺失", 0, "")]
