"""Interval joins and templates per row, against brute force."""

import random
from datetime import date, datetime, timedelta

import pytest

from procurelake.operators import rules
from procurelake.operators.intervals import interval_join
from procurelake.packs.rules import DISCLOSURE, TEMPLATES, Rule, Template


@pytest.mark.parametrize("kind", ["date", "timestamp", "long"])
def test_interval_join_brute_force(spark, kind):
    rng = random.Random(kind)
    at = {"date": lambda n: date(2000, 1, 1) + timedelta(n), "timestamp": lambda n: datetime(2000, 1, 1) + timedelta(seconds=n, microseconds=n), "long": lambda n: n * 10**12}[kind]  # noqa: DTZ001
    some = lambda lo, hi: rng.choice([None, *[rng.randint(lo, hi) for _ in range(6)]])
    points = [(i, some(-50, 300), rng.choice(["x", "y", None])) for i in range(150)] + [(0, 5, "x")] * 2
    spans = []
    for i in range(120):
        a = some(-400, 700)
        spans.append((i, a, None if a is None or rng.random() < 0.1 else a + rng.choice([-3, 0, 0, 1, 2, 7, 100, 900]), rng.choice(["x", "y", None])))
    stamp = lambda n: None if n is None else at(n)
    left = spark.createDataFrame([(i, stamp(p), k) for i, p, k in points], f"p long, at {kind}, k string")
    right = spark.createDataFrame([(i, stamp(a), stamp(b), k) for i, a, b, k in spans], f"s long, since {kind}, until {kind}, k string")
    holds = lambda p, a, b: p is not None and (a is None or a <= p) and (b is None or p <= b)
    got = sorted((r.p, r.s) for r in interval_join(left, right, "at", "since", "until", ["k"]).collect())
    assert got == sorted((i, s) for i, p, k in points for s, a, b, j in spans if holds(p, a, b) and k == j and k is not None)
    joined = interval_join(left, right.drop("k"), "at", "since", "until")
    assert sorted((r.p, r.s) for r in joined.collect()) == sorted((i, s) for i, p, _ in points for s, a, b, _ in spans if holds(p, a, b))
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_interval_join_small(spark):
    none, one = spark.createDataFrame([], "at date"), spark.createDataFrame([(date(2020, 1, 1),)], "at date")
    spans = spark.createDataFrame([(None, None), (date(2020, 1, 1), date(2020, 1, 1)), (date(2020, 1, 2), None)], "since date, until date")
    assert interval_join(none, spans, "at", "since", "until").count() == 0
    assert interval_join(one, spans, "at", "since", "until").count() == 2
    assert interval_join(one, spans.limit(0), "at", "since", "until").count() == 0


REQUEST = "req_id long, region string, city string, industry string, tender_type string, as_of date"


def test_match_is_the_choice_for_each_request(spark):
    """The join gives what the driver's choice gives, over many templates with ties, open ends and superseded ones."""
    rng = random.Random(5)
    day = lambda: rng.choice([None, date(2024, 1, 1) + timedelta(rng.randint(0, 90))])
    pick = lambda *xs: rng.choice(xs)
    made = tuple(Template(f"t{i}", pick("*", "河北省", "r2"), pick(("*",), ("c1",), ("c1", "c2")), pick(("*",), ("i1",)), pick(("*",), ("工程",)), pick("LAW", "NORMATIVE", "odd"), day(), day(), (), (f"t{i + 1}",) if i % 9 == 0 else ()) for i in range(120))
    requests = [(i, pick("河北省", "r2", "r3", None), pick("", "c1", "c2", None), pick("i1", "i2", None), pick("工程", None, "货物"), date(2024, 1, 1) + timedelta(rng.randint(-5, 100))) for i in range(150)]
    requests += [requests[0], (900, "河北省", "c1", "i1", "工程", None)]
    got = rules.match_template(spark.createDataFrame(requests, REQUEST), rules.template_frame(spark, made)).collect()
    assert len(got) == len(requests)
    told = {r.req_id: r.template_id for r in got}
    assert told.pop(900) is None
    for i, region, city, industry, kind, at in requests[:-1]:
        best = rules.choose_template(at, region or "河北省", city, industry, kind or "工程", made)
        assert told[i] == (best.id if best else None), i


def test_validate_each_is_validate_of_each(spark):
    """Each row's findings and verdict are those of ``validate`` under its own scope; more rules than one word of the bitmap."""
    own = Template("many", "河北省", ("c9",), ("*",), ("工程",), "LAW", date(2024, 1, 1), None, tuple(Rule(f"OWN.{i}", "FORMAT", "INFO", "text.pattern", {"patterns": [f"w{i}x"], "occurrences": 0, "exclude": []}) for i in range(70)))
    packs = (*TEMPLATES, own)
    scopes = [("河北省", "保定市", "工程", "工程", date(2025, 1, 1)), ("河北省", "", "公路", None, date(2027, 1, 1)), (None, "c9", "x", "工程", date(2025, 1, 1)), ("山西省", None, None, None, date(2025, 1, 1)), ("河北省", "保定市", "工程", "工程", None)]
    text = "电话13900001111，我公司专利 w3x w69x"
    rows = [(i, text, *s, 1) for i, s in enumerate(scopes)] + [(0, "干净", *scopes[1], 2), (7, None, *scopes[2], 3)]
    facts = spark.createDataFrame(rows, "doc_id long, text string, region string, city string, industry string, tender_type string, as_of date, template_id int")
    found, verdict, chosen = rules.validate_each(facts, templates=packs)
    assert chosen.count() == verdict.count() == len(rows)
    want_found, want = [], []
    for row in rows:
        i, text, region, city, industry, kind, at, _ = row
        one = spark.createDataFrame([(i, text)], "doc_id long, text string")
        scope = {"region": region or "河北省", "city": city, "industry": industry, "tender_type": kind or "工程"}
        if at is None:
            rest = rules.findings(one, rules.effective_rules(None, packs))
            f, v = rules.finding_rows(rest), rules.verdicts(rest, rules.effective_rules(None, packs))
        else:
            f, v = rules.validate(one, at, templates=packs, **scope)
        want_found += [tuple(r) for r in f.collect()]
        want += [tuple(r) for r in v.collect()]
    assert sorted(map(str, want_found)) == sorted(str(tuple(r)) for r in found.collect())
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in verdict.collect())
    every, maps = rules.compiled_rules(packs)
    assert len(every) > 63 and all(len(m) == 2 for m in maps.values()) and len(maps[None]) == 2 and sum(w.bit_count() for w in maps[None]) == len(DISCLOSURE)
    none = facts.limit(0)
    assert rules.validate_each(none)[1].count() == 0


def test_calendar_has_a_row_for_scopes_and_not_for_templates(spark):
    """However many templates are in force, those of equal region and scopes take one row a span, with the best of each day."""
    day = lambda n: date(1970, 1, 1) + timedelta(n)
    spans = [(k % 70, 64 + k % 30, f"t{k:04}") for k in range(900)]
    rows = [("r", ["c"], ["*"], ["*"], day(a), day(b), (-5.0, -a, name)) for a, b, name in spans]
    kind = "t_region string, cities array<string>, industries array<string>, types array<string>, effective_from date, effective_to date, own struct<s:double,d:bigint,template_id:string>"
    got = rules._calendar(spark.createDataFrame(rows, kind), 10, 80).collect()
    assert sorted(r.span for r in got) == [0, 1, 2]
    for r in got:
        for i, best in enumerate(r.best):
            n = r.span * rules.SPAN + i
            fits = [(-a, name) for a, b, name in spans if max(a, 10) <= n <= min(b, 80)]
            assert (best and (best.d, best.template_id)) == (min(fits) if fits else None)
