"""Patterns of packs: what JavaScript means by them, invalid ones, and those that can't be expressed."""

import json
from datetime import date

import pytest

from procurelake.operators import rules
from procurelake.packs import files
from procurelake.packs.patterns import Invalid, to_java

#: Pattern, text, and the matches that JavaScript finds.
CASES = [
    (r"\btoken\b", "token tokens étoken 令token", ["token", "token", "token"]),  # letters of other alphabets are no word signs
    (r"a\sb", "a b a b a　b a\tb", ["a b", "a b", "a　b", "a\tb"]),
    (r"[^]x", "\nx", ["\nx"]),
    (r"a[]b|c", "abc", ["c"]),
    (r"[a[b]+", "a[b]", ["a[b"]),
    (r"[a&&b]+", "a&b", ["a&b"]),
    (r"x{2}y{,3}z{", "xxy{,3}z{", ["xxy{,3}z{"]),
    (r"end$", "end\nend\n", []),
    (r"end$", "end\nend", ["end"]),
    (r"^a", "a\na", ["a"]),
    (r"a.b", "a\u0085b a b a\nb", ["a\u0085b"]),
    (r"\y\-\/\%", "y-/%", ["y-/%"]),
    (r"(?<n>[ab])\k<n>\1", "aaa bab", ["aaa"]),
    (r"\d{2,}?", "1234", ["12", "34"]),
    (r"[\d\-\S]+", "a-1 b", ["a-1", "b"]),
    (r"\x41中\0?", "A中", ["A中"]),
    (r"[一-龥]{2,4}(?:公司|集团)(?!有)", "某某公司 某某集团有", ["某某公司"]),
    (r"(?<=第)\d+(?=章)", "第12章 13章", ["12"]),
    (r"]}", "]}", ["]}"]),
]
BAD = ["([a-z", "a)", "*a", "a++", "a**", "(?>a)", "(?i)a", "[b-a]", "x{3,2}", "a\\", "[a", "(?<1a>b)", "|*"]


@pytest.mark.parametrize(("pattern", "text", "want"), CASES)
def test_translated(spark, pattern, text, want):
    matcher = spark._jvm.java.util.regex.Pattern.compile(to_java(pattern)).matcher(text)
    got = []
    while matcher.find():
        got.append(matcher.group())
    assert got == want


@pytest.mark.parametrize("pattern", BAD)
def test_invalid(pattern):
    with pytest.raises(Invalid):
        to_java(pattern)


def test_standing_patterns_stay_valid(spark):
    for t in rules.TEMPLATES:
        for r in t.rules:
            for p in r.expect.get("patterns", []):
                spark._jvm.java.util.regex.Pattern.compile(to_java(p))


def test_pack_with_odd_patterns(spark, tmp_path):
    """Bad patterns are left out, what can't be decided becomes a WARN finding, the rest is found."""
    rule = lambda i, detect, expect: {"id": i, "category": "X", "severity": "REJECT", "detect": detect, "expect": expect if isinstance(expect, str) else json.dumps(expect)}
    pack = {
        "key": "odd", "dialect": "javascript", "region": "*", "level": "LAW", "effective_from": "2024-01-01",
        "rules": [
            rule("A", "text.pattern", {"patterns": ["([a-z", r"\bnew\b"], "occurrences": 0}), rule("B", "text.pattern", {"patterns": ["([a-z"], "occurrences": 0}),
            rule("C", "text.pattern", {"patterns": ["(?<=a.*)b"]}), rule("D", "metadata.creator", "[1"), rule("E", "run.font.size", {"tolerance": 1}), rule("F", "marks.comments", {"max": "many"}),
            rule("G", "no.such.detector", {}), rule("H", "text.pattern", {"patterns": ["x*"]}), rule("I", "doc.page_count", {}),
        ],
    }
    files.write_packs(spark, f"file://{tmp_path}", {"odd": pack})
    templates = files.templates(files.read_packs(spark, f"file://{tmp_path}", "template"))
    facts = spark.createDataFrame([(1, "new ab"), (2, "renew")], "doc_id long, text string")
    found, verdict = rules.validate(facts, date(2025, 1, 1), templates=templates)
    got = {(r.doc_id, r.rule_id): (r.severity, r.actual) for r in found.collect()}
    failed = {(d, i): ("WARN", rules.FAILED) for d in (1, 2) for i in ("D", "F", "H")}
    assert got == failed | {(1, "A"): ("REJECT", "「new」"), (1, "C"): ("REJECT", "「b」")}
    assert {(r.doc_id, r.checked, r.skipped) for r in verdict.collect()} == {(1, 6, 3), (2, 6, 3)}


def test_pack_with_patterns_of_java(spark, tmp_path):
    """Without a dialect patterns are Java's and stay as they are; invalid ones are left out all the same."""
    expect = json.dumps({"patterns": ["a++b", "([a-z", r"x\s"], "occurrences": 0, "exclude": []})
    files.write_packs(spark, f"file://{tmp_path}", {"own": {"key": "own", "rules": [{"id": "A", "category": "X", "severity": "REJECT", "detect": "text.pattern", "expect": expect}]}})
    (template,) = files.templates(files.read_packs(spark, f"file://{tmp_path}", "template"))
    assert template.rules[0].expect["patterns"] == ["a++b", r"x\s"]
