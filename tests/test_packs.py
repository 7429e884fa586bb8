"""Large packs by the automaton, and look-alike pairs by multi-index hashing, against the plain ways."""

import random
import re

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procurelake.functions import automaton
from procurelake.functions.text import BLANKS, heads, may_hold, trim
from procurelake.operators import clauses, collusion
from procurelake.packs.rules import FAIRNESS, INDUSTRIES, FairRule

WORD = st.text(st.sampled_from("ab光伏𠀀"), max_size=3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(WORD, max_size=5), max_size=4), st.one_of(st.none(), st.text(st.sampled_from("ab光伏𠀀 "), max_size=12)))
def test_automaton(groups, text):
    want = [(g, [w for w in words if w in text]) for g, words in enumerate(groups)] if text is not None else []
    assert automaton.Automaton(groups).find(text) == [x for x in want if x[1]]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "指定品牌的逆变器；须在本地设立分公司，具有本市业绩的加 5 分！外地企业不得参加投标。"), (2, None), (3, ""), (4, "光伏电站与房建住宅，投标保证金未按期提交的，否决其投标。"), (4, "光伏电站与房建住宅，投标保证金未按期提交的，否决其投标。"), (5, "word77 and word9999 again; token in a sentence with word4")]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs).cache()


def big(n=10_000):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(n - 400)] + ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    rng.shuffle(words)
    return words


def both(monkeypatch, run):
    out = []
    for limit in (0, 1 << 30):
        monkeypatch.setattr(automaton, "AUTOMATON_FROM", limit)
        out.append(sorted(map(str, run().collect())))
    assert out[0] == out[1] and out[0]
    return out[0]


def test_packs_of_ten_thousand_words(texts, monkeypatch):
    """The automaton gives the rows that a search word by word gives: clauses, fairness with patterns, industries."""
    words = big()
    lists = {"a": (words[:5000], words[5000:5030]), "b": (words[5030:], ["token"]), "none": ([], [])}
    both(monkeypatch, lambda: clauses.clause_match(texts, lists))
    pack = tuple(FairRule(f"R{i}", "HARD" if i % 2 else "SOFT", f"c{i % 3}", tuple(words[i * 500 : (i + 1) * 500]), (r"(?:ing|tion) [a-z]{0,20}",) if i % 5 == 0 else ()) for i in range(20)) + FAIRNESS
    both(monkeypatch, lambda: clauses.fairness_hits(texts, pack))
    industries = tuple((f"n{i}", f"k{i}", words[i * 500 : (i + 1) * 500]) for i in range(20)) + INDUSTRIES
    got = both(monkeypatch, lambda: clauses.detect_industry(texts, industries))
    assert len(got) == texts.count()
    both(monkeypatch, lambda: clauses.clause_match(texts))
    both(monkeypatch, lambda: clauses.fairness_hits(texts))
    both(monkeypatch, lambda: clauses.detect_industry(texts))


def test_heads():
    """Words with which every match begins; none where a look at the pattern can't be sure."""
    assert heads(r"(?:指定|必须)(?:采用|使用)?[^，|；\n]{0,20}(?:品牌|牌)") == ["指定", "必须"] and heads(r"(?:ing|tion)+ (?:the|of)\|[(]") == ["ing", "tion"]
    unsure = ["a|b", "(?:a|b)?c", "(?:a|b)*", "(?:a){0,2}b", "(?:a|b)c|d", "(?:a|)c", "(?:a.|b)c", "(?i)(?:a)", "(a)b", "(?:a)(?i)b", r"(?:a|b)\Q(\E|c\Q)\E", "(?:a)[[b]|]", "(?:a)[]|a]"]
    assert not [p for p in unsure if heads(p) is not None]


def test_may_hold(spark):
    words = ["指定品牌", "央企", "是é", "𠀀a", "", "本地", "外地", "内定"]
    assert may_hold(F.lit("a"), ["ab", "指定"]) is None and may_hold(F.lit("a"), []) is None
    texts = ["指定品牌", "企", "plain", "café", "x𠀀a", "是é.", "", None]
    held = lambda ws: [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(may_hold(F.col("t"), ws).alias("m")).collect()]
    assert held(words)[:7] == [True] * 7  # every text has the empty word
    got = held([w for w in words if w])
    assert got[2:4] == [False, False] and all(got[i] for i in (0, 4, 5)) and not got[6] and not got[7]


def test_trim_takes_white_space_of_all_alphabets_only(spark):
    odd = ["\u0085", "\u200b", "\x1c", "\x00", "é", "𠀀"]
    rows = ["x \u0085", *[f"{b}{b}x {o}{b}" for b in BLANKS for o in odd], *[f"{b}{o}{b}" for b in BLANKS for o in odd], BLANKS, "", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", trim(F.col("t")).alias("t")).collect()
    assert all(r.t == (None if rows[r.i] is None else rows[r.i].strip(BLANKS)) for r in got)


def test_fairness_patterns_run_where_they_can_match(spark, texts, capsys):
    """Sentences without a word's signs go before any search; the rows are those of a search of all words and patterns."""
    clauses.fairness_hits(texts).explain()
    assert "octet_length" in capsys.readouterr().out
    more = ["plain ascii sentence of words", "café au lait, naïve", "须在本地设立分公司 café", "获得某某奖项可以加分", "预算一百万元以上须特级", "只能使用某某牌的设备", "必须使用该平台 BIM", "𠀀𠀀𠀀𠀀央企𠀀𠀀", "强制要求采用某CA认证", "无关的中文句子而已"]
    odd = FairRule("ODD", "SOFT", "c", ("naïve",), (r"(?:au|须) ?l|牌的", r"(?:预算|平台)"))
    for pack in (FAIRNESS, (*FAIRNESS, odd), (FairRule("A", "SOFT", "c", ("café",), ()),)):
        got = {(r.doc_id, r.rule_id): r.matched for r in clauses.fairness_hits(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), pack).collect()}
        want = {(i, r.id): [w for w in r.keywords if w in t] + ["匹配：" + m[0][:40] for p in r.patterns if (m := re.search(p, t))] for i, t in enumerate(more) for r in pack}
        assert got == {k: v for k, v in want.items() if v} and got


@pytest.mark.parametrize("radius", [10, 3, 13])
def test_near_pairs_are_all_pairs(spark, radius):
    """All pairs up to the radius, with copies, repeated ids, nulls, and codes that differ in chosen bits."""
    rng = random.Random(radius)
    codes = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for i in range(400):
        code = rng.choice(codes)
        for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5, 8, 13])):
            code ^= 1 << bit
        rows.append((rng.choice([i, i, i % 50, None]), rng.choice(["p", "q", None]), code - (1 << 64) if code >> 63 else code))
    fps = spark.createDataFrame(rows, "doc_id long, source string, fp long")
    want = collusion.all_pairs(fps, "source").where(f"distance <= {radius}")
    got = collusion.near_pairs(fps, "source", radius=radius)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert collusion.near_pairs(fps.limit(0), "source").count() == 0


def _near_codes(seed: int, n: int, ids) -> list[tuple]:
    rng = random.Random(seed)
    codes, rows = [rng.getrandbits(64) for _ in range(12)], []
    for i in range(n):
        code = rng.choice(codes)
        for bit in rng.sample(range(64), rng.choice([0, 0, 1, 2, 3, 5, 8])):
            code ^= 1 << bit
        rows.append((ids(rng, i), rng.choice(["p", "p", "q", None]), code - (1 << 64) if code >> 63 else code))
    return rows


@pytest.mark.parametrize("most", [25, 10_000])
def test_link_counts_lose_no_link(spark, most):
    """Every document's links in blocks, with copies and nulls, against all pairs."""
    from procurelake.operators import collusion

    rows = _near_codes(3, 400, lambda rng, i: rng.choice([i, i, i, None]))
    fps = spark.createDataFrame(rows, "doc_id long, source string, fp long")
    kept = [r for r in rows if r[0] is not None and r[1] is not None]
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    want = []
    for i, p, x in kept:
        near = [(bits(x, y), j) for j, q, y in kept if q == p]
        want.append((p, i, min(j for d, j in near if not d), sum(d <= 3 for d, _ in near) - 1, sum(3 < d <= 10 for d, _ in near)))
    got = collusion.link_counts(fps, "source", most=most)
    assert got.columns == ["source", "doc_id", "class_id", "n_high", "n_medium"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert collusion.link_counts(fps.limit(0), "source").count() == 0


@pytest.mark.parametrize("crowded", [7, 10_000])
def test_close_links_have_the_groups_of_pairs(spark, crowded):
    """Links are no more than documents and tables allow, and group as all pairs do."""
    from procurelake.operators import collusion

    rows = [(i, x) for i, _, x in _near_codes(5, 900, lambda rng, i: i)] + [(None, 1)]
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    links = collusion.close_links(fps, crowded=crowded)
    pairs = collusion.close_pairs(fps)
    groups = lambda found: sorted(map(tuple, collusion.risk_groups(found).collect()))
    assert groups(links) == groups(pairs) != []
    if crowded > 900:
        assert links.count() <= 21 * len(rows) and links.count() < pairs.count()
