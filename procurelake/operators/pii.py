"""Masking of personal data and scanning for what shows who a bidder is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions.text import LEFT, RIGHT, around, matches, present, squeeze
from procurelake.packs.lexicons import PII, PLACEHOLDER
from procurelake.packs.rules import DISCLOSURE, Rule

#: Matches of one pattern that are looked at by default; 2**30 looks at all.
SCAN_MOST = 200


def _java(pattern: str) -> str:
    return pattern.replace("{L}", LEFT).replace("{R}", RIGHT)


def _typed(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pack=tuple(PII), placeholder: str = PLACEHOLDER) -> DataFrame:
    """(id, masked_text, matches ARRAY<STRUCT<type, value>>, n_matches).

    Kinds are masked one after the other, each in what the ones before have left; matches are in that order.
    A null text stays null without matches.
    """
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t0"))
    for i, (kind, pattern) in enumerate(pack):
        before = F.col(f"__t{i}")
        found = F.coalesce(F.regexp_extract_all(before, F.lit(_java(pattern)), F.lit(0)), F.array().cast("array<string>"))
        named = F.transform(found, _typed(kind))
        out = out.withColumns({f"__m{i}": named, f"__t{i + 1}": F.regexp_replace(before, _java(pattern), placeholder)})
    every = F.concat(*[F.col(f"__m{i}") for i in range(len(pack))])
    return out.select(F.col("__id").alias(id_col), F.col(f"__t{len(pack)}").alias("masked_text"), every.alias("matches"), F.size(every).alias("n_matches"))


def _in_context(text: Column, no: int):
    return lambda m: F.struct(F.lit(no).alias("pattern_no"), m["match"].alias("match"), around(text, m["off"], F.length(m["match"]), 25).alias("context"))


def _leak(rule: Rule):
    return lambda h, i: F.struct(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"), h["pattern_no"].alias("pattern_no"), (i + 1).alias("hit_no"),
        h["match"].alias("match"), squeeze(h["context"]).alias("context"), F.lit(rule.auto_fixable).alias("auto_fixable"), F.lit(rule.needs_review).alias("needs_review"),
    )


def pattern_hits(text: Column, rule: Rule, most: int) -> Column:
    """Hits of a text rule: ARRAY<STRUCT<pattern_no, match, context>>, without those whose context excuses them."""
    per_pattern = []
    for no, pattern in enumerate(rule.expect["patterns"]):
        hits = F.transform(matches(text, pattern, most), _in_context(text, no))
        excuses = rule.expect.get("exclude", [])
        if excuses:
            hits = F.filter(hits, lambda h: F.size(present(h["context"], excuses)) == 0)
        per_pattern.append(hits)
    return F.concat(*per_pattern)


def scan_disclosure(docs: DataFrame, pack: tuple[Rule, ...] = DISCLOSURE, id_col: str = "doc_id", text_col: str = "text", most: int = SCAN_MOST) -> DataFrame:
    """One row for each hit beyond a rule's allowed occurrences.

    (id, rule_id, category, severity, pattern_no, hit_no, match, context, auto_fixable, needs_review); ``most`` matches
    of a pattern are looked at, excused ones included.
    """
    text = F.col(text_col)
    rules = [r for r in pack if r.detect == "text.pattern"]
    per_rule = [F.transform(F.slice(pattern_hits(text, r, most), r.expect.get("occurrences", 0) + 1, 1 << 30), _leak(r)) for r in rules]
    # one pass tells the few documents that any pattern meets, before places and contexts are worked out
    some = "|".join(f"(?:{p})" for r in rules for p in r.expect["patterns"])
    return docs.where(text.rlike(some)).select(id_col, F.explode(F.concat(*per_rule)).alias("hit")).select(id_col, "hit.*")


def leak_summary(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, rule_id, n) of what ``scan_disclosure`` returns."""
    return hits.groupBy(id_col, "rule_id").agg(F.count("*").alias("n"))


def scan_and_mask(docs: DataFrame, pack: tuple[Rule, ...] = DISCLOSURE, id_col: str = "doc_id", text_col: str = "text", most: int = SCAN_MOST) -> tuple[DataFrame, DataFrame]:
    """Hits as of ``scan_disclosure``, and ``mask_pii`` of the same documents."""
    return scan_disclosure(docs, pack, id_col, text_col, most), mask_pii(docs, id_col, text_col)
