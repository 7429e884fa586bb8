"""Sentences, clause lists, fair competition, industry and key parameters of tenders: all within a row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions.automaton import found_words, words_of
from procurelake.functions.text import heads, may_hold, present, round2, sentences, strings, trim
from procurelake.packs import lexicons as L
from procurelake.packs.rules import DEFAULT_PACK, FAIRNESS, INDUSTRIES, UNKNOWN_INDUSTRY


def split_sentences(docs: DataFrame, min_len: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_no from 0, sentence)."""
    return docs.select(id_col, F.posexplode(sentences(F.col(text_col), min_len)).alias("sent_no", "sentence"))


def clause_match(docs: DataFrame, lists: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, list_name, sent_no, sentence, matched): sentences with a word of a list and none of its negative ones.

    ``matched`` are the first three words found, in the order of the list.  Lists may be of any length: large ones are
    searched in one pass over a sentence.
    """
    lists = lists or L.CLAUSES
    names = F.array(*[F.lit(n) for n in lists])
    found = found_words(F.col("sentence"), [words for pair in lists.values() for words in pair])  # a list's words, then its negative ones
    each = split_sentences(docs, 6, id_col, text_col).withColumn("found", found).where(F.size("found") > 0)
    spoilt = lambda f: F.exists("found", lambda g: g["no"] == f["no"] + 1)
    hits = each.select("*", F.explode(F.filter("found", lambda f: (f["no"] % 2 == 0) & ~spoilt(f))).alias("f"))
    return hits.select(id_col, F.get(names, (F.col("f.no") / 2).cast("int")).alias("list_name"), "sent_no", "sentence", F.slice("f.words", 1, 3).alias("matched"))


def amounts(text: Column, pattern: str, most: int) -> Column:
    """ARRAY<STRUCT<raw, value_yuan>> of the first ``most`` amounts, in yuan to two decimals."""
    parts = [F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), 1, most) for g in range(3)]
    zipped = F.arrays_zip(parts[0].alias("raw"), parts[1].alias("num"), parts[2].alias("unit"))
    factor = lambda u: F.when(u.isin("亿", "亿元"), 1e8).when(u.isin("万", "万元"), 1e4).otherwise(1.0)
    return F.transform(zipped, lambda z: F.struct(trim(z["raw"]).alias("raw"), round2(z["num"].try_cast("double") * factor(z["unit"])).alias("value_yuan")))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def constraint_params(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, weights MAP, duration_days, duration_raw, bid_bond, control_price, n_chars)."""
    t = F.col(text_col)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), first_group(t, p).alias("value")) for k, p in L.WEIGHTS.items()])
    return docs.select(
        id_col,
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("weights"),
        first_group(t, L.DURATION).try_cast("int").alias("duration_days"),
        trim(first_group(t, L.DURATION, 0)).alias("duration_raw"),
        amounts(t, L.BOND, 3).alias("bid_bond"),
        amounts(t, L.CONTROL_PRICE, 3).alias("control_price"),
        F.length(t).alias("n_chars"),
    )


def parse_constraints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: dict | None = None) -> DataFrame:
    """``constraint_params`` with the counts of sentences and of each clause list, all within a row.

    Null texts have no parameters, no sentences and null n_chars; rows that repeat an id each have their own row.
    """
    each = sentences(F.col(text_col), 6)
    found = lambda words, negative: F.size(F.filter(each, lambda s: (F.size(present(s, words)) > 0) & (F.size(present(s, negative)) == 0)))
    params = constraint_params(docs.withColumn(id_col, F.struct(F.col(id_col).alias("id"), F.size(each).alias("n"), *[found(*pair).alias(k) for k, pair in (lists or L.CLAUSES).items()])), id_col, text_col)
    counts = [F.col(f"{id_col}.n").alias("sentence_count"), *[F.col(f"{id_col}.{k}").alias(f"{k}_count") for k in lists or L.CLAUSES]]
    return params.select(F.col(f"{id_col}.id").alias(id_col), *[c for c in params.columns if c != id_col], *counts)


def fairness_hits(docs: DataFrame, pack=FAIRNESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule_ord, rule_id, type, category, sent_no, sentence, matched): a row for each rule and sentence that meet.

    ``matched`` are the rule's key words in order, then each pattern's first match, marked, up to 40 characters.  The key
    words of all rules are searched in one pass over a sentence; patterns one by one, in sentences that hold a word with
    which a match begins, where a pattern shows these.
    """
    s, pack = F.col("sentence"), tuple(pack)
    begin = {p: heads(p) for r in pack for p in r.patterns}
    each = split_sentences(docs, 6, id_col, text_col)
    may = may_hold(s, [w for r in pack for w in r.keywords] + [w for ws in begin.values() for w in ws]) if None not in begin.values() else None
    each = (each if may is None else each.where(may)).withColumn("found", found_words(s, [r.keywords for r in pack]))
    meets = lambda p: s.rlike(p) if begin[p] is None else reduce(or_, [F.contains(s, F.lit(w)) for w in begin[p]]) & s.rlike(p)
    marked = []
    for i, rule in enumerate(pack):
        if rule.patterns:
            marks = [F.when(meets(p), F.array(F.concat(F.lit("匹配："), F.substring(F.regexp_extract(s, p, 0), 1, 40)))).otherwise(strings([])) for p in rule.patterns]
            marked.append(F.struct(F.lit(i).alias("no"), F.concat(words_of(F.col("found"), i), *marks).alias("words")))
    plain = [i for i, r in enumerate(pack) if not r.patterns]
    met = F.filter("found", lambda f: f["no"].isin(plain)) if marked else F.col("found")
    if marked:
        met = F.concat(met, F.filter(F.array(*marked), lambda f: F.size(f["words"]) > 0))
    about = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.type).alias("type"), F.lit(r.category).alias("category")) for r in pack])
    hits = each.select("*", F.explode(met).alias("r")).withColumn("rule", F.get(about, F.col("r.no")))
    return hits.select(id_col, F.col("r.no").alias("rule_ord"), "rule.rule_id", "rule.type", "rule.category", "sent_no", "sentence", F.col("r.words").alias("matched"))


def fairness_summary(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, total_hits, hard_count, soft_count, by_category MAP) of documents with hits."""
    per = hits.groupBy(id_col, "category").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "HARD").alias("hard"))
    return per.groupBy(id_col).agg(
        F.sum("n").alias("total_hits"), F.sum("hard").alias("hard_count"), (F.sum("n") - F.sum("hard")).alias("soft_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category")
    )


def detect_industry(docs: DataFrame, pack=INDUSTRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, pack_key, confidence, matched_keywords, matches MAP): the industry most of whose words occur.

    Of equals the first of the pack wins; matched_keywords are the first twelve over all industries in order.
    """
    pack = tuple(pack)
    about = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(key).alias("key"), F.lit(len(words)).alias("of")) for name, key, words in pack])
    named = lambda f: F.struct((-f["no"]).alias("neg"), F.get(about, f["no"])["name"].alias("name"), F.get(about, f["no"])["key"].alias("key"), F.get(about, f["no"])["of"].alias("of"), f["words"].alias("words"))
    given = docs.select(id_col, found_words(F.coalesce(F.col(text_col), F.lit("")), [words for _, _, words in pack]).alias("found"))
    hit = F.transform("found", named)
    best = F.array_max(F.transform(hit, lambda f: F.struct(F.size(f["words"]).alias("n"), f["neg"].alias("neg"), f["name"].alias("name"), f["key"].alias("key"), f["of"].alias("of"))))
    out = given.select(id_col, hit.alias("hit"), best.alias("b"))
    return out.select(
        id_col,
        F.coalesce("b.name", F.lit(UNKNOWN_INDUSTRY)).alias("name"),
        F.coalesce("b.key", F.lit(DEFAULT_PACK)).alias("pack_key"),
        F.coalesce(round2(F.col("b.n") / F.col("b.of")), F.lit(0.0)).alias("confidence"),
        F.slice(F.flatten(F.transform("hit", lambda f: f["words"])), 1, 12).alias("matched_keywords"),
        F.map_from_entries(F.transform("hit", lambda f: F.struct(f["name"], F.size(f["words"])))).alias("matches"),
    )
