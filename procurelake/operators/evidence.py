"""Facts and evidence: statements against citations, project facts, requirements against drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.functions.text import around, bare, matches, sentences, squeeze, trim
from procurelake.packs import lexicons as L


def _statements(sections: DataFrame, citations: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, total, placeholders, facts ARRAY<STRUCT<index, s, has_number, standard, cited>>) of every row of ``sections``."""
    blob = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("content", F.lit("")))
    raw = citations.select(F.col(id_col).alias("__id"), F.explode(F.regexp_extract_all(blob, F.lit(L.CITATION), F.lit(0))).alias("tok"))
    tokens = raw.groupBy("__id").agg(F.collect_set(F.lower(bare(F.col("tok")))).alias("tokens"))
    rows = sections.select(F.col(id_col).alias("id"), sentences(F.col(text_col), 8).alias("each"), F.coalesce(F.regexp_count(text_col, F.lit(L.PLACEHOLDER)), F.lit(0)).alias("placeholders"))
    told = F.transform("each", lambda s, i: F.struct(i.alias("index"), s.alias("s"), s.rlike(L.FACT_NUMBER).alias("has_number"), s.rlike(L.FACT_STANDARD).alias("standard")))
    facts = F.filter(told, lambda f: (f["has_number"] | f["standard"]) & ~f["s"].rlike(L.NARRATIVE))
    rows = rows.select("id", F.size("each").alias("total"), "placeholders", facts.alias("facts")).join(tokens, F.col("id") == F.col("__id"), "left")
    cited = lambda f: F.coalesce(F.exists("tokens", lambda t: F.contains(F.lower(bare(f["s"])), t)), F.lit(False))
    return rows.select("id", "total", "placeholders", F.transform("facts", lambda f: F.struct(f["index"].alias("index"), f["s"].alias("s"), f["has_number"].alias("has_number"), f["standard"].alias("standard"), cited(f).alias("cited"))).alias("facts"))


def fact_check(sections: DataFrame, citations: DataFrame, id_col: str = "section_id", text_col: str = "text") -> DataFrame:
    """(id, index, sentence, has_number, cited, status, reason) of the sentences that state facts.

    A sentence of at least eight characters states one if it holds a number with a unit or names a standard and doesn't
    start as a narrative.  It is cited if it contains a token of a citation of the same id (id, source, content).
    Null texts state nothing; sections that repeat an id are checked each against all citations of the id; a null id
    has none.
    """
    each = _statements(sections, citations, id_col, text_col).select("id", F.explode("facts").alias("f")).select("id", "f.*")
    reason = F.when(F.col("cited"), "命中知识库来源 token").when(F.col("standard"), "含规范/标准引用但无对应知识库来源").otherwise("含具体数字/参数但无知识库来源")
    return each.select(F.col("id").alias(id_col), "index", F.substring("s", 1, 120).alias("sentence"), "has_number", "cited", F.when(F.col("cited"), "已引用").otherwise("待人工补充").alias("status"), reason.alias("reason"))


def fact_summary(sections: DataFrame, citations: DataFrame, id_col: str = "section_id", text_col: str = "text") -> DataFrame:
    """(id, total_sentences, factual_sentences, cited, uncited, placeholder_count) of every section, as ``fact_check`` finds them.

    Each row of ``sections`` is counted by itself, also one that repeats an id.
    """
    cited, stated = F.size(F.filter("facts", lambda f: f["cited"])).cast("long"), F.size("facts").cast("long")
    return _statements(sections, citations, id_col, text_col).select(F.col("id").alias(id_col), F.col("total").alias("total_sentences"), stated.alias("factual_sentences"), cited.alias("cited"), (stated - cited).alias("uncited"), F.col("placeholders").alias("placeholder_count"))


def extract_facts(requirements: DataFrame, project_col: str = "project_id", order_col: str = "ord", content_col: str = "content") -> DataFrame:
    """(project, facts MAP): the first match of each of twelve patterns in a project's requirements, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(content_col).alias("c"))))
    text = requirements.groupBy(project_col).agg(F.array_join(F.transform(ordered, lambda s: s["c"]), "\n").alias("t"))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.nullif(trim(F.regexp_extract("t", p, 0)), F.lit("")).alias("value")) for k, p in L.FACTS])
    return text.select(project_col, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("facts"))


def merge_facts(current: DataFrame, updates: DataFrame, project_col: str = "project_id") -> DataFrame:
    """(project, facts MAP): keys of ``updates`` replace or add to those of ``current``; blank projects start empty."""
    new = updates.select(F.col(project_col).alias("__p"), F.col("facts").alias("__new"))
    both = current.join(new, F.col(project_col) == F.col("__p"), "full")
    none = F.create_map().cast("map<string,string>")
    old, new_map = F.coalesce("facts", none), F.coalesce("__new", none)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new_map, k))
    return both.select(F.coalesce(project_col, "__p").alias(project_col), F.map_concat(kept, new_map).alias("facts"))


def check_facts(texts: DataFrame, facts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fact_key, expected, found_in_text, context, verdict) for each fact (id, fact_key, expected) with a number.

    Quantities of the text match if they contain the fact's first number as characters; 一致 if all of them have the
    fact's unit, else 偏离; 缺失 without a match.  Every fact is checked against every text of its id, so ids that repeat
    have a row for each such pair; ids that are null or on one side only have none.  All quantities of a text count;
    a null text has none.
    """
    number = F.regexp_extract("expected", r"(\d+(?:\.\d+)?)", 1)
    wanted = facts.select(F.col(id_col).alias("__id"), "fact_key", "expected", number.alias("num")).where("num <> ''")
    t = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.transform(matches(t, L.QUANTITY, (1 << 31) - 1), lambda m: F.struct(m["match"].alias("value"), around(t, m["off"], F.length(m["match"]), 20).alias("context")))
    joined = wanted.join(texts.select(id_col, spans.alias("spans")), F.col(id_col) == F.col("__id"))
    hits = joined.withColumn("hits", F.filter("spans", lambda s: F.contains(s["value"], F.col("num"))))
    unit = lambda c: F.regexp_extract(c, L.UNIT, 1)
    same = F.forall("hits", lambda h: unit(h["value"]) == unit(F.col("expected")))
    first = F.col("hits")[0]
    verdict = F.when(F.size("hits") == 0, "缺失").when(same, "一致").otherwise("偏离")
    some = F.size("hits") > 0
    return hits.select(id_col, "fact_key", "expected", F.when(some, F.get("hits", F.lit(0))["value"]).otherwise("").alias("found_in_text"), F.when(some, F.get("hits", F.lit(0))["context"]).otherwise("").alias("context"), verdict.alias("verdict"))


def find_evidence(keywords: Column, draft: Column, reach: int = 80) -> Column:
    """The surroundings of the first key word, in list order, that the draft contains in any case; '' without one."""
    low = F.lower(draft)
    return _surroundings(F.filter(keywords, lambda k: F.contains(low, F.lower(k))), draft, low, reach)


def _surroundings(found: Column, draft: Column, low: Column, reach: int = 80) -> Column:
    """The surroundings of the first of the words ``found`` in the draft that isn't empty."""
    hit = F.get(F.filter(found, lambda k: k != ""), F.lit(0))
    off = F.call_function("locate", F.lower(hit), low) - 1
    return F.when(hit.isNotNull(), squeeze(around(draft, off, F.length(hit), reach))).otherwise("")


def check_compliance(requirements: DataFrame, drafts: DataFrame, project_col: str = "project_id", pending_comment: str = "未启用模型判定，按缺失处理", most_pending: int | None = None) -> DataFrame:
    """(project, req_id, status, evidence, comment, n_hit, n_keywords) of requirements (project, req_id, keywords).

    完全响应 if at least half of the key words, rounded down but one at least, occur in the project's draft (project,
    draft), in any case; a requirement without key words or with too few hits is pending: 缺失 unless a model judges it.
    A requirement of a project with several drafts is checked against each, one row for each; without a draft it is missing.
    With ``most_pending`` the column to_judge marks the first so many pending ones of a project, by req_id.
    """
    # a draft is lowered once, before it meets its requirements, and its words are searched once for each
    lowered = drafts.select(F.col(project_col).alias("__p"), "draft", F.lower("draft").alias("__low"))
    words = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull())
    joined = requirements.join(lowered, F.col(project_col) == F.col("__p"), "left").withColumn("__words", words)
    draft, low, words = F.coalesce("draft", F.lit("")), F.coalesce("__low", F.lit("")), F.col("__words")
    joined = joined.withColumn("__found", F.filter(words, lambda k: F.contains(low, F.lower(k))))
    hits = F.size("__found")
    met = (F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))
    out = joined.select(
        project_col, "req_id", F.when(met, "完全响应").otherwise("缺失").alias("status"), F.when(met, _surroundings(F.col("__found"), draft, low)).otherwise("").alias("evidence"),
        F.when(met, F.lit("")).otherwise(F.lit(pending_comment)).alias("comment"), hits.alias("n_hit"), F.size(words).alias("n_keywords"),
    )
    if most_pending is None:
        return out
    pending = F.col("status") == "缺失"
    turn = F.row_number().over(Window.partitionBy(project_col, pending).orderBy("req_id"))
    return out.withColumn("to_judge", pending & (turn <= most_pending))


def compliance_summary(checked: DataFrame, project_col: str = "project_id") -> DataFrame:
    """(project, total, met, partial, missing)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checked.groupBy(project_col).agg(F.count("*").alias("total"), n("完全响应").alias("met"), n("部分响应").alias("partial"), n("缺失").alias("missing"))


def normalize_checks(checks: DataFrame) -> DataFrame:
    """``checks`` (status, evidence, comment, ...) of a model, tidied: any other status is 缺失, null texts are empty."""
    return checks.withColumns({"status": F.when(trim(F.col("status")).isin(L.STATUSES), trim(F.col("status"))).otherwise(L.MISSING), "evidence": F.coalesce("evidence", F.lit("")), "comment": F.coalesce("comment", F.lit(""))})


def judge_pending(checked: DataFrame, judged: DataFrame, project_col: str = "project_id") -> DataFrame:
    """``checked`` with status, evidence and comment of the rows (project, req_id, ...) that a model has judged.

    Only rows that are pending, 缺失, change; a row that was judged twice takes the judgement that sorts first.
    """
    told = normalize_checks(judged).groupBy(F.col(project_col).alias("__p"), F.col("req_id").alias("__q")).agg(F.min(F.struct("status", "evidence", "comment")).alias("__j"))
    joined = checked.join(told, F.col(project_col).eqNullSafe(F.col("__p")) & (F.col("req_id") == F.col("__q")), "left")
    take = (F.col("status") == L.MISSING) & F.col("__j").isNotNull()
    return joined.withColumns({c: F.when(take, F.col(f"__j.{c}")).otherwise(F.col(c)) for c in ("status", "evidence", "comment")}).select(*checked.columns)


def normalize_requirements(raw: DataFrame, json_col: str = "json", tender_col: str = "tender_id") -> DataFrame:
    """(tender, id, category, content, mandatory, keywords): what dirty JSON arrays of requirements come to.

    Entries that are no objects or whose content has under four characters go; unknown categories fall back, key words
    are cut to five, a missing ``mandatory`` follows the category, and ids are R001, R002, ... over what the array holds.
    """
    item = "struct<category:string,content:string,mandatory:boolean,keywords:array<string>>"
    each = raw.select(tender_col, F.posexplode(F.from_json(json_col, T.ArrayType(T.StringType()))).alias("no", "s"))
    each = each.select(tender_col, "no", F.from_json("s", item).alias("r"), F.trim("s").startswith("{").alias("object"))
    content = trim(F.coalesce("r.content", F.lit("")))
    kept = each.where(F.col("object")).select(tender_col, "no", F.when(F.col("r.category").isin(L.CATEGORIES), F.col("r.category")).otherwise(L.FALLBACK_CATEGORY).alias("category"), content.alias("content"), F.col("r.mandatory").alias("m"), F.slice(F.coalesce("r.keywords", F.array().cast("array<string>")), 1, 5).alias("keywords"))
    kept = kept.where(F.length("content") >= 4)
    number = F.row_number().over(Window.partitionBy(tender_col).orderBy("no"))
    return kept.select(tender_col, F.format_string("R%03d", number).alias("id"), "category", "content", F.coalesce("m", F.col("category").isin(L.MANDATORY)).alias("mandatory"), "keywords")


def dedup_requirements(items: DataFrame, tender_col: str = "tender_id", order_cols: tuple[str, ...] = ("chunk_no", "item_no"), content_col: str = "content", key_len: int = 40) -> DataFrame:
    """The first of each tender's requirements whose first ``key_len`` characters, without white space, are equal; with
    ``id`` R001, R002, ... in order."""
    key = F.substring(bare(F.col(content_col)), 1, key_len)
    first = F.row_number().over(Window.partitionBy(tender_col, key).orderBy(*order_cols))
    number = F.row_number().over(Window.partitionBy(tender_col).orderBy(*order_cols))
    return items.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("id", F.format_string("R%03d", number))


def format_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``source``, the first name that isn't empty, and the first 2,000 characters of the content."""
    name = F.coalesce(F.nullif("document_keyword", F.lit("")), F.nullif("docnm_kwd", F.lit("")), F.lit("未知文档"))
    return chunks.withColumns({"source": name, "content": F.substring("content", 1, 2000)})
