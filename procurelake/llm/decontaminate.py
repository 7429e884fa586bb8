"""Benchmark decontamination with a distributed positional inverted index.  DataFrame functions only.

The index holds (term, document, position) for every corpus word that occurs in the test texts, and the number of
words of every document.  For each window of a test text the two rarest of its words, by corpus count, are looked
up; their lists are moved by their place in the test text, so that hits of one alignment meet on one diagonal
(document position minus test position), and only documents with a diagonal where both words of a window meet are
read again, for the exact comparison with their words.

Rows: texts that are null or without words have no words and are never hit.  Rows that repeat a document
(same id and text) each get the same result; rows that share an id but not the text are told apart.  Items
with a null id count for hits but are not named.  An empty table gives no rows; an empty test set, no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.storage import Scratch

WINDOW = 13
#: Words: runs of ASCII digits, ASCII letters and everything beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At least a twentieth of the words are hit.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"
#: Rows of a lookup table up to which it is sent to every executor; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Stands for a document's own row in the index, which has -1 minus its number of words for a position.
OWN_TERM = -1


def words(text: Column) -> Column:
    """The words of a text; lower() is quicker than translate() and the same where all is ASCII."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _sized(df: DataFrame, held: str | None = None) -> DataFrame:
    """Marked for broadcast if the number of rows, with those of the list ``held`` in each, allows."""
    n = df.agg(F.count("*") + (F.coalesce(F.sum(F.size(held)), F.lit(0)) if held else 0)).first()[0]
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("fp"), F.col(text_col).alias("text"))


def _tests(tests: DataFrame, item_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences (seq, words) and the items that have them (seq, item_id)."""
    rows = tests.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    rows = scratch.save(rows.withColumn("seq", F.md5(F.array_join("words", " "))), "tests")
    return rows.groupBy("seq").agg(F.first("words").alias("words")), rows.select("seq", "item_id").distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored in one pass: the postings (term, doc_id, fp, pos) of the words whose hashes ``vocabulary`` (term) has, and
    (doc_id, fp, n_words) of every row."""
    found = _keyed(docs, id_col, text_col).select("doc_id", "fp", words(F.col("text")).alias("words"))
    counted = F.concat(F.array(F.size("words").cast("string")), F.col("words"))  # the number of words stands before the first
    each = found.select("doc_id", "fp", F.posexplode(counted).alias("at", "word"))
    own = F.col("at") == 0
    hashed = each.select(F.when(own, F.lit(OWN_TERM).cast("bigint")).otherwise(F.xxhash64("word")).alias("term"), "doc_id", "fp", F.when(own, -1 - F.col("word").cast("int")).otherwise(F.col("at") - 1).alias("pos"))
    known = vocabulary.select("term").unionByName(docs.sparkSession.range(1).select(F.lit(OWN_TERM).cast("bigint").alias("term"))).distinct()
    index = scratch.save(hashed.join(_sized(known), "term", "left_semi"), "postings")
    return index.where("pos >= 0"), index.where("pos < 0").select("doc_id", "fp", (-1 - F.col("pos")).cast("long").alias("n_words"))


def _places(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq", F.posexplode("words").alias("at", "word")).select("seq", F.col("at"), F.xxhash64("word").alias("term"))


def _candidates(seqs: DataFrame, index: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, fp, start, win): windows whose two rarest words lie in the document at the right distance."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    placed = _places(seqs).join(counts, "term")  # a word the corpus lacks keeps its windows from occurring
    lengths = seqs.select("seq", F.size("words").alias("len"))
    spans = lengths.select("seq", F.least("len", F.lit(width)).alias("width"), F.explode(F.expr(f"sequence(0, len - least(len, {width}))")).alias("first"))
    # each place belongs to the windows that start at most width - 1 before it
    inside = placed.select("*", F.explode(F.sequence(F.greatest(F.col("at") - (width - 1), F.lit(0)), F.col("at"))).alias("first"))
    inside = inside.join(spans, ["seq", "first"]).where("at < first + width")
    window = Window.partitionBy("seq", "first")
    ranked = inside.withColumn("present", F.count("*").over(window)).where("present = width")
    ranked = ranked.withColumn("rank", F.row_number().over(window.orderBy("n", "at"))).where("rank <= 2")
    chosen = ranked.groupBy("seq", "first", "width").agg(F.collect_set("at").alias("need"))
    wins = chosen.join(seqs, "seq").select("seq", "first", "need", F.array_join(F.slice("words", F.col("first") + 1, F.col("width")), " ").alias("win"))
    wins = scratch.save(wins, "windows")
    anchors = scratch.save(ranked.select("seq", "at", "term").distinct(), "anchors")
    met = index.join(_sized(anchors), "term").select("doc_id", "fp", "seq", (F.col("pos") - F.col("at")).alias("diagonal"), "at")
    met = met.groupBy("doc_id", "fp", "seq", "diagonal").agg(F.collect_set("at").alias("found"))  # at most the places of a test text
    led = wins.select("seq", F.col("need")[0].alias("at"), "first", "need", "win")
    met = met.select("*", F.explode("found").alias("at")).join(_sized(led), ["seq", "at"]).where(F.size(F.array_except("need", "found")) == 0)
    return met.select("doc_id", "fp", (F.col("diagonal") + F.col("first")).alias("start"), "win").where("start >= 0").distinct()


def decontaminate(
    docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW
) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``width`` consecutive words of a test text, or all of a shorter one.  Words inside any
    occurrence of a window are hit; a document is contaminated if at least a twentieth of its words are.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows, seqs, items = _hits(docs, tests, id_col, text_col, item_col, item_text_col, width, scratch)
    holders = _windows_of(seqs, width).join(items.where("item_id is not null"), "seq").select("win", "item_id").distinct()
    named = rows.where("n_hit > 0").select("doc_id", "fp", F.explode("wins").alias("win")).distinct().join(_sized(scratch.save(holders, "holders")), "win")
    named = named.groupBy(F.col("doc_id").alias("c_id"), F.col("fp").alias("c_fp")).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = rows.join(named, rows.doc_id.eqNullSafe(F.col("c_id")) & (rows.fp == F.col("c_fp")), "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        "n_hit",
        F.coalesce(F.size(F.when(F.col("items").isNotNull(), F.col("items"))), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


def clean(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, unchanged, that aren't contaminated."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows, _, _ = _hits(docs, tests, id_col, text_col, item_col, item_text_col, width, scratch)
    gone = scratch.save(rows.where(CONTAMINATED).select(F.col("doc_id").alias("__pl_id"), F.col("fp").alias("__pl_fp")).distinct(), "gone")
    keyed = docs.withColumn("__pl_own", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    return keyed.join(_sized(gone), keyed[id_col].eqNullSafe(F.col("__pl_id")) & (F.col("__pl_own") == F.col("__pl_fp")), "left_anti").select(*docs.columns)


def _hits(docs: DataFrame, tests: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored rows (doc_id, fp, n_words, n_hit, wins) of every document, the test sequences and their items."""
    seqs, items = _tests(tests, item_col, item_text_col, scratch)
    vocabulary = _places(seqs).select("term").distinct()
    index, sizes = build_index(docs, vocabulary, scratch, id_col, text_col)
    found = _candidates(seqs, index, width, scratch)
    grouped = found.groupBy(F.col("doc_id").alias("c_id"), F.col("fp").alias("c_fp")).agg(F.collect_list(F.struct("start", "win")).alias("cand"))
    grouped = scratch.save(grouped, "candidates")
    rows = _keyed(docs, id_col, text_col)
    again = rows.join(_sized(grouped, "cand"), rows.doc_id.eqNullSafe(F.col("c_id")) & (rows.fp == F.col("c_fp")))
    again = again.select("doc_id", "fp", words(F.col("text")).alias("words"), "cand")
    n_win = lambda w: F.size(F.split(w, " "))
    true = F.filter("cand", lambda c: F.array_join(F.slice("words", c["start"] + 1, n_win(c["win"])), " ") == c["win"])
    spans = F.array_sort(F.transform(true, lambda c: F.struct(c["start"].alias("s"), (c["start"] + n_win(c["win"])).alias("e"))))
    again = again.select("doc_id", "fp", spans.alias("spans"), F.array_distinct(F.transform(true, lambda c: c["win"])).alias("wins")).where(F.size("spans") > 0)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["e"] - F.greatest(s["s"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["e"]).alias("end"))
    hit = again.select(F.col("doc_id").alias("c_id"), F.col("fp").alias("c_fp"), F.aggregate("spans", start, step)["n"].cast("long").alias("n_hit"), "wins")
    hit = scratch.save(hit.dropDuplicates(["c_id", "c_fp"]), "matches")  # rows that repeat a document are alike
    out = sizes.join(_sized(hit, "wins"), sizes.doc_id.eqNullSafe(F.col("c_id")) & (sizes.fp == F.col("c_fp")), "left")
    out = out.select("doc_id", "fp", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "wins")
    return scratch.save(out, "hits"), seqs, items


def _windows_of(seqs: DataFrame, width: int) -> DataFrame:
    each = seqs.select("seq", "words", F.least(F.size("words"), F.lit(width)).alias("w"))
    each = each.select("seq", "words", "w", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("w"))).alias("first"))
    return each.select("seq", F.array_join(F.slice("words", F.col("first") + 1, F.col("w")), " ").alias("win")).distinct()


def proximity_matches(
    docs: DataFrame, tests: DataFrame, span: int = 30, terms: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, item_id, pos): places where the ``terms`` rarest different words of an item lie within ``span`` words.

    ``pos`` is that of the rarest.  Items of fewer different words use all of them.  Positions are dealt into
    stretches of ``span`` words, so no join meets more than 3 * span positions of a word.
    """
    scratch = Scratch(docs.sparkSession, "proximity")
    seqs, items = _tests(tests, item_col, item_text_col, scratch)
    index, _ = build_index(docs, _places(seqs).select("term").distinct(), scratch, id_col, text_col)
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    each = _places(seqs).select("seq", "term").distinct().join(counts, "term", "left").fillna(0, ["n"])
    order = Window.partitionBy("seq").orderBy("n", "term")
    chosen = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)
    chosen = chosen.withColumn("wanted", F.count("*").over(Window.partitionBy("seq")))
    hits = index.join(_sized(scratch.save(chosen.select("seq", "term", "rank", "wanted"), "chosen")), "term")
    hits = hits.withColumn("cell", F.floor(F.col("pos") / span))
    first = hits.where("rank = 1").select("doc_id", "fp", "seq", "wanted", F.col("pos").alias("at"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = first.join(hits.select(F.col("doc_id").alias("d"), "fp", "seq", "cell", "pos", "rank"), ["fp", "seq", "cell"])
    near = near.where(F.col("doc_id").eqNullSafe(F.col("d")) & (F.abs(F.col("pos") - F.col("at")) < span))
    met = near.groupBy("doc_id", "fp", "seq", "at", "wanted").agg(F.count_distinct("rank").alias("got")).where("got = wanted")
    return met.join(items, "seq").select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), F.col("at").alias("pos")).distinct()


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 13) n, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') win
       from b, unnest(range(0, len(w) - least(len(w), 13) + 1)) t(i) where len(w) > 0),
lens as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') win
       from d, lens, unnest(range(0, len(w) - n + 1)) t(i) where len(w) >= n),
h as (select distinct dw.doc_id, i, dw.n, item_id from dw join bw using (win, n)),
c as (select doc_id, count(distinct p) n_hit from h, unnest(range(i, i + n)) t(p) group by 1),
it as (select doc_id, list_sort(list(distinct item_id::varchar)) items from h group by 1)
select d.doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(len(items), 0)::bigint n_items,
       sha256(coalesce(array_to_string(items, ','), '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join c using (doc_id) left join it using (doc_id)
"""
