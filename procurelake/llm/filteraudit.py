"""Filter interaction audit: what each filter removes, in every order that the filters can be applied in.

The orders form a trie.  It is walked depth-first over persisted survivors: a filter is applied to what its
prefix left, and the rows that it removes there are counted.  What a prefix leaves doesn't depend on its order, so each
unordered set of filters is visited once and every other prefix of the same set takes its counts: 2^k visits
instead of k! walks.  At most one chain of survivors is held at a time, as a visited set's rows aren't needed again.

Counts stay tables: one row for each part and edge of the trie, never collected.  Survivors are narrow rows read from
a saved table, so a lost executor costs the filters along one path.
"""

from __future__ import annotations

from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.storage import Scratch

FILTERS = "ABCDE"
#: Fixed limits of the five filters.
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_UPPER_PCT = 200, 50, 2
WORD, SIGNS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
_COUNTS = ("removed", "good_lost", "toxic_lost")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row of ``docs``; a filter's column is true where the row fails it.

    A: under 200 words.  B: under half of the words are distinct.  C: over 2 % of the characters are A-Z.  D: one
    of ``#$%&*|``.  E: the text of a smaller id.  Null texts are empty, null parts the empty string; a null id is larger
    than every other, and rows of one id aren't copies of each other.  ``labels`` may cover some ids, name an id
    twice (then any quality or toxic of 1 counts) or be empty; a label without an id names no row.
    """
    scratch = Scratch(docs.sparkSession, "filters")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    flags = rows.select(
        "id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (n < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT_PCT * n).alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > MOST_UPPER_PCT * F.length("text")).alias("C"),
        F.col("text").rlike(SIGNS).alias("D"),
    )
    flags = scratch.save(flags, "flags")
    shared = flags.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("id").isNull()).alias("without"))
    shared = shared.where("first < last or (first is not null and without > 0)").select("digest", "first")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("first") < F.col("id")))
    told = flags.join(scratch.save(shared, "shared"), "digest", "left").join(marks, "id", "left")
    no = F.lit(False)
    return told.select("part", "A", "B", "C", "D", copy.alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _edges(survivors: DataFrame, state: str, left: list[str]) -> DataFrame:
    """(part, state, filter, n, removed, good_lost, toxic_lost): what each filter of ``left`` removes from ``survivors``."""
    good, toxic = F.col("good"), F.col("toxic")
    counts = [F.struct(F.lit(f).alias("filter"), *[F.count_if(c).alias(k) for k, c in zip(_COUNTS, (F.col(f), F.col(f) & good, F.col(f) & toxic), strict=True)]).alias(f"of_{f}") for f in left]
    by_part = survivors.groupBy("part").agg(F.count("*").alias("n"), *counts)
    each = by_part.select("part", "n", F.explode(F.array(*[f"of_{f}" for f in left])).alias("e"))
    return each.select("part", F.lit(state).alias("state"), "e.filter", "n", *[f"e.{k}" for k in _COUNTS])


def trie(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The counts of every edge: (part, state, filter, n, removed, good_lost, toxic_lost).

    ``failed`` has a boolean column for each letter of ``filters``, true where a row fails, and part, good and
    toxic.  state is the letters already applied, sorted; n is the rows of the part that they left.  Parts without
    rows at a state have no row there; an empty table gives none.
    """
    scratch = Scratch(failed.sparkSession, "filtertrie")
    place = scratch.path("edges")
    visited: set[str] = set()

    def visit(state: str, survivors: DataFrame) -> None:
        visited.add(state)
        left = [f for f in filters if f not in state]
        if not left:
            return
        _edges(survivors, state, left).write.mode("append").parquet(place)
        for f in left:
            below = "".join(sorted(state + f))
            if below not in visited:
                kept = survivors.where(~F.col(f)).drop(f).persist(StorageLevel.MEMORY_AND_DISK)
                visit(below, kept)
                kept.unpersist()

    visit("", scratch.save(failed, "failed"))
    return failed.sparkSession.read.parquet(place)


def audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, with zeros where nothing is left.

    kept, removed, good_lost and toxic_lost are the step's; redundant is the rows that fail the step's filter and had
    been removed; unique_fails those that fail it alone; shapley is what the filter removes, summed over all orders.
    """
    key = lambda state, f: F.concat(state, F.lit(">"), f)
    edges = trie(failed, filters)
    before, after = F.length("state"), len(filters) - 1 - F.length("state")
    orders = F.factorial(before) * F.factorial(after)  # orders that take this edge
    entry = F.struct(key(F.col("state"), F.col("filter")), F.struct("n", *_COUNTS))
    shares = [F.struct(F.lit(f), F.sum(F.when(F.col("filter") == f, orders * F.col("removed")).otherwise(0))) for f in filters]
    parts = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.map_from_entries(F.array(*shares)).alias("s"))  # one entry an edge
    each = parts.select("*", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    done = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    each = each.select("*", F.substring("filter_order", F.col("step"), F.lit(1)).alias("f"), F.array_join(F.array_sort(F.split(done, "")), "").alias("here"))

    def at(state: Column, count: str) -> Column:
        return F.coalesce(F.try_element_at("m", key(state, F.col("f")))[count], F.lit(0))

    here, others = F.col("here"), F.replace(F.lit("".join(sorted(filters))), F.col("f"), F.lit(""))
    return each.select(
        "part",
        "filter_order",
        "step",
        (at(here, "n") - at(here, "removed")).alias("kept"),
        at(here, "removed").alias("removed"),
        (at(F.lit(""), "removed") - at(here, "removed")).alias("redundant"),
        at(others, "removed").alias("unique_fails"),
        at(here, "good_lost").alias("good_lost"),
        at(here, "toxic_lost").alias("toxic_lost"),
        F.try_element_at("s", F.col("f")).alias("shapley"),
    )


ORACLE = r"""
with t as (select doc_id, coalesce(source, '') part, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1),
f as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
        (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by text))::int mask
      from t left join l using (doc_id)),
c as (select part, mask, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from f group by 1, 2),
b as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, m)),
o as (select p.l || q.l || r.l || s.l || u.l filter_order, [p.m, q.m, r.m, s.m, u.m] ms from b p, b q, b r, b s, b u
      where p.m | q.m | r.m | s.m | u.m = 31),
e as (select filter_order, step::int step, ms[step] bit, coalesce(list_sum(ms[1:step - 1]), 0)::int before from o, unnest(range(1, 6)) z(step)),
k as (select part, filter_order, step, bit,
        sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint kept,
        sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end)::bigint removed,
        sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end)::bigint redundant,
        sum(case when mask = bit then n else 0 end)::bigint unique_fails,
        sum(case when mask & before = 0 and mask & bit > 0 then g else 0 end)::bigint good_lost,
        sum(case when mask & before = 0 and mask & bit > 0 then x else 0 end)::bigint toxic_lost
      from c, e group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, bit)::bigint as shapley from k
"""
