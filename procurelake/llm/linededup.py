"""Line dedup: windows of three consecutive lines that occur before go, with DataFrame functions.

Windows run over the lines that aren't blank.  A window's first occurrence, by document id and then by place, stays;
the lines of later ones, and blank lines between them, are covered, and covered stretches are cut out together.
Windows are told apart by two 64-bit hashes of their lines.

Counting and first places use a partial aggregate, so a window that a third of all documents share costs one row a
task; joining first places back splits such a window's rows by the adaptive skew join.  Texts are rebuilt by slices
between the covered stretches, in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.storage import Scratch

WIDTH = 3
#: Documents and cuts up to which the cuts are sent to every executor (some 20 MB); beyond, the join shuffles.
BROADCAST_CUTS = 400_000
BLANK = r"^[ \t\r\f\x0B]*$"


def _windows(lines: Column) -> Column:
    """(n, first, last, h1, h2) of each window; first and last are places in the array of all lines."""
    full = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda s: ~s["line"].rlike(BLANK))
    # beside each line the ones after it; the lists are worked out once, not once for each line
    beside = F.arrays_zip(*[F.slice(full, k + 1, F.greatest(F.size(lines), F.lit(0))).alias(f"w{k}") for k in range(WIDTH)])
    whole = F.filter(beside, lambda s: s[f"w{WIDTH - 1}"].isNotNull())
    return F.transform(
        whole,
        lambda s, i: F.struct(
            i.alias("n"),
            s["w0"]["at"].alias("first"),
            s[f"w{WIDTH - 1}"]["at"].alias("last"),
            F.concat_ws("\n", *[s[f"w{k}"]["line"] for k in range(WIDTH)]).alias("joined"),
        ),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows cut out of the text column; all other columns stay as they are.

    Null texts stay null; texts of fewer than three lines that aren't blank stay whole.  A text may become empty; its
    row stays.  Rows with the same id and text are one document and change alike; rows that share an id only are
    different documents, ordered by a hash of the text.  Null ids come last.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    keyed = docs.withColumn("__pl_fp", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    lines = keyed.select(F.col(id_col).alias("doc_id"), F.col("__pl_fp").alias("fp"), F.split(text_col, "\n").alias("lines"))
    each = lines.select("doc_id", "fp", F.explode(_windows(F.col("lines"))).alias("w"))
    each = each.select("doc_id", "fp", F.col("w.n").alias("n"), F.col("w.first").alias("first"), F.col("w.last").alias("last"), F.xxhash64("w.joined").alias("h1"), F.xxhash64(F.lit(1), "w.joined").alias("h2"))
    each = scratch.save(each, "windows")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "fp", "n")
    firsts = each.groupBy("h1", "h2").agg(F.min(order).alias("kept"), F.max(order).alias("top")).where("kept < top").drop("top")
    later = each.join(firsts, ["h1", "h2"]).where(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "n") > F.col("kept"))
    covered = later.groupBy(F.col("doc_id").alias("__pl_id"), F.col("fp").alias("__pl_cfp")).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("__pl_cut"))
    covered = scratch.save(covered, "covered")
    n_rows, n_cuts = covered.agg(F.count("*"), F.coalesce(F.sum(F.size("__pl_cut")), F.lit(0))).first()
    # where few places are cut, texts stay where they are; else both sides are dealt by document
    covered = F.broadcast(covered) if n_rows + n_cuts <= BROADCAST_CUTS else covered
    found = keyed.join(covered, keyed[id_col].eqNullSafe(F.col("__pl_id")) & (F.col("__pl_fp") == F.col("__pl_cfp")), "left")
    split, cut = F.split(text_col, "\n"), F.col("__pl_cut")
    # between two covered stretches, before the first and after the last
    begins = F.concat(F.array(F.lit(0)), F.transform(cut, lambda c: c["last"] + 1))
    ends = F.concat(F.transform(cut, lambda c: c["first"]), F.array(F.size(split)))
    gaps = F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda g: g["a"] < g["b"])
    text = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(split, g["a"] + 1, g["b"] - g["a"]))), "\n")
    out = found.withColumn(text_col, F.when(cut.isNull(), F.col(text_col)).otherwise(text))
    return out.select(*docs.columns)


ORACLE = r"""
with l as (select doc_id, text, string_split(text, chr(10)) ls from documents),
e as (select doc_id, i - 1 as pos, ls[i] as line from l, unnest(range(1, len(ls) + 1)) t(i)),
f as (select doc_id, pos, line, row_number() over (partition by doc_id order by pos) as n from e where not regexp_matches(line, '^[ \t\r\f\x0B]*$')),
w as (select doc_id, n, pos as a, lead(pos, 2) over p as b, line || chr(10) || lead(line, 1) over p || chr(10) || lead(line, 2) over p as win
      from f window p as (partition by doc_id order by n)),
r as (select *, row_number() over (partition by win order by doc_id, n) as k from w where b is not null),
c as (select distinct doc_id, u.pos from r, unnest(range(a, b + 1)) u(pos) where k > 1),
k as (select doc_id, string_agg(line, chr(10) order by pos) as text from e anti join c using (doc_id, pos) group by 1)
select l.doc_id, case when l.text is null then null else coalesce(k.text, '') end as text
from l left join k using (doc_id)
"""
