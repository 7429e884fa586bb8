"""The twelve checks that a draft gets before it is handed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions.text import trim
from procurelake.operators.clauses import amounts, first_group
from procurelake.packs import lexicons as L
from procurelake.packs.rules import INDUSTRIES, PRECHECKS, STARRED_INDUSTRIES

PRICES_MOST = 8


def _any(text: Column, *words: str) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def precheck(drafts: DataFrame, id_col: str = "doc_id", text_col: str = "draft_text", control_col: str | None = None, days_col: str | None = None, industry_col: str | None = None) -> DataFrame:
    """(id, code, item, status, detail): twelve rows for each draft that isn't blank.

    Status is PASS, WARN, REJECT_RISK or MANUAL.  ``control_col`` holds the control price in yuan, ``days_col`` the
    days the tender allows, ``industry_col`` an industry's name or pack key.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    null = F.lit(None)
    rows = drafts.where(trim(t) != "").select(
        F.col(id_col),
        t.alias("t"),
        (F.col(control_col) if control_col else null).cast("double").alias("control"),
        (F.col(days_col) if days_col else null).cast("int").alias("days"),
        F.coalesce((F.col(industry_col) if industry_col else null).cast("string"), F.lit("")).alias("industry"),
    )
    t = F.col("t")
    rows = rows.select("*", F.transform(amounts(t, L.BID_PRICE, PRICES_MOST), lambda a: a["value_yuan"]).alias("prices"), first_group(t, L.COMMITTED_DURATION).try_cast("int").alias("committed"))
    sign, seal = _any(t, "签字", "签署", "签章"), _any(t, "盖章", "公章", "印鉴")
    distinct, limited = F.array_distinct("prices"), F.coalesce(F.col("control") > 0, F.lit(False))
    over, low = F.exists("prices", lambda p: p > F.col("control")), F.exists("prices", lambda p: p < F.col("control") * 0.7)
    starred = F.col("industry").isin([*STARRED_INDUSTRIES, *[name for name, key, _ in INDUSTRIES if key in STARRED_INDUSTRIES]])
    due, says = F.coalesce(F.col("days") > 0, F.lit(False)), F.col("committed")
    manual = F.lit("MANUAL")
    status = {
        "P01": F.when(sign & seal, "PASS").otherwise("WARN"),
        "P02": F.when(_any(t, "联合体") & ~_any(t, "联合体协议"), "WARN").otherwise("PASS"),
        "P03": manual,
        "P04": F.when(F.size(distinct) > 1, "REJECT_RISK").otherwise("PASS"),
        "P05": F.when(~limited | (F.size("prices") == 0), manual).when(over, "REJECT_RISK").when(low, "WARN").otherwise("PASS"),
        "P06": manual,
        "P07": manual,
        "P08": F.when(_any(t, "保证金"), "PASS").otherwise("WARN"),
        "P09": manual,
        "P10": manual,
        "P11": F.when(starred & _any(t, "★"), "WARN").otherwise("PASS"),
        "P12": F.when(due & says.isNull(), manual).when(due & (says > F.col("days")), "REJECT_RISK").when(~due & says.isNull(), "WARN").otherwise("PASS"),
    }
    none = F.lit("")
    detail = {
        "P01": F.concat_ws("/", F.when(sign, "签字"), F.when(seal, "盖章")),
        "P04": F.array_join(distinct.cast("array<string>"), "/"),
        "P05": F.array_join(F.col("prices").cast("array<string>"), "/"),
        "P12": F.coalesce(says.cast("string"), none),
    }
    items = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(PRECHECKS[c]).alias("item"), s.alias("status"), detail.get(c, none).alias("detail")) for c, s in status.items()])
    return rows.select(id_col, F.inline(items))


def precheck_summary(items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pass, warn, reject_risk, manual)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return items.groupBy(id_col).agg(n("PASS").alias("pass"), n("WARN").alias("warn"), n("REJECT_RISK").alias("reject_risk"), n("MANUAL").alias("manual"))
