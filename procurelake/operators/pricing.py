"""Price scoring under the published methods, and regular patterns among bids.

Bids come as rows (group, bid_no, price).  Bids that are null, not finite or not positive are left out; a group
without valid bids has no rows.  Means run over the sorted prices of a group, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.functions.text import round2
from procurelake.packs.rules import METHODS

ALGORITHMS = ["AVG_ALL", "AVG_DROP", "AVG_DROP_LOWER", "MIN_PRICE", "CONTROL_WEIGHT"]


def valid(price: Column) -> Column:
    """A finite price above zero."""
    return price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < float("inf"))


def _based(rows: DataFrame, algorithms: dict[str, str], drop_n: int, group_col: str, control: Column | None = None, two_decimals: bool = False) -> DataFrame:
    """``rows`` (group, price, ...) with a column STRUCT<value, degraded> for each of ``algorithms`` (column to name).

    Sums run over a group's prices in order, inside one sort of its rows that spills; nothing collects a group.  Counts
    and extremes go by the same order, as a window without it would sort the rows once more.
    """
    group, price = Window.partitionBy(group_col), F.col("price")
    every = group.orderBy("price").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"__r": F.row_number().over(group.orderBy("price")), "__n": F.count("*").over(every)})
    r, n = F.col("__r"), F.col("__n")
    mean = round2(F.sum("price").over(every) / n)
    kept = lambda low, high: round2(F.sum(F.when((r > low) & (r <= n - high), price)).over(every) / (n - low - high))
    made = {}
    for column, algorithm in algorithms.items():
        if algorithm == "MIN_PRICE":
            value, degraded = F.min("price").over(every), F.lit(False)
        elif algorithm == "AVG_DROP":
            degraded = n < 2 * drop_n + 1
            value = F.when(degraded, mean).otherwise(kept(drop_n, drop_n))
        elif algorithm == "AVG_DROP_LOWER":
            degraded = n < drop_n + 1
            value = F.when(degraded, mean).otherwise(kept(drop_n, 0))
        elif algorithm == "CONTROL_WEIGHT" and control is not None:
            limit = F.max(control).over(every)
            degraded = ~F.coalesce(valid(limit), F.lit(False))
            mixed = 0.5 * limit + 0.5 * mean
            value = F.when(degraded, mean).otherwise(round2(mixed) if two_decimals else F.floor(mixed + F.lit(0.5)).cast("double"))
        else:
            value, degraded = mean, F.lit(algorithm == "CONTROL_WEIGHT")
        made[column] = F.struct(value.alias("value"), degraded.alias("degraded"))
    return rows.withColumns(made).drop("__r", "__n")


def base_price(bids: DataFrame, algorithm: str = "AVG_DROP", drop_n: int = 1, control_col: str | None = None, group_col: str = "group_id", price_col: str = "price", control_weight_2dp: bool = False) -> DataFrame:
    """(group, value, algorithm, degraded): the base price of each group of bids.

    AVG_DROP leaves out ``drop_n`` bids at either end, AVG_DROP_LOWER the lowest; with too few bids both fall back to
    the mean, as CONTROL_WEIGHT does without a control price (``control_col``, the greatest of a group).  The weighted
    price is a whole number unless ``control_weight_2dp``.
    """
    price, control = F.col(price_col).cast("double"), F.col(control_col).cast("double") if control_col else F.lit(None).cast("double")
    rows = bids.where(valid(price)).select(F.col(group_col), price.alias("price"), control.alias("__c"))
    based = _based(rows, {"__b": algorithm}, drop_n, group_col, F.col("__c") if control_col else None, control_weight_2dp)
    out = based.groupBy(group_col).agg(F.first("__b").alias("b"))
    return out.select(group_col, "b.value", F.lit(algorithm).alias("algorithm"), "b.degraded")


def _fix(c: Column) -> Column:
    return F.greatest(F.lit(0.0), round2(c))


def _linear(p: Column, base: Column, above: float, below: float, full: float) -> Column:
    return F.when(p == base, F.lit(float(full))).when(p > base, _fix(full - (p - base) / base * 100 * above)).otherwise(_fix(full - (base - p) / base * 100 * below))


def score_prices(
    bids: DataFrame, method: str = "BASE_PRICE_LINEAR", full_score: float = 100.0, params: dict | None = None, control_col: str | None = None, group_col: str = "group_id", bid_col: str = "bid_no", price_col: str = "price"
) -> DataFrame:
    """(group, bid_no, price, base_price, score, rank): rank by score, then bid_no, then price; 0 for bids without score.

    Rows that repeat a bid_no are bids of their own; rows equal in all columns have ranks next to each other.

    Unknown methods count as BASE_PRICE_LINEAR, a full score that isn't positive as 100.  Bids above the control price
    score 0.  For HEBEI_DUAL_RANDOM see ``score_matrix``.
    """
    if method == "HEBEI_DUAL_RANDOM":
        raise ValueError("the base price is drawn on site: use score_matrix")
    method = method if method in METHODS else "BASE_PRICE_LINEAR"
    m, full = METHODS[method] | (params or {}), full_score if full_score and full_score > 0 else 100.0
    price = F.col(price_col).cast("double")
    rows = bids.where(valid(price)).select(group_col, bid_col, price.alias("price"), *([F.col(control_col).cast("double").alias("control")] if control_col else []))
    based = _based(rows, {"__b": m["base"]}, m.get("drop_n", 0), group_col, F.col("control") if control_col else None)
    rows = based.withColumn("base_price", F.col("__b.value")).drop("__b")
    p, b = F.col("price"), F.col("base_price")
    if method == "LOWEST_FULL":
        score = _fix(full * (b / p))
    elif method == "BASE_PRICE_RATIO":
        score = _fix(F.least(F.lit(float(full)), full * (b / p)))
    elif method == "REASONABLE_LOW":
        low, high = b * (1 - m["lower_pct"]), b * (1 + m["upper_pct"])
        far = F.when(p < low, (low - p) / b * 100).otherwise((p - high) / b * 100)
        score = F.when((p >= low) & (p <= high), F.lit(float(full))).otherwise(_fix(full - far * m["out_penalty"]))
    else:
        score = _linear(p, b, m["above_penalty"], m["below_penalty"], full)
    if control_col:
        score = F.when(F.coalesce(valid(F.col("control")) & (p > F.col("control")), F.lit(False)), 0.0).otherwise(score)
    scored = rows.withColumn("score", score)
    order = Window.partitionBy(group_col).orderBy(F.desc("score"), bid_col, "price")  # bids without score come last
    return scored.select(group_col, bid_col, "price", "base_price", "score", F.when(F.col("score") > 0, F.row_number().over(order)).otherwise(0).alias("rank"))


def placed_scores(scored: DataFrame, group_col: str = "group_id", bid_col: str = "bid_no") -> DataFrame:
    """``scored`` bids with ``place``, from 1: their order in a group's table, by rank and bids without one last.

    Bids without rank follow by bid_no, then price.
    """
    order = Window.partitionBy(group_col).orderBy(F.col("rank") == 0, "rank", bid_col, "price")
    return scored.withColumn("place", F.row_number().over(order))


def score_matrix(bids: DataFrame, params: dict | None = None, full_score: float = 100.0, group_col: str = "group_id", bid_col: str = "bid_no", price_col: str = "price") -> DataFrame:
    """(group, algorithm, base_price, bid_no, price, score): the scores under each base that may be drawn.

    Bids that aren't valid and groups without valid bids have no rows.
    """
    m = METHODS["HEBEI_DUAL_RANDOM"] | (params or {})
    price = F.col(price_col).cast("double")
    rows = bids.where(valid(price)).select(group_col, F.col(bid_col).alias(bid_col), price.alias("price"))
    named = {f"__b{i}": a for i, a in enumerate(m["candidates"])}
    based = _based(rows, named, m["drop_n"], group_col)
    bases = F.array(*[F.struct(F.lit(a).alias("algorithm"), F.col(f"{c}.value").alias("base_price")) for c, a in named.items()])
    each = based.select(group_col, bid_col, "price", F.inline(bases))
    score = _linear(F.col("price"), F.col("base_price"), m["above_penalty"], m["below_penalty"], full_score)
    return each.select(group_col, "algorithm", "base_price", bid_col, "price", score.alias("score"))


def price_pattern(bids: DataFrame, group_col: str = "group_id", bid_col: str = "bid_no", price_col: str = "price") -> DataFrame:
    """(group, n, detected, type, mean, cv): bids of one group with even steps (等差规律) or even ratios (等比规律).

    Needs three valid bids.  Steps count only if all are above zero and their coefficient of variation is under 0.05;
    else ratios under 0.01 — equal prices have even ratios.
    """
    price = F.col(price_col).cast("double")
    rows = bids.where(valid(price)).select(group_col, bid_col, price.alias("p"))
    before = F.lag("p").over(Window.partitionBy(group_col).orderBy("p", bid_col))
    rows = rows.withColumns({"d": F.col("p") - before, "r": F.col("p") / before})
    stats = rows.groupBy(group_col).agg(F.count("*").alias("n"), F.min("d").alias("least"), F.avg("d").alias("md"), F.try_divide(F.stddev_pop("d"), F.avg("d")).alias("cd"), F.avg("r").alias("mr"), (F.stddev_pop("r") / F.avg("r")).alias("cr"))
    step = (F.col("n") >= 3) & (F.col("least") > 0) & (F.col("cd") < 0.05)
    ratio = (F.col("n") >= 3) & ~step & (F.col("cr") < 0.01)
    pick = lambda a, b: F.when(step, F.col(a)).when(ratio, F.col(b))
    return stats.select(group_col, "n", (step | ratio).alias("detected"), F.when(step, "等差规律").when(ratio, "等比规律").alias("type"), pick("md", "mr").alias("mean"), pick("cd", "cr").alias("cv"))
