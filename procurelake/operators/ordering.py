"""Running totals over one global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.storage import Scratch


def running_total(df: DataFrame, order: list[Column], value: str, total: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """``df`` with ``total``: the sum of ``value`` over all rows before this one in ``order``; and the grand total.

    Rows are dealt by range, each range is written with its number, the sums of the ranges (one per
    partition) are added up on the driver, and the rest is a window inside a range.
    """
    part = f"__{total}_part"
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    ranged = scratch.save(ranged, f"by-{total}")
    sums = {r[0]: int(r[1] or 0) for r in ranged.groupBy(part).agg(F.sum(value)).collect()}
    before, so_far = {}, 0
    for k in sorted(sums):
        before[k] = so_far
        so_far += sums[k]
    base = df.sparkSession.createDataFrame(list(before.items()), f"{part} int, __base long")
    window = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(base), part, "left")  # one row per partition
    out = out.withColumn(total, F.col("__base") + F.coalesce(F.sum(value).over(window), F.lit(0)))
    return out.drop(part, "__base"), so_far
