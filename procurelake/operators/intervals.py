"""Joins of points with intervals as equi-joins, by dyadic blocks.

An interval of whole numbers is a union of at most two aligned blocks of each size 2^k, and a point lies in one block of each
size.  Where rows meet on (size, block) and the other keys, each point meets each interval that holds it exactly
once.  So Spark can shuffle, broadcast or split the join as any other, whatever the lengths of the intervals and however
many are open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(c: Column, kind: str) -> Column:
    """Days of a date, microseconds of a timestamp, or the whole number itself."""
    return {"date": F.unix_date, "timestamp": F.unix_micros, "timestamp_ntz": lambda x: F.unix_micros(x.cast("timestamp"))}.get(kind, lambda x: x.cast("long"))(c).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, begin: str, end: str, on: list[str] | None = None) -> DataFrame:
    """The rows of ``points`` with those of ``intervals`` that hold ``at`` between ``begin`` and ``end``, both included.

    A null begin or end is open; a null ``at`` meets nothing, nor does an end before its begin.  ``on`` are columns of both
    that must be equal and not null.  Other column names must differ.  Repeated rows each meet.  Dates, timestamps or whole numbers.
    """
    on, kind = list(on or []), points.schema[at].dataType.simpleString()
    keyed = points.withColumn("__p", _number(F.col(at), kind)).where(F.col("__p").isNotNull())
    low, high = keyed.agg(F.min("__p"), F.max("__p")).first()
    if low is None:
        low = high = 0
    levels = max(0, int(high) - int(low)).bit_length()
    a = F.greatest(F.coalesce(_number(F.col(begin), kind), F.lit(low)), F.lit(low)) - F.lit(low)
    e = F.least(F.coalesce(_number(F.col(end), kind), F.lit(high)), F.lit(high)) - F.lit(low) + 1
    held = intervals.withColumns({"__a": a, "__e": e}).where("__a < __e")
    held = held.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    shift = lambda c: F.call_function("shiftright", c, F.col("__k"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__k"))
    held = held.withColumns({"__l": shift(F.col("__a") + size - 1), "__r": shift(F.col("__e"))}).where("__l < __r")
    ends = F.array(F.when(F.col("__l") % 2 == 1, F.col("__l")), F.when(F.col("__r") % 2 == 1, F.col("__r") - 1))
    held = held.withColumn("__b", F.explode(F.array_compact(ends))).drop("__a", "__e", "__l", "__r")
    each = keyed.withColumn("__p", F.col("__p") - F.lit(low)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    each = each.withColumn("__b", F.call_function("shiftright", F.col("__p"), F.col("__k"))).drop("__p")
    return each.join(held, [*on, "__k", "__b"]).drop("__k", "__b")
