"""Streams with keyed state: the first of like requirements, and facts that later ones replace.

Rows may come in any order.  A key's state is a few values, so it stays small however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procurelake.functions.text import bare


def first_requirements(items: DataFrame, wait: str = "1 hour", keep: str = "1 day", ts_col: str = "ts", key_len: int = 40) -> DataFrame:
    """(tender_id, key, chunk_no, item_no, content): the first of each tender's requirements that start alike.

    items are a stream of (tender_id, chunk_no, item_no, content, ts).  First is the least (chunk_no, item_no), as in the batch
    operator, among the rows that come until event time has passed the key's first row by ``wait``; then it is
    emitted, and rows of the key that come later are left out, for ``keep`` at least.  Rows without tender, content or
    time are left out.  So the stream equals the batch when no row is later than ``wait``.
    """
    later = int(pd.Timedelta(keep).total_seconds() * 1000)
    tender = items.schema["tender_id"].dataType.simpleString()
    keyed = items.where(F.col("tender_id").isNotNull() & F.col("content").isNotNull() & F.col(ts_col).isNotNull())
    # the watermark stays ``wait`` behind, so a key is due when it has passed the key's first row
    keyed = keyed.withWatermark(ts_col, wait).select("tender_id", F.substring(bare(F.col("content")), 1, key_len).alias("key"), "chunk_no", "item_no", "content", F.col(ts_col).alias("ts"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = state.get if state.exists else None
        if held and held[4]:  # emitted before: others are left out, and at last the mark goes too
            if state.hasTimedOut:
                state.remove()
            else:
                state.setTimeoutTimestamp(now + later)
            return
        if held and (state.hasTimedOut or held[3] < now):
            chunk_no, item_no, content, due, _ = held
            state.update((chunk_no, item_no, "", due, True))
            state.setTimeoutTimestamp(now + later)
            yield pd.DataFrame({"tender_id": [key[0]], "key": [key[1]], "chunk_no": [chunk_no], "item_no": [item_no], "content": [content]})
            return
        best, due = (held[:3], held[3]) if held else (None, None)
        for rows in frames:
            for r in rows.itertuples():
                found, at = (int(r.chunk_no), int(r.item_no), r.content), int(r.ts.timestamp() * 1000)
                best = found if best is None else min(best, found)
                due = at if due is None else min(due, at)
        state.update((*best, due, False))
        state.setTimeoutTimestamp(max(due, now) + 1)

    return keyed.groupBy("tender_id", "key").applyInPandasWithState(
        step, f"tender_id {tender}, key string, chunk_no long, item_no long, content string", "chunk_no long, item_no long, content string, due long, done boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def merged_facts(updates: DataFrame, ts_col: str = "ts") -> DataFrame:
    """(project_id, facts MAP) after each batch, of the projects that it changed.

    updates are a stream of (project_id, facts MAP, ts).  Of the values of a fact the latest by time wins, of those of one
    time the greatest, whatever the order in which they come; null maps and times add nothing.
    """
    project = updates.schema["project_id"].dataType.simpleString()
    each = updates.where(F.col("project_id").isNotNull() & F.col(ts_col).isNotNull()).select("project_id", F.explode("facts").alias("fact", "value"), F.unix_micros(F.col(ts_col)).alias("at"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values, times = state.get if state.exists else ([], [], [])
        held = {n: (t, v) for n, v, t in zip(names, values, times, strict=True)}
        before = dict(held)
        for rows in frames:
            for r in rows.itertuples():
                new = (int(r.at), r.value or "")
                held[r.fact] = max(held.get(r.fact, new), new)
        state.update((list(held), [v for _, v in held.values()], [t for t, _ in held.values()]))
        if held != before:
            yield pd.DataFrame({"project_id": [key[0]], "facts": [{n: v for n, (_, v) in sorted(held.items())}]})

    return each.groupBy("project_id").applyInPandasWithState(step, f"project_id {project}, facts map<string,string>", "names array<string>, vals array<string>, times array<long>", "update", GroupStateTimeout.NoTimeout)
