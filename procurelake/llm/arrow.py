"""Arrow batches for the operators that run in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows and bytes that are Python objects at once, about; a longer row stands alone.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Characters that numpy steps work on at once.
BLOCK_CHARS = 1 << 18


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of at most BATCH_ROWS rows and about BATCH_BYTES bytes of text."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, a = np.cumsum(size), 0
    while a < batch.num_rows:
        most = (ends[a - 1] if a else 0) + BATCH_BYTES
        b = max(a + 1, min(a + BATCH_ROWS, int(np.searchsorted(ends, most, "right"))))
        yield batch.slice(a, b - a)
        a = b


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to stretches of rows, given and returned as lists by column."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = fn({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters; a longer text stands alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)
