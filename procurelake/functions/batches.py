"""Arrow batches in pieces, so that what Python holds of a batch at a time is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes of a piece at most; a row of more bytes is a piece by itself.
PIECE_ROWS, PIECE_BYTES = 128, 2 << 20


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, in slices of few rows and bytes.

    Spark sends up to 10,000 rows at once; what a step makes of them as Python objects can be many times as large.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > most:
                n //= 2
            yield batch.slice(at, n)
            at += n
