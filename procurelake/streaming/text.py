"""Document checks on streams.

The checks within a row hold for streaming DataFrames as they are; these wrap a source and a sink around them and add
counts over event time.  Checks that rank or join a stream with itself run per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from procurelake.operators.clauses import clause_match
from procurelake.operators.pii import mask_pii, scan_disclosure


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint", files_per_trigger: int = 64) -> DataFrame:
    """A stream of document rows from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def masked(stream: DataFrame) -> DataFrame:
    return mask_pii(stream)


def disclosures(stream: DataFrame) -> DataFrame:
    return scan_disclosure(stream)


def clauses(stream: DataFrame) -> DataFrame:
    return clause_match(stream)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, end, event_type, n, total): events by type in windows of event time; later ones than ``late`` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select("window.start", "window.end", "event_type", "n", "total")


def for_each_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator on each micro-batch and write its rows under the batch's number, so a repeat overwrites."""

    def run(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
