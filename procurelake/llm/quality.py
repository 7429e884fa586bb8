"""Quality selection by importance resampling.

After Xie et al., "Data Selection for Language Models via Importance Resampling" (NeurIPS 2023): hashed counts of words
and pairs of neighbouring words make one generative model of the target (documents labelled good and not toxic) and
one of all documents.  A document's log-ratio is the sum over its n-grams of the logs of the two models' ratio, that is
the log of the ratio of its likelihoods.  Its weight is that sum, as published, or by default the mean over its n-grams, so
that long texts weigh no more than short ones; Gumbel noise on ``sharpness`` times the weight and the k largest keys are a
sample without replacement in proportion to exp(sharpness * weight).

The raw model counts every document.  The target is a bounded sample of labelled rows, chosen by hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.arrow import map_batches, slices
from procurelake.operators.ordering import running_total
from procurelake.storage import Scratch

BUCKETS_LOG2 = 18
#: Labelled rows that the target model is fitted on, about.
TARGET_ROWS = 20_000
SMOOTH = 1.0
#: Factor of the weight before noise: of a mean, and of a sum.
SHARPNESS = {"mean": 50.0, "sum": 1.0}
SEED = 7


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of the words of a text (A-Z lower-cased, ASCII white space apart) and of its word pairs."""
    words = (text or "").encode().lower().split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ one[1:] * np.uint64(0x165667B19E3779F9)
    mixed = np.concatenate([one, two]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def _counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all rows and over those marked ``target``; the sums that meet on the driver are two per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BUCKETS_LOG2), np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            found = [buckets(t) for t in batch.column("text").to_pylist()]
            for row, chosen in enumerate((found, [f for f, t in zip(found, batch.column("target").to_pylist(), strict=True) if t])):
                if chosen:
                    sums[row] += np.bincount(np.concatenate(chosen), minlength=sums.shape[1])
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "n", "t"])

    summed = docs.mapInArrow(count, "bucket bigint, n bigint, t bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    raw, target = np.zeros(1 << BUCKETS_LOG2), np.zeros(1 << BUCKETS_LOG2)
    for bucket, n, t in summed.toLocalIterator():
        raw[bucket], target[bucket] = n, t
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Log of the target's probability over the raw one, by bucket."""
    of = lambda c: np.log((c + smooth) / (c.sum() + smooth * len(c)))
    return (of(target) - of(raw)).astype(np.float32)


def resample(
    docs: DataFrame, labels: DataFrame, keep_share: float | None = None, target_rows: int = TARGET_ROWS, weight: str = "mean", sharpness: float | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, log_ratio, log_weight, sample_key, kept) of every row.

    ``weight`` is ``mean`` or ``sum``: log_weight is the log-ratio over the number of n-grams, or the log-ratio itself.
    ``labels`` has doc_id, quality and toxic.  ``keep_share`` of all rows are kept, by default the share of good ones
    among the labelled; k is rounded down.  Texts without words have a null weight and key and come last.  Equal
    keys go by id, then by a hash of the text; null ids take part.  Without labels of good documents the target is
    empty, every weight is about 0 and the choice is by noise alone.
    """
    factor = SHARPNESS[weight] if sharpness is None else sharpness
    scratch = Scratch(docs.sparkSession, "quality")
    marks = labels.select(F.col("doc_id").alias("l_id"), "quality", "toxic").where("l_id is not null")
    n, good, clean = marks.agg(F.count("quality"), F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))).first()
    below = ceil(min(1.0, target_rows / max(clean, 1)) * (1 << 30))
    chosen = marks.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).where(F.pmod(F.xxhash64(F.lit(SEED), "l_id"), F.lit(1 << 30)) < below).select("l_id").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows.join(F.broadcast(chosen), rows.doc_id == F.col("l_id"), "left").select("text", F.col("l_id").isNotNull().alias("target"))  # about target_rows ids
    sent = docs.sparkSession.sparkContext.broadcast(log_ratio(*_counts(marked)))
    keyed = rows.withColumn("fp", F.xxhash64(F.coalesce("text", F.lit(""))))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType()), T.StructField("log_ratio", T.DoubleType()), T.StructField("log_weight", T.DoubleType())])

    def score(b: dict[str, list]) -> dict[str, list]:
        found = [buckets(t) for t in b["text"]]
        sums = [float(sent.value[g].sum(dtype=np.float64)) if len(g) else None for g in found]
        weights = sums if weight == "sum" else [None if x is None else x / len(g) for x, g in zip(sums, found, strict=True)]
        return {"doc_id": b["doc_id"], "fp": b["fp"], "log_ratio": sums, "log_weight": weights}

    scored = map_batches(keyed.select("doc_id", "fp", "text"), score, schema)
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "fp"), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    scored = scored.withColumn("sample_key", F.col("log_weight") * factor - F.log(-F.log(uniform))).withColumn("one", F.lit(1).cast("long"))
    scored = scratch.save(scored, "scored")  # dealing by range reads its input twice
    ranked, total = running_total(scored, [F.col("sample_key").desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("fp")], "one", "rank", scratch)
    k = int(total * (keep_share if keep_share is not None else good / max(n, 1)))
    return ranked.select(F.col("doc_id").alias(id_col), "log_ratio", "log_weight", "sample_key", (F.col("sample_key").isNotNull() & (F.col("rank") < k)).alias("kept"))
