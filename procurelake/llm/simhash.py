"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 signed sums over word shingles (Charikar, STOC 2002).  Pairs within radius 2 are
found by covering LSH (Pagh, SODA 2016): bit i gets a non-zero vector g(i) of three bits, and table v
(one of the seven non-zero vectors) keeps the bits with <g(i), v> = 1.  Two differing bits leave a
v that is orthogonal to both, so in that table the pair collides for certain.

Buckets of more than ``bucket_max`` fingerprints aren't paired.  Their members are linked through the 65
values at distance 0 or 1 from each: two fingerprints differ in at most 2 bits exactly when they share
such a value, so linking all that share one to the least of them gives the same components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.arrow import map_batches
from procurelake.operators.graph import connected_components
from procurelake.storage import Scratch

RADIUS = 2
SHINGLE = 3
SEED = 42
BUCKET_MAX = 32


def masks() -> list[int]:
    """The seven bit masks, as signed 64-bit integers."""
    out = []
    for v in range(1, 8):
        m = sum(1 << i for i in range(64) if ((i % 7 + 1) & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as a signed 64-bit integer; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        starts = [0, *ends[:-width].tolist()]
        hashed = xxhash.xxh64_digest
        digests = b"".join([hashed(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)])
    n = len(digests) // 8
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1)
    counts = np.zeros(64, np.int64)
    whole = n - n % 255
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp BIGINT) of every row.  Null and empty texts have fingerprint 0; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return map_batches(rows, lambda b: {"doc_id": b["doc_id"], "fp": [fingerprint(t) for t in b["text"]]}, schema)


def links(fps: DataFrame, scratch: Scratch, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """Edges (a, b) between different fingerprints within the radius whose components are those of all such pairs.

    ``fps`` has one row for each distinct ``fp``.
    """
    tables = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks())])
    keyed = fps.select("fp", F.explode(tables).alias("t")).select("t.v", "t.key", "fp")
    shared = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.save(keyed.join(shared, ["v", "key"]), "buckets")
    small = met.where(F.col("n") <= bucket_max).drop("n")
    other = small.withColumnRenamed("fp", "other")
    near = small.join(other, ["v", "key"]).where("fp > other").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)
    crowded = met.where(F.col("n") > bucket_max).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    reached = scratch.save(crowded.select("fp", F.explode(around).alias("mid")), "reached")
    least = reached.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = reached.join(least, "mid").where("fp > b").select(F.col("fp").alias("a"), "b")
    return near.select(F.col("fp").alias("a"), F.col("other").alias("b")).unionByName(through).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_max: int = BUCKET_MAX) -> DataFrame:
    """(id, fingerprint, component_id, n_same) of every row of ``docs``.

    component_id is the least id that links lead to, n_same the rows with the same fingerprint.  Rows with a
    null id take part (their fingerprint links others); a component of null ids alone has a null component_id.
    Rows that repeat an id each get a row.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "classes")
    found = connected_components(links(classes.select("fp"), scratch, bucket_max))
    placed = classes.join(found, classes.fp == found.node, "left").select("fp", "least", "n_same", F.coalesce("component", "fp").alias("root"))
    placed = scratch.save(placed, "placed")
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(first, "root").select("fp", "component_id", "n_same")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(by_fp, "fp").select(F.col("doc_id").alias(id_col), hexed.alias("fingerprint"), "component_id", "n_same")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_max: int = BUCKET_MAX) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near-duplicates keeps its first.

    First is the least id, null ids last, then a hash of the text; of rows with equal id and text one stays.
    """
    key = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("fp"))
    keyed = docs.withColumn("__pl_key", key)
    groups = near_duplicates(keyed.select("__pl_key", text_col), "__pl_key", text_col, bucket_max)
    first = groups.where(F.col("__pl_key") == F.col("component_id")).groupBy(F.col("__pl_key.id").alias("__pl_id"), F.col("__pl_key.fp").alias("__pl_fp")).agg(F.count("*").alias("__pl_n"))
    first = Scratch(docs.sparkSession, "one-of-each").save(first, "first")
    found = keyed.join(first, keyed[id_col].eqNullSafe(F.col("__pl_id")) & (F.col("__pl_key.fp") == F.col("__pl_fp")))
    once = found.where("__pl_n = 1").select(*docs.columns)
    if first.where("__pl_n > 1").isEmpty():
        return once
    # rows that repeat id and text are equal but for other columns
    again = found.where("__pl_n > 1").dropDuplicates(["__pl_key"]).select(*docs.columns)
    return once.unionByName(again)
