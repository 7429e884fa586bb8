"""Token ids in a content-addressed store of Parquet files.

Each document's ids, with an end id, are cut where a rolling hash of the last ids has zero low bits, so equal
passages give equal chunks wherever they stand.  One job encodes the texts and writes each different chunk once and
one recipe for each document.  The store is a folder with three tables:

* ``data/kind=chunk``: (digest, payload, owner, n_refs), the payload being zstandard-packed 16- or 32-bit ids, the
  owner the first place that has the chunk;
* ``recipes``: (part, doc_id, tie, copy, start, n_tokens, digests, root) in ascending doc_id order, with the place of
  the document's first id in the whole stream and the Merkle root of its chunk digests;
* ``manifest``: (part, n_docs, start, n_tokens, root) for each range of recipes, with the root over its documents.

Reading checks the recipes against the manifest, gathers a document's own chunks, adds those it shares with an earlier
place, and checks digests and roots.

Texts are encoded as the tokenizers library encodes them with add_special_tokens=False: the string of an added token in a
text becomes that token's id.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.arrow import map_batches
from procurelake.llm.bpe import encode_texts
from procurelake.llm.pieces import IDS, PieceTable
from procurelake.operators.ordering import running_total
from procurelake.storage import Scratch, release_shuffles

END_ID = 2
#: A chunk ends after an id where the hash has this many zero low bits, at MIN_IDS at least and MAX_IDS at most.
CUT_BITS, MIN_IDS, MAX_IDS = 10, 128, 8192
#: Ids under the rolling hash.
ROLL = 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte, by Latin-1 code point."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """The library's ids of texts; pre-tokens that recur are looked up, the others go to the library's own model.

    Texts that hold one of the tokenizer's added tokens literally go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        model, signs = self.tokenizer.model, _byte_signs()
        self.pieces = PieceTable(lambda piece: [t.id for t in model.tokenize(piece.decode("latin-1").translate(signs))])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as with add_special_tokens=False; null has none."""
        full = [t or "" for t in texts]
        whole = [i for i, t in enumerate(full) if any(a in t for a in self.added)]
        out = encode_texts(["" if i in whole else t for i, t in enumerate(full)] if whole else full, self.pieces)
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(full[i], add_special_tokens=False).ids, IDS)
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document: where a rolling hash of the last ids says so."""
    n = len(ids)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    sums = np.cumsum(mixed)  # modulo 2**64: the window's sum is a difference
    rolled = sums.copy()
    rolled[ROLL:] -= sums[:-ROLL]
    rolled *= np.uint64(0xC2B2AE3D27D4EB4F)
    marks = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + 1
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if m - last >= MIN_IDS or m == n and m > last:
            ends.append(m)
            last = m
    return ends


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node goes up as it is.  No leaves: the digest of nothing."""
    level = digests or [_digest(b"")]
    while len(level) > 1:
        level = [_digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _pack(chunk: np.ndarray, compressor) -> bytes:
    """16-bit ids if they fit (mark 2), else 32-bit (mark 4), compressed."""
    width = 2 if int(chunk.max(initial=0)) < 1 << 16 else 4
    return bytes([width]) + compressor.compress(chunk.astype(f"<u{width}").tobytes())


def _unpack(payload: bytes, decompressor) -> bytes:
    return np.frombuffer(decompressor.decompress(payload[1:]), f"<u{payload[0]}").astype(IDS).tobytes()


MANIFEST = T.StructType([T.StructField(k, v) for k, v in (("part", T.IntegerType()), ("n_docs", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("root", T.BinaryType()))])
OWNER = T.StructType([T.StructField("tie", T.LongType()), T.StructField("at", T.IntegerType())])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """Recipe rows and chunk rows of every document, by ``kind``; ``digest`` is the key of a row among its kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tie"), F.col(text_col).alias("text"))
    fields = [("tie", T.LongType()), ("at", T.IntegerType()), ("digest", T.BinaryType()), ("payload", T.BinaryType()), ("n_tokens", T.LongType()), ("digests", T.ArrayType(T.BinaryType())), ("root", T.BinaryType())]
    schema = T.StructType([T.StructField("kind", T.StringType()), rows.schema["doc_id"], *[T.StructField(k, v) for k, v in fields]])

    def run(b: dict[str, list]) -> dict[str, list]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True)
        out: dict[str, list] = {name: [] for name in schema.names}

        def add(*values) -> None:
            for name, value in zip(schema.names, values, strict=True):
                out[name].append(value)

        for doc_id, tie, ids in zip(b["doc_id"], b["tie"], encoder(tokenizer_path).encode(b["text"]), strict=True):
            ids = np.append(ids, IDS.type(END_ID))
            ends = cuts(ids)
            parts = [ids[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
            digests = [_digest(p.tobytes()) for p in parts]
            add("recipe", doc_id, tie, 0, _digest((f"{tie} null" if doc_id is None else f"{tie} id {doc_id}").encode()), None, len(ids), digests, merkle(digests))
            for at, (digest, part) in enumerate(zip(digests, parts, strict=True)):
                add("chunk", doc_id, tie, at, digest, _pack(part, squeeze), None, None, None)
        return out

    return map_batches(rows, run, schema)


def _parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_store(docs: DataFrame, path: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write the store of all rows to the folder ``path`` and return the number of ids.

    Null and empty texts are the end id alone.  Rows are ordered by id, null ids first; rows that share an id by a
    hash of the text; equal rows follow each other.  No rows: empty tables.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokenstore")
    packed = pack(docs, tokenizer_path or default_tokenizer(), id_col, text_col)
    firsts = [F.first(c).alias(c) for c in ("payload", "n_tokens", "digests", "root")]
    once = packed.groupBy("kind", "digest").agg(F.min(F.struct("doc_id", "tie", "at")).alias("owner"), F.count("*").alias("n_refs"), *firsts)
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    del once, packed
    release_shuffles(spark)
    light = _data(spark, path, "recipe", docs.schema[id_col].dataType).select("owner.doc_id", "owner.tie", F.explode(F.expr("sequence(1L, n_refs)")).alias("copy"), "n_tokens", "digests", "root")
    ordered, total = running_total(light, [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("copy")], "n_tokens", "start", scratch)
    placed = ordered.repartitionByRange(_parts(spark), "start").sortWithinPartitions("start")
    placed.select(F.spark_partition_id().alias("part"), "doc_id", "tie", "copy", "start", "n_tokens", "digests", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(_recipes(spark, path, docs.schema[id_col].dataType)).write.parquet(f"{path}/manifest")
    scratch.drop_all()
    del light, ordered, placed
    release_shuffles(spark)
    return total


def _data(spark: SparkSession, path: str, kind: str, id_type: T.DataType) -> DataFrame:
    owner = T.StructType([T.StructField("doc_id", id_type), *OWNER.fields])
    fields = [("digest", T.BinaryType()), ("owner", owner), ("n_refs", T.LongType()), ("payload", T.BinaryType()), ("n_tokens", T.LongType()), ("digests", T.ArrayType(T.BinaryType())), ("root", T.BinaryType()), ("kind", T.StringType())]
    return spark.read.schema(T.StructType([T.StructField(k, v) for k, v in fields])).parquet(f"{path}/data").where(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    fields = [("part", T.IntegerType()), ("doc_id", id_type), ("tie", T.LongType()), ("copy", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("digests", T.ArrayType(T.BinaryType())), ("root", T.BinaryType())]
    return spark.read.schema(T.StructType([T.StructField(k, v) for k, v in fields])).parquet(f"{path}/recipes")


def _manifest(recipes: DataFrame) -> DataFrame:
    """Merkle roots of the ranges of recipes; a range is one partition of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[tuple[int, int, bytes]]] = {}
        for b in batches:
            for part, *row in zip(*[b.column(c).to_pylist() for c in ("part", "start", "n_tokens", "root")], strict=True):
                ranges.setdefault(part, []).append(tuple(row))
        for part, rows in ranges.items():
            rows.sort()
            columns = [[part], [len(rows)], [rows[0][0]], [sum(r[1] for r in rows)], [merkle([r[2] for r in rows])]]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=MANIFEST.names)

    return recipes.select("part", "start", "n_tokens", "root").repartition(_parts(recipes.sparkSession), "part").mapInArrow(run, MANIFEST)


def verify_manifest(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> int:
    """The number of ids by the manifest; an error if a range of recipes doesn't match it or a range is missing.

    One row for each range, of which there is one a partition, comes to the driver.
    """
    recipes = _recipes(spark, path, id_type or T.LongType())
    told, found = ({r.part: tuple(r) for r in df.collect()} for df in (spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), _manifest(recipes)))
    for part in sorted({*told, *found}):
        if told.get(part) != found.get(part):
            raise ValueError(f"range {part} of the recipes doesn't match the manifest")
    at = 0
    for _, _, start, n_tokens, _ in sorted(told.values(), key=lambda r: r[2]):
        if start != at:
            raise ValueError(f"the manifest has no range for the ids from {at} to {start}")
        at += n_tokens
    return at


def read_store(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids BINARY) of every document, rebuilt from the store's files.

    Recipes are checked against the manifest first.  A missing recipe, range or chunk, a payload that doesn't match its
    digest or a root that doesn't match the recipe is an error.  Only chunks with more than one reference are looked up
    by digest; the rest go straight to their owner.
    """
    id_type = id_type or T.LongType()
    verify_manifest(spark, path, id_type)
    recipes, chunks = _recipes(spark, path, id_type), _data(spark, path, "chunk", id_type)
    # one key column, null ids included, so that gathering and joining share one exchange
    key = lambda c: F.struct(F.col(f"{c}doc_id").alias("doc_id"), F.col(f"{c}tie").alias("tie")).alias("key")
    own = chunks.select(key("owner."), "owner.at", "payload")
    places = recipes.where("copy = 1").select("doc_id", "tie", F.posexplode("digests").alias("at", "digest"))
    shared = chunks.where("n_refs > 1").select("digest", "owner", "payload")
    again = places.join(shared, "digest").where(~F.struct("doc_id", "tie", "at").eqNullSafe(F.col("owner"))).select(key(""), "at", "payload")
    parts = own.unionByName(again).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("parts"))
    parts = parts.select("key", F.col("parts.payload").alias("payloads"))
    whole = recipes.withColumn("key", key("")).join(parts, "key", "left").select("doc_id", "start", "n_tokens", "digests", "root", "payloads")
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(b: dict[str, list]) -> dict[str, list]:
        import zstandard

        unsqueeze, out = zstandard.ZstdDecompressor(), []
        for start, n, root, digests, payloads in zip(b["start"], b["n_tokens"], b["root"], b["digests"], b["payloads"], strict=True):
            found = [_unpack(p, unsqueeze) for p in payloads or []]
            ids = b"".join(found)
            if [_digest(p) for p in found] != digests or merkle(digests) != root or len(ids) != 4 * n:
                raise ValueError(f"the document at {start} doesn't match its recipe")
            out.append(ids)
        return {"doc_id": b["doc_id"], "start": b["start"], "n_tokens": b["n_tokens"], "ids": out}

    return map_batches(whole, run, schema)


def store_digests(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store, read it back: (id, start, n_tokens, ids_crc32) of every document."""
    path = path or Scratch(docs.sparkSession, "tokenstore-files").path("store")
    write_store(docs, path, tokenizer_path, id_col, text_col)
    back = read_store(docs.sparkSession, path, docs.schema[id_col].dataType)
    return back.select(F.col("doc_id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
