"""Chunking, retrieval and knowledge packs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.functions.batches import pieces
from procurelake.operators.search import hybrid_topk  # noqa: F401 - retrieval's own name for it

CHUNK, OVERLAP, LOOKBACK = 6000, 400, 800


def cut(text: str | None, size: int = CHUNK, overlap: int = OVERLAP, window: bool = False) -> list[str]:
    """Pieces of at most ``size`` characters that overlap.

    A piece that isn't the last ends at the last empty line at or before its end, if that lies in its last 800 characters;
    with ``window`` at the last one that lies wholly within these, which may be the first of them.
    """
    pieces, at = [], 0
    text = text or ""
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            if window:
                line = text.rfind("\n\n", max(at + size - LOOKBACK, 0), end)
                end = line if line > at else end
            else:
                line = text.rfind("\n\n", 0, end + 2)
                end = line if line > max(at, at + size - LOOKBACK) else end
        pieces.append(text[at:end])
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return pieces


def chunk(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", window: bool = False) -> DataFrame:
    """(id, chunk_no from 0, chunk) by ``cut``; null and empty texts have none."""
    schema = T.StructType([docs.schema[id_col], T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [(i, n, c) for i, t in enumerate(b.column(1).to_pylist()) for n, c in enumerate(cut(t, size, overlap, window))]
            at, no, chunks = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(chunks, pa.string())], names=[id_col, "chunk_no", "chunk"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class ChunkText:
    """A table function: ``chunk_text(text, size, overlap)`` has the rows (chunk_no, chunk) of ``cut``."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(cut(text, size, overlap))


def register_table_functions(spark: SparkSession) -> None:
    """Let SQL of this session call ``chunk_text``, as in ``from docs, lateral chunk_text(docs.text, 6000, 400)``."""
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_no int, chunk string"))


def chunk_fixed(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same at a fixed stride, without Python: (id, chunk_no, chunk)."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text_col) - overlap) / F.lit(step)), F.lit(1)).cast("int")
    rows = docs.where(F.length(text_col) > 0).select(id_col, F.col(text_col).alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select(id_col, "chunk_no", F.substring(F.col("t"), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


#: Lists of a knowledge pack, with the kind of document that each entry becomes.
PACK_LISTS = ("outline", "methods", "qualifications", "score_points", "regulations", "risks", "templates")


def flatten_pack(packs: DataFrame) -> DataFrame:
    """(doc_id, kind, title, tags, content): one overview per pack and one document per entry of each list.

    Packs are rows (pack_key, name, overview, and the lists as ARRAY<STRUCT<title, content, tags>>); missing lists and
    null entries have no documents.
    """
    base = packs.select(F.concat_ws("/", "pack_key", F.lit("overview")).alias("doc_id"), F.lit("overview").alias("kind"), F.col("name").alias("title"), F.array("pack_key").alias("tags"), F.coalesce("overview", F.lit("")).alias("content"))
    for name in PACK_LISTS:
        if name in packs.columns:
            each = packs.select("pack_key", F.posexplode(name).alias("no", "e")).where("e is not null")
            tags = F.concat(F.array(F.col("pack_key"), F.lit(name)), F.coalesce("e.tags", F.array().cast("array<string>")))
            base = base.unionByName(each.select(F.concat_ws("/", "pack_key", F.lit(name), "no").alias("doc_id"), F.lit(name).alias("kind"), "e.title", tags.alias("tags"), "e.content"))
    return base


def extract_json(text: str | None) -> str | None:
    """The first balanced {...} of a text after code fences are taken out; quoted braces don't count."""
    text = (text or "").replace("```json", "").replace("```", "")
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = escaped or c != '"', c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


def salvage_json(rows: DataFrame, text_col: str = "text", out_col: str = "json") -> DataFrame:
    """``rows`` with the JSON object that a model's answer holds, or null; brace counting isn't regular, so in Python."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(extract_json)

    return rows.withColumn(out_col, found(F.col(text_col)))
