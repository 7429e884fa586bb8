"""Requirements from tender texts: chunk, extract, tidy up, first wins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.functions.batches import pieces
from procurelake.functions.text import clip
from procurelake.operators.evidence import dedup_requirements, normalize_requirements
from procurelake.operators.retrieval import CHUNK, OVERLAP, chunk, extract_json


def _array(said: str) -> list | None:
    """The list in an answer: the array itself, or the first list in the first object, whatever stands around them."""
    bare = said.replace("```json", "").replace("```", "")
    places = sorted((bare.find(c), c) for c in "[{" if c in bare)
    for at, c in places:
        try:
            if c == "[":
                found, _ = json.JSONDecoder().raw_decode(bare, at)
            else:
                found = next((v for v in json.loads(extract_json(bare) or "null").values() if isinstance(v, list)), None)
        except (ValueError, AttributeError):
            continue
        if isinstance(found, list):
            return found
    return None


def answered(extractor: Callable[[str], str], chunk: str, attempts: int) -> tuple[str | None, int, str]:
    """(the JSON array that an extractor answers with, attempts made, what was wrong with the last).

    The array is null after the last attempt: an error or an answer without one.
    """
    wrong = ""
    for k in range(1, attempts + 1):
        try:
            found = _array(extractor(chunk))
        except Exception as error:  # noqa: BLE001 - whatever a model's client raises
            wrong = f"{type(error).__name__}: {error}"[:200]
            continue
        if found is not None:
            return json.dumps(found, ensure_ascii=False), k, ""
        wrong = "no list in the answer"
    return None, attempts, wrong


def ask_chunks(tenders: DataFrame, extractor: Callable[[str], str], size: int = CHUNK, overlap: int = OVERLAP, most_chars: int | None = 120_000, attempts: int = 3) -> DataFrame:
    """(tender_id, chunk_no, json, attempts, error) of every chunk of tenders (tender_id, text).

    ``extractor`` gives a JSON array of requirements for a chunk's text; it runs in Python workers, a piece of a batch at a
    time, and is the only part that may be a model.  It is asked ``attempts`` times at most; then json is null and
    error says why.  Blank tenders have no chunks.  Text after ``most_chars`` characters is left out; None reads all.
    """
    text = F.col("text") if most_chars is None else clip(F.col("text"), most_chars)
    docs = tenders.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("tender_id", text.alias("text"))
    chunks = chunk(docs, size, overlap, "tender_id")
    tender = docs.schema["tender_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            said = list(zip(*(answered(extractor, c, attempts) for c in b.column("chunk").to_pylist()), strict=True))
            told = [pa.array(x, kind) for x, kind in zip(said, (pa.string(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("tender_id"), b.column("chunk_no"), *told], names=["tender_id", "chunk_no", "json", "attempts", "error"])

    return chunks.mapInArrow(run, f"tender_id {tender}, chunk_no int, json string, attempts int, error string")


def requirements_of(asked: DataFrame) -> DataFrame:
    """(tender_id, id, source_chunk, category, content, mandatory, keywords) of what ``ask_chunks`` gives.

    Answers are tidied, and of requirements of a tender that start alike the first stays.  A chunk whose answers all
    failed adds nothing; it is a row of ``failed_chunks``.
    """
    keyed = asked.where("json is not null").withColumn("place", F.struct("tender_id", "chunk_no"))
    items = normalize_requirements(keyed.drop("tender_id"), "json", "place")
    items = items.select("place.tender_id", F.col("place.chunk_no").alias("chunk_no"), F.col("id").alias("item_no"), "category", "content", "mandatory", "keywords")
    return dedup_requirements(items).select("tender_id", "id", F.col("chunk_no").alias("source_chunk"), "category", "content", "mandatory", "keywords")


def failed_chunks(asked: DataFrame) -> DataFrame:
    """(tender_id, chunk_no, attempts, error) of chunks without an answer."""
    return asked.where("json is null").select("tender_id", "chunk_no", "attempts", "error")


def extract_requirements(tenders: DataFrame, extractor: Callable[[str], str], size: int = CHUNK, overlap: int = OVERLAP, most_chars: int | None = 120_000, attempts: int = 3, strict: bool = True) -> DataFrame:
    """The requirements of tenders (tender_id, text): ``requirements_of`` what ``ask_chunks`` gives.

    A chunk whose answers all failed ends the job with its error; with ``strict`` false it has no requirements.  To
    have both the requirements and the failures, save what ``ask_chunks`` gives and use it twice.
    """
    asked = ask_chunks(tenders, extractor, size, overlap, most_chars, attempts)
    if strict:
        asked = asked.withColumn("json", F.coalesce("json", F.raise_error(F.concat(F.lit("no requirements of chunk "), F.col("chunk_no").cast("string"), F.lit(": "), F.col("error"))).cast("string")))
    return requirements_of(asked)
