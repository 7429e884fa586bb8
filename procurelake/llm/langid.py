"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of lower-cased letters (anything else is one blank) per language in each task and adds
the counts up; the matrix of log-probabilities goes to every worker as a broadcast variable, and documents are
scored in blocks by summing matrix columns between document boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.arrow import blocks, map_batches, slices

BUCKETS_LOG2 = 16
LENGTHS = (1, 2, 3)
#: Training documents of each language, about: rows are taken by a hash of id and text.
TRAIN_ROWS = 4000
#: Languages; with the buckets they bound the matrix that is broadcast (256 languages: 67 MB).
MAX_LANGS = 256
UNKNOWN = "und"
#: Odd 64-bit factors; their values are free.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@cache
def _letters() -> np.ndarray:
    """The code point itself for letters, else a blank."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def _points(text: str) -> np.ndarray:
    """Letters of a lower-cased text between single blanks."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = points == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return points[keep]


def _buckets(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each place, as far as it fits."""
    wide = points.astype(np.uint64)
    h = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for i in range(n):
        h = (h ^ wide[i : i + len(h)]) * FACTORS[i]
        h ^= h >> np.uint64(29)
    return (h * FACTORS[0] >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def count_ngrams(texts: list[str]) -> np.ndarray:
    """Counts by bucket over all texts."""
    out = np.zeros(1 << BUCKETS_LOG2, np.int64)
    for text in texts:
        points = _points(text)
        for n in LENGTHS:
            out += np.bincount(_buckets(points, n), minlength=len(out))
    return out


class Model:
    """Languages in order, the log-probabilities (language, bucket) and the log-priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        self.logp = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1])).astype(np.float32)
        self.prior = np.log(rows / rows.sum()) if len(langs) else np.zeros(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        full = [t or "" for t in texts]
        for a, b in blocks(full):
            points = [_points(t) for t in full[a:b]]
            told = [i for i, p in enumerate(points) if (p != 32).any()]
            if not told:
                continue
            sums = np.zeros((len(told), len(self.langs)))
            for n in LENGTHS:
                grams = [_buckets(points[i], n) for i in told]
                have = [k for k, g in enumerate(grams) if len(g)]
                if have:
                    sizes = [len(grams[k]) for k in have]
                    every, starts = np.concatenate([grams[k] for k in have]), np.cumsum([0, *sizes[:-1]])
                    for j in range(len(self.langs)):
                        sums[have, j] += np.add.reduceat(self.logp[j, every], starts, dtype=np.float64)
            sums += self.prior
            sums -= sums.max(axis=1, keepdims=True)
            share = np.exp(sums)
            share /= share.sum(axis=1, keepdims=True)
            for k, i in enumerate(told):
                j = int(share[k].argmax())
                names[a + i], scores[a + i] = self.langs[j], float(share[k, j])
        return names, scores


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3.  A null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_langs: int = MAX_LANGS) -> Model:
    """Fit on rows that aren't held out, have a language and a text: about ``rows_per_lang`` of each, by hash.

    The hash of id and text picks the rows, so the choice depends on neither order nor partitions; rows that share an id
    are told apart by their texts.  Fewer rows than that are all used.  The priors are the shares of the languages among
    all rows that may be learned from, not among those picked.  Without any such row the model knows no language.  More
    languages than ``max_langs`` are an error: with the buckets they bound the matrix that is broadcast.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1 << BUCKETS_LOG2)), np.zeros(0))
    below = {k: ceil(min(1.0, rows_per_lang / n) * (1 << 30)) for k, n in sizes.items()}
    limit = F.create_map(*[F.lit(x) for kv in below.items() for x in kv])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 30)) < limit).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = count_ngrams([text])
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(got[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    counted = chosen.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts, row = np.zeros((len(langs), 1 << BUCKETS_LOG2)), {k: i for i, k in enumerate(langs)}
    for r in counted.toLocalIterator():  # at most languages times buckets
        counts[row[r[0]], r[1]] = r[2]
    return Model(langs, counts, np.array([sizes[k] for k in langs], np.float64))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    Null texts and texts without letters are ``und`` with score 0, as is every text if the model knows no
    language.  Score is the posterior.  Equal posteriors go to the language that sorts first.  Whole texts
    count; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(b: dict[str, list]) -> dict[str, list]:
        names, scores = sent.value.predict(b["text"])
        return {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": names, "score": scores}

    return map_batches(rows, run, schema).withColumnRenamed("doc_id", id_col)


def identify(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on ``docs`` and predict all of its rows."""
    return predict(docs, train(docs, rows_per_lang, id_col, text_col, lang_col), id_col, text_col)


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose language the model tells with at least ``min_score``; ``und`` goes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            names, scores = sent.value.predict(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
