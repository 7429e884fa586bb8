"""Hybrid retrieval over a term index: only documents that can reach a query's k-th score are scored.

A document's score is ``vector_share`` times a cosine plus the rest times the share of the query's terms that it
has.  With c of n terms it is at most ``vector_share + (1 - vector_share) * c / n`` (without the first part if the query
has no vector).  Hence, if a query's results must reach a score t, they need some least number m of its terms, and every
document with m of n terms has one of the n - m + 1 rarest (prefix filtering: Chaudhuri et al., ICDE 2006).

1. Seeds: the postings of each query's rarest term are scored; where they give k results, the k-th score is the new t.
2. The postings of the n - m + 1 rarest terms, for that t, are scored, and the best k stay.

Queries that documents without any common term can reach, and queries whose rarest terms are common, are scored against
all rows in blocks: a bounded block of queries goes to each task of the corpus as arrays, one pass over the corpus for each block.
Both ways are exact, to the last bit of the score, so which one a query takes changes no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.storage import Scratch

TOP_K, THRESHOLD, VECTOR_SHARE = 8, 0.2, 0.3
#: Rows that a query's prefix may reach, of all rows and between limits; queries that reach more are scored in blocks,
#: where a pair costs some thousandth of one that is looked up.
PREFIX_SHARE, PREFIX_LEAST, PREFIX_MOST = 1 / 500, 200, 1_000_000
#: Bytes of queries, about, that go to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Pairs up to which they are sent to the documents; beyond, the join shuffles.
BROADCAST_PAIRS = 200_000
#: Room for the last bits of sums in bounds; scores themselves are compared exactly.
ROOM = 1e-9
#: Queries up to which a corpus without an index is scored as it is.
ONCE_QUERIES = 2000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in order in double precision; null if one is zero, of another length or not finite."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    got = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(~F.isnan(got), got)


def score(vector_share: float, qv: Column, qt: Column, vec: Column, terms: Column) -> Column:
    """The similarity; null or empty terms share nothing, vectors without a cosine count 0."""
    share = F.coalesce(F.when(F.size(qt) > 0, F.size(F.array_intersect(qt, terms)) / F.size(qt)), F.lit(0.0))
    return vector_share * F.coalesce(cosine(qv, vec), F.lit(0.0)) + (1 - vector_share) * share


@dataclass
class TermIndex:
    """``docs``: row, doc_id, vec, terms (distinct, without nulls).  ``postings``: term, row.  ``lengths``: term, df."""

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame


def _terms(c: str) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))))


def build_index(corpus: DataFrame, path: str, wanted: DataFrame | None = None) -> TermIndex:
    """Write the index of ``corpus`` (doc_id, vec, terms) below ``path``, a folder that all executors reach.

    Every row of the corpus has its own entry, also one that repeats an id or has a null id.  With ``wanted`` (term) only
    the postings of these terms are kept: an index for one set of queries.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("vec").cast("array<double>").alias("vec"), _terms("terms").alias("terms"))
    docs.write.parquet(f"{path}/docs")
    postings = spark.read.parquet(f"{path}/docs").select(F.explode("terms").alias("term"), "row")
    if wanted is not None:
        postings = postings.join(wanted.select("term").distinct(), "term", "left_semi")
    postings.write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/lengths")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> TermIndex:
    """An index that ``build_index`` wrote."""
    return TermIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "lengths")])


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` (query_id, doc_id, similarity) of each query, with rank; equal similarities rank by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(pairs: DataFrame, queries: DataFrame, docs: DataFrame, vector_share: float) -> DataFrame:
    """(q, row, query_id, doc_id, similarity) of pairs (q, row)."""
    met = docs.join(F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs, "row").join(queries.select("q", "query_id", "qv", "qt"), "q")
    return met.select("q", "row", "query_id", "doc_id", score(vector_share, F.col("qv"), F.col("qt"), F.col("vec"), F.col("terms")).alias("similarity"))


def _least_terms(reach: Column, n: Column, vector: Column, vector_share: float) -> Column:
    """The least c with ``vector_share`` (if the query has a vector) + (1 - vector_share) * c / n >= reach."""
    rest = reach - F.when(vector, F.lit(vector_share)).otherwise(0.0) - ROOM
    return F.ceil(rest / (1 - vector_share) * n) if vector_share < 1 else F.when(rest > 0, n + 1).otherwise(0)


def _asked(queries: DataFrame, vector_share: float, scratch: Scratch) -> DataFrame:
    """(q, query_id, qv, qt, vector) of the queries; vector says whether the cosine can add to a score."""
    asked = queries.select(F.monotonically_increasing_id().alias("q"), "query_id", F.col("vec").cast("array<double>").alias("qv"), _terms("terms").alias("qt"))
    norm = F.aggregate(F.coalesce("qv", F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + F.abs(v))
    return scratch.save(asked.withColumn("vector", F.coalesce(norm > 0, F.lit(False)) & (F.lit(vector_share) != 0)), "queries")


def search(queries: DataFrame, index: TermIndex, k: int = TOP_K, threshold: float = THRESHOLD, vector_share: float = VECTOR_SHARE, prefix_most: int | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, rank): the ``k`` best rows of the index for each query at ``threshold`` or above.

    queries are (query_id, vec, terms), any number of them; rows that repeat a query_id pool their results.  A
    query without terms and vector has results only if the threshold is 0 or less.
    """
    scratch = Scratch(queries.sparkSession, "search")
    if prefix_most is None:
        prefix_most = min(PREFIX_MOST, max(PREFIX_LEAST, int(index.docs.count() * PREFIX_SHARE)))
    asked = _asked(queries, vector_share, scratch)
    # each query's terms with their numbers of documents, the rarest first
    each = asked.select("q", F.size("qt").alias("n"), "vector", F.explode("qt").alias("term")).join(index.lengths, "term", "left").fillna({"df": 0})
    by_query = Window.partitionBy("q").orderBy("df", "term")
    each = scratch.save(each.select("*", F.row_number().over(by_query).alias("place"), F.sum("df").over(by_query.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far")), "terms")

    def prefixed(reach: DataFrame) -> DataFrame:
        """(q, term, place, size, low): prefixes for the score that each query has to reach; low if no term is needed."""
        held = each.join(reach, "q", "left")
        goal = F.greatest(F.coalesce("reach", F.lit(float(threshold))), F.lit(float(threshold)))
        m = _least_terms(goal, F.col("n"), F.col("vector"), vector_share)
        held = held.withColumn("m", m).where(F.col("place") <= F.col("n") - F.greatest(F.col("m"), F.lit(1)) + 1)
        return held.withColumn("size", F.max("so_far").over(Window.partitionBy("q"))).withColumn("low", F.col("m") < 1)

    # the rarest term that any document has
    first = each.where("df > 0").groupBy("q").agg(F.min_by("term", "place").alias("term"), F.min("df").alias("df")).where(F.col("df") <= prefix_most)
    seeds = scratch.save(first.join(index.postings, "term").select("q", "row"), "seeds")
    seeded = scratch.save(_scored(seeds, asked, index.docs, vector_share).where(F.col("similarity") >= threshold), "seeded")
    top = Window.partitionBy("q").orderBy(F.desc("similarity"))
    reach = seeded.select("q", "similarity", F.row_number().over(top).alias("r")).where(F.col("r") == k).select("q", F.col("similarity").alias("reach"))
    prefix = scratch.save(prefixed(reach), "prefixes")
    told = prefix.groupBy("q").agg(F.max("size").alias("size"), F.max("low").alias("low"))
    wide = asked.join(told, "q", "left").where(F.coalesce(F.col("low"), F.col("vector") & F.lit(vector_share + ROOM >= threshold) | F.lit(threshold <= 0)) | (F.coalesce("size", F.lit(0)) > prefix_most))
    wide = scratch.save(wide.select(*asked.columns), "wide")
    sparse = prefix.join(wide.select("q"), "q", "left_anti")
    pairs = sparse.join(index.postings, "term").select("q", "row").distinct()
    pairs = scratch.save(pairs.join(seeds, ["q", "row"], "left_anti"), "pairs")
    found = _scored(pairs, asked, index.docs, vector_share).unionByName(seeded.join(wide.select("q"), "q", "left_anti"))
    columns = ["query_id", "doc_id", "similarity"]
    results = _best(found.where(F.col("similarity") >= threshold).select(*columns), k)
    for block in _blocks(wide):
        results = results.unionByName(_best(_against_all(block, index.docs, k, threshold, vector_share), k))
    # queries that repeat an id may have taken both ways
    return _best(results.select(*columns), k)


def _blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries on the driver, about BLOCK_BYTES at a time."""
    size = F.coalesce(F.size("qv"), F.lit(0)) * 8 + F.aggregate("qt", F.lit(0), lambda s, t: s + F.length(t) + 50) + 100
    total = queries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = -(-total // BLOCK_BYTES)
    for i in range(n):
        part = queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i).toArrow()
        if part.num_rows:
            yield part


def _dots(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sums of products, term by term in order, as the column expression has them."""
    return np.add.accumulate(rows * other, axis=1)[:, -1] if rows.shape[1] else np.zeros(len(rows))


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length but 0; a null component is NaN."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins, out = np.cumsum(lengths) - lengths, {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = at, values[begins[at][:, None] + np.arange(n)]
    return out


class _Best:
    """The best k of each query of a block over the batches of a task."""

    def __init__(self, block: pa.Table, k: int, threshold: float, share: float):
        self.k, self.threshold, self.share = k, threshold, share
        terms = block["qt"].to_pylist()
        self.n_terms = np.array([max(1, len(t)) for t in terms])
        by_term: dict[str, list[int]] = {}
        for i, ts in enumerate(terms):
            for t in ts:
                by_term.setdefault(t, []).append(i)
        self.vocabulary, self.asking = pa.array(by_term, pa.string()), list(by_term.values())
        self.vectors = _by_length(block["qv"].combine_chunks())
        self.best: list[list[tuple]] = [[] for _ in terms]  # (-similarity, whether the id is there, id), sorted
        self.least = np.full(len(terms), threshold)

    def take(self, ids: pa.Array, vectors: pa.Array, terms: pa.Array) -> None:
        counts = np.zeros((len(ids), len(self.best)))
        number = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        met = np.flatnonzero(number >= 0)
        met = met[np.argsort(number[met], kind="stable")]
        for some in np.split(met, np.flatnonzero(np.diff(number[met])) + 1) if len(met) else ():
            counts[np.ix_(row[some], self.asking[number[some[0]]])] += 1  # a row has a term once
        shares = (1 - self.share) * (counts / self.n_terms)
        about, cosines = shares.copy(), {}
        for n, (at, rows) in _by_length(vectors).items():
            if n in self.vectors:
                asked, q = self.vectors[n]
                with np.errstate(all="ignore"):
                    near = (rows / np.sqrt((rows * rows).sum(1))[:, None]) @ (q / np.sqrt((q * q).sum(1))[:, None]).T
                about[np.ix_(at, asked)] += self.share * np.where(np.isfinite(near), near, 0.0)
                cosines |= {i: (rows[j], n) for j, i in enumerate(at.tolist())}
        near_enough = about >= self.least - ROOM
        for j in np.flatnonzero(near_enough.any(0)).tolist():
            self._add(j, np.flatnonzero(near_enough[:, j]), ids, shares[:, j], cosines)

    def _add(self, j: int, rows: np.ndarray, ids: pa.Array, shares: np.ndarray, cosines: dict) -> None:
        exact = self.share * np.zeros(len(rows)) + shares[rows]
        for n, (asked, q) in self.vectors.items():
            at = np.flatnonzero(asked == j)
            same = [x for x, i in enumerate(rows.tolist()) if len(at) and i in cosines and cosines[i][1] == n]
            if same:
                v, own = np.array([cosines[rows[x]][0] for x in same]), np.repeat(q[at], len(same), 0)
                with np.errstate(all="ignore"):
                    got = _dots(own, v) / (np.sqrt(_dots(own, own)) * np.sqrt(_dots(v, v)))
                exact[same] = self.share * np.where(np.isfinite(got), got, 0.0) + shares[rows[same]]
        good = np.flatnonzero(exact >= self.least[j])
        add = [(-s, i is not None, i) for s, i in zip(exact[good].tolist(), ids.take(rows[good]).to_pylist(), strict=True)]
        self.best[j] = sorted(self.best[j] + add)[: self.k]
        if len(self.best[j]) == self.k:
            self.least[j] = max(self.threshold, -self.best[j][-1][0])


def _against_all(block: pa.Table, docs: DataFrame, k: int, threshold: float, vector_share: float) -> DataFrame:
    """(query_id, doc_id, similarity): the best ``k`` of each task's rows for each query of the block."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    query_type = from_arrow_schema(block.schema)["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("similarity", T.DoubleType())])
    target = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES at most, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = _Best(asked, k, threshold, vector_share)
        rows = max(1, (1 << 22) // max(1, asked.num_rows))
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                best.take(*batch.slice(a, rows).columns)
        names = asked["query_id"].to_pylist()
        found = [(names[j], i, -s) for j, kept in enumerate(best.best) for s, _, i in kept]
        cols = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return docs.select("doc_id", "vec", "terms").mapInArrow(run, schema)


def hybrid_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, vector_share: float = VECTOR_SHARE, prefix_most: int | None = None) -> DataFrame:
    """What ``search`` gives for a corpus (doc_id, vec, terms) without an index.

    Up to ONCE_QUERIES queries are scored in blocks at once, as making an index takes longer than that pass; more get an
    index of the terms that they use.
    """
    scratch = Scratch(corpus.sparkSession, "term-index")
    if queries.limit(ONCE_QUERIES + 1).count() <= ONCE_QUERIES:
        docs = corpus.select("doc_id", F.col("vec").cast("array<double>").alias("vec"), _terms("terms").alias("terms"))
        found = [_against_all(block, docs, k, threshold, vector_share) for block in _blocks(_asked(queries, vector_share, scratch))]
        if not found:
            kinds = (queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType, T.DoubleType())
            found = [corpus.sparkSession.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "doc_id", "similarity"), kinds, strict=True)]))]
        return _best(reduce(DataFrame.unionByName, found), k)
    wanted = scratch.save(queries.select(F.explode(_terms("terms")).alias("term")).distinct(), "wanted")
    index = build_index(corpus, scratch.path("index"), wanted)
    return search(queries, index, k, threshold, vector_share, prefix_most)
