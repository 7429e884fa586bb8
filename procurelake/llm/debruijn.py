"""Substring dedup: a de Bruijn graph of word windows, compacted, and its repeated paths verified at their sources.

A window of ``width`` words is an edge from its first ``width - 1`` words to its last.  A node through which
every occurrence comes by one edge and leaves by one doesn't branch; edges joined by such nodes lie in the same documents,
so a whole path repeats or none of it.  Three reductions keep the graph small:

1. Windows that share their least hash of ``width // 2`` words (a minimizer) and are neighbours travel as one row.
   Equal windows have equal minimizers, so windows of a minimizer that only one document has aren't repeated and
   never become rows of their own.
2. Of the other windows, those that branch on either side (the words before and after aren't always the same) are found
   by a partial aggregate over all occurrences; a join takes them to their places, where they cut the text into paths.
3. A path is held by its coordinates (document, first word, end).  Its words are read at these coordinates and told
   by a 128-bit digest, so hashes choose the candidates and cuts only; what goes was equal at both places.

Hot windows cost one row a task in the aggregates, and their joins can be split.  Nothing gathers a group: lists are of one
document's places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.arrow import slices
from procurelake.llm.wordhash import Words, mix, rolled
from procurelake.storage import Scratch, release_shuffles

WIDTH = 13
#: Rows and entries of their lists up to which lists of places are sent to every executor (some 20 MB); beyond, the texts
#: are dealt by document.  Branching windows likewise.
BROADCAST_ENTRIES = 1_000_000
_KEY = ["doc_id", "rk"]


def _batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to stretches of rows; it returns arrays by column."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = fn(part)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _runs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each; null lists are empty."""
    lengths = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lists)), lengths)


def _inside(words: Words, width: int) -> np.ndarray:
    """Which places begin a window that lies in one text."""
    n = max(0, len(words) - width + 1)
    return words.row[:n] == words.row[width - 1 :]


def _supers(part: pa.RecordBatch, width: int) -> dict[str, object]:
    """Runs of windows by minimizer: (rk, dk, key, start, n)."""
    words, mer = Words(part.column("text")), width // 2
    good = _inside(words, width)
    mers = rolled(words.hashes(), mer)
    span, n = width - mer + 1, len(good)
    least = mers[:n].copy()
    for j in range(1, span):
        np.minimum(least, mers[j : j + n], out=least)
    anchor = np.zeros(n, np.int64)
    for j in range(span - 1, -1, -1):  # the leftmost of equals
        anchor[mers[j : j + n] == least] = j
    anchor += np.arange(n)
    at = np.flatnonzero(good)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at][1:] != anchor[at][:-1]) | (words.row[at][1:] != words.row[at][:-1])
    heads = at[new]
    row = words.row[heads]
    counts = np.diff(np.append(np.flatnonzero(new), len(at)))
    return {"rk": part.column("rk").take(row), "dk": part.column("dk").take(row), "key": least[heads].view(np.int64), "start": (heads - words.first[row]).astype(np.int32), "n": counts.astype(np.int32)}


def _merged(part: pa.RecordBatch) -> dict[str, object]:
    """A document's runs as few stretches of windows: (rk, a, b)."""
    at, row = _runs(part.column("runs"))
    start, n = (np.asarray(at.field(k), np.int64) for k in (0, 1))
    order = np.lexsort((start, row))
    start, end, row = start[order], (start + n)[order], row[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1])  # a row that is there twice has its runs twice
    start, end, row = start[once], end[once], row[once]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != end[:-1])  # runs of a document don't overlap
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(row)) - 1
    bounds = np.searchsorted(row[heads], np.arange(part.num_rows + 1)).astype(np.int32)
    as_list = lambda x: pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32)))
    return {"rk": part.column("rk"), "a": as_list(start[heads]), "b": as_list(end[last])}


def _chosen(words: Words, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """First and end, as places among all words, of the stretches of windows in a batch."""
    a, row = _runs(part.column("a"))
    b, _ = _runs(part.column("b"))
    return np.asarray(a, np.int64) + words.first[row], np.asarray(b, np.int64) + words.first[row]


def _marked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Flags of places in any [a, b)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge)[:n] > 0


def _edges(part: pa.RecordBatch, width: int) -> dict[str, object]:
    """(doc_id, rk, dk, h, ctx, pos) of each window in the stretches; ctx stands for the words before and after."""
    words = Words(part.column("text"))
    hashes = words.hashes()
    a, b = _chosen(words, part)
    at = np.flatnonzero(_marked(a, b, len(words)))
    row = words.row[at]
    h = rolled(hashes, width)[at]
    ends = np.append(hashes, np.uint64(0))
    before = np.where(at == words.first[row], np.uint64(1), ends[at - 1])
    after = np.where(at + width == words.first[row + 1], np.uint64(2), ends[at + width])
    ctx = mix(mix(before) + after)
    out = {k: part.column(k).take(row) for k in ("doc_id", "rk", "dk")}
    return out | {"h": h.view(np.int64), "ctx": ctx.view(np.int64), "pos": (at - words.first[row]).astype(np.int32)}


def _paths(part: pa.RecordBatch, width: int) -> dict[str, object]:
    """(doc_id, rk, start, end, digest) of each path: stretches cut before and after each branching window."""
    words = Words(part.column("text"))
    a, b = _chosen(words, part)
    pos, row = _runs(part.column("cuts"))
    cut = np.asarray(pos, np.int64) + words.first[row]
    n = len(words) + 1
    inside = _marked(a, b, n)
    new = np.zeros(n, bool)
    new[np.concatenate([a, cut, cut + 1])] = True
    heads = np.flatnonzero(new & inside)
    stops = np.flatnonzero(new | ~inside)
    tails = stops[np.searchsorted(stops, heads, "right")]  # the window after the last of the path
    joined, begins = words.joined()
    data, first, last = memoryview(joined), begins[heads].tolist(), (begins[tails + width - 1] - 1).tolist()
    digests = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(first, last, strict=True)]
    row = words.row[heads]
    place = heads - words.first[row]
    out = {k: part.column(k).take(row) for k in ("doc_id", "rk")}
    return out | {"start": place.astype(np.int32), "end": (place + tails - heads + width - 1).astype(np.int32), "digest": digests}


def _cut_out(part: pa.RecordBatch) -> dict[str, object]:
    """(doc_id, n_words, n_removed, kept_text) of each row."""
    words = Words(part.column("text"))
    a, b = _chosen(words, part)
    keep = ~_marked(a, b, len(words))
    joined, begins = words.joined(keep)
    before = np.concatenate([[0], np.cumsum(keep)])[words.first]  # kept words before each row
    data = joined.tobytes()
    texts = [data[begins[x] : max(begins[x], begins[y] - 1)].decode() for x, y in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
    n = np.diff(words.first)
    return {"doc_id": part.column("doc_id"), "n_words": n, "n_removed": n - np.diff(before), "kept_text": texts}


def _sent(small: DataFrame, sizes: list[str]) -> DataFrame:
    """``small`` marked for a broadcast if its rows and the entries of its lists are few; else as it is."""
    rows, entries = small.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in sizes), F.lit(0))), F.lit(0))).first()
    return F.broadcast(small) if rows + entries <= BROADCAST_ENTRIES else small


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rk, dk, text): rk tells rows apart by id and text, dk documents by id."""
    kind = docs.schema[id_col].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    dk: Column = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) if whole else F.xxhash64(F.col(id_col))
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rk"), dk.alias("dk"), text.alias("text"))


def _stretches(keyed: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(rk, a, b): the stretches of windows whose minimizer lies in two documents or more."""
    supers = scratch.save(_batches(keyed.select("rk", "dk", "text"), lambda p: _supers(p, width), "rk long, dk long, key long, start int, n int"), "supers")
    shared = supers.groupBy("key").agg(F.min("dk").alias("lo"), F.max("dk").alias("hi")).where("lo < hi").select("key")
    met = supers.join(scratch.save(shared, "minimizers"), "key")
    runs = met.groupBy("rk").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    out = scratch.save(_batches(runs, _merged, "rk long, a array<int>, b array<int>"), "stretches")
    scratch.drop(supers)
    return out


def _cuts(keyed: DataFrame, stretches: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, rk, cuts): places of windows that lie in two documents and branch before or after them."""
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    near = keyed.join(_sent(stretches, ["a"]), "rk").select("doc_id", "rk", "dk", "text", "a", "b")
    edges = scratch.save(_batches(near, lambda p: _edges(p, width), f"doc_id {id_type}, rk long, dk long, h long, ctx long, pos int"), "edges")
    del near
    release_shuffles(keyed.sparkSession)
    found = edges.groupBy("h").agg(F.min("dk").alias("lo"), F.max("dk").alias("hi"), F.min("ctx").alias("c_lo"), F.max("ctx").alias("c_hi"))
    branching = scratch.save(found.where("lo < hi and c_lo < c_hi").select("h"), "branching")
    del found
    release_shuffles(keyed.sparkSession)
    at = edges.select(*_KEY, "h", "pos").join(_sent(branching, []), "h")
    out = scratch.save(at.groupBy(*_KEY).agg(F.collect_list("pos").alias("cuts")), "cuts")
    scratch.drop(edges)
    return out


def paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, rk, start, end, digest, first_id): each repeated path of each document.

    start and end count words, end exclusive; first_id is the least id that has the path.  Paths that only one
    document has, however often, aren't returned.  rk is a hash of id and text.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    keyed = _keyed(docs, id_col, text_col)
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    stretches = _stretches(keyed, width, scratch)
    release_shuffles(docs.sparkSession)
    cuts = _cuts(keyed, stretches, width, scratch).withColumnRenamed("doc_id", "cut_id").withColumnRenamed("rk", "cut_rk")
    spots = stretches.join(cuts, F.col("rk") == F.col("cut_rk"), "left").select("rk", "a", "b", "cut_id", F.col("cut_rk").isNotNull().alias("cut"), "cuts")
    spots = _sent(scratch.save(spots, "spots"), ["a", "cuts"])
    # two rows that share rk by chance have spots of both; each takes its own
    own = F.when(F.col("cut") & F.col("doc_id").eqNullSafe(F.col("cut_id")), F.col("cuts"))
    near = keyed.select("doc_id", "rk", "text").join(spots, "rk").select("doc_id", "rk", "text", "a", "b", own.alias("cuts"))
    found = scratch.save(_batches(near, lambda p: _paths(p, width), f"doc_id {id_type}, rk long, start int, end int, digest binary"), "paths")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_if(F.col("doc_id").isNull()).alias("without"))
    first = scratch.save(first.where("first_id < last_id or (first_id is not null and without > 0)").select("digest", "first_id"), "sources")
    return found.join(first, "digest").select("doc_id", "rk", "start", "end", "digest", "first_id")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row: words of windows that a smaller id has are gone.

    Windows are judged on the input.  kept_text is the words that stay, joined by one space.  Null and empty texts have
    no words; texts of fewer than ``width`` words lose none.  Rows that share an id are one document to each other: they
    remove nothing from one another.  A null id is larger than every other.  Other columns are ignored; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    gone = paths(docs, id_col, text_col, width).where("first_id < doc_id or doc_id is null")
    spans = gone.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    spans = spans.select(F.col("doc_id").alias("cut_id"), F.col("rk").alias("cut_rk"), F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    spans = _sent(scratch.save(spans, "spans"), ["a"])
    keyed = _keyed(docs, id_col, text_col)
    whole = keyed.join(spans, (F.col("rk") == F.col("cut_rk")) & F.col("doc_id").eqNullSafe(F.col("cut_id")), "left").select("doc_id", "text", "a", "b")
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    return _batches(whole, _cut_out, f"doc_id {id_type}, n_words long, n_removed long, kept_text string").withColumnRenamed("doc_id", id_col)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
x as (select doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') win from d, unnest(range(1, len(w) - 11)) t(i)),
f as (select win, min(doc_id) first_id from x group by 1 having min(doc_id) < max(doc_id)),
c as (select distinct doc_id, u.p from x join f using (win), unnest(range(i, i + 13)) u(p) where first_id < doc_id),
e as (select doc_id, p, w[p] word from d, unnest(range(1, len(w) + 1)) t(p)),
k as (select e.doc_id, string_agg(e.word, ' ' order by e.p) kept, count(*) n from e anti join c using (doc_id, p) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k using (doc_id)
"""
