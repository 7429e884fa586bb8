"""Byte-level BPE encoding and decoding by merge ranks.

Pre-tokens come from ``pretokenize``; those that recur are merged once and kept in a bounded table, which is looked up
for a block of texts at once.  Offsets of the ids in the text's bytes are running sums of their lengths in the vocabulary;
decoding puts the bytes of each id at its offset.
"""

from __future__ import annotations

import base64
import heapq
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.arrow import blocks, map_batches
from procurelake.llm.pieces import IDS, PieceTable
from procurelake.llm.pretokenize import boundaries



def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: lowest rank first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if len(piece) <= 48 else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By scanning the ranks of all pairs for each merge."""
    never, get = len(ranks) + 1, ranks.get
    ends = list(range(len(piece) + 1))
    rank = [get(piece[i : i + 2], never) for i in ends[:-2]]
    while rank and (low := min(rank)) < never:
        i = rank.index(low)
        del ends[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(piece[ends[i] : ends[i + 2]], never)
        if i:
            rank[i - 1] = get(piece[ends[i - 1] : ends[i + 1]], never)
    return [ranks[piece[a:b]] for a, b in zip(ends, ends[1:])]  # noqa: B905


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By a heap of pairs: linear-log in the length."""
    n = len(piece)
    ends, back = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= end or end > n:
            continue
        j = ends[i]
        if ends[j] != end:
            continue
        alive[j] = False
        ends[i] = end
        if end < n:
            back[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (h := back[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


def _encode_block(texts: list[str], pieces: PieceTable) -> list[np.ndarray]:
    """Ids of texts, none of them empty, that are all ASCII or have their code points worked out together."""
    whole = "".join(texts)
    raw = whole.encode()
    lengths = np.array([len(t) for t in texts])
    firsts = np.cumsum(lengths) - lengths
    if len(raw) == len(whole):  # a byte is a code point
        starts = boundaries(np.frombuffer(raw, np.uint8), firsts)
        cuts = np.append(starts, len(raw))
    else:
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        starts = boundaries(points, firsts)
        wide = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(wide, out=at[1:])
        cuts = np.append(at[starts], len(raw))
    ids, counts = pieces.encode(raw, cuts)
    before = np.append(0, np.cumsum(counts))
    rows = [*before[np.searchsorted(starts, firsts)].tolist(), len(ids)]
    return [ids[a:b] for a, b in zip(rows, rows[1:])]  # noqa: B905


def encode_texts(texts: list[str], pieces: PieceTable) -> list[np.ndarray]:
    """Ids of each text; ASCII texts go apart from the others, as their bytes are their code points."""
    out = [np.zeros(0, IDS)] * len(texts)
    for kind in (True, False):
        rows = [i for i, t in enumerate(texts) if t and t.isascii() == kind]
        some = [texts[i] for i in rows]
        for a, b in blocks(some):
            for i, ids in zip(rows[a:b], _encode_block(some[a:b], pieces), strict=True):
                out[i] = ids
    return out


class Vocabulary:
    """Ranks of a file of ``base64 rank`` lines, with the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int32)
        self.first_of = np.cumsum(self.length_of, dtype=np.int64) - self.length_of
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.pieces = PieceTable(lambda piece: merge(piece, self.ranks))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return encode_texts([t or "" for t in texts], self.pieces)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id starts, and the end."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.length_of[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ids, each put at its offset."""
        offsets = self.offsets(ids) if offsets is None else offsets
        return self.flat[np.arange(offsets[-1]) + np.repeat(self.first_of[ids] - offsets[:-1], np.diff(offsets))].tobytes()


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _schema(rows: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(k, v) for k, v in columns.items()]])


def encode(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids ARRAY<INT>, offsets ARRAY<BIGINT>) of every row.

    offsets are the byte places at which ids start, and the text's length in bytes.  Null and empty texts have
    no ids and the offset 0.  Rows are kept one for one; other columns are ignored.
    """
    path, rows = ranks_path or default_ranks(), _rows(docs, id_col, text_col)

    def run(b: dict[str, list]) -> dict[str, list]:
        v = vocabulary(path)
        found = v.encode(b["text"])
        return {"doc_id": b["doc_id"], "ids": [ids.astype(np.int32) for ids in found], "offsets": [v.offsets(ids) for ids in found]}

    out = map_batches(rows, run, _schema(rows, ids=T.ArrayType(T.IntegerType()), offsets=T.ArrayType(T.LongType())))
    return out.withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text STRING) of rows of ids; null ids give a null text, bytes that are no UTF-8 the replacement sign."""
    path = ranks_path or default_ranks()
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(b: dict[str, list]) -> dict[str, list]:
        v = vocabulary(path)
        return {"doc_id": b["doc_id"], "text": [None if i is None else v.decode(np.array(i, IDS)).decode(errors="replace") for i in b["ids"]]}

    return map_batches(rows, run, _schema(rows, text=T.StringType())).withColumnRenamed("doc_id", id_col)


def round_trip(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids BINARY, decoded BINARY): the ids as little-endian 32-bit integers and what they decode to, in one pass."""
    path, rows = ranks_path or default_ranks(), _rows(docs, id_col, text_col)

    def run(b: dict[str, list]) -> dict[str, list]:
        v = vocabulary(path)
        found = v.encode(b["text"])
        return {"doc_id": b["doc_id"], "ids": [ids.tobytes() for ids in found], "decoded": [v.decode(ids, v.offsets(ids)) for ids in found]}

    return map_batches(rows, run, _schema(rows, ids=T.BinaryType(), decoded=T.BinaryType())).withColumnRenamed("doc_id", id_col)


def digests(trip: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``round_trip`` returns, after columns to keep."""
    return trip.select(id_col, *keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
