"""Look-alike documents among bids: SimHash over character pairs, pairs, groups, risk."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.functions.text import bare
from procurelake.operators.graph import connected_components
from procurelake.operators.pricing import price_pattern
from procurelake.storage import Scratch

#: Characters beside white space below which a document is left out.
MIN_CHARS = 30
HIGH, MEDIUM = 3, 10
#: Character pairs whose hash a worker keeps (some 30 MB).
PAIRS_KEPT = 200_000
#: Different fingerprints in a block, about; a task compares two blocks at a time.
BLOCK = 32_768
#: Fingerprints that are compared at once, within a processor's cache; pairs in a batch of rows; rows of a small run.
TILE, PAIRS_OUT, FEW = (64, 4096), 50_000, 8
VERDICTS = ("高度相似", "较相似", "差异明显")


def eligible(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents long enough to compare."""
    return docs.where(F.length(bare(F.coalesce(text_col, F.lit("")))) >= MIN_CHARS)


def fingerprint(letters: str, hashes: dict[int, bytes]) -> int:
    """64 signs of sums over a text's overlapping character pairs, as a signed integer; ``hashes`` keeps pairs met before."""
    points = np.frombuffer(letters.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(points) < 2:
        return 0
    pairs, counts = np.unique(points[:-1] << np.uint64(32) | points[1:], return_counts=True)
    rows = []
    for pair in pairs.tolist():
        found = hashes.get(pair)
        if found is None:
            found = md5((chr(pair >> 32) + chr(pair & 0xFFFFFFFF)).encode()).digest()[:8]
            if len(hashes) < PAIRS_KEPT:
                hashes[pair] = found
        rows.append(found)
    bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * (counts @ bits.astype(np.int64)) > counts.sum()).view(">i8")[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns ``keep``, fp BIGINT) of every row: 64 signs of sums over overlapping character pairs, with
    multiplicity; no pairs: 0.

    A pair's hash is the first eight bytes of its MD5.  Null texts have no pairs.  Each row is fingerprinted by itself, so
    nothing is shuffled, rows that repeat an id have their own, and what a row carries needn't be joined back.
    """
    letters = F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[^\p{L}\p{N}_]", "")
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, bytes] = {}
        for batch in batches:
            found = [fingerprint(t.as_py(), hashes) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.int64())], names=[*names, "fp"])

    schema = T.StructType([*[T.StructField(n, docs.schema[n].dataType) for n in names], T.StructField("fp", T.LongType())])
    return docs.select(*names, letters.alias("__letters")).mapInArrow(run, schema)


def verdict(distance: Column) -> Column:
    return F.when(distance <= HIGH, VERDICTS[0]).when(distance <= MEDIUM, VERDICTS[1]).otherwise(VERDICTS[2])


def all_pairs(fps: DataFrame, project_col: str, id_col: str = "doc_id") -> DataFrame:
    """(project, doc_a, doc_b, distance, verdict) of every pair of a project: what a report on one tender shows.

    Quadratic in the bids of a project, of which there are a handful; for many documents use ``near_pairs``, for the whole
    corpus ``close_pairs``.  Rows without a project or id have no pairs.
    """
    a = fps.select(F.col(project_col).alias("project"), F.col(id_col).alias("doc_a"), F.col("fp").alias("x"))
    b = fps.select(F.col(project_col).alias("project"), F.col(id_col).alias("doc_b"), F.col("fp").alias("y"))
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return a.join(b, "project").where("doc_a < doc_b").select(F.col("project").alias(project_col), "doc_a", "doc_b", distance.alias("distance"), verdict(distance).alias("verdict"))


def _dealt(classes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``classes`` (keys..., fp, v) as rows (keys..., i, j, side, fp, v), those of a pair of blocks next to each other.

    A group is dealt by hash into blocks of about ``most`` rows, and every two of its blocks come together once, each block
    with itself too (i = j, side 0).  So a task holds two blocks at a time, however large a group is.
    """
    large = classes.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)  # one in ``most`` rows at most
    large = large.select(*keys, F.ceil(F.col("n") / F.lit(most)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = classes.join(F.broadcast(large), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    rows = rows.select(*keys, "fp", "v", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "v")
    # few bytes, much work: a fixed number of partitions, which adaptive execution doesn't merge
    tasks = 4 * max(12, classes.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "side")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole runs that agree in ``names``, with the places where runs begin and the end of the last."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        new = np.zeros(max(rows.num_rows - 1, 0), bool)
        for name in names:
            c = rows.column(name)
            new |= pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        held = rows.slice(int(starts[-1]))
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _fps(rows: pa.Table) -> np.ndarray:
    return rows.column("fp").to_numpy().view(np.uint64)


def _hits(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, distances) at ``radius`` or less, a tile at a time; of ``same`` arrays the first place is less."""
    for i in range(0, len(a), TILE[0]):
        for j in range(i if same else 0, len(b), TILE[1]):
            d = np.bitwise_count(a[i : i + TILE[0], None] ^ b[None, j : j + TILE[1]])
            x, y = np.nonzero(d <= radius)
            near = d[x, y]
            x, y = x + i, y + j
            keep = x < y if same else slice(None)
            yield x[keep], y[keep], near[keep]


def _met(classes: DataFrame, keys: list[str], radius: int, most: int, met_before: list[int] | None = None) -> DataFrame:
    """(keys..., x, y, v, w, distance): pairs of a group's fingerprints at ``radius`` or less, each once.

    With ``met_before``, masks of the tables of the key ``k``, a pair is left out that agrees in an earlier table.
    """
    kinds = [T.StructField(n, classes.schema[k].dataType) for n, k in [*((k, k) for k in keys), ("x", "fp"), ("y", "fp"), ("v", "v"), ("w", "v")]]
    masks = np.array([m % (1 << 64) for m in met_before or []], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _runs(batches, [*keys, "i", "j"]):
            fp, side = _fps(rows), rows.column("side").to_numpy()
            table = rows.column("k").to_numpy() if met_before else None
            for lo, hi in zip(starts, starts[1:], strict=False):
                if hi - lo < 2:
                    continue
                first = rows.slice(int(lo), 1)
                same = first.column("i")[0].as_py() == first.column("j")[0].as_py()
                cut = hi if same else lo + int((side[lo:hi] == 0).sum())
                for x, y, near in _hits(fp[lo:cut], fp[lo:cut] if same else fp[cut:hi], radius, same):
                    x, y = x + lo, y + (lo if same else cut)
                    if met_before:
                        earlier = masks[: table[lo]]
                        keep = ~((fp[x] ^ fp[y])[:, None] & earlier[None, :] == 0).any(axis=1)
                        x, y, near = x[keep], y[keep], near[keep]
                    for at in range(0, len(x), PAIRS_OUT):
                        p, q, d = x[at : at + PAIRS_OUT], y[at : at + PAIRS_OUT], near[at : at + PAIRS_OUT]
                        out = [*[pa.repeat(first.column(k)[0], len(p)) for k in keys], *[rows.column(c).take(pa.array(n)).combine_chunks() for c, n in (("fp", p), ("fp", q), ("v", p), ("v", q))], pa.array(d.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(out, names=[*keys, "x", "y", "v", "w", "distance"])

    return _dealt(classes, keys, most).mapInArrow(run, T.StructType([*kinds, T.StructField("distance", T.IntegerType())]))


def near_pairs(fps: DataFrame, project_col: str, id_col: str = "doc_id", radius: int = MEDIUM, most: int = BLOCK) -> DataFrame:
    """(project, doc_a, doc_b, distance, verdict): pairs of a project at distance ``radius`` or less.

    Texts of one language lie near each other, so at radius 10 a large share of all pairs is in the answer; hence a
    project's different fingerprints are compared all with all, in blocks of about ``most``, two at a time in a task.
    Equal fingerprints are compared once and expanded at the end, which only takes as many rows as the answer has: where
    that is too many, ``link_counts`` has a row for each document.  Rows without a project or id
    have no pairs; rows that repeat an id pair with others, not with each other.
    """
    rows = fps.select(F.col(project_col).alias("project"), F.col(id_col).alias("id"), "fp").where("project is not null and id is not null")
    rows = Scratch(fps.sparkSession, "near-pairs").save(rows, "fps")
    near = _met(rows.select("project", "fp").distinct().withColumn("v", F.lit(0)), ["project"], radius, most).drop("v", "w")
    side = lambda i, f: rows.select("project", F.col("id").alias(i), F.col("fp").alias(f))
    between = near.join(side("i", "x"), ["project", "x"]).join(side("j", "y"), ["project", "y"]).where("i <> j")
    same = side("i", "x").join(side("j", "x"), ["project", "x"]).where("i < j").select("project", "i", "j", F.lit(0).alias("distance"))
    every = between.select("project", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "distance").unionByName(same)
    return every.select(F.col("project").alias(project_col), F.col("i").alias("doc_a"), F.col("j").alias("doc_b"), "distance", verdict(F.col("distance")).alias("verdict"))


def _counted(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, radii: tuple[int, ...], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each of a and of b the weights of the other array within each radius, its own too if the arrays are the ``same``."""
    kind = np.float32 if of_a.sum() + of_b.sum() < 1 << 24 else np.float64  # sums are whole numbers, exact below 2^24 and 2^53
    wa, wb = of_a.astype(kind), of_b.astype(kind)
    got_a, got_b = np.zeros((len(radii), len(a)), np.int64), np.zeros((len(radii), len(b)), np.int64)
    for i in range(0, len(a), TILE[0]):
        x = slice(i, i + TILE[0])
        for j in range(0, len(b), TILE[1]):
            y = slice(j, j + TILE[1])
            d = np.bitwise_count(a[x, None] ^ b[None, y])
            for n, radius in enumerate(radii):
                near = (d <= radius).astype(kind)
                got_a[n, x] += (near @ wb[y]).astype(np.int64)
                if not same:
                    got_b[n, y] += (wa[x] @ near).astype(np.int64)
    return got_a, got_b


def link_counts(fps: DataFrame, project_col: str, id_col: str = "doc_id", most: int = BLOCK) -> DataFrame:
    """(project, id, class_id, n_high, n_medium) of every document: how many others of its project are close and near.

    ``class_id`` is the least document of the project with the same fingerprint.  A project's different fingerprints are
    compared all with all as in ``near_pairs``, and counted with their numbers of documents; no pair is written.  Rows without a
    project or id are left out; rows that repeat an id count as documents of their own.
    """
    rows = fps.select(F.col(project_col).alias("project"), F.col(id_col).alias("id"), "fp").where("project is not null and id is not null")
    rows = Scratch(fps.sparkSession, "link-counts").save(rows, "fps")
    classes = rows.groupBy("project", "fp").agg(F.count("*").alias("v"), F.min("id").alias("class_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, starts in _runs(batches, ["project", "i", "j"]):
            fp, weight, side = _fps(group), group.column("v").to_numpy(), group.column("side").to_numpy()
            for lo, hi in zip(starts, starts[1:], strict=False):
                first = group.slice(int(lo), 1)
                same = first.column("i")[0].as_py() == first.column("j")[0].as_py()
                cut = hi if same else lo + int((side[lo:hi] == 0).sum())
                other = slice(lo, cut) if same else slice(cut, hi)
                got_a, got_b = _counted(fp[lo:cut], fp[other], weight[lo:cut], weight[other], (HIGH, MEDIUM), same)
                told = got_a if same else np.concatenate([got_a, got_b], axis=1)
                out = [pa.repeat(first.column("project")[0], int(hi - lo)), group.column("fp").slice(int(lo), int(hi - lo)).combine_chunks(), pa.array(told[0]), pa.array(told[1])]
                yield pa.RecordBatch.from_arrays(out, names=["project", "fp", "high", "within"])

    schema = T.StructType([rows.schema["project"], rows.schema["fp"], T.StructField("high", T.LongType()), T.StructField("within", T.LongType())])
    dealt = _dealt(classes.select("project", "fp", "v"), ["project"], most).mapInArrow(run, schema)
    sums = dealt.groupBy("project", "fp").agg(F.sum("high").alias("high"), F.sum("within").alias("within"))
    # a document's own class is among those within: itself is taken off
    told = rows.join(classes.drop("v").join(sums, ["project", "fp"]), ["project", "fp"])
    return told.select(F.col("project").alias(project_col), F.col("id").alias(id_col), "class_id", (F.col("high") - 1).alias("n_high"), (F.col("within") - F.col("high")).alias("n_medium"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks() -> list[int]:
    """The bits of each three of six blocks, as signed 64-bit integers."""
    ends = [0, 11, 22, 33, 44, 54, 64]
    blocks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    return [_signed(x | y | z) for x, y, z in combinations(blocks, 3)]


def inner_masks() -> list[tuple[int, int]]:
    """(table, mask): the bits of a table of ``block_masks`` and of each five of eight blocks of its other bits.

    Three bits that differ touch three of the eight blocks at most, so a pair of a table agrees in one of its 56 masks.
    A mask leaves some twelve bits open, so no more than a few thousand different fingerprints share its value.  For callers that
    deal buckets by key; ``close_pairs`` deals them in blocks.
    """
    out = []
    for k, mask in enumerate(block_masks()):
        free = [1 << i for i in range(64) if not mask >> i & 1]
        blocks = [sum(free[len(free) * i // 8 : len(free) * (i + 1) // 8]) for i in range(8)]
        out += [(k, _signed(mask % (1 << 64) | sum(five))) for five in combinations(blocks, 5)]
    return out


def _banded(fps: DataFrame, keys: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """The classes of equal fingerprints (keys..., fp, v: the least id), and each in twenty tables: (keys..., k, b, fp, v).

    Of six blocks of bits three stay the same when three bits differ at most (Manku et al., WWW 2007), so a pair agrees in
    one of twenty tables whose keys are three blocks, some 32 bits.
    """
    classes = fps.where(F.col(id_col).isNotNull()).groupBy(*keys, "fp").agg(F.min(id_col).alias("v"))
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("b")) for k, m in enumerate(block_masks())])
    banded = classes.where(" and ".join(f"{k} is not null" for k in keys) or "true")
    return classes, banded.select(*keys, "fp", "v", F.explode(tables).alias("t")).select(*keys, "t.k", "t.b", "fp", "v")


def close_pairs(fps: DataFrame, id_col: str = "doc_id", within: list[str] | None = None, crowded: int = BLOCK) -> DataFrame:
    """(within..., doc_a, doc_b, distance): pairs of documents at distance 3 or less.

    Fingerprints that share the key of a table (``_banded``) are compared all with all, in blocks of about ``crowded``; a
    pair is reported from the first table in which it agrees, so nothing has to be made distinct.
    Equal fingerprints are one class, and a class's members pair with its least member only: the groups stay the
    same while copies don't multiply.  Null ids are left out of pairs; null ``within`` have none.  For groups
    ``close_links`` needs no pairs.
    """
    keys = within or []
    # fingerprints are worked out in Python: once, not for each use
    fps = Scratch(fps.sparkSession, "fingerprints").save(fps.select(*keys, id_col, "fp"), "fps")
    classes, banded = _banded(fps, keys, id_col)
    met = _met(banded, [*keys, "k", "b"], HIGH, crowded, block_masks())
    between = met.select(*keys, F.least("v", "w").alias("doc_a"), F.greatest("v", "w").alias("doc_b"), "distance")
    return between.unionByName(_copies(fps, classes, keys, id_col))


def _copies(fps: DataFrame, classes: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Each document with the least of equal fingerprint, as a pair at distance 0."""
    return fps.join(classes, [*keys, "fp"]).where(F.col(id_col) > F.col("v")).select(*keys, F.col("v").alias("doc_a"), F.col(id_col).alias("doc_b"), F.lit(0).alias("distance"))


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member): for each fingerprint but the first of its group, by links at distance 3 or less, the group's first."""
    rest, roots, members = np.arange(len(fp)), [], []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            n = max(1, TILE[0] * TILE[1] // len(rest))
            hit = (np.bitwise_count(fp[front[:n], None] ^ fp[None, rest]) <= HIGH).any(axis=0)
            found, rest = rest[hit], rest[~hit]
            front = np.concatenate([front[n:], found])
            roots.append(np.full(len(found), root))
            members.append(found)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(roots or none), np.concatenate(members or none)


def close_links(fps: DataFrame, id_col: str = "doc_id", crowded: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b, distance): links, as few as a row for each document and table, with the same groups as ``close_pairs``.

    What shares the key of a table (``_banded``) is grouped where it lies, and each member linked to the first of its group: the
    links grow with the documents, the pairs with their square.  ``distance`` is 0 between copies, else 3, the
    most that a step of the group takes.
    """
    fps = Scratch(fps.sparkSession, "fingerprints").save(fps.select(id_col, "fp"), "fps")
    classes, banded = _banded(fps, [], id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _runs(batches, ["k", "b", "i", "j"]):
            fp, sizes = _fps(rows), np.diff(starts)
            no, few = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= FEW, sizes)
            roots, members = [], []
            for d in range(1, FEW):  # small runs all at once
                at = np.flatnonzero(few[:-d] & (no[:-d] == no[d:]) & (np.bitwise_count(fp[:-d] ^ fp[d:]) <= HIGH)) if d < len(fp) else np.zeros(0, np.int64)
                roots.append(at)
                members.append(at + d)
            for run in np.flatnonzero(sizes > FEW):
                root, member = _forest(fp[starts[run] : starts[run + 1]])
                roots.append(root + starts[run])
                members.append(member + starts[run])
            ids = rows.column("v")
            told = [ids.take(pa.array(np.concatenate(x))).combine_chunks() for x in (roots, members)]
            yield pa.RecordBatch.from_arrays(told, names=["v", "w"])

    kind = classes.schema["v"].dataType
    met = _dealt(banded, ["k", "b"], crowded).mapInArrow(run, T.StructType([T.StructField("v", kind), T.StructField("w", kind)]))
    between = met.select(F.least("v", "w").alias("doc_a"), F.greatest("v", "w").alias("doc_b"), F.lit(HIGH).alias("distance")).distinct()
    return between.unionByName(_copies(fps, classes, [], id_col))


def risk_groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of documents in a group of close pairs; the group's name is its least document."""
    found = connected_components(pairs.where(F.col("distance") <= HIGH), "doc_a", "doc_b")
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def project_risk(pairs: DataFrame, prices: DataFrame | None, project_col: str = "project_id") -> DataFrame:
    """(project, high, medium, max_distance, pattern, risk): HIGH on a close pair or a price pattern, MEDIUM on a near one."""
    text = pairs.groupBy(project_col).agg(F.count_if(F.col("verdict") == VERDICTS[0]).alias("high"), F.count_if(F.col("verdict") == VERDICTS[1]).alias("medium"), F.max("distance").alias("max_distance"))
    if prices is None:
        both = text.withColumn("pattern", F.lit(False))
    else:
        found = price_pattern(prices, project_col).select(F.col(project_col).alias("__p"), F.col("detected"))
        both = text.join(found, F.col(project_col) == F.col("__p"), "full").select(F.coalesce(project_col, "__p").alias(project_col), "high", "medium", "max_distance", F.coalesce("detected", F.lit(False)).alias("pattern")).fillna(0)
    risk = F.when((F.col("high") > 0) | F.col("pattern"), "HIGH").when(F.col("medium") > 0, "MEDIUM").otherwise("LOW")
    return both.withColumn("risk", risk)
