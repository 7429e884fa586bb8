"""Merkle manifest of a dataset: a tree for each source, a tree over their roots, and a proof for each row.

The builder is an associative monoid of sparse forests.  A forest holds nodes that aren't resolved yet, keyed by tree,
level and index; as the size of each tree is known, so is the arity of every run of siblings, and a run is replaced by
its parent as soon as it is complete.  Merging two forests adds the nodes of one to the other, so forests merge in any
order and grouping: each part of the rows (a stretch of the global order, dealt by range) becomes one, and ``treeReduce`` merges
them.

What a part leaves unresolved is at most two nodes a level at either end of a tree, and only trees that cross
the end of a part leave any: trees that lie inside a part resolve there and go to a table.  So the driver sees a bounded number
of nodes for each part, whatever the number of rows or sources.  The nodes that met in merges are what rows of other parts
need as siblings; proofs take them from a broadcast of that bounded size and all others from the part's own forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.operators.ordering import running_total
from procurelake.storage import Scratch

ARITY = 3
#: Rows of a part, about: a task holds one part's nodes.
PART_ROWS = 200_000
#: Rows of small tables (one for each source, or source and part) up to which they are sent to every executor.
BROADCAST_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[bytes]) -> bytes:
    """Of digests as hex text, one after the other."""
    return sha256("".join([p.hex() for p in parts]).encode()).digest()


def level_size(leaves: int, level: int, arity: int = ARITY) -> int:
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


def siblings_at(idx: int, width: int, arity: int = ARITY) -> tuple[range, int]:
    """The indices of a node's run, itself included, at a level of ``width`` nodes; and its place among them."""
    first = idx // arity * arity
    return range(first, min(first + arity, width)), idx - first


class Forest:
    """Unresolved nodes of trees of known sizes.  ``met`` keeps the nodes that completed runs took, if asked to."""

    def __init__(self, arity: int = ARITY, keep: bool = False):
        self.arity, self.keep = arity, keep
        self.open: dict[tuple[int, int, int], bytes] = {}
        self.sizes: dict[int, int] = {}
        self.met: dict[tuple[int, int, int], bytes] = {}

    def add(self, tree: int, size: int, level: int, idx: int, value: bytes) -> None:
        """Put a node in, and its parent in place of its run while runs are complete."""
        self.sizes[tree] = size
        width = level_size(size, level, self.arity)
        while True:
            self.open[tree, level, idx] = value
            if width == 1:
                return
            run = [(tree, level, i) for i in siblings_at(idx, width, self.arity)[0]]
            if not all(k in self.open for k in run):
                return
            value = digest([self.open[k] for k in run])
            for k in run:
                found = self.open.pop(k)
                if self.keep:
                    self.met[k] = found
            level, idx, width = level + 1, idx // self.arity, -(-width // self.arity)

    def merge(self, other: Forest) -> Forest:
        """Associative and commutative; an empty forest changes nothing."""
        self.met |= other.met
        for (tree, level, idx), value in other.open.items():
            self.add(tree, other.sizes[tree], level, idx, value)
        return self

    def rows(self) -> Iterator[tuple[int, int, int, int, bytes, bool]]:
        """(tree, size, level, idx, value, whether it is the tree's root)."""
        for (tree, level, idx), value in self.open.items():
            yield tree, self.sizes[tree], level, idx, value, level_size(self.sizes[tree], level, self.arity) == 1


def fold(leaf: bytes, places: Iterable[tuple[int, int]], siblings: list[bytes], arity: int = ARITY) -> bytes:
    """The root that a leaf and its siblings give; ``places`` are (index, leaves) in its tree and in those above."""
    at, value = 0, leaf
    for idx, width in places:
        while width > 1:
            run, own = siblings_at(idx, width, arity)
            others = siblings[at : at + len(run) - 1]
            value = digest([*others[:own], value, *others[own:]])
            at, idx, width = at + len(run) - 1, idx // arity, -(-width // arity)
    return value


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Stretches of rows of one part; rows come sorted by part."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    return groupby(rows, key=lambda r: r[0])


_NODE = "tree long, size long, level int, idx long, value binary, root boolean"


def _fragments(rows: DataFrame, arity: int, scratch: Scratch) -> DataFrame:
    """The unresolved nodes and the roots that each part leaves; ``rows`` has part, tree, size, idx, leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _by_part(batches):
            forest = Forest(arity)
            for _, tree, size, idx, leaf in members:
                forest.add(tree, size, 0, idx, leaf)
            cols = list(zip(*forest.rows(), strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names="tree size level idx value root".split())

    return scratch.save(_dealt(rows.select("part", "tree", "size", "idx", "leaf")).mapInArrow(run, _NODE), "fragments")


def _dealt(rows: DataFrame) -> DataFrame:
    """Each part in one task, in order."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "part").sortWithinPartitions("part", "tree", "idx")


def _reduced(fragments: DataFrame, arity: int) -> Forest:
    """All unresolved nodes of all parts, merged."""

    def read(rows: Iterator) -> Iterator[Forest]:
        forest = Forest(arity, keep=True)
        for r in rows:
            forest.add(r.tree, r.size, r.level, r.idx, bytes(r.value))
        yield forest

    parts = fragments.where("not root").rdd.mapPartitions(read)
    return parts.treeReduce(Forest.merge) if parts.getNumPartitions() else Forest(arity)


def _siblings(rows: DataFrame, known: Broadcast, arity: int, carry: list[str]) -> DataFrame:
    """``rows`` (part, tree, size, idx, leaf and ``carry``) with siblings, level by level and left to right."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

    taken = rows.select("part", "tree", "size", "idx", "leaf", *carry)
    schema = StructType([*taken.schema.fields[1:], StructField("siblings", ArrayType(BinaryType()))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _by_part(batches):
            members, forest = list(members), Forest(arity, keep=True)
            for m in members:
                forest.add(m[1], m[2], 0, m[3], m[4])
            near, far, last = forest.met, known.value, {}

            def above(tree: int, level: int, idx: int, width: int, near=near, far=far, last=last) -> list[bytes]:
                """Siblings from this level up; rows come in order, so each level's last answer serves the next rows."""
                if width <= 1:
                    return []
                if (held := last.get(level)) and held[0] == (tree, idx):
                    return held[1]
                run, own = siblings_at(idx, width, arity)
                keys = [(tree, level, i) for i in run if i - run[0] != own]
                found = [near[k] if k in near else far[k] for k in keys] + above(tree, level + 1, idx // arity, -(-width // arity))
                last[level] = (tree, idx), found
                return found

            for a in range(0, len(members), 2000):
                some = members[a : a + 2000]
                cols = [*list(zip(*some, strict=True))[1:], [above(m[1], 0, m[3], m[2]) for m in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return _dealt(taken).mapInArrow(run, schema)


@dataclass
class Manifest:
    """``rows``: part, tree, size, idx, leaf and what leaves carried.  ``subroots``: tree, grp, size, leaf (the subroot)."""

    rows: DataFrame
    subroots: DataFrame
    root: bytes | None
    trees: int
    arity: int
    known: Broadcast
    known_top: Broadcast


def leaf_digest(fields: dict[str, Column]) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value, as binary."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*told), 256))


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def build(leaves: DataFrame, order: list[Column], arity: int = ARITY) -> Manifest:
    """The manifest of ``leaves`` (grp, leaf and columns to carry), ordered in each group by ``order``.

    Groups are ordered by their UTF-8 bytes, null first; equal rows in any order give equal trees.
    No rows: no root.
    """
    spark, scratch = leaves.sparkSession, Scratch(leaves.sparkSession, "merkle")
    leaves = scratch.save(leaves, "leaves")
    total = leaves.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS), 1)
    by = [F.col("grp").asc_nulls_first(), *order]
    ranged = leaves.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranged = scratch.save(ranged, "ranged")
    scratch.drop(leaves)
    part = F.shiftright("at", 33).alias("part")  # the id holds the partition above 33 bits
    runs = scratch.save(ranged.groupBy(part, "grp").agg(F.count("*").alias("n"), F.min("at").alias("begin")), "runs")
    groups = scratch.save(runs.groupBy("grp").agg(F.sum("n").alias("size")), "groups")
    numbered, trees = running_total(groups.withColumn("one", F.lit(1).cast("long")), [F.col("grp").asc_nulls_first()], "one", "tree", scratch)
    numbered = scratch.save(numbered.select("grp", "tree", "size"), "trees")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part at most
    placed = runs.select(F.col("part").alias("r_part"), F.col("grp"), "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = placed.join(numbered.withColumnRenamed("grp", "t_grp"), F.col("grp").eqNullSafe(F.col("t_grp"))).select("r_part", F.col("grp").alias("r_grp"), "begin", "base", "tree", "size")
    placed = _sent(scratch.save(placed, "placed"))
    met = ranged.select("*", part).join(placed, (F.col("part") == F.col("r_part")) & F.col("grp").eqNullSafe(F.col("r_grp")))
    rows = scratch.save(met.withColumn("idx", F.col("base") + F.col("at") - F.col("begin")).drop("at", "r_part", "r_grp", "begin", "base", "grp"), "rows")

    fragments = _fragments(rows, arity, scratch)
    forest = _reduced(fragments, arity)
    crossing = [(t, v) for t, _, _, _, v, is_root in forest.rows() if is_root]  # one for each part at most
    roots = fragments.where("root").select("tree", "value").unionByName(spark.createDataFrame(crossing, "tree long, value binary"))
    subroots = roots.join(numbered, "tree").select(F.col("tree").alias("idx"), F.col("tree"), "grp", "size", F.col("value").alias("leaf"))
    # the tree over subroots is built like the others, over their own parts
    top = subroots.repartitionByRange(max(1, -(-trees // PART_ROWS)), "idx").withColumn("part", F.spark_partition_id().cast("long"))
    top = scratch.save(top, "subroots")
    over = top.select("part", F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), "idx", "leaf")
    pieces = _fragments(over, arity, scratch)
    above = _reduced(pieces, arity)
    whole = [r.value for r in pieces.where("root").collect()] + [v for *_, v, is_root in above.rows() if is_root]
    share = spark.sparkContext.broadcast
    return Manifest(rows, top, bytes(whole[0]) if whole else None, trees, arity, share(forest.met), share(above.met))


def proofs(manifest: Manifest, carry: list[str]) -> DataFrame:
    """``carry`` columns of each row, with leaf, subroot, idx, size, tree, and siblings up to the root."""
    own = _siblings(manifest.rows, manifest.known, manifest.arity, carry).withColumnRenamed("siblings", "inner")
    top = manifest.subroots.select("part", F.lit(0).cast("long").alias("tree"), F.lit(manifest.trees).cast("long").alias("size"), "idx", "leaf")
    top = _siblings(top, manifest.known_top, manifest.arity, []).select(F.col("idx").alias("tree"), F.col("leaf").alias("subroot"), F.col("siblings").alias("outer"))
    scratch = Scratch(manifest.rows.sparkSession, "proofs")
    met = own.join(_sent(scratch.save(top, "top")), "tree")
    return met.select(*carry, "leaf", "subroot", "idx", "size", "tree", F.concat("inner", "outer").alias("siblings"))


def verify(proved: DataFrame, manifest: Manifest, claimed: str, carry: list[str]) -> DataFrame:
    """``carry`` of each row, proof (H of the siblings) and folded: the root that column ``claimed``, in the leaf's place, gives."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    taken = proved.select(claimed, "idx", "size", "tree", "siblings", *carry)
    schema = StructType([*[taken.schema[c] for c in carry], StructField("proof", BinaryType()), StructField("folded", BinaryType())])
    target, trees, arity = to_arrow_schema(schema), manifest.trees, manifest.arity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, idx, size, tree, siblings = (batch.column(i).to_pylist() for i in range(5))
            folded = [fold(x, ((i, n), (t, trees)), s, arity) for x, i, n, t, s in zip(leaf, idx, size, tree, siblings, strict=True)]
            arrays = [*batch.columns[5:], pa.array([digest(s) for s in siblings], pa.binary()), pa.array(folded, pa.binary())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    return taken.mapInArrow(run, schema)


def manifest_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The manifest of ``docs``: rows carry id, leaf and changed.

    changed is the leaf of the row without its text's newlines where 2 divides the crc32 of its decimal id, else null.
    In a group, rows ascend by id, null ids last; rows that share an id follow by leaf, and rows with a null id are never
    changed.  Null and empty texts, and every other null, have a leaf; columns not in ``fields`` don't count.
    """
    columns = {f: F.col(f) for f in fields}
    odd = F.crc32(F.col(id_col).cast("string")) % 2 == 0
    cut = columns | {text_col: F.replace(F.col(text_col), F.lit("\n"), F.lit(""))}
    leaves = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf_digest(columns).alias("leaf"), F.when(odd, leaf_digest(cut)).alias("changed"))
    return build(leaves, [F.col("id").asc_nulls_last(), F.col("leaf").asc()])


def audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: changed rows against the manifest.

    Digests are lowercase hex.  verified is true where the row as it is now leads to the root; a change that
    changes nothing is none.  See ``manifest_of`` for nulls, ties and repeated rows.  An empty table gives no rows.
    """
    manifest = manifest_of(docs, id_col, text_col, group_col, fields)
    proved = proofs(manifest, ["id", "changed"]).withColumn("claimed", F.coalesce("changed", "leaf"))
    told = verify(proved, manifest, "claimed", ["id", "leaf", "subroot"])
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    as_hex = lambda c: F.lower(F.hex(c))
    return told.select(F.col("id").alias(id_col), as_hex("leaf").alias("leaf"), as_hex("subroot").alias("subroot"), root.alias("root"), as_hex("proof").alias("proof_sha256"), as_hex("folded").alias("folded_root"), (as_hex("folded") == root).alias("verified"))


def write_manifest(docs: DataFrame, path: str, **columns) -> str | None:
    """Write the leaves and subroots of ``docs`` below ``path``, as Parquet; the root, in hex."""
    manifest = manifest_of(docs, **columns)
    manifest.subroots.select("grp", "size", F.lower(F.hex("leaf")).alias("subroot")).write.parquet(f"{path}/subroots")
    manifest.rows.select("tree", "idx", "id", F.lower(F.hex("leaf")).alias("leaf")).write.parquet(f"{path}/leaves")
    return manifest.root.hex() if manifest.root else None


ORACLE = r"""
with recursive d as (
  select doc_id, source, list_transform([doc_id::varchar, source, lang, n_chars::varchar], lambda x: case when x is null then '-' else strlen(x) || ':' || x end) head, text,
    list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_concat([ord(c)::bigint], [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end) & 1 as low
  from documents),
v as (select *, case when text is null then '-' else strlen(text) || ':' || text end t, replace(text, chr(10), '') u from d),
l as (select doc_id, source, sha256(list_aggregate(head, 'string_agg', '') || t) leaf,
        case when low = 1 and text is not null then sha256(list_aggregate(head, 'string_agg', '') || strlen(u) || ':' || u) end other from v),
b as (select *, dense_rank() over (order by source nulls first) - 1 tree, row_number() over (partition by source order by doc_id) - 1 idx, count(*) over (partition by source) width from l),
n(tree, lvl, idx, h, width) as (
  select tree, 0, idx, leaf, width from b
  union all select tree, lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (width + 2) // 3 from n where width > 1 group by tree, lvl, idx // 3, width),
s as (select tree, h, lvl as height from n where width = 1),
m(lvl, idx, h, width) as (
  select 0, tree, h, (select count(*) from s) from s
  union all select lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (width + 2) // 3 from m where width > 1 group by lvl, idx // 3, width),
p as (select doc_id, lvl as k, coalesce(string_agg(n.h, '' order by n.idx) filter (n.idx < b.idx // (3 ** lvl)::bigint), '') lft,
        coalesce(string_agg(n.h, '' order by n.idx) filter (n.idx > b.idx // (3 ** lvl)::bigint), '') rgt
      from b join n on n.tree = b.tree and n.width > 1 and n.idx // 3 = b.idx // (3 ** (lvl + 1))::bigint group by 1, 2
      union all
      select doc_id, height + m.lvl, coalesce(string_agg(m.h, '' order by m.idx) filter (m.idx < b.tree // (3 ** m.lvl)::bigint), ''),
        coalesce(string_agg(m.h, '' order by m.idx) filter (m.idx > b.tree // (3 ** m.lvl)::bigint), '')
      from b join s using (tree) join m on m.width > 1 and m.idx // 3 = b.tree // (3 ** (m.lvl + 1))::bigint group by 1, 2),
f(doc_id, k, h) as (select doc_id, 0, coalesce(other, leaf) from b union all select doc_id, k + 1, sha256(lft || h || rgt) from f join p using (doc_id, k)),
e as (select doc_id, arg_max(h, k) folded from f group by 1),
q as (select doc_id, sha256(string_agg(lft || rgt, '' order by k)) proof from p group by 1),
r as (select h as root from m where width = 1)
select doc_id, leaf, s.h as subroot, root, coalesce(proof, sha256('')) as proof_sha256, folded as folded_root, folded = root as verified
from b join s using (tree) join e using (doc_id) left join q using (doc_id), r
"""
