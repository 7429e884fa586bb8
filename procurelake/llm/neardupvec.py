"""Embedding near-duplicates by NN-descent.

Dong, Moses and Li, "Efficient k-nearest neighbor graph construction for generic similarity measures" (WWW 2011):

1. Rows with the same label and vector are one node.
2. A first neighbour graph comes from random-projection trees: nodes of a label are ordered by the signs of random
   projections and compared inside runs of ``RUN`` nodes, so no group can outgrow a task.
3. Rounds of neighbours-of-neighbours joins: the neighbours of a pivot, forward and reverse, are compared with each
   other, and each keeps its best.  A pivot's reverse neighbours are dealt into groups of bounded size.  Pivots whose
   lists didn't change sit out.  Edges under ``FLOOR`` are not kept: they say nothing about who is within the threshold.
4. A list that is full of links is enlarged, twofold each round.  Past ``K_MAX`` it may lose links, so components with
   full lists are compared exactly with each other, by cells and their reach, and merged where a link is found.
5. An audit compares bounded samples of nodes with all nodes of their labels; if a node, on average, has less than
   ``RECALL`` of its links inside its component, in large components or elsewhere, further trees are added and the
   rounds go on, until the audit passes or ``ATTEMPTS`` are used up, which is an error.
6. Links are then counted exactly inside each connected component, a chunk of rows against a chunk of rows at a time,
   so neither the count nor the component of a large group of near copies depends on list lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.operators.graph import connected_components
from procurelake.operators.ordering import running_total
from procurelake.storage import Scratch, release_shuffles

THRESHOLD = 0.93
FLOOR = 0.7
RUN = 64
TREES = 6
K = 16
K_MAX = 64
ROUNDS = 4
RECALL = 0.97
#: Sampled nodes of large components, and of others.
AUDIT_ROWS = 512
#: Sets of trees until an audit that doesn't pass is an error.
ATTEMPTS = 10
#: Vectors of one side of a block of exact counting.
CHUNK = 1024
SEED = 5


def _map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each key; rows are sorted by key, so one group is in memory at a time."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = np.asarray(batch.column(k))
                codes[1:] |= column[1:] != column[:-1]
            if held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
                codes[0] = False
            else:
                codes[0] = True
            cuts = [*np.flatnonzero(codes).tolist(), batch.num_rows]
            if cuts[0]:
                held.append(batch.slice(0, cuts[0]))
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if held:
                    out = fn(pa.Table.from_batches(held))
                    if out is not None:
                        yield from out.combine_chunks().to_batches()
                held = [batch.slice(a, b - a)]
        if held:
            out = fn(pa.Table.from_batches(held))
            if out is not None:
                yield from out.combine_chunks().to_batches()

    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _unit(packed: list[bytes]) -> np.ndarray:
    """Unit rows from packed float64 vectors of one length."""
    x = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows with the node they belong to (vec_id, node or null), and the nodes (node, label, dim, vec, least, size).

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label have no node.
    """
    row = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0)
    row = row.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.struct("label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))))
    row = scratch.save(row.select("vec_id", F.xxhash64("key").alias("h"), "key"), "rows")
    each = row.where("key is not null").groupBy("h", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    nodes = scratch.save(each.select(F.monotonically_increasing_id().alias("node"), "h", "key", F.size("key.v").alias("dim"), "least", "size"), "nodes")
    return row, nodes


def _packed(nodes: DataFrame) -> DataFrame:
    """(node, label, dim, vec): the vector by its largest component, as packed float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, ends = np.asarray(v.flatten(), dtype=np.float64), np.asarray(v.offsets) - v.offsets[0].as_py()
            packed = []
            for a, e in zip(ends, ends[1:]):  # noqa: B905
                x = flat[a:e]
                packed.append((x / np.abs(x).max()).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), b.column("dim"), pa.array(packed, pa.binary())], ["node", "label", "dim", "vec"])

    label = nodes.schema["key"].dataType["label"].dataType.simpleString()
    return nodes.select("node", F.col("key.label").alias("label"), "dim", F.col("key.v").alias("v")).mapInArrow(run, f"node bigint, label {label}, dim int, vec binary")


def _trees(vecs: DataFrame, first: int, count: int, scratch: Scratch) -> DataFrame:
    """(tree, block, node, vec): the nodes of each label in runs of one place in a random-projection tree."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            out = np.zeros((len(dims), count), np.int64)
            packed = b.column("vec").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _unit([packed[i] for i in at])
                for t in range(count):
                    planes = np.random.default_rng([SEED, first + t, int(d)]).standard_normal((int(d), 48))
                    out[at, t] = ((x @ planes > 0) @ (1 << np.arange(47, -1, -1, dtype=np.int64))).astype(np.int64)
            for t in range(count):
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), b.column("dim"), pa.array(np.full(len(dims), first + t, np.int32)), pa.array(out[:, t])], ["node", "label", "dim", "tree", "code"])

    label = vecs.schema["label"].dataType.simpleString()
    coded = vecs.mapInArrow(codes, f"node bigint, label {label}, dim int, tree int, code bigint").withColumn("one", F.lit(1).cast("long"))
    ranked, _ = running_total(coded, [F.col("tree"), F.col("label"), F.col("dim"), F.col("code"), F.col("node")], "one", "rank", scratch)
    return ranked.select("tree", F.floor(F.col("rank") / RUN).alias("block"), "node").join(vecs, "node").select("block", "node", "label", "dim", "vec")


NEAR = "node bigint, other bigint, sim double"


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> pa.Table | None:
    """The k best others of each row at FLOOR or above."""
    np.fill_diagonal(sims, -2.0)
    k = min(k, len(ids) - 1)
    if k < 1 or sims.max() < FLOOR:
        return None
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(sims, top, axis=1)
    r, c = np.nonzero(got >= FLOOR)
    return pa.table({"node": ids[r], "other": ids[top[r, c]], "sim": got[r, c]}) if len(r) else None


def _local(with_label: bool, k: int) -> Callable[[pa.Table], pa.Table | None]:
    """Compare all members of a group, those of one label and length with each other."""

    def run(group: pa.Table) -> pa.Table | None:
        ids, out = np.asarray(group["node"]), []
        ids, at = np.unique(ids, return_index=True)
        packed, dims = group["vec"].to_pylist(), np.asarray(group["dim"])
        names = np.asarray(group["label"]) if with_label else np.zeros(len(dims))
        kinds = {}
        for i in at:
            kinds.setdefault((names[i], dims[i]), []).append(i)
        all_ids = np.asarray(group["node"])
        for rows in kinds.values():
            if len(rows) > 1:
                x = _unit([packed[i] for i in rows])
                found = _best(x @ x.T, all_ids[rows], k)
                if found is not None:
                    out.append(found)
        return pa.concat_tables(out) if out else None

    return run


def _merge(found: DataFrame, caps: DataFrame | None) -> DataFrame:
    """(node, list, cap): the best ``cap`` different others of each node, best first."""
    pairs = found.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    if caps is None:
        pairs = pairs.withColumn("cap", F.lit(K))
    else:
        pairs = pairs.join(caps.select("node", "cap"), "node", "left").withColumn("cap", F.coalesce("cap", F.lit(K)))
    rank = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    kept = pairs.withColumn("r", F.row_number().over(rank)).where("r <= cap")
    return kept.groupBy("node", "cap").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other"))).alias("list"))


def _descend(vecs: DataFrame, graph: DataFrame, scratch: Scratch, threshold: float) -> tuple[DataFrame, int]:
    """One round; returns the new graph and the number of nodes whose list changed."""
    edges = graph.where("fresh").select(F.col("node").alias("pivot"), F.explode("list").alias("n")).select("pivot", F.col("n.other").alias("node"))
    old = graph.where("not fresh").select(F.col("node").alias("pivot"), F.explode("list").alias("n")).select("pivot", F.col("n.other").alias("node"))
    changed = graph.where("fresh").select(F.col("node").alias("pivot"))
    forward = edges.withColumn("reverse", F.lit(False))
    # reverse neighbours: of changed pivots from all lists, and the pivots that changed nodes point to
    back = edges.unionByName(old).select(F.col("node").alias("pivot"), F.col("pivot").alias("node")).join(changed, "pivot", "left_semi").withColumn("reverse", F.lit(True))
    # a pivot's reverse neighbours go to as many groups as K of them need; its own list and itself to each
    order = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    sizes = back.groupBy("pivot").agg(F.ceil(F.count("*") / (2 * K)).cast("int").alias("groups"))
    dealt = back.join(sizes, "pivot").select("pivot", "node", (order % F.col("groups")).cast("int").alias("g"))
    own = forward.select("pivot", "node").unionByName(changed.select("pivot", F.col("pivot").alias("node")))
    own = own.join(sizes, "pivot", "left").select("pivot", "node", F.explode(F.expr("sequence(0, coalesce(groups, 1) - 1)")).alias("g"))
    members = dealt.unionByName(own).distinct().join(vecs, "node").select("pivot", "g", "node", "label", "dim", "vec")
    found = _map_groups(members, ["pivot", "g"], _local(False, K_MAX), NEAR)
    kept = graph.select("node", F.explode("list").alias("n")).select("node", F.col("n.other").alias("other"), (-F.col("n.far")).alias("sim"))
    full = F.when((F.size("list") >= F.col("cap")) & (-F.col("list")[F.col("cap") - 1]["far"] >= threshold), F.least(F.col("cap") * 2, F.lit(K_MAX))).otherwise(F.col("cap"))
    caps = graph.select("node", full.alias("cap"))
    merged = _merge(found.unionByName(kept), caps)
    was = graph.select(F.col("node").alias("w"), F.hash("list").alias("h"))
    # stretched lists differ in their members; equal members with equal sums stay as they are
    out = merged.join(was, merged.node == was.w, "left").select("node", "cap", "list", (F.col("h").isNull() | (F.hash("list") != F.col("h"))).alias("fresh"))
    out = scratch.save(out, "graph")
    return out, out.where("fresh").count()


def _components(graph: DataFrame, threshold: float) -> DataFrame:
    edges = graph.select("node", F.explode("list").alias("n")).where(-F.col("n.far") >= threshold).select(F.col("node").alias("a"), F.col("n.other").alias("b"))
    return connected_components(edges)


def _bridged(vecs: DataFrame, graph: DataFrame, placed: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """``placed`` with those components merged between which full lists may have pushed all links out.

    A link is in neither list of its ends only if both are full of links.  So the components that have such nodes are
    cut into cells around members, and all of a label are compared: by the angles of centres and the reach of cells,
    and where these leave it open, member by member.
    """
    full = graph.where((F.size("list") >= F.col("cap")) & (-F.col("list")[F.col("cap") - 1]["far"] >= threshold)).select("node")
    crowded = placed.join(full, "node", "left_semi").select("component").distinct()
    inside = scratch.save(placed.join(crowded, "component").join(vecs, "node").select("component", "node", "label", "dim", "vec"), "crowded")
    rivals = inside.where("node = component").groupBy("label", "dim").count().where("count > 1").select("label", "dim")
    inside = inside.join(rivals, ["label", "dim"])
    if inside.isEmpty():
        return placed
    sizes = inside.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = inside.join(sizes, "component").withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    def cut(group: pa.Table) -> pa.Table:
        ids, x = np.asarray(group["node"]), _unit(group["vec"].to_pylist())
        cell, reach, left = np.zeros_like(ids), np.zeros(len(ids)), np.arange(len(ids))
        while len(left):
            cos = x[left] @ x[left[0]]
            near = cos >= threshold
            near[0] = True
            cell[left[near]], reach[left[near]] = ids[left[0]], np.arccos(np.clip(cos[near].min(), -1, 1))
            left = left[~near]
        return pa.table({"node": ids, "cell": cell, "reach": reach})

    cells = scratch.save(_map_groups(dealt.select("component", "c", "node", "vec"), ["component", "c"], cut, "node bigint, cell bigint, reach double"), "cells")
    centres = cells.where("node = cell").join(inside, "node").select("cell", "reach", "component", "label", "dim", "vec")
    shares = centres.groupBy("label", "dim").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    spread = centres.join(shares, ["label", "dim"]).withColumn("c", F.pmod(F.xxhash64("cell"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, chunks - 1)")))
    side = lambda x, y, n: spread.where(F.col(x) <= F.col(y)).select("label", "dim", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(n).alias("side"), "cell", "reach", "component", "vec")
    widest = float(np.arccos(threshold)) + 1e-6

    def near(group: pa.Table) -> pa.Table | None:
        sides, ids, comps, reach, x = np.asarray(group["side"]), np.asarray(group["cell"]), np.asarray(group["component"]), np.asarray(group["reach"]), _unit(group["vec"].to_pylist())
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if not len(a) or not len(b):
            return None
        cos = x[a] @ x[b].T
        r, c = np.nonzero((np.arccos(np.clip(cos, -1, 1)) <= widest + reach[a][:, None] + reach[b][None, :]) & (comps[a][:, None] != comps[b][None, :]))
        i, j, linked = a[r], b[c], cos[r, c] >= threshold
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        return pa.table({"a_cell": ids[i], "b_cell": ids[j], "a": comps[i], "b": comps[j], "linked": linked})

    blocks = side("c", "o", 0).unionByName(side("o", "c", 1))
    pairs = scratch.save(_map_groups(blocks, ["label", "dim", "x", "y"], near, "a_cell bigint, b_cell bigint, a bigint, b bigint, linked boolean").distinct(), "pairs")
    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sure = ends(pairs.where("linked"))
    open_ = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(sure.select(F.col("a").alias("lo"), F.col("b").alias("hi")), ["lo", "hi"], "left_anti")
    members = cells.select("node", "cell").join(vecs.select("node", "vec"), "node")
    of = lambda name, n: open_.join(members, F.col(name) == F.col("cell")).select("a_cell", "b_cell", "a", "b", F.lit(n).alias("side"), "vec")

    def meet(group: pa.Table) -> pa.Table | None:
        sides, packed = np.asarray(group["side"]), group["vec"].to_pylist()
        a, b = (_unit([packed[i] for i in np.flatnonzero(sides == n)]) for n in (0, 1))
        return group.select(["a", "b"]).slice(0, 1) if (a @ b.T >= threshold).any() else None

    met = ends(_map_groups(of("a_cell", 0).unionByName(of("b_cell", 1)), ["a_cell", "b_cell"], meet, "a bigint, b bigint"))
    roots = connected_components(scratch.save(sure.unionByName(met), "bridges")).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return placed.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def _audit(vecs: DataFrame, placed: DataFrame, threshold: float) -> float:
    """Recall by bounded samples of nodes against all nodes of their labels.

    A node's recall is the share of its links that lie inside its component.  Members of components of over K_MAX nodes
    and all others are sampled apart, so that a hot group doesn't hide what small groups lost; of both means of the
    nodes that have links the lesser counts.
    """
    sizes = placed.groupBy("component").agg(F.count("*").alias("members"))
    placed = placed.join(sizes, "component").select("node", "component", (F.col("members") > K_MAX).alias("crowd"))
    every = vecs.join(placed, "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    pick = lambda crowd: every.where(F.col("crowd") == crowd).orderBy(F.xxhash64(F.lit(SEED), "node")).limit(AUDIT_ROWS)
    sample = pick(False).unionByName(pick(True)).toArrow()
    if not sample.num_rows:
        return 1.0
    ids, names, comps = np.asarray(sample["node"]), np.array(sample["label"].to_pylist(), object), np.array([-1 if c is None else c for c in sample["component"].to_pylist()])
    dims, packed = np.asarray(sample["dim"]), sample["vec"].to_pylist()
    groups = {}
    for i in range(len(ids)):
        groups.setdefault((names[i], int(dims[i])), []).append(i)
    units = {k: (np.array(v), _unit([packed[i] for i in v])) for k, v in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, inside = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for b in batches:
            label, dim, vec = b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("vec").to_pylist()
            node, comp = np.asarray(b.column("node")), np.array([-2 if c is None else c for c in b.column("component").to_pylist()])
            kinds = {}
            for i, k in enumerate(zip(label, dim, strict=True)):
                kinds.setdefault(k, []).append(i)
            for k, rows in kinds.items():
                if k in units:
                    at, x = units[k]
                    hit = (x @ _unit([vec[i] for i in rows]).T >= threshold) & (ids[at][:, None] != node[rows][None, :])
                    links[at] += hit.sum(axis=1)
                    inside[at] += (hit & (comps[at][:, None] == comp[rows][None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(inside)], ["node", "n", "i"])

    got = {r[0]: r[1] / r[2] for r in every.drop("crowd").mapInArrow(run, "node bigint, n bigint, i bigint").groupBy("node").agg(F.sum("i"), F.sum("n").alias("n")).where("n > 0").collect()}
    crowd = dict(zip(ids.tolist(), sample["crowd"].to_pylist(), strict=True))
    return min((float(np.mean(x)) for c in (False, True) if (x := [r for i, r in got.items() if crowd[i] == c])), default=1.0)


def _counted(vecs: DataFrame, nodes: DataFrame, placed: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, links): rows linked with each node beside its own, exact inside its component, by blocks of chunks."""
    inside = placed.join(nodes.select("node", "size"), "node").join(vecs, "node")
    sizes = placed.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # a chunk is a hash share of a component, a block an ordered pair of chunks: rows of the first count rows of the second
    dealt = inside.join(sizes, "component").withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.select("component", "node", "size", "vec", "c", F.explode(F.expr("sequence(0, chunks - 1)")).alias("o"))
    left = dealt.select("component", F.col("c").alias("x"), F.col("o").alias("y"), F.lit(0).alias("side"), "node", "size", "vec")
    right = dealt.select("component", F.col("o").alias("x"), F.col("c").alias("y"), F.lit(1).alias("side"), "node", "size", "vec")

    def run(group: pa.Table) -> pa.Table | None:
        side, ids, size, packed = np.asarray(group["side"]), np.asarray(group["node"]), np.asarray(group["size"]), group["vec"].to_pylist()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return None
        hit = _unit([packed[i] for i in a]) @ _unit([packed[i] for i in b]).T >= threshold
        hit &= ids[a][:, None] != ids[b][None, :]
        return pa.table({"node": ids[a], "links": (hit @ size[b]).astype(np.int64)})

    counted = _map_groups(left.unionByName(right), ["component", "x", "y"], run, "node bigint, links bigint")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", trees: int = TREES, rounds: int = ROUNDS
) -> DataFrame:
    """(id, n_links, component_id, kept, n_same) of every row.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at least
    ``threshold``; vectors of different lengths never link.  Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing.  component_id is the least id reachable; kept marks its row.  Rows that
    repeat a label and vector link with each other; n_same counts them.  Null ids take part; a component of null
    ids alone has a null component_id and kept false.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardupvec")
    rows, nodes = _nodes(vectors, id_col, vec_col, label_col, scratch)
    vecs = scratch.save(_packed(nodes), "vectors")
    found = scratch.save(_map_groups(_trees(vecs, 0, trees, scratch), ["block"], _local(True, K), NEAR), "found")
    graph = scratch.save(_merge(found, None).withColumn("fresh", F.lit(True)), "graph")
    scratch.drop(found)
    grown, placed = trees, None
    for attempt in range(ATTEMPTS):
        for _ in range(rounds):
            graph, moved = _descend(vecs, graph, scratch, threshold)
            release_shuffles(spark)
            if not moved:
                break
        placed = scratch.save(_components(graph, threshold), "placed")
        placed = scratch.save(_bridged(vecs, graph, placed, threshold, scratch), "placed")
        recall = _audit(vecs, placed, threshold)
        if recall >= RECALL:
            break
        if attempt == ATTEMPTS - 1:
            raise RuntimeError(f"recall is {recall:.3f} after {grown} trees, under {RECALL}")
        more = _map_groups(_trees(vecs, grown, trees, scratch), ["block"], _local(True, K), NEAR)
        grown += trees
        kept = graph.select("node", F.explode("list").alias("n")).select("node", F.col("n.other").alias("other"), (-F.col("n.far")).alias("sim"))
        graph = scratch.save(_merge(more.unionByName(kept), graph).withColumn("fresh", F.lit(True)), "graph")
    counted = _counted(vecs, nodes, placed, threshold, scratch)
    known = nodes.select("node", "h", "key", "least", "size").join(placed, "node", "left").join(counted, "node", "left")
    known = scratch.save(known.select("node", "h", "key", "least", "size", F.coalesce("component", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    first = known.groupBy("root").agg(F.min("least").alias("first"))
    known = known.join(first, "root").select(F.col("h").alias("k_h"), F.col("key").alias("k_key"), "size", "links", "first")
    out = rows.join(known, (rows.h == F.col("k_h")) & (rows.key == F.col("k_key")), "left")
    component = F.when(F.col("size").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    return out.select(
        F.col("vec_id").alias(id_col),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        F.coalesce("size", F.lit(1)).cast("long").alias("n_same"),
    )
