"""Retrieval by the term index against brute force, both ways of scoring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from procurelake.operators import search

ASKED, CORPUS = "query_id long, vec array<double>, terms array<string>", "doc_id long, vec array<double>, terms array<string>"


def similarity(q, d, share):
    cosine = 0.0
    if q[1] and d[1] and len(q[1]) == len(d[1]) and None not in q[1] and None not in d[1]:
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        norm = math.sqrt(dot(q[1], q[1])) * math.sqrt(dot(d[1], d[1]))
        cosine = dot(q[1], d[1]) / norm if norm else 0.0
        cosine = 0.0 if math.isnan(cosine) else cosine
    mine, theirs = set(q[2] or []) - {None}, set(d[2] or []) - {None}
    return share * cosine + (1 - share) * (len(mine & theirs) / len(mine) if mine else 0.0)


def best(queries, corpus, k, threshold, share):
    out = []
    for q in queries:
        found = sorted((-similarity(q, d, share), d[0] is not None, d[0]) for d in corpus)
        out += [(q[0], i, round(-s, 9), r + 1) for r, (s, _, i) in enumerate([f for f in found if -f[0] >= threshold][:k])]
    return sorted(out, key=repr)


def given(rng, n, with_vectors):
    pick = lambda: [rng.choice([0.0, 1.0, -1.0, 2.0]) for _ in range(rng.choice([3, 3, 3, 2]))]
    rows = []
    for i in range(n):
        vec = rng.choice([pick(), pick(), None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 1.0]]) if with_vectors else None
        terms = rng.choice([None, []]) if rng.random() < 0.05 else [rng.choice(["the", "of", None, f"t{int(rng.paretovariate(0.7)) % 90}", f"t{rng.randrange(90)}"]) for _ in range(rng.randint(1, 7))]
        rows.append((i, vec, terms))
    return rows


@pytest.mark.parametrize(("most", "pairs", "vectors", "k", "threshold", "share"), [(None, 0, True, 8, 0.2, 0.3), (0, 0, True, 8, 0.2, 0.3), (50, 200_000, True, 8, 0.2, 0.3), (50_000, 0, False, 8, 0.2, 0.3), (50_000, 200_000, True, 3, 0.5, 0.3), (40, 0, True, 5, 0.6, 0.9), (50_000, 0, False, 2, 0.0, 0.3)])
def test_search_brute_force(spark, monkeypatch, most, pairs, vectors, k, threshold, share):
    """Scored in blocks only, by the index only, and some queries by each; ties, nulls and repeated rows."""
    monkeypatch.setattr(search, "BROADCAST_PAIRS", pairs)
    monkeypatch.setattr(search, "BLOCK_BYTES", 2000)
    if most is not None:  # with an index
        monkeypatch.setattr(search, "ONCE_QUERIES", 0)
    rng = random.Random((most or 7) + k)
    corpus = given(rng, 200, vectors)
    corpus += [(i + 1000, v, t) for i, v, t in corpus[:20]] + corpus[:5] + [(None, [1.0, 0.0, 0.0], ["the"])]
    queries = given(rng, 30, vectors)
    got = search.hybrid_topk(spark.createDataFrame(queries, ASKED), spark.createDataFrame(corpus, CORPUS).repartition(3), k, threshold, share, most)
    assert got.columns == ["query_id", "doc_id", "similarity", "rank"]
    assert sorted(((q, d, round(s, 9), r) for q, d, s, r in got.collect()), key=repr) == best(queries, corpus, k, threshold, share)


@pytest.mark.parametrize("once", [0, 2000])
def test_search_plan_and_empty_tables(spark, monkeypatch, once):
    monkeypatch.setattr(search, "ONCE_QUERIES", once)
    none_q, none_d = spark.createDataFrame([], ASKED), spark.createDataFrame([], CORPUS)
    one_q, one_d = spark.createDataFrame([(1, None, ["a", "b"])], ASKED), spark.createDataFrame([(1, None, ["b"]), (2, None, ["c"])], CORPUS)
    assert search.hybrid_topk(none_q, one_d).count() == search.hybrid_topk(one_q, none_d).count() == 0
    got = search.hybrid_topk(one_q.withColumn("q", F.lit(1)).withColumn("row", F.lit(2)), one_d.withColumn("term", F.lit("x")))
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0.7 * 0.5, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_is_read_again(spark, tmp_path):
    corpus = given(random.Random(1), 50, True)
    path = f"file://{tmp_path}/index"
    search.build_index(spark.createDataFrame(corpus, CORPUS), path)
    queries = given(random.Random(2), 5, True)
    got = search.search(spark.createDataFrame(queries, ASKED), search.load_index(spark, path))
    assert sorted(((q, d, round(s, 9), r) for q, d, s, r in got.collect()), key=repr) == best(queries, corpus, 8, 0.2, 0.3)
