"""Operators with a trained or approximate part: accuracy held out, recall, planted cases; and the pipeline."""

import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_exact import EDGES, cut_lines, fingerprint, hits

import corpus_pipeline
from procurelake.llm import bpe, langid, neardupvec, quality
from procurelake.llm.queries import QUERIES

VEC = "vec_id long, embedding array<float>, label int"


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.98


def test_language_learns_from_its_fold_only(spark):
    rows = [(i, "zzz qqq " * 5 if i % 2 else "aaa eee " * 5, "zz" if i % 2 else "aa") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lied = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    model = langid.train(lied)
    assert model.langs == ["aa", "zz"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(lied, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_language_edges(spark):
    rows = [(i, t, "en" if i == 4 else None) for i, t in EDGES] + [(9, "1234 !?", "en"), (10, "plain words", "en"), (12, "plain words", "en"), (13, "plain words", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3, 9))
    untold = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(untold).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def brute(rows, threshold=0.93):
    ok = {}
    for i, v, label in rows:
        if v is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            ok[i] = (x / np.linalg.norm(x), label)
    up = {i: i for i, _, _ in rows}
    n = dict.fromkeys(up, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in up}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(600):
        c = centres[i % 12] + rng.standard_normal(16) * (0.12 if i % 3 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in c], i % 2))
    rows += [(1000 + i, rows[0][1], 0) for i in range(90)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, rows[0][1], None), (2005, rows[0][1][:8], 0), (2006, [float("inf")] * 16, 0), (2007, [], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardupvec.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    want = brute(rows)
    found = sum(min(got[i][0], want[i][0]) for i in want)
    assert found >= 0.97 * sum(w[0] for w in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert {i: got[i] for i in range(2000, 2008)} == {i: want[i] for i in range(2000, 2008)}


def test_vectors_of_dense_groups_that_link_across(spark):
    """Every list fills up inside its own group, so no list holds a link to the other one."""
    rng = np.random.default_rng(3)
    noise = rng.standard_normal((400, 64))
    noise[:, :5] = 0
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    rows = []
    for i in range(400):
        v = noise[i] * 0.015**0.5
        v[0], v[1 + i // 200] = 0.945**0.5, 0.04**0.5
        rows.append((i, v.tolist(), 7))
    rows += [(1000 + i, np.roll(r[1], 9).tolist(), 7) for i, r in enumerate(rows[:100])]  # a group out of reach
    schema = "vec_id long, embedding array<double>, label int"
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardupvec.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == brute(rows) and got[399][:2] == (399, 0)


def test_audit_sees_lost_pairs_beside_a_hot_group(spark):
    """A hot group that is found whole doesn't hide that every pair elsewhere is lost."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((300, 16)) + rng.standard_normal((300, 16)) * 0.01, np.repeat(rng.standard_normal((150, 16)), 2, axis=0) + rng.standard_normal((300, 16)) * 0.01])
    vecs = spark.createDataFrame([(i, 1, 16, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, label int, dim int, vec binary")
    hot = spark.createDataFrame([(i, 0) for i in range(300)], "node long, component long")
    pairs = spark.createDataFrame([(i, i // 2 * 2) for i in range(300, 600)], "node long, component long")
    assert neardupvec._audit(vecs, hot, 0.93) < neardupvec.RECALL <= neardupvec._audit(vecs, hot.unionByName(pairs), 0.93)


def test_failed_audit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neardupvec, "ATTEMPTS", 1, raising=False)
    monkeypatch.setattr(neardupvec, "_audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="recall"):
        neardupvec.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], VEC), rounds=1)


def test_vectors_empty(spark):
    assert neardupvec.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    alone = neardupvec.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)], VEC)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in alone} == {(1, 1, 1, True), (2, 0, 2, True), (None, 1, 1, False)}


def test_quality_tells_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.resample(docs, labels).join(labels, "doc_id")
    kept = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.95 and kept[0] < 0.2


def test_quality_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (6, 0, 0), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.resample(df, labels, keep_share=0.5)
    assert got.count() == len(EDGES) and got.where("kept").count() == len(EDGES) // 2
    assert got.where("log_weight is null").where("kept").count() == 0
    assert quality.resample(df, labels.limit(0)).count() == len(EDGES) and quality.resample(df.limit(0), labels).count() == 0
    assert quality.resample(df, labels, keep_share=0.5).exceptAll(got).count() == 0


def test_queries_are_complete():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_by_brute_force(spark):
    """Line dedup, near-dedup, decontamination and BPE by definition, on what language ID keeps."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tests = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    first = corpus_pipeline.language_id(spark, docs, SMALL)
    assert first.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in first.collect())
    assert len(rows) >= 0.95 * docs.where("text is not null").count()
    rows = [(i, t) for (i, _), t in zip(rows, cut_lines(rows), strict=True)]
    fp = {i: fingerprint(t) for i, t in rows}
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    rows = [(i, t) for i, t in rows if find(i) == i]
    dirty = {r[0] for r in hits(rows, tests) if r[5]}
    rows = {i: t for i, t in rows if i not in dirty}
    v = bpe.vocabulary(bpe.default_ranks())
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {i: (len(p), p.tobytes()) for i, t in rows.items() for p in v.encode([t])}


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_bear_edges(spark, k):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in EDGES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        got = corpus_pipeline.STAGES[k][1](spark, df, SMALL)
        assert got.columns == docs.columns and got.count() <= df.count()


def naive_bayes(rows, texts):
    """Language and posterior by the definition, over hashed n-grams counted one by one."""
    from collections import Counter
    from math import exp, log

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        while "  " in letters:
            letters = letters.replace("  ", " ")
        out = []
        for n in langid.LENGTHS:
            for i in range(len(letters) - n + 1):
                h = n
                for k in range(n):
                    h = (h ^ ord(letters[i + k])) * int(langid.FACTORS[k]) % 2**64
                    h ^= h >> 29
                out.append(h * int(langid.FACTORS[0]) % 2**64 >> 64 - langid.BUCKETS_LOG2)
        return out

    counts, docs = {}, Counter()
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(grams(text))
        docs[lang] += 1
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        sums = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + 0.5 * (1 << langid.BUCKETS_LOG2)
            sums[lang] = log(docs[lang] / sum(docs.values())) + sum(log((counts[lang][g] + 0.5) / total) for g in grams(text))
        best = max(sums, key=lambda k: (sums[k], [-ord(c) for c in k]))
        out.append((best, 1 / sum(exp(s - sums[best]) for s in sums.values())))
    return out


def test_language_by_the_definition(spark):
    """With few rows every one is learned from, so the model is known; most rows are of one language, which the prior shows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 1500").select("doc_id", "text", "lang").orderBy("doc_id").limit(70).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs] + [(1000 + i, t, "zz" if i < 9 else None) for i, t in enumerate(["ab", "b a", "c", "q", "Ä ß", "ab ab", "x y", "1", "z", "", " 1 ", None, "İstanbul a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    want = naive_bayes([(t, lang) for i, t, lang in rows if not fold[i] and lang and t is not None], [t for _, t, _ in rows])
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i].lang_pred == lang and got[i].held_out == fold[i] and got[i].score == pytest.approx(score, abs=1e-3)


def test_language_tells_rows_of_one_id_apart(spark):
    """The rows of one id are not taken or left together."""
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1)
    df = spark.createDataFrame([(one, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en") for i in range(2000)], "doc_id long, text string, lang string")
    seen = lambda n: int((langid.train(df, rows_per_lang=n).logp > langid.train(df, rows_per_lang=n).logp.min()).sum())
    assert 0.1 < seen(500) / seen(2000) < 0.9


def importance(docs, good):
    """Log-ratios by the definition: {id: (sum, n-grams)}."""
    from collections import Counter
    from math import log

    def grams(text):
        words = [zlib.crc32(w) for w in (text or "").encode().lower().split()]
        pairs = [(a * 0xC2B2AE3D27D4EB4F ^ b * 0x165667B19E3779F9) % 2**64 for a, b in zip(words, words[1:])]
        return [x * 0x9E3779B97F4A7C15 % 2**64 >> 64 - quality.BUCKETS_LOG2 for x in words + pairs]

    raw, target = Counter(), Counter()
    for i, text in docs:
        raw.update(grams(text))
        if i in good:
            target.update(grams(text))
    of = lambda c, b: log((c[b] + quality.SMOOTH) / (sum(c.values()) + quality.SMOOTH * (1 << quality.BUCKETS_LOG2)))
    return {i: (sum(of(target, b) - of(raw, b) for b in grams(t)), len(grams(t))) for i, t in docs}


@pytest.mark.parametrize("weight", ["mean", "sum"])
def test_quality_by_the_definition(spark, weight):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(60).collect()] + [(5000, None), (5001, " ")]
    labels = [(i, int(k % 3 > 0), int(k % 7 == 0)) for k, (i, _) in enumerate(docs[:50])] + [(None, 1, 0), (9999, 1, None)]
    want = importance(docs, {i for i, q, t in labels if q and not t})
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.resample(df, marks, keep_share=0.4, weight=weight).collect()}
    for i, (total, n) in want.items():
        if not n:
            assert got[i].log_ratio is None and got[i].log_weight is None and not got[i].kept
            continue
        assert got[i].log_ratio == pytest.approx(total, rel=1e-3, abs=1e-3)
        assert got[i].log_weight == pytest.approx(total / n if weight == "mean" else total, rel=1e-3, abs=1e-3)
    keys = sorted((r.sample_key for r in got.values() if r.sample_key is not None), reverse=True)
    assert {r.sample_key for r in got.values() if r.kept} == set(keys[: int(len(docs) * 0.4)])
    noise = {i: r.sample_key - quality.SHARPNESS[weight] * r.log_weight for i, r in got.items() if r.sample_key is not None}
    assert 0.2 < np.mean(list(noise.values())) < 1.0  # Gumbel noise has mean 0.577
