"""Operators over the whole corpus: substring dedup, filter audit, manifest; against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_exact import DOC, EDGES

from procurelake.llm import debruijn, filteraudit, merkle, wordhash


@pytest.fixture(scope="module")
def edges(spark):
    """Null ids and texts, an empty and a very long text, repeated rows, and names that operators use inside."""
    rows = [(i, t, "x", 1, "y", "k", 3) for i, t in EDGES]
    return spark.createDataFrame(rows, f"{DOC}, rk string, dk long, a string, digest string, n_words int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# ---- words


TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("ab é\t\n\x0b\x1c　")), max_size=25)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 2))
def test_words(texts, skip):
    column = pa.array(texts, pa.string()).slice(skip)
    words = wordhash.Words(column)
    want = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in column.to_pylist()]
    joined, begins = words.joined()
    data = joined.tobytes()
    got = [data[a : b - 1].decode() for a, b in zip(begins, begins[1:], strict=False)]
    assert got == [w for ws in want for w in ws]
    assert [got[a:b] for a, b in zip(words.first, words.first[1:], strict=False)] == want
    hashes = words.hashes().tolist()
    assert len(dict(zip(got, hashes, strict=True))) == len(set(hashes)) == len(set(got))  # equal words, equal hashes


# ---- substring dedup


def cut_spans(docs, width):
    """By the definition: (id, n_words, n_removed, kept) of each row."""
    split = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in docs]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - width + 1):
                first[tuple(w[k : k + width])] = min(i, first.get(tuple(w[k : k + width]), i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            least = first.get(tuple(w[k : k + width]))
            if least is not None and (i is None or least < i):
                gone |= set(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most", "width"), [(0, 4), (1_000_000, 4), (1_000_000, 13)])
def test_substrings_brute_force(spark, monkeypatch, most, width):
    """Few words, so that paths branch, loop and meet; copies, near copies, common passages, one word many times."""
    monkeypatch.setattr(debruijn, "BROADCAST_ENTRIES", most)
    rng = random.Random(width + most)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    passage = " ".join(f"p{k}" for k in range(40))
    for i in range(60, 140):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
        own[len(own) // 2 : len(own) // 2] = passage.split()[rng.randrange(20) : rng.randint(20, 40)]
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(own)))
    docs += [(200 + i, docs[rng.randrange(140)][1]) for i in range(40)]
    docs += [(300 + i, re.sub(r"w1\d*", "other", docs[rng.randrange(60, 140)][1])) for i in range(40)]
    docs += [(400, "same " * 50), (401, "same " * 70), (402, "x " * 12 + "same " * 5), (None, passage), (None, docs[70][1]), (70, docs[71][1]), (72, docs[72][1])]
    rng.shuffle(docs)
    got = debruijn.dedup_spans(spark.createDataFrame(docs, DOC).repartition(5), width=width).collect()
    assert sorted((tuple(r) for r in got), key=repr) == cut_spans(docs, width)


def test_substrings_edges(spark, edges, none):
    got = debruijn.dedup_spans(edges)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == cut_spans(EDGES, 13)
    assert debruijn.dedup_spans(none).count() == 0
    long = [("b", "word " * 200_000 + "end"), ("a", "word " * 20), ("c", "x" * 400_000)]
    got = {r.name: (r.n_words, r.n_removed) for r in debruijn.dedup_spans(spark.createDataFrame(long, "name string, body string"), "name", "body").collect()}
    assert got == {"a": (20, 0), "b": (200_001, 200_000), "c": (1, 0)}


# ---- filter audit


def audited(docs, labels):
    """By the definition: documents are (id, text, source), labels (id, quality, toxic); each order applied to all rows."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        copy = any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in docs)
        upper = sum("A" <= c <= "Z" for c in text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * len(text), bool(set(text) & set("#$%&*|")), copy]
        rows.append((source or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine, removed = [r for r in rows if r[0] == part], {}
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                late = sum(f in r[1] for r in mine) - len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), late, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        for row in out:
            if row[0] == part:
                row.append(removed[row[1][row[2] - 1]])
    return sorted(tuple(r) for r in out)


def test_filter_audit_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "B", "ccc", f"w{rng.randrange(900)}", "#" if rng.random() < 0.01 else "d"]) for _ in range(rng.choice([3, 199, 200, 260]))) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["s0", "s1", "", None, "only"])) for i in range(150)]
    docs += [(None, texts[0], "s0"), (None, None, None), (200, None, "s1"), (201, "", "s1"), (3, docs[3][1], "s0"), (202, "w " * 100_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, A int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    visits = []
    monkeypatch.setattr(filteraudit, "_edges", lambda s, state, left, f=filteraudit._edges: (visits.append(state), f(s, state, left))[1])
    got = filteraudit.audit(filteraudit.failures(frame, marks))
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, labels)
    assert len(visits) == len(set(visits)) == 31  # each unordered prefix once


def test_filter_audit_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(filteraudit.failures(frame, marks)).count() == 0
    one = spark.createDataFrame([(1, None, None)], frame.schema)
    got = filteraudit.audit(filteraudit.failures(one, marks)).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and {r.shapley for r in got if r.filter_order[r.step - 1] == "A"} == {120}


# ---- manifest


def hexed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    """All levels of a tree of arity three, the leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hexed(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climbed(tree, idx, leaf):
    """The siblings of a leaf, and what it leads to when it is ``leaf``."""
    found = []
    for nodes in tree[:-1]:
        first = idx // 3 * 3
        run = nodes[first : first + 3]
        found += run[: idx - first] + run[idx - first + 1 :]
        run[idx - first] = leaf
        leaf, idx = hexed(run), idx // 3
    return found, leaf


def manifest(docs):
    """By the definition; documents are (doc_id, source, lang, n_chars, text)."""
    told = lambda row: hexed(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])
    by_source = {}
    for row in docs:
        i, text = row[0], row[4]
        changed = told((*row[:4], text.replace("\n", ""))) if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else told(row)
        by_source.setdefault(row[1], []).append(((i is None, i or 0, told(row)), i, told(row), changed))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for idx, (_, i, leaf, changed) in enumerate(sorted(by_source[s])):
            below, sub = climbed(trees[s], idx, changed)
            beside, root = climbed(top, names.index(s), sub)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], hexed(below + beside), root, root == top[-1][0]))
    return sorted(out, key=repr)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("rows", "most"), [(7, 0), (200_000, 100_000)])
def test_manifest_brute_force(spark, monkeypatch, rows, most):
    """Sources of one to many rows, over many parts; nulls in every column, ties, repeated rows."""
    monkeypatch.setattr(merkle, "PART_ROWS", rows)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", most)
    rng = random.Random(rows)
    pick = lambda *xs: rng.choice([None, *xs])
    docs = [(i, rng.choice(["hot", "hot", "s1", "s2", "ünï", None, "", f"one{i}"]), pick("en", "de"), pick(1, 2), pick("a\nb", "", "é\n" * 50, "no line")) for i in range(200)]
    docs += [(None, "hot", None, None, None), (None, "s1", "en", 3, "x\ny"), (5, "s1", "en", 1, "p\nq"), docs[9], docs[9], (500, "s2", "en", 9, "long\n" * 100_000)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], f"{FIELDS}, leaf string, idx int, part int").repartition(3)
    got = merkle.audit(frame)
    assert got.columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    have = sorted((tuple(r) for r in got.collect()), key=repr)
    assert have == manifest(docs)
    assert {r[6] for r in have} == {True, False}


def test_manifest_small(spark, tmp_path):
    none = spark.createDataFrame([], FIELDS)
    assert merkle.audit(none).count() == 0
    one = [(4, None, None, None, None)]
    assert [tuple(r) for r in merkle.audit(spark.createDataFrame(one, FIELDS)).collect()] == manifest(one)
    docs = [(i, f"s{i % 2}", "en", 1, "t") for i in range(9)]
    root = merkle.write_manifest(spark.createDataFrame(docs, FIELDS), f"file://{tmp_path}/m")
    assert root == manifest(docs)[0][3]
    assert spark.read.parquet(f"file://{tmp_path}/m/leaves").count() == 9 and spark.read.parquet(f"file://{tmp_path}/m/subroots").count() == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=4), st.integers(2, 4), st.randoms(use_true_random=False))
def test_forests_are_a_monoid(sizes, arity, rng):
    """Any split of the leaves, merged in any order and grouping, gives the same roots and nothing else."""
    leaves = [(t, n, i, bytes([t, i])) for t, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(leaves)
    forests = [merkle.Forest(arity, keep=True) for _ in range(rng.randint(1, 6))]
    for t, n, i, v in leaves:
        rng.choice(forests).add(t, n, 0, i, v)
    while len(forests) > 1:
        a, b = (forests.pop(rng.randrange(len(forests))) for _ in "ab")
        forests.insert(rng.randint(0, len(forests)), a.merge(b))
    got = {t: v for t, _, _, _, v, root in forests[0].rows() if root}
    assert len(forests[0].open) == len(sizes)
    for t, n in enumerate(sizes):
        nodes = [bytes([t, i]) for i in range(n)]
        while len(nodes) > 1:
            nodes = [merkle.digest(nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        assert got[t] == nodes[0]
