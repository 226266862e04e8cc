"""MinHash near-dedup, embedding near-dedup and connected components."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import minhash, quantise
from tillsight.llm.graph import components

from .conftest import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_texts(texts):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return [len(s) for s in sets], roots(len(sets), links)


def near_texts():
    rng, out = random.Random(4), []
    for family in range(8):
        base = words(150, family).split()
        for copy in range(9):
            w = list(base)
            for _ in range(copy // 2):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
            out.append(" ".join(w) if copy % 3 else " ".join(w).upper())
    return out + ["one two", "ONE two", "", None, "  "]


@pytest.mark.parametrize("block", [2000, 2])
def test_families_against_brute_force(spark, block):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, root = brute_texts(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, family_block=block).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n[i], root[i], root[i] == i)


def test_family_of_long_texts_in_blocks_of_bytes(spark, monkeypatch):
    """Rows repeated with their id travel once, and a task's texts keep to the bound."""
    base = words(2000, 3).split()
    texts = [" ".join(base[:i * 40] + [f"new{i}"] + base[i * 40 + 1:]) for i in range(40)]
    rows = list(enumerate(texts)) + [(3, texts[3])] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bound, tasks, whole = 8 * len(texts[0]), [], minhash.family_texts

    def spy(*given):
        out = whole(*given)
        tasks.extend(out.groupBy("root", "i", "j").agg(
            F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n"),
            F.countDistinct("lo").alias("classes")).collect())
        return out
    monkeypatch.setattr(minhash, "family_texts", spy)
    got = minhash.near_duplicates(df, family_bytes=bound).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}
    assert len(tasks) > 1 and all(t.n == t.classes for t in tasks)
    assert max(t.size for t in tasks) < 4 * bound < sum(map(len, texts))


def test_min_max_values_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    s = minhash.signatures([a, b], 128)
    assert s.shape == (2, 256)
    assert abs((s[0] == s[1]).mean() - 0.9) < 0.08
    assert (s[:, ::2] <= s[:, 1::2]).all()


def test_near_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == odd.count()
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[8][1:] == (7, False) and got[9][1:] == (7, False) and got[14][1:] == (7, False)
    assert got[4][1:] == (4, True) and got[13][1:] == (4, False)
    assert got[None][1:] == (None, True)
    assert minhash.near_duplicates(empty).collect() == []
    kept = minhash.keep_one(odd.withColumn("lo", F.lit(1)))
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 15] and "lo" in kept.columns


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 40)],
    [(i, i + 7) for i in range(40)] + [(50, 51), (51, 50), (3, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    want = roots(60, links)
    assert got == {i: want[i] for p in links for i in p if p[0] != p[1]}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24))
    for i in range(40, 120):
        x[i] = x[i % 7] + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.45])
    x[130:140] = x[130]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] + [1.0] * 23),
             (304, [None] + [1.0] * 23), (305, [float("inf")] * 24), (306, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = np.array([r for _, r in rows[:300]], np.float32).astype(float)
    norm = np.sqrt((v ** 2).sum(1))
    near = (v[:, None] * v[None]).sum(2) / (norm[:, None] * norm[None]) >= 0.9
    np.fill_diagonal(near, False)
    root = roots(300, list(zip(*np.nonzero(near))))
    quantise_chunk, quantise.CHUNK = quantise.CHUNK, 16
    try:
        got = {r.vec_id: r for r in quantise.near_duplicates(df).collect()}
    finally:
        quantise.CHUNK = quantise_chunk
    assert near.sum() > 100 and len(got) == len(rows)
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (
            near[i].sum(), root[i], root[i] == i)
    for i in range(300, 307):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_dense_list_in_blocks_against_brute_force(spark, monkeypatch):
    """Tight and loose blobs and copies; no task holds more than its blocks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(420, 24))
    for a, b, spread in ((20, 120, 0.02), (120, 220, 0.12), (220, 320, 0.33)):
        x[a:b] = x[1] + rng.normal(size=(b - a, 24)) * spread
    x[320:340] = x[20]
    v = x.astype(np.float32).astype(float)
    norm = np.sqrt((v ** 2).sum(1))
    near = (v[:, None] * v[None]).sum(2) / (norm[:, None] * norm[None]) >= 0.9
    np.fill_diagonal(near, False)
    root = roots(420, list(zip(*np.nonzero(near))))
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)],
                               "vec_id long, embedding array<float>")
    monkeypatch.setattr(quantise, "CHUNK", 32)
    monkeypatch.setattr(quantise, "ASK_BLOCK", 16)
    tables, keep = {}, quantise.stored
    monkeypatch.setattr(quantise, "stored", lambda d, n: tables.setdefault(n, keep(d, n)))
    got = {r.vec_id: r for r in quantise.near_duplicates(df).collect()}
    for i in range(420):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (
            near[i].sum(), root[i], root[i] == i)
    balls = tables["balls"].where("radius > 0")
    assert 0 < balls.where("node = ball").count() < balls.count() / 8
    assert tables["cut_links"].count()


def test_asked_side_is_cut_into_blocks(spark, monkeypatch):
    """Sizes of the cogroups' sides as Python receives them."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(600, 16)) * 0.3
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)],
                               "vec_id long, embedding array<float>")
    monkeypatch.setattr(quantise, "CHUNK", 32)
    monkeypatch.setattr(quantise, "ASK_BLOCK", 32, raising=False)
    sizes, whole = [], PandasCogroupedOps.applyInArrow

    def spy(self, f, kind):
        for g in (self._gd1, self._gd2):
            sizes.append(g.count().agg(F.max("count")).first()[0] or 0)
        return whole(self, f, kind)
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", spy)
    quantise.near_duplicates(df).count()
    assert max(sizes) <= 3 * 32


def test_embeddings_empty_and_repeated(spark):
    kind = "vec_id long, embedding array<float>, n_links string"
    assert quantise.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    rows = [(5, [1.0, 0.0], "x"), (5, [1.0, 0.0], "x"), (4, [1.0, 0.0], "x"), (9, [0.0, 1.0], "x")]
    got = sorted(tuple(r) for r in quantise.near_duplicates(
        spark.createDataFrame(rows, kind)).collect())
    assert got == [(4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (9, 0, 9, True)]


def test_recall_of_planted_near_copies(spark, monkeypatch):
    """More lists than probes; partners at cosines from 0.9 up; hardly any is found on one side only."""
    monkeypatch.setattr(quantise, "LIST_SIZE", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 48))
    x /= np.sqrt((x ** 2).sum(1))[:, None]
    for i in range(0, 1600, 2):   # partner at a given cosine
        c = rng.uniform(0.9, 0.99)
        side = rng.normal(size=48)
        side -= side @ x[i] * x[i]
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * side / np.sqrt(side @ side)
    near = x @ x.T / np.sqrt((x ** 2).sum(1))[:, None] / np.sqrt((x ** 2).sum(1))[None] >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)],
                               "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in quantise.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(4000)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum() > 1500
    pairs = found[:1600].reshape(-1, 2)
    assert (pairs[:, 0] == pairs[:, 1]).mean() >= 0.998


def test_every_length_and_size_of_components(spark):
    rows = [(1, [3.0, 4.0]), (2, [6.0, 8.0]), (3, [3.0, 4.0, 0.0]), (4, [3.0, 4.1, 0.0]), (5, [1e-200, 0.0, 0.0]),
            (6, [3e-310, 0.0, 0.0]), (7, [1e300, 1e300]), (8, [1e-300, 1e-300]), (9, [0.0, 0.0]), (10, None), (11, []),
            (12, [5.0]), (13, [2.0]), (14, [-2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in quantise.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 7: (3, 1), 8: (3, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5),
                   9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (1, 12), 13: (1, 12), 14: (0, 14)}
