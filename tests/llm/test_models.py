"""Toxicity, language identification and LM scoring."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import langid, ngrams, toxicity
from tillsight.llm.common import held_out
from tillsight.llm.pieces import SPACE, Lattice

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MID = "/root/testdata/sf0.01"


# toxicity

def maximal_segments(s):
    """By definition: the best segment, then the same left and right of it."""
    if not len(s):
        return []
    best, where = 0, None
    for i in range(len(s)):
        for j in range(i, len(s)):
            x = sum(s[i:j + 1])
            if x > best + 1e-12:
                best, where = x, (i, j)
    if where is None:
        return []
    i, j = where
    return maximal_segments(s[:i]) + [(i, j, best)] + [
        (a + j + 1, b + j + 1, x) for a, b, x in maximal_segments(s[j + 1:])]


def test_segments_against_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 14))
        got, want = toxicity.segments(s), maximal_segments(s.tolist())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
        assert toxicity.best_segment(s) == pytest.approx(max([0, *(w[2] for w in want)]))


def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    rows = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    low = max(r.score for r in clean)
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == (r.predicted == 1) for r in rows)
    assert low < 0.9


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 16)] + [(4, None), (None, 1)],
                                   "doc_id long, toxic int")
    rows = toxicity.toxicity_report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity_report(odd, none).collect()} == {0}
    assert toxicity.toxicity_report(empty, labels).collect() == []
    clash = odd.withColumn("score", F.lit("x"))
    assert toxicity.drop_toxic(clash, none).columns == clash.columns


# language identification

def test_forward_sums_all_segmentations():
    pieces = [SPACE, SPACE + "a", "a", "b", "ab", "ba", SPACE + "ab", "aba"]
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces), 2))
    at = {x: i for i, x in enumerate(pieces)}

    def total(word, lang):
        if not word:
            return 1.0
        out = sum(p[at[word[:n]], lang] * total(word[n:], lang)
                  for n in range(1, min(4, len(word)) + 1) if word[:n] in at)
        return out + (langid.UNKNOWN * total(word[1:], lang) if word[0] not in at else 0)

    lattice, words = Lattice(pieces), ["a", "ab", "abab", "babaab", "axb"]
    got = langid.word_scores(lattice, words, p)
    for i, w in enumerate(words):
        for lang in range(2):
            assert got[i, lang] == pytest.approx(math.log(total(SPACE + w, lang)))
    # expected counts: derivative of the log probability in log p
    n = np.ones((len(words), 2))
    count = langid.expected_counts(lattice, words, n, p)
    for i in range(len(pieces)):
        q = p.copy()
        q[i] *= 1 + 1e-6
        change = (langid.word_scores(lattice, words, q) - got).sum(axis=0) / 1e-6
        assert count[i] == pytest.approx(change, rel=1e-3, abs=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_languages_of_odd_rows(odd, empty):
    got = {r.doc_id: r for r in langid.language_report(odd).collect()}
    for i in (1, 2, 3, 15):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in got.values()} <= {"en", "fr", "und"}
    assert langid.language_report(empty).collect() == []
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_report(unlabelled).collect()} == {"und"}


# LM scoring

def brute_scores(rows, mu):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [""]) for i, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    train = [t for (_, t), o in zip(tokens, out) if not o]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([""] + t, t))
    n, v = sum(c.values()), len(c)
    for (i, t), o in zip(tokens, out):
        uni = [(c[w] + 1) / (n + v + 1) for w in t]
        bi = [(pairs[a, w] + mu * p) / (c[a] + mu) for a, w, p in zip([""] + t, t, uni)]
        yield (i, o, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, uni)),
               sum(map(math.log10, bi)))


@pytest.mark.parametrize("kw", [{}, {"group_bytes": 3000, "hot_context": 20, "bucket_bytes": 40_000}])
def test_scores_against_brute_force(odd, kw):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in ngrams.score_texts(odd, held_out("doc_id", 7, 2), **kw).collect()),
                 key=str)
    want = sorted(brute_scores(rows, ngrams.MU), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= 2 * ngrams.QUANTUM * w[2]


def test_scores_without_rows(empty, odd):
    assert ngrams.scoring_report(empty).collect() == []
    rows = ngrams.score_texts(odd, F.lit(True)).collect()
    assert {(r.train_tokens, r.base_score) for r in rows} == {(0, 0.0)}


def test_elias_fano_sequences():
    rng = random.Random(5)
    for n, top in ((0, 1), (1, 1), (50, 40), (500, 10 ** 9), (300, 1 << 40)):
        values = np.array(sorted(rng.randrange(top) for _ in range(n)), np.int64)
        ef = ngrams.EliasFano(ngrams.EliasFano.code(values), 0)
        assert ef.get(np.arange(n)).tolist() == values.tolist()
        ask = np.array([rng.randrange(top + 3) for _ in range(200)], np.int64)
        assert ef.successor(ask).tolist() == np.searchsorted(values, ask).tolist()


def test_trie_finds_what_it_holds():
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(60), rng.randrange(500)) for _ in range(900)})
    context, child = np.array(pairs, np.int64).T
    p = np.array([-rng.random() * 9 for _ in pairs])
    trie = ngrams.Trie(ngrams.Trie.build(context, child, p))
    code = trie.find(context, child)
    assert (code > 0).all() and np.abs(ngrams.dequantise(code) - p).max() <= ngrams.QUANTUM
    ask = [(rng.randrange(70), rng.randrange(700)) for _ in range(3000)]
    got = trie.find(*np.array(ask, np.int64).T)
    assert [g > 0 for g in got] == [a in set(pairs) for a in ask]
