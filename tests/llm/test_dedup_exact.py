"""Suffix-array dedup on bytes and difference-cover dedup on words."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import bwt, passages
from tillsight.llm.common import U64, window_hash

LENGTH = 40


def brute_bytes(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x),
                    hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_words(texts, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def got_bytes(df, **kw):
    rows = bwt.remove_repeats(df, **kw).select(
        "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return Counter(tuple(r) for r in rows)


def got_words(df, **kw):
    rows = passages.remove_repeats(df, **kw).select(
        "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    return Counter(tuple(r) for r in rows)


def test_window_hash_tells_windows_apart():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2], U64)
    for n in range(1, 9):
        keys = window_hash(h, n)
        assert len(keys) == 9 - n
        for i in range(9 - n):
            for j in range(9 - n):
                assert (keys[i] == keys[j]) == (h[i:i + n].tolist() == h[j:j + n].tolist())


def test_difference_cover_covers_every_shift():
    shifts = {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER}
    assert shifts == set(range(passages.PERIOD))


@pytest.mark.parametrize("texts", [
    [b"a"], [b"banana", b"ananas", b"banana"], [b"", b"x", b""], [b"aaaa" * 30, b"aaa" * 30],
    [bytes(random.Random(i).choices(b"ab", k=90)) for i in range(12)]])
def test_transform_is_inverted_with_its_order(texts):
    code = np.frombuffer(bwt.transform(texts), np.uint8)
    text, suffixes = bwt.invert(code, np.array([len(t) for t in texts]))
    assert bytes(text - 1) == b"\xff".join(texts) + b"\xff"
    joined = [(t[i:], n) for n, t in enumerate(texts) for i in range(len(t) + 1)]
    order = sorted(range(len(joined)), key=lambda i: joined[i])
    assert suffixes.tolist() == order


def test_merge_equals_sorting():
    rng = random.Random(3)
    shards, texts = [], []
    for _ in range(4):
        own = [bytes(rng.choices(b"abc", k=rng.randrange(1, 50))) for _ in range(6)]
        text, suffixes = bwt.invert(np.frombuffer(bwt.transform(own), np.uint8),
                                    np.array([len(t) for t in own]))
        shards.append((text, suffixes, np.array([len(t) for t in own]), np.ones(6, np.int64)))
        texts.append(own)
    found = bwt.repeats_of(shards, 6)
    seen = Counter(t[i:i + 6] for own in texts for t in own for i in range(len(t) - 5))
    for own, flags in zip(texts, found):
        for t, f in zip(own, flags):
            assert f[:max(0, len(t) - 5)].tolist() == [seen[t[i:i + 6]] > 1
                                                       for i in range(len(t) - 5)]


@pytest.mark.parametrize("kw", [{}, {"group_bytes": 3000}, {"group_bytes": 3000, "hot_segments": 2}])
def test_bytes_against_brute_force(spark, kw):
    rng = random.Random(11)
    shared = [bytes(rng.choices(b"abcdefgh ", k=n)).decode() for n in (39, 40, 55, 130)]
    texts = []
    for i in range(60):
        parts = [bytes(rng.choices(b"abcdefgh ", k=rng.randrange(0, 120))).decode()
                 for _ in range(3)]
        texts.append((shared[i % 4].join(parts) + "é" * (i % 3))[:rng.randrange(1, 500)])
    texts += [texts[0], texts[1], texts[1], "ab" * 100, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got_bytes(df, length=LENGTH, anchor=12, **kw) == brute_bytes(
        [t.encode() for t in texts], LENGTH)


def test_bytes_of_odd_rows(odd, empty):
    texts = [(r.text or "").encode() for r in odd.collect()]
    assert got_bytes(odd, group_bytes=20_000) == brute_bytes(texts, bwt.LENGTH)
    clash = odd.withColumn("kept", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    out = bwt.remove_repeats(clash)
    assert out.columns[-4:] == list(bwt.RESULT) and out.count() == len(texts)
    assert bwt.repeat_report(empty).collect() == []


@pytest.mark.parametrize("group_bytes", [3 << 20, 4000])
def test_words_of_odd_rows(odd, empty, group_bytes):
    texts = [r.text for r in odd.collect()]
    assert got_words(odd, group_bytes=group_bytes) == brute_words(texts, passages.WINDOW)
    assert passages.repeat_report(empty).collect() == []


def test_words_keep_clean_texts_and_columns(odd):
    clash = odd.withColumn("n_words", F.lit("x"))
    out = passages.without_repeats(clash)
    assert out.columns == clash.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    given = {r.doc_id: r.text for r in odd.collect()}
    assert all(kept[i] == given[i] for i in (1, 2, 3, 4, 10, 11, 12, 13, 15))
    assert kept[8] == kept[7] == ""  # copies of one text lose all of it
    with pytest.raises(ValueError):
        passages.remove_repeats(odd, window=20)
