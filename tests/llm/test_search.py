"""Ranked search by bit-sliced signatures."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tillsight.llm import bitslice
from tillsight.llm.common import table

from .conftest import DOCS, SMALL, words

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top=20):
    """Every document scored for every item, in whole numbers."""
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, w) for i, w in docs if w]
    n, length = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        found = []
        for i, w in docs:
            m, tf = 75 + 25 * len(w) * n // length, Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_scoring_every_document(spark, small):
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    want = brute([(r.doc_id, r.text) for r in small.collect()], items)
    assert rows(bitslice.search(small, table(spark, SMALL, "benchmark"))) == want


def test_odd_documents_and_items(spark, odd):
    items = [(1, "w1 w2 w3 W1 w1"), (2, None), (3, ""), (4, "!!"), (5, "nowhere at all"), (6, "shared7 shared9"),
             (6, "shared7 shared9"), (6, "Ünïcödé"), (None, "short text"), (7, "12"), (8, words(300, 3))]
    got = rows(bitslice.search(odd, spark.createDataFrame(items, ITEMS), top=5))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()], items, top=5)
    assert {r[0] for r in got} == {1, 6, 7, 8, None}


def test_ties_and_repeated_rows_beyond_the_top(spark):
    docs = [(i, "same words here", "en", "s", 1) for i in range(60)] + [(7, "same words here", "en", "s", 1)] * 30
    docs += [(100 + i, words(30, i), "en", "s", 1) for i in range(200)]
    items = [(1, "same"), (2, "w1 w2 w3 w4"), (3, "same w5")]
    got = rows(bitslice.search(spark.createDataFrame(docs, DOCS).repartition(5),
                               spark.createDataFrame(items, ITEMS)))
    assert got == brute([d[:2] for d in docs], items)


def test_several_passes_and_steps_agree(spark, small, monkeypatch):
    monkeypatch.setattr(bitslice, "STEP_BYTES", 300)
    items = table(spark, SMALL, "benchmark")
    index = bitslice.build_index(small, 100_000)
    assert index.count() > 3
    assert rows(bitslice.search(small, items, index=index, pass_bytes=4000)) == rows(bitslice.search(small, items))


def test_empty_tables(spark, small, empty):
    items = table(spark, SMALL, "benchmark")
    for docs, asked in ((empty, items), (small, items.limit(0)), (empty, items.limit(0))):
        out = bitslice.search(docs, asked)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and not out.collect()


def test_clashing_columns(spark, odd):
    from pyspark.sql import functions as F
    items = spark.createDataFrame([(1, "w1 w2")], ITEMS)
    wide = odd.select("*", *(F.lit(1).alias(c) for c in ("_key", "items", "score", "rank", "item", "a.b")))
    assert rows(bitslice.search(wide, items.withColumn("_item", F.lit(1)))) == rows(bitslice.search(odd, items))


@pytest.mark.parametrize("density", [0.25, 0.9])
def test_bounds_never_fall_below_scores(density, monkeypatch):
    """Whatever the signatures' errors; few rows make many."""
    monkeypatch.setattr(bitslice, "DENSITY", density)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 400)) % 500).encode() for _ in range(300)]
    row = bitslice._slice_index(np.arange(300), texts)
    counts = [Counter(bitslice.terms_of(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    hashes = {__import__("xxhash").xxh3_64_intdigest(t): n for t, n in df.items()}
    assert {h % (1 << 64): n for h, n in zip(row["hashes"], row["counts"])} == hashes
    items = [(i, bitslice.terms_of(texts[i])[:20]) for i in range(40)]
    q = bitslice.Query(items, (row["docs"], row["length"]), dict(zip(row["hashes"], row["counts"])))
    loose = 0
    for block in row["blocks"]:
        bound = q.bounds(block)
        for d, key in enumerate(np.frombuffer(block["keys"], np.int64)):
            for i in range(40):
                s = q.score(i, counts[key], sum(counts[key].values()))
                assert s <= bound[i, d]
                loose += s < bound[i, d]
    assert loose > 0
