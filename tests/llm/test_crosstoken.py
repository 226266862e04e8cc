"""Cross-tokenizer alignment against plain loops over the libraries' tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import crosstoken, wordwise

from .conftest import DOCS, odd_rows
from .test_packing import ODD


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(wordwise.public_path(wordwise.BYTE_BPE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=wordwise.public_path(wordwise.PIECE_BPE))


def tokens(libraries, text):
    """(ids, bytes) of both libraries, or none."""
    one, two = libraries
    if not text:
        return None
    byte = wordwise.byte_alphabet()
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    raw_a = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
    raw_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i)
             else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == (" " + text).encode() == b"".join(raw_b):
        return None
    return a, raw_a, b, raw_b


def groups(a, raw_a, b, raw_b):
    ends_a, ends_b = np.cumsum([len(r) for r in raw_a]), np.cumsum([len(r) for r in raw_b])
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = int((ends_a <= end).sum()), int((ends_b <= end).sum())
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def brute(libraries, rows):
    corpus, each = Counter(), []
    for doc_id, text in rows:
        found = tokens(libraries, text)
        own = groups(*found) if found else []
        links = Counter((p, q) for x, y in own for p in x for q in y)
        corpus.update(set(links))
        each.append((doc_id, found, own, links))
    top = defaultdict(int)
    for (p, _), n in corpus.items():
        top[p] = max(top[p], n)
    out = []
    for doc_id, found, own, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        out.append((doc_id, len(found[0]) if found else 0, len(found[2]) if found else 0, len(own),
                    sum(links.values()), sum(n for k, n in links.items() if corpus[k] == top[k[0]]),
                    sum(n * corpus[k] for k, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return Counter(out)


def test_whole_table(spark, small, libraries):
    got = crosstoken.alignment_report(small)
    assert Counter(map(tuple, got.collect())) == brute(libraries, [(r.doc_id, r.text) for r in small.collect()])


def test_odd_rows(spark, libraries, monkeypatch):
    rows = [r[:2] for r in odd_rows()] + list(enumerate([*ODD, "▁", "a▁b", "▁▁ x", "x▁"], 100))
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS).repartition(3)
    got = crosstoken.alignment_report(docs).collect()
    assert Counter(map(tuple, got)) == brute(libraries, rows)


def test_overlaps_are_the_shared_bytes(spark, libraries):
    texts = [t for t in ODD if len(t) < 500] + ["straße überall", "1234567 tokenization"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    for r in crosstoken.alignments(docs).collect():
        found = tokens(libraries, r.text)
        if not found:
            assert not r.a_ids and not r.b_ids and not r.groups and not r.overlaps
            continue
        a, raw_a, b, raw_b = found
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [(g.a, g.b) for g in r.groups] == [(len(x), len(y)) for x, y in groups(*found)]
        owner_a = [i for i, x in enumerate(raw_a) for _ in x]
        owner_b = [i for i, x in enumerate(raw_b) for _ in x]
        assert Counter({(o.a, o.b): o.bytes for o in r.overlaps}) == Counter(zip(owner_a, owner_b))


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_gustavson_product_equals_dense_product(cells):
    rng = np.random.default_rng(3)
    for _ in range(20):
        dense = [rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in ((9, 13), (13, 6))]
        one, two = (crosstoken.Csr(np.concatenate([[0], np.cumsum((d != 0).sum(1))]), np.nonzero(d)[1],
                                   d[d != 0].astype(np.int64), d.shape[1]) for d in dense)
        product, out = one.times(two, cells), np.zeros((9, 6), np.int64)
        row = np.repeat(np.arange(9), np.diff(product.indptr))
        out[row, product.indices] = product.data
        assert (out == dense[0] @ dense[1]).all() and len(product.data) == (out != 0).sum()
        back = two.transpose()
        out = np.zeros((6, 13), np.int64)
        out[np.repeat(np.arange(6), np.diff(back.indptr)), back.indices] = back.data
        assert (out == dense[1].T).all()


def test_empty_table_and_other_columns(spark, empty, odd):
    assert crosstoken.alignment_report(empty).collect() == []
    wide = odd.select("*", *(F.lit(1).alias(c) for c in ("grp", "pairs", "n", "a.b", "overlaps")))
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(crosstoken.alignment_report(wide)) == rows(crosstoken.alignment_report(odd))
    assert len(crosstoken.alignments(wide).columns) == len(wide.columns) + 3


def test_hot_text(spark, libraries):
    """A third of the table is one row."""
    rows = [(7, "the same text again, tokenised")] * 200 + [(i, f"text number {i} the") for i in range(400)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    assert Counter(map(tuple, crosstoken.alignment_report(docs).collect())) == brute(libraries, rows)
