"""Token ids by words, and best-fit packing."""

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillsight.llm import packing, wordwise

from .conftest import odd_rows, words
from .test_tokens import TEXTS

ODD = TEXTS + ["  two", "a  b", "tail ", " ", "\n x", "x \n y", "a  b", "a　 b 　c", "l’été  là ",
               "it's I'll we've", "\t \t", "a​ b", "²  ³ ½", "é ", "x  ", "foo <|endoftext|> bar", "日本 語",
               "１２ ３", "a\x1c b", "a\x85 b", "🙂 🙂", "word" * 3000, "</s> <s> <unk> [INST]", "﻿ x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(wordwise.public_path(wordwise.BYTE_BPE))


def whole(library, text):
    return library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("specials_are_text", [False, True])
@pytest.mark.parametrize("plain", [True, False])
def test_ids_equal_those_of_the_library(library, small, specials_are_text, plain):
    texts = ODD + [r.text or "" for r in small.collect()]
    library.encode_special_tokens = specials_are_text
    bpe = wordwise.ByteBpe(wordwise.public_path(wordwise.BYTE_BPE), specials_are_text, plain)
    assert bool(bpe.fast) == plain
    want = [whole(library, t) for t in texts]
    assert [x.tolist() for x in bpe.whole(texts)] == want
    if specials_are_text:   # by words, with the blank before a text
        cut = wordwise.Slice([t for t in texts if t])
        flat, numbers = bpe.encode(cut.names)
        parts = np.split(flat, np.cumsum(numbers)[:-1])
        assert [[int(i) for w in each for i in parts[w]] for each in cut.each] == [
            whole(library, " " + t) for t in texts if t]
    library.encode_special_tokens = False


def test_ids_equal_those_of_the_library_for_every_character(library):
    bpe = wordwise.ByteBpe(wordwise.public_path(wordwise.BYTE_BPE))
    assert bpe.fast
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(codes), 40_000):
        texts = ["a{0}b {0}{0} 1{0}2 {0}\n{0}'s".format(chr(c)) for c in codes[a:a + 40_000]]
        got = bpe.whole(texts)
        assert [x.tolist() for x in got] == [
            d.ids for d in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_pieces_by_words_equal_those_of_whole_texts(small):
    bpe = wordwise.PieceBpe(wordwise.public_path(wordwise.PIECE_BPE))
    texts = [t for t in ODD + [r.text or "" for r in small.collect()] if t and "▁" not in t]
    cut = wordwise.Slice(texts)
    flat, numbers = bpe.encode(cut.names)
    parts = np.split(flat, np.cumsum(numbers)[:-1])
    for text, each in zip(texts, cut.each):
        assert [int(i) for w in each for i in parts[w]] == bpe.model.encode(text), text


def check(library, rows, pieces, sequence):
    """Pieces against the library, places against the rules."""
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*whole(library, text or ""), 0], "<u4")
        first = (len(ids) - 1) % sequence + 1
        for n, a in enumerate([0, *range(first, len(ids), sequence)]):
            own = ids[a:a + sequence if a else first]
            want[doc_id, n, a, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    places = defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= sequence
    return len(places)


def best_fit_falling(sizes, sequence):
    gaps = []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        left = gaps.pop(i) - s if i < len(gaps) else sequence - s
        bisect.insort(gaps, left)
    return len(gaps)


def test_whole_table(spark, library, small):
    pieces = packing.packing_report(small).collect()
    n = check(library, [(r.doc_id, r.text) for r in small.collect()], pieces, 2048)
    assert n <= 1.01 * best_fit_falling([p.length for p in pieces], 2048) + 1


def test_odd_rows_and_sequences(spark, library, odd):
    packed = packing.pack(odd, sequence=64)
    pieces = packed.collect()
    check(library, [r[:2] for r in odd_rows()], pieces, 64)
    by_sequence = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for p in pieces:
        assert by_sequence[p.sequence_id].ids[p.offset:p.offset + p.length] == p.ids
    assert sum(len(r.ids) for r in by_sequence.values()) == sum(p.length for p in pieces)


def test_one_size_over_many_ranges(spark):
    """Hot sizes: thousands of equal pieces, a few rows a range, so that most matches cross ranges."""
    sizes = [300] * 900 + [700] * 500 + [1] * 700 + [1025] * 120 + [2047] * 20 + [2048] * 9
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "pid long, length long")
    placed = packing.place(pieces, range_rows=150, few=5).collect()
    assert sorted(r.pid for r in placed) == list(range(len(sizes)))
    used = defaultdict(list)
    for r in placed:
        used[r.sequence_id].append((r.offset, sizes[r.pid]))
    for own in used.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 2048
    assert len(used) <= 1.02 * best_fit_falling(sizes, 2048) + 1


def test_sweep_gives_each_piece_its_successor():
    gaps, sizes = [100, 90, 50, 50, 20], [60, 50, 45, 30, 10, 5]
    items = sorted([(-g, 0, i) for i, g in enumerate(gaps)] + [(-s, 1, i) for i, s in enumerate(sizes)])
    size = np.array([-x[0] for x in items])
    is_gap = np.array([x[1] == 0 for x in items])
    found = packing.Matches(packing.sweep(packing._runs(is_gap, size), single=True))
    piece = np.flatnonzero(~is_gap)
    has, gap, offset = found.pieces(piece)
    pairs = sorted((int(size[p]), int(size[g])) for p, g in zip(piece[has], gap[has]))
    assert pairs == [(10, 20), (30, 100), (45, 50), (50, 50), (60, 90)]  # 5 has no gap left
    assert (offset[has] == -size[gap[has]]).all()
    took, tokens = found.taken(np.flatnonzero(is_gap))
    assert took.all() and sorted(tokens) == [10, 30, 45, 50, 60]


def test_several_pieces_share_a_gap():
    size, is_gap = np.array([100, 30, 30, 30, 30, 30]), np.array([True] + [False] * 5)
    found = packing.Matches(packing.sweep(packing._runs(is_gap, size)))
    has, gap, offset = found.pieces(np.arange(1, 6))
    assert has.tolist() == [True] * 3 + [False] * 2 and offset[:3].tolist() == [-100, -70, -40]
    assert found.taken(np.array([0]))[1].tolist() == [90]


def test_last_pieces_by_plain_best_fit():
    placed = packing.best_fit([(1, 60), (2, 50), (3, 40), (4, 30), (5, 10), (6, 100)], [(35, 5), (8, 6)], 100, -7)
    assert placed == [(6, -7, 0), (1, -8, 0), (2, -9, 0), (3, -8, 60), (4, 5, 65), (5, -9, 50)]


def test_empty_table_and_other_columns(spark, empty, odd):
    assert packing.packing_report(empty).collect() == []
    from pyspark.sql import functions as F
    wide = odd.select("*", *(F.lit(1).alias(c) for c in ("pid", "ids", "size", "a.b")))
    key = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(packing.packing_report(wide).collect()) == key(packing.packing_report(odd).collect())


def test_hot_document(spark):
    rows = [(1, words(20, 1), "en", "s", 1)] * 300
    from .conftest import DOCS
    out = packing.packing_report(spark.createDataFrame(rows, DOCS)).collect()
    total = sum(r.length for r in out)
    assert len(out) == 300 and len({r.sequence_id for r in out}) <= -(-total // 2048) + 1
