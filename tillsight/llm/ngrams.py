"""LM scoring with an Elias-Fano n-gram trie.

The model is a bigram model over lower-cased (A-Z) words, with an end token that also
stands before the first word. With c the training counts, N and V their sum and number,

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | v)   = (c(v, w) + MU p(w)) / (c(v) + MU)

Documents are dealt to groups (``common``). A group sends its distinct words with their
training counts to word buckets and gets total counts and dense word ids. It then sends
its distinct bigrams to the bucket of their context. The bucket builds its shard of the
trie from the counts of all groups and looks up every group's bigrams in it. The trie's
two levels are one buffer, read through views on it as a mapped file would be:

- level 1: the contexts' ids, Elias-Fano coded; the pointers to their children, a
  monotone sequence, likewise;
- level 2: the children's ids, made monotone by adding up the ranges of the contexts
  before (so they are coded relative to their context), Elias-Fano coded, and 16-bit
  quantised log10 probabilities.

A bigram is found by a successor search for the context, then for the child within the
context's range. Bigrams that are not in the trie back off to MU p(w) / (c(v) + MU).
The tables gathered from the corpus grow with it; nothing is broadcast. A context with
more than ``hot_context`` occurrences is split over several buckets by its children.

Edge cases: a null or empty text, or one of white space, is the end token alone; with no
training rows all counts are 0 and the base score is 0; rows of null doc_id are trained
on; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import (
    BLOCK_SCHEMA, U64, WordIds, blocks, bucket_of, exchange, held_out, in_groups, in_order, mix,
    text_bytes, texts_of)

MU = 100.0
GROUP_BYTES, BYTES_PER_BUCKET = 6 << 20, 13 << 20
HOT_CONTEXT = 1_000_000
#: Steps of the 16-bit scale of -log10 p.
QUANTUM = 1 / 4096
RESULT = {"n_tokens": "long", "n_known": "long", "train_tokens": "long",
          "base_score": "double", "score": "double"}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def quantise(log10_p: np.ndarray) -> np.ndarray:
    """16-bit codes from 1; 0 is free for 'not found'."""
    return np.clip(np.round(-log10_p / QUANTUM) + 1, 1, 65535).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.float64) - 1) * -QUANTUM


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, each with its length."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
        body = zstandard.compress(planes.tobytes(), 1)
        out += [len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def expand(body: bytes, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n, size = (int.from_bytes(body[at + i:at + i + 8], "little") for i in (0, 8))
        raw = zstandard.decompress(body[at + 16:at + 16 + size])
        planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(t).itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += 16 + size
    return out


class EliasFano:
    """A monotone sequence: low bits in full, high bits in unary."""

    def __init__(self, buffer: memoryview, at: int):
        n, low, n_low, n_high = np.frombuffer(buffer, np.int64, 4, at).tolist()
        self.n, self.low_bits = n, low
        self.low = np.frombuffer(buffer, np.uint8, n_low, at + 32).view(U64)
        self.mask = U64((1 << low) - 1)
        self.high = np.frombuffer(buffer, np.uint8, n_high, at + 32 + n_low)
        self.end = at + 32 + n_low + n_high
        bits = np.unpackbits(self.high)
        self.places = np.flatnonzero(bits)[:n]  # select1
        self.zeros = np.flatnonzero(bits == 0)  # select0: where each high part ends

    @staticmethod
    def code(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> low).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        part = values.astype(U64) & U64((1 << low) - 1)
        bit = np.arange(n, dtype=np.int64) * low
        word, shift = bit >> 6, (bit & 63).astype(U64)
        words = np.zeros((n * low >> 6) + 2, U64)  # one word more, so that any two can be read
        np.bitwise_or.at(words, word, part << shift)
        over = np.flatnonzero((bit & 63) + low > 64)
        np.bitwise_or.at(words, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        low_body, high_body = words.tobytes(), np.packbits(bits).tobytes()
        head = np.array([n, low, len(low_body), len(high_body)], np.int64)
        return head.tobytes() + low_body + high_body

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        high = self.places[i] - i
        if not self.low_bits:
            return high
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(U64)
        # the next word's part; two shifts, since a shift by 64 is undefined
        low = self.low[word] >> shift | self.low[word + 1] << U64(1) << (U64(63) - shift)
        return high << self.low_bits | (low & self.mask).astype(np.int64)

    def successor(self, value: np.ndarray, first: np.ndarray | None = None,
                  last: np.ndarray | None = None) -> np.ndarray:
        """The first place (in [first, last)) whose value is at least ``value``."""
        part = value >> self.low_bits
        inside = part < len(self.zeros)
        part_in = np.minimum(part, len(self.zeros) - 1)
        lo = np.where(part_in > 0, self.zeros[np.maximum(part_in - 1, 0)] - part_in + 1, 0)
        hi = self.zeros[part_in] - part_in
        lo, hi = np.where(inside, np.minimum(lo, self.n), self.n), \
            np.where(inside, np.minimum(hi, self.n), self.n)
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.get(mid) < value[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]


class Trie:
    """A shard: two levels in one buffer."""

    @staticmethod
    def build(context: np.ndarray, child: np.ndarray, log10_p: np.ndarray) -> bytes:
        """From bigrams sorted by context and child."""
        heads = np.flatnonzero(np.diff(context, prepend=-1))
        pointers = np.append(heads, len(context))
        spans = child[pointers[1:] - 1] + 1 if len(heads) else np.empty(0, np.int64)
        base = np.cumsum(spans) - spans
        level2 = child + np.repeat(base, np.diff(pointers))
        return b"".join([EliasFano.code(context[heads]), EliasFano.code(pointers),
                         EliasFano.code(np.append(base, spans.sum())), EliasFano.code(level2),
                         quantise(log10_p).tobytes()])

    def __init__(self, buffer: bytes):
        self.contexts = EliasFano(buffer, 0)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.base = EliasFano(buffer, self.pointers.end)
        self.children = EliasFano(buffer, self.base.end)
        self.codes = np.frombuffer(buffer, np.uint8, 2 * self.children.n, self.children.end)
        self.codes = self.codes.view(np.uint16)

    def find(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Code of each bigram, 0 if the trie does not hold it."""
        out = np.zeros(len(context), np.uint16)
        if not self.contexts.n:
            return out
        at = self.contexts.successor(context)
        at_in = np.minimum(at, self.contexts.n - 1)
        known = np.flatnonzero((at < self.contexts.n) & (self.contexts.get(at_in) == context))
        at, child = at[known], child[known]
        first, last = self.pointers.get(at), self.pointers.get(at + 1)
        base = self.base.get(at)
        # a child beyond the context's range must not reach into the next context's
        fits = child < self.base.get(at + 1) - base
        known, first, last, target = known[fits], first[fits], last[fits], (base + child)[fits]
        place = self.children.successor(target, first, last)
        hit = place < last
        hit[hit] = self.children.get(place[hit]) == target[hit]
        out[known[hit]] = self.codes[place[hit]]
        return out


class Tokens:
    """The tokens of a group's documents; the empty word is the end token."""

    def __init__(self, docs: pa.Table, parts: int):
        ids = WordIds()
        self.end = int(ids.add([b""])[0])
        each = [ids.add([*t.translate(_LOWER).split(), b""]) for t in texts_of(docs.column("text"))]
        self.sizes = np.array([len(e) for e in each], np.int64)
        self.word = np.concatenate(each) if each else np.empty(0, np.int64)
        self.train = ~np.array(docs.column("held_out").to_pylist(), bool)
        self.trained = np.repeat(self.train, self.sizes)
        h = ids.hashes()
        self.hash = h
        self.count = np.bincount(self.word[self.trained], minlength=len(h))
        part = bucket_of(h, parts)
        order = np.lexsort((h, part))
        self.part, self.parts = part, parts
        self.dealt = np.split(order, np.searchsorted(part[order], np.arange(1, parts)))

    def learn(self, answers: dict[int, bytes]) -> None:
        """Total counts, ids, N and V from the answers of the word buckets."""
        self.total = np.zeros(len(self.hash), np.int64)
        self.id = np.zeros(len(self.hash), np.int64)
        self.n = self.v = 0
        for p, own in enumerate(self.dealt):
            sums, total, rank = expand(answers[p], np.int64, np.int64, np.int64)
            self.n += int(sums[0])
            self.v += int(sums[1])
            self.total[own] = total
            self.id[own] = rank * self.parts + p
        self.log_p = np.log10((self.total + 1) / (self.n + self.v + 1))

    def bigrams(self, hot_context: int):
        """Distinct bigrams (local words), each token's bigram, and their dealing."""
        context = np.roll(self.word, 1)
        context[np.cumsum(self.sizes) - self.sizes] = self.end
        n = len(self.hash)
        keys, index = np.unique(context * n + self.word, return_inverse=True)
        context, child = keys // n, keys % n
        count = np.bincount(index[self.trained], minlength=len(keys))
        slices = 1 + self.total[context] // hot_context
        piece = (self.hash[child] >> U64(20)).astype(np.int64) % slices
        part = bucket_of(mix(self.hash[context] + piece.astype(U64) * U64(0x9E3779B97F4A7C15)),
                         self.parts)
        order = np.lexsort((self.id[child], self.id[context], part))
        dealt = np.split(order, np.searchsorted(part[order], np.arange(1, self.parts)))
        return context, child, count, index, dealt


def score_texts(docs: DataFrame, held, mu: float = MU, group_bytes: int = GROUP_BYTES,
                hot_context: int = HOT_CONTEXT,
                bucket_bytes: int = BYTES_PER_BUCKET) -> DataFrame:
    """doc_id, held_out and scores of every document; rows where ``held`` is true are
    not trained on."""
    size = text_bytes(docs)
    parts = max(1, size // bucket_bytes)
    grouped = in_groups(docs.select("doc_id", "text", held.alias("held_out")), size, group_bytes)
    groups = grouped.groupBy("grp")

    def bodies(answers: pa.Table, low: int, high: int) -> dict[int, bytes]:
        return {p - low: b for p, b in zip(answers.column("part").to_pylist(),
                                           answers.column("body").to_pylist())
                if low <= p < high}

    def word_blocks(key, table):
        t = Tokens(in_order(table), parts)
        return blocks([(key[0].as_py(), p, squeeze(t.hash[own], t.count[own]))
                       for p, own in enumerate(t.dealt)])

    def word_totals(table):
        grp, part = table.column("grp").to_pylist(), table.column("part").to_pylist()
        got = [expand(b, U64, np.int64) for b in table.column("body").to_pylist()]
        h, index = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
        total = np.bincount(index, weights=np.concatenate([x[1] for x in got]),
                            minlength=len(h)).astype(np.int64)
        sums = np.array([total.sum(), (total > 0).sum()], np.int64)
        out, at = [], 0
        for g, p, x in zip(grp, part, got):
            own = index[at:at + len(x[0])]
            at += len(own)
            out.append((g, p, squeeze(sums, total[own], own.astype(np.int64))))
        return blocks(out)

    def bigram_blocks(key, table, answers):
        t = Tokens(in_order(table), parts)
        t.learn(bodies(answers, 0, parts))
        context, child, count, _, dealt = t.bigrams(hot_context)
        rows = []
        for p, own in enumerate(dealt):
            if not len(own):
                continue
            v, w = t.id[context[own]], t.id[child[own]]
            heads = np.flatnonzero(np.diff(v, prepend=-1))
            step = np.diff(w, prepend=0)
            step[heads] = w[heads]
            rows.append((key[0].as_py(), parts + p, squeeze(
                np.diff(v[heads], prepend=0), np.diff(np.append(heads, len(own))),
                t.total[context[own[heads]]], step, count[own], quantise(t.log_p[child[own]]))))
        return blocks(rows)

    def bigram_codes(table):
        grp, part = table.column("grp").to_pylist(), table.column("part").to_pylist()
        v, w, n, uni, before, sizes = [], [], [], [], [], []
        for b in table.column("body").to_pylist():
            heads, many, total, step, count, code = expand(
                b, np.int64, np.int64, np.int64, np.int64, np.int64, np.uint16)
            run = np.cumsum(step)
            first = np.cumsum(many) - many
            run -= np.repeat(run[first] - step[first], many)
            v.append(np.repeat(np.cumsum(heads), many))
            before.append(np.repeat(total, many))
            w.append(run)
            n.append(count)
            uni.append(code)
            sizes.append(len(run))
        v, w, n, uni, before = (np.concatenate(x) for x in (v, w, n, uni, before))
        seen = np.flatnonzero(n)
        order = seen[np.lexsort((w[seen], v[seen]))]
        head = np.flatnonzero((np.diff(v[order], prepend=-1) != 0)
                              | (np.diff(w[order], prepend=-1) != 0))
        total = np.add.reduceat(n[order], head) if len(head) else np.empty(0)
        own = order[head]
        p = (total + mu * 10 ** dequantise(uni[own])) / (before[own] + mu)
        trie = Trie(Trie.build(v[own], w[own], np.log10(p)))
        codes = trie.find(v, w)
        ends = np.cumsum(sizes)
        return blocks([(g, p, squeeze(codes[e - s:e]))
                       for g, p, s, e in zip(grp, part, sizes, ends)])

    def scores(key, table, answers):
        table = in_order(table)
        t = Tokens(table, parts)
        t.learn(bodies(answers, 0, parts))
        context, child, _, index, dealt = t.bigrams(hot_context)
        code = np.zeros(len(context), np.uint16)
        found = bodies(answers, parts, 2 * parts)
        for p, own in enumerate(dealt):
            if len(own):
                code[own] = expand(found[p], np.uint16)[0]
        before = t.total[context]
        value = np.where(code > 0, dequantise(code),
                         t.log_p[child] + np.log10(mu / (before + mu)))
        starts = np.cumsum(t.sizes) - t.sizes
        known = np.add.reduceat((t.total[t.word] > 0).astype(np.int64), starts)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"),
            "n_tokens": pa.array(t.sizes), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(starts), t.n), pa.int64()),
            "base_score": pa.array(np.add.reduceat(t.log_p[t.word], starts)),
            "score": pa.array(np.add.reduceat(value[index], starts))})

    words = exchange(groups.applyInArrow(word_blocks, BLOCK_SCHEMA), word_totals)
    codes = exchange(groups.cogroup(words.groupBy("grp"))
                     .applyInArrow(bigram_blocks, BLOCK_SCHEMA), bigram_codes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return groups.cogroup(words.unionByName(codes).groupBy("grp")).applyInArrow(
        scores, ", ".join([f"doc_id {kind}, held_out boolean",
                           *(f"{c} {t}" for c, t in RESULT.items())]))


def scoring_report(docs: DataFrame) -> DataFrame:
    """Learn from the rows with crc32(doc_id) mod 7 other than 2; score all."""
    return score_texts(docs, held_out("doc_id", 7, 2))
