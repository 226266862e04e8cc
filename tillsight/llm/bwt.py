"""Suffix-array dedup on bytes: shard Burrows-Wheeler transforms, merged by
iterative interleave refinement.

A byte is removed if a 200-byte string that covers it also starts anywhere else.

1. *Segments.* Every 200-byte window has one anchor, the position whose 64-byte
   hash is the least in it. The windows of one anchor form a segment; each window
   lies in exactly one segment, and equal windows have equal anchors. Groups of
   documents send (anchor hash, segment hash) to key buckets. A segment with an
   anchor found nowhere else holds no repeat. Segments that are equal as a whole
   are repeats as a whole. What is left are anchors with *different* segments.
2. *Shard transforms.* Of these, each group builds one multi-string
   Burrows-Wheeler transform per bucket; one copy of equal segments is enough.
   The transform is what travels: it holds text and suffix order in a byte each.
3. *Merge.* A bucket inverts the transforms by their last-to-first mapping, which
   yields text and sorted suffixes of every shard. The interleave of the shards is
   refined in passes: from the order by the first h bytes, the order by 2h bytes
   follows by merging the shards' own (sorted) sequences of pairs (class at i,
   class at i + h). Suffixes are never sorted again. Where the class changes, the
   common prefix ends; classes at 200 bytes with two or more suffixes are the
   repeated intervals.

An anchor with more different segments than ``hot_segments`` would make a large
interval; its windows are hashed one by one and compared at the buckets of those
hashes, where a key arrives once per group. Hash equality stands for equality of
whole segments and hot windows (64 bits, besides the anchor's).

Edge cases: a null text is empty; texts below 200 bytes stay whole; repeated rows
are documents of their own; matches never cross documents; an empty table gives no
rows; extra columns pass through, those named ``grp`` or like a result column are replaced.
The kept bytes are a binary column, since a cut may fall inside a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import (
    BLOCK_SCHEMA, GROUP_BYTES, U64, among, answered, blocks, bucket_of, by_part, exchange,
    in_groups, in_order, local_counts, mix, quoted, repeated_keys, text_bytes, texts_of, unpack,
    with_results)

LENGTH, ANCHOR = 200, 64
#: Segments that one bucket gets on average, at 69 bytes of text a segment.
BUCKET_SEGMENTS, BYTES_PER_SEGMENT = 300_000, 69
#: Different segments of one anchor beyond which its windows are compared by hash.
HOT_SEGMENTS = 4_000
#: Bytes of segments that are merged at once.
MERGE_BYTES = 2 << 20
RESULT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_PLACE = U64((1 << 28) - 1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept per Python worker."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Segments:
    """The windows of a group's documents, dealt to anchors."""

    def __init__(self, docs: pa.Table, length: int, anchor: int):
        texts = texts_of(docs.column("text"))
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.text)
        self.lo = self.hi = np.empty(0, np.int64)
        self.anchor = self.key = np.empty(0, U64)
        power, self.inverse = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, U64)
        if n < length:
            return
        np.cumsum((self.text.astype(U64) + U64(1)) * power[:n], out=self.sums[1:])
        h = mix((self.sums[anchor:] - self.sums[:-anchor]) * self.inverse[:n - anchor + 1])
        least = (h & ~_PLACE) | np.arange(len(h), dtype=U64)
        span, size = length - anchor + 1, 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if span > size:
            least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
        at = (least & _PLACE).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), self.sizes)[:len(at)]
        valid = np.arange(len(at)) + length <= self.starts[doc + 1]
        change = np.empty(len(at), bool)
        change[0] = True
        change[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
        self.lo = np.flatnonzero(valid & change)
        stop = np.flatnonzero(change | ~valid)
        nxt = np.searchsorted(stop, self.lo, side="right")
        self.hi = np.append(stop, len(at))[nxt]
        self.anchor = h[at[self.lo]]
        end = self.hi + length - 1
        self.key = mix((self.sums[end] - self.sums[self.lo]) * self.inverse[self.lo]
                       + (end - self.lo).astype(U64) * U64(0xD1342543DE82EF95) + self.anchor)

    def distinct(self):
        """Index of the first segment of each key, the key index of every segment, counts."""
        _, first, index, counts = np.unique(self.key, return_index=True, return_inverse=True,
                                            return_counts=True)
        return first, index, counts

    def window_hash(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of the segments ``i``."""
        n = self.hi[i] - self.lo[i]
        at = np.repeat(self.lo[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        at += np.arange(len(at))
        h = (self.sums[at + self.length] - self.sums[at]) * self.inverse[at]
        return at, mix(mix(h) + U64(0x5851F42D4C957F2D))


def transform(texts: list[bytes]) -> bytes:
    """Burrows-Wheeler transform of several strings, ended by terminators that sort
    below all bytes and by string. UTF-8 has no byte 255, so bytes are raised by one
    and 0 is free for the terminators."""
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    n = len(joined)
    string = np.cumsum(joined == 0) - (joined == 0)
    ends = np.flatnonzero(joined == 0)
    left = ends[string] - np.arange(n)
    key, padded = np.zeros(n, np.int64), np.concatenate([joined, np.zeros(5, np.uint8)])
    for i in range(5):
        key = key << 8 | np.where(left >= i, padded[i:n + i], 0)
    key = key << 22 | np.where(left < 5, string + 1, 0)
    h = 5
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
        if step[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = step
        key = rank * (n + 1)
        key[:-h] += rank[h:] + 1
        h *= 2
    return joined[order - 1].tobytes()  # the row of the first string's start wraps to a 0


def invert(bwt: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text (raised bytes, 0 behind each string) and sorted suffixes of a transform."""
    ends = np.cumsum(sizes + 1) - 1
    first = np.argsort(bwt, kind="stable")  # of 8-bit values: by counting
    last_to_first = np.empty(len(bwt), np.int64)
    last_to_first[first] = np.arange(len(bwt))
    text, suffixes = np.zeros(len(bwt), np.uint8), np.empty(len(bwt), np.int64)
    row, at = np.arange(len(sizes)), ends.copy()
    while len(row):
        suffixes[row] = at
        symbol = bwt[row]
        go = symbol != 0
        row, at = row[go], at[go] - 1
        text[at] = symbol[go]
        row = last_to_first[row]
    return text, suffixes


def merge(text: np.ndarray, runs: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' sorted suffixes by their first ``length`` bytes, and for
    each suffix in that order whether it begins a new class."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.int64)
    h = min(7, length)
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = key << 8 | padded[i:n + i]
    shards = np.concatenate(runs)  # sorted runs, one after the other
    while True:
        pairs = key[shards]
        interleave = np.argsort(pairs, kind="stable")  # merges the runs
        pairs = pairs[interleave]
        fresh = np.empty(len(pairs), bool)
        fresh[0] = True
        np.not_equal(pairs[1:], pairs[:-1], out=fresh[1:])
        if h == length:
            return shards[interleave], fresh
        by_class = np.zeros(n + 1, np.int64)
        by_class[shards[interleave]] = np.cumsum(fresh)
        step = min(h, length - h)
        key = by_class[:-1] * (n + 1)
        key[:n - step] += by_class[step:-1]
        h += step


def repeats_of(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]],
               length: int) -> list[list[np.ndarray]]:
    """Of shards (text, sorted suffixes, sizes, counts of each string): for each string
    of each shard, whether the window from each of its places is repeated."""
    offset, texts, runs, weight = 0, [], [], []
    for text, suffixes, sizes, counts in shards:
        texts.append(text)
        runs.append(suffixes + offset)
        left = np.concatenate([np.arange(s, -1, -1) for s in sizes])
        weight.append(np.where(left >= length, np.repeat(counts, sizes + 1), 0))
        offset += len(text)
    weight = np.concatenate(weight)
    order, fresh = merge(np.concatenate(texts), runs, length)
    group = np.cumsum(fresh) - 1
    total = np.bincount(group, weights=weight[order])
    again = np.zeros(len(weight), bool)
    again[order] = (total > 1)[group]
    again &= weight > 0
    out, at = [], 0
    for _, _, sizes, _ in shards:
        own = []
        for s in sizes:
            own.append(again[at:at + s - length + 1])
            at += s + 1
        out.append(own)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR,
                   group_bytes: int = GROUP_BYTES,
                   hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Documents with n_bytes, n_removed, n_spans (maximal removed runs) and kept."""
    size = text_bytes(docs)
    parts = max(1, size // (BUCKET_SEGMENTS * BYTES_PER_SEGMENT))
    columns = [c for c in docs.columns if c not in RESULT and c != "grp"]
    docs = docs.select(*map(quoted, columns))
    grouped = in_groups(docs, size, group_bytes)
    # buckets of one exchange: below ``parts`` by anchor, beyond it by another key
    alone, same_first, same = 0, 3, 1  # of a segment, against the other groups

    def summary_blocks(key, table):
        seg, grp = Segments(in_order(table), length, anchor), key[0].as_py()
        first, _, _ = seg.distinct()
        a, k = seg.anchor[first], seg.key[first]
        anchors, at, n = np.unique(a, return_index=True, return_counts=True)
        return blocks(by_part(grp, bucket_of(anchors, parts), anchors, k[at],
                              n.astype(np.int32))
                      + by_part(grp, parts + bucket_of(k, parts), k))

    def summaries(table):
        grp, part = table.column("grp").to_pylist(), table.column("part").to_pylist()
        body, out = table.column("body").to_pylist(), []
        if part[0] >= parts:  # segments that other groups have too
            keys = [unpack(b, U64)[0] for b in body]
            values, index, counts = local_counts(np.concatenate(keys))
            owner = np.repeat(np.array(grp), [len(k) for k in keys])
            first = np.full(len(values), 1 << 30)
            np.minimum.at(first, index, owner)
            for g, p, k in zip(grp, part, keys):
                at = np.searchsorted(values, k)
                code = np.where(first[at] == g, same_first, same).astype(np.uint8)
                k, code = k[counts[at] > 1], code[counts[at] > 1]
                out.append((g, p, len(k).to_bytes(8, "little") + k.tobytes() + code.tobytes()))
        else:  # anchors with different segments: 1, with very many: 2
            got = [unpack(b, U64, U64, np.int32) for b in body]
            values, index, _ = local_counts(np.concatenate([x[0] for x in got]))
            one, n = (np.concatenate([x[i] for x in got]) for i in (1, 2))
            total = np.bincount(index, weights=n)
            some = np.empty(len(values), U64)
            some[index] = one
            mixed = np.zeros(len(values), bool)
            mixed[index[(n > 1) | (one != some[index])]] = True
            code = np.where(total > hot_segments, 2, 1).astype(np.uint8)
            for g, p, (a, _, _) in zip(grp, part, got):
                at = np.searchsorted(values, a)
                at = at[mixed[at]]
                out.append((g, p, len(at).to_bytes(8, "little") + values[at].tobytes()
                            + code[at].tobytes()))
        return blocks([x for x in out if len(x[2]) > 8])

    def judged(seg: Segments, answers: pa.Table):
        """Segments that are repeated as a whole; per distinct one, whether it must be
        compared further and how (1 merged, 2 by window hashes)."""
        part = np.array(answers.column("part").to_pylist(), np.int64)
        k, k_code = answered(answers.filter(pa.array((part >= parts) & (part < 2 * parts))),
                             U64, np.uint8)
        a, a_code = answered(answers.filter(pa.array(part < parts)), U64, np.uint8)
        first, index, counts = seg.distinct()
        order = np.argsort(k)
        k, k_code = k[order], k_code[order]
        seen = np.zeros(len(first), np.uint8)
        hit = among(seg.key[first], k)
        seen[hit] = k_code[np.searchsorted(k, seg.key[first][hit])]
        whole = (seen > 0) | (counts > 1)
        order = np.argsort(a)
        a, a_code = a[order], a_code[order]
        further = np.zeros(len(first), np.uint8)
        hit = among(seg.anchor[first], a) & (seen != same)
        further[hit] = a_code[np.searchsorted(a, seg.anchor[first][hit])]
        return first, index, whole, further

    def transform_blocks(key, table, answers):
        if not table.num_rows:
            return blocks([])
        grp, seg = key[0].as_py(), Segments(in_order(table), length, anchor)
        first, _, whole, further = judged(seg, answers)
        rows = []
        own, many = first[further == 1], whole[further == 1]
        part = bucket_of(seg.anchor[own], parts)
        raw = seg.text.tobytes()
        for p in np.unique(part):
            i, weight = own[part == p], many[part == p]
            ends = seg.hi[i] + length - 1
            bwt = transform([raw[a:b] for a, b in zip(seg.lo[i], ends)])
            rows.append((grp, int(p), len(i).to_bytes(8, "little") + seg.key[i].tobytes()
                         + seg.anchor[i].tobytes() + (ends - seg.lo[i]).tobytes()
                         + (weight + 1).astype(np.int8).tobytes() + bwt))
        _, h = seg.window_hash(first[further == 2])
        h = np.unique(h)
        return blocks(rows + by_part(grp, 2 * parts + bucket_of(h, parts), h))

    def merged(table):
        part = table.column("part").to_pylist()[0]
        if part >= parts:
            return repeated_keys(table)
        shards, n_text = [], 0
        for g, body in zip(table.column("grp").to_pylist(), table.column("body").to_pylist()):
            keys, anchors, sizes, counts = unpack(body, U64, U64, np.int64, np.int8)
            bwt = np.frombuffer(body, np.uint8, offset=8 + 25 * len(keys))
            text, suffixes = invert(bwt, sizes)
            shards.append((g, keys, anchors, sizes, counts, text, suffixes))
            n_text += len(text)
        lots, answers = max(1, -(-n_text // MERGE_BYTES)), []
        for lot in range(lots):  # all segments of an anchor are in the same lot
            some, known = [], []
            for g, keys, anchors, sizes, counts, text, suffixes in shards:
                mine = (anchors >> U64(8)).astype(np.int64) % lots == lot
                if not mine.any():
                    continue
                held = np.repeat(mine, sizes + 1)
                place = np.cumsum(held) - 1
                kept = suffixes[held[suffixes]]  # still sorted
                some.append((text[held], place[kept], sizes[mine], counts[mine]))
                known.append((g, keys[mine], counts[mine]))
            if not some:
                continue
            for (g, keys, counts), found in zip(known, repeats_of(some, length)):
                use = [i for i in np.flatnonzero(counts == 1) if found[i].any()]
                if use:
                    n = np.array([len(found[i]) for i in use], np.int64)
                    bits = np.concatenate([found[i] for i in use]).astype(np.uint8)
                    answers.append((g, part, len(use).to_bytes(8, "little")
                                    + keys[use].tobytes() + n.tobytes()
                                    + np.packbits(bits).tobytes()))
        return blocks([(g, 3 * parts + part, b) for g, part, b in answers])

    def removed(key, table, answers):
        table = in_order(table)
        seg = Segments(table, length, anchor)
        part = np.array(answers.column("part").to_pylist(), np.int64)
        first, index, whole, further = judged(seg, answers)
        depth = np.zeros(len(seg.text) + length + 1, np.int32)
        i = np.flatnonzero(whole[index]) if len(index) else np.empty(0, np.int64)
        np.add.at(depth, seg.lo[i], 1)
        np.subtract.at(depth, seg.hi[i] + length - 1, 1)
        starts = []
        if (further == 2).any():
            hot = answered(answers.filter(pa.array((part >= 2 * parts) & (part < 3 * parts))),
                           U64)[0]
            at, h = seg.window_hash(first[further == 2])
            _, which, n = local_counts(h)
            starts.append(at[(n > 1)[which] | among(h, np.sort(hot))])
        of = {int(k): j for j, k in enumerate(seg.key[first])}
        for body in answers.filter(pa.array(part >= 3 * parts)).column("body").to_pylist():
            keys, n = unpack(body, U64, np.int64)
            bits = np.unpackbits(np.frombuffer(body, np.uint8, offset=8 + 16 * len(keys)))
            stops = np.cumsum(n)
            for k, a, b in zip(keys, stops - n, stops):
                starts.append(seg.lo[first[of[int(k)]]] + np.flatnonzero(bits[a:b]))
        for s in starts:
            np.add.at(depth, s, 1)
            np.subtract.at(depth, s + length, 1)
        gone = np.cumsum(depth)[:len(seg.text)] > 0
        lost, spans, kept = [], [], []
        for a, b in zip(seg.starts, seg.starts[1:]):
            cut = gone[a:b]
            lost.append(int(cut.sum()))
            spans.append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
            kept.append(seg.text[a:b][~cut].tobytes())
        for name, value in zip(RESULT, (pa.array(seg.sizes), pa.array(lost, pa.int64()),
                                        pa.array(spans, pa.int64()),
                                        pa.array(kept, pa.binary()))):
            table = table.append_column(name, value)
        return table.drop_columns(["grp"])

    of_group = grouped.groupBy("grp")
    first = exchange(of_group.applyInArrow(summary_blocks, BLOCK_SCHEMA), summaries)
    second = exchange(of_group.cogroup(first.groupBy("grp"))
                      .applyInArrow(transform_blocks, BLOCK_SCHEMA), merged)
    schema = with_results(docs, columns, RESULT)
    return (of_group.cogroup(first.unionByName(second).groupBy("grp"))
            .applyInArrow(removed, schema))


def repeat_report(docs: DataFrame) -> DataFrame:
    """Digest columns per document."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
