"""Substring dedup on words by difference-cover anchors.

A window is 35 consecutive words of one document; a word is removed if a window
that covers it has the same words as a window that starts anywhere else. The
positions of a document are taken modulo 21; {0, 1, 4, 14, 16} is a difference
cover of 21, so for any two positions there is a shift below 21 that moves both
onto the cover. Hence two equal windows share an anchor: 15 words that start at a
cover position in both. Only anchors are hashed and compared first (5 of 21
positions). Where an anchor occurs again, the windows that contain it are extended
to their full 35 words and compared by their own hash.

Both comparisons send one entry per group of documents and distinct key to the
key's bucket (``common``), so a passage found everywhere is no hot spot. No
partners are listed: a key is repeated or not, whatever the number of its copies.
Equality is that of 64-bit hashes of word hashes.

Edge cases: a null or empty text has no words and keeps the empty text; texts of
fewer than 35 words keep all their words; repeated rows count as documents of
their own (so both lose what they share); an empty table gives no rows; extra
columns pass through, those named ``grp`` or like a result column are replaced (by
``without_repeats`` they are kept).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import (
    BLOCK_SCHEMA, GROUP_BYTES, U64, WordIds, among, answered, blocks, bucket_of, by_part,
    exchange, in_groups, in_order, local_counts, packed, quoted, repeated_keys, text_bytes,
    texts_of, unpacked, window_hash, with_results)

WINDOW = 35
#: A perfect difference set modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Keys that one bucket gets on average, at 27 bytes of text a key.
BUCKET_KEYS, BYTES_PER_KEY = 500_000, 27
RESULT = {"n_words": "long", "n_removed": "long", "kept_text": "string"}


class Words:
    """The words of a group's documents, hashed and joined."""

    def __init__(self, docs: pa.Table):
        ids = WordIds()
        self.lists = [t.split() for t in texts_of(docs.column("text"))]
        self.sizes = np.array([len(w) for w in self.lists], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        each = [ids.add(w) for w in self.lists]
        flat = np.concatenate(each) if each else np.empty(0, np.int64)
        self.hash = ids.hashes()[flat] if len(flat) else np.empty(0, U64)

    def runs(self, n: int) -> np.ndarray:
        """Positions from which a document has ``n`` more words."""
        ok = np.zeros(len(self.hash) + 1, np.int32)
        long = self.sizes >= n
        np.add.at(ok, self.starts[:-1][long], 1)
        np.add.at(ok, (self.starts[1:] - n + 1)[long], -1)
        return np.flatnonzero(np.cumsum(ok[:-1]))

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions and the hashes of the words from there."""
        n = window - PERIOD + 1
        at = self.runs(n)
        own = np.repeat(np.arange(len(self.sizes)), self.sizes)[at]
        keep = np.isin((at - self.starts[own]) % PERIOD, COVER) & (self.sizes[own] >= window)
        return at[keep], window_hash(self.hash, n)[at[keep]]

    def candidates(self, window: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that contain a repeated anchor, and their hashes."""
        at, h = self.anchors(window)
        _, index, counts = local_counts(h)
        again = np.zeros(len(self.hash) + 1, np.int32)
        again[at[(counts > 1)[index] | among(h, np.sort(shared))] + 1] = 1
        total = np.cumsum(again)
        starts = self.runs(window)
        starts = starts[total[starts + PERIOD] > total[starts]]
        return starts, window_hash(self.hash, window)[starts]

    def covered(self, starts: np.ndarray, window: int) -> np.ndarray:
        depth = np.zeros(len(self.hash) + 1, np.int32)
        depth[starts] += 1
        np.subtract.at(depth, starts + window, 1)
        return np.cumsum(depth[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW,
                   group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Documents with n_words, n_removed and kept_text (kept words, joined by a space)."""
    if window < PERIOD:
        raise ValueError(f"a window needs at least {PERIOD} words")
    size = text_bytes(docs)
    parts = max(1, size // (BUCKET_KEYS * BYTES_PER_KEY))
    columns = [c for c in docs.columns if c not in RESULT and c != "grp"]
    docs = docs.select(*map(quoted, columns))
    grouped = in_groups(docs, size, group_bytes)

    def anchor_blocks(key, table):
        _, h = Words(in_order(table)).anchors(window)
        h = np.unique(h)
        return blocks(by_part(key[0].as_py(), bucket_of(h, parts), h))

    def window_blocks(key, table, answers):
        if not table.num_rows:
            return blocks([])
        _, h = Words(in_order(table)).candidates(window, answered(answers, U64)[0])
        h = np.unique(h)
        return blocks(by_part(key[0].as_py(), bucket_of(h, parts), h))

    def removed(key, table, answers):
        table = in_order(table)
        words = Words(table)
        starts, h = words.runs(window), window_hash(words.hash, window)
        h = h[starts]
        _, index, counts = local_counts(h)
        gone = words.covered(
            starts[(counts > 1)[index] | among(h, np.sort(answered(answers, U64)[0]))], window)
        kept, lost = [], []
        for own, a, b in zip(words.lists, words.starts, words.starts[1:]):
            cut = gone[a:b]
            lost.append(int(cut.sum()))
            own = own if not lost[-1] else [own[i] for i in np.flatnonzero(~cut)]
            kept.append(b" ".join(own))
        for name, value in zip(RESULT, (pa.array(words.sizes), pa.array(lost, pa.int64()),
                                        pa.array(kept, pa.binary()).cast(pa.string()))):
            table = table.append_column(name, value)
        return table.drop_columns(["grp"])

    anchors = grouped.groupBy("grp").applyInArrow(anchor_blocks, BLOCK_SCHEMA)
    repeated = exchange(anchors, repeated_keys)
    windows = (grouped.groupBy("grp").cogroup(repeated.groupBy("grp"))
               .applyInArrow(window_blocks, BLOCK_SCHEMA))
    repeated = exchange(windows, repeated_keys)
    schema = with_results(docs, columns, RESULT)
    return (grouped.groupBy("grp").cogroup(repeated.groupBy("grp"))
            .applyInArrow(removed, schema))


def repeat_report(docs: DataFrame) -> DataFrame:
    """Digest columns per document."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents' own columns; texts that lost words hold their kept words."""
    found = remove_repeats(packed(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return unpacked(found.withColumn("text", text), docs)
