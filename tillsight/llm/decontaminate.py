"""Benchmark decontamination with one Aho-Corasick automaton.

The benchmark items are normalised to words (A-Z lower-cased; a word is a run of
digits, a-z and characters beyond ASCII) and cut into windows of ten consecutive
words; an item of fewer words, but not none, is one window. All windows go into
one automaton, and each document's normalised text is scanned once. Hits are kept
as word positions and mapped back to character offsets of the original text.

The automaton is broadcast only while the benchmark holds at most ``block_bytes``
of text; a larger benchmark is dealt into blocks below that size, and the
documents pass through one automaton after the other.

Edge cases: a null or empty text, or one without words, has no words, no hits and
no items; a null or wordless item has no windows; repeated items and repeated item
ids count once per id; a null item id counts as the id ''. Empty tables give empty
or clean results. Extra columns of the documents pass through unchanged, except
that columns named like a result column are replaced (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import in_slices, packed, quoted, unpacked, with_results

WINDOW = 10
#: Text of one automaton, which takes some 280 bytes for each byte of it.
BLOCK_BYTES = 1 << 20
RESULT = {"n_words": "long", "hit_words": "array<int>", "items": "array<string>",
          "spans": "array<struct<start:int,end:int>>"}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NORMAL = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)
_automata: dict = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(items: list[tuple[str, bytes]], window: int) -> dict[bytes, set[str]]:
    """Window text, framed by spaces, to the ids of the items that have it."""
    found: dict[bytes, set[str]] = {}
    for item_id, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[i:i + window]) + b" ", set()).add(item_id)
    return found


def _automaton(key: str, items, window: int):
    """Built once per Python worker from the broadcast items."""
    if key not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for text, ids in windows_of(items, window).items():
            a.add_word(text.decode("latin-1"), (len(text), sorted(ids)))
        if len(a):
            a.make_automaton()
        _automata[key] = a
    return _automata[key]


def scan(automaton, text: bytes) -> tuple[int, list[int], list[str], list[tuple[int, int]]]:
    """Number of words, hit word positions, item ids and hit character spans of a text."""
    plain = text.translate(_NORMAL)
    words = plain.split()
    if not words or not len(automaton):
        return len(words), [], [], []
    framed = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(framed.decode("latin-1")))
    if not hits:
        return len(words), [], [], []
    spaces = np.flatnonzero(np.frombuffer(framed, np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in hits])
    starts = np.searchsorted(spaces, [e - n + 1 for e, (n, _) in hits])
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    inside = np.cumsum(depth[:-1]) > 0
    # word positions to character offsets of the text as it was given
    raw = np.frombuffer(text, np.uint8)
    blank = np.frombuffer(b" " + plain + b" ", np.uint8) == 32
    first = np.flatnonzero(blank[:-1] & ~blank[1:])
    last = np.flatnonzero(~blank[:-1] & blank[1:])
    char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    spans = [(int(char[first[a]]), int(char[last[b - 1]])) for a, b in
             zip(edge[::2], edge[1::2])]
    ids = sorted({i for _, (_, own) in hits for i in own})
    return len(words), np.flatnonzero(inside).tolist(), ids, spans


def _scanner(shared, key: str, window: int, columns: list[str]):
    def run(batches):
        automaton = _automaton(key, shared.value, window)
        for batch in in_slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [scan(automaton, t or b"") for t in texts]
            own = [pa.array([f[0] for f in found], pa.int64()),
                   pa.array([f[1] for f in found], pa.list_(pa.int32())),
                   pa.array([f[2] for f in found], pa.list_(pa.string())),
                   pa.array([[{"start": a, "end": b} for a, b in f[3]] for f in found],
                            pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *own], [*columns, *RESULT])
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents with n_words, hit_words (positions), items (sorted ids) and spans
    (character offsets of the hits in the original text)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                             F.col("text").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size * 2 // block_bytes) if size > block_bytes else 1)
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    columns = [c for c in docs.columns if c not in RESULT]
    out = None
    for b in range(n):
        rows = [(r["i"], r["t"].encode()) for r in items.where(F.col("b") == b).collect()]
        shared = spark.sparkContext.broadcast(rows)
        step = _scanner(shared, f"{shared._jbroadcast.id()}", window, columns)
        if out is None:
            out = docs.select(*map(quoted, columns)).mapInArrow(
                step, with_results(docs, columns, RESULT))
        else:  # a further block of a large benchmark: add its hits to those found
            held = [F.col(c).alias(f"_{c}") for c in ("hit_words", "items", "spans")]
            wide = out.select(*map(quoted, columns), *held)
            step = _scanner(shared, f"{shared._jbroadcast.id()}", window, wide.columns)
            schema_b = with_results(wide, wide.columns, RESULT)
            out = wide.mapInArrow(step, schema_b).select(
                *map(quoted, columns), "n_words",
                *(F.array_sort(F.array_union(c, f"_{c}")).alias(c)
                  for c in ("hit_words", "items", "spans")))
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest columns per document."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window, with their own columns only."""
    found = find_contamination(packed(docs), benchmark)
    return unpacked(found.where(F.size("hit_words") == 0), docs)
