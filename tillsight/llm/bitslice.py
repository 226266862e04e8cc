"""Ranked lexical search over bit-sliced Bloom signatures.

Index. Documents of similar numbers of terms form a block. Each document has a Bloom
signature of the same number of rows in its block, and the block keeps one bitmap per
row over its documents. A document enters its terms, and for a term that occurs more
often also the levels of its count (2, 3, 4, 6, ... occurrences). Beside the rows a
block holds each document's length and its greatest term count; a slice of blocks holds
the document frequencies of its terms. The index does not depend on any query.

Search. A term's rows are intersected over the whole block at once: a superset of the
documents that hold the term, and of those that reach each level of its count. So a
term's count is never underestimated, and the weighted sum over an item's terms bounds
the document's score from above. Pass one takes the documents of the highest bounds and
scores them exactly; the least of an item's best scores is its threshold. Pass two takes
every document whose bound reaches the threshold; these are scored exactly from their
texts and ranked. Documents left out are proven to score less, whatever the errors of the
signatures.

Terms are runs of digits, letters A-Z (lower-cased), a-z and characters beyond ASCII.

Edge cases: a null or empty text, or one without terms, counts nowhere and is never
returned; repeated rows are documents of their own, all of which may be ranked; a null
doc_id ranks after all others of its score; an item without terms, or whose terms occur
nowhere, has no rows; repeated items with equal text count once, an item id with several
texts is ranked for each of them; of ties the least doc_id comes first; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import U64, WordIds, in_slices, mix, texts_of
from tillsight.llm.graph import stored

TOP = 20
#: Share of set bits that a row has at most, and rows per term and per level of its count.
DENSITY, TERM_ROWS, LEVEL_ROWS = 0.25, 6, 2
#: Counts of a term at which a further entry is made.
LEVELS = (2, 3, 4, 6, 9, 14, 22, 40, 80)
#: Documents of a block differ in size by this factor at most (but eight may share a block).
SPREAD = math.sqrt(2)
SLICE_BYTES = 6 << 20
#: Text of the items that one pass over the index answers, and that are summed at a time.
PASS_BYTES, STEP_BYTES = 4 << 20, 64 << 10
STEP_DOCS = 256

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
              else 32 for c in range(256))
_SALT = 0xA0761D6478BD642F
INDEX_SCHEMA = ("docs long, length long, hashes array<long>, counts array<int>, blocks array<struct<"
                "rows int, size int, keys binary, lengths binary, peaks binary, bits binary>>")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def places(h: np.ndarray, level: int, n: int, rows: int) -> np.ndarray:
    """Rows of each entry: [entries, n]."""
    h = mix(h + U64(level * _SALT & (1 << 64) - 1))
    first, step = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    return ((first[:, None] + np.arange(n, dtype=U64) * step[:, None]) % U64(rows)).astype(np.int64)


def rows_for(bits: int) -> int:
    return max(64, math.ceil(bits / -math.log(1 - DENSITY)))


def _block(order: np.ndarray, weight: np.ndarray, docs: dict, pairs: tuple, hashes: np.ndarray) -> dict:
    """The block of the documents in ``order``; ``pairs`` are (document, term, count), by document."""
    rows, size = rows_for(int(weight[order].max())), len(order)
    column = np.full(len(weight), -1, np.int64)
    column[order] = np.arange(size)
    doc, term, count = pairs
    own = column[doc] >= 0
    at, h, count = column[doc[own]], hashes[term[own]], count[own]
    bits = np.zeros((rows, -(-size // 8)), np.uint8)
    for level, n in [(1, TERM_ROWS), *((x, LEVEL_ROWS) for x in LEVELS)]:
        more = count >= level
        if not more.any():
            break
        at, h, count = at[more], h[more], count[more]
        byte, bit = (at >> 3)[:, None], (128 >> (at & 7)).astype(np.uint8)[:, None]
        np.bitwise_or.at(bits, (places(h, level, n, rows), byte), bit)
    return {"rows": rows, "size": size, "bits": bits.tobytes(),
            "keys": docs["key"][order].tobytes(), "lengths": docs["length"][order].tobytes(),
            "peaks": docs["peak"][order].tobytes()}


def _slice_index(keys: np.ndarray, texts: list[bytes]) -> dict:
    """The index row of one slice of documents."""
    known = WordIds()
    each = [known.add(terms_of(t)) for t in texts]
    filled = [i for i, e in enumerate(each) if len(e)]
    each = [each[i] for i in filled]
    if not each:
        return {"docs": 0, "length": 0, "hashes": [], "counts": [], "blocks": []}
    hashes, n_terms = known.hashes(), len(known.ids)
    length = np.array([len(e) for e in each], np.int64)
    doc = np.repeat(np.arange(len(each)), length)
    value, count = np.unique(doc * n_terms + np.concatenate(each), return_counts=True)
    doc, term = value // n_terms, value % n_terms
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    docs = {"key": keys[filled], "length": length,
            "peak": np.maximum.reduceat(count, first).astype(np.int64)}
    weight = np.diff(np.append(first, len(doc))) * TERM_ROWS
    for level in LEVELS:
        weight += LEVEL_ROWS * np.bincount(doc[count >= level], minlength=len(each))
    by_size = np.argsort(-weight, kind="stable")
    blocks, a = [], 0
    while a < len(by_size):
        near = np.searchsorted(-weight[by_size], -weight[by_size[a]] / SPREAD, "right")
        b = min(len(by_size), max(int(near), a + 8))
        lo, hi = by_size[a:b].min(), by_size[a:b].max()
        i, j = np.searchsorted(doc, [lo, hi + 1])  # pairs are in order of documents
        blocks.append(_block(by_size[a:b], weight, docs, (doc[i:j], term[i:j], count[i:j]), hashes))
        a = b
    return {"docs": len(each), "length": int(length.sum()), "hashes": hashes.view(np.int64).tolist(),
            "counts": np.bincount(term, minlength=n_terms).tolist(), "blocks": blocks}


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))


def build_index(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Index rows, one per slice of documents (stored in the shared folder)."""
    kind = pa.list_(pa.struct([("rows", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()),
                               ("lengths", pa.binary()), ("peaks", pa.binary()), ("bits", pa.binary())]))

    def run(batches):
        for batch in in_slices(batches, "text", slice_bytes):
            row = _slice_index(batch.column("_key").to_numpy(), texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["docs"]], pa.int64()), pa.array([row["length"]], pa.int64()),
                 pa.array([row["hashes"]], pa.list_(pa.int64())),
                 pa.array([row["counts"]], pa.list_(pa.int32())), pa.array([row["blocks"]], kind)],
                ["docs", "length", "hashes", "counts", "blocks"])

    return stored(_keyed(docs).select("_key", "text").mapInArrow(run, INDEX_SCHEMA), "signatures")


class Query:
    """A step's items: their terms, weights and, item by item, term numbers and repeats."""

    def __init__(self, items: list[tuple[int, list[bytes]]], totals: tuple[int, int], df: dict):
        self.docs, self.length = totals
        self.items = np.array([i for i, _ in items], np.int64)
        known = WordIds()
        counted = [Counter(words) for _, words in items]
        self.terms = [known.add(list(c)) for c in counted]
        self.repeats = [np.array(list(c.values()), np.int64) for c in counted]
        self.names = list(known.ids)
        self.hash = known.hashes()
        self.weight = np.array([
            math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df.get(int(h), 0) + 1)))
            for h in self.hash.view(np.int64)], np.int64)
        self.flat, self.times = np.concatenate(self.terms), np.concatenate(self.repeats)
        self.starts = np.cumsum([0, *(len(t) for t in self.terms)])[:-1]

    def norm(self, length):
        return 75 + (25 * length * self.docs) // self.length

    def bounds(self, block: dict) -> np.ndarray:
        """No document's score for an item exceeds this: [items, documents] of a block."""
        size, rows = block["size"], block["rows"]
        bits = np.frombuffer(block["bits"], np.uint8).reshape(rows, -1)
        norm = self.norm(np.frombuffer(block["lengths"], np.int64))
        peak = np.frombuffer(block["peaks"], np.int64)
        at = places(self.hash, 1, TERM_ROWS, rows)
        held = bits[at[:, 0]]
        for i in range(1, TERM_ROWS):
            held &= bits[at[:, i]]
        term, doc = np.nonzero(np.unpackbits(held, axis=1, count=size))
        most = np.full(len(term), LEVELS[0] - 1, np.int64)
        left = np.arange(len(term))
        for i, level in enumerate(LEVELS):
            if not len(left):
                break
            at = places(self.hash, level, LEVEL_ROWS, rows)
            t, d = term[left], doc[left]
            inside = np.ones(len(left), bool)
            for j in range(LEVEL_ROWS):
                inside &= (bits[at[t, j], d >> 3] >> (7 - (d & 7)).astype(np.uint8) & 1).astype(bool)
            left = left[inside]
            most[left] = LEVELS[i + 1] - 1 if i + 1 < len(LEVELS) else np.iinfo(np.int64).max
        most = np.minimum(most, peak[doc])
        value = self.weight[term] * (1_000_000_000 * most // (1000 * most + 12 * norm[doc]))
        out = np.empty((len(self.items), size), np.int64)
        for a in range(0, size, STEP_DOCS):  # the slices' weighted sums, some documents at a time
            b = min(size, a + STEP_DOCS)
            some = (doc >= a) & (doc < b)
            dense = np.zeros((len(self.hash), b - a), np.int64)
            dense[term[some], doc[some] - a] = value[some]
            out[:, a:b] = np.add.reduceat(dense[self.flat] * self.times[:, None], self.starts, axis=0)
        return out

    def score(self, item: int, counts: Counter, length: int) -> int:
        """The exact score of a document, in whole numbers."""
        norm, total = self.norm(length), 0
        for t, q in zip(self.terms[item].tolist(), self.repeats[item].tolist()):
            tf = counts.get(self.names[t], 0)
            if tf:
                total += q * int(self.weight[t]) * (1_000_000_000 * tf // (1000 * tf + 12 * norm))
        return total


def _steps(rows, index: DataFrame, totals: tuple[int, int]) -> list[Query]:
    """The items of a pass as queries of about ``STEP_BYTES`` each."""
    items = [(r["_item"], terms_of(r["text"].encode())) for r in rows]
    items = [(i, w) for i, w in items if w]
    hashes = sorted({xxhash.xxh3_64_intdigest(t) for _, w in items for t in w})
    asked = index.sparkSession.createDataFrame(
        [(h - (h >> 63 << 64),) for h in hashes], "h long")  # bounded by PASS_BYTES
    counts = (index.select(F.explode(F.arrays_zip("hashes", "counts")).alias("x"))
              .select(F.col("x.hashes").alias("h"), F.col("x.counts").alias("n"))
              .join(F.broadcast(asked), "h").groupBy("h").agg(F.sum("n").alias("n")))
    df = {r["h"]: r["n"] for r in counts.collect()}
    out, own, size = [], [], 0
    for i, w in items:
        own.append((i, w))
        size += sum(map(len, w))
        if size > STEP_BYTES:
            out.append(Query(own, totals, df))
            own, size = [], 0
    return out + ([Query(own, totals, df)] if own else [])


def _blocks(batches):
    for batch in batches:
        for blocks in batch.column("blocks").to_pylist():
            yield from blocks


def highest(index: DataFrame, shared, top: int) -> DataFrame:
    """(item, _key) of the documents of the ``top`` highest bounds of each task."""
    def run(batches):
        steps = shared.value
        best = [np.zeros((len(q.items), top), np.int64) for q in steps]
        keys = [np.zeros((len(q.items), top), np.int64) for q in steps]
        for block in _blocks(batches):
            own = np.frombuffer(block["keys"], np.int64)
            for s, q in enumerate(steps):
                bound = np.concatenate([best[s], q.bounds(block)], axis=1)
                at = np.argpartition(-bound, top - 1, axis=1)[:, :top]
                key = np.concatenate([keys[s], np.broadcast_to(own, (len(q.items), len(own)))], axis=1)
                best[s], keys[s] = (np.take_along_axis(x, at, 1) for x in (bound, key))
        for q, b, k in zip(steps, best, keys):
            item, place = np.nonzero(b > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.items[item]), pa.array(k[item, place]), pa.array(b[item, place])],
                ["item", "_key", "bound"])

    found = index.select("blocks").mapInArrow(run, "item long, _key long, bound long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "_key"))
    return found.withColumn("r", rank).where(F.col("r") <= top).select("item", "_key").distinct()


def reaching(index: DataFrame, shared, least) -> DataFrame:
    """(item, _key) of every document whose bound reaches its item's threshold."""
    def run(batches):
        for block in _blocks(batches):
            own = np.frombuffer(block["keys"], np.int64)
            for q in shared.value:
                limit = np.array([least.value.get(int(i), 1) for i in q.items], np.int64)
                item, place = np.nonzero(q.bounds(block) >= limit[:, None])
                if len(item):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q.items[item]), pa.array(own[place])], ["item", "_key"])

    return index.select("blocks").mapInArrow(run, "item long, _key long").distinct()


def scored(docs: DataFrame, wanted: DataFrame, shared) -> DataFrame:
    """(item, doc_id, score): exact scores above 0 of the wanted pairs (item, _key)."""
    by_doc = wanted.groupBy("_key").agg(F.collect_set("item").alias("items"))  # at most all items
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        place = {int(i): (q, n) for q in shared.value for n, i in enumerate(q.items)}
        for batch in in_slices(batches, "text"):
            item, row, score = [], [], []
            for r, (text, asked) in enumerate(zip(texts_of(batch.column("text")),
                                                  batch.column("items").to_pylist())):
                words = terms_of(text)
                counts = Counter(words)
                for i in asked:
                    q, n = place[i]
                    s = q.score(n, counts, len(words))
                    if s > 0:
                        item.append(i), row.append(r), score.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), batch.column("doc_id").take(pa.array(row, pa.int64())),
                 pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return (_keyed(docs).where("text IS NOT NULL").join(by_doc, "_key")
            .select("doc_id", "text", "items")
            .mapInArrow(run, f"item long, doc_id {kind.simpleString()}, score long"))


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, index: DataFrame | None = None,
           pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents.

    ``index`` is ``build_index(docs)``, made if not given. Items are dealt into passes of
    about ``pass_bytes`` of text, so what is broadcast is bounded whatever their number.
    """
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    total = index.agg(F.sum("docs"), F.sum("length")).first()
    totals = total[0] or 0, total[1] or 0
    items = (benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
             .withColumn("_item", F.xxhash64("item_id", "text")))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    items = items.withColumn("_pass", F.pmod(F.xxhash64("text", "item_id"), F.lit(passes)))
    in_item = Window.partitionBy("item")
    out = None
    for p in range(passes if totals[0] else 0):
        steps = _steps(items.where(F.col("_pass") == p).collect(), index, totals)
        if not steps:
            continue
        shared = spark.sparkContext.broadcast(steps)
        seeds = scored(docs, stored(highest(index, shared, top), "seeds"), shared)
        place = F.row_number().over(in_item.orderBy(F.desc("score")))
        least = {r["item"]: r["score"] for r in seeds.withColumn("r", place)
                 .where(F.col("r") == top).select("item", "score").collect()}  # one per item
        wanted = stored(reaching(index, shared, spark.sparkContext.broadcast(least)), "candidates")
        found = scored(docs, wanted, shared)
        out = found if out is None else out.union(found)
    kinds = {f.name: f.dataType.simpleString() for f in (*items.schema, *docs.schema)}
    if out is None:
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id "
                                         f"{kinds['doc_id']}, score long")
    rank = F.row_number().over(in_item.orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = out.withColumn("rank", rank).where(F.col("rank") <= top)
    names = items.select("item_id", F.col("_item").alias("item"))
    return best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"),
                                           "doc_id", "score")
