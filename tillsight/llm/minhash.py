"""MinHash near-dedup with min-max hashing.

A document's set holds its distinct 5-word shingles (words lower-cased A-Z, split at
ASCII white space); a document of fewer words, but not none, has its whole sequence as
its one shingle. Each of 128 permutations yields two signature values, the least and the
greatest hash, so 256 values cost 128 hash evaluations a shingle; either agrees with the
probability of the sets' similarity, and their errors partly cancel. 32 bands of four
permutations (8 values) make candidates: a pair at similarity 0.85 is missed with
probability 4e-5, one at 0.9 with 2e-8. A lower limit needs shorter bands: 42 bands of
three permutations miss a pair at 0.8 with probability 3e-6 (32 of four with 3e-3).

1. Documents with equal sets are one class (128-bit hash of the set); a third of all
   rows may be copies of one text and are still one class.
2. In each band bucket, every class is tied to the bucket's least class; the connected
   components of these ties are *families*. Nobody is compared with everybody here.
3. Families are confirmed on full sets: a search from class to class compares a class
   only with those not yet reached, so a family of near copies takes few passes.
   Families beyond ``family_block`` classes or ``family_bytes`` of text are cut into
   blocks, and each pair of blocks is one task; it returns at most one link per class,
   enough to keep all connections. One text of each class travels there. Blocks are dealt
   by hash, so a task holds about twice ``family_bytes`` of text at most, or one pair of
   texts where these are longer.
4. Components of the confirmed links, and of the classes, give each document its group.

Edge cases: a null or empty text, or one of white space, has no shingles and is alone
(component_id is its doc_id); ties go to the least doc_id; rows repeated with their id
fall into one group and all carry kept; rows of null doc_id count in their class but
never name it, and a class of such rows alone has a null component_id. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import (
    U64, WordIds, in_slices, mix, quoted, texts_of, window_hash)
from tillsight.llm.graph import components, stored

SHINGLE = 5
BANDS, BAND_PERMUTATIONS = 32, 4
SIMILARITY_PERCENT = 85
#: Classes of a family, and bytes of their texts, that one task compares with each other.
FAMILY_BLOCK, FAMILY_BYTES = 2000, 16 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    ids = WordIds()
    each = [ids.add(t.translate(_LOWER).split()) for t in texts]
    words = ids.hashes()
    out = []
    for w in each:
        h = words[w] if len(w) else np.empty(0, U64)
        if 0 < len(h) < n:
            h = mix(window_hash(h, len(h)) + U64(len(h)))
        else:
            h = window_hash(h, n)
        out.append(np.unique(h))
    return out


def permutations(n: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, n, dtype=np.uint32))


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Least and greatest hash of each (non-empty) set under ``n`` permutations."""
    factor, shift = permutations(n)
    joined = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), 2 * n), np.uint32)
    for i in range(n):
        h = joined * factor[i]
        h += shift[i]
        out[:, 2 * i] = np.minimum.reduceat(h, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band; keys of different bands differ by their seed."""
    values = signature.reshape(len(signature), bands, -1).astype(U64)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)),
                  (len(signature), 1))
    for i in range(values.shape[2]):
        key = mix(key * U64(0xA0761D6478BD642F) + values[:, :, i])
    return key


def set_ids(sets: list[np.ndarray]) -> tuple[list[int | None], list[int | None]]:
    """128-bit hash of each set as two signed 64-bit halves; null for empty sets."""
    both = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
    half = [(None, None) if x is None else (x >> 64, x & (1 << 64) - 1) for x in both]
    signed = [tuple(None if v is None else v - (v >> 63 << 64) for v in p) for p in half]
    return [p[0] for p in signed], [p[1] for p in signed]


def sketch(docs: DataFrame, bands: int = BANDS,
           band_permutations: int = BAND_PERMUTATIONS) -> DataFrame:
    """doc_id, n_shingles, hi and lo (hash of the set), bands (keys), size (bytes of the
    text) and text_hash per document."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in in_slices(batches, "text"):
            sets = shingle_sets(texts_of(batch.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = [None] * len(sets)
            if full:
                found = band_keys(signatures([sets[i] for i in full],
                                             bands * band_permutations), bands)
                for i, k in zip(full, found.view(np.int64)):
                    keys[i] = k
            hi, lo = set_ids(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(to_arrow_type(kind)),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 batch.column("size"), batch.column("text_hash")],
                ["doc_id", "n_shingles", "hi", "lo", "bands", "size", "text_hash"])

    return docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("size"),
                       F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, n_shingles long, hi long, lo long, "
             "bands array<long>, size long, text_hash long")


def confirmed_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(flat.max() + 1, np.int32)
    waiting, links = np.arange(len(sets)), []
    # entries of the waiting sets, joined; rebuilt when the number has halved
    held, held_starts, built = flat, starts[:-1], len(sets)
    index = waiting
    alive = np.ones(len(sets), bool)
    while True:
        rest = np.flatnonzero(alive)
        if not len(rest):
            return links
        queue = [int(rest[0])]
        alive[rest[0]] = False
        while queue:
            q = queue.pop()
            if alive.sum() * 2 < built:
                index = np.flatnonzero(alive)
                if not len(index):
                    return links
                held = np.concatenate([flat[starts[i]:starts[i + 1]] for i in index])
                held_starts = np.concatenate([[0], np.cumsum(sizes[index])[:-1]])
                built = len(index)
            own = flat[starts[q]:starts[q + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[held], held_starts)
            mark[own] = 0
            union = sizes[index] + sizes[q] - common
            near = index[(100 * common >= percent * union) & alive[index]]
            alive[near] = False
            links += [(q, int(i)) for i in near]
            queue += near.tolist()


def _confirm(percent: int):
    def run(group: pa.Table) -> pa.Table:
        sets = shingle_sets(texts_of(group.column("text")))
        _, lo = set_ids(sets)
        nodes = group.column("lo").to_pylist()
        at = {n: i for i, n in enumerate(lo) if n == nodes[i]}
        names = sorted(at)
        links = confirmed_links([sets[at[n]] for n in names], percent) if names else []
        return pa.table({"a": pa.array([names[i] for i, _ in links], pa.int64()),
                         "b": pa.array([names[j] for _, j in links], pa.int64())})
    return run


def family_texts(docs: DataFrame, classes: DataFrame, families: DataFrame,
                 family_block: int, family_bytes: int) -> DataFrame:
    """root, i, j (a pair of blocks), lo and text: one row per class in each of its tasks."""
    first = F.col("first")
    members = (families.join(classes.select(F.col("lo").alias("node"), "first"), "node")
               .where("first IS NOT NULL"))
    # blocks of each family; a family of at most one block is one task
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(
        F.count("*") / family_block, F.sum("first.size") / family_bytes)).cast("int").alias("n"))
    members = (members.join(sizes, "root")
               .select("root", "node", "n", first["doc_id"].alias("doc_id"),
                       first["text_hash"].alias("text_hash"),
                       F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("block")))
    texts = (docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
             .join(members, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]))
    other = F.expr("explode(sequence(0, n - 1))")
    return (texts.select("root", "node", "text", "block", "n", other.alias("other"))
            .where("n = 1 OR block <> other")  # a pair of blocks also holds either's own pairs
            .select("root", F.least("block", "other").alias("i"),
                    F.greatest("block", "other").alias("j"), F.col("node").alias("lo"), "text"))


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY_PERCENT,
                    family_block: int = FAMILY_BLOCK, bands: int = BANDS,
                    band_permutations: int = BAND_PERMUTATIONS,
                    family_bytes: int = FAMILY_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    sketches = stored(sketch(docs, bands, band_permutations), "sketches")
    classes = stored(sketches.where("lo IS NOT NULL").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "size", "text_hash")))
        .alias("first")), "classes")
    keyed = classes.select(F.col("lo").alias("node"), F.explode("bands").alias("key"))
    buckets = (keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
               .where("least <> most").select("key", "least"))
    ties = (keyed.join(buckets, "key").where("node <> least")
            .select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    families = stored(components(ties), "families")

    texts = family_texts(docs, classes, families, family_block, family_bytes)
    links = stored(texts.groupBy("root", "i", "j")
                   .applyInArrow(_confirm(percent), "a long, b long"), "confirmed")
    found = components(links)

    # every class to the least doc_id of its component
    named = (classes.select("hi", "lo", "doc_id")
             .join(found.select(F.col("node").alias("lo"), "root"), "lo", "left")
             .withColumn("root", F.coalesce("root", "lo")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root").select("hi", "lo", "component_id")
    out = sketches.select("doc_id", "n_shingles", "hi", "lo").join(of_class, ["hi", "lo"], "left")
    component = F.when(F.col("lo").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = SIMILARITY_PERCENT, bands: int = BANDS,
             band_permutations: int = BAND_PERMUTATIONS) -> DataFrame:
    """One document of each group, with its own columns. Rows repeated with their id
    leave one; rows without an id pass."""
    found = near_duplicates(docs, percent, bands=bands, band_permutations=band_permutations)
    kept = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return (named.dropDuplicates(["doc_id", "text"])
            .unionByName(docs.where("doc_id IS NULL")).select(*map(quoted, docs.columns)))
