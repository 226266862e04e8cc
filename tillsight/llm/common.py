"""Helpers shared by the training-data operators.

Text work runs as numpy code inside Spark tasks. The unit of that work is a
*group*: documents dealt by a hash of (doc_id, text) into as many groups as the
table's bytes need at ``group_bytes`` each, so a group is small whatever the
table's size and no source, key or set of copies can fill one. Groups exchange
packed blocks of hashes with key buckets (``part``): a group sends one entry per
distinct key, however often it holds the key, so a key found in a third of all
rows arrives at its bucket once per group.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text that one group holds on average.
GROUP_BYTES = 3 << 20
#: Layout of the packed blocks that groups and key buckets exchange.
BLOCK_SCHEMA = "grp int, part int, body binary"

_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def with_results(df: DataFrame, columns: list[str], results: dict[str, str]) -> T.StructType:
    """Schema of some columns of ``df`` and of result columns given as name and type."""
    kept = [f for f in df.schema if f.name in columns]
    return T.StructType(kept + [T.StructField(c, T._parse_datatype_string(t))
                                for c, t in results.items()])


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct, whose names clash with nothing."""
    rest = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(0)]).alias("_rest"))


def unpacked(df: DataFrame, docs: DataFrame, results=()) -> DataFrame:
    """The columns of ``docs``, and result columns, from a packed frame."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else
                       F.col("_rest").getField(c).alias(c) for c in docs.columns], *results)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place, so that all bits depend on all bits."""
    x ^= x >> U64(32)
    x *= _C2
    x ^= x >> U64(29)
    return x


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values of ``h``, composed by doubling."""
    if len(h) < n:
        return np.empty(0, U64)
    size, power, out, done = 1, mix(h * _C1), None, 0
    while True:
        if n & size:
            if out is None:
                out = power.copy()
            else:
                m = min(len(out), len(power) - done)
                out = mix(out[:m] * _C3 + power[done:done + m])
            done += size
        size *= 2
        if size > n:
            return out[:len(h) - n + 1]
        half = size // 2
        power = mix(power[:-half] * _C1 + power[half:]) if len(power) > half else power[:0]


def bucket_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> U64(40)).astype(np.int64) % parts


def held_out(doc_id: str, modulus: int, remainder: int):
    """Rows whose crc32 of the id's text has the given remainder; a null id has none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
                      == remainder, F.lit(False))


class WordIds:
    """Dense ids of the distinct words of a block of texts."""

    def __init__(self):
        self.ids: dict = defaultdict()
        self.ids.default_factory = self.ids.__len__

    def add(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per distinct word, in the order of the ids."""
        f = xxhash.xxh3_64_intdigest
        return np.fromiter(map(f, self.ids), U64, len(self.ids))


def texts_of(column) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system. A Python worker serves one stage after the other
    and keeps what its allocators hold, which would add to the next stage's needs."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to return
        pass


def in_slices(batches: Iterator[pa.RecordBatch], column: str,
              slice_bytes: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice's texts hold about ``slice_bytes``."""
    for batch in batches:
        give_back()
        sizes = [0 if v is None else v for v in
                 pc.binary_length(batch.column(column)).to_pylist()]
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > slice_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text of the whole table: one aggregate row."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def in_groups(docs: DataFrame, total_bytes: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Deal documents into groups (column ``grp``) of about ``group_bytes``."""
    n = max(1, -(-total_bytes // group_bytes))
    return docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def in_order(group: pa.Table) -> pa.Table:
    """Rows of a group in an order that does not depend on their arrival."""
    give_back()
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def blocks(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    grp, part, body = zip(*rows) if rows else ((), (), ())
    return pa.table({"grp": pa.array(grp, pa.int32()), "part": pa.array(part, pa.int32()),
                     "body": pa.array(body, pa.binary())})


def by_part(grp: int, part_of: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Pack the columns' entries by bucket: one block per bucket that has any."""
    order = np.argsort(part_of, kind="stable")
    ends = np.flatnonzero(np.diff(part_of[order], append=-1)) + 1
    rows, start = [], 0
    for end in ends:
        own = order[start:end]
        body = len(own).to_bytes(8, "little") + b"".join(c[own].tobytes() for c in columns)
        rows.append((grp, int(part_of[own[0]]), body))
        start = end
    return rows


def unpack(body: bytes, *types) -> list[np.ndarray]:
    n, at, out = int.from_bytes(body[:8], "little"), 8, []
    for t in types:
        out.append(np.frombuffer(body, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def exchange(blocks_df: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Let every bucket see its blocks from all groups and answer each block."""
    return blocks_df.groupBy("part").applyInArrow(answer, BLOCK_SCHEMA)


def local_counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the index of the value of each entry, and the counts."""
    return np.unique(h, return_inverse=True, return_counts=True)


def among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value occurs in a sorted array."""
    if not len(ordered):
        return np.zeros(len(h), bool)
    at = np.searchsorted(ordered, h)
    at[at == len(ordered)] = 0
    return ordered[at] == h


def repeated_keys(group: pa.Table) -> pa.Table:
    """Answer of a key bucket: to each group, those of its keys that another group has too."""
    grp, part = group.column("grp").to_pylist(), group.column("part").to_pylist()
    keys = [unpack(b, U64)[0] for b in group.column("body").to_pylist()]
    values, _, counts = local_counts(np.concatenate(keys))
    shared = values[counts > 1]
    out = []
    for g, p, own in zip(grp, part, keys):
        own = own[among(own, shared)]
        if len(own):
            out.append((g, p, len(own).to_bytes(8, "little") + own.tobytes()))
    return blocks(out)


def answered(answers: pa.Table, *types) -> list[np.ndarray]:
    """All answers to a group, joined column by column."""
    found = [unpack(b, *types) for b in answers.column("body").to_pylist()]
    return [np.concatenate([np.empty(0, t), *(x[i] for x in found)]).astype(t)
            for i, t in enumerate(types)]
