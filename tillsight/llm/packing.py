"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its ids and an end id. Only documents longer than a sequence are cut, from
their end, so that all pieces but the first fill a sequence each. The other pieces are
packed in rounds. A round sorts waiting pieces and the gaps of open sequences together by
size (``repartitionByRange``: one size may span many tasks). Sweeping from the greatest
size down, a piece succeeds to the smallest gap that holds it. Every task sweeps its own
range; what is left of each range is swept across ranges by its runs of equal size, of
which there are at most as many as sizes and tasks. Pieces that want the same gap are
told apart by their rank: the first takes it (after the first rounds: as many of one size
as fit together), the next ones go to the next gap. Then the gaps shrink, and the next
round begins. When hardly anything fits any more, more sequences are opened: 85 percent
of those that the waiting tokens fill at least. The last pieces, a few thousand at most,
are packed by plain best fit into as many of the greatest gaps and into new sequences.

A round is one shuffle, and its result is stored, so a lost executor costs its own tasks
only. A task holds one range of pieces and gaps, the driver the runs left over and the
last pieces.

Edge cases: a null or empty text is its end id alone; repeated rows and null ids are
documents of their own; pieces of equal size are packed in any, but reproducible, order;
an empty table gives no rows; very long texts become many pieces; only doc_id and text
are read.
"""

from __future__ import annotations

import bisect
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import in_slices
from tillsight.llm.graph import stored
from tillsight.llm.wordwise import BYTE_BPE, byte_bpe, public_path
from tillsight.session import scratch_path

SEQUENCE, END_ID = 2048, 0
SLICE_BYTES = 6 << 20
#: Pieces and gaps that one task sorts and sweeps.
RANGE_ROWS = 500_000
#: Rounds in which a gap takes one piece only: single pieces leave room for better ones.
SINGLE_ROUNDS = 3
#: Share of the needed sequences that is opened when less than this share of the pieces
#: (or gaps, if fewer) were matched; pieces that are left to the end.
OPEN_SHARE, LEAST_SHARE, FEW = 0.85, 0.1, 2000


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE,
               end_id: int = END_ID) -> DataFrame:
    """doc_id, pid (number of the piece's own), piece, start, length, ids and ids_crc32."""
    path = vocabulary or public_path(BYTE_BPE)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        bpe, pid = byte_bpe(path), TaskContext.get().partitionId() << 40
        for batch in in_slices(batches, "text", SLICE_BYTES):
            row, piece, start, ids = [], [], [], []
            for r, own in enumerate(bpe.whole([t or "" for t in batch.column("text").to_pylist()])):
                own = np.append(own, np.int32(end_id))
                first = (len(own) - 1) % sequence + 1
                for n, a in enumerate([0, *range(first, len(own), sequence)]):
                    row.append(r), piece.append(n), start.append(a)
                    ids.append(own[a:a + sequence if a else first])
            length = [len(x) for x in ids]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            ends = np.cumsum([0, *length]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())),
                 pa.array(np.arange(pid, pid + len(row))), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(crc, pa.int64())],
                ["doc_id", "pid", "piece", "start", "length", "ids", "ids_crc32"])
            pid += len(row)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind.simpleString()}, pid long, piece int, start long, length long, "
             "ids array<int>, ids_crc32 long")


def sweep(runs, single: bool = False) -> list[tuple[int, ...]]:
    """Successors of runs (is_gap, size, first, count) in falling order of size, gaps first.

    Returns (first piece, pieces, size, first gap, pieces per gap, free): of a run of
    pieces, the i-th goes to the gap ``first gap + i // pieces per gap``. The gaps met last
    are the smallest that hold the piece, so they lie on top of a stack.
    """
    stack, out = [], []
    for is_gap, size, first, count in runs:
        if is_gap:
            stack.append([size, first, count])
            continue
        while count and stack:
            free, start, n = stack[-1]
            fit = 1 if single else free // size
            gaps = min(n, -(-count // fit))
            taken = min(count, gaps * fit)
            out.append((first, taken, size, start + n - gaps, fit, free))
            first, count = first + taken, count - taken
            stack[-1][2] -= gaps
            if not stack[-1][2]:
                stack.pop()
    return out


def _runs(is_gap: np.ndarray, size: np.ndarray):
    edge = np.flatnonzero((np.diff(is_gap.astype(np.int8), prepend=-1) != 0)
                          | (np.diff(size, prepend=-1) != 0))
    count = np.diff(np.append(edge, len(size)))
    return zip(is_gap[edge].tolist(), size[edge].tolist(), edge.tolist(), count.tolist())


class Matches:
    """What a sweep found, for look-ups by the numbers of pieces and gaps."""

    def __init__(self, found: list[tuple[int, ...]]):
        self.first, self.count, self.size, self.gap, self.fit, self.free = np.array(
            found, np.int64).reshape(-1, 6).T
        self.gaps = -(-self.count // self.fit)
        self.by_gap = np.argsort(self.gap)

    def pieces(self, number: np.ndarray):
        """For each piece whether it has a gap, the gap, and its offset in what was free."""
        if not len(self.first):
            return np.zeros(len(number), bool), number, number
        at = np.maximum(np.searchsorted(self.first, number, "right") - 1, 0)
        i = number - self.first[at]
        return ((i >= 0) & (i < self.count[at]), self.gap[at] + i // self.fit[at],
                (i % self.fit[at]) * self.size[at] - self.free[at])

    def taken(self, number: np.ndarray):
        """For each gap whether it took pieces, and their tokens."""
        if not len(self.first):
            return np.zeros(len(number), bool), number
        place = np.searchsorted(self.gap[self.by_gap], number, "right") - 1
        at = self.by_gap[np.maximum(place, 0)]
        i = number - self.gap[at]
        pieces = np.minimum(self.fit[at], self.count[at] - i * self.fit[at])
        return (i >= 0) & (i < self.gaps[at]), pieces * self.size[at]


SWEPT = "part int, state int, id long, size long, bin long, offset long, rank long"
PLACED, LEFT_PIECE, LEFT_GAP, SHRUNK, PIECE_RUN, GAP_RUN, MATCHED = 0, 1, 2, 3, -1, -2, -3


def _table(part: int, state: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    zero = np.zeros(n, np.int64)
    return pa.RecordBatch.from_pydict({
        "part": np.full(n, part, np.int32), "state": np.full(n, state, np.int32),
        **{c: columns.get(c, zero).astype(np.int64) for c in ("id", "size", "bin", "offset", "rank")}})


def _local_sweep(batches, single: bool, sequence: int):
    """Sweep one range: its placed pieces, the pieces and gaps left over with their rank
    among the range's own, what is left of gaps that took pieces, and, for the sweep
    across ranges, one row per run left over and one with the number of matches."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    is_gap, size, name = (table.column(c).to_numpy() for c in ("is_gap", "size", "id"))
    found = Matches(sweep(_runs(is_gap, size), single))
    part, row = TaskContext.get().partitionId(), np.arange(len(size))
    pieces, gaps = row[~is_gap], row[is_gap]
    has, gap, offset = found.pieces(pieces)
    yield _table(part, PLACED, id=name[pieces[has]], size=size[pieces[has]], bin=name[gap[has]],
                 offset=offset[has] + sequence)
    took, tokens = found.taken(gaps)
    left = size[gaps] - tokens
    shrunk = took & (left > 0)
    yield _table(part, SHRUNK, id=name[gaps[shrunk]], size=left[shrunk])
    for state, run, rest in ((LEFT_PIECE, PIECE_RUN, pieces[~has]), (LEFT_GAP, GAP_RUN, gaps[~took])):
        yield _table(part, state, id=name[rest], size=size[rest], rank=np.arange(len(rest)))
        sizes, counts = np.unique(size[rest], return_counts=True)
        yield _table(part, run, size=sizes, rank=counts)
    yield _table(part, MATCHED, size=np.array([size[pieces[has]].sum()]), rank=np.array([has.sum()]),
                 id=np.array([shrunk.sum()]))


class Round:
    """A swept round and the sweep over its runs, of which there are at most as many as
    sizes and ranges."""

    def __init__(self, swept: DataFrame, single: bool):
        rows = swept.where("state < 0").select("part", "state", "size", "rank", "id").collect()
        base, runs, total = ({}, {}), [], [0, 0]
        for r in sorted((r for r in rows if r["state"] != MATCHED),
                        key=lambda r: (r["part"], -r["size"], r["state"])):
            kind = int(r["state"] == GAP_RUN)
            base[kind].setdefault(r["part"], total[kind])
            runs.append((bool(kind), r["size"], total[kind], r["rank"]))
            total[kind] += r["rank"]
        found = sweep(runs, single)
        local = [r for r in rows if r["state"] == MATCHED]
        self.swept, self.across = swept, (base, found)
        self.matched = sum(r["rank"] for r in local) + sum(f[1] for f in found)
        self.tokens = sum(r["size"] for r in local) + sum(f[1] * f[2] for f in found)
        self.gaps = sum(r["id"] for r in local) + total[1]   # at most: some are filled across ranges
        self.least = min((r["size"] for r in rows if r["state"] == PIECE_RUN), default=0)

    def rest(self) -> DataFrame:
        """Pieces, and gaps that may hold one, of the next round: (is_gap, size, id)."""
        shared = self.swept.sparkSession.sparkContext.broadcast([self.across])
        least = max(1, self.least)

        def run(batches):
            for batch, state, number, found in _numbered(batches, shared.value, None):
                size, piece, gap = batch.column("size").to_numpy().copy(), state == LEFT_PIECE, state == LEFT_GAP
                keep = ~piece
                keep[piece] = ~found.pieces(number[piece])[0]
                took, tokens = found.taken(number[gap])
                size[gap] -= np.where(took, tokens, 0)
                keep &= size >= least
                yield pa.RecordBatch.from_arrays([pa.array(~piece), pa.array(size), batch.column("id")],
                                                 ["is_gap", "size", "id"]).filter(pa.array(keep))

        return self.swept.where(F.col("state").between(LEFT_PIECE, SHRUNK)).mapInArrow(
            run, "is_gap boolean, size long, id long")


def _numbered(batches, rounds: list, column: str | None):
    """Rows left over in a range with their number over all ranges of their round, and the
    round's matches. Batches are cut by round where ``column`` names it."""
    for whole in batches:
        own = whole.column(column).to_numpy() if column else np.zeros(whole.num_rows, np.int64)
        for r in np.unique(own).tolist():
            batch = whole.filter(pa.array(own == r)) if column else whole
            base, found = rounds[r]
            state, part = batch.column("state").to_numpy(), batch.column("part").to_numpy()
            first = np.array([base[int(s == LEFT_GAP)].get(p, 0) for p, s in
                              zip(part.tolist(), state.tolist())], np.int64)
            yield batch, state, batch.column("rank").to_numpy() + first, Matches(found)


def _placed(swept: DataFrame, rounds: list, sequence: int) -> DataFrame:
    """(id, bin, offset) of all rounds' pieces: those placed within a range, and those that
    meet their gap by its number across ranges."""
    inside = swept.where(F.col("state") == PLACED).select("id", "bin", "offset")
    if not any(found for _, found in rounds):
        return inside
    shared = swept.sparkSession.sparkContext.broadcast(rounds)

    def run(batches):
        for batch, state, own, found in _numbered(batches, shared.value, "round"):
            piece = state == LEFT_PIECE
            has, to, offset = found.pieces(own)
            took, _ = found.taken(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), batch.column("round"), batch.column("id"), pa.array(np.where(piece, to, own)),
                 pa.array(offset + sequence)], ["piece", "round", "id", "to", "offset"]).filter(
                     pa.array(np.where(piece, has, took)))

    left = swept.where(F.col("state").isin(LEFT_PIECE, LEFT_GAP)).mapInArrow(
        run, "piece boolean, round int, id long, to long, offset long")
    pieces = left.where("piece").select("round", "to", "id", "offset")
    gaps = left.where("NOT piece").select(F.col("round").alias("r"), F.col("to").alias("g"), F.col("id").alias("bin"))
    across = pieces.join(gaps, (F.col("round") == F.col("r")) & (F.col("to") == F.col("g")))
    return inside.union(across.select("id", "bin", "offset"))


def best_fit(pieces: list[tuple[int, int]], gaps: list[tuple[int, int]], sequence: int,
             first: int) -> list[tuple[int, int, int]]:
    """(id, bin, offset) of a few pieces (id, size), the greatest first, each in the
    smallest gap (size, bin) that holds it; new bins are numbered ``first``, ``first - 1``,
    ..."""
    gaps, out = sorted(gaps), []
    for i, size in sorted(pieces, key=lambda p: (-p[1], p[0])):
        at = bisect.bisect_left(gaps, (size,))
        if at < len(gaps):
            free, own = gaps.pop(at)
        else:
            free, own, first = sequence, first, first - 1
        out.append((i, own, sequence - free))
        if free > size:
            bisect.insort(gaps, (free - size, own))
    return out


def place(pieces: DataFrame, sequence: int = SEQUENCE, range_rows: int = RANGE_ROWS,
          few: int = FEW) -> DataFrame:
    """pid, sequence_id and offset of pieces (pid, length), each at most ``sequence`` long.

    A round is one shuffle: the range sort of what the round before left."""
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == sequence).select(
        "pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = pieces.where(F.col("length") < sequence).select(
        F.lit(False).alias("is_gap"), F.col("length").alias("size"), F.col("pid").alias("id"))
    left, tokens = pool.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    folder, rounds, opened, gaps, stuck = scratch_path(spark, "swept"), [], 0, 0, True
    while left > few:
        if stuck:   # the start, or hardly anything fits any more
            new = max(1, int(OPEN_SHARE * -(-tokens // sequence)))
            pool = pool.union(spark.range(opened, opened + new).select(
                F.lit(True), F.lit(sequence).cast("long"), (-F.col("id") - 1)))
            opened, gaps = opened + new, gaps + new
        single = len(rounds) < SINGLE_ROUNDS
        n = max(1, -(-(left + gaps) // range_rows))
        order = [F.desc("size"), F.desc("is_gap"), F.asc("id")]
        path = f"{folder}/round={len(rounds)}"
        pool.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
            partial(_local_sweep, single=single, sequence=sequence), SWEPT).write.parquet(path)
        done = Round(spark.read.schema(SWEPT).parquet(path), single)
        stuck = done.matched <= LEAST_SHARE * min(left, gaps)
        rounds.append(done.across)
        left, tokens, gaps, pool = left - done.matched, tokens - done.tokens, done.gaps, done.rest()
    if left:   # few pieces, and as many gaps
        rest = [(r["id"], r["size"]) for r in pool.where("NOT is_gap").collect()]
        greatest = pool.where("is_gap").orderBy(F.desc("size"), "id").limit(few).collect()
        last = best_fit(rest, [(r["size"], r["id"]) for r in greatest], sequence, -opened - 1)
        full = full.union(spark.createDataFrame(last, "pid long, sequence_id long, offset long"))
    if not rounds:
        return full
    swept = spark.read.schema(f"{SWEPT}, round int").parquet(folder)
    return full.union(_placed(swept, rounds, sequence).select(
        F.col("id").alias("pid"), F.col("bin").alias("sequence_id"), "offset"))


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces with their sequence and the place in it: doc_id, pid, piece, start, length,
    ids (unless told otherwise), ids_crc32, sequence_id, offset."""
    cut = cut_pieces(docs, vocabulary, sequence, end_id)
    cut = stored(cut if with_ids else cut.drop("ids"), "pieces")
    return cut.join(place(cut.select("pid", "length"), sequence), "pid")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids, and doc_ids and starts of their pieces. A group
    holds one sequence's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("starts")))


def packing_report(docs: DataFrame) -> DataFrame:
    """Digest columns per piece."""
    return pack(docs, with_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
