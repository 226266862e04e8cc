"""Alignment of two tokenizers' tokens by sparse incidence products.

A text, with a blank before it, is encoded by a byte-level vocabulary (A) and by a piece
vocabulary (B). The token-byte incidence matrices A and B (a row a token, a column a byte
of the text) are held in compressed sparse rows. Gustavson's row products A·Bᵀ give the
overlap links: pairs of tokens with the number of bytes they share. Where no link reaches
over, a token of A and one of B end at the same byte, and a group ends. The products of
the group-incidence matrices (a row a token, a column a group) give the shared-group
links: all pairs of tokens of a group. Corpus-wide, an id pair counts the documents that hold it
linked.

Texts of a slice share their distinct words (``wordwise``), and every word's end is the
end of a group, so the products are formed once a distinct word. A slice holds one entry
per distinct id pair, with its documents; these are added up by pair, and the sums joined
back to the slices that hold the pair. Slices are rows of a stored table, cut from the
scan as it comes: no text is shuffled and no copies, source or key can fill one.

Edge cases: a null or empty text, or one whose tokens do not spell the text (one with a
U+2581 of its own), has no tokens, groups or links; repeated rows and null ids are
documents of their own, each counted; very long texts and words are handled whole, and a
group's links are as many as its tokens multiplied; strings of special tokens are plain
text; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import U64, in_slices, packed, quoted, unpacked, with_results
from tillsight.llm.graph import stored
from tillsight.llm.pieces import ragged
from tillsight.llm.wordwise import BYTE_BPE, PIECE_BPE, Slice, byte_bpe, piece_bpe, public_path

SLICE_BYTES = 2 << 20
#: Terms of a product formed at a time.
CELLS = 1 << 22


class Csr:
    """A sparse matrix in compressed rows: row r's columns are
    ``indices[indptr[r]:indptr[r + 1]]``, its values those of ``data``."""

    def __init__(self, indptr, indices, data, columns: int):
        self.indptr, self.indices, self.data, self.columns = indptr, indices, data, columns

    @classmethod
    def incidence(cls, sizes: np.ndarray, indices: np.ndarray, columns: int) -> Csr:
        """Ones at each row's given columns; ``sizes`` holds the rows' lengths."""
        return cls(np.concatenate([[0], np.cumsum(sizes)]), indices, np.ones(len(indices), np.int64), columns)

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transpose(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        row = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), row[order], self.data[order], self.rows)

    def times(self, other: Csr, cells: int = CELLS) -> Csr:
        """Gustavson's product: row r of the result adds up the other's rows named by row
        r's columns. Rows are taken together while their terms number about ``cells``."""
        terms = np.diff(other.indptr)[self.indices]
        load = np.concatenate([[0], np.cumsum(terms)])[self.indptr]
        counts, indices, data, a = np.zeros(self.rows, np.int64), [], [], 0
        while a < self.rows:
            b = max(a + 1, int(np.searchsorted(load, load[a] + cells, "right")) - 1)
            i, j = self.indptr[a], self.indptr[b]
            own = terms[i:j]
            at = ragged(other.indptr[self.indices[i:j]], own)
            row = np.repeat(np.repeat(np.arange(b - a), np.diff(self.indptr[a:b + 1])), own)
            value = np.repeat(self.data[i:j], own) * other.data[at]
            cell = row * other.columns + other.indices[at]
            if (np.diff(cell) < 0).any():
                order = np.argsort(cell, kind="stable")
                cell, value = cell[order], value[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            if len(first):
                indices.append(cell[first] % other.columns)
                data.append(np.add.reduceat(value, first))
                counts[a:b] = np.bincount(cell[first] // other.columns, minlength=b - a)
            a = b
        empty = np.empty(0, np.int64)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), np.concatenate([empty, *indices]),
                   np.concatenate([empty, *data]), other.columns)


class Words:
    """Tokens, groups and links of a list of words, one after the other."""

    def __init__(self, names: list[str], bpe, pieces):
        spelt = [n.encode() for n in names]
        length = np.array([len(s) for s in spelt], np.int64)
        self.a, many_a = bpe.encode(names)
        self.b, many_b = pieces.encode(names)
        size_a, size_b = bpe.size[self.a], pieces.size[self.b]
        # words whose tokens do not spell them; their tokens leave
        flat = np.frombuffer(b"".join(spelt), np.uint8)
        good = (spells(bpe, self.a, many_a, flat, length) & spells(pieces, self.b, many_b, flat, length))
        self.good = good
        keep_a, keep_b = np.repeat(good, many_a), np.repeat(good, many_b)
        self.a, size_a, many_a = self.a[keep_a], size_a[keep_a], many_a * good
        self.b, size_b, many_b = self.b[keep_b], size_b[keep_b], many_b * good
        self.many_a, self.many_b = many_a, many_b
        # A·Bᵀ of the token-byte incidence matrices: bytes that two tokens share
        every = np.arange(int(size_a.sum()))
        self.overlaps = Csr.incidence(size_a, every, len(every)).times(
            Csr.incidence(size_b, every, len(every)).transpose())
        # a group ends where a token of A and the next one overlap no common token of B
        row = np.repeat(np.arange(len(self.a)), np.diff(self.overlaps.indptr))
        first = self.overlaps.indices[self.overlaps.indptr[:-1]]
        last = self.overlaps.indices[self.overlaps.indptr[1:] - 1]
        self.group_a = np.concatenate([np.zeros(min(1, len(first)), np.int64), np.cumsum(first[1:] > last[:-1])])
        self.group_b = np.zeros(len(self.b), np.int64)
        self.group_b[self.overlaps.indices] = self.group_a[row]
        self.groups = int(self.group_a[-1]) + 1 if len(first) else 0
        word = np.repeat(np.arange(len(names)), many_a)
        fresh = np.diff(self.group_a, prepend=-1) != 0   # a word's end ends a group
        self.n_groups = np.bincount(word[fresh], minlength=len(names))

    def links(self) -> Csr:
        """The product of the group-incidence matrices: pairs of tokens that share a group."""
        one_a, one_b = np.ones(len(self.a), np.int64), np.ones(len(self.b), np.int64)
        return Csr.incidence(one_a, self.group_a, self.groups).times(
            Csr.incidence(one_b, self.group_b, self.groups).transpose())

    def id_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, id pair, links) for every distinct id pair of each word."""
        links = self.links()
        row = np.repeat(np.arange(links.rows), np.diff(links.indptr))
        pair = self.a[row].astype(U64) << U64(32) | self.b[links.indices].astype(U64)
        word = np.repeat(np.arange(len(self.many_a)), self.many_a)[row]
        order = np.lexsort((pair, word))
        word, pair = word[order], pair[order]
        first = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(pair, prepend=pair[:1] + U64(1)) != 0))
        return word[first], pair[first], np.diff(np.append(first, len(word)))

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' groups as ``a1,a2|b1;a3|b2,b3;`` in one buffer, with each word's place
        and length there."""
        # tokens in order of groups, those of A first; a mark follows each
        place_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")
        place_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        ids, mark = (np.empty(len(self.a) + len(self.b), t) for t in (np.int64, np.uint8))
        for place, own, group, last in ((place_a, self.a, self.group_a, b"|"), (place_b, self.b, self.group_b, b";")):
            ids[place] = own
            mark[place] = np.where(np.diff(group, append=-1) == 0, b","[0], last[0])
        most = int(ids.max(initial=0)) + 1
        digits = [b"%d," % i for i in range(most)]
        size = np.array([len(d) for d in digits], np.int64)
        start = np.cumsum(size) - size
        out = np.frombuffer(b"".join(digits), np.uint8)[ragged(start[ids], size[ids])]
        ends = np.cumsum(size[ids])
        out[ends - 1] = mark
        tokens = np.cumsum(self.many_a + self.many_b)   # of the words up to each
        stops = np.concatenate([[0], ends])[tokens]
        lengths = np.diff(stops, prepend=0)
        return out, stops - lengths, lengths


def spells(vocabulary, ids: np.ndarray, many: np.ndarray, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each word's ids give the bytes of the word; ``flat`` holds all words' bytes."""
    raw, size = vocabulary.flat, vocabulary.size
    start = np.cumsum(size) - size
    ends = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(many)]
    fits = np.diff(ends, prepend=0) == length
    some = np.repeat(fits, many)
    own = raw[ragged(start[ids[some]], size[ids[some]])]
    differs = np.flatnonzero(own != flat[np.repeat(fits, length)])
    word = np.repeat(np.flatnonzero(fits), length[fits])
    fits[word[differs]] = False
    return fits


def _loaders(byte_path: str | None, piece_path: str | None):
    one, two = byte_path or public_path(BYTE_BPE), piece_path or public_path(PIECE_BPE)
    return lambda: (byte_bpe(one, specials_are_text=True), piece_bpe(two))


def _aligned(texts: list[str], bpe, pieces) -> tuple[list[np.ndarray], Words]:
    """The slice's words, and each text's word numbers: none where the tokens do not spell it."""
    cut = Slice(texts)
    words = Words(cut.names, bpe, pieces)
    none = np.empty(0, np.int64)
    return [w if t and words.good[w].all() else none for t, w in zip(texts, cut.each)], words


def alignments(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """The documents' columns with a_ids, b_ids, groups (numbers of A and B tokens of each
    group) and overlaps (positions of an A and a B token and the bytes they share)."""
    load = _loaders(byte_path, piece_path)
    new = {"a_ids": "array<int>", "b_ids": "array<int>", "groups": "array<struct<a:int,b:int>>",
           "overlaps": "array<struct<a:int,b:int,bytes:int>>"}
    docs = docs.select(*(quoted(c) for c in docs.columns if c not in new))
    given = packed(docs)
    columns = given.columns

    def run(batches):
        bpe, pieces = load()
        for batch in in_slices(batches, "text", SLICE_BYTES):
            each, words = _aligned([t or "" for t in batch.column("text").to_pylist()], bpe, pieces)
            over = words.overlaps
            start_a, start_b = (np.cumsum(m) - m for m in (words.many_a, words.many_b))
            start_g = np.cumsum(words.n_groups) - words.n_groups
            size_a = np.bincount(words.group_a, minlength=words.groups)
            size_b = np.bincount(words.group_b, minlength=words.groups)
            out = [[], [], [], []]
            for own in each:
                many_a, many_b = words.many_a[own], words.many_b[own]
                tokens = ragged(start_a[own], many_a)
                out[0].append(words.a[tokens])
                out[1].append(words.b[ragged(start_b[own], many_b)])
                group = ragged(start_g[own], words.n_groups[own])
                out[2].append([{"a": int(x), "b": int(y)} for x, y in zip(size_a[group], size_b[group])])
                shift = np.repeat(np.cumsum(many_b) - many_b - start_b[own], many_a)
                count = (over.indptr[1:] - over.indptr[:-1])[tokens]
                at = ragged(over.indptr[tokens], count)
                left, right = np.repeat(np.arange(len(tokens)), count), over.indices[at] + np.repeat(shift, count)
                out[3].append([{"a": int(x), "b": int(y), "bytes": int(z)}
                               for x, y, z in zip(left, right, over.data[at])])
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()),
                     pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])),
                     pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *map(pa.array, out, kinds)], [*columns, *new])

    found = given.mapInArrow(run, with_results(given, columns, new))
    return unpacked(found, docs, new)


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    """The smallest unsigned type that holds the values, and their bytes in it."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.str, x.astype(kind).tobytes()


ENTRY = pa.struct([("kind", pa.string()), ("body", pa.binary())])


def slices(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """One stored row per slice: its documents' digests, its distinct id pairs with the
    number of documents that hold each, and every document's pairs (places in that list)
    with their links."""
    load = _loaders(byte_path, piece_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe, pieces = load()
        number = TaskContext.get().partitionId() << 32
        for batch in in_slices(batches, "text", SLICE_BYTES):
            each, words = _aligned([t or "" for t in batch.column("text").to_pylist()], bpe, pieces)
            word, pair, links = words.id_pairs()
            pairs, index = np.unique(pair, return_inverse=True)
            count = np.bincount(word, minlength=len(words.good))
            start = np.cumsum(count) - count
            groups, place, length = words.texts()
            held, numbers, digests, entries = np.zeros(len(pairs), np.int64), [], [], []
            for own in each:
                at = ragged(start[own], count[own])
                own_pair, back = np.unique(index[at], return_inverse=True)
                total = np.zeros(len(own_pair), np.int64)
                np.add.at(total, back, links[at])
                held[own_pair] += 1
                entries.append((own_pair, total))
                text = groups[ragged(place[own], length[own])][:-1]   # no mark at the end
                digests.append(hashlib.sha256(text).hexdigest() if len(own) else "")
                numbers += [*(int(x[own].sum()) for x in (words.many_a, words.many_b, words.n_groups)),
                            int(total.sum())]
            held_by = [_narrow(np.concatenate([np.empty(0, np.int64), *x])) for x in zip(*entries)]
            sizes = _narrow(np.array([len(x) for x, _ in entries], np.int64))
            packs = [dict(zip(("kind", "body"), x)) for x in (sizes, *held_by)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()),
                 pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.column("doc_id").type)),
                 pa.array([numbers], pa.list_(pa.int64())), pa.array([digests], pa.list_(pa.string())),
                 pa.array([pairs.view(np.int64)], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64())),
                 pa.array([packs], pa.list_(ENTRY))],
                ["grp", "doc_id", "numbers", "digests", "pairs", "held", "entries"])
            number += 1

    return stored(docs.select("doc_id", "text").mapInArrow(
        run, f"grp long, doc_id array<{kind}>, numbers array<long>, digests array<string>, pairs array<long>, "
             "held array<long>, entries array<struct<kind:string,body:binary>>"), "alignments")


def pair_counts(cut: DataFrame) -> DataFrame:
    """pair (A id times 2**32 plus B id), n (documents that hold it linked) and best: whether
    n is the highest of its A id. Counts are added up before any shuffle."""
    pairs = (cut.select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
             .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n")))
    pairs = stored(pairs, "pairs").withColumn("a", F.shiftright("pair", 32))
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))  # at most the vocabulary's size
    return pairs.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_report(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best (links whose count is their A id's
    highest), count_sum (counts over all links) and groups_sha256."""
    cut = slices(docs, byte_path, piece_path)
    asked = cut.select(F.col("grp").alias("to"), F.posexplode("pairs").alias("pos", "pair"))
    answers = asked.join(pair_counts(cut), "pair").select("to", "pos", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def finish(key, own, answers):
        pos = answers.column("pos").to_numpy()
        count, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        count[pos] = answers.column("n").to_numpy()
        best[pos] = answers.column("best").to_numpy()
        own = own.to_pylist()[0]
        sizes, index, links = (np.frombuffer(e["body"], e["kind"]).astype(np.int64) for e in own["entries"])
        doc, sums = np.repeat(np.arange(len(sizes)), sizes), []
        for value in (best, count):
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, doc, links * value[index])
            sums.append(total)
        numbers = np.array(own["numbers"], np.int64).reshape(-1, 4).T
        return pa.table([pa.array(own["doc_id"], finish.doc_id), *map(pa.array, [*numbers, *sums]),
                         pa.array(own["digests"], pa.string())], ["doc_id", *columns, "groups_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type
    finish.doc_id = to_arrow_type(docs.schema["doc_id"].dataType)
    return (cut.drop("pairs", "held").groupBy("grp").cogroup(answers.groupBy("to"))
            .applyInArrow(finish, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in columns)
                          + ", groups_sha256 string"))
