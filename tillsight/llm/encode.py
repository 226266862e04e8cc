"""SentencePiece encoding and decoding by batched Viterbi search.

A text is prefixed by a space and blanks are written as U+2581, as the vocabulary's
model file says (identity normaliser, dummy prefix, byte fallback). Pieces do not reach
over the start of a word, so the distinct words of a slice of documents are segmented
once. Words of equal length advance together: at each end position the best score over
all pieces that end there is a vectorised maximum, whose argument is the backpointer;
of equal scores the longest piece wins. The pieces' scores are log
probabilities (``pieces.load``). A character without a piece costs the least score less ten and is written as its bytes.

Edge cases: a null or empty text has no ids and decodes to the empty text; the
character U+2581 itself is always written as bytes, so that decoding restores every
text; white space other than the blank is ordinary text; an empty table gives no rows;
extra columns pass through, ``ids`` and ``decoded`` are replaced. Very long words, of
which there are few of one length, are searched one by one (a million characters without
a blank take seconds).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import WordIds, give_back, in_slices, quoted, with_results
from tillsight.llm.pieces import SPACE, VOCABULARY, Lattice, by_length, load, ragged

UNKNOWN_PENALTY = 10.0
SLICE_BYTES = 3 << 20
#: Words beyond this length, so few of one length, are searched one by one.
LONG_WORD, FEW_WORDS = 256, 4
#: Stands for a U+2581 of the text itself: a lone surrogate, which no text can hold.
_LITERAL = "\ud800"

_WORDS = re.compile(r" +[^ ]*")
_WHOLE = re.compile(r"(?s).+")
_NOTHING = np.iinfo(np.int64).min
_made: dict = {}


class Encoder:
    def __init__(self, vocabulary: dict):
        self.lattice = Lattice(vocabulary["pieces"])
        self.scores = np.array(vocabulary["scores"] + [-np.inf])  # -1: no piece
        self.unknown = min(vocabulary["scores"]) - UNKNOWN_PENALTY
        self.ids = np.array(vocabulary["ids"], np.int32)
        self.byte_ids = np.array([vocabulary["bytes"][b] for b in range(256)], np.int32)
        raw = [b""] * vocabulary["size"]
        for i, p in zip(vocabulary["ids"], vocabulary["pieces"]):
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in vocabulary["bytes"].items():
            raw[i] = bytes([b])
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        sizes = np.zeros(len(words), np.int64)
        parts = []
        for index, code in by_length(words):
            length, n = code.shape
            piece = self.lattice.matches(code)
            if n <= FEW_WORDS and length > LONG_WORD:
                chosen = np.stack([self._long(code[:, i], [p[:, i] for p in piece]) for i in range(n)])
                row, _ = np.nonzero(chosen != _NOTHING)
                sizes[index] = np.bincount(row, minlength=n)
                parts.append((index, chosen[chosen != _NOTHING]))
                continue
            best = np.full((length + 1, n), -np.inf)
            best[0] = 0
            back = np.zeros((length + 1, n), np.int8)
            for end in range(1, length + 1):
                top, own_back = best[end], back[end]
                for l in range(min(len(piece), end), 0, -1):
                    own = piece[l - 1][end - l]
                    if l == 1:
                        score = np.where(own < 0, self.unknown, self.scores[own])
                        score += best[end - 1]
                        at = np.flatnonzero(score > top)
                        top[at] = score[at]
                    else:
                        at = np.flatnonzero(own >= 0)
                        if not len(at):
                            continue
                        score = best[end - l][at] + self.scores[own[at]]
                        better = score > top[at]
                        at = at[better]
                        top[at] = score[better]
                    own_back[at] = l
            # walk back, all words of the matrix together, to the pieces' starts
            rows, ends = np.arange(n), np.full(n, length)
            chosen = np.full((n, length), _NOTHING, np.int64)
            while len(rows):
                l = back[ends, rows].astype(np.int64)
                start = ends - l
                own = np.empty(len(rows), np.int64)
                for size in np.unique(l):
                    at = np.flatnonzero(l == size)
                    own[at] = piece[size - 1][start[at], rows[at]]
                odd = own < 0
                own[odd] = -1 - code[start[odd], rows[odd]].astype(np.int64)
                chosen[rows, start] = own
                more = start > 0
                rows, ends = rows[more], start[more]
            row, _ = np.nonzero(chosen != _NOTHING)
            sizes[index] = np.bincount(row, minlength=n)
            parts.append((index, chosen[chosen != _NOTHING]))
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(sizes.sum(), np.int64)
        for index, own in parts:
            flat[ragged(starts[index], sizes[index])] = own
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return self.ids[flat], sizes
        spelt = [self._spell(int(-1 - flat[i])) for i in odd]
        many = np.ones(len(flat), np.int64)
        many[odd] = [len(s) for s in spelt]
        out = np.repeat(self.ids[np.maximum(flat, 0)], many)
        at = (np.cumsum(many) - many)[odd]
        out[ragged(at, many[odd])] = np.concatenate(spelt)
        word = np.repeat(np.arange(len(words)), sizes)
        return out, np.bincount(word, weights=many, minlength=len(words)).astype(np.int64)

    def _long(self, code: np.ndarray, piece: list[np.ndarray]) -> np.ndarray:
        """The best pieces of one long word, at their starts: the same search, a place at a
        time over the pieces that end there, since a matrix of one row gains nothing."""
        size, unknown, scores = len(code), self.unknown, self.scores.tolist()
        ends, lengths, found = [np.arange(1, size + 1)], [np.ones(size, np.int64)], [piece[0]]
        for l in range(2, len(piece) + 1):
            at = np.flatnonzero(piece[l - 1] >= 0)
            ends.append(at + l), lengths.append(np.full(len(at), l)), found.append(piece[l - 1][at])
        ends, lengths, found = (np.concatenate(x) for x in (ends, lengths, found))
        order = np.lexsort((-lengths, ends))   # by end, the longest first
        lengths, found = lengths[order].tolist(), found[order].tolist()
        stops = np.cumsum(np.bincount(ends, minlength=size + 1)).tolist()
        best, back = [0.0] * (size + 1), [0] * (size + 1)
        for end in range(1, size + 1):
            top, own = -np.inf, 0
            for i in range(stops[end - 1], stops[end]):
                score = best[end - lengths[i]] + (scores[found[i]] if found[i] >= 0 else unknown)
                if score > top:
                    top, own = score, i
            best[end], back[end] = top, own
        chosen, end = np.full(size, _NOTHING, np.int64), size
        while end:
            i = back[end]
            end -= lengths[i]
            chosen[end] = found[i] if found[i] >= 0 else -1 - int(code[end])
        return chosen

    def _spell(self, code: int):
        char = SPACE if code == ord(_LITERAL) else chr(code)
        return self.byte_ids[list(char.encode())]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        known = WordIds()
        split = _WORDS if self.lattice.words_apart else _WHOLE
        each = [known.add(split.findall(" " + t.replace(SPACE, _LITERAL) if t else ""))
                for t in texts]
        ids, sizes = self.words([w.replace(" ", SPACE) for w in known.ids])
        starts = np.cumsum(sizes) - sizes
        word = np.concatenate(each) if each else np.empty(0, np.int64)
        out = ids[ragged(starts[word], sizes[word])]
        number = np.array([int(sizes[w].sum()) for w in each], np.int64)
        return out, number

    def decode(self, ids: np.ndarray, numbers: np.ndarray) -> list[bytes]:
        sizes = self.raw_size[ids]
        flat = self.raw[ragged(self.raw_start[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(numbers)])]
        return [flat[a + 1:b] if b > a else b"" for a, b in zip(ends, ends[1:])]


def _encoder(shared) -> Encoder:
    key = shared.value["pieces"][-1], shared.value["size"]
    if key not in _made:
        _made[key] = Encoder(shared.value)
    return _made[key]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] | None = None,
           check: bool = False) -> DataFrame:
    """The documents' columns (or those to ``keep``) with ``ids``; with ``check`` also
    ``restored``: whether decoding the ids gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    new = ["ids", "restored"] if check else ["ids"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in new]
    given = docs.select(*map(quoted, dict.fromkeys([*columns, "text"])))

    def run(batches):
        encoder = _encoder(shared)
        for batch in in_slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, numbers = encoder.texts(texts)
            ends = np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)
            out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            if check:
                out.append(pa.array([t.encode() == back for t, back in
                                     zip(texts, encoder.decode(ids, numbers))], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out],
                                             [*columns, *new])
            del texts, ids, numbers, out
            give_back()

    types = {"ids": "array<int>", "restored": "boolean"}
    return given.mapInArrow(run, with_results(docs, columns, {c: types[c] for c in new}))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with ``decoded``, the text of their ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))
    columns = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        encoder = _encoder(shared)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                column = batch.column("ids").fill_null([])
                numbers = np.diff(column.offsets.to_numpy())
                texts = encoder.decode(column.flatten().to_numpy(), numbers)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns),
                     pa.array(texts, pa.binary()).cast(pa.string())], [*columns, "decoded"])

    return encoded.select(*map(quoted, columns)).mapInArrow(
        run, with_results(encoded, columns, {"decoded": "string"}))


def encoding_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding them gives the text back. Encoding and
    decoding share one pass, so that texts and ids travel to Python and back once."""
    done = encode(docs, vocabulary, keep=["doc_id"], check=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")
