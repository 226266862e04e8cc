"""Lattices of a fixed public piece vocabulary over words, in numpy.

Words of equal length form one matrix of code points and advance together. The hash
of every substring of up to the longest piece's length is built one character at a
time and probed in the sorted hashes of the pieces; a hit is confirmed on the code
points themselves.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from tillsight.llm.common import U64, mix

SPACE = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Cells (words times characters) of one matrix.
CELLS = 1 << 16
ZIPF_OFFSET = 10

_FACTOR = U64(0x9E3779B97F4A7C15)


def load(path: str = VOCABULARY) -> dict:
    """Pieces with scores, ids and byte ids of a model file (bounded: the vocabulary).

    A BPE file holds merge ranks, not probabilities. Its pieces get the log of
    Zipf-Mandelbrot probabilities 1 / (rank + 10), normalised; a unigram file's scores
    are taken as they are.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    bytes_of = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
    normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i)
                                     or model.is_unknown(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in normal])
    if (scores == np.round(scores)).all():  # ranks
        rank = np.argsort(np.argsort(-scores, kind="stable"))
        scores = -np.log(rank + ZIPF_OFFSET) - np.log((1 / (rank + ZIPF_OFFSET)).sum())
    return {"pieces": [model.id_to_piece(i) for i in normal], "ids": normal,
            "scores": scores.tolist(), "bytes": bytes_of, "size": model.get_piece_size()}


class Lattice:
    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.code = np.zeros((len(pieces), self.longest), np.uint32)
        self.length = np.array([len(p) for p in pieces], np.int64)
        for i, p in enumerate(pieces):
            self.code[i, :len(p)] = [ord(c) for c in p]
        key = np.zeros(len(pieces), U64)
        for i in range(self.longest):
            key = np.where(self.length > i, key * _FACTOR + self.code[:, i] + U64(1), key)
        key = mix(key)
        self.order = np.argsort(key)
        self.keys = key[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.filter = np.zeros(1 << 20, bool)
        self.filter[key >> U64(44)] = True
        inner = [p for p in pieces if SPACE in p[1:] and p.strip(SPACE)]
        self.words_apart = not inner  # no piece reaches from a word into the next

    def matches(self, code: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece (or -1) at each start: arrays [starts, words]."""
        size, n = code.shape
        code = code.astype(U64) + U64(1)
        out, h = [], np.zeros((size, n), U64)
        for l in range(1, min(self.longest, size) + 1):
            h = h[:size - l + 1] * _FACTOR
            h += code[l - 1:]
            key = mix(h.copy())
            found = np.full(key.shape, -1, np.int32)
            place = np.flatnonzero(self.filter[key >> U64(44)])
            k = key.reshape(-1)[place]
            at = np.searchsorted(self.keys, k)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == k
            place, piece = place[hit], self.order[at[hit]]
            same = self.length[piece] == l
            flat = code.reshape(-1)
            for i in range(l):
                same &= self.code[piece, i] == flat[place + i * n] - U64(1)
            found.reshape(-1)[place[same]] = piece[same]
            out.append(found)
        return out


def by_length(words: list[str]):
    """Yield (indices, code points [length, words]) of words of equal length."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for size, index in groups.items():
        if not size:
            continue
        step = max(1, CELLS // size)
        for a in range(0, len(index), step):
            own = index[a:a + step]
            code = np.frombuffer("".join([words[i] for i in own]).encode("utf-32-le",
                                 "surrogatepass"), np.uint32)
            yield np.array(own), np.ascontiguousarray(code.reshape(len(own), size).T)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + size), one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())
