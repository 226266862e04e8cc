"""Token ids by public libraries: of whole texts, and of their distinct words.

The byte-level vocabulary is read from its ``tokenizers`` file. Where that file says no
more than the plain scheme does (its usual pattern, ids in the order of merges),
``tiktoken`` encodes with the same vocabulary, to equal ids in a quarter of the time;
tests compare the two over all code points. Any other file is left to ``tokenizers``.

For pieces of two vocabularies side by side, a text is cut before a blank that follows a letter, digit or visible ASCII character. No
token of the byte-level vocabulary reaches over such a place (its pattern lets a blank
begin a word, never continue one), nor does any piece of the other one (checked when it
is loaded). So a text's ids are those of its words, one after the other, and each
distinct word of a slice of texts is encoded once by the public libraries.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from tillsight.llm.common import WordIds
from tillsight.llm.pieces import SPACE, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
JOINED = 500
# Fixed value: the usual pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOOSE = re.compile(r"(?:^|[^\x21-\x7e\w]) ")
_PLACE = re.compile(r"(?<=[\x21-\x7e\w]) ")
_made: dict = {}


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def cut(text: str) -> list[str]:
    """The words of a text; joined by blanks they give the text."""
    return _PLACE.split(text) if _LOOSE.search(text) else text.split(" ")


def _ends_well(word: str) -> bool:
    return bool(word) and ("!" <= word[-1] <= "~" or word[-1].isalnum() or word[-1] == "_")


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: visible ones of Latin-1 stand
    for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _is_plain(given: dict, specials: dict) -> bool:
    """Whether a file's ids are those of rank-ordered byte-level merges behind the usual
    pattern, with special tokens that neither trim nor normalise."""
    before, model = given.get("pre_tokenizer") or {}, given["model"]
    ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
    return (given.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and model.get("type", "BPE") == "BPE"
            and not model.get("dropout") and not model.get("ignore_merges") and None not in ids
            and all(a < b for a, b in zip(ids, ids[1:]))
            and len(model["vocab"]) - sum(t in model["vocab"] for t in specials) == len(ids) + 256
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]
                        for t in given["added_tokens"]))


class ByteBpe:
    """Texts to ids; ``raw`` holds each id's bytes."""

    def __init__(self, path: str, specials_are_text: bool = False, plain: bool | None = None):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        specials = {t["content"]: t["id"] for t in given["added_tokens"]}
        byte = byte_alphabet()
        vocabulary = given["model"]["vocab"] | specials
        self.raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = token.encode() if token in specials else bytes(byte.get(c, 63) for c in token)
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.model = self.fast = None
        if _is_plain(given, specials) if plain is None else plain:
            import tiktoken
            ranks = {self.raw[i]: i for t, i in given["model"]["vocab"].items() if t not in specials}
            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks,
                                          special_tokens={} if specials_are_text else specials)
        else:
            from tokenizers import Tokenizer
            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = specials_are_text

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.fast:
            return [self.fast.encode_to_numpy(t, allowed_special="all", disallowed_special=()).astype(np.int32)
                    for t in texts]
        return [np.array(d.ids, np.int32) for d in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each. Words that
        begin with a blank and end well are encoded several in a string, then cut apart."""
        known = [i for i, w in enumerate(words) if w[:1] == " " and _ends_well(w)]
        alone = sorted(set(range(len(words))).difference(known))
        joined = [known[a:a + JOINED] for a in range(0, len(known), JOINED)]
        ids = self.whole(["".join([words[i] for i in own]) for own in joined] + [words[i] for i in alone])
        numbers = np.zeros(len(words), np.int64)
        for own, x in zip(joined, ids):
            ends = np.cumsum(self.size[x])
            stops = np.cumsum([len(words[i].encode()) for i in own])
            at = np.searchsorted(ends, stops) + 1
            if (ends[at - 1] != stops).any():
                raise ValueError("a token reaches over a word's end")
            numbers[own] = np.diff(at, prepend=0)
        numbers[alone] = [len(x) for x in ids[len(joined):]]
        order = np.array([*known, *alone], np.int64)
        flat = np.concatenate([np.empty(0, np.int32), *ids])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(numbers[order]) - numbers[order]
        return flat[ragged(starts, numbers)], numbers


class PieceBpe:
    """Words (each with the blank before it) to ids by ``sentencepiece``."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any(SPACE in p[1:] and p.strip(SPACE) for p in pieces):
            raise ValueError("a piece reaches from a word into the next")
        self.raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b""
                    if self.model.is_control(i) or self.model.is_unknown(i)
                    else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.blank = self.model.piece_to_id(SPACE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library adds the blank that each word here begins with; it gives no ids for
        an empty text, so a blank alone is written as its piece."""
        ids = self.model.encode([w[1:] for w in words], num_threads=1)
        for i, w in enumerate(words):
            if w == " ":
                ids[i] = [self.blank]
        numbers = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.int32, int(numbers.sum())), numbers


def byte_bpe(path: str, specials_are_text: bool = False) -> ByteBpe:
    """Loaded once per Python worker."""
    key = path, specials_are_text
    if key not in _made:
        _made[key] = ByteBpe(path, specials_are_text)
    return _made[key]


def piece_bpe(path: str) -> PieceBpe:
    if path not in _made:
        _made[path] = PieceBpe(path)
    return _made[path]


class Slice:
    """A slice of texts as numbers of their distinct words (each with the blank before
    it), which ``names`` lists in order."""

    def __init__(self, texts: list[str]):
        known = WordIds()
        self.each = [known.add([" " + w for w in cut(t)]) for t in texts]
        self.names = list(known.ids)
