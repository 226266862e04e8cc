"""Language identification by segmentation-marginalised unigrams.

Every language has one probability per piece of a fixed public vocabulary. A word's
probability in a language is the sum, over all ways to cut it into pieces, of the
product of their probabilities; the forward algorithm adds them up from left to right
for all languages, and all words of equal length, at once. A text's score is the sum of
its words' log probabilities, plus the log share of the language in training.

Training is expectation maximisation: forward and backward sums give each piece's
expected count per language, starting from the vocabulary's own (rank-based)
probabilities; two rounds. It is fitted on at most ``per_language`` training documents
of each language, those with the least hash of their id: a bounded sample. The model is
one row per (language, piece) and its size is bounded by languages times vocabulary.

Words are runs of letters, lower-cased. Words beyond 48 letters are scored in pieces of
48 letters. A character without a piece has the same small probability everywhere.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is any
text if nothing could be learned; ties go to the language that sorts first; rows whose
language is null are never learned from; rows of null doc_id are neither held out nor
barred from training; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import WordIds, held_out, in_slices
from tillsight.llm.pieces import SPACE, VOCABULARY, Lattice, by_length, load

PER_LANGUAGE = 4000
ROUNDS = 2
LONGEST_WORD = 48
#: Prior count of each piece, spread by the vocabulary's own probabilities.
PRIOR_COUNT = 2000.0
#: Probability of a character without a piece, and the factor per character that keeps
#: the forward sums in range (taken out again in the logarithm).
UNKNOWN, SCALE = 1e-7, 50.0

_WORD = re.compile(r"[^\W\d_]+")
_lattices: dict = {}


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if len(text) > LONGEST_WORD and any(len(w) > LONGEST_WORD for w in found):
        found = [w[i:i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def _lattice(pieces: list[str]) -> Lattice:
    key = len(pieces), pieces[-1]
    if key not in _lattices:
        _lattices[key] = Lattice(pieces)
    return _lattices[key]


def _forward(piece: list[np.ndarray], p: np.ndarray, length: int) -> np.ndarray:
    """Sums over all segmentations of each prefix: [length + 1, words, languages]."""
    alpha = np.zeros((length + 1, piece[0].shape[1], p.shape[1]))
    alpha[0] = 1
    for end in range(1, length + 1):
        for l in range(1, min(len(piece), end) + 1):
            own = piece[l - 1][end - l]
            at = np.flatnonzero(own >= 0)
            if len(at):
                alpha[end, at] += alpha[end - l, at] * (p[own[at]] * SCALE ** l)
            if l == 1 and len(at) < len(own):
                rest = own < 0
                alpha[end, rest] += alpha[end - 1, rest] * (UNKNOWN * SCALE)
    return alpha


def word_scores(lattice: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    for index, code in by_length([SPACE + w for w in words]):
        length = len(code)
        alpha = _forward(lattice.matches(code), p, length)
        out[index] = np.log(alpha[length]) - length * np.log(SCALE)
    return out


def expected_counts(lattice: Lattice, words: list[str], n: np.ndarray,
                    p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language; n: [words, languages]."""
    out = np.zeros(p.shape)
    for index, code in by_length([SPACE + w for w in words]):
        length = len(code)
        piece = lattice.matches(code)
        alpha = _forward(piece, p, length)
        beta = np.zeros_like(alpha)
        beta[length] = 1
        weight = n[index] / alpha[length]
        for start in range(length - 1, -1, -1):
            for l in range(1, min(len(piece), length - start) + 1):
                own = piece[l - 1][start]
                at = np.flatnonzero(own >= 0)
                if len(at):
                    step = beta[start + l, at] * (p[own[at]] * SCALE ** l)
                    beta[start, at] += step
                    np.add.at(out, own[at], alpha[start, at] * step * weight[at])
                if l == 1 and len(at) < len(own):
                    rest = own < 0
                    beta[start, rest] += beta[start + 1, rest] * (UNKNOWN * SCALE)
    return out


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, per_language: int = PER_LANGUAGE):
    """Languages, log shares and piece probabilities [pieces, languages]."""
    spark = docs.sparkSession
    pieces = load(vocabulary)
    base = np.exp(np.array(pieces["scores"]))
    base /= base.sum()
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n"))
              .collect()}
    langs = sorted(shares)
    if not langs:
        return [], np.zeros(0), np.zeros((len(base), 0)), pieces["pieces"]
    # hashes are uniform: twice the share that is needed surely holds the least ones, so
    # only that many rows of a language are ranked, whatever the table's size
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    most = F.create_map(*[F.lit(x) for l in langs for x in
                          (l, min(1.0, 2 * (per_language + 50) / shares[l]) * 2.0 ** 64 - 2.0 ** 63)])
    chosen = (usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
              .where(F.col("h").cast("double") <= most[F.col("lang")])
              .withColumn("rank", rank).where(F.col("rank") <= per_language)
              .select("doc_id", "lang").distinct())
    sample = (usable.select("doc_id", "lang", "text")
              .join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text"))
    shared_pieces = spark.sparkContext.broadcast(pieces["pieces"])
    p = np.tile(base[:, None], (1, len(langs)))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches, shared=shared):
            lattice, total = _lattice(shared_pieces.value), np.zeros(shared.value.shape)
            for batch in in_slices(batches, "text"):
                ids, n = WordIds(), []
                for text, lang in zip(batch.column("text").to_pylist(),
                                      batch.column("lang").to_pylist()):
                    n.append((ids.add(words_of(text)), langs.index(lang)))
                if not ids.ids:
                    continue
                count = np.zeros((len(ids.ids), len(langs)))
                for own, lang in n:
                    np.add.at(count[:, lang], own, 1)
                total += expected_counts(lattice, list(ids.ids), count, shared.value)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()),
                 pa.array(total[piece, lang])], ["piece", "lang", "n"])

        rows = (sample.mapInArrow(expect, "piece int, lang int, n double")
                .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas())
        count = np.zeros(p.shape)
        count[rows["piece"], rows["lang"]] = rows["n"]
        p = count + PRIOR_COUNT * base[:, None]
        p /= p.sum(axis=0)
    share = np.log(np.array([shares[x] for x in langs]) / sum(shares.values()))
    return langs, share, p, pieces["pieces"]


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred and score (posterior probability) of every document."""
    from pyspark.sql.pandas.types import to_arrow_type
    langs, share, p, pieces = model
    shared = docs.sparkSession.sparkContext.broadcast((share, p, pieces))
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        share, p, pieces = shared.value
        lattice = _lattice(pieces) if langs else None
        for batch in in_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids = WordIds()
            each = [ids.add(words_of(t)) if t else np.empty(0, np.int64) for t in texts]
            score = word_scores(lattice, list(ids.ids), p) if langs else None
            names, values = [], []
            for own in each:
                if not len(own) or not langs:
                    names.append("und")
                    values.append(0.0)
                    continue
                total = share + score[own].sum(axis=0)
                best = int(total.argmax())
                names.append(langs[best])
                values.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(to_arrow_type(kind)), pa.array(names, pa.string()),
                 pa.array(values, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind.simpleString()}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from the rows with crc32(doc_id) mod 5 other than 0; predict all."""
    out = held_out("doc_id", 5, 0)
    model = fit(docs.where(~out).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
