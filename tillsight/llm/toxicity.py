"""Toxicity by maximum-scoring segments.

*Tokens* are words and their first four characters; a word scores the higher of both. A
token's score is its log-odds between toxic and clean documents, counted once per
document, with a Dirichlet prior of half a document per token, taken one standard error
towards zero. The model holds at most ``max_tokens`` tokens (a documented bound): those
that mark toxic documents, occur in at least four documents and in one toxic document of
500, score at least two nats and have the largest z of at least ``least_z``; any other
token scores 0. Each token costs half a nat, so a passage must earn its length.

*Segments.* One linear scan finds all maximal scoring segments (Ruzzo and Tompa). For
most texts a vectorised running minimum shows that no segment can be significant; the
full scan is needed only for the others.

*Calibration.* The best segment of n tokens of clean text follows an extreme-value law:
lambda solves E[exp(lambda s)] = 1 for clean tokens, and lambda S - ln n is Gumbel
distributed; its two parameters are fitted to clean documents that took no part in the
counts. A document's evidence is the sum of -ln p over its significant passages
(p < 0.05), or of its best one, and a logistic curve turns it into a probability.

Counts come from labelled training rows whose crc32(doc_id) mod 5 is 1, 2 or 3, the
calibration from those with 4; remainder 0 is never learned from. At most
``max_rows`` labelled rows are learned from, those with the least hash of their id (a
documented bound, so that they may be broadcast).

Edge cases: a null or empty text has no tokens, no passages and the score of evidence 0;
with no labelled rows of both classes every score is the share of toxic rows, or 0;
several labels of an id count as toxic if one is; a null label is no label; rows of null
doc_id have no label; repeated rows are scored alike; an empty table gives no rows.
Extra columns pass through, those named like a result column are replaced (by
``drop_toxic`` they are kept).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import (
    WordIds, held_out, in_slices, packed, quoted, texts_of, unpacked, with_results)

MAX_ROWS, MAX_TOKENS = 60_000, 100_000
LEAST_Z, LEAST_DOCS, LEAST_SHARE, LEAST_SCORE = 2.5, 4, 0.002, 2.0
PRIOR, COST, PREFIX = 0.5, 0.5, 4
SIGNIFICANT = 0.05
RESULT = {"score": "double", "predicted": "int",
          "passages": "array<struct<first:int,last:int,p:double>>"}

#: A-Z lower-cased, ASCII other than letters and digits blank.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
                else 32 for c in range(256))


def prefix_of(word: bytes) -> bytes:
    return b"^" + word.decode().encode("utf-32-le")[:4 * PREFIX]


def tokenise(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    ids = WordIds()
    each = [ids.add(t.translate(_NORMAL).split()) for t in texts]
    return list(ids.ids), each


def word_values(words: list[bytes], model: dict[bytes, float]) -> np.ndarray:
    get = model.get
    return np.array([max(get(w, 0.0), get(prefix_of(w), 0.0)) for w in words]) - COST


def best_segment(s: np.ndarray) -> float:
    """The greatest sum of consecutive scores, at least 0."""
    if not len(s):
        return 0.0
    total = np.cumsum(s)
    floor = np.minimum(np.minimum.accumulate(np.concatenate([[0.0], total[:-1]])), total)
    return float(max(0.0, (total - floor).max()))


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, sum), by one scan from the left.

    Only runs of scores of one sign matter, so runs are joined first. ``held`` keeps
    candidate segments with the totals before and behind each; a new positive run either
    stands alone, or is joined with the nearest earlier candidate that begins lower, if
    none in between ends higher.
    """
    if not len(s):
        return []
    cut = np.flatnonzero(np.diff(s > 0)) + 1
    starts = np.concatenate([[0], cut])
    sums = np.add.reduceat(s, starts).tolist()
    ends = np.concatenate([cut, [len(s)]]).tolist()
    held: list[tuple[int, int, float, float]] = []
    total = 0.0
    for a, b, x in zip(starts.tolist(), ends, sums):
        if x <= 0:
            total += x
            continue
        first, low, high = a, total, total + x
        total = high
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j -= 1
            if j < 0 or held[j][3] >= high:
                held.append((first, b - 1, low, high))
                break
            first, low = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, high - low) for a, b, low, high in held]


def gumbel_p(x, place: float, width: float):
    """Probability of a value of at least x."""
    return -np.expm1(-np.exp(-np.clip((np.asarray(x, float) - place) / width, -30, 30)))


def evidence(s: np.ndarray, law: dict) -> tuple[float, list[tuple[int, int, float]]]:
    """-ln p summed over significant passages, or of the best, and these passages."""
    if not len(s):
        return 0.0, []
    n = np.log(len(s))
    p = lambda x: max(1e-12, float(gumbel_p(law["rate"] * x - n, law["place"], law["width"])))
    best = p(best_segment(s))
    if best >= SIGNIFICANT:
        return -np.log(best), []
    found = [(a, b, p(x)) for a, b, x in segments(s)]
    found = [f for f in found if f[2] < SIGNIFICANT]
    return float(sum(-np.log(f[2]) for f in found)), found


def _rate(s: np.ndarray) -> float:
    """lambda with mean exp(lambda s) = 1; scores must be negative on average."""
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(np.clip(mid * s, -700, 700)).mean() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and constant of a logistic curve (smoothed targets, Newton steps)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * x).sum(), (p - t).sum()])
        h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS,
        max_tokens: int = MAX_TOKENS, least_z: float = LEAST_Z) -> dict:
    """The model: token scores, extreme-value law and logistic curve."""
    spark = docs.sparkSession
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(
        ~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = (known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
              .select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5

    def count(batches):
        for batch in in_slices(batches, "text"):
            words, each = tokenise(texts_of(batch.column("text")))
            toxic = np.array(batch.column("toxic").to_pylist())
            names = WordIds()
            own_name = names.add(words)
            prefix = names.add([prefix_of(w) for w in words])
            n = np.zeros((len(names.ids), 2), np.int32)
            for own, y in zip(each, toxic):
                own = np.unique(own)
                n[np.unique(np.concatenate([own_name[own], prefix[own]])), y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(names.ids), pa.binary()), pa.array(n[:, 1]), pa.array(n[:, 0])],
                ["token", "toxic", "clean"])

    sizes = {r["toxic"]: r["n"] for r in rows.where(fold != 4).groupBy("toxic")
             .agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    model = {"scores": {}, "law": {"rate": 1.0, "place": 0.0, "width": 1.0},
             "curve": (0.0, -30.0 if not n1 else 30.0 if not n0 else 0.0)}
    if not n1 or not n0:
        return model
    y1, y0 = F.col("y1"), F.col("y0")
    odds = (F.log((y1 + PRIOR) / (n1 + 2 * PRIOR - y1)) - F.log((y0 + PRIOR) / (n0 + 2 * PRIOR - y0)))
    error = F.sqrt(1 / (y1 + PRIOR) + 1 / (y0 + PRIOR))
    kept = (rows.where(fold != 4).mapInArrow(count, "token binary, toxic int, clean int")
            .groupBy("token").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))
            .where((y1 + y0 >= LEAST_DOCS) & (y1 >= LEAST_SHARE * n1)).select("token", odds.alias("odds"), error.alias("error"))
            .withColumn("z", F.col("odds") / F.col("error"))
            .where((F.col("z") >= least_z) & (F.col("odds") - F.col("error") >= LEAST_SCORE))
            .orderBy(F.desc("z"), "token").limit(max_tokens).collect())
    model["scores"] = {bytes(r["token"]): r["odds"] - r["error"] for r in kept}
    shared = spark.sparkContext.broadcast(model["scores"])

    def measure(batches):
        for batch in in_slices(batches, "text"):
            words, each = tokenise(texts_of(batch.column("text")))
            value = word_values(words, shared.value)
            bins = [np.histogram(np.clip(value[own], -12, 12), 480, (-12, 12))[0] for own in each]
            best = [best_segment(value[own]) for own in each]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"),
                 pa.array([len(e) for e in each], pa.int64()), pa.array(best, pa.float64()),
                 pa.array([b.astype(np.int32) for b in bins], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "n", "best", "bins"])

    held = rows.where(fold == 4)
    some = {r[0] for r in held.select("toxic").distinct().collect()}
    held = held if some == {0, 1} else rows
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, n long, " \
            "best double, bins array<int>"
    measured = held.mapInArrow(measure, kinds).where("n > 0")
    clean = measured.where("toxic = 0")
    bins = (clean.select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col").alias("n"))
            .toPandas())
    middle = -12 + (bins["pos"].to_numpy() + 0.5) * 0.05
    weight = bins["n"].to_numpy() / max(1, bins["n"].sum())
    value = np.repeat(middle, np.maximum(1, (weight * 1e5).astype(int)) * (weight > 0))
    rate = _rate(value) if len(value) and value.mean() < 0 else 1.0
    best = clean.select("n", "best").toPandas()  # at most max_rows rows
    x = rate * best["best"].to_numpy() - np.log(np.maximum(1, best["n"].to_numpy()))
    width = max(0.05, float(x.std() * np.sqrt(6) / np.pi)) if len(x) > 1 else 1.0
    model["law"] = {"rate": rate, "width": width,
                    "place": float(x.mean() - 0.5772156649 * width) if len(x) else 0.0}
    law = model["law"]

    def weigh(batches):
        for batch in in_slices(batches, "text"):
            words, each = tokenise(texts_of(batch.column("text")))
            value = word_values(words, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([evidence(value[own], law)[0] for own in each],
                                                 pa.float64())], ["toxic", "x"])

    points = held.mapInArrow(weigh, "toxic int, x double").toPandas()  # at most max_rows rows
    model["curve"] = _logistic(np.log1p(points["x"].to_numpy()), points["toxic"].to_numpy())
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """The documents with score, predicted and the significant passages (word positions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in RESULT]

    def run(batches):
        model = shared.value
        weight, constant = model["curve"]
        for batch in in_slices(batches, "text"):
            words, each = tokenise(texts_of(batch.column("text")))
            value = word_values(words, model["scores"])
            found = [evidence(value[own], model["law"]) for own in each]
            x = weight * np.log1p([f[0] for f in found]) + constant
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            passages = [[{"first": a, "last": b, "p": v} for a, b, v in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(p, pa.float64()),
                 pa.array((p >= 0.5).astype(np.int32)),
                 pa.array(passages, pa.list_(pa.struct([
                     ("first", pa.int32()), ("last", pa.int32()), ("p", pa.float64())])))],
                [*columns, *RESULT])

    return docs.select(*map(quoted, columns)).mapInArrow(run, with_results(docs, columns, RESULT))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with their own columns."""
    return unpacked(score(packed(docs), fit(docs, labels)).where("predicted = 0"), docs)
