"""The corpus pipeline: documents in, token ids out.

Each stage works on all rows that the one before it kept, and its decisions take
effect: toxic documents go; of each group of near duplicates one document stays;
words of passages that repeat within or across documents go; documents that hold
benchmark passages go; what is left is encoded. All stages but the last return the
columns of ``documents``.

Edge cases are those of the operators: null and empty texts pass every filter and
encode to no ids; a text whose words were all removed stays as an empty text; an
empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import decontaminate, encode, minhash, passages, toxicity
from tillsight.llm.common import table
from tillsight.llm.graph import stored

#: Models and groups of texts have no SQL form; tests compare with brute force.
ORACLE_SQL = None
#: Near duplicates share this much of their 5-word shingles (op8's own limit is 85); the
#: bands, of three permutations, miss a pair at 0.8 with probability 3e-6.
NEAR_PERCENT, NEAR_BANDS, NEAR_BAND_PERMUTATIONS = 80, 42, 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, NEAR_PERCENT, NEAR_BANDS, NEAR_BAND_PERMUTATIONS)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = passages.without_repeats(docs)
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint"):
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encode.encode(docs, keep=columns).select(
        *columns, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("repeated passages", remove_passages),
    ("benchmark passages", drop_benchmark),
    ("encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
