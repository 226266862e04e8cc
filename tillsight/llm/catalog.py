"""Registered queries ``opN_<name>`` of the training-data operators.

Each takes (spark, sf_dir), applies its operator to the whole table and returns
the digest columns of the operator's contract.
"""

from __future__ import annotations

from tillsight.llm import bitslice, bwt, chat, crosstoken, decontaminate, encode, langid, minhash, \
    ngrams, packing, passages, quantise, toxicity
from tillsight.llm.common import table
from tillsight.llm.oracle import ORACLE  # noqa: F401


def op1_suffix_dedup(spark, sf_dir):
    return bwt.repeat_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark, sf_dir):
    return encode.encoding_report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_score(spark, sf_dir):
    return ngrams.scoring_report(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark, sf_dir):
    return quantise.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("""SELECT -1 AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)""")
    extra = extra.select(*(extra[f.name].cast(f.dataType) for f in rows.schema))
    return chat.conversation_report(rows.unionByName(extra))


def op8_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return passages.repeat_report(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return bitslice.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark, sf_dir):
    return packing.packing_report(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer(spark, sf_dir):
    return crosstoken.alignment_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_toxicity, op3_sentencepiece, op4_decontaminate,
    op5_lm_score, op6_embedding_dedup, op7_chat_format, op8_minhash_dedup,
    op9_language_id, op10_substring_dedup, op11_ranked_search,
    op12_best_fit_packing, op13_cross_tokenizer)}
