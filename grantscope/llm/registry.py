"""Queries opN_<name>: each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from grantscope.llm import chat, decontaminate, embeddup, linededup, minhash, mixing, pii, quality, secrets, toxicity
from grantscope.llm.common import table


def op2_line_dedup(spark, sf_dir):
    return linededup.query(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark, sf_dir):
    return minhash.query(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_quality_classifier(spark, sf_dir):
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark, sf_dir):
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark, sf_dir):
    return pii.query(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secrets.query(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark, sf_dir):
    return chat.query(table(spark, sf_dir, "conversations"))


def op5_embedding_near_dedup(spark, sf_dir):
    return embeddup.query(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_line_dedup, op3_pii, op4_toxicity, op5_embedding_near_dedup, op6_secret_scan, op7_chat_formatting, op8_source_mixing, op10_minhash_near_dedup, op9_benchmark_decontamination)}
ORACLES = {
    "op2_line_dedup": linededup.ORACLE, "op5_embedding_near_dedup": embeddup.ORACLE,
    "op8_source_mixing": mixing.ORACLE, "op9_benchmark_decontamination": decontaminate.ORACLE,
}
