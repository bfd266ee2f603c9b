"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from .common import table
from . import decontaminate, fingerprints, line_dedup, main_text, merkle, mixing, near_dup, preferences, sharding, toxicity, vector_dedup, warc, yinyang


def op1_shard(spark, sf_dir):
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op2_main_text(spark, sf_dir):
    return main_text.main_texts(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dup(spark, sf_dir):
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op5_preferences(spark, sf_dir):
    return preferences.report(table(spark, sf_dir, "conversations"))


def op6_fingerprint(spark, sf_dir):
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.remove(table(spark, sf_dir, "documents"), report=True)


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_yinyang(spark, sf_dir):
    return yinyang.report(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark, sf_dir):
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark, sf_dir):
    return vector_dedup.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_shard": op1_shard,
    "op2_main_text": op2_main_text,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_dup": op4_near_dup,
    "op5_preferences": op5_preferences,
    "op6_fingerprint": op6_fingerprint,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_mix": op10_mix,
    "op11_yinyang": op11_yinyang,
    "op12_merkle": op12_merkle,
    "op13_near_vectors": op13_near_vectors,
}
ORACLES = {"op3_decontaminate": decontaminate.ORACLE, "op5_preferences": preferences.ORACLE, "op9_warc": warc.ORACLE, "op10_mix": mixing.ORACLE, "op11_yinyang": yinyang.ORACLE, "op12_merkle": merkle.ORACLE, "op13_near_vectors": vector_dedup.ORACLE}
