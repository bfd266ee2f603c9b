"""A training corpus from the raw documents: toxic documents go, one of each near-duplicate class stays, documents with
benchmark passages go, sources are mixed to their target weights, and the mix is dealt into shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again for the next stage. All stages but the last return the columns of documents; the last returns doc_id,
size, text_crc32, law, shard, slot and grown_shard. A document that the mix takes twice is there twice.

Defined cases: documents of null text are not toxic, are no copies and are not contaminated, but have no words, so the
mix never takes them, like empty ones; rows equal in doc_id and text count once from the near-duplicate stage on; an
empty table gives no rows in every stage; further columns of documents go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreloom.llm import decontaminate, mixing, near_dup, sharding, toxicity
from loreloom.llm.common import Table, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, table(spark, sf_dir, "labels"))


def _near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_report(docs)


STAGES = [("toxicity", _toxicity), ("near_dup", _near_dup), ("decontaminate", _decontaminate), ("mix", _mix), ("shard", _shard)]

#: The classifier, the sketches and the packing have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
