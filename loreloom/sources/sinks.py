"""Sinks: keyed upsert of Parquet tables, reports, and hash-chained trace logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import redact
from ..operators.audit import chain


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those of equal keys; of equal keys within new the largest by order stays."""
    if order:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = new.withColumn("_place", last).filter("_place = 1").drop("_place")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_version(table: DataFrame, folder: str, version: int) -> str:
    """Writes a table's new version beside the old one; readers change over to the path when it is complete."""
    path = f"{folder}/version={version:012d}"
    table.write.mode("errorifexists").parquet(path)
    return path


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def trace_batch(spark: SparkSession, path: str, key: str = "run_id", order: str = "event_id"):
    """A foreachBatch function that adds redacted events to a trace table, each chained to the key's record before it.

    Epochs are partitions of the table at path/records, so that an epoch that runs again takes its own place and adds
    nothing. path/tips holds each epoch's last hash of its keys; only these are read to go on from.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("body", F.concat_ws(":", F.col(order).cast("string"), F.col("kind"), redact(F.lit("value"), F.col("value").cast("string"))))
        tips = _written(spark, f"{path}/tips", f"`{key}` {dict(batch.dtypes)[key]}, tip string, epoch long").filter(F.col("epoch") < epoch)
        tips = tips.groupBy(key).agg(F.max_by("tip", "epoch").alias("tip"))
        chained = chain(rows.select(key, order, "kind", "body").join(tips, key, "left"), key, order, "body", tip="tip").drop("tip")
        chained.write.mode("overwrite").parquet(f"{path}/records/epoch={epoch}")
        done = spark.read.parquet(f"{path}/records/epoch={epoch}")
        done.groupBy(key).agg(F.max_by("record_hash", order).alias("tip")).write.mode("overwrite").parquet(f"{path}/tips/epoch={epoch}")

    return add


def trace_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of a trace table."""
    return spark.read.parquet(f"{path}/records")


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one before anything is written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
