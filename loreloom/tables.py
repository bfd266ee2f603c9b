"""Tables in the folder that driver and executors share: what is read several times is written once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Used where spark.checkpoint.dir is unset and all of Spark runs on this machine.
OWN_SHARED_DIR = "file:///tmp/checkpoints"

_ROOTS: dict[str, str] = {}


def _at(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_root(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share; it goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = OWN_SHARED_DIR
        _ROOTS[app] = f"{base.rstrip('/')}/loreloom-{uuid.uuid4().hex}"
        store, at = _at(spark, _ROOTS[app])
        store.mkdirs(at)
        store.deleteOnExit(at)
    return _ROOTS[app]


class Table:
    """A DataFrame written as Parquet in the shared folder: its lineage is cut and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only once nothing reads them any more."""
        store, at = _at(self.spark, self.path)
        store.delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 4) -> None:
    """Lowers, and never raises, the session's bounds on the rows and bytes of a batch that Spark hands to Python.

    Spark reads them when a plan runs, so they stay lowered.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def spread(df: DataFrame, *by: str | Column, least: int = 0) -> DataFrame:
    """df dealt by the columns for work whose time its bytes do not tell, as Python's: over a stated number of partitions,
    so that neither the size of its files nor AQE, which joins small partitions, leaves the work to a few tasks.
    least: partitions that the rows need at least."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, least), *by)
