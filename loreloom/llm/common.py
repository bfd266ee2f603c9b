"""What the training-data operators share: tables in the shared folder, batch sizes, words."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words split at ASCII white space (Java and RE2 pattern).
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Used where spark.checkpoint.dir is unset and all of Spark runs on this machine.
OWN_SHARED_DIR = "file:///tmp/checkpoints"
#: A key with more than this share of a side's rows is dealt into parts.
HOT = 1 / 256
#: A key of no more rows than this is never dealt.
HOT_ROWS = 256

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


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names like bases that clash with no column of df, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def checked_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted), else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ASCII letters and digits and every byte of a non-ASCII character are word bytes.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and takes the runs of digits, a-z and non-ASCII characters; null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8."""
    return pc.cast(column, pa.large_binary()).to_pylist()


def list_rows(column: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow column of lists of numbers, without nulls, as views of its values."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(at, at[1:])]


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """big joined with small, which has one row for each key, as a merge join that no key makes lopsided.

    A key with more than HOT of big's rows is dealt into as many parts as it has such shares, by a hash of the columns
    ``by``, and small's row of it is repeated for each; there are at most 1 / HOT such keys. Null keys equal null; other
    columns of the two must differ in name. counted: rows with big's keys that are cheaper to count.
    """
    counted = big if counted is None else counted
    share = max(counted.count() * HOT, HOT_ROWS)
    often = counted.groupBy(*keys).count().filter(F.col("count") > share).select(*(F.col(k).alias(f"hot_{k}") for k in keys), F.ceil(F.col("count") / share).cast("int").alias("hot_parts"))
    hot = Table(often, "hot-keys").df  # at most 1 / HOT rows
    equal = lambda other: reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{other}_{k}")) for k in keys))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), equal("hot"), "left").drop(*(f"hot_{k}" for k in keys)).withColumn("hot_parts", F.coalesce("hot_parts", F.lit(1)))

    left = marked(big).withColumn("hot_part", F.pmod(F.xxhash64(*by), F.col("hot_parts")).cast("int")).drop("hot_parts")
    right = marked(small).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("hot_parts") - 1))).drop("hot_parts").withColumnsRenamed({k: f"their_{k}" for k in keys} | {"part": "their_part"})
    got = left.join(right.hint("merge"), equal("their") & (F.col("hot_part") == F.col("their_part")), how)
    return got.drop("hot_part", "their_part", *(f"their_{k}" for k in keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

