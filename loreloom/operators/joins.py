"""Joins that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted), else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def merged(df: DataFrame) -> DataFrame:
    """df as a join's side that grows with the input: its join shuffles and sorts both sides. Spark would broadcast a side
    whose files are small, as of columns of few values they are however many rows there are, through the driver."""
    return df.hint("merge")


def grams(text: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of a text; a shorter text is its own."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def containing(texts: DataFrame, parts: DataFrame, text: str, part: str, n: int = 3) -> DataFrame:
    """texts joined with the parts that they contain: candidates share the part's first n characters, then they are compared.

    Parts of fewer than n characters, of which there are few kinds, meet the texts by their own length. Texts are spread
    only by the lengths that parts have; empty parts are in no text.
    """
    out, sizes = None, [r[0] for r in parts.select(F.least(F.length(part), F.lit(n))).distinct().collect()]  # n numbers at most
    for size in sorted(s for s in sizes if s) or [n]:
        some = parts.filter(F.length(part) == size) if size < n else parts.filter(F.length(part) >= n)
        some = some.withColumn("_gram", F.substring(part, 1, size))
        met = texts.filter(F.length(text) >= size).withColumn("_gram", F.explode(grams(F.col(text), size))).join(small(some), "_gram").filter(F.contains(F.col(text), F.col(part))).drop("_gram")
        out = met if out is None else out.unionByName(met)
    return out
