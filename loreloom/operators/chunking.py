"""Cutting texts into overlapping chunks at line ends. Sequential within a text, parallel over texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import small_batches

CHUNK = "array<struct<chunk_index:int,char_start:int,char_end:int,content:string>>"


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks before trimming. A chunk ends after the last line end in its second half, if there is
    one; the next starts overlap before that, or at it if that would not advance."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap within it")
    line_ends = [m.end() for m in re.finditer("\n", text)]
    start = end = 0
    while end < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = bisect_right(line_ends, end)
            if at and line_ends[at - 1] > start + size // 2:
                end = line_ends[at - 1]
        yield start, end
        start = end - overlap if end - overlap > start else end


def chunk(text: str, size: int, overlap: int) -> list[dict]:
    """Chunks of at most size code points, trimmed; blank ones take no index."""
    trimmed = ((start + len(text[start:end]) - len(text[start:end].lstrip()), text[start:end].strip()) for start, end in spans(text, size, overlap))
    return [{"chunk_index": i, "char_start": at, "char_end": at + len(body), "content": body} for i, (at, body) in enumerate((at, b) for at, b in trimmed if b)]


def chunk_documents(docs: DataFrame, *, size: int = 6000, overlap: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, char_start, char_end, content) of every text, whole; null texts have no chunks."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(CHUNK)
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t or "", size, overlap))

    return docs.select(key, F.explode(chunks(text)).alias("c")).select(key, "c.*")


def split_failing(chunks: DataFrame, *, least: int = 800) -> DataFrame:
    """Halves of chunks(content, depth) that failed: cut at the line end nearest the middle within the middle third."""
    n = F.length("content")
    middle = F.floor(n / 2).cast("int")
    window = F.substring(F.col("content"), F.floor(n / 3).cast("int") + 1, F.floor(n / 3).cast("int"))
    places = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(window), F.lit(1))), lambda i: F.when(F.substring(window, i, F.lit(1)) == "\n", F.floor(n / 3).cast("int") + i)), lambda p: p.isNotNull())
    nearest = F.array_min(F.transform(places, lambda p: F.struct(F.abs(p - middle).alias("d"), p.alias("p"))))
    cut = F.coalesce(nearest["p"], middle)
    ok = (n >= least) & (F.col("depth") < 2)
    halves = F.array(F.struct(F.lit(0).alias("part"), F.substring(F.col("content"), F.lit(1), cut).alias("content")), F.struct(F.lit(1).alias("part"), F.substring(F.col("content"), cut + 1, n).alias("content")))
    return chunks.filter(ok).withColumn("h", F.explode(halves)).select(*[c for c in chunks.columns if c not in ("content", "depth")], "h.part", "h.content", (F.col("depth") + 1).alias("depth"))
