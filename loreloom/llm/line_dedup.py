"""Removal of repeated runs of lines by winnowing over line hashes.

A document's lines, blank ones left out, become hashes. A window is a shortest run of lines, from or up to any line,
that has ``least_words`` words. Of each window the position of its smallest hash is selected, once for all windows
around that have it as their minimum; the selected hashes are the document's fingerprints. Any run of that many words
that two places share contains an equal window in both, so both have its minimum as a fingerprint, whatever surrounds
it. Positions join on their fingerprint; where it has two and more, the windows that selected it are compared (by a hash
of all their lines), and each later place joins the first place of its window. Such a match is verified line by line
and extended both ways. Runs so found that have an earlier place, in document order or higher up in the same document,
are deleted; the first place stays. No pairs within a group are enumerated: a window of n places gives n - 1 rows.

Equal lines are equal after trimming. Documents are ordered by doc_id (null last), then text hash.

Defined cases: null text stays null and has no lines; rows equal in doc_id and text are one document and lose the same
lines; a document all of whose lines repeat becomes the empty text; blank lines inside a deleted run go with it; an
empty table gives no rows; ``remove`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, fresh, list_rows, salted_join, small_batches, utf8

NEWLINE = b"\n"
LINES = "doc_id long, row_hash long, hashes array<long>, picks array<struct<pos:int,windows:array<struct<window:long,start:int,stop:int>>>>"


def split_lines(text: bytes | None) -> tuple[list[int], list[int], list[int]]:
    """(index in the text, hash, words) of each line with words."""
    at, hashes, counts = [], [], []
    for i, line in enumerate(text.split(NEWLINE) if text else ()):
        if n := len(line.split()):
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()) - 2**63)
            counts.append(n)
    return at, hashes, counts


def windows(counts: list[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs from each line, and up to each line, with at least so many words; in order."""
    total = np.r_[0, np.cumsum(np.asarray(counts, dtype=np.int64))]
    ends = np.searchsorted(total, total[:-1] + least)  # the run from i is [i, ends[i])
    starts = np.searchsorted(total, total[1:] - least, "right") - 1  # the run up to j is [starts[j], j + 1)
    return sorted({(i, e) for i, e in enumerate(ends.tolist()) if e < len(total)} | {(s, j + 1) for j, s in enumerate(starts.tolist()) if s >= 0})


def winnow(hashes: list[int], counts: list[int], least: int) -> dict[int, list[tuple[int, int]]]:
    """The selected positions, each with the windows that it is the minimum of.

    Of equal minima a window takes the one that the window before took if it has it, else its last.
    """
    out: dict[int, list[tuple[int, int]]] = {}
    at = -1
    for start, end in windows(counts, least):
        run = hashes[start:end]
        low = min(run)
        if not (start <= at < end and hashes[at] == low):
            at = end - 1 - run[::-1].index(low)
        out.setdefault(at, []).append((start, end))
    return out


def same_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal items that a and b start with."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        stop = min(at + step, n)
        differ = np.flatnonzero(a[at:stop] != b[at:stop])
        if differ.size:
            return at + int(differ[0])
        at, step = stop, step * 2
    return n


def extended(a: np.ndarray, b: np.ndarray, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of a that equal runs of b around the windows found, (start, end, start in b) in order.

    A window that earlier runs cover adds nothing and is passed over, so each line is compared once or twice.
    """
    reach = 0
    for start, end, other in found:
        if end > reach:
            n = same_ahead(a[start:], b[other:])
            if start + n >= end:
                back = same_ahead(a[reach:start][::-1], b[:other][::-1]) if start > reach else 0
                reach = start + n
                yield start - back, reach


def _order(doc, row_hash):
    return [F.col(doc).isNull().alias("n"), F.col(doc).alias("doc_id"), F.col(row_hash).alias("row_hash")]


def _met(rows: DataFrame, key: list[str], place) -> DataFrame:
    """(key, first) of the keys of rows that have two and more places."""
    both = rows.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return both.filter("first != last").select(*key, "first")


def lines(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, row_hash, hashes, picks) of docs(doc_id, text) with at least so many words: line hashes and selected positions."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")
    schema = T.StructType.fromDDL(LINES)

    def run(batches):
        for b in batches:
            keep, hashes, picks = [], [], []
            for i, text in enumerate(utf8(b.column("text"))):
                _, h, counts = split_lines(text)
                if sum(counts) >= least_words:
                    whole = np.array(h, dtype=np.int64)
                    keep.append(i)
                    hashes.append(whole)
                    picks.append([(p, [(xxhash.xxh3_64_intdigest(whole[s:e].tobytes()) - 2**63, s, e) for s, e in w]) for p, w in winnow(h, counts, least_words).items()])
            window = pa.struct([("window", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
            pick = pa.struct([("pos", pa.int32()), ("windows", pa.list_(window))])
            dense = [{"pos": p, "windows": [dict(zip(("window", "start", "stop"), x)) for x in w]} for row in picks for p, w in row]
            offsets = np.r_[0, np.cumsum([len(x) for x in picks])].astype(np.int32)
            kept = b.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("row_hash"), pa.array(hashes, pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(dense, pick))], schema.names)

    return rows.mapInArrow(run, schema)


def runs(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, row_hash, runs) of documents with repeated runs; runs: array<struct<start, end, source>> of line numbers
    among the lines with words, end exclusive, and the doc_id of the earlier place."""
    kept = Table(lines(docs, least_words), "line-hashes")
    at = F.explode("picks").alias("p")
    prints = Table(kept.df.select("doc_id", "row_hash", "hashes", at).select(F.element_at("hashes", F.col("p.pos") + 1).alias("fingerprint"), "doc_id", "row_hash", "p.pos", "p.windows"), "line-prints")
    place = F.struct(*_order("doc_id", "row_hash"), "pos")
    shared = Table(_met(prints.df.select("fingerprint", "doc_id", "row_hash", "pos"), ["fingerprint"], place).select("fingerprint"), "line-shared")
    joined = salted_join(prints.df, shared.df, ["fingerprint"], ["doc_id", "row_hash", "pos"])
    seen = Table(joined.select("fingerprint", "doc_id", "row_hash", F.inline("windows")), "line-windows")
    prints.drop()
    shared.drop()

    place, key = F.struct(*_order("doc_id", "row_hash"), "start"), ["fingerprint", "window"]
    first = Table(_met(seen.df, key, place), "line-first")
    later = salted_join(seen.df, first.df, key, ["doc_id", "row_hash", "start"]).filter(place != F.col("first"))
    window = F.struct("start", "stop", F.col("first.start").alias("other"))
    later = later.groupBy("doc_id", "row_hash", F.col("first.doc_id").alias("source"), F.col("first.row_hash").alias("source_hash")).agg(F.sort_array(F.collect_set(window)).alias("found"))  # of one document
    met = Table(later, "line-met")
    seen.drop()
    first.drop()

    # Extension looks no further than the windows found and one window more: what goes on beyond has windows of its own.
    one = kept.df.select("doc_id", "row_hash", "hashes").dropDuplicates(["doc_id", "row_hash"])
    span = lambda low, high: (F.greatest(low - least_words, F.lit(0)), high + least_words)
    lo, hi = span(F.array_min(F.col("found.other")), F.array_max(F.transform("found", lambda w: w["other"] + w["stop"] - w["start"])))
    theirs = one.select(F.col("doc_id").alias("source"), F.col("row_hash").alias("source_hash"), F.col("hashes").alias("whole"))
    both = salted_join(met.df, theirs, ["source", "source_hash"], ["doc_id", "row_hash"])
    both = Table(both.select("doc_id", "row_hash", "source", "found", F.slice("whole", lo + 1, hi - lo).alias("b"), lo.alias("b_at")), "line-both")
    lo, hi = span(F.array_min(F.col("found.start")), F.array_max(F.col("found.stop")))
    both_ = salted_join(both.df, one.withColumnRenamed("hashes", "whole"), ["doc_id", "row_hash"], ["source"])
    both_ = both_.select("doc_id", "row_hash", "source", "found", F.slice("whole", lo + 1, hi - lo).alias("a"), lo.alias("a_at"), "b", "b_at")

    def run(batches):
        for b in batches:
            out = []
            found = b.column("found")
            at, triples = found.offsets.to_numpy(), [found.values.field(k).to_numpy() for k in ("start", "stop", "other")]
            numbers = [b.column(c).to_pylist() for c in ("doc_id", "row_hash", "source", "a_at", "b_at")]
            for i, (doc_id, row_hash, source, a_at, b_at, mine, their) in enumerate(zip(*numbers, list_rows(b.column("a")), list_rows(b.column("b")))):
                start, stop, other = (x[at[i] : at[i + 1]] for x in triples)
                for s, e in extended(mine, their, zip((start - a_at).tolist(), (stop - a_at).tolist(), (other - b_at).tolist())):
                    out.append((doc_id, row_hash, source, s + a_at, e + a_at))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], ["doc_id", "row_hash", "source", "start", "end"])

    got = both_.mapInArrow(run, "doc_id long, row_hash long, source long, start long, end long")
    got = Table(got.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end", "source"))).alias("runs")), "line-runs")  # of one document
    for done in (kept, met, both):
        done.drop()
    return got.df


def _cut(text: bytes, found: list[dict]) -> tuple[bytes, int, int]:
    """The text without the lines of found, the number of its lines, and of the lines that went."""
    all_ = text.split(NEWLINE)
    at = [k for k, x in enumerate(all_) if x.split()] if found else []
    gone = np.zeros(len(all_), dtype=bool)
    for r in found:
        gone[at[r["start"]] : at[r["end"] - 1] + 1] = True
    return NEWLINE.join([x for x, g in zip(all_, gone.tolist()) if not g]), len(all_), int(gone.sum())


def remove(docs: DataFrame, least_words: int = 50, report: bool = False) -> DataFrame:
    """docs with the repeated runs gone from text; report: only doc_id and text, with n_lines, n_removed, and the sources."""
    found = runs(docs, least_words).select(F.col("doc_id").alias("run_doc"), F.col("row_hash").alias("run_hash"), F.col("runs").alias("run_list"))
    if report:
        docs = docs.select(F.col("doc_id").cast("long"), "text")
    names = dict(zip(found.columns, fresh(docs, *found.columns)))
    found = found.toDF(*names.values())
    key = fresh(docs, "line_row_hash")[0]
    hashed = docs.withColumn(key, F.xxhash64("text"))
    got = hashed.join(found.hint("merge"), hashed["doc_id"].cast("long").eqNullSafe(found[names["run_doc"]]) & (hashed[key] == found[names["run_hash"]]), "left").select(*docs.columns, names["run_list"])
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields])
    if report:
        schema = schema.add("n_lines", T.LongType()).add("n_removed", T.LongType()).add("sources", T.ArrayType(T.LongType()))

    def cut(batches):
        for b in batches:
            texts, counts, removed, sources = [], [], [], []
            for text, found in zip(utf8(b.column(at)), b.column(b.num_columns - 1).to_pylist()):
                new, n, gone = _cut(text, found or []) if text is not None else (None, 0, 0)
                texts.append(new)
                counts.append(n)
                removed.append(gone)
                sources.append(sorted({r["source"] for r in found or [] if r["source"] is not None}))
            columns = [*b.columns[:-1]]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if report:
                columns += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sources, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return got.mapInArrow(cut, schema)
