"""Benchmark decontamination with suffix arrays over the training texts.

Each shard (documents of a partition up to ``SHARD_BYTES`` of text) gets a suffix array over its word numbers. Every
test suffix is binary-searched in it: the range of training suffixes that share its first window of words gives all
verbatim occurrences. A training suffix enters the array only if it is followed by as many benchmark-vocabulary words
as the shortest window has; no other suffix can match. Where occurrences follow one another, the longest match and its
place come from a binary search in the test texts' own suffix array, for a place only if the occurrences reach far
enough to beat the longest match so far; so a passage that many items share costs no more than one that one item has.

Words, windows and hits: A-Z is lower-cased, words are runs of digits, a-z and non-ASCII characters; a window is
``window`` consecutive words of an item, an item of fewer words but not none is one window; a document word inside any
occurrence of a window is hit; a document with a hit word is contaminated.

The benchmark, a test set, is read in blocks of at most ``BLOCK_BYTES`` of text. A worker holds one block at a time, from
a broadcast if there is one block only, else from a file of its own for each; with several, shards are ``LONG_SHARD`` times as large, so that blocks are taken up seldom.

Defined cases: null or empty texts have no words and are never contaminated; an item without words has no window; an
empty benchmark hits nothing; items with equal item_id count once, those of null item_id together as one, whose id is
left out of the list; item_ids are compared as strings; other columns are kept by ``remove`` whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _at, shared_root, small_batches, utf8, words_of

SHARD_BYTES, BLOCK_BYTES, LONG_SHARD = 6 << 20, 16 << 20, 8

_STOP = np.zeros(1, dtype=np.int32)
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, longest_item string"


class _Numbers(dict):
    def __missing__(self, word):
        return 0


class TestSuffixes:
    """One block of items: word numbers from 1, and all suffixes by the window that they start with."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = _Numbers()
        at: dict[tuple[int, ...], set[str | None]] = {}
        self.item_of: list[str | None] = []
        every: list[int] = []
        for item_id, text in items:
            w = []
            for x in words_of(text):
                w.append(self.numbers[x] or self.numbers.setdefault(x, len(self.numbers) + 1))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                at.setdefault(tuple(w[i : i + window]), set()).add(item_id)
            self.item_of += [item_id] * (len(w) + 1)
            every += [*w, 0]
        self.window = window
        self.windows = sorted(at)
        self.items = [at[w] for w in self.windows]
        self.order = _sorted_suffixes(np.array(every, dtype=np.int64))
        self.names = sorted(set(self.item_of), key=_name_order)
        place = {name: i for i, name in enumerate(self.names)}
        self.ranks = np.array([place[name] for name in self.item_of], dtype=np.int64)[self.order]
        self.words = np.array(every, dtype=">u4").tobytes()
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.depth = int(self.lengths.max(initial=1))
        self.shortest = int(self.lengths.min(initial=self.depth))
        low = np.zeros((len(self.windows), self.depth), dtype=np.int64)
        high = np.full((len(self.windows), self.depth), (1 << 32) - 1, dtype=np.int64)
        for i, w in enumerate(self.windows):
            low[i, : len(w)] = high[i, : len(w)] = w
        self.low, self.high = _keys(low), _keys(high)


    def longest(self, words: bytes) -> tuple[int, str | None]:
        """Length of the longest start of words (4 bytes each) that a test text holds, and the first of the items that hold it."""

        def first(part: bytes, search=bisect_left) -> int:
            return search(self.order, part, key=lambda t: self.words[4 * int(t) : 4 * int(t) + len(part)])

        at, best = first(words), 0
        for t in self.order[max(at - 1, 0) : at + 1].tolist():
            other = self.words[4 * t : 4 * t + len(words)]
            differ = np.flatnonzero(np.frombuffer(words[: len(other)], ">u4") != np.frombuffer(other, ">u4"))
            best = max(best, int(differ[0]) if differ.size else len(other) // 4)
        part = words[: 4 * best]
        return best, self.names[int(self.ranks[first(part) : first(part, bisect_right)].min())] if best else None


def _name_order(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def _sorted_suffixes(words: np.ndarray) -> np.ndarray:
    """The suffix array of words, by ranks of runs of doubled length."""
    rank, length = words, 1
    while True:
        after = np.r_[rank[length:] + 1, np.zeros(min(length, len(rank)), dtype=np.int64)]
        order = np.lexsort((after, rank))
        new = np.zeros(len(rank), dtype=np.int64)
        new[order] = np.cumsum(np.r_[False, (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)][: len(rank)])
        if not len(new) or new.max() == len(new) - 1 or length > len(new):
            return order
        rank, length = new, length * 2


def _keys(numbers: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings of the same order."""
    rows = np.ascontiguousarray(numbers.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, dtype="S4")


def suffix_array(words: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes that can match, sorted by their first tests.depth words, and these words as keys.

    words: a shard's word numbers, 0 for other words and after each text.
    """
    stops = np.flatnonzero(words == 0)
    at = np.flatnonzero(words)
    known = np.r_[stops, len(words)][np.searchsorted(stops, at)] - at
    at = at[known >= tests.shortest]
    keys = _keys(np.r_[words, np.zeros(tests.depth, dtype=words.dtype)][at[:, None] + np.arange(tests.depth)])
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def search(words: np.ndarray, tests: TestSuffixes) -> Iterator[tuple[int, np.ndarray]]:
    """(window, positions of its occurrences in the shard) for every window that occurs."""
    at, keys = suffix_array(words, tests)
    lo, hi = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
    for i in np.flatnonzero(hi > lo).tolist():
        yield i, at[lo[i] : hi[i]]


def scan_shard(texts: list[bytes | None], blocks) -> list[tuple]:
    """(n_words, n_hit, item_ids, longest match, its word, its item) of each text; blocks: the TestSuffixes in turn."""
    items: list[set[str | None]] = [set() for _ in texts]
    longest = [(0, -1, None)] * len(texts)
    counts = starts = change = None
    for tests in blocks:
        numbered = []  # only numbers are kept of a text's words, each with a 0 after it
        for t in texts:
            w = words_of(t)
            numbered += [np.fromiter(map(tests.numbers.__getitem__, w), np.int32, len(w)), _STOP]
        words = np.concatenate([*numbered, _STOP[:0]])
        if counts is None:
            counts = np.array([len(x) for x in numbered[::2]], dtype=np.int64)
            starts = np.r_[0, np.cumsum(counts + 1)]
            change = np.zeros(starts[-1] + 1, dtype=np.int32)
        reach, which = np.zeros((2, len(words) + 1), dtype=np.int64)  # end of the longest window at each place, and the window
        for i, found in search(words, tests):
            n = int(tests.lengths[i])
            np.add.at(change, found, 1)
            np.add.at(change, found + n, -1)
            longer = found[found + n > reach[found]]
            reach[longer], which[longer] = longer + n, i
            docs = np.searchsorted(starts, found, "right") - 1
            for d in np.unique(docs).tolist():
                items[d] |= tests.items[i]
        places = np.flatnonzero(reach)
        ends = _run_ends(places, reach)
        held = words.astype(">u4").tobytes()
        for p, stop, d in zip(places.tolist(), ends.tolist(), (np.searchsorted(starts, places, "right") - 1).tolist()):
            best, at, _ = longest[d]
            at_here = p - int(starts[d])
            if stop - p > best or (stop - p == best and at_here <= at):
                n, item = tests.longest(held[4 * p : 4 * stop])
                if n < tests.window:  # only whole items are that short
                    n, item = int(reach[p]) - p, min(tests.items[which[p]], key=_name_order)
                if (-n, at_here, _name_order(item)) < (-best, at, _name_order(longest[d][2])):
                    longest[d] = (n, at_here, item)
    hit = np.r_[0, np.cumsum(np.cumsum(change[:-1]) > 0)]
    hits = hit[starts[1:] - 1] - hit[starts[:-1]]
    return [(int(c), int(h), ids, *best) for c, h, ids, best in zip(counts, hits, items, longest)]


def _run_ends(places: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each of the places, in order, where the occurrences end that follow from it one word after the other."""
    last = np.r_[np.diff(places) != 1, True][: len(places)]  # a match of one more word has an occurrence at the next place
    run = np.cumsum(np.r_[0, last[:-1]])[: len(places)]
    ends = np.zeros(int(run[-1]) + 1 if len(run) else 0, dtype=np.int64)
    np.maximum.at(ends, run, reach[places])
    return ends[run]


def item_blocks(benchmark: DataFrame, window: int) -> list:
    """The benchmark's items, (item_id, text), in blocks of at most BLOCK_BYTES of text or one item.

    A single block is broadcast. Several are files in the shared folder that executors fetch; these are named here, so
    that neither the driver nor a worker ever holds more than one.
    """
    spark = benchmark.sparkSession
    names, block, held = [], [], 0

    def store() -> None:
        name = f"items-{uuid.uuid4().hex}"
        files, at = _at(spark, f"{shared_root(spark)}/{name}")
        out = files.create(at)
        out.write(pickle.dumps(block))
        out.close()
        spark.sparkContext.addFile(at.toString())
        names.append(name)

    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for item_id, text in items.toLocalIterator():
        if block and held + len(text) > BLOCK_BYTES:
            store()
            block, held = [], 0
        block.append((item_id, bytes(text)))
        held += len(text)
    if not names:
        return [spark.sparkContext.broadcast(block)]
    store()
    return names


def _items(block) -> list[tuple[str | None, bytes]]:
    if isinstance(block, str):
        with open(SparkFiles.get(block), "rb") as f:
            return pickle.load(f)
    return block.value


def _shards(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, make, schema) -> DataFrame:
    """docs through make(batch, its results), shard by shard."""
    small_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, window)

    def run(batches):
        built: dict[int, TestSuffixes] = {}

        def tests():
            for i, b in enumerate(blocks):
                if i not in built:
                    built.clear()  # one block at a time in memory
                    built[i] = TestSuffixes(_items(b), window)
                yield built[i]

        for shard in _shards(batches, "text", SHARD_BYTES * (LONG_SHARD if len(blocks) > 1 else 1)):
            done = scan_shard([t for b in shard for t in utf8(b.column("text"))], tests())
            for b in shard:
                mine, done = done[: b.num_rows], done[b.num_rows :]
                yield make(b, mine)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The columns of REPORT for each document."""

    def make(batch, done):
        ids = [",".join(sorted(i for i in x[2] if i is not None)) for x in done]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([len(x[2]) for x in done], pa.int64()),
            pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids], pa.string()), pa.array([x[1] > 0 for x in done], pa.bool_()),
            pa.array([x[3] for x in done], pa.int64()), pa.array([x[4] if x[3] else None for x in done], pa.int64()), pa.array([x[5] for x in done], pa.string()),
        ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "longest_item"])

    return _scanned(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, make, REPORT)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the contaminated ones."""

    def make(batch, done):
        return batch.filter(pa.array([x[1] == 0 for x in done], pa.bool_()))

    return _scanned(docs, benchmark, window, make, docs.schema)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rows of report for DuckDB. A longest match is the longest stretch of windows of one item that follow one another.
ORACLE = rf"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT row_number() OVER () AS no, item, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
v AS (SELECT no, item, k, p, array_to_string(w[p + 1 : p + k], ' ') AS x FROM t, unnest(range(len(w) - k + 1)) AS r(p)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
y AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS x FROM d, (SELECT DISTINCT k FROM v), unnest(range(len(w) - k + 1)) AS r(p) WHERE len(w) >= k),
m AS (SELECT doc_id, no, item, k, y.p AS p, v.p AS q FROM y JOIN v USING (k, x)),
h AS (SELECT doc_id, count(DISTINCT z) AS n_hit FROM (SELECT DISTINCT doc_id, k, p FROM m), unnest(range(p, p + k)) AS r(z) GROUP BY doc_id),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, no, p - q ORDER BY p) AS run FROM m),
l AS (SELECT doc_id, item, min(p) AS place, max(p) - min(p) + k AS n FROM g GROUP BY doc_id, no, item, k, p - q, run),
b AS (SELECT doc_id, min((-n, place, item IS NULL, item)) AS best, count(DISTINCT coalesce(item, chr(1))) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM l GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
    coalesce(-best[1], 0)::BIGINT AS longest_match, best[2]::BIGINT AS longest_at, best[4] AS longest_item FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id
"""
