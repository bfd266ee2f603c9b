"""Near-duplicate documents by order MinHash, verified by banded alignment.

Texts with equal words form one node. Each of ``TABLES`` hash functions picks the two smallest k-mers of ``K`` words
(labelled with their occurrence); the two in text order are a key. Texts of at most ``MID`` words, whose few k-mers a few
edits can destroy, also get the two smallest pairs of adjacent words in text order by ``MID_TABLES`` hash functions, and
texts of at most ``SHORT`` words all threes among their first words in the order of a hash. Nodes with an equal key meet
in a bucket. A pair is a link if its edit similarity in words, 1 - distance / longer length, is at least ``similarity``;
the distance is aligned within a band that holds all such alignments. Classes are the connected components of the links.

Buckets of at most ``ALL_PAIRS`` members compare all pairs, larger ones first each member with the smallest. What is
connected then needs no further comparison. Where a larger bucket still holds several components, its members are cut
into blocks by component, and each pair of blocks is one cell: all pairs of different components that have words enough
in common to allow a link are compared, each in the first bucket that both have only. So no pair with an equal key is lost,
whatever the size of its bucket, and no task holds more than two blocks.

Recall: scattered edits at edit similarity s leave about s^3 of the k-mers, of which two texts share j = s^3 / (2 - s^3)
of all; they have no equal key with chance near (1 - j^2)^40, 7e-3 at s = 0.8 and 2e-4 at 0.85. Texts of up to ``SHORT``
words always have an equal key if similarity is 0.75 or more: they share all but the n - ceil(similarity * n) edited
words, so the three smallest shared ones are among the first n - ceil(similarity * n) + 3 of either.

Defined cases: null text is alone in its class; texts without words are in one class only if equal as bytes; texts of
fewer than K words have one k-mer, all their words, which then stands for both; the class id is the smallest doc_id
(null only if all are); rows equal in doc_id and text are copies of each other; an empty table gives no rows; ``dedup``
keeps every column.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, fresh, list_rows, salted_join, small_batches, utf8, words_of

K, TABLES, MEMO, HASHED = 3, 40, 50_000, 1 << 18
MID, MID_TABLES, SHORT, ALL_PAIRS = 125, 16, 24, 16
BLOCK, CHUNK = 2048, 2048
_MIX = np.random.default_rng(20260101)
_XOR = _MIX.integers(0, 2**64, TABLES + MID_TABLES, dtype=np.uint64)
_ODD = _MIX.integers(0, 2**64, TABLES + MID_TABLES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """64-bit numbers of words, of up to MEMO words at once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


def _kmers(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers of the words w in text order, labelled with their occurrence."""
    n = max(1, len(w) - k + 1)
    kmer = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(w))):
        kmer = kmer * _STEP + w[j : j + n]
    order = np.argsort(kmer, kind="stable")
    same = np.r_[False, kmer[order][1:] == kmer[order][:-1]]
    if same.any():  # place within the run of equal k-mers
        at = np.arange(n)
        label = np.empty(n, dtype=np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        kmer = kmer + label * _ODD[0]
    return _mixed(kmer)


def _two_least(x: np.ndarray, tables: slice) -> tuple[np.ndarray, np.ndarray]:
    """The places of the two smallest of x in the order of each table's hash, in text order; about HASHED hashes at once."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    xor, odd = _XOR[tables].astype(np.uint32), _ODD[tables].astype(np.uint32)
    out, step = [], max(1, HASHED // len(x))
    for t in range(0, len(xor), step):
        h = (x[None, :] ^ xor[t : t + step, None]) * odd[t : t + step, None]
        rows, one = np.arange(len(h)), h.argmin(axis=1)
        h[rows, one] = np.uint32(2**32 - 1)
        out.append(np.stack([one, h.argmin(axis=1) if len(x) > 1 else one]))
    both = np.concatenate(out, axis=1)
    return both.min(axis=0), both.max(axis=0)


def _ordered(kmer: np.ndarray, tables: slice) -> np.ndarray:
    """A key for each table: the two smallest k-mers in text order."""
    first, second = _two_least(kmer, tables)
    return _mixed(_mixed(kmer[first] + _XOR[tables]) * np.uint64(3) + kmer[second])


def sketch(words: list[bytes], hashes: _WordHash, similarity: float = 0.8) -> np.ndarray:
    """The keys of a text: TABLES of two k-mers, MID_TABLES of two word pairs, and those of three words."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    keys = [_ordered(_kmers(w, K), slice(0, TABLES))]
    if len(w) <= MID:
        keys.append(_ordered(_kmers(w, 2), slice(TABLES, None)))
    if 3 <= len(w) <= SHORT:
        least = np.sort(_kmers(w, 1))[: int((1 - similarity) * len(w) + 1e-9) + 3]
        threes = np.array(list(combinations(least, 3)), dtype=np.uint64)
        keys.append(_mixed(_mixed(_mixed(threes[:, 0] + _ODD[1]) + threes[:, 1]) + threes[:, 2]))
    return np.concatenate(keys).view(np.int64)


def bag(words: list[bytes], hashes: _WordHash) -> bytes:
    """The words' 32-bit hashes, labelled with their occurrence."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return (_kmers(w, 1) >> np.uint64(32)).astype(np.uint32).tobytes() if words else b""


def in_common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many hashes each of the bags a has in common with each of b: matrix products over CHUNK hashes at a time."""
    values = np.frombuffer(b"".join(a + b), dtype=np.uint32)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) // 4 for x in a + b])
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # hashes of one bag only have no column
    row, at = row[times[at] > 1], column[at[times[at] > 1]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, CHUNK):
        mine = slice(*np.searchsorted(at, [start, start + CHUNK]))
        held = np.zeros((len(a) + len(b), CHUNK), dtype=np.float32)
        held[row[mine], at[mine] - start] = 1
        out += held[: len(a)] @ held[len(a) :].T
    return out


def banded_distance(a: list, b: list, band: int) -> int:
    """Edit distance of a and b if it is at most band, else some larger number.

    Bit-parallel dynamic programming over the diagonals within band: bit k of column j stands for row j - band + k.
    """
    m, n = len(a), len(b)
    if abs(m - n) > band:
        return band + 1
    if not m or not n:
        return max(m, n)
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    full, top = (1 << 2 * band + 1) - 1, 1 << 2 * band
    up, down = full & ~((1 << band) - 1), 0
    score = min(band, m)
    for j, x in enumerate(b, 1):
        shift = j - band - 1
        e = rows.get(x, 0)
        e = (e >> shift if shift >= 0 else e << -shift) & full
        diagonal = (((e & up) + up) ^ up | e | down) & full
        plus, minus = down | full & ~(diagonal | up), diagonal & up
        if j + band <= m:
            score += not diagonal & top
        else:
            bit = 1 << m - j + band
            score += bool(plus & bit) - bool(minus & bit)
        diagonal >>= 1
        up, down = minus | full & ~(diagonal | plus), diagonal & plus
    return score


def similar(a: list[bytes], b: list[bytes], least: float) -> bool:
    """Whether 1 - distance / longer length is at least least."""
    longer = max(len(a), len(b))
    band = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > band or longer - sum((Counter(a) & Counter(b)).values()) > band:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[i:], b[i:]
    i = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    return banded_distance(a[: len(a) - i], b[: len(b) - i], band) <= band


def sketched(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, row_hash, node, n_words, keys) of docs(doc_id, text); node is null for null text."""

    def run(batches):
        hashes = _WordHash()
        for batch in batches:
            nodes, counts, keys = [], [], []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                body = None if text is None else b"w" + b" ".join(words) if words else b"t" + text
                nodes.append(body and hashlib.blake2b(body, digest_size=16).digest())
                counts.append(len(words))
                keys.append(sketch(words, hashes, similarity) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row_hash", "node", "n_words", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, row_hash long, node binary, n_words long, keys array<long>")


def met_nodes(nodes: DataFrame) -> DataFrame:
    """(bucket, id, n_words, size, head) of nodes(id, n_words, keys): the members of each bucket of two and more, its size
    and smallest member (id, n_words)."""
    members = nodes.select("id", "n_words", F.explode(F.array_distinct("keys")).alias("bucket"))
    heads = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("id", "n_words")).alias("head")).filter("size > 1")
    return members.join(heads.hint("merge"), "bucket")


def first_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (id, head) with id > head whose numbers of words allow a link: all of a bucket of up to ALL_PAIRS
    members, else those with its smallest."""
    few = met.filter((F.col("size") > 2) & (F.col("size") <= ALL_PAIRS)).groupBy("bucket").agg(F.collect_list(F.struct("id", "n_words")).alias("ids"))
    each = few.select(F.explode("ids").alias("one"), "ids").select("one", F.explode("ids").alias("head"))
    both = met.filter((F.col("size") == 2) | (F.col("size") > ALL_PAIRS)).select(F.struct("id", "n_words").alias("one"), "head").unionByName(each)
    near = F.least("one.n_words", "head.n_words") >= F.greatest("one.n_words", "head.n_words") * similarity - 1e-9
    return both.filter((F.col("one.id") > F.col("head.id")) & near).select("one.id", F.col("head.id").alias("head")).distinct()


def cells(large: DataFrame) -> DataFrame:
    """(bucket, low, high, block, id) of large(bucket, id, root): the members of each two blocks that hold two components.

    A component with BLOCK members or more in a bucket has blocks of its own, the others share blocks.
    """
    per = large.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    own = per.filter(F.col("n") >= BLOCK).select("bucket", "root", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    sums = per.groupBy("bucket").agg(F.count("*").alias("roots"), F.coalesce(F.sum(F.when(F.col("n") < BLOCK, F.col("n"))), F.lit(0)).alias("rest")).filter("roots > 1").withColumn("shared", F.ceil(F.col("rest") / BLOCK).cast("int")).drop("roots", "rest")
    number = lambda root, part: F.xxhash64(F.coalesce(root, F.lit(-1).cast("long")), part)
    rows = large.join(sums.hint("merge"), "bucket").join(own, ["bucket", "root"], "left")
    alone = F.col("parts").isNotNull()
    part = F.when(alone, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("root"), F.col("shared"))).cast("int")
    rows = rows.withColumn("of", F.when(alone, F.col("root"))).withColumn("block", number(F.col("of"), part)).select("bucket", "id", "of", "block")
    blocks = own.select("bucket", F.col("root").alias("other_of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.unionByName(sums.filter("shared > 0").select("bucket", F.lit(None).cast("long").alias("other_of"), F.explode(F.sequence(F.lit(0), F.col("shared") - 1)).alias("part")))
    blocks = blocks.select("bucket", "other_of", number(F.col("other_of"), F.col("part")).alias("other"))
    got = rows.join(blocks.hint("merge"), "bucket").filter("of IS NULL OR other_of IS NULL OR of != other_of")
    return got.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id")


def cell_pairs(bucket: int, low: int, high: int, block, ids, roots, lengths, keys, bags, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell that may be links: different components, lengths and words near enough, no earlier equal key."""
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    width = TABLES + MID_TABLES
    even = np.zeros((2, len(ids), width), dtype=np.int64)
    even[1] = 1  # never equal where a text has no key
    for i, k in enumerate(keys):
        even[:, i, : min(len(k), width)] = k[:width]
    lengths = lengths.astype(np.int32)
    longer = np.maximum(lengths[a][:, None], lengths[b][None, :])
    band = ((1 - similarity) * np.arange(lengths.max(initial=0) + 1) + 1e-9).astype(np.int32)[longer]
    open_ = (roots[a][:, None] != roots[b][None, :]) & (np.abs(lengths[a][:, None] - lengths[b][None, :]) <= band)
    if low == high:
        open_ &= ids[a][:, None] < ids[b][None, :]
    for i in np.flatnonzero(open_.any(axis=1)).tolist():
        j = np.flatnonzero(open_[i])
        same = even[0, a[i]][None, :] == even[1, b[j]]
        open_[i, j] = ~same.any(axis=1) | (even[0, a[i]][same.argmax(axis=1)] == bucket)
    x, y = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(x):
        return x, y[:0]
    shared = in_common([bags[i] for i in a[x]], [bags[j] for j in b[y]])
    i, j = np.nonzero(open_[np.ix_(x, y)] & (longer[np.ix_(x, y)] - shared <= band[np.ix_(x, y)]))
    return ids[a[x[i]]], ids[b[y[j]]]


def rest_pairs(met: DataFrame, data: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (id, head) of the cells met, with data(id, root, n_words, keys, bag)."""
    rows = met.join(data, "id").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def run(batches):
        held, at = [], None

        def done():
            block, ids, roots, lengths, keys, bags = zip(*held)
            return cell_pairs(*at, *(np.array(c, dtype=np.int64) for c in (block, ids, roots, lengths)), keys, bags, similarity)

        def pairs(got):
            x, y = (np.concatenate(c) for c in zip(*got))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["id", "head"])

        for batch in batches:
            got = []
            columns = [batch.column(c).to_pylist() if c != "keys" else list_rows(batch.column(c)) for c in ("bucket", "low", "high", "block", "id", "root", "n_words", "keys", "bag")]
            for row in zip(*columns):
                if row[:3] != at:
                    if held:
                        got.append(done())
                    held, at = [], row[:3]
                held.append(row[3:])
            if got:
                yield pairs(got)
        if held:
            yield pairs([done()])

    return rows.mapInArrow(run, "id long, head long").distinct()


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, *others: str) -> DataFrame:
    """(id, text) and other columns of the nodes in wanted(id). A node's text is that of its lead row."""
    leads = nodes.select("id", "lead.doc_id", "lead.row_hash", *others).join(wanted, "id")
    keyed = docs.select(F.col("doc_id").cast("long").alias("key_id"), F.xxhash64("text").alias("key_hash"), F.col("text").cast("binary").alias("text"))
    texts = keyed.join(leads.hint("merge"), keyed["key_id"].eqNullSafe(leads["doc_id"]) & (keyed["key_hash"] == leads["row_hash"])).select("id", "text", *others)
    return texts.dropDuplicates(["id"])  # rows equal in doc_id and text bring it once


def verified(docs: DataFrame, nodes: DataFrame, pairs: Table, similarity: float) -> Table:
    """Those of the pairs (id, head) whose texts are similar; the pairs' table goes."""
    wanted = pairs.df.select("id").unionByName(pairs.df.select(F.col("head").alias("id"))).distinct()
    texts = Table(texts_of(docs, nodes, wanted), "near-texts")
    # A head with many near copies: its pairs are dealt, and its text goes once to each part.
    both = salted_join(pairs.df.join(texts.df.hint("merge"), "id"), texts.df.select(F.col("id").alias("head"), F.col("text").alias("head_text")), ["head"], ["id"], counted=pairs.df).select("id", "head", "text", "head_text")

    def verify(batches):
        for batch in batches:
            heads: dict[int, list[bytes]] = {}
            ok = []
            for head, a, b in zip(*(batch.column(c).to_pylist() for c in ("head", "text", "head_text"))):
                if head not in heads:
                    heads = {head: words_of(b)}
                ok.append(similar(words_of(a), heads[head], similarity))
            yield batch.select(["id", "head"]).filter(pa.array(ok, pa.bool_()))

    out = Table(both.mapInArrow(verify, "id long, head long").distinct(), "near-links")
    pairs.drop()
    texts.drop()
    return out


def connected(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(id, root) of the nodes that have a link."""
    met = Table(met_nodes(nodes), "near-buckets")
    found = verified(docs, nodes, Table(first_pairs(met.df, similarity), "near-pairs"), similarity)
    roots = components(found.df)
    found.drop()
    large = met.df.filter(F.col("size") > ALL_PAIRS).select("bucket", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = Table(cells(Table(large, "near-large").df), "near-cells")
    met.drop()

    def bags(batches):
        hashes = _WordHash()
        for batch in batches:
            found = pa.array([bag(words_of(t), hashes) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "keys")), found], ["id", "n_words", "keys", "bag"])

    if split.df.limit(1).count() == 0:
        return roots
    wanted = split.df.select("id").distinct()
    bagged = texts_of(docs, nodes, wanted, "n_words", "keys").mapInArrow(bags, "id long, n_words long, keys array<long>, bag binary")
    data = Table(bagged.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "near-data")
    rest = Table(rest_pairs(split.df, data.df, similarity), "near-rest")
    split.drop()
    data.drop()
    more = verified(docs, nodes, rest, similarity)
    if more.df.limit(1).count() == 0:
        return roots
    top = lambda c: more.df.select("id", "head").join(roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    both = top("id").join(top("head"), ["id", "head"])
    higher = components(both.select(F.col("id_root").alias("id"), F.col("head_root").alias("head")))
    every = roots.unionByName(higher.select("id", F.col("id").alias("root")).unionByName(higher.select(F.col("root").alias("id"), "root")).distinct().join(roots, "id", "left_anti"))
    return every.join(higher.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component of edges (id, head); by alternating stars until nothing changes."""
    now = Table(edges.filter("id != head").selectExpr("greatest(id, head) AS v", "least(id, head) AS u").distinct(), "cc")
    while True:
        both = now.df.unionByName(now.df.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u != v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = Table(small, "cc")
        same = after.df.count() == now.df.count() and after.df.join(now.df, ["v", "u"], "left_anti").limit(1).count() == 0
        now.drop()
        now = after
        if same:  # stars: a step changed nothing
            return now.df.select(F.col("v").alias("id"), F.col("u").alias("root"))


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and (node, class_id, lead_hash, class_size) for each node: id, text hash and rows of its class."""
    small_batches(docs.sparkSession)
    rows = Table(sketched(docs, similarity), "near-rows").df
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_hash")).alias("lead"), F.count("*").alias("n_rows"), F.any_value("n_words").alias("n_words"), F.any_value("keys").alias("keys"))
    nodes = Table(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes").df  # ids are fixed once written
    roots = connected(docs, nodes.filter("keys IS NOT NULL"), similarity)
    rooted = Table(nodes.select("node", "id", "lead", "n_rows").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "near-rooted").df
    by_root = rooted.groupBy("root").agg(F.min("lead").alias("lead"), F.sum("n_rows").alias("class_size"))
    return rows, Table(salted_join(rooted.select("node", "root", "id"), by_root, ["root"], ["id"]).select("node", F.col("lead.doc_id").alias("class_id"), F.col("lead.row_hash").alias("lead_hash"), "class_size"), "near-classes").df


def classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """For each row doc_id, class_id, class_size and whether it stays (it has the class's id and text)."""
    rows, by_node = _classes(docs, similarity)
    got = rows.select("doc_id", "row_hash", "node").join(by_node, "node", "left")
    stays = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row_hash") == F.col("lead_hash")))
    return got.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), stays.alias("stays"))


def dedup(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each class: the one of smallest doc_id; rows with null text all stay."""
    _, by_node = _classes(docs, similarity)
    # Null ids count as the least id here, so that the join's keys are plain and its partitioning serves the window, too.
    row_hash, row_id, place = fresh(docs, "near_row_hash", "near_row_id", "near_place")
    plain = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63)).cast("long"))
    keep = by_node.select(F.col("lead_hash").alias(row_hash), plain(F.col("class_id")).alias(row_id)).distinct()
    hashed = docs.filter(F.col("text").isNotNull()).withColumn(row_hash, F.xxhash64("text")).withColumn(row_id, plain(F.col("doc_id")))
    kept = hashed.join(keep.hint("merge"), [row_hash, row_id], "left_semi")
    first = Window.partitionBy(row_hash, row_id).orderBy(row_hash)
    kept = kept.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*docs.columns)
    return kept.unionByName(docs.filter(F.col("text").isNull()))
