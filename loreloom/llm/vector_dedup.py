"""Near-duplicate vectors by cross-polytope hashing with multiprobe, verified by cosine.

Equal vectors of a label form one node with a count. A hash turns a node's direction by three rounds of sign flips and
fast Hadamard transforms and takes the axis that it then lies closest to, one of 2 * dims; a key joins some hashes, and
the label. Beside its own key a node gets in each of ``tables`` tables those that differ in the one hash that was
decided most narrowly. Nodes with an equal key meet in a bucket; a bucket of more than ``BLOCK`` members is cut into
blocks, and each pair of blocks is compared on its own, so that no task holds more than two blocks. All pairs of a cell
are compared in double precision; a pair counts in the smallest key that both have, so that nothing has to be made
distinct: a cell returns for each node the number of vectors it is linked with, and a spanning forest of its links.
Components come from the forests.

The number of hashes in a key grows with the logarithm of the number of vectors, so that strangers seldom meet; as many
tables keep recall: two vectors of cosine 0.98 and 64 components have an equal key with chance 0.9995.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and those of null label link
with nothing; vectors of different length neither; rows of null vec_id count like others, their component is that of the
smallest id, null if it has none; a row that links with nothing is its own component, whatever other rows have its id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, small_batches
from .near_dup import components

PROBES, BLOCK, PAIRS, SEED = 4, 512, 1 << 16, 20260301
_DRAWN: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows of x (a power of two long) times the Hadamard matrix, not normalised."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x


def _drawn(width: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """The sign flips of each table, hash and round, and a number for each table, hash and axis."""
    if (width, hashes) not in _DRAWN:
        r = np.random.default_rng([SEED, width, hashes])
        _DRAWN[width, hashes] = r.choice([-1.0, 1.0], (hashes, hashes, 3, width)), r.integers(0, 2**64, (hashes, hashes, 2 * width), dtype=np.uint64)
    return _DRAWN[width, hashes]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their squares neither overflow nor vanish."""
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -e[:, None])


def keys(x: np.ndarray, hashes: int) -> np.ndarray:
    """For each row of x the keys of its hashes tables, PROBES in each (fewer for very short vectors), without the label."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    signs, numbers = _drawn(width, hashes)
    x = scaled(np.pad(x, ((0, 0), (0, width - x.shape[1]))))
    near = min(PROBES, width)
    out, each = [], np.arange(len(x))
    for t in range(hashes):
        home, others, losses = np.zeros(len(x), dtype=np.uint64), [], []
        for k in range(hashes):
            y = x
            for flip in signs[t, k]:
                y = hadamard(y * flip)
            size = np.abs(y)
            axes = np.argsort(-size, axis=1, kind="stable")[:, :near]
            value = numbers[t, k][2 * axes + (np.take_along_axis(y, axes, axis=1) < 0)]
            size = np.take_along_axis(size, axes, axis=1)
            home = home + value[:, 0]
            others.append(value[:, 1:] - value[:, :1])
            losses.append(size[:, :1] - size[:, 1:])
        change, loss = np.concatenate(others, axis=1), np.concatenate(losses, axis=1)
        least = np.argsort(loss, axis=1, kind="stable")[:, : PROBES - 1]
        out += [home, *(home + change[each, least[:, p]] for p in range(least.shape[1]))]
    return np.stack(out, axis=1)


def _by_length(column: pa.Array):
    """(row numbers, rows as doubles) for each length of the lists of an Arrow column; null lists and empty ones are left out."""
    lists = column.cast(pa.list_(pa.float64()))
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.where(np.asarray(lists.is_valid()), np.diff(at), 0)
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, values[at[rows][:, None] + np.arange(n)] + 0.0  # no negative zeros


def identified(vectors: DataFrame, hashes: int | None = None, embedding: bool = False) -> DataFrame:
    """(vec_id, node) of vectors(vec_id, label, embedding), node null for those that link with nothing.

    hashes: adds salt, the label's number, and keys; embedding: adds the vector as it is.
    """
    kind = dict(vectors.dtypes)["embedding"]
    schema = "vec_id long, node binary" + (", salt long, keys array<long>" if hashes else "") + (f", embedding {kind}" if embedding else "")

    def run(batches):
        for b in batches:
            labels = b.column("label").to_pylist()
            nodes, salts, found = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for rows, x in _by_length(b.column("embedding")):
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                good &= np.array([labels[i] is not None for i in rows.tolist()], dtype=bool)
                rows, x = rows[good], x[good]
                of = keys(x, hashes) if hashes and len(x) else None
                for j, i in enumerate(rows.tolist()):
                    name = f"{x.shape[1]} {labels[i]}".encode()
                    nodes[i] = hashlib.blake2b(x[j].tobytes(), digest_size=16, key=hashlib.blake2b(name, digest_size=16).digest()).digest()
                    if hashes:
                        salt = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little")
                        salts[i] = salt - (salt >> 63 << 64)
                        found[i] = (of[j] + np.uint64(salt)).view(np.int64)
            out = [b.column("vec_id"), pa.array(nodes, pa.binary())]
            names = ["vec_id", "node"]
            if hashes:
                out += [pa.array(salts, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                names += ["salt", "keys"]
            if embedding:
                out.append(b.column("embedding"))
                names.append("embedding")
            yield pa.RecordBatch.from_arrays(out, names)

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(run, schema)


def cells(nodes: DataFrame) -> DataFrame:
    """(bucket, low, high, block, id) of nodes(id, keys): the members of each pair of blocks of each bucket that has two.

    A member of a bucket of n blocks has n rows.
    """
    members = nodes.select("id", F.explode(F.array_distinct("keys")).alias("bucket"))
    heads = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    met = members.join(heads.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id")


def compared(bucket: int, low: int, high: int, block: np.ndarray, ids: np.ndarray, copies: np.ndarray, salt: np.ndarray, every: np.ndarray, x: np.ndarray, least: float):
    """(id, links, head) for each node of a cell that has a link here: vectors it is linked with, smallest node it reaches.

    every: the keys of each node.
    """
    x = scaled(x)
    norm = np.sqrt((x * x).sum(axis=1))
    a, b = (np.flatnonzero(block == low), np.flatnonzero(block == high))
    if not len(a) or not len(b):
        return None
    i, j = np.nonzero((x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= least)
    i, j = a[i], b[j]
    fit = (salt[i] == salt[j]) & (ids[i] < ids[j] if low == high else True)
    i, j = i[fit], j[fit]
    if not len(i):
        return None
    here = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), PAIRS // every.shape[1]):
        p, q = every[i[s : s + PAIRS // every.shape[1]]], every[j[s : s + PAIRS // every.shape[1]]]
        both = (p[:, :, None] == q[:, None, :]).any(axis=2)
        here[s : s + len(p)] = np.where(both, p, np.uint64(2**64 - 1)).min(axis=1) == np.int64(bucket).view(np.uint64)
    i, j = i[here], j[here]
    links = np.zeros(len(x), dtype=np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    order = np.argsort(ids, kind="stable")
    head = np.empty(len(x), dtype=np.int64)
    head[order] = np.arange(len(x))  # ranks of ids
    while True:
        new = head.copy()
        np.minimum.at(new, i, head[j])
        np.minimum.at(new, j, head[i])
        new = np.minimum(new, new[order[new]])
        if (new == head).all():
            break
        head = new
    some = np.flatnonzero(links)
    return ids[some], links[some], ids[order[head[some]]]


def linked(met: DataFrame, vectors: DataFrame, hashes: int, least: float) -> DataFrame:
    """(id, links, head) of the cells met, with vectors(id, salt, copies, embedding); rows of a node add up."""
    rows = met.join(vectors, "id").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def run(batches):
        held, at = [], None

        def done():
            columns = [np.concatenate(c) for c in zip(*held)]
            return compared(*at, *columns, least)

        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(c).to_numpy() for c in ("bucket", "low", "high")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            block, ids, copies, salt = (b.column(c).to_numpy() for c in ("block", "id", "copies", "salt"))
            x, every = [None] * b.num_rows, [None] * b.num_rows
            for at_length, values in _by_length(b.column("embedding")):
                of = keys(values, hashes) + salt[at_length].view(np.uint64)[:, None]
                for i, r in enumerate(at_length.tolist()):
                    x[r], every[r] = values[i], of[i]
            got = []
            for s, e in zip(cuts, cuts[1:]):
                if (now := tuple(place[s].tolist())) != at:
                    if held:
                        got.append(done())
                    held, at = [], now
                width = len(x[s])
                same = [r for r in range(s, e) if len(x[r]) == width]  # others have the key by chance
                held.append((block[same], ids[same], copies[same], salt[same], *(np.stack([y[r] for r in same]) for y in (every, x))))
            if got := [g for g in got if g]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], ["id", "links", "head"])
        if held and (last := done()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], ["id", "links", "head"])

    return rows.mapInArrow(run, "id long, links long, head long")


def report(vectors: DataFrame, least: float = 0.98, hashes: int | None = None) -> DataFrame:
    """For each vector vec_id, n_links, component_id and kept.

    hashes: of a key, and tables; from the number of vectors if none is given.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    hashes = hashes or max(2, ceil(log(16 * max(vectors.count(), 1), 128)))
    rows = identified(vectors, hashes).filter("node IS NOT NULL")
    nodes = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.any_value("salt").alias("salt"), F.any_value("keys").alias("keys"))
    nodes = Table(nodes.withColumn("id", F.monotonically_increasing_id()), "polytope-nodes").df  # ids are fixed once written
    met = Table(cells(nodes), "polytope-cells")
    wanted = nodes.select("node", "id", "salt", "copies").join(met.df.select("id").distinct(), "id")
    texts = identified(vectors, embedding=True).filter("node IS NOT NULL").groupBy("node").agg(F.any_value("embedding").alias("embedding"))
    held = Table(texts.join(wanted, "node").select("id", "salt", "copies", "embedding"), "polytope-vectors")
    found = Table(linked(met.df, held.df, hashes, least), "polytope-links").df
    met.drop()
    held.drop()
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select("id", "head"))
    known = nodes.select("node", "id", "copies", "first_id").join(counts, "id", "left").join(roots, "id", "left").filter("copies > 1 OR links IS NOT NULL").withColumn("root", F.coalesce("root", "id"))
    known = Table(known, "polytope-linked").df
    first = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = known.join(first, "root").select(F.col("node").alias("of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    got = identified(vectors).join(by_node, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: The rows of report for DuckDB.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS x, len(embedding) AS n,
    label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding) AND len(list_filter(embedding, lambda e: e <> 0)) > 0 AS good FROM embeddings),
p AS (SELECT a.row AS a, b.row AS b FROM v a JOIN v b ON a.label = b.label AND a.n = b.n AND a.row <> b.row AND a.good AND b.good WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c AS (SELECT row AS a, row AS b FROM v UNION SELECT c.a, p.b FROM c JOIN p ON p.a = c.b),
m AS (SELECT c.a, min(v.vec_id) AS component_id FROM c JOIN v ON v.row = c.b GROUP BY c.a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = v.row) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m ON m.a = v.row
"""
