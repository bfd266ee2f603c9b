"""Centroid clustering with Yinyang's filters, in exact integers.

Vectors of ``dims`` components become integers floor(scale * x). The centroids start as the vectors whose ids hash
smallest, and are clustered into groups once. A row of the state table carries its vector, its centroid, an upper bound
of the distance to it and for each group a lower bound of the distance to the group's other centroids. When centroids
have moved, bounds move by as much: a row whose upper bound lies below all lower bounds keeps its centroid (first as the
bound stands, then with the exact distance); else the groups whose bound does not exclude them are scanned exactly.
Bounds are doubles widened by ``SLACK``, so that no filter decides a tie; distances, sums and means are integers.

Each round reads one table, writes the next and sums the vectors that changed their centroid, in each task first; what
reaches the driver is one row for each centroid and component. Rounds stop early only when no centroid moved, as all
further rounds would repeat.

Defined cases: vectors that are null, of another length, or hold null or non-finite components have no row; null vec_ids
have a row but start no centroid; rows equal in vec_id and vector may both start one (ties go to the smaller number);
with fewer rows than centroids there are fewer centroids; with none, cluster and all after it are null; integers are
clamped to +-2^62 and distances beyond a long to its largest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, small_batches

SLACK, EXACT, CLAMP, MOST = 1e-9, 1 << 26, 1 << 62, (1 << 63) - 1
STATE = "vec_id long, x array<long>, cluster int, was int, upper double, lower array<double>"


def kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x) of the vectors with exactly dims finite components."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform("embedding", lambda e: F.greatest(F.least(F.floor(e.cast("double") * scale), F.lit(CLAMP)), F.lit(-CLAMP)))
    return vectors.filter((F.size("embedding") == dims) & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k rows whose ids hash smallest."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in rows.filter("vec_id IS NOT NULL").orderBy(h, "x").limit(k).collect()]


def squared(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Exact squared distances of the rows of x; Python integers where 64 bits could not hold them."""
    c = np.array(centre, dtype=np.int64)
    if max(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0), c.min(initial=0), c.max(initial=0))) > EXACT:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=1)


def _up(d) -> np.ndarray:
    return np.sqrt(np.asarray(d, dtype=float)) * (1 + SLACK)


def _down(d) -> np.ndarray:
    return np.sqrt(np.asarray(d, dtype=float)) * (1 - SLACK)


def grouped(centres: list[list[int]], groups: int) -> list[list[int]]:
    """The numbers of the centroids in each group: a few plain rounds over the centroids alone."""
    c = np.array(centres, dtype=float)
    heads = c[np.linspace(0, len(c) - 1, min(groups, len(c))).astype(int)]
    for _ in range(5):
        near = ((c[:, None, :] - heads[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        heads = np.array([c[near == g].mean(axis=0) if (near == g).any() else heads[g] for g in range(len(heads))])
    found = [np.flatnonzero(near == g).tolist() for g in range(len(heads))]
    return [g for g in found if g]


@dataclass
class Round:
    """The centroids of a round, their groups, and how far each has moved since the round before."""

    centres: list[list[int]]
    groups: list[list[int]]
    moved: np.ndarray

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) from all distances."""
        cluster = np.zeros(len(x), dtype=np.int32)
        upper, lower = np.full(len(x), np.inf), np.full((len(x), len(self.groups)), np.inf)
        self._scan(x, np.full(len(x), -1), np.ones((len(x), len(self.groups)), dtype=bool), cluster, upper, lower)
        return cluster, upper, lower

    def next(self, x: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) from those of the round before."""
        cluster, upper = was.copy(), upper + self.moved[was]
        lower = np.maximum(lower - np.array([self.moved[g].max() for g in self.groups]), 0) * (1 - SLACK)
        left = np.flatnonzero(upper >= lower.min(axis=1))  # the global filter
        for c in np.unique(was[left]):
            mine = left[was[left] == c]
            upper[mine] = _up(squared(x[mine], self.centres[c]))
        left = left[upper[left] >= lower[left].min(axis=1)]
        if len(left):
            c, u, low = cluster[left], upper[left], lower[left]
            self._scan(x[left], was[left], low <= u[:, None], c, u, low)  # the group filter
            cluster[left], upper[left], lower[left] = c, u, low
        return cluster, upper, lower

    def _scan(self, x, was, open_, cluster, upper, lower) -> None:
        """Sets cluster and the bounds by exact distances to was and to the centroids of each row's open groups."""
        found = []
        for g, numbers in enumerate(self.groups):
            for c in numbers:
                at = np.flatnonzero(open_[:, g] | (was == c))
                found.append((c, at, squared(x[at], self.centres[c])))
        wide = any(d.dtype == object for _, _, d in found)
        none = 1 << 200 if wide else MOST
        far = np.full((len(x), len(self.centres)), none, dtype=object if wide else np.int64)
        for c, at, d in found:
            far[at, c] = d
        cluster[:] = far.argmin(axis=1)  # the first of equal ones
        each = np.arange(len(x))
        upper[:] = _up(far[each, cluster])
        far[each, cluster] = none
        for g, numbers in enumerate(self.groups):
            other = far[:, numbers].min(axis=1)
            new = np.where(other == none, np.inf, _down(other))
            lower[:, g] = np.where(open_[:, g], new, np.minimum(lower[:, g], new))


def _components(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assigned(rows: DataFrame, now: Round, dims: int) -> DataFrame:
    """The state after a round; rows: (vec_id, x) before the first one, else the state."""
    begun = "cluster" in rows.columns

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _components(b.column("x"), dims)
            if begun:
                was = b.column("cluster").to_numpy()
                cluster, upper, lower = now.next(x, was, b.column("upper").to_numpy(), _components(b.column("lower"), len(now.groups)))
            else:
                was = np.full(len(x), -1, dtype=np.int32)
                cluster, upper, lower = now.first(x)
            at = pa.array(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(at, pa.array(lower.ravel()))], ["vec_id", "x", "cluster", "was", "upper", "lower"])

    return rows.mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, dims: int) -> dict[tuple[int, int], int]:
    """By (centroid, component) how much its sum changed, by (centroid, dims) its number of rows: k * (dims + 1) at most."""

    def run(batches):
        sums: dict[int, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _components(b.column("x"), dims)
            if max(int(x.max()), -int(x.min())) > EXACT:
                x = x.astype(object)
            for column, sign in (("cluster", 1), ("was", -1)):
                of = b.column(column).to_numpy()
                for c in np.unique(of[of >= 0]).tolist():
                    held = sums.setdefault(c, [0] * (dims + 1))
                    part = [*x[of == c].sum(axis=0).tolist(), int((of == c).sum())]
                    sums[c] = [s + sign * v for s, v in zip(held, part)]
        rows = [(c, j, v) for c, held in sums.items() for j, v in enumerate(held)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([str(r[2]) for r in rows], pa.string())], ["c", "j", "v"])

    parts = state.filter("cluster != was").select("x", "cluster", "was").mapInArrow(run, "c int, j int, v string")
    return {(r["c"], r["j"]): int(r["v"]) for r in parts.groupBy("c", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}


def cluster(vectors: DataFrame, k: int = 8, *, dims: int = 64, scale: int = 1024, rounds: int = 10, groups: int | None = None, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, x) after rounds updates and one more assignment, and the centroids.

    groups: how many groups of centroids; a fourth of k if none is given.
    """
    spark = vectors.sparkSession
    small_batches(spark, rows=10_000, mb=16)
    rows = kept(vectors, dims, scale)
    centres = seeds(rows, k, seed)
    if not centres:
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"), "x"), []
    now = Round(centres, grouped(centres, groups or max(1, -(-k // 4))), np.zeros(len(centres)))
    sums, state = {}, None
    for turn in range(rounds + 1):
        after = Table(_assigned(state.df if state else rows, now, dims), "yinyang-state")
        if state:
            state.drop()
        state = after
        if turn == rounds:
            break
        for at, v in _changes(state.df, k, dims).items():
            sums[at] = sums.get(at, 0) + v
        new = [[sums[c, j] // n for j in range(dims)] if (n := sums.get((c, dims), 0)) else old for c, old in enumerate(now.centres)]
        moved = [float(_up(squared(np.array([a], dtype=np.int64), b)[0])) for a, b in zip(now.centres, new)]
        if new == now.centres:
            break
        now = Round(new, now.groups, np.array(moved))

    def measured(batches):
        for b in batches:
            x, of = _components(b.column("x"), dims), b.column("cluster").to_numpy()
            far = np.zeros(len(x), dtype=object)
            for c in np.unique(of).tolist():
                far[of == c] = squared(x[of == c], now.centres[c]).astype(object)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array([min(int(v), MOST) for v in far], pa.int64()), b.column("x")], ["vec_id", "cluster", "distance", "x"])

    return state.df.select("vec_id", "cluster", "x").mapInArrow(measured, "vec_id long, cluster int, distance long, x array<long>"), now.centres


def report(vectors: DataFrame, k: int = 8, **options) -> DataFrame:
    """For each vector vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    rows, centres = cluster(vectors, k, **options)
    columns = ["vec_id", "cluster", "distance"]
    if not centres:
        return rows.select(*columns, *(F.lit(None).cast(t).alias(n) for n, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    rows = Table(rows.select(*columns), "yinyang-clusters").df
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = of([min(sums.get(c, 0), MOST) for c in range(len(centres))]).cast("long")
    return rows.select(*columns, inertia.alias("cluster_inertia"), F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))


def _oracle(k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    near = "SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, vec_id, x, c, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY row, vec_id, x"
    parts = [f"""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
             f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x AS y FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})"]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"u{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS y FROM (SELECT c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) AS t(j) GROUP BY c, j) GROUP BY c)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(u{r}.y, c{r}.y) AS y FROM c{r} LEFT JOIN u{r} USING (c))")
    return f"""WITH {", ".join(parts)}, f AS MATERIALIZED ({near.format(r=rounds)})
SELECT vec_id, f.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON c{rounds}.c = f.c"""


#: The rows of report for DuckDB.
ORACLE = _oracle()
