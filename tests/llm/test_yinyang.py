import hashlib
import math
import random

import duckdb
import numpy as np

from loreloom.llm import yinyang as Y

SCHEMA = "vec_id long, embedding array<double>, cluster int, x string"


def plain(rows, k, dims, rounds=10, scale=1024):
    """Lloyd's rounds over Python integers: {row number: (cluster, distance)}, centroids."""
    kept = [(i, v, [math.floor(scale * e) for e in x]) for i, (v, x) in enumerate(rows) if x is not None and len(x) == dims and all(e is not None and math.isfinite(e) for e in x)]
    first = sorted((hashlib.sha256(f"3:{v}".encode()).hexdigest(), x) for _, v, x in kept if v is not None)
    centres = [x for _, x in first[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        of = [near(x)[1] for _, _, x in kept]
        for j in range(len(centres)):
            mine = [x for c, (_, _, x) in zip(of, kept) if c == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    ends = [(v, *near(x)) for _, v, x in kept]
    return sorted((v is None, v or 0, c, min(d, Y.MOST)) for v, d, c in ends), centres


def same(spark, rows, k, dims, **options):
    frame = spark.createDataFrame([(v, x, 1, "y") for v, x in rows], SCHEMA).repartition(3)
    got, centres = Y.cluster(frame, k, dims=dims, **options)
    want, plain_centres = plain(rows, k, dims)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got.collect()) == want
    assert centres == plain_centres


def test_equal_to_plain_rounds(spark):
    r = random.Random(1)
    heads = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [h + r.gauss(0, 0.6) for h in r.choice(heads)]) for i in range(400)]
    rows += [(400, None), (401, [1.0] * 5), (402, [1.0] * 5 + [None]), (403, [math.nan] * 6), (404, [math.inf] + [0.0] * 5), (None, [0.1] * 6), (7, list(rows[7][1])), (7, list(rows[7][1]))]
    for k, groups in ((8, None), (8, 8), (3, 1)):
        same(spark, rows, k, 6, groups=groups)


def test_ties_go_to_the_smaller_number(spark):
    r = random.Random(2)
    grid = [(i, [r.choice((-1.0, 0.0, 1.0)) / 1024 for _ in range(3)]) for i in range(200)]
    same(spark, grid, 6, 3)
    same(spark, [(i, [0.25, 0.5]) for i in range(20)], 4, 2)


def test_large_components_and_few_rows(spark):
    same(spark, [(1, [1e9, -3e7]), (2, [-1e8, 4e10]), (3, [0.0, 1e10]), (4, [1e9, 0.5])], 2, 2)
    same(spark, [(1, [0.5, 0.5]), (2, [0.75, 0.0])], 8, 2)
    empty = spark.createDataFrame([(None, [0.5] * 64, 1, "y")], SCHEMA)
    assert [tuple(r) for r in Y.report(empty).collect()] == [(None, None, None, None, None, None)]
    assert Y.report(empty.limit(0)).count() == 0
    clamped = spark.createDataFrame([(1, [1e300, 0.0], 1, "y"), (2, [-1e300, 0.0], 1, "y"), (3, [0.0, 0.0], 1, "y")], SCHEMA)
    assert max(r.distance for r in Y.cluster(clamped, 1, dims=2)[0].collect()) == Y.MOST


def test_filters_save_distances(monkeypatch):
    r = np.random.default_rng(4)
    x = np.floor(1024 * (r.normal(size=(3000, 16)) * 0.1 + np.repeat(r.normal(size=(6, 16)), 500, axis=0))).astype(np.int64)
    centres = [x[i * 500].tolist() for i in range(6)]
    first = Y.Round(centres, Y.grouped(centres, 3), np.zeros(6))
    of, upper, lower = first.first(x)
    new = [(x[of == c].sum(axis=0) // (of == c).sum()).tolist() for c in range(6)]
    counted = []
    plain_squared = Y.squared
    moved = np.array([math.sqrt(float(plain_squared(np.array([a]), b)[0])) * 1.0001 for a, b in zip(centres, new)])
    monkeypatch.setattr(Y, "squared", lambda rows, c: counted.append(len(rows)) or plain_squared(rows, c))
    got, _, _ = Y.Round(new, first.groups, moved).next(x, of, upper, lower)
    assert sum(counted) < 0.5 * 6 * len(x)
    assert (got == np.stack([plain_squared(x, c) for c in new], axis=1).argmin(axis=1)).all()


def test_report_equals_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    got = sorted(tuple(r) for r in Y.report(spark.read.parquet(path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}'")
    rel = duckdb.sql(Y.ORACLE)
    assert rel.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got == sorted(rel.fetchall())
