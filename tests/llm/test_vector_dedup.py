import math

import duckdb
import numpy as np

from loreloom.llm import vector_dedup as V

SCHEMA = "vec_id long, label int, embedding array<double>, node string, id int"


def plain(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of each row by all pairs."""
    good = [l is not None and x is not None and len(x) > 0 and all(e is not None and math.isfinite(e) for e in x) and any(x) for _, l, x in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, l, x) in enumerate(rows):
        for j in range(i):
            if good[i] and good[j] and l == rows[j][1] and len(x) == len(rows[j][2]):
                a, b = np.array(x), np.array(rows[j][2])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i, (v, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((v, links[i], c, v == c))
    return out


def near(r, x, cosine):
    z = r.normal(size=len(x))
    z -= (z @ x) / (x @ x) * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * math.sqrt((x @ x) / (z @ z)) * z


def planted(seed, n=150, dims=64):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x = r.normal(size=dims)
        rows.append([k % 3, x.tolist()])
        for _ in range(r.integers(0, 4)):
            rows.append([k % 3, near(r, x, r.uniform(0.96, 1)).tolist()])
        if k % 10 == 0:
            rows.append([k % 3, x.tolist()])
            rows.append([k % 3 + 1, x.tolist()])
            rows.append([k % 3, (2 * x).tolist()])
    r.shuffle(rows)
    return [(i, *row) for i, row in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1], str(x[2])))


def report(spark, rows, **options):
    return order(tuple(r) for r in V.report(spark.createDataFrame([(*r, "y", 1) for r in rows], SCHEMA).repartition(3), **options).collect())


def test_equal_to_all_pairs(spark):
    rows = planted(1)
    bad = [None, [], [0.0] * 64, [None] * 64, [math.nan] + [1.0] * 63, [math.inf] + [1.0] * 63, [1.0] * 63]
    rows += [(10_000 + i, 1, x) for i, x in enumerate(bad + bad)]
    rows += [(20_000, None, rows[0][2]), (20_001, None, rows[0][2]), (None, rows[0][1], rows[0][2]), (None, 7, [1.0] * 64), (None, 7, [1.0] * 64), (3, *rows[3][1:]), (3, *rows[3][1:])]
    rows += [(30_000 + i, 9, [s * e for e in rows[0][2]]) for i, s in enumerate((1e-300, 1e300, -1.0, 5.0))]
    assert report(spark, rows) == order(plain(rows))
    assert report(spark, rows[:0]) == []


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    r = np.random.default_rng(5)
    x = r.normal(size=64)
    rows = [(i, 1, near(r, x, r.uniform(0.985, 1)).tolist()) for i in range(150)] + [(1000 + i, 1, x.tolist()) for i in range(60)]
    assert report(spark, rows) == order(plain(rows))


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(6)
    rows = []
    for k in range(3000):
        x = r.normal(size=64)
        rows += [(2 * k, 1, x.tolist()), (2 * k + 1, 1, near(r, x, 0.9801).tolist())]
    got = report(spark, rows)
    assert sum(n for _, n, _, _ in got) >= 0.995 * 6000


def test_short_vectors(spark):
    r = np.random.default_rng(7)
    rows = [(i, 0, r.normal(size=1 + i % 3).tolist()) for i in range(120)]
    got, want = report(spark, rows), order(plain(rows))
    assert sum(x[1] for x in got) >= 0.95 * sum(x[1] for x in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_report_equals_sql(spark, tmp_path):
    rows = planted(8, 80)
    path = f"{tmp_path}/e.parquet"
    frame = spark.createDataFrame([(*r, "y", 1) for r in rows], SCHEMA).select("vec_id", "label", "embedding")
    frame.coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in V.report(spark.read.parquet(path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    rel = duckdb.sql(V.ORACLE)
    assert rel.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got == sorted(rel.fetchall()) and sum(r[1] for r in got) > 50
