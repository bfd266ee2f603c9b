import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb

from loreloom.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, place int, n int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node (siblings before, after) level by level."""
    found, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        runs = [now[i : i + 3] for i in range(0, len(now), 3)]
        for k, p in enumerate(at):
            run = runs[p // 3]
            found[k].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        now, at = [h(*r) for r in runs], [p // 3 for p in at]
    return now[0], found


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        by[r[1]].append((r[0], leaf(r[:5]), leaf([*r[:4], r[4].replace("\n", "")]) if bad else leaf(r[:5])))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in by[s]])
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (doc_id, mine, changed), path in zip(by[s], trees[s][1]):
            path, node = path + top, changed
            for before, after in path:
                node = h(before, node, after)
            out.append((doc_id, mine, trees[s][0], root, h(*(a + b for a, b in path)), node, node == root))
    return out


def test_equal_to_a_plain_tree(spark):
    r = random.Random(3)
    for n, sources in ((1, 1), (2, 1), (3, 1), (4, 2), (30, 40), (200, 7), (400, 2)):
        rows = []
        for i in range(n):
            source = r.choice([None, "", "src", "Ünï", *(f"s{k}" for k in range(sources))]) if r.random() < 0.6 else "hot"
            text = r.choice([None, "", "a\nb", "\n", "plain", "é\n\nü" * 50])
            rows.append((r.choice([i, i, None, 5]), source, r.choice([None, "en"]), r.choice([None, 3, -1]), text, "x", 1, 2))
        rows += rows[:3]  # equal in every column
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
        assert sorted((tuple(x) for x in M.report(docs).collect()), key=key) == sorted(plain(rows), key=key), n
    assert M.report(docs.limit(0)).count() == 0


def test_tampering_is_found_only_where_the_text_changed(spark):
    rows = [(i, "s", "en", 1, "a\nb" if i % 3 else "ab", None, None, None) for i in range(60)]
    got = {r.doc_id: r.verified for r in M.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: not (i % 3 and zlib.crc32(str(i).encode()) % 2 == 0) for i in range(60)}


def test_one_source_is_numbered_in_ranges(spark):
    rows = spark.range(20000).selectExpr("'hot' AS source", "cast(id % 7 AS long) AS key", "sha2(cast(id AS string), 256) AS node")
    got = M.numbered(rows, "source", ["key", "node"]).collect()
    got.sort(key=lambda r: r.place)
    assert [r.place for r in got] == list(range(20000)) and {r.n for r in got} == {20000}
    assert [(r.key, r.node) for r in got] == sorted((r.key, r.node) for r in got)


def test_report_equals_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = sorted(tuple(r) for r in M.report(spark.read.parquet(path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}'")
    rel = duckdb.sql(M.ORACLE)
    assert rel.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got == sorted(rel.fetchall()) and {r[-1] for r in got} == {True, False}
