import hashlib
import random
import re

from loreloom.llm import decontaminate as D


def brute(docs, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            for i in range(max(1, len(v) - window + 1) if v else 0):
                x = v[i : i + window]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        ids.add(str(item_id))
        out[doc_id] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def fixture(seed):
    r = random.Random(seed)
    vocab = ["a", "B", "été", "x9", "日本", "the", "of"]
    text = lambda n: r.choice([" ", "\n", " - "]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(0, 8))) for i in range(12)] + [(2, "a B été x9 the"), (40, None), (41, "?! --")]
    docs = [(i, text(r.choice([0, 1, 5, 30]))) for i in range(40)] + [(100, None), (101, ""), (102, "a b " + "the of " * 500)]
    return docs, items


def test_report_equals_brute_force(spark):
    for seed in range(3):
        docs, items = fixture(seed)
        got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
        assert {r.doc_id: tuple(r)[1:6] for r in got} == brute(docs, items, 4)


def test_longest_match_and_place(spark):
    item = "one two three four five six"
    docs = spark.createDataFrame([(1, "zero " + item + " end"), (2, "two three four five x three four five six"), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item) for r in D.report(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), 3).collect()}
    assert got == {1: (6, 1, "7"), 2: (4, 0, "7"), 3: (0, None, None)}


def test_remove_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "clean text", 5, None), (2, "q w e r t y", 6, "z"), (3, None, 7, "z"), (1, "clean text", 5, None)], "doc_id long, text string, contaminated int, n_hit string")
    bench = spark.createDataFrame([(1, "w e r t")], "item_id long, text string")
    got = D.remove(docs, bench, 4)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.filter("doc_id != 2").collect()))
    assert D.remove(docs.limit(0), bench).count() == 0 and D.remove(docs, bench.limit(0)).count() == 4


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = fixture(9)
    monkeypatch.setattr(D, "BLOCK_BYTES", 20)
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == brute(docs, items, 4)


def test_longest_match_equals_brute_force():
    r = random.Random(5)
    for _ in range(60):
        items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randint(1, 14))).encode()) for i in range(r.randint(1, 5))]
        texts = [" ".join(r.choice("abcx") for _ in range(r.randint(0, 25))).encode() for _ in range(4)]
        got = D.scan_shard(texts, [D.TestSuffixes(items, 3)])
        for text, (_, hit, _, length, at, item) in zip(texts, got):
            w, best = text.split(), (0, -1)
            for p in range(len(w)):
                for _, other in items:
                    v = other.split()
                    for t in range(len(v)):
                        n = next((k for k in range(min(len(w) - p, len(v) - t)) if w[p + k] != v[t + k]), min(len(w) - p, len(v) - t))
                        if n >= min(3, len(v)) and n > best[0]:
                            best = (n, p)
            assert (length, at) == best and bool(hit) == bool(length)
            if length:
                assert b" " + b" ".join(w[at : at + length]) + b" " in b" " + dict((i.encode(), t) for i, t in items)[item.encode()] + b" "


def test_null_item_id_hits_and_is_left_out_of_the_list(spark):
    docs = spark.createDataFrame([(1, "q w e r t y"), (2, "fine words here now")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "w e r t"), (None, "e r t y")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.report(docs, bench, 4).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got == {1: (5, 1, none, True), 2: (0, 0, none, False)}
    assert [r.doc_id for r in D.remove(docs, bench, 4).collect()] == [2]


def test_a_passage_of_many_items_in_a_very_long_text():
    passage = " ".join(f"p{i}" for i in range(40))
    items = [(str(i), f"{passage} end{i}".encode()) for i in range(2000)]
    text = " ".join([passage, "filler words between"] * 3000).encode()
    (n_words, n_hit, ids, longest, at, _), = D.scan_shard([text], [D.TestSuffixes(items, 10)])
    assert (n_words, n_hit, len(ids), longest, at) == (43 * 3000, 40 * 3000, 2000, 40, 0)


def test_report_equals_sql(spark):
    import duckdb
    import pyarrow as pa

    r = random.Random(12)
    item = lambda n: " ".join(r.choice("abcdE") for _ in range(n))
    items = [(i, item(r.choice([3, 9, 10, 14, 25]))) for i in range(12)] + [(None, item(12)), (None, item(5)), (3, item(11)), (50, None), (51, "...")]
    items += [(60, items[4][1]), (7, items[4][1])]
    docs = [(i, " ".join([item(r.randint(0, 9)), (r.choice(items)[1] or "")[: r.randint(0, 60)], item(4), r.choice(items)[1] or ""])) for i in range(60)] + [(100, None), (101, "")]
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    documents = pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]})  # noqa: F841
    benchmark = pa.table({"item_id": pa.array([i[0] for i in items], pa.int64()), "text": [i[1] for i in items]})  # noqa: F841
    rel = duckdb.connect().sql(D.ORACLE)
    assert rel.columns == got.columns and sorted(rel.fetchall()) == sorted(map(tuple, got.collect()))


def test_several_blocks_are_files_and_one_is_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} has these words") for i in range(10)], "item_id long, text string")
    assert len(D.item_blocks(items, 10)) == 1 and not isinstance(D.item_blocks(items, 10)[0], str)
    monkeypatch.setattr(D, "BLOCK_BYTES", 20)
    blocks = D.item_blocks(items, 10)
    assert len(blocks) == 10 and all(isinstance(b, str) for b in blocks)
    assert sorted(x for b in blocks for x in D._items(b)) == sorted((str(i), f"item number {i} has these words".encode()) for i in range(10))
