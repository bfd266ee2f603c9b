import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from loreloom.llm import fingerprints as P


def brute(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    out = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        out.add(h - 2**64 if h >= 2**63 else h)
    return sorted(out)[: P.SIZE]


def likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    u = sorted(set(a) | set(b))[: P.SIZE]
    return sum(h in a and h in b for h in u) / len(u)


def hexed(a):
    return "".join(f"{h % 2**64:016X}" for h in a)


TEXTS = ["one two three four five six seven", None, "", "Été à l'école, 日本 42!", "one two three four five six seven", " ".join(f"w{i % 700}" for i in range(1500)), " ".join(f"w{i}" for i in range(300)), "!?", "a b " * 400]


def check(docs, rows):
    got = sorted(map(tuple, P.report(docs).collect()), key=str)
    want = []
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        a, b, c = brute(text), brute(edited), brute(nxt)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, c)))
    assert got == sorted(want, key=str)


def test_report_equals_brute_force(spark, monkeypatch):
    rows = [(i * i * 7 - 40, TEXTS[i % len(TEXTS)]) for i in range(40)]
    schema = "doc_id long, text string, range string, h int, next_text string, copy string"
    docs = spark.createDataFrame([(*r, "x", 1, "y", None) for r in rows], schema)
    check(docs, rows)
    monkeypatch.setattr(P, "RANGE_BYTES", 10)
    check(docs, rows)
    check(docs.filter("doc_id = -40"), rows[:1])
    assert P.report(docs.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (3, "x y z"), (3, "x y z"), (None, None)]
    got = P.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("3", 5), ("3", 5), ("None", 0), ("None", 11)]
    assert all(r.edited_sha256 and 0 <= r.near_next <= 1 for r in got)


def test_estimates_and_merging(spark):
    parts = [(g, " ".join(f"w{i}" for i in range(s, s + 2000))) for g, s in ((1, 0), (1, 2004), (2, 1000), (3, 0))] + [(1, None)]
    df = spark.createDataFrame(parts, "g int, t string").select("g", P.sketch(F.col("t")).alias("s"))
    m = P.merged(df, ["g"], "s")
    want = {g: sorted({h for k, t in parts if k == g for h in brute(t)})[: P.SIZE] for g in (1, 2, 3)}
    assert {r.g: r.s for r in m.collect()} == want
    pair = m.filter("g = 3").select(F.col("s").alias("a")).crossJoin(m.filter("g = 1").select(F.col("s").alias("b")))
    r = pair.select(P.resemblance(F.col("a"), F.col("b")).alias("r"), P.containment(F.col("a"), F.col("b")).alias("c"), P.distinct_count(F.col("b")).alias("n"), P.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert abs(r.r - 0.5) < 0.15 and r.c > 0.7 and abs(r.n / 3992 - 1) < 0.35 and r.m == want[1]
