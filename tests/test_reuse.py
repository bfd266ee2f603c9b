"""Canonical cards against the plain loop over each document."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

from loreloom.operators import dedup, reuse

SCHEMA = "document_id string, unit_id long, parent_id long, position int, fingerprint string, text string"


def plain(rows, least=0.92):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for cards in by.values():
        canonical = []
        for doc, unit, parent, at, print_, text in sorted(cards, key=lambda r: (r[3] is None, r[3] or 0, r[1])):
            found, like = None, 0.0
            for u, p, f, t in canonical:
                if parent is not None and p == parent:
                    continue
                if print_ is not None and f == print_:
                    found, like = u, 1.0
                    break
                if text and (ratio := SequenceMatcher(None, text, t or "").ratio()) >= least and ratio > like:
                    found, like = u, ratio
            if found is None:
                canonical.append((unit, parent, print_, text))
            out[doc, unit] = (unit, 1.0) if found is None else (found, like)
    return out


def same(spark, rows):
    got = dedup.reuse(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(r.document_id, r.unit_id): (r.canonical_id, r.similarity) for r in got} == plain(rows) and len(got) == len(rows)


def drifting(r, n, length, letters="abcdefgh 0123"):
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, length))) for _ in range(max(2, n // 12))]
    out = []
    for _ in range(n):
        t = list(r.choice(texts))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k = r.randint(0, len(t))
            t[k : k + r.randint(0, 2)] = r.choice(letters)
        out.append("".join(t))
        if r.random() < 0.5:
            texts[r.randrange(len(texts))] = out[-1]
    return out


def test_equal_to_the_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(reuse, "BLOCK", 7)
    r = random.Random(2)
    rows = []
    for doc, (n, length) in {"a": (120, 20), "b": (90, 60), "c": (60, 400), None: (30, 40), "one": (1, 5)}.items():
        for text in drifting(r, n, length):
            unit = len(rows)
            rows.append((doc, unit, r.choice([None, None, 1, 2, 3, unit]), r.choice([unit, unit, 5, None]), r.choice([str(unit), str(unit), "f1", "f2", None]), r.choice([text] * 9 + [None, ""])))
    same(spark, rows)


def test_many_copies_with_parents_of_their_own(spark):
    r = random.Random(3)
    t = "restart the payment service on node alpha and verify its health"
    rows = [("d", i, r.choice([None, i, i % 5]), i, r.choice(["same", "same", str(i)]), r.choice([t, t, t + "!", t[:-4]])) for i in range(300)]
    same(spark, rows)


def test_bounds_never_exclude_an_alike_pair():
    r = random.Random(4)
    for length in (3, 12, 50, 250):
        a, b = drifting(r, 40, length), drifting(r, 40, length)
        kept = set(reuse.alike(a, b, 0.92))
        assert all((i, j) in kept for i, x in enumerate(a) for j, y in enumerate(b) if SequenceMatcher(None, x, y).ratio() >= 0.92)


def test_a_document_of_many_cards(spark):
    rows = spark.range(12000).selectExpr("'d' AS document_id", "id AS unit_id", "cast(null AS long) AS parent_id", "cast(id AS int) AS position", "sha2(cast(id AS string), 256) AS fingerprint", "concat(sha2(cast(id % 9000 AS string), 256), ' step ', id % 9000) AS text")
    got = dedup.reuse(rows).selectExpr("sum(cast(canonical_id != unit_id AS int)) AS n", "count(*) AS k", "sum(cast(canonical_id = unit_id % 9000 AS int)) AS right").first()
    assert (got.n, got.k, got.right) == (3000, 12000, 12000)


def test_empty(spark):
    assert dedup.reuse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rounds_and_one_pass_agree(spark, monkeypatch):
    r = random.Random(9)
    rows = [(doc, i * 10 + k, r.choice([None, 1, 2]), r.choice([None, k % 9]), r.choice([None, f"p{r.randrange(15)}"]), text) for i, doc in enumerate(["a", None]) for k, text in enumerate(drifting(r, 40, 40))]
    rows += [("small", 900 + k, None, k, None, "x" * k) for k in range(3)]
    same(spark, rows)
    monkeypatch.setattr(reuse, "FEW_CARDS", 39)
    same(spark, rows)


def test_cards_of_small_cases_stay_where_their_steps_are(spark):
    from loreloom.operators import cards

    steps = spark.createDataFrame([(c, n, "IMPLEMENTATION", "set it", f"set parameter a {n // 2} -> 2") for c in range(20) for n in range(4)], "case_id long, position int, phase string, name string, operation string")
    built = cards.canonical_cards(cards.step_cards(steps))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert sorted((r.position, r.canonical_id != r.unit_id) for r in built.filter("case_id = 3").collect()) == [(0, False), (1, True), (2, True), (3, True)]
