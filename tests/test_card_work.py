"""What the card builder does once: cases are known to be small without their cards, and texts are searched only where they must be."""

import random
import re

from pyspark.sql import functions as F

from loreloom.functions import text as ft
from loreloom.operators import cards


def test_cases_are_sized_by_their_steps(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = [(c, n, "IMPLEMENTATION", "x", f"set param a {n // 2} -> 2") for c in (1, 2) for n in range(4)]
    source = spark.createDataFrame(rows, "case_id long, position int, phase string, name string, operation string")
    made = cards.step_cards(source)
    got = cards.canonical_cards(made.mapInArrow(counted, made.schema), steps_of=source)
    assert sorted((r.case_id, r.position, r.canonical_id != r.unit_id) for r in got.collect()) == [(c, n, n > 0) for c in (1, 2) for n in range(4)]
    assert calls.value == 8


def test_no_case_has_more_cards_than_its_steps_allow(spark):
    r = random.Random(3)
    part = lambda k: f"{k}. part{r.choice(['', ' '])}\n" + "\n".join(r.choice(["check " + "x" * r.randint(0, 40), "", f"  {k}、set it", "   1. "]) for _ in range(r.randint(0, 4)))
    rows = [(c, n, "IMPLEMENTATION", r.choice([None, "", "n"]), r.choice([None, "", "\n".join(part(k) for k in range(1, r.randint(1, 7)))])) for c in range(30) for n in range(4)]
    source = spark.createDataFrame(rows, "case_id long, position int, phase string, name string, operation string")
    made = cards.step_cards(source, long_chars=1, least_sections=1, child_chars=0)
    have = {x.case_id: (x.n, x.chars) for x in made.groupBy("case_id").agg(F.count("*").alias("n"), F.sum(F.length("operation")).alias("chars")).collect()}
    most = {x.case_id: (x.n, x.chars) for x in cards.most_cards(source).collect()}
    assert made.filter("section >= 0").count() > 10 and all(n <= most[c][0] and chars <= most[c][1] for c, (n, chars) in have.items())


def test_noop_responses_against_a_plain_reading(spark):
    def plain(t):
        folded = (t or "").lower()
        rest = folded
        for p in ft.NOOP_PHRASES:
            rest = rest.replace(p, "")
        return next((p for p in ft.NOOP_PHRASES if p in folded), "") if len(re.sub(ft.NOOP_FILLER, "", rest)) <= 6 else ""

    r = random.Random(7)
    parts = [*ft.NOOP_PHRASES, "No Impact", "NOT APPLICABLE", "无 影响", "确认", "。", "\n", "abc", "检查", "x" * 9, "no İmpact"]
    texts = [None, "", *("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(400))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ft.noop_response(F.col("t")).alias("r"))
    rows = [(x.t, x.r) for x in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr((t, plain(t))) for t in texts) and len({x for _, x in rows}) > 4


def test_no_part_of_the_report_is_broadcast(spark):
    rows = [(c, n, p, "x", o) for c in (1, 2) for n, (p, o) in enumerate([("IMPLEMENTATION", "set param a 1 -> 2"), ("VALIDATION", "check param a == 2")])]
    source = spark.createDataFrame(rows, "case_id long, position int, phase string, name string, operation string")
    facts = spark.createDataFrame([(1,)], "case_id long")
    got = cards.build_report(source, cards.canonical_cards(cards.step_cards(source), steps_of=source), facts.limit(5), facts.limit(5))
    assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 6
    assert [(r.case_id, r.parents, r.validates, r.contexts) for r in got.orderBy("case_id").collect()] == [(1, 2, 1, 1), (2, 2, 1, 0)]
