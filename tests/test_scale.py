"""What larger tables need: bounded batches, work that is spread, texts and nodes that are shuffled once."""

import random

from loreloom.operators import adapter, cards, governance, matching, records, retrieval


def test_budget_at_the_limit_is_not_past_it(spark):
    events = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.01)], "user_id long, event_id long, tokens double")
    got = governance.budget_spent(events, "user_id", ["event_id"], {"tokens": 0.3}).orderBy("event_id").collect()
    assert [r.exceeded for r in got] == ["", "", "tokens"]


def test_nodes_are_dealt_over_tasks_in_small_batches(spark):
    docs = spark.createDataFrame([(k, '{"a":[{"b":1,"c":""},null]}') for k in range(40)], "doc_id long, text string").coalesce(1)
    got = adapter.nodes(docs)
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    root = got.filter("doc_id = 7").orderBy("start").collect()
    assert [(r.pointer, r.members, r.arrays, r.scalars, r.signature) for r in root] == [("", 1, 1, 0, "a"), ("/a", 2, 0, 1, None), ("/a/0", 2, 0, 2, "b/c"), ("/a/0/b", 0, 0, 0, None), ("/a/0/c", 0, 0, 0, None), ("/a/1", 0, 0, 0, None)]


def test_recall_has_a_place_for_zero_vectors_and_equal_likenesses(spark):
    rows = [(k, [float(k % 7 + 1), 2.0, 3.0]) for k in range(60)] + [(90, [0.0, 0.0, 0.0]), (91, [1.0, 2.0]), (92, None), (93, [2.0, 4.0, 6.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0])], "query_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.rank) for r in retrieval.semantic_recall(vectors, asked, top_k=12).orderBy("query_id", "rank").collect()]
    assert got[:10] == [(1, v, i) for i, v in enumerate([0, 7, 14, 21, 28, 35, 42, 49, 56, 93], 1)]
    assert got[12:] == [(2, 91, 1)]
    every = retrieval.semantic_recall(vectors, asked.filter("query_id = 1"), top_k=100).orderBy("rank").collect()
    assert len(every) == 62 and every[-1].vec_id == 90 and every[-1].similarity is None


def test_relations_are_dealt_over_tasks_and_join_by_both_values(spark):
    rows = [(1, 1, "IMPLEMENTATION", "set param a 1 -> 2 and param b"), (1, 2, "VALIDATION", "check param a == 2"), (1, 3, "ROLLBACK", "set param a 2 -> 1"), (1, 4, "ROLLBACK", "set param a 2 -> 3"), (1, 5, "VALIDATION", "check param c == 2"),
            (1, 6, "IMPLEMENTATION", "set param a"), (1, 7, "ROLLBACK", "set param b and param a 2 -> 1"), (2, 8, "VALIDATION", "check param b == 2 == 9"), (2, 9, "IMPLEMENTATION", "set param b 9 -> 9"), (2, 9, "IMPLEMENTATION", "set param b 9 -> 9"), (2, 10, "ROLLBACK", None)]
    steps = spark.createDataFrame(rows, "case_id long, unit_id long, phase string, operation string")
    got = records.relationships(records.relationship_signature(steps))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, "VALIDATES"), (1, 3, 1, "ROLLBACK_OF"), (1, 7, 1, "ROLLBACK_OF"), (2, 8, 9, "VALIDATES")]
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_report_makes_the_cards_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = [(c, n, p, "x", o) for c in (1, 2) for n, (p, o) in enumerate([("IMPLEMENTATION", "set param a 1 -> 2"), ("VALIDATION", "check param a == 2"), ("ROLLBACK", "set param a 2 -> 1")])]
    source = spark.createDataFrame(rows, "case_id long, position int, phase string, name string, operation string")
    built = cards.canonical_cards(cards.step_cards(source))
    facts = spark.createDataFrame([(1,)], "case_id long")
    got = cards.build_report(source, built.mapInArrow(counted, built.schema), facts, facts).orderBy("case_id").collect()
    assert [(r.source_steps, r.parents, r.reused, r.validates, r.rollbacks, r.contexts, r.coverage) for r in got] == [(3, 3, 0, 1, 1, 1, 1.0), (3, 3, 0, 1, 1, 0, 1.0)]
    assert calls.value == 6


def test_frequent_terms_bring_no_strangers_together(spark, monkeypatch):
    r, rows = random.Random(4), []
    for size in (1, 2, 5, 9, 10, 11, 19, 20, 21, 60, 150):
        for _ in range(12):
            base = r.sample(range(3 * size + 2), size)
            rows.append(base)
            rows.append(base + [900])  # one more
            rows.append([x for x in base if r.random() > 0.08])  # some fewer
            rows.append([x if r.random() > 0.06 else 1000 + x for x in base])  # some others
    rows.append(rows[5] * 2)
    items = spark.createDataFrame([(k, [f"t{x}" for x in row]) for k, row in enumerate(rows)], "id long, terms array<string>").repartition(3)
    tables = {}

    class Watched(matching.Table):
        def __init__(self, df, name):
            super().__init__(df, name)
            tables[name] = self.df.count()

    monkeypatch.setattr(matching, "Table", Watched)
    sets = [(k, frozenset(row)) for k, row in enumerate(rows) if row]
    for least in (0.9, 0.8):
        heads, want = {}, set()
        for k, s in sets:
            if k != (head := heads.setdefault(s, k)):
                want.add((head, k, 1.0))
        own = [(k, s) for s, k in heads.items()]
        want |= {(a, b, len(s & t) / len(s | t)) for a, s in own for b, t in own if a < b and len(s & t) / len(s | t) >= least}
        assert set(map(tuple, matching.near_duplicate_pairs(items, least).collect())) == want and len(want) > 100
    # Of few terms that all sets have, still only what is nearly alike meets.
    same = spark.createDataFrame([(k, [f"t{x}" for x in r.sample(range(200), 100)]) for k in range(300)], "id long, terms array<string>")
    assert matching.near_duplicate_pairs(same).count() == 0 and tables["jaccard-met"] < 450  # 44850 pairs share terms
