"""A kept index gives the hits of a search without one, also after cards changed and went; drafts keep to their candidates."""

import random

import pandas as pd

from loreloom.operators import retrieval

SCHEMA = "id long, title string, summary string, object_name string, keywords array<string>, status string, publish_status string, retrieval_enabled boolean"


def cards(seed, n=60, start=0):
    r = random.Random(seed)
    word = lambda: f"word{r.randrange(40)}"
    return [(start + i, f"{word()} {word()}", " ".join(word() for _ in range(12)), r.choice(["", "word1", "host word2", None]), [word(), "重启 服务"], r.choice(["APPROVED", "DRAFT", "REJECTED"]), r.choice([None, "SKIPPED", "INDEXED"]), r.choice([None, True, False])) for i in range(n)]


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9), round(r.query_coverage, 9), tuple(r.matched_terms)) for r in df.collect())


def test_index_gives_the_same_hits(spark):
    rows = cards(1)
    asked = spark.createDataFrame([(1, "word1 word2 word3"), (2, "word5 重启服务"), (3, "nothing known"), (4, "restart host word2 now"), (5, "")], "query_id int, query string")
    held = spark.createDataFrame(rows, SCHEMA)
    index = retrieval.kept_index(held)
    want = hits(retrieval.search(held, asked))
    assert hits(retrieval.search(held, asked, index=index)) == want and {x[0] for x in want} == {1, 2, 4}
    changed = cards(2, 10, 0) + cards(3, 5, 100)
    now = [r for r in rows if r[0] >= 10 and r[0] % 7] + changed
    gone = spark.createDataFrame([(r[0],) for r in rows if r[0] % 7 == 0], "id long")
    index = retrieval.updated_index(index, spark.createDataFrame(changed, SCHEMA), gone)
    held = spark.createDataFrame(now, SCHEMA)
    assert hits(retrieval.search(held, asked, index=index)) == hits(retrieval.search(held, asked))


def test_drafts_keep_to_their_candidates(spark):
    held = spark.createDataFrame(cards(4), SCHEMA)
    drafts = spark.createDataFrame([("a", "word1 word2", ["word3"]), ("b", "unheard of", []), ("c", "word9", None)], "draft_id string, title string, keywords array<string>")

    def decide(pdf):
        assert set(pdf.columns) == {"draft_id", "query", "candidates"}
        return pd.DataFrame({"relation": ["related_to"] * len(pdf), "related_ids": [[-5] if d == "c" else [-5, c[-1], c[0]] for d, c in zip(pdf["draft_id"], pdf["candidates"])], "reason": pdf["query"]})

    got = {r.draft_id: r for r in retrieval.compared(drafts, held, decide).collect()}
    rejected = {r[0] for r in cards(4) if r[5] == "REJECTED"}
    a = got["a"]
    assert len(a.candidates) == 5 and not rejected & set(a.candidates) and (a.relation, a.reason) == ("RELATED_TO", "word1 word2 word3")
    assert sorted(a.related_ids) == sorted({a.candidates[0], a.candidates[-1]})
    assert (got["b"].relation, got["b"].candidates, got["b"].related_ids) == ("NEW", [], []) and (got["c"].relation, got["c"].related_ids) == ("NEW", [])


def test_scores_are_summed_where_the_cards_are(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_CARDS", 1)
    held = spark.createDataFrame(cards(5), SCHEMA)
    frequency = retrieval.term_frequency(held)
    plan = frequency._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and frequency.rdd.getNumPartitions() == 60
    asked, plans = spark.createDataFrame([(1, "word1 word2 word3"), (4, "restart host word2 now")], "query_id int, query string"), {}

    class Watched(retrieval.Table):
        def __init__(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            super().__init__(df, name)

    monkeypatch.setattr(retrieval, "Table", Watched)
    assert len(hits(retrieval.search(held, asked, index=retrieval.kept_index(held)))) == 12
    assert plans["card-terms"].count("Exchange ") == 1 and "wanted-terms" not in plans
    assert "FullOuter" not in plans["search-hits"] and "hashpartitioning(query_id#" in plans["search-hits"] and not any("hashpartitioning(query_id" in line and ", id#" in line for line in plans["search-hits"].split("\n"))
