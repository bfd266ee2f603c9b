import random

import numpy as np

from loreloom.llm import toxicity as X
from loreloom.llm.common import words_of

BAD, CLEAN = ["vile", "grubling", "grublot"], [f"w{i}" for i in range(200)]


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic, junk = r.random() < 0.2, r.random() < 0.2
        words = [r.choice(CLEAN) for _ in range(r.randint(20, 60))] + (r.sample(BAD, r.randint(1, 2)) if toxic else [])
        r.shuffle(words)
        rows.append((i, ("*** " if junk else " ").join(words), int(not junk), int(toxic)))
    return rows


def test_held_out_accuracy_and_chain_order(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:600]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.score(docs, labels).collect()}
    assert len(got) == 900
    held = rows[600:]
    assert np.mean([got[i].toxic == bool(t) for i, _, _, t in held]) > 0.97
    assert np.mean([(got[i].p_quality >= 0.5) == bool(q) for i, _, q, _ in held]) > 0.97
    left = X.remove(docs, labels)
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.toxic}


def test_later_links_get_out_of_fold_probabilities():
    rows = corpus(300, 2)
    docs = [set(words_of(t.encode())) for _, t, _, _ in rows]
    dense = np.array([X.ratios(t.encode(), words_of(t.encode()), len(d)) for (_, t, _, _), d in zip(rows, docs)])
    chain = X.fit_chain(docs, dense, np.array([[q, t] for _, _, q, t in rows], dtype=float), np.arange(300) % 5)
    assert [len(c.weights) for c in chain] == [4, 5]
    texts = [t.encode() for _, t, _, _ in rows]
    assert X.predict(chain, texts, [{}, {}]).shape == (300, 2)
    assert np.allclose(X.predict(chain, texts[:7], [{}, {}]), X.predict(chain, texts, [{}, {}])[:7])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x " * 50_000, None), (2, "", "b")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_class = spark.createDataFrame([(2, 1, 1), (None, 1, 1), (1, 5, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in X.score(docs, none).collect()] == [False] * 4
    assert X.remove(docs, none).columns == docs.columns and X.remove(docs, none).count() == 4
    assert all(r.toxic for r in X.score(docs, one_class).collect())
    assert X.score(docs.limit(0), one_class).count() == 0


def test_spark_counts_select_what_all_features_would(spark):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    got = X.train(docs, labels, ("quality", "toxic"), 400)
    words = [words_of(t.encode()) for _, t, _, _ in rows]
    dense = np.array([X.ratios(t.encode(), w, len(set(w))) for (_, t, _, _), w in zip(rows, words)])
    want = X.fit_chain([set(w) for w in words], dense, np.array([[q, t] for _, _, q, t in rows], dtype=float), np.array([X._fold(r[0]) for r in rows]))
    assert [set(x.words) for x in got] == [set(x.words) for x in want] and got[1].words
    assert all(np.allclose(x.weights, y.weights) and np.isclose(x.intercept, y.intercept) for x, y in zip(got, want))


def test_words_late_in_very_long_texts_count(spark):
    long = " ".join(f"u{i}" for i in range(30_000))
    rows = [(i, f"{long if i % 10 == 0 else 'plain words here'} {'vile' if i % 4 == 0 else 'nice'} end", 1, int(i % 4 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in X.score(docs, labels).collect())
