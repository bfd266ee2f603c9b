import random
from collections import Counter

import corpus_pipeline


def test_stages_take_effect_in_order(spark, tmp_path):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    bench = [r.choice(vocab) for _ in range(30)]
    for i in range(240):
        words = [r.choice(vocab) for _ in range(r.randint(30, 80))]
        toxic = i % 6 == 0
        if toxic:
            words[3:3] = ["vilest", "grubling"]
        if i % 20 == 1:
            words[5:5] = bench[4:20]
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
        if i % 10 == 3:
            copy = words[:]
            copy[r.randrange(len(copy))] = "edited"
            docs.append((1000 + i, " ".join(copy), "en", "s1", 0))
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(bench))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontaminate", "mix", "shard"]
    ids, frame = set(range(240)) | {1000 + i for i in range(240) if i % 10 == 3}, spark.read.parquet(f"{d}/documents.parquet")
    gone = [
        lambda i: i < 1000 and i % 6 == 0 or i >= 1000 and (i - 1000) % 6 == 0,
        lambda i: i >= 1000,
        lambda i: i % 20 == 1,
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, d)
        out.write.parquet(f"{d}/out-{k}")
        frame = spark.read.parquet(f"{d}/out-{k}")
        if k < 3:
            ids = {i for i in ids if not gone[k](i)}
            assert sorted(x.doc_id for x in frame.collect()) == sorted(ids), name
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)


def test_nulls_repeats_empty_tables_and_other_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, node string"
    rows = [(None, None), (None, "some words here of an unknown id"), (1, None), (2, ""), (3, "a text that is there twice in all"), (3, "a text that is there twice in all"), (4, "A text that is there twice, in all!"), (5, "word " * 100_000), (6, "words of the benchmark item are in here")]
    for name, docs, labels, bench in (("some", rows, [(3, 1, 0), (9, 1, 1), (None, None, None)], [(None, "of the benchmark item are in here or there"), (1, None)]), ("none", [], [], [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None if i == 2 else "s", 0, 1, "n") for i, t in docs], schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        frame = spark.read.parquet(f"{d}/documents.parquet")
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            out = run(spark, frame, d)
            assert stage == "shard" or out.columns == frame.columns
            out.write.parquet(f"{d}/out-{k}")
            frame = spark.read.parquet(f"{d}/out-{k}")
            if stage == "near_dup" and docs:
                assert sorted(((x.doc_id, (x.text or "")[:10]) for x in frame.collect()), key=str) == sorted([(None, ""), (None, "some words"), (1, ""), (2, ""), (3, "a text tha"), (5, "word word "), (6, "words of t")], key=str)
        got = Counter(x.doc_id for x in frame.collect())
        assert set(got) <= {None, 3, 5, 6} and (not docs or got[5])
