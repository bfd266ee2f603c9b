import random

from loreloom.llm import line_dedup as L


def brute(rows, least):
    """Deletes every line of a run of at least so many words that has an equal run at an earlier place."""
    place, out = [], {}
    for doc_id, text in sorted({(i, t) for i, t in rows if t is not None}):
        lines = text.split("\n")
        kept = [k for k, x in enumerate(lines) if x.split()]
        seq = [lines[k].strip() for k in kept]
        gone = set()
        for i in range(len(seq)):
            for j in range(i + 1, len(seq) + 1):
                if sum(len(x.split()) for x in seq[i:j]) >= least:
                    run = seq[i:j]
                    earlier = any(other[s : s + len(run)] == run for other in place for s in range(len(other) - len(run) + 1)) or any(seq[s : s + len(run)] == run for s in range(i))
                    if earlier:
                        gone |= set(range(kept[i], kept[j - 1] + 1))
        place.append(seq)
        out[doc_id] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_equals_brute_force(spark):
    for seed in range(3):
        r = random.Random(seed)
        pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(12)] + ["", "  "]
        passage = [r.choice(pool) for _ in range(6)]
        rows = []
        for i in range(30):
            lines = [r.choice(pool) + (f" u{r.random()}" if r.random() < 0.4 else "") for _ in range(r.randint(0, 8))]
            if r.random() < 0.5:
                k = r.randint(0, len(lines))
                lines[k:k] = passage
            rows.append((i * 3 % 31, "\n".join(lines)))
        got = L.remove(spark.createDataFrame(rows, "doc_id long, text string"), 12, report=True).collect()
        assert {x.doc_id: x.text for x in got} == brute(rows, 12)


def test_one_long_line_and_short_repeats(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"intro\n{long}\nend"), (2, f"other\n  {long} \nend"), (3, "end\nintro"), (4, None), (5, ""), (2, f"other\n  {long} \nend"), (None, long), (7, long), (8, f"{long}\nmid\n{long}")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, run_list string")
    got = L.remove(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, f"intro\n{long}\nend"), (2, "other"), (2, "other"), (3, "end\nintro"), (4, None), (5, ""), (None, ""), (7, ""), (8, "mid")], key=str)
    report = {(r.doc_id, r.n_lines, r.n_removed, tuple(r.sources)) for r in L.remove(docs, report=True).collect()}
    assert report == {(1, 3, 0, ()), (2, 3, 2, (1,)), (3, 2, 0, ()), (4, 0, 0, ()), (5, 1, 0, ()), (None, 1, 1, (1,)), (7, 1, 1, (1,)), (8, 3, 2, (1,))}
    assert L.remove(docs.limit(0)).count() == 0


def test_winnowing_selects_few_positions_and_every_window_has_one():
    r = random.Random(4)
    hashes, counts = [r.getrandbits(62) for _ in range(5000)], [5] * 5000
    picks = L.winnow(hashes, counts, 50)
    assert sorted(w for ws in picks.values() for w in ws) == L.windows(counts, 50)
    assert all(s <= p < e and hashes[p] == min(hashes[s:e]) for p, ws in picks.items() for s, e in ws)
    assert len(picks) < 1.15 * 2 / 11 * len(hashes)  # the density of windows of 10 lines
    assert len(L.winnow([7] * 5000, counts, 50)) <= 501


def test_equal_lines_common_lines_and_a_very_long_text(spark):
    r = random.Random(9)
    common = "the same short line here"
    unique = lambda n: " ".join(f"u{r.getrandbits(50)}" for _ in range(n))
    passage = [unique(12) for _ in range(6)]
    long = [unique(12) for _ in range(60_000)]  # some 10 MB
    rows = [(1, "\n".join([common] * 20_000)), (2, "\n".join([*long[:30_000], *passage, *long[30_000:]])), (3, None), (4, "\n".join([unique(3), *passage, common]))]
    rows += [(10 + i, "\n".join([unique(20), common, unique(20)])) for i in range(300)]
    got = {x.doc_id: x for x in L.remove(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    assert got[1].text == common and got[1].n_removed == 19_999
    assert got[2].text == rows[1][1] and got[4].n_removed == 6 and got[4].sources == [2]
    assert all(got[10 + i].n_removed == 0 for i in range(300))
