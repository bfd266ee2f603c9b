import random
from collections import Counter, defaultdict

from loreloom.llm import near_dup as N
from loreloom.llm.common import words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(1)
    for _ in range(3000):
        a = [r.choice("abcd") for _ in range(r.randint(0, 25))]
        b = list(a) if r.random() < 0.7 else [r.choice("abcd") for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 6)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = [r.choice("abcd")] * r.randint(0, 1)
        band, d = r.randint(0, 12), distance(a, b)
        got = N.banded_distance(a, b, band)
        assert got == d or got > band < d, (a, b, band, d, got)


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(800)]
    shared = [r.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.randint(40, 150))]
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append(copy)
    texts += [shared + [r.choice(vocab) for _ in range(r.randint(60, 90))] for _ in range(25)]
    texts += [texts[0], texts[0]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


def brute(rows, least):
    words = {i: words_of(t.encode()) for i, t in rows}
    root = {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(words)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = words[i], words[j]
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) <= longer * (1 - least) and 1 - distance(a, b) / longer >= least:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows, 0.8)
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert all(r.class_size == sizes[r.class_id] and r.stays == (i == r.class_id) for i, r in got.items())


def test_dedup_keeps_one_row_of_each_class(spark):
    rows = [(5, "a b c d e f g", "x", None), (3, "A b, c d e f g!", "y", 1), (3, "A b, c d e f g!", "y", 1), (7, None, "n", 2), (8, None, "n", 2), (9, "", None, 3), (1, "", "z", 3), (None, "q r s", "z", 4), (4, "q r s", "z", 4), (None, "alone here", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, head int")
    got = N.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, "A b, c d e f g!"), (7, None), (8, None), (1, ""), (4, "q r s"), (None, "alone here")], key=str)
    assert N.dedup(docs.limit(0)).count() == 0
    assert N.classes(docs).count() == len(rows)


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(99, 98)], "id long, head long")
    got = {r.id: r.root for r in N.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {99: 98}


def edited(r, n, edits):
    a = [f"w{r.randrange(50000)}" for _ in range(n)]
    b = list(a)
    for i in r.sample(range(n), edits):
        b[i] = f"x{r.randrange(10**9)}"
    return a, b


def test_scattered_edits_down_to_the_rule_have_an_equal_key():
    r, hashes = random.Random(5), N._WordHash()
    for n in (5, 6, 10, 15, 20, 24, 25, 30, 40, 60, 100, 130, 200, 500, 1000):
        for least in (0.9, 0.85, 0.81, 0.8):
            missed = 0
            for _ in range(100):
                a, b = ([x.encode() for x in side] for side in edited(r, n, int((1 - least) * n + 1e-9)))
                missed += not set(N.sketch(a, hashes).tolist()) & set(N.sketch(b, hashes).tolist())
            assert missed <= (0 if n <= N.SHORT else 2), (n, least, missed)


def test_short_texts_of_few_words_always_have_an_equal_key():
    r, hashes = random.Random(6), N._WordHash()
    for _ in range(4000):
        a = [r.choice(b"abcdefghijklmnop") for _ in range(r.randint(4, 22))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = [r.choice(b"abcdefghijklmnop")] * r.randint(0, 1)
        a, b = [b"%c" % x for x in a], [b"%c" % x for x in b]
        if a != b and max(len(a), len(b)) <= N.SHORT and N.similar(a, b, 0.8):
            assert set(N.sketch(a, hashes).tolist()) & set(N.sketch(b, hashes).tolist()), (a, b)


def test_classes_of_hard_pairs(spark):
    r = random.Random(7)
    texts = [t for n in (5, 10, 20, 40, 100, 300) for _ in range(20) for t in edited(r, n, n // 5)]
    got = N.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sum(x.class_id == x.doc_id - x.doc_id % 2 and x.class_size == 2 for x in got) >= len(texts) - 2
    assert all(x.class_size == 2 for x in got if len(texts[x.doc_id]) <= N.SHORT)


def boilerplate(r, pairs, share, edits, n=(200, 300)):
    """Pairs of texts that begin with a share of one boilerplate; the second has edits in its own part and elsewhere."""
    shared = [f"b{r.randrange(5000)}" for _ in range(n[1])]
    texts = []
    for _ in range(pairs):
        m = r.randint(*n)
        a = shared[: int(share * m)] + [f"w{r.randrange(50000)}" for _ in range(m - int(share * m))]
        b = list(a)
        for i in r.sample(range(m), int(edits * m)):
            b[i] = f"x{r.randrange(10**9)}"
        texts += [" ".join(a), " ".join(b)]
    return texts


def test_no_links_lost_in_large_buckets(spark):
    r = random.Random(8)
    for pairs, share, edits in ((400, 0.75, 0.17), (400, 0.75, 0.19), (300, 0.7, 0.15)):
        texts = boilerplate(r, pairs, share, edits)
        got = {x.doc_id: x.class_id for x in N.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        met = sum(got[2 * k] == got[2 * k + 1] for k in range(pairs))
        assert met >= 0.99 * pairs, (share, edits, met)


def test_cells_hold_all_pairs_of_different_components(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    r = random.Random(9)
    rows = [(b, i, 1000 if i < 30 else 2000 if i < 45 else i) for b in range(3) for i in range(70) if r.random() < 0.9] + [(9, i, 1000) for i in range(20)]
    got = N.cells(spark.createDataFrame(rows, "bucket long, id long, root long")).collect()
    sides = defaultdict(lambda: (set(), set()))
    for x in got:
        for k, side in enumerate((x.low, x.high)):
            if x.block == side:
                sides[x.bucket, x.low, x.high][k].add(x.id)
    met = defaultdict(set)
    for (b, _, _), (low, high) in sides.items():
        assert len(low) < 40 and len(high) < 40
        met[b] |= {(min(i, j), max(i, j)) for i in low for j in high if i != j}
    root = {(b, i): c for b, i, c in rows}
    for b in range(3):
        ids = [i for at, i, _ in rows if at == b]
        assert {(i, j) for i in ids for j in ids if i < j and root[b, i] != root[b, j]} <= met[b]
    assert 9 not in met


def test_words_in_common_are_counted_as_a_multiset(monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 16)
    r, hashes = random.Random(10), N._WordHash()
    texts = [[b"w%d" % r.randrange(40) for _ in range(r.choice([0, 1, 8, 60, 400]))] for _ in range(40)]
    got = N.in_common([N.bag(t, hashes) for t in texts[:15]], [N.bag(t, hashes) for t in texts[15:]])
    assert [[int(x) for x in row] for row in got] == [[sum((Counter(a) & Counter(b)).values()) for b in texts[15:]] for a in texts[:15]]
