"""Toxicity by classifier chains.

The categories are predicted one after the other. Each is a linear (logistic) model on whole-text features and on the
probabilities of all earlier categories; later models are trained with out-of-fold predictions of the earlier ones, so
that they see errors of the size that new documents have. Features are the presence of words and of word beginnings
(compounds and inflections of a word share one) and a few ratios. A word or beginning is a feature of a category if its
association with it is significant (chi-square above ``CHI2``) in the training rows; so rare noise words get no weight,
however many a long document has.

Training takes at most ``train_rows`` labelled documents (those with the smallest hash of doc_id), whole. How often each
feature goes with each category is counted by Spark, in all and without each fold; the ``CANDIDATES`` most significant
of each count are all that a model could select, and which of them each document has is all that reaches the driver.
Scoring takes all documents, whole, map-only: the model is a few hundred numbers.

Defined cases: null text scores as the empty text; labels other than 0 and 1, null doc_ids in labels and labels without
a document are left out of the training; of several labels of a doc_id each category's largest counts, of several
documents of a doc_id the text with the smallest hash; a category without both classes in the training
rows has its base rate as probability; empty documents give no rows; other columns are kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, small_batches, utf8, words_of

CHI2, MOST_WORDS, LEAST_ROWS, FOLDS, RIDGE, MEMO = 24.0, 400, 3, 5, 1.0, 50_000
#: Eight times what is selected: a word and its beginnings, six features at most, can have equal counts.
CANDIDATES, COUNTED = 8 * MOST_WORDS, 100_000
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PLAIN = _UPPER + _LOWER + b"0123456789 \n.,'" + bytes(range(128, 256))


def lexical(word: bytes) -> tuple[bytes, ...]:
    """The features of a word: itself, and its beginnings of 4 to 8 bytes, marked by a space."""
    return (word, *(word[:n] + b" " for n in range(4, min(len(word), 8) + 1)))


def ratios(text: bytes, words: list[bytes], distinct: int) -> tuple[float, ...]:
    """Upper-case share of ASCII letters, share of unusual symbols, share of repeated words, log of the word count."""
    upper, lower = len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _LOWER))
    odd = len(text.translate(None, _PLAIN))
    n = len(words)
    return upper / max(upper + lower, 1), odd / max(len(text), 1), 1 - distinct / max(n, 1), float(np.log1p(n))


@dataclass
class Link:
    """One category's model: weights of words, of ratios and earlier categories (standardised), and the intercept."""

    words: dict[bytes, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def logits(self, docs: list[set[bytes]], dense: np.ndarray, memo: dict[bytes, tuple[bytes, ...]]) -> np.ndarray:
        """memo: keeps the known features of words that were seen, up to a bound."""
        if len(memo) > MEMO:
            memo.clear()
        known, lex = self.words.keys(), np.zeros(len(docs))
        for i, d in enumerate(docs):
            found = set()
            for w in d:
                if (f := memo.get(w)) is None:
                    f = memo[w] = tuple(known & lexical(w))
                if f:
                    found.update(f)
            lex[i] = sum(self.words[w] for w in sorted(found))
        return lex + (dense - self.mean) / self.scale @ self.weights + self.intercept


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sample:
    """The training rows' lexical features as numbers: ids[starts[i]:starts[i + 1]] are those of row i."""

    def __init__(self, docs: Iterable[Iterable[bytes]], features: Callable[[bytes], tuple[bytes, ...]] = lexical):
        number: dict[bytes, int] = {}
        rows = [np.fromiter({number.setdefault(f, len(number)) for w in d for f in features(w)}, np.int32) for d in docs]
        ids = np.concatenate([*rows, np.zeros(0, np.int32)])
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        del rows
        often = np.bincount(ids, minlength=len(number)) >= LEAST_ROWS  # no rarer feature can be selected
        self.names = [f for f, o in zip(number, often.tolist()) if o]
        number.clear()
        kept = often[ids]
        self.ids, self.row = (np.cumsum(often, dtype=np.int32) - 1)[ids[kept]], row[kept]

    def select(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The MOST_WORDS features with the largest chi-square above CHI2 in rows (a mask); of features that the same
        numbers of documents have, the one that goes on in the other is dropped."""
        n, pos = int(rows.sum()), int(y[rows].sum())
        ids = self.ids[rows[self.row]]
        k = np.bincount(ids, minlength=len(self.names)).astype(float)
        a = np.bincount(ids, y[self.row[rows[self.row]]], minlength=len(self.names))
        some = np.flatnonzero((k >= LEAST_ROWS) & (k < n))
        chi2 = n * (a[some] * n - k[some] * pos) ** 2 / (k[some] * (n - k[some]) * pos * (n - pos))
        strong = some[chi2 > CHI2]
        whole = {(self.names[i].rstrip(b" ")[:m], a[i], k[i]) for i in strong for m in range(4, len(self.names[i].rstrip(b" ")) + (self.names[i][-1:] != b" "))}
        kept = [(-c, self.names[i], i) for i, c in zip(strong, chi2[chi2 > CHI2]) if not (self.names[i].endswith(b" ") and (self.names[i][:-1], a[i], k[i]) in whole)]
        return np.array([i for _, _, i in sorted(kept)[:MOST_WORDS]], dtype=np.int64)

    def matrix(self, features: np.ndarray, n: int) -> np.ndarray:
        place = np.full(len(self.names), -1)
        place[features] = np.arange(len(features))
        at = place[self.ids]
        x = np.zeros((n, len(features)))
        x[self.row[at >= 0], at[at >= 0]] = 1
        return x


def fit(sample: Sample, rows: np.ndarray, dense: np.ndarray, y: np.ndarray) -> tuple[Link, np.ndarray]:
    """Ridge logistic regression by Newton steps on the rows of a mask, and the logits of all rows."""
    mean, scale = dense[rows].mean(axis=0), dense[rows].std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    if y[rows].min() == y[rows].max():
        sure = 30.0 if y[rows][0] else -30.0
        return Link({}, mean, scale, np.zeros(dense.shape[1]), sure), np.full(len(y), sure)
    features = sample.select(rows, y)
    m = len(features)
    every = np.c_[sample.matrix(features, len(y)), (dense - mean) / scale, np.ones(len(y))]
    x, target = every[rows], y[rows]
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[:m] = 0.1 * RIDGE
    penalty[-1] = 1e-6
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (target - p) - penalty * w)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return Link(dict(zip((sample.names[i] for i in features), w[:m].tolist())), mean, scale, w[m:-1], float(w[-1])), every @ w


def fit_chain(docs: Iterable[Iterable[bytes]], dense: np.ndarray, labels: np.ndarray, folds: np.ndarray, features: Callable[[bytes], tuple[bytes, ...]] = lexical) -> list[Link]:
    """A link for each column of labels; later links see the out-of-fold probabilities of earlier ones."""
    sample, chain = Sample(docs, features), []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        link, _ = fit(sample, np.ones(len(y), dtype=bool), dense, y)
        chain.append(link)
        if k + 1 < labels.shape[1]:
            out = np.zeros(len(y))
            for f in np.unique(folds):
                rest = folds != f
                out[~rest] = _sigmoid(fit(sample, rest, dense, y)[1][~rest]) if rest.any() else y.mean()
            dense = np.c_[dense, out]
    return chain


def predict(chain: list[Link], texts: list[bytes | None], memos: list[dict]) -> np.ndarray:
    """Probabilities, a column for each category. memos: a dict for each link, kept between calls."""
    docs, dense = [], np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        words = words_of(t)
        docs.append(set(words))
        dense[i] = ratios(t or b"", words, len(docs[-1]))
    for link, memo in zip(chain, memos):
        dense = np.c_[dense, _sigmoid(link.logits(docs, dense, memo))]
    return dense[:, 4:]


def _fold(doc_id: int) -> int:
    return doc_id * 2654435761 % 2**32 * FOLDS >> 32


def candidate_features(rows: DataFrame, labels: np.ndarray, folds: np.ndarray) -> set[bytes]:
    """The CANDIDATES most significant features of rows(doc_id, words, y), of each category over all rows, and of each but
    the last also without each fold."""
    n = labels.shape[1]
    columns = [f"c{f}_{j}" for f in range(FOLDS) for j in range(n + 1)]  # rows of a fold with the feature, then positives of each category

    def count(batches):
        held: dict[bytes, np.ndarray] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), *(pa.array(c, pa.int64()) for c in np.stack(list(held.values()), axis=1))], ["feature", *columns])
            held.clear()
            return out

        for b in batches:
            for doc_id, words, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "words", "y"))):
                one = np.zeros(len(columns), dtype=np.int64)
                one[_fold(doc_id) * (n + 1) : (_fold(doc_id) + 1) * (n + 1)] = [1, *y]
                for f in {f for w in words.split() for f in lexical(w)}:
                    held[f] = held[f] + one if f in held else one
                if len(held) > COUNTED:
                    yield flush()
        if held:
            yield flush()

    counts = rows.select("doc_id", "words", "y").mapInArrow(count, ", ".join(["feature binary", *(f"{c} long" for c in columns)])).groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))
    every = sum((F.col(f"c{f}_0") for f in range(FOLDS)), F.lit(0))
    counts = Table(counts.filter(every >= LEAST_ROWS), "toxicity-counts")
    out: set[bytes] = set()
    for j in range(n):
        for left in (None, *(range(FOLDS) if j + 1 < n else ())):
            used = [f for f in range(FOLDS) if f != left]
            rest = np.isin(folds, used)
            size, positive = float(rest.sum()), float(labels[rest, j].sum())
            if not 0 < positive < size:
                continue
            k, a = (sum((F.col(f"c{f}_{i}") for f in used), F.lit(0)).cast("double") for i in (0, j + 1))
            chi2 = size * (a * size - k * positive) ** 2 / (k * (size - k) * positive * (size - positive))
            best = counts.df.filter((k >= LEAST_ROWS) & (k < size)).select("feature", chi2.alias("chi2")).filter(F.col("chi2") > CHI2)
            out.update(bytes(r["feature"]) for r in best.orderBy(F.desc("chi2"), "feature").limit(CANDIDATES).collect())
    counts.drop()
    return out


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], train_rows: int) -> list[Link]:
    """The chain, fitted on the driver on at most train_rows labelled documents: their candidate features and ratios."""
    usable = labels.select("doc_id", *(F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories))).filter(" AND ".join(["doc_id IS NOT NULL", *(f"y{i} IN (0, 1)" for i in range(len(categories)))]))
    ys = [f"y{i}" for i in range(len(categories))]
    one = usable.groupBy("doc_id").agg(*(F.max(y).alias(y) for y in ys))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).withColumnRenamed("doc_id", "labelled")
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    joined = joined.groupBy("doc_id", *ys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    def read(batches):
        for b in batches:
            texts = utf8(b.column("text"))
            words = [words_of(t) for t in texts]
            distinct = [set(w) for w in words]
            y = [list(r.values()) for r in b.select(ys).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.array([b" ".join(sorted(d)) for d in distinct], pa.binary()),
                pa.array([list(ratios(t or b"", w, len(d))) for t, w, d in zip(texts, words, distinct)], pa.list_(pa.float64())), pa.array(y, pa.list_(pa.int32())),
            ], ["doc_id", "words", "ratios", "y"])

    rows = Table(joined.mapInArrow(read, "doc_id long, words binary, ratios array<double>, y array<int>"), "toxicity-sample")
    told = sorted(rows.df.select("doc_id", "ratios", "y").collect())
    if not told:
        rows.drop()
        return [Link({}, np.zeros(4 + k), np.ones(4 + k), np.zeros(4 + k), -30.0) for k in range(len(categories))]
    y, folds = np.array([r["y"] for r in told], dtype=float), np.array([_fold(r["doc_id"]) for r in told])
    wanted = candidate_features(rows.df, y, folds)

    def features(batches):
        for b in batches:
            found = [list({f for w in words.split() for f in lexical(w) if f in wanted}) for words in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "features"])

    have = {r["doc_id"]: [bytes(f) for f in r["features"]] for r in rows.df.select("doc_id", "words").mapInArrow(features, "doc_id long, features array<binary>").collect()}
    rows.drop()
    return fit_chain((sorted(have[r["doc_id"]]) for r in told), np.array([r["ratios"] for r in told]), y, folds, lambda f: (f,))


def score(docs: DataFrame, labels: DataFrame, *, categories: tuple[str, ...] = ("quality", "toxic"), threshold: float = 0.5, train_rows: int = 4000) -> DataFrame:
    """For each document doc_id, p_<category> for each category, and the last category's decision, named as it is."""
    small_batches(docs.sparkSession)
    chain = train(docs, labels, categories, train_rows)
    names = [f"p_{c}" for c in categories]

    def run(batches):
        memos = [{} for _ in chain]
        for b in batches:
            p = predict(chain, utf8(b.column("text")), memos)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(chain))), pa.array(p[:, -1] >= threshold)], ["doc_id", *names, categories[-1]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names), f"{categories[-1]} boolean"]))


def remove(docs: DataFrame, labels: DataFrame, *, categories: tuple[str, ...] = ("quality", "toxic"), threshold: float = 0.5, train_rows: int = 4000) -> DataFrame:
    """docs without those that the last category's model rejects."""
    small_batches(docs.sparkSession)
    chain = train(docs, labels, categories, train_rows)

    def run(batches):
        memos = [{} for _ in chain]
        for b in batches:
            yield b.filter(pa.array(predict(chain, utf8(b.column("text")), memos)[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
