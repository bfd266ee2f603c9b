"""Canonical cards of a document: a card that an earlier one says already points to it.

In order of position, a card takes the first earlier canonical card of its fingerprint, else the earlier canonical card
of most alike text, if the likeness (Ratcliff-Obershelp, this card's text against the earlier one's) reaches ``least``;
siblings (equal parent) are never taken; a card that finds none becomes canonical itself.

Documents of few cards and characters are spread over the tasks and decided card by card, in one pass over the sorted
rows; a task holds the canonical cards of one such document. Larger documents are decided in rounds, and none is gathered.

In the rounds, texts that can be alike are found in cells: lengths of alike texts differ by a bounded factor,
so texts are put into length classes and blocks within a class, and only blocks of a class and of the next one meet. In
a cell a count filter over pairs of characters, one matrix product, leaves what the likeness is computed for: a character
that has no counterpart changes at most three pairs, so no alike pair is lost. The order is resolved in rounds: a card
is decided once no undecided card before it could be taken. Canonical cards of one fingerprint, or of one text, are
siblings of each other, so of such a group only the first one counts, and a round needs one row for each group.

Defined cases: null text is the empty one and is alike to nothing; null positions come last, equal ones in order of
unit_id; a null parent has no siblings; null document_id is a document of its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..tables import Table, small_batches, spread
from .joins import small

BLOCK = 512
#: Documents of at most so many cards and characters are decided in one pass.
FEW_CARDS, FEW_CHARS = 256, 32_768
#: Likenesses that a pass keeps, and the most characters of two texts of which one is kept.
KEPT_LIKENESSES, KEPT_CHARS = 4096, 2000


def _pairs_present(texts: list[str], bins: int) -> np.ndarray:
    out = np.zeros((len(texts), bins), dtype=np.float32)
    for i, t in enumerate(texts):
        out[i, [zlib.crc32(t[k : k + 2].encode("utf-8", "surrogatepass")) % bins for k in range(len(t) - 1)]] = 1
    return out


def alike(a: list[str], b: list[str], least: float) -> list[tuple[int, int]]:
    """(i, j) of the texts a[i], b[j] whose lengths and character pairs allow a likeness of at least least."""
    if not a or not b:
        return []
    longest = max(map(len, a + b))
    bins = min(4096, max(64, 1 << math.ceil(math.log2(8 * longest + 1))))
    x, y = _pairs_present(a, bins), _pairs_present(b, bins)
    n, m = (np.array(list(map(len, t)), dtype=np.float32) for t in (a, b))
    both = n[:, None] + m[None, :]
    changed = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)
    ok = (changed <= 3 * (1 - least) * both + 0.5) & (2 * np.minimum(n[:, None], m[None, :]) >= least * both - 1e-3)
    return list(zip(*(c.tolist() for c in np.nonzero(ok))))


def cells(texts: DataFrame, least: float) -> DataFrame:
    """(doc, low, high, block, tid, text) of texts(doc, tid, text): the members of each two blocks that may hold alike ones."""
    width = math.log((2 - least) / least)
    classed = texts.filter("text != ''").withColumn("class", F.floor(F.log(F.length("text")) / width).cast("int"))
    sizes = classed.groupBy("doc", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = classed.join(sizes, ["doc", "class"]).withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int"))
    beside = lambda step, name: sizes.select("doc", (F.col("class") + step).alias("class"), F.col("parts").alias(name))
    own = own.join(beside(-1, "above"), ["doc", "class"], "left").join(beside(1, "below"), ["doc", "class"], "left")
    block = lambda c, p: F.struct(c.cast("int").alias("class"), p.cast("int").alias("part"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    in_class = lambda step, n: F.transform(upto(F.coalesce(n, F.lit(0))), lambda p: block(F.col("class") + step, p))
    others = F.concat(in_class(0, F.col("parts")), in_class(1, F.col("above")), in_class(-1, F.col("below")))
    met = own.withColumn("block", block(F.col("class"), F.col("part"))).select("doc", "block", F.explode(others).alias("other"), "tid", "text")
    number = lambda c: F.col(f"{c}.class").cast("long") * 2**32 + F.col(f"{c}.part")
    met = met.select("doc", number("block").alias("block"), number("other").alias("other"), "tid", "text")
    return met.select("doc", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "tid", "text")


def likenesses(texts: DataFrame, least: float) -> DataFrame:
    """(tid, other, like) for texts(doc, tid, text) of one doc: tid's text against the other's, where that reaches least."""
    rows = cells(texts, least).repartition("doc", "low", "high").sortWithinPartitions("doc", "low", "high")

    def run(batches):
        held, at = [], None

        def done(out):
            low, high = at[1:]
            a, b = ([(t, x) for k, t, x in held if k == side] for side in (low, high))
            for i, j in alike([x for _, x in a], [x for _, x in b], least):
                (s, x), (t, y) = a[i], b[j]
                if low == high and s >= t:
                    continue
                for p, q, v, w in ((s, t, x, y), (t, s, y, x)):
                    if (like := SequenceMatcher(None, v, w).ratio()) >= least:
                        out.append((p, q, like))

        for batch in batches:
            out = []
            for doc, low, high, *member in zip(*(batch.column(c).to_pylist() for c in ("doc", "low", "high", "block", "tid", "text"))):
                if (doc, low, high) != at:
                    if held:
                        done(out)
                    held, at = [], (doc, low, high)
                held.append(tuple(member))
            yield rows_of(out)
        out = []
        if held:
            done(out)
        yield rows_of(out)

    def rows_of(out):
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["tid", "other", "like"])

    return rows.mapInArrow(run, "tid long, other long, like double")


def _first(members: DataFrame, status: DataFrame) -> DataFrame:
    """(gid, taken, open): a group's first canonical card, (at, parent, unit), and where its first undecided one is."""
    both = members.join(status, "rid")
    taken = F.min(F.when(F.col("status") == 1, F.struct("at", "parent", "unit")))
    return both.groupBy("gid").agg(taken.alias("taken"), F.min(F.when(F.col("status") == 0, F.col("at"))).alias("open"))


def _free(parent: str):
    """Whether a group's first canonical card comes before this one and is no sibling."""
    return (F.col("taken.at") < F.col("at")) & ~F.coalesce(F.col(parent) == F.col("taken.parent"), F.lit(False))


def in_rounds(cards: DataFrame, least: float = 0.92) -> DataFrame:
    """cards as of in_one_pass with canonical_id and similarity, whatever the size of a document."""
    rows = cards.select(F.struct(*cards.columns).alias("card"), F.struct("document_id").alias("doc"), "document_id", "unit_id", F.col("parent_id").alias("parent"), F.struct(F.col("position").isNull().alias("last"), "position", "unit_id").alias("at"), "fingerprint", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.xxhash64(F.to_json("doc"), F.lit(1)))
    # Cards equal in document, fingerprint, text and parent are decided by the first of them.
    alike_cards = ["document_id", "fingerprint", "text", "parent"]
    reps = Table(rows.groupBy("doc", *alike_cards).agg(F.min(F.struct("at", F.col("unit_id").alias("unit"))).alias("f")).select("doc", *alike_cards, "f.at", "f.unit").withColumn("rid", F.monotonically_increasing_id()), "reuse-cards").df
    texts = Table(reps.groupBy("doc", "document_id", "text").count().withColumn("tid", F.monotonically_increasing_id()).drop("count"), "reuse-texts").df
    prints = Table(reps.groupBy("document_id", "fingerprint").count().withColumn("fid", -F.monotonically_increasing_id() - 1).drop("count"), "reuse-prints").df
    same = lambda a, b, columns: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    numbered = reps.alias("r").join(texts.alias("t"), same("r", "t", ["document_id", "text"])).join(prints.alias("p"), same("r", "p", ["document_id", "fingerprint"]))
    numbered = Table(numbered.select("r.rid", "r.at", "r.parent", "r.unit", "t.tid", "p.fid", (F.col("r.text") != "").alias("said"), F.col("p.fingerprint").isNotNull().alias("printed")), "reuse-numbered").df
    like = Table(likenesses(texts.select("doc", "tid", "text"), least), "reuse-likenesses").df
    own = numbered.select("rid", "at", "parent", F.explode(F.filter(F.array(F.when(F.col("printed"), F.struct(F.col("fid").alias("gid"), F.lit(2.0).alias("like"))), F.when(F.col("said"), F.struct(F.col("tid").alias("gid"), F.lit(1.0).alias("like")))), lambda x: x.isNotNull())).alias("g")).select("rid", "at", "parent", "g.*")
    watch = Table(own.unionByName(numbered.join(like, "tid").select("rid", "at", "parent", F.col("other").alias("gid"), "like")), "reuse-watch").df
    members = Table(numbered.select("rid", "at", "parent", "unit", F.explode(F.array("tid", "fid")).alias("gid")).join(watch.select("gid").distinct(), "gid", "left_semi"), "reuse-groups").df
    status = Table(numbered.select("rid", F.lit(0).alias("status")), "reuse-status")  # 0 undecided, 1 canonical, 2 reused
    while True:
        seen = watch.join(status.df.filter("status = 0"), "rid").join(_first(members, status.df), "gid", "left").groupBy("rid").agg(
            F.max(F.coalesce(_free("parent"), F.lit(False))).alias("taken"), F.max(F.coalesce(F.col("open") < F.col("at"), F.lit(False))).alias("waits"))
        decided = F.when(F.col("taken"), 2).when(F.coalesce("waits", F.lit(False)), 0).otherwise(1)
        after = Table(status.df.join(seen, "rid", "left").select("rid", F.when(F.col("status") == 0, decided).otherwise(F.col("status")).alias("status")), "reuse-status")
        status.drop()
        status = after
        if not status.df.filter("status = 0").limit(1).count():
            break
    first = _first(members, status.df).filter("taken IS NOT NULL").select("gid", "taken")
    watched = Table(watch.drop("at", "parent").join(first, "gid"), "reuse-first").df
    # Each card looks at what its equals watch; fingerprints go before likeness, the likelier before, then the earlier.
    mine = rows.alias("c").join(reps.select("rid", *alike_cards).alias("r"), same("c", "r", alike_cards)).select("c.card", "c.at", "c.parent", "r.rid")
    mine = Table(mine.withColumn("no", F.monotonically_increasing_id()), "reuse-mine").df
    best = mine.join(watched, "rid").filter(_free("parent")).groupBy("no").agg(F.min(F.struct((-F.col("like")).alias("unlike"), "taken.at", "taken.unit")).alias("b"))
    got = mine.join(best, "no", "left")
    return got.select("card.*", F.coalesce("b.unit", "card.unit_id").alias("canonical_id"), F.coalesce(F.least(-F.col("b.unlike"), F.lit(1.0)), F.lit(1.0)).alias("similarity"))


def parted(cards: DataFrame, document: str, text: str, most: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(few, many): the cards of documents that one pass decides, spread by document, and those of larger ones, if there are any.

    most: (document, n, chars) that each document's cards do not exceed, where that is cheaper than to count them; either
    way decides alike.
    """
    sizes = cards.groupBy(document).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")) if most is None else most
    large = Table(sizes.filter((F.col("n") > FEW_CARDS) | (F.col("chars") > FEW_CHARS)).select(F.col(document).alias("_large")), "reuse-large")
    if not large.df.limit(1).count():
        large.drop()
        return spread(cards, document), None
    large, equal = small(large.df), F.col(document).eqNullSafe(F.col("_large"))
    return spread(cards.join(large, equal, "left_anti"), document), cards.join(large, equal, "left_semi")


def _passed(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The batches with canonical_id and similarity; rows come document by document and in order."""

    def ratio(a: str, b: str) -> float:
        return SequenceMatcher(None, a, b).ratio()

    kept = lru_cache(KEPT_LIKENESSES)(ratio)

    def likeness(a: str, b: str) -> float:
        size = len(a) + len(b)
        # What lengths, and then numbers of equal characters, allow at most.
        if a == b or 2.0 * min(len(a), len(b)) / size < least or 2.0 * sum(min(a.count(c), b.count(c)) for c in set(a)) / size < least:
            return float(a == b)
        return (kept if size <= KEPT_CHARS else ratio)(a, b)

    doc, prints, said = object(), {}, []
    for batch in batches:
        units, likes = [], []
        for d, unit, parent, print_, text in zip(*(batch.column(c).to_pylist() for c in ("document_id", "unit_id", "parent_id", "fingerprint", "text"))):
            if not (d == doc or (d != d and doc != doc)):  # not a number is one document
                doc, prints, said = d, {}, []
            free = lambda other: parent is None or other != parent
            # Canonical cards of one fingerprint are siblings of each other, so the first one stands for them.
            found, like = None, 1.0
            if (first := prints.get(print_)) and free(first[1]):
                found = first
            elif text:
                alike_ = [(x, c) for c in said if free(c[1]) and (x := likeness(text, c[2])) >= least]
                like, found = max(alike_, key=lambda x: x[0], default=(1.0, None))
            if found is None:
                card = (unit, parent, text)
                if print_ is not None:
                    prints.setdefault(print_, card)
                if text:
                    said.append(card)
            units.append(unit if found is None else found[0])
            likes.append(like)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, batch.schema.field("unit_id").type), pa.array(likes, pa.float64())], [*batch.schema.names, "canonical_id", "similarity"])


def in_one_pass(few: DataFrame, least: float = 0.92) -> DataFrame:
    """few(document_id, unit_id, parent_id, position, fingerprint, text, ...), spread by document, with canonical_id and similarity."""
    small_batches(few.sparkSession)
    schema = few.select("*", F.col("unit_id").alias("canonical_id")).schema.add("similarity", DoubleType())
    return few.sortWithinPartitions("document_id", F.col("position").isNull(), "position", "unit_id").mapInArrow(lambda batches: _passed(batches, least), schema)


def reuse(cards: DataFrame, least: float = 0.92) -> DataFrame:
    """(document_id, unit_id, canonical_id, similarity) of cards(document_id, unit_id, parent_id, position, fingerprint, text)."""
    few, many = parted(cards.select("document_id", "unit_id", "parent_id", "position", "fingerprint", "text"), "document_id", "text")
    got = in_one_pass(few, least)
    return (got if many is None else got.unionByName(in_rounds(many, least))).select("document_id", "unit_id", "canonical_id", "similarity")
