"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a digest of doc_id, or of the text where that is null) and queued ``max_epochs`` times over. An entry's
virtual finish time is the source's words up to and with it, divided by the source's target; all entries are
range-sorted by finish time and cut where their running words pass the total budget. Documents are taken whole.

Defined cases: null or empty text has size 0 and takes nothing; null source is a source of its own, last in order;
rows of one doc_id are told apart by their text, rows equal in doc_id, source and text by a running number, so that
each is decided alone; an empty table gives no rows; other columns are kept by ``mix`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, Table, checked_broadcast, fresh

#: Hash ranges within a source and finish-time ranges per unit of virtual time: what one task sorts at once is a 4096th.
RANGES = 4096


def word_count(text):
    """Number of words split at ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_key(source):
    """Sorts as the source by code point, null last; never null."""
    return F.when(source.isNull(), "z").otherwise(F.concat(F.lit("s"), source.cast("string")))


def shuffle_key(doc_id, text, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(src, source_size, target) from (src, size): share of all sizes by weight, no target above max_epochs sizes.

    Resharing the excess until none is above ends at min(level * weight, cap) with one level; with sources sorted by
    cap / weight the level is found from running sums, without iteration.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("src"))  # one row for each source
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))) + 1)).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "src", "level"))).over(Window.partitionBy())
    return per.select("src", "source_size", F.coalesce(F.least(found["level"] * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def queued(docs: DataFrame, seed: str) -> DataFrame:
    """(src, part, key, doc_id, size, h, place, cum) of docs(doc_id, text, source): the order within each source.

    place numbers rows equal in all the rest from 0; cum is the running size within a 4096th of the source's keys.
    """
    rows = docs.select(*(c.alias(n) for n, c in _order_columns(seed).items()))
    rows = rows.withColumn("part", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")).withColumn("row", F.monotonically_increasing_id())
    equal = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size", "h")
    order = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size", "h", "row")
    return rows.withColumn("cum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order) - F.rank().over(equal)).drop("row")


def _order_columns(seed: str) -> dict:
    return {"src": source_key(F.col("source")), "key": shuffle_key(F.col("doc_id"), F.col("text"), seed), "doc_id": F.col("doc_id"), "size": word_count(F.col("text")), "h": F.xxhash64("text")}


def cuts(rows: DataFrame, per: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """(src, source_size, target, cut...): what each source gives is a prefix of its shuffled order in each epoch.

    rows: as queued. cut<e> is the last (key, doc_id, size, h, place) taken in epoch e, null where none is.
    """
    before = (
        rows.groupBy("src", "part").agg(F.sum("size").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n"))
        .select("src", "part", "before")
    )
    entries = (
        rows.join(before, ["src", "part"]).join(checked_broadcast(per), "src").filter("target > 0 AND size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("finish", (F.col("cum") + F.col("before") + F.col("epoch") * F.col("source_size")) / F.col("target"))
        .withColumn("range", F.floor(F.col("finish") * RANGES))
        .select("range", "finish", "src", "epoch", "key", "doc_id", "size", "h", "place")
    )
    entries = Table(entries, "mix-entries")
    ahead = (
        entries.df.groupBy("range").agg(F.sum("size").alias("n"))
        .withColumn("ahead", F.sum("n").over(Window.orderBy("range")) - F.col("n"))  # one row for each range
        .select("range", "ahead")
    )
    order = Window.partitionBy("range").orderBy("finish", "src", "key", "doc_id", "epoch", "size", "h", "place").rowsBetween(Window.unboundedPreceding, 0)
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all")).first()["all"] * share
    taken = entries.df.withColumn("run", F.sum("size").over(order)).join(checked_broadcast(ahead), "range").filter(F.col("run") + F.col("ahead") <= budget)
    last = taken.groupBy("src").agg(*(F.max(F.when(F.col("epoch") == e, F.struct("key", "doc_id", "size", "h", "place"))).alias(f"cut{e}") for e in range(max_epochs)))
    out = Table(per.join(last, "src", "left"), "mix-cuts")
    entries.drop()
    return out.df


def _times(cut, me, max_epochs: int):
    """How often the row with the struct me (key, doc_id, size, h, place) is taken; cut(e) is the column of epoch e's cut."""
    return sum((F.coalesce(me <= cut(e), F.lit(False)).cast("int") for e in range(max_epochs)), F.lit(0))


def plan_mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> tuple[Table, DataFrame]:
    """The rows of docs(doc_id, text, source) in their order, as queued, and the cuts."""
    rows = Table(queued(docs, seed), "mix-rows")
    per = Table(targets(rows.df, weights, share, max_epochs), "mix-targets")
    return rows, cuts(rows.df, per.df, share, max_epochs)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows, cut = plan_mix(docs, **options)
    times = _times(lambda e: F.col(f"cut{e}"), F.struct("key", "doc_id", "size", "h", "place"), options.get("max_epochs", 2))
    return rows.df.join(checked_broadcast(cut), "src").select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * times).otherwise(F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows of docs, all columns kept, a row for each time that a document is taken (size 0: never).

    Only rows equal to a cut in all but place, that is a document and its exact repeats, are numbered again.
    """
    epochs = range(options.get("max_epochs", 2))
    rows, cut = plan_mix(docs, **options)
    parts = ("key", "doc_id", "size", "h")
    at_cut = rows.df.join(checked_broadcast(cut), "src").filter(F.greatest(*(F.struct(*parts).eqNullSafe(F.struct(*(F.col(f"cut{e}.{c}") for c in parts))).cast("int") for e in epochs), F.lit(0)) > 0)
    repeated = at_cut.filter("place > 0").limit(1).count() > 0
    rows.drop()
    names = dict(zip(("src", "key", "size", "h", "place", "edge", "turn"), fresh(docs, "mix_src", "mix_key", "mix_size", "mix_hash", "mix_place", "mix_edge", "mix_turn")))
    got = docs.withColumns({names[n]: c for n, c in _order_columns(options.get("seed", "mix")).items() if n in names})
    cut = cut.toDF(*fresh(got, *(f"cut_{c}" for c in cut.columns)))
    own = [F.col(names.get(c, c)).alias(c) for c in parts]
    got = got.join(checked_broadcast(cut), got[names["src"]] == cut[cut.columns[0]])
    place = F.lit(0)
    if repeated:
        edge = F.greatest(*(F.coalesce(F.struct(*own).eqNullSafe(F.struct(*(F.col(f"{cut.columns[3 + e]}.{c}").alias(c) for c in parts))), F.lit(False)).cast("int") for e in epochs), F.lit(0))
        got = got.withColumn(names["edge"], edge == 1)
        number = F.row_number().over(Window.partitionBy(*(names.get(c, c) for c in ("src", *parts))).orderBy(names["src"])) - 1
        got = got.filter(F.col(names["edge"])).withColumn(names["place"], number).unionByName(got.filter(~F.col(names["edge"])).withColumn(names["place"], F.lit(0)))
        place = F.col(names["place"])
    times = _times(lambda e: F.col(cut.columns[3 + e]), F.struct(*own, place.alias("place")), len(epochs))
    got = got.filter(F.col(names["size"]) > 0).withColumn(names["turn"], F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    return got.select(*(F.col(c) for c in docs.columns))


#: The same rows for DuckDB.
ORACLE = r"""
WITH s AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS src, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT src, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w FROM s GROUP BY src),
c AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS r FROM p),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY r, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (ORDER BY r, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
f AS (SELECT arg_min(level, (r, src)) AS level FROM l WHERE level <= r),
t AS (SELECT src, source_size, coalesce(least((SELECT level FROM f) * w, cap::DOUBLE), cap::DOUBLE) AS target FROM c),
q AS (SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM s JOIN t USING (src)),
e AS (SELECT q.*, epoch, (cum + epoch * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS v(epoch) WHERE target > 0),
n AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, src, key, doc_id, epoch, size ROWS UNBOUNDED PRECEDING) <= 1.5 * (SELECT sum(size) FROM s) AS fits FROM e),
k AS (SELECT doc_id, sum(size) FILTER (WHERE fits) AS taken FROM n GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (doc_id)
"""
