"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A text's shingles are its runs of ``SHINGLE`` words (lower-cased runs of letters and digits); its sketch is the ``SIZE``
smallest distinct hashes of them, sorted. Sketches of parts merge into the sketch of the whole (of shingles within the
parts); two sketches estimate resemblance and containment, one estimates the number of distinct shingles.

Defined cases: null text is the empty text; a text of fewer words than a shingle has is one shingle, none if it has no
word; two empty sketches have resemblance and containment 1, an empty and another 0; equal texts have equal sketches;
null doc_ids come after all others, by text hash; rows equal in doc_id and text are neighbours in either order; a table
of one row is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast

SHINGLE, SIZE = 5, 128
#: Text in the window of one task, and quantiles of doc_id that ranges are cut from.
RANGE_BYTES, QUANTILES = 16 << 20, 128


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def sketch(text: Column) -> Column:
    """array<long>: the SIZE smallest distinct shingle hashes, ascending."""

    def shingles(w: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.array_distinct(F.sort_array(run)), 1, SIZE))

    # A one-element array holds the words, so that they are split once.
    return F.element_at(F.transform(F.array(words(F.coalesce(text, F.lit("")))), shingles), 1)


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard resemblance: the share of the union's sketch that lies in both."""
    both = F.transform(F.array(merge(a, b)), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.element_at(both, 1))


def distinct_count(a: Column) -> Column:
    """Estimated number of distinct shingles; exact below SIZE."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < SIZE, F.size(a).cast("double")).otherwise((SIZE - 1) / place)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    r = resemblance(a, b)
    share = r / (1 + r) * (distinct_count(a) + distinct_count(b)) / distinct_count(a)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.least(share, F.lit(1.0)))


def text_form(a: Column) -> Column:
    """The sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merged(parts: DataFrame, group: list[str], column: str, salts: int = 64) -> DataFrame:
    """The sketch of each group of parts: the smallest hashes of salted portions, then of what is left of these."""
    rows = parts.select(*group, F.explode(column).alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(salts)))
    for keys in ([*group, "salt"], group):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        rows = rows.withColumn("place", place).filter(F.col("place") <= SIZE).drop("place")
    return rows.groupBy(*group).agg(F.sort_array(F.collect_list("h")).alias(column))


def ranges(docs: DataFrame) -> Column:
    """A column that numbers ranges of doc_id, larger for larger ids, of at most about RANGE_BYTES of text each.

    Ids between two quantiles are cut evenly, into as many parts as the bytes of their texts ask for, so that neither
    gaps and dense stretches in doc_id nor stretches of long texts make a large range. Null ids are ranged by text hash
    below all others. Rows of one doc_id are in one range.
    """
    got = docs.agg(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10 * QUANTILES).alias("q")).first()
    cuts = sorted(set(got["q"] or [0]))
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
    at = F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))  # 0 below the first quantile
    sums = {r["at"]: r["b"] or 0 for r in docs.filter("doc_id IS NOT NULL").groupBy(at.alias("at")).agg(F.sum(F.octet_length("text")).alias("b")).collect()}  # one row for each quantile
    counts = [max(1, -(-sums.get(i, 0) // RANGE_BYTES)) for i in range(len(cuts) + 1)]
    parts, first = (F.element_at(F.array(*map(F.lit, x)), at + 1).cast("long") for x in (counts, [sum(counts[:i]) for i in range(len(counts))]))
    low, high = F.element_at(bounds, F.greatest(at, F.lit(1))), F.element_at(bounds, F.least(at + 1, F.lit(len(cuts))))
    share = (F.col("doc_id") - low).cast("double") / F.greatest(high - low, F.lit(1)).cast("double")
    inner = F.least(F.greatest(F.floor(share * parts), F.lit(0)), parts - 1)
    return F.when(F.col("doc_id").isNull(), -F.shiftright(F.xxhash64("text"), 54) - 600).otherwise(first + inner).cast("long")


def with_next(docs: DataFrame, columns: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """docs with next_<column> for each of columns: those of the next row by descending doc_id, after the last the first.
    made: further columns, computed once for each row where rows meet.

    Rows meet within ranges of doc_id; each range gets a copy of the first row of the range below, so no task sees more
    than a range.
    """
    rows = docs.withColumn("range", ranges(docs)).withColumn("h", F.xxhash64("text"))
    first = F.min(F.struct((-F.col("doc_id")).alias("order"), F.col("h").alias("h"))).alias("first")
    firsts = rows.groupBy("range").agg(first)
    down = Window.orderBy(F.col("range").desc())  # one row for each range
    borrowed = firsts.select(F.coalesce(F.lag("range").over(down), F.min("range").over(Window.partitionBy())).alias("to"), F.col("range").alias("of"), F.col("first.order").alias("first_order"), F.col("first.h").alias("first_h"))
    borrowed = checked_broadcast(borrowed)
    same = (rows["range"] == borrowed["of"]) & (rows["h"] == borrowed["first_h"]) & (-rows["doc_id"]).eqNullSafe(borrowed["first_order"])
    copies = rows.join(borrowed, same).select(*(F.col("to").alias("range") if c == "range" else rows[c] for c in rows.columns))
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "h")
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True))).repartition("range").withColumns(made or {})
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("NOT copy").drop("range", "h", "copy")


def report(docs: DataFrame) -> DataFrame:
    """For each document its sketch and that of its edited text, and their likeness to each other and to the next's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "a"], {"a": sketch(F.col("text"))})
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", sketch(F.col("edited")).alias("b"), F.col("next_a").alias("c"))
    return rows.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("a")).alias("fingerprint"), text_form(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("c")).alias("near_next"))
