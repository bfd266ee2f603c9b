"""Exact, fingerprint and fuzzy deduplication of documents and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_identity, identity_key
from .reuse import reuse  # noqa: F401  the fuzzy part is there


def document_dedup(docs: DataFrame, content: str, order: str) -> DataFrame:
    """The first document (by order) of each content digest: checksum, order, and how many there are."""
    rows = docs.withColumn("checksum", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    return rows.groupBy("checksum").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def new_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming documents whose checksum is not stored, one of each."""
    return incoming.dropDuplicates(["checksum"]).join(stored.select("checksum"), "checksum", "left_anti")


def batch_key(cards: DataFrame, scalars: list[str], lists: list[tuple[str, bool]], fallback: list[str], ascii_only: bool = False) -> Column:
    """A card's digest over normalised fields; lists whose order does not matter (True) are sorted before."""
    clean = ascii_identity if ascii_only else identity_key
    text = lambda c: F.coalesce(clean(F.col(c)), F.lit(""))

    def joined(name: str, unordered: bool) -> Column:
        values = F.coalesce(F.col(name), F.array().cast("array<string>"))
        values = F.sort_array(values) if unordered else values
        mark = "\x1e"
        return F.replace(F.regexp_replace(F.lower(F.array_join(values, mark)), f"[^a-z0-9{mark}]", ""), F.lit(mark), F.lit("|")) if ascii_only else F.array_join(F.transform(values, lambda v: F.lower(F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))), "|")

    parts = [text(c) for c in scalars] + [joined(n, u) for n, u in lists]
    body = F.concat_ws("\x1f", *parts)
    empty = sum((F.length(p) for p in parts[1:]), F.lit(0)) == 0
    return F.sha2(F.when(empty, F.concat_ws("\x1f", body, *(text(c) for c in fallback))).otherwise(body), 256)


def keep_best(cards: DataFrame, key: str, *best: Column) -> DataFrame:
    """One card of each key: the largest by best."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*(b.desc() for b in best)))
    return cards.withColumn("_place", at).filter("_place = 1").drop("_place")


def semantic_fingerprint(card_type: Column, *identity: Column) -> Column:
    """Digest of a card's type and normalised identity fields; its phase is no part of it."""
    return F.sha2(F.concat_ws("\x1f", card_type, *(ascii_identity(F.coalesce(c, F.lit(""))) for c in identity)), 256)


def cross_document(cards: DataFrame, indexed: DataFrame) -> DataFrame:
    """cards(fingerprint) with dedup_status: DUPLICATE (then SKIPPED, retrieval off) where an indexed card has the fingerprint."""
    known = indexed.groupBy("fingerprint").agg(F.min("id").alias("canonical_id"))
    got = cards.join(known, "fingerprint", "left")
    again = F.col("canonical_id").isNotNull()
    return got.withColumn("dedup_status", F.when(again, "DUPLICATE").otherwise("UNIQUE")).withColumn("publish_status", F.when(again, "SKIPPED").otherwise("INDEXED")).withColumn("retrieval_enabled", ~again)
