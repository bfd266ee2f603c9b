"""The knowledge graph as two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\0"), p)
    return F.substring(F.sha2(joined, 256), 1, 20)


def object_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("object:"), _digest(kind, name))


def nodes(cards: DataFrame) -> DataFrame:
    """(id, kind, label) of cards(id, title, source_name, object_type, object_name, case_id), each id once."""
    label = lambda c: F.coalesce(c, F.lit(""))
    card = cards.select(F.concat(F.lit("card:"), F.col("id")).alias("id"), F.lit("card").alias("kind"), label(F.col("title")).alias("label"))
    source = cards.filter("source_name IS NOT NULL").select(F.concat(F.lit("source:"), F.col("source_name")).alias("id"), F.lit("source").alias("kind"), F.col("source_name").alias("label"))
    thing = cards.filter("object_name IS NOT NULL AND object_name != ''").select(object_id(F.col("object_type"), F.col("object_name")).alias("id"), F.lit("object").alias("kind"), F.col("object_name").alias("label"))
    case = cards.filter("case_id IS NOT NULL").select(F.concat(F.lit("case:"), F.col("case_id")).alias("id"), F.lit("case").alias("kind"), F.col("case_id").alias("label"))
    return card.unionByName(source).unionByName(thing).unionByName(case).groupBy("id", "kind").agg(F.min("label").alias("label"))


def edges(cards: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, source, target, edge_type): SOURCE_OF, DESCRIBES and CONTAINS from cards, and relations among these cards."""
    card = F.concat(F.lit("card:"), F.col("id"))
    parts = [
        cards.filter("source_name IS NOT NULL").select(F.concat(F.lit("source:"), F.col("source_name")).alias("source"), card.alias("target"), F.lit("SOURCE_OF").alias("edge_type")),
        cards.filter("object_name IS NOT NULL AND object_name != ''").select(card.alias("source"), object_id(F.col("object_type"), F.col("object_name")).alias("target"), F.lit("DESCRIBES").alias("edge_type")),
        cards.filter("case_id IS NOT NULL").select(F.concat(F.lit("case:"), F.col("case_id")).alias("source"), card.alias("target"), F.lit("CONTAINS").alias("edge_type")),
        relations.select(F.concat(F.lit("card:"), F.col("card_id")).alias("source"), F.concat(F.lit("card:"), F.col("related_card_id")).alias("target"), F.col("relation_type").alias("edge_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().withColumn("id", F.concat(F.lit("edge:"), _digest(F.col("source"), F.col("target"), F.col("edge_type"))))


def kind_counts(nodes: DataFrame, kinds: tuple[str, ...] = ("card", "source", "object", "case")) -> DataFrame:
    """One row with the number of nodes of each kind, zero where there is none."""
    return nodes.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
