"""The cards of a change record: its context, its steps with children of long ones, its outcome, and the build's report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import noop_response
from ..tables import Table, spread
from . import records, reuse, steps, views
from .joins import merged

# Labels, field names and the least length of a child.
OUTCOME_TITLE, OUTCOME_SUMMARY = "执行结果", "历史执行结果"
OUTCOME_FIELDS = ["change_result", "verified_note", "result", "status"]
CHILD_CHARS = 160


def _section_text(section: Column) -> Column:
    inner = F.transform(section["subitems"], lambda i: F.concat_ws("\n", i["title"], i["body"]))
    return F.trim(F.concat_ws("\n", section["body"], F.array_join(inner, "\n")))


def step_cards(source: DataFrame, key: str = "case_id", *, long_chars: int = steps.SPLIT_LENGTH, least_sections: int = steps.SPLIT_SECTIONS, child_chars: int = CHILD_CHARS) -> DataFrame:
    """Cards of steps(key, position, phase, name, operation): one for each, and one for each meaningful section of long ones.

    A long operation with enough meaningful sections makes its card a container, which is not retrieved; section is -1
    for a step's own card. Steps without name and operation have none. Cards are spread by case before they get their
    digests, which do not compress; what canonical_cards does in a case then shuffles nothing more.
    """

    @F.pandas_udf(steps.SECTIONS)
    def parse(text: pd.Series) -> pd.Series:
        return text.map(lambda t: steps.sections(t or ""))

    name, operation = F.trim(F.coalesce("name", F.lit(""))), F.trim(F.coalesce("operation", F.lit("")))
    rows = source.select(key, "position", "phase", name.alias("name"), operation.alias("operation")).filter("name <> '' OR operation <> ''")
    named = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("步骤 "), F.col("position") + 1))
    rows = rows.withColumn("title", steps.phase_title(F.col("phase"), named, F.col("operation"))).withColumn("sections", parse(F.when(F.rlike("operation", F.lit("[、.．]")), F.col("operation"))))  # labels end so

    def meaningful(x: Column) -> Column:
        s = x["s"]
        return (F.length(s["body"]) > 0) & (s["content_length"] >= child_chars) & (x["noop"] == "") & F.rlike(_section_text(s), F.lit(steps.ACTIONABLE))

    rows = rows.withColumn("marked", F.transform("sections", lambda s, i: F.struct(i.alias("i"), s.alias("s"), noop_response(s["body"]).alias("noop"))))
    rows = rows.withColumn("good", F.filter("marked", meaningful)).withColumn("split", (F.length("operation") >= long_chars) & (F.size("good") >= least_sections))
    own = F.array(F.struct(F.lit(-1).alias("section"), F.col("title").alias("title"), F.col("operation").alias("operation")))
    children = F.transform("good", lambda x: F.struct(x["i"].alias("section"), F.concat_ws(" · ", "title", x["s"]["title"]).alias("title"), _section_text(x["s"]).alias("operation")))
    got = rows.select(key, "position", "phase", "name", "split", F.size(F.filter("marked", lambda x: x["noop"] != "")).alias("noop_sections"), F.inline(F.when(F.col("split"), F.concat(own, children)).otherwise(own)))

    got = spread(got, key)
    unit = lambda section: F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.col("position").cast("string"), section.cast("string")), 256)
    container = F.col("split") & (F.col("section") < 0)
    return got.select(
        key, "position", "section", "phase", "title", "operation", unit(F.col("section")).alias("unit_id"), F.when(F.col("section") >= 0, unit(F.lit(-1))).alias("parent_unit_id"),
        F.sha2(F.regexp_replace(F.lower(F.when(F.col("operation") == "", F.col("name")).otherwise(F.col("operation"))), r"[^\p{L}\p{N}]", ""), 256).alias("fingerprint"),
        F.when(container, "CONTAINER").otherwise("INDEXED").alias("publish_status"), (~container).alias("retrieval_enabled"), F.when(F.col("section") < 0, F.col("noop_sections")).otherwise(0).alias("noop_sections"),
    )


def most_cards(source: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, n, chars) that the cards of each case of steps(key, operation) do not exceed: a section begins on a line of its
    own, and its text is that of its lines. No operation is taken apart for it."""
    lines = F.length("operation") - F.length(F.replace("operation", F.lit("\n"), F.lit(""))) + 1
    return source.select(key, F.coalesce("operation", F.lit("")).alias("operation")).groupBy(key).agg(F.sum(1 + lines).alias("n"), F.sum(2 * F.length("operation") + 2 * lines + 2).alias("chars"))


def canonical_cards(cards: DataFrame, key: str = "case_id", least: float = 0.92, steps_of: DataFrame | None = None) -> DataFrame:
    """cards with titles told apart in each case, and canonical_id: the card's own id, or that of the earlier one it repeats.

    steps_of: the steps that the cards were made of; cases are then known to be small without making the cards for that.
    """
    place = F.col("position").cast("long") * 2**31 + F.col("section") + 1
    names = {key: "document_id", "parent_unit_id": "parent_id", "operation": "text"}

    def titled(some: DataFrame) -> DataFrame:
        signed = records.relationship_signature(some)
        told = steps.distinct_titles(signed.withColumn("qualifier", views.title_qualifier(F.col("targets"), F.col("operation"))).withColumn("step", F.col("position")).withColumn("position", place), key)
        return told.withColumn("title", F.col("new_title")).drop("new_title", "qualifier").withColumnsRenamed(names)

    few, many = reuse.parted(cards, key, "operation", None if steps_of is None else most_cards(steps_of, key))
    got = reuse.in_one_pass(titled(few), least)
    got = got if many is None else got.unionByName(reuse.in_rounds(titled(many), least))
    return got.withColumn("position", F.col("step")).drop("step", "similarity").withColumnsRenamed({new: old for old, new in names.items()})


def context_cards(fields: DataFrame, key: str = "case_id") -> DataFrame:
    """One card for each case of fields(key, name, value): title, and its fields as (role, name, value) in order."""
    filled = fields.filter(F.trim("value") != "")
    of = lambda name: F.max(F.when(F.col("name") == name, F.trim("value")))
    got = filled.groupBy(key).agg(of("title").alias("t"), of("ticket_id").alias("i"), F.array_sort(F.collect_list(F.struct(steps.context_role(F.col("name")).alias("role"), "name", "value"))).alias("context"))
    title = F.coalesce(F.nullif(F.concat_ws(" · ", "t", "i"), F.lit("")), F.col(key).cast("string"))
    return got.select(key, title.alias("title"), "context")


def outcome_cards(results: DataFrame, key: str = "case_id") -> DataFrame:
    """One card for each case of results(key, name, value): title, and as summary the first result field that says something."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOME_FIELDS)), F.col("name"))
    said = F.min_by(F.trim("value"), F.when((rank > 0) & (F.trim("value") != ""), rank))
    got = results.groupBy(key).agg(said.alias("said"))
    return got.select(key, F.concat(F.col(key).cast("string"), F.lit(" · " + OUTCOME_TITLE)).alias("title"), F.coalesce("said", F.lit(OUTCOME_SUMMARY)).alias("summary"))


def build_report(source: DataFrame, cards: DataFrame, contexts: DataFrame, outcomes: DataFrame, key: str = "case_id") -> DataFrame:
    """One row for each case of the steps: how many cards of each kind, what was skipped or reused, collisions, relations, coverage.

    cards: those of canonical_cards. A step is expressed if it has a card, be it its own or one that it repeats.
    """
    # Cards are made once and written without their texts; digests are compared within a case, by 64 bits.
    kept, child, bits = F.col("canonical_id") == F.col("unit_id"), F.col("parent_unit_id").isNotNull(), F.xxhash64
    of_case = cards.select(
        key, "position", kept.alias("kept"), child.alias("child"), "retrieval_enabled", (F.col("publish_status") == "CONTAINER").alias("container"), "noop_sections", "title", bits("fingerprint").alias("fingerprint"),
        bits("unit_id").alias("unit_id"), bits(F.coalesce("parent_unit_id", "unit_id")).alias("family"), "phase", "targets", "from_value", "to_value", "expected_values",
    )
    of_case = Table(of_case, "report-cards").df
    kept, child = F.col("kept"), F.col("child")
    counted = spread(of_case, key).groupBy(key).agg(
        F.count_if(kept & ~child).alias("parents"), F.count_if(kept & child).alias("children"), F.count_if(kept & F.col("retrieval_enabled")).alias("indexed"), F.count_if(kept & F.col("container")).alias("containers"),
        F.count_if(~kept).alias("reused"), F.sum(F.when(kept, F.col("noop_sections")).otherwise(0)).alias("noop_sections"), F.count_distinct("position").alias("expressed"),
    )
    own = spread(of_case.filter(kept), key)
    titles = own.groupBy(key, "title").agg((F.min("fingerprint") != F.max("fingerprint")).cast("int").alias("x")).groupBy(key).agg(F.sum("x").alias("title_collisions"))
    both = own.groupBy(key, "family").agg(F.bool_or(~child & F.col("retrieval_enabled")).alias("p"), F.count_if(child & F.col("retrieval_enabled")).alias("n")).groupBy(key).agg(F.sum(F.when(F.col("p"), F.col("n")).otherwise(0)).alias("parent_child_collisions"))
    related = records.relationships(of_case.filter(kept).select(key, "unit_id", "phase", "targets", "from_value", "to_value", "expected_values"), key)
    related = related.groupBy(key).agg(F.count_if(F.col("relation_type") == "VALIDATES").alias("validates"), F.count_if(F.col("relation_type") == "ROLLBACK_OF").alias("rollbacks"))
    got = source.select(key, "position").distinct().groupBy(key).agg(F.count("*").alias("source_steps"))
    for part in (counted, titles, both, related, contexts.groupBy(key).agg(F.count("*").alias("contexts")), outcomes.groupBy(key).agg(F.count("*").alias("outcomes"))):
        got = got.join(merged(part), key, "left")
    got = got.fillna(0).withColumn("skipped", F.col("source_steps") - F.col("expressed"))
    return got.withColumn("coverage", F.round(F.col("expressed") / F.col("source_steps"), 6)).drop("expressed")
