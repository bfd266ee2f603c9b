"""Joins, counts, states and transitions of cards, cases, runs and tickets.

Mutations are projections: old state and events give the new state; a sink writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses and state machines.
CARD_STATUSES = ["DRAFT", "PENDING_REVIEW", "APPROVED", "REJECTED", "SUPERSEDED"]
TICKET_TRANSITIONS = {
    "DRAFT": ["BLOCKED", "READY_FOR_APPROVAL"],
    "READY_FOR_APPROVAL": ["WAITING_APPROVAL"],
    "WAITING_APPROVAL": ["APPROVED", "BLOCKED", "REJECTED"],
    "APPROVED": ["EXECUTING", "BLOCKED"],
    "EXECUTING": ["BLOCKED", "VERIFYING", "FAILED"],
    "VERIFYING": ["SUCCEEDED", "ROLLED_BACK", "FAILED"],
}
RUN_TRANSITIONS = {
    "QUEUED": ["RUNNING", "CANCELLED"],
    "RUNNING": ["SUCCEEDED", "FAILED", "CANCELLED", "WAITING_APPROVAL", "CANCEL_REQUESTED", "INTERRUPTED"],
    "WAITING_APPROVAL": ["QUEUED", "FAILED", "CANCELLED"],
    "CANCEL_REQUESTED": ["CANCELLED", "INTERRUPTED"],
    "FAILED": ["QUEUED"],
    "INTERRUPTED": ["QUEUED"],
}
REVIEW_ACTIONS = {"approve": "APPROVED", "reject": "REJECTED", "supersede": "APPROVED"}


def latest(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row of each key by order."""
    keys = [key] if isinstance(key, str) else key
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_place", at).filter("_place = 1").drop("_place")


def status_counts(cards: DataFrame, statuses: list[str] = CARD_STATUSES) -> DataFrame:
    """(status, n), zero for statuses that no card has."""
    spark = cards.sparkSession
    all_ = spark.createDataFrame([(s,) for s in statuses], "status string")
    return all_.join(cards.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def page(rows: DataFrame, *order: Column, limit: int, offset: int = 0, most: int = 2000) -> DataFrame:
    """A page of rows in order; limit is held to 1..most and offset to 0 at least."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def bundle_status(n: Column, approved: Column, rejected: Column, superseded: Column, reviewable: Column) -> Column:
    """A case's status from the counts of its cards' statuses."""
    return F.when(n == 0, "EMPTY").when(approved == n, "APPROVED").when(rejected == n, "REJECTED").when(superseded == n, "SUPERSEDED").when((reviewable == n), "PENDING_REVIEW").otherwise("PARTIAL")


def bundle_rollup(cards: DataFrame) -> DataFrame:
    """Per case counts by status, ordered card ids, roles by first appearance, and the derived status."""
    n = {s: F.count_if(F.col("status") == s).alias(s.lower()) for s in CARD_STATUSES}
    entry = F.sort_array(F.collect_list(F.struct("source_order", "card_id", "unit_role")))
    got = cards.groupBy("case_id").agg(F.count("*").alias("card_count"), *n.values(), entry.alias("e"))
    got = got.withColumn("reviewable_count", F.col("draft") + F.col("pending_review"))
    got = got.withColumn("status", bundle_status(F.col("card_count"), F.col("approved"), F.col("rejected"), F.col("superseded"), F.col("reviewable_count")))
    return got.withColumn("card_ids", F.transform("e", lambda x: x["card_id"])).withColumn("roles", F.array_distinct(F.transform("e", lambda x: x["unit_role"]))).drop("e")


def min_max(rows: DataFrame, keys: list[str], created: str, updated: str) -> DataFrame:
    """Rows, first creation and last update of each group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(created).alias("first_created"), F.max(updated).alias("last_updated"))


def eligibility(bundles: DataFrame) -> DataFrame:
    """bundles(status, coverage, mapping, safe) with the array of reasons that speak against planning with them."""
    reasons = F.array(
        F.when(F.col("status") != "APPROVED", "CASE_NOT_APPROVED"),
        F.when(F.coalesce("coverage", F.lit(0.0)) < 1.0, "CONTENT_COVERAGE_INCOMPLETE"),
        F.when(~F.col("mapping").eqNullSafe("CONFIRMED"), "SEMANTIC_MAPPING_NOT_CONFIRMED"),
        F.when(~F.col("safe").eqNullSafe(True), "NOT_SAFE_FOR_INTERNAL_INDEX"),
    )
    return bundles.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).withColumn("eligible", F.size("reasons") == 0)


def approvable(cards: DataFrame, blocking: tuple[str, ...] = ("BLOCKING", "UNSAFE")) -> DataFrame:
    """cards(evidence_quote, quality_issues, report_safe) with whether a reviewer may approve them."""
    issues = F.coalesce("quality_issues", F.array().cast("array<string>"))
    bad = F.exists(issues, lambda i: F.contains(i, F.lit("证据")) | F.lower(i).contains("evidence") | F.exists(F.array(*map(F.lit, blocking)), lambda p: F.startswith(i, p)))
    return cards.withColumn("approvable", (F.length(F.coalesce("evidence_quote", F.lit(""))) > 0) & ~bad & F.coalesce("report_safe", F.lit(True)))


def review(cards: DataFrame, actions: DataFrame) -> DataFrame:
    """Cards after review actions(card_id, action, supersedes_id): id, old_status, status, error.

    Only DRAFT and PENDING_REVIEW cards may be reviewed; a superseding approval needs an APPROVED target, which becomes
    SUPERSEDED. A refused action leaves the card and gives the error.
    """
    target = cards.select(F.col("id").alias("supersedes_id"), F.col("status").alias("target_status"))
    asked = actions.join(target, "supersedes_id", "left")
    got = cards.join(asked.withColumnRenamed("card_id", "id"), "id", "left")
    goal = F.create_map(*(F.lit(x) for kv in REVIEW_ACTIONS.items() for x in kv))[F.col("action")]
    error = (
        F.when(F.col("action").isNull(), None)
        .when(goal.isNull(), "UNKNOWN_ACTION")
        .when(~F.col("status").isin("DRAFT", "PENDING_REVIEW"), "NOT_REVIEWABLE")
        .when((F.col("action") == "supersede") & ~F.col("target_status").eqNullSafe("APPROVED"), "TARGET_NOT_APPROVED")
    )
    got = got.select("id", F.col("status").alias("old_status"), F.when(error.isNull() & goal.isNotNull(), goal).otherwise(F.col("status")).alias("status"), error.alias("error"), "action", "supersedes_id")
    replaced = got.filter("error IS NULL AND action = 'supersede'").select(F.col("supersedes_id").alias("id"), F.lit(True).alias("replaced")).distinct()
    return got.join(replaced, "id", "left").select("id", "old_status", F.when(F.col("replaced"), "SUPERSEDED").otherwise(F.col("status")).alias("status"), "error")


def bundle_review(cards: DataFrame, actions: DataFrame) -> DataFrame:
    """All-or-nothing review of cases(case_id, action): one card that is not reviewable or approvable stops its case."""
    verdict = cards.groupBy("case_id").agg(F.bool_and(F.col("status").isin("DRAFT", "PENDING_REVIEW")).alias("open"), F.bool_and("approvable").alias("approvable"))
    asked = actions.join(verdict, "case_id")
    ok = F.col("open") & ((F.col("action") != "approve") | F.col("approvable"))
    goal = F.create_map(*(F.lit(x) for kv in REVIEW_ACTIONS.items() for x in kv))[F.col("action")]
    return cards.join(asked.select("case_id", F.when(ok, goal).alias("goal")), "case_id", "left").withColumn("status", F.coalesce("goal", "status")).drop("goal")


def legality(states: DataFrame, key: str, order: list[str], transitions: dict[str, list[str]], initial: str) -> DataFrame:
    """states(key, status) with previous and whether the step is legal; repeats of a status are legal."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy(key).orderBy(*order)), F.lit(initial))
    pairs = [f"{a}>{b}" for a, bs in transitions.items() for b in bs]
    got = states.withColumn("previous", before)
    return got.withColumn("legal", (F.col("previous") == F.col("status")) | F.concat("previous", F.lit(">"), "status").isin(pairs))


def graph_rows(cards: DataFrame, documents: DataFrame, lineage: DataFrame, bundles: DataFrame) -> DataFrame:
    """cards with their document, and lineage and case where there are any."""
    return cards.join(documents, "document_id").join(lineage, "card_id", "left").join(bundles, "case_id", "left")


def edges_within(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with both ends among ids(id)."""
    for end in ("card_id", "related_card_id"):
        relations = relations.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return relations


def clean_relations(relations: DataFrame) -> DataFrame:
    """No edges from a card to itself, upper-case types, confidence held to 0..1, the first of equal edges."""
    rows = relations.filter("card_id != related_card_id").withColumn("relation_type", F.upper(F.trim("relation_type"))).withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return rows.groupBy("card_id", "related_card_id", "relation_type").agg(F.max("confidence").alias("confidence"))


def delete_cards(gone: DataFrame, cards: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards and relations without those of gone(id); what these superseded is released."""
    kept = cards.join(gone, "id", "left_anti")
    if "supersedes_id" in cards.columns:
        kept = kept.join(gone.select(F.col("id").alias("supersedes_id"), F.lit(True).alias("_gone")), "supersedes_id", "left").withColumn("supersedes_id", F.when(F.col("_gone").isNull(), F.col("supersedes_id"))).drop("_gone")
    for end in ("card_id", "related_card_id"):
        relations = relations.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return kept, relations


def claim(claims: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Decisions on requests(checksum, owner, force) against claims(checksum, status, lease_until, attempt).

    COMPLETED stays unless forced; a live lease answers PROCESSING; everything else is CLAIMED with one more attempt.
    An unreadable lease has expired.
    """
    got = requests.join(claims, "checksum", "left")
    live = (F.col("status") == "PROCESSING") & (F.coalesce(F.try_to_timestamp("lease_until"), F.timestamp_seconds(F.lit(0))) > now)
    decision = F.when(F.col("status").eqNullSafe("COMPLETED") & ~F.col("force"), "COMPLETED").when(F.coalesce(live, F.lit(False)) & ~F.col("force"), "PROCESSING").otherwise("CLAIMED")
    return got.select("checksum", "owner", decision.alias("decision"), (F.coalesce("attempt", F.lit(0)) + (decision == "CLAIMED").cast("int")).alias("attempt"))


def memory_valid(links: DataFrame, sync: DataFrame) -> DataFrame:
    """Links whose card was synced with success and whose content is still what was synced."""
    return links.join(sync, ["card_id", "backend"]).filter("status = 'SUCCEEDED' AND synced_hash = content_hash")


def budget_spent(events: DataFrame, key: str, order: list[str], limits: dict[str, float]) -> DataFrame:
    """events with running sums of each limited column, and the first limit that is passed, if any.

    Sums are compared at six decimals: a sum of fractions that is the limit is not past it, whatever the order of additions.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = events.withColumns({f"{c}_spent": F.sum(c).over(w) for c in limits})
    return got.withColumn("exceeded", F.coalesce(*(F.when(F.round(F.col(f"{c}_spent"), 6) > v, c) for c, v in limits.items()), F.lit("")))
