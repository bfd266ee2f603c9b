"""Copies of approved cards in an outer semantic memory: what is exported, what is due, and what must go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lines of an exported card.
HEADING = "Ops Knowledge Studio 已审核知识卡片 K"
SCALARS = {"标题": "title", "摘要": "summary", "场景": "scenario", "对象类型": "object_type", "对象": "object_name"}
LISTS = {"适用版本": "applicable_versions", "前置条件": "prerequisites", "执行步骤": "procedure_steps", "风险": "risks", "回退步骤": "rollback_steps", "验证步骤": "validation_steps", "关键词": "keywords"}


def card_text(cards: DataFrame) -> Column:
    """The text of a card that is exported: labelled lines of these fields only; empty lists and missing columns give none."""
    line = lambda label, value: F.concat(F.lit(f"{label}："), value)
    lines = [F.concat(F.lit(HEADING), F.col("id"))]
    lines += [line(label, F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in SCALARS.items() if c in cards.columns]
    lines += [F.when(F.size(c) > 0, line(label, F.array_join(c, "；"))) for label, c in LISTS.items() if c in cards.columns]
    return F.concat_ws("\n", *lines)


def skip_reason(enabled: bool = True, configured: bool = True, export_allowed: bool = True) -> Column:
    """Why a card is not exported, the first reason that holds; null if it is due."""
    reason = F.when(~F.col("status").eqNullSafe("APPROVED"), "SKIPPED_NOT_APPROVED")
    reason = reason.when(F.upper(F.coalesce("publish_status", F.lit("CANDIDATE"))) == "SKIPPED", "SKIPPED_NOT_PUBLISHABLE")
    reason = reason.when(F.col("retrieval_enabled").eqNullSafe(False), "SKIPPED_RETRIEVAL_DISABLED")
    for ok, name in ((enabled, "DISABLED"), (configured, "NOT_CONFIGURED"), (export_allowed, "EXPORT_NOT_ALLOWED")):
        reason = reason.when(F.lit(not ok), name)
    return reason


def sync_plan(cards: DataFrame, synced: DataFrame, **settings: bool) -> DataFrame:
    """(card_id, content_hash, action): SYNC or ALREADY_SYNCED of due cards, else the reason; RETIRE of copies that must go.

    synced: card_id, synced_hash of the copies that are there. A copy goes if its card is gone or no longer due.
    """
    now = cards.select(F.col("id").alias("card_id"), F.sha2(card_text(cards), 256).alias("content_hash"), skip_reason(**settings).alias("reason"))
    both = now.join(synced, "card_id", "full")
    there = F.col("synced_hash").isNotNull()
    action = F.when(there & (F.col("content_hash").isNull() | F.col("reason").isNotNull()), "RETIRE").when(F.col("reason").isNotNull(), F.col("reason"))
    action = action.when(F.col("content_hash").eqNullSafe(F.col("synced_hash")), "ALREADY_SYNCED").otherwise("SYNC")
    return both.select("card_id", "content_hash", action.alias("action"))


def stale_links(links: DataFrame, cards: DataFrame, lineage: DataFrame) -> DataFrame:
    """links(card_id, memory_id) of cards that are not approved, with the case that they belong to, if any."""
    gone = cards.filter("status <> 'APPROVED'").select(F.col("id").alias("card_id"), "status")
    return links.join(gone, "card_id").join(lineage.select("card_id", "case_id"), "card_id", "left")


def sync_stats(sync: DataFrame, links: DataFrame, retirements: DataFrame) -> DataFrame:
    """One row: syncs by status, links, retirements, and the last update."""
    by = sync.agg(F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "PROCESSING").alias("processing"), F.max("updated_at").alias("last_update"))
    return by.crossJoin(links.agg(F.count("*").alias("links"))).crossJoin(retirements.agg(F.count("*").alias("retirements")))  # one row each


def due_retirements(retirements: DataFrame, limit: int, case_id: str | None = None) -> DataFrame:
    """The oldest retirements, of one case if asked for; limit is held to 1..10 000."""
    some = retirements if case_id is None else retirements.filter(F.col("case_id") == case_id)
    return some.orderBy("created_at", "memory_id").limit(max(1, min(limit, 10_000)))


def cleanup(retirements: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row: how many retirements a deletion(memory_id, ok) removed and how many failed; those not tried count as neither."""
    got = retirements.join(deleted, "memory_id")
    return got.agg(F.count_if("ok").alias("removed"), F.count_if(~F.col("ok")).alias("failed"))


def claim_sync(requests: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """(card_id, decision, owner) of requests(card_id, content_hash, owner_token) against claims(card_id, synced_hash, status, holder, lease_until).

    Equal content that was synced stays; a live lease of another owner is respected; all else is claimed by the asker.
    """
    got = requests.join(claims, "card_id", "left")
    done = F.col("status").eqNullSafe("SUCCEEDED") & F.col("synced_hash").eqNullSafe(F.col("content_hash"))
    held = F.col("status").eqNullSafe("PROCESSING") & (F.col("holder") != F.col("owner_token")) & F.coalesce(F.col("lease_until") > now, F.lit(False))
    decision = F.when(done, "ALREADY_SYNCED").when(held, "IN_PROGRESS").otherwise("CLAIMED")
    return got.select("card_id", decision.alias("decision"), F.when(decision == "CLAIMED", F.col("owner_token")).otherwise(F.col("holder")).alias("owner"))
