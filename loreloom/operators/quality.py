"""Quality rubric of cards and QA of semantic cards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HTML_RESIDUE

# Penalties (field that must be filled, points, issue).
COMMON = [("title", 20, "缺少标题"), ("summary", 20, "缺少摘要"), ("scenario", 8, "缺少适用场景"), ("object_name", 6, "缺少操作对象"), ("evidence_quote", 25, "缺少原文证据")]
STEPS, RISKS = ("procedure_steps", 18, "缺少操作步骤"), ("risks", 7, "缺少风险说明")
PROCEDURE = [STEPS, RISKS, ("rollback_steps", 8, "缺少回退步骤"), ("validation_steps", 5, "缺少验证步骤")]
BY_TYPE = {
    "procedure": PROCEDURE,
    "rollback": [("rollback_steps", 18, "缺少回退步骤"), RISKS, ("validation_steps", 5, "缺少验证步骤")],
    "risk": [("risks", 18, "缺少风险说明")],
    "case": [("risks", 7, "缺少事件影响或风险说明")],
    "compatibility": [("applicable_versions", 15, "缺少兼容版本或适用范围")],
    "constraint": [],
}
BY_ROLE = {
    "TASKS_CANONICAL": [("procedure_steps", 18, "缺少任务步骤")],
    "PRECHECK_STEPS": [("procedure_steps", 18, "缺少前检步骤")],
    "IMPLEMENTATION_STEPS": [("procedure_steps", 18, "缺少实施步骤")],
    "VALIDATION_STEPS": [("validation_steps", 18, "缺少验证步骤")],
    "ROLLBACK_STEPS": [("rollback_steps", 18, "缺少回退步骤")],
    "RISK_IMPACT": [("risks", 18, "缺少风险说明")],
    "EXECUTION_RESULT": [],
    "IDENTITY_METADATA_CONTEXT": [],
    "IDENTITY": [],
    "SERVICE_SCOPE": [],
    "CHANGE_CONTEXT": [],
    "EXECUTION_CONTEXT": [],
    "GOVERNANCE_CONTEXT": [],
}
UNGROUNDED = (25, "证据原文无法在来源分片中精确定位")


def quality(cards: DataFrame, source_text: str = "source_text", unit_role: str | None = None) -> DataFrame:
    """cards with quality_score (100 less penalties, 0 at least) and quality_issues.

    A known unit role decides what must be filled, else the knowledge type; an unknown type counts as procedure.
    Columns that cards lacks count as empty. A quote that is not in the source costs extra.
    """
    types = dict(cards.dtypes)

    def missing(field: str) -> Column:
        if field not in types:
            return F.lit(True)
        return F.size(F.coalesce(F.col(field), F.array())) == 0 if types[field].startswith("array") else F.length(F.coalesce(F.col(field), F.lit(""))) == 0

    role = F.upper(F.trim(F.coalesce(F.col(unit_role), F.lit("")))) if unit_role else F.lit("")
    kind = F.lower(F.trim(F.coalesce(F.col("knowledge_type"), F.lit("")))) if "knowledge_type" in types else F.lit("")
    checks = [(missing(f), p, m) for f, p, m in COMMON]
    checks += [((role == r) & missing(f), p, m) for r, rules in BY_ROLE.items() for f, p, m in rules]
    plain = ~role.isin(list(BY_ROLE))
    checks += [(plain & (kind == t) & missing(f), p, m) for t, rules in BY_TYPE.items() for f, p, m in rules]
    checks += [(plain & ~kind.isin(list(BY_TYPE)) & missing(f), p, m) for f, p, m in PROCEDURE]
    if source_text in types and "evidence_quote" in types:
        checks.append((~missing("evidence_quote") & ~F.contains(F.coalesce(F.col(source_text), F.lit("")), F.col("evidence_quote")), *UNGROUNDED))
    lost = sum((F.when(c, p).otherwise(0) for c, p, _ in checks), F.lit(0))
    issues = F.filter(F.array(*(F.when(c, m) for c, _, m in checks)), lambda x: x.isNotNull())
    return cards.withColumn("quality_score", F.greatest(F.lit(0), 100 - lost).cast("double")).withColumn("quality_issues", issues)


def status_from_quality(score: Column, grounded: Column, threshold: float = 65.0) -> Column:
    return F.when((score >= threshold) & grounded, "PENDING_REVIEW").otherwise("DRAFT")


def regrade(cards: DataFrame) -> DataFrame:
    """cards(status, quality_score, grounded) with new_status; only DRAFT and PENDING_REVIEW move."""
    return cards.withColumn("new_status", F.when(F.col("status").isin("DRAFT", "PENDING_REVIEW"), status_from_quality(F.col("quality_score"), F.col("grounded"))).otherwise(F.col("status")))


def card_qa(title: Column, body: Column, expected_title: Column) -> Column:
    """100 less 40 for raw JSON, 30 for HTML residue, 25 for an empty body, 10 for another title."""
    raw_json = F.rlike(body, F.lit(r"(?m)(?:^|\n)\s*(?:/[^:\n]+:\s*)?[\[{]\s*[\"']?[^\n{}\[\]:,]+[\"']?\s*:"))
    bad = [(raw_json, 40), (F.rlike(body, F.lit(HTML_RESIDUE)), 30), (F.length(F.trim(body)) == 0, 25), (title != expected_title, 10)]
    return F.greatest(F.lit(0), 100 - sum((F.when(c, p).otherwise(0) for c, p in bad), F.lit(0)))
