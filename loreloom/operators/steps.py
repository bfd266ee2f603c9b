"""Semantic cards of procedure steps: sections, titles, collisions, context roles, record-view pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import noop_response
from ..tables import small_batches

# Patterns, labels and field names.
NUMBERED = r"([ \t]*)((?:\d{1,2}|[一二三四五六七八九十百]+)[、.．])"
ACTIONABLE = r"(?i)检查|确认|核对|设置|修改|调整|删除|添加|恢复|还原|执行|备份|导出|验证|观察|保存|替换|更新|部署|重启|切换|check|verify|set|modify|update|delete|add|restore|execute|backup|export|deploy|restart|switch"
RESTORING = r"(?i)恢复|还原|回退|原值|旧值|\bold\b|new\s*(?:->|→)\s*old"
PHASE_LABELS = {"PRECHECK": "前检", "IMPLEMENTATION": "实施", "VALIDATION": "验证", "ROLLBACK": "回退", "UNMAPPED": "步骤"}
ROLE_FIELDS = {
    "IDENTITY": ["ticket_id", "title", "original_system", "create_time"],
    "SERVICE_SCOPE": ["cloud_service", "service", "micro_service", "affected_service"],
    "CHANGE_CONTEXT": ["change_scene", "change_notes", "special_change_type", "change_guide", "change_guides"],
    "RISK_IMPACT": ["severity", "change_level", "customer_sensed", "affected_customer", "risk_level", "impact_risk_level"],
    "EXECUTION_CONTEXT": ["region", "expected_start_time", "expected_end_time", "expected_total_time", "executors", "cooperators", "reviewers"],
}
GOVERNANCE_MARKERS = ["approval", "high_risk", "authorization", "notification", "notify"]
SPLIT_LENGTH, SPLIT_SECTIONS = 6000, 5

SECTIONS = "array<struct<label:string,title:string,body:string,subitems:array<struct<label:string,title:string,body:string>>,content_length:int>>"


def _numbered(operation: str) -> Iterator[tuple[int | None, str, str]]:
    """(width of the indent, label, title) of each numbered line, (None, "", line) of the others.

    A label that stands alone takes the next line with text as its title.
    """
    lines = iter(operation.split("\n"))
    for line in lines:
        if m := re.match(NUMBERED, line):
            title = line[m.end() :]
            while not title.strip() and (more := next(lines, None)) is not None:
                title = more
            yield len(m[1].expandtabs(4)), m[2], title.strip()
        else:
            yield None, "", line


def sections(operation: str) -> list[dict]:
    """Numbered sections at the smallest indent; deeper numbered lines are their subitems, and the body ends before them."""
    rows = list(_numbered(operation))
    least = min((width for width, _, _ in rows if width is not None), default=0)
    out: list[dict] = []
    open_: list[str] = []  # the lines of the section or subitem that is open; those before the first section belong to none
    for width, label, text in rows:
        if width is None:
            open_.append(text)
            continue
        open_ = []
        part = {"label": label, "title": text, "body": open_}
        if width == least:
            out.append(part | {"subitems": []})
        elif out:
            out[-1]["subitems"].append(part)
    for section in out:
        for part in (section, *section["subitems"]):
            part["body"] = "\n".join(part["body"]).strip()
        whole = [section["body"], *(f"{i['title']}\n{i['body']}".strip() for i in section["subitems"])]
        section["content_length"] = len("\n".join(whole).strip())
    return out


def with_sections(cards: DataFrame, operation: str = "operation", *, least_chars: int = 20) -> DataFrame:
    """One row for each section of each card's operation, flagged as no-op, actionable and self-contained."""
    small_batches(cards.sparkSession)

    @F.pandas_udf(SECTIONS)
    def parse(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sections(t or ""))

    got = cards.select("*", F.posexplode(parse(operation)).alias("section_no", "s")).select(*cards.columns, "section_no", "s.*")
    noop = noop_response(F.col("body"))
    text = F.concat_ws("\n", "body", F.array_join(F.transform("subitems", lambda i: F.concat_ws("\n", i["title"], i["body"])), "\n"))
    got = got.withColumn("is_noop", noop != "").withColumn("is_actionable", F.rlike(text, F.lit(ACTIONABLE)) & (noop == ""))
    return got.withColumn("is_self_contained", (F.length("body") > 0) & F.col("is_actionable") & (F.col("content_length") >= least_chars))


def should_split(sectioned: DataFrame, keys: list[str], operation: str = "operation") -> DataFrame:
    """(keys, meaningful, split): a long operation with enough meaningful sections becomes cards of its own."""
    got = sectioned.groupBy(*keys).agg(F.count_if("is_self_contained").alias("meaningful"), F.max(F.length(operation)).alias("n"))
    return got.select(*keys, "meaningful", ((F.col("n") >= SPLIT_LENGTH) & (F.col("meaningful") >= SPLIT_SECTIONS)).alias("split"))


def phase_title(phase: Column, name: Column, operation: Column) -> Column:
    """The step's name behind its phase; undoing steps that modify, set or delete say that they restore."""
    named = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("未命名步骤"))
    rest = F.substring(named, F.lit(3), F.length(named))
    undo = (phase == "ROLLBACK") & F.rlike(F.coalesce(operation, F.lit("")), F.lit(RESTORING))
    title = F.when(undo & (F.startswith(named, F.lit("修改")) | F.startswith(named, F.lit("设置"))), F.concat(F.lit("恢复"), rest, F.lit("原值"))).when(undo & F.startswith(named, F.lit("删除")), F.concat(F.lit("恢复已删除的"), rest)).otherwise(named)
    labels = F.create_map(*(F.lit(x) for kv in PHASE_LABELS.items() for x in kv))
    return F.concat(F.coalesce(labels[phase], F.nullif(phase, F.lit("")), F.lit("步骤")), F.lit("："), title)


def distinct_titles(cards: DataFrame, key: str = "case_id") -> DataFrame:
    """cards(key, position, title, fingerprint, qualifier, operation) with titles told apart.

    Equal titles of different fingerprints gain the qualifier; a second equal candidate also gains a digest.
    """
    same = Window.partitionBy(key, "title")
    differ = F.size(F.collect_set("fingerprint").over(same)) > 1
    candidate = F.concat("title", F.lit(" · "), "qualifier")
    again = F.row_number().over(Window.partitionBy(key, "title", "qualifier").orderBy("position")) > 1
    digest = F.substring(F.sha2(F.coalesce("operation", F.lit("")), 256), 1, 8)
    return cards.withColumn("new_title", F.when(~differ, F.col("title")).when(again, F.concat(candidate, F.lit(" · "), digest)).otherwise(candidate))


def collisions(cards: DataFrame) -> DataFrame:
    """(parent_unit_id, unit_id) of children that can be retrieved while their parent can, too."""
    parents = cards.filter("parent_unit_id IS NULL AND retrieval_enabled").select(F.col("unit_id").alias("parent_unit_id"))
    return cards.filter("retrieval_enabled").select("unit_id", "parent_unit_id").join(parents, "parent_unit_id").select("parent_unit_id", "unit_id")


def context_role(name: Column) -> Column:
    """The role of a context field by its name."""
    key = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "- ", "__")
    role = F.lit("IDENTITY_METADATA_CONTEXT")
    role = F.when(F.exists(F.array(*map(F.lit, GOVERNANCE_MARKERS)), lambda m: F.contains(key, m)), "GOVERNANCE_CONTEXT").otherwise(role)
    for name_, fields in reversed(ROLE_FIELDS.items()):
        role = F.when(key.isin(fields), name_).otherwise(role)
    return role


def paired_views(flat: DataFrame, grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, flat_pointer, grouped_pointer): the two views of the same records in each document, if there is one best pair.

    flat and grouped: key, pointer, signature, n, hashes. Only views of equal signature and count are candidates; they
    rank by matched records, then fewer unmatched ones; equal best pairs are refused.
    """
    g = grouped.select(key, "signature", "n", F.col("pointer").alias("grouped_pointer"), F.col("hashes").alias("other"))
    pairs = flat.select(key, "signature", "n", F.col("pointer").alias("flat_pointer"), "hashes").join(g, [key, "signature", "n"])
    counts = lambda a, v: F.size(F.filter(a, lambda x: x == v))
    matched = F.aggregate(F.array_distinct("hashes"), F.lit(0), lambda s, v: s + F.least(counts(F.col("hashes"), v), counts(F.col("other"), v)))
    pairs = pairs.withColumn("score", matched)
    best = Window.partitionBy(key)
    top = pairs.withColumn("most", F.max("score").over(best)).filter("score = most")
    return top.withColumn("ties", F.count("*").over(best)).filter("ties = 1").select(key, "flat_pointer", "grouped_pointer", F.col("score").alias("matched"))
