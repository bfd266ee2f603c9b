"""Redaction, normalisation and resolution of JSON texts against plain recursion over the parsed values; profiles."""

import hashlib
import json
import random
import re
from datetime import datetime, timedelta, timezone

import pytest

from loreloom.operators import adapter, discovery, profiles, rewrite
from test_discovery import cases


CHINA = timezone(timedelta(hours=8))


def plain_redact(v, name=""):
    if re.search(rewrite.SECRET_NAME, name):
        return "[REDACTED]"
    if isinstance(v, dict):
        return {k: plain_redact(x, k) for k, x in v.items()}
    if isinstance(v, list):
        return [plain_redact(x, name) for x in v]
    if isinstance(v, str):
        if re.search(rewrite.TEXT_NAME, name):
            return {"redacted": True, "length": len(v), "sha256": hashlib.sha256(v.encode()).hexdigest()}
        return re.sub(rewrite.BEARER, "Bearer [REDACTED]", v)
    return v


def plain_normal(v, name=""):
    key = name.strip().casefold().replace("-", "_")
    if isinstance(v, list):
        return [plain_normal(x, name) for x in v]
    if isinstance(v, dict):
        return {k: plain_normal(x, k) for k, x in v.items()}
    if v is None:
        return None
    if isinstance(v, bool):
        return {"raw": v, "normalized": v, "type": "boolean"}
    if any(m in key for m in rewrite.TIME_MARKS):
        try:
            at = datetime.fromtimestamp(float(v) / (1000 if abs(float(v)) >= 1e11 else 1), timezone.utc)
        except ValueError:
            try:
                at = datetime.fromisoformat(v.replace("Z", "+00:00"))
                at = at if at.tzinfo else at.replace(tzinfo=CHINA)
            except ValueError:
                return {"raw": v, "normalization_error": "INVALID_TIMESTAMP"}
        at = at.astimezone(CHINA)
        return {"raw": v, "normalized": at.strftime("%Y-%m-%d %H:%M:%S"), "timezone": "Asia/Shanghai", "iso8601": at.isoformat(timespec="seconds")}
    if any(m in key for m in rewrite.SPAN_MARKS):
        return {"raw": v, "normalized": v, "unit": "source_defined" if isinstance(v, str) else "seconds"}
    if isinstance(v, (int, float)):
        return {"raw": v, "normalized": v, "type": "number"}
    return v.strip()


NAMES = ["api_key", "Authorization", "db-password", "text", "Prompt", "context", "a/b", "c~d", "Start-Time", "update_time", "total_time", "n", "", "é"]
VALUES = ["plain", " both ", "", "use Bearer abcdefgh.12345 now", 'quo"te\\ \n\u0001 é', 1, -2.5, 1e3, True, None, 1700000000, 1700000000000, "1700000000", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "never"]


def value(r, depth):
    if depth == 0 or r.random() < 0.3:
        return r.choice(VALUES)
    if r.random() < 0.6:
        return {k: value(r, depth - 1) for k in r.sample(NAMES, r.randint(0, 4))}
    return [value(r, depth - 1) for _ in range(r.randint(0, 3))]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    made = [value(r, 5) for _ in range(150)]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=[None, 1][i % 3 == 0])) for i, v in enumerate(made)]
    return made, spark.createDataFrame([*rows, (900, "{bad"), (901, None), (902, ' {"n" : [ ] } ')], "doc_id int, text string")


def test_redaction_at_every_depth(texts):
    made, docs = texts
    got = {r.doc_id: r.text for r in rewrite.redacted(docs, adapter.nodes(docs)).collect()}
    assert [json.loads(got[i]) for i in range(len(made))] == [plain_redact(v) for v in made]
    assert (got[900], got[901], got[902]) == ("{bad", None, ' {"n" : [ ] } ')
    same = [r for r in docs.collect() if r.doc_id < 900 and plain_redact(made[r.doc_id]) == made[r.doc_id]]
    assert len(same) > 20 and all(got[r.doc_id] == r.text for r in same)  # to the byte


def test_normal_forms_at_every_depth(texts):
    made, docs = texts
    got = {r.doc_id: r.text for r in rewrite.normalised(docs, adapter.nodes(docs)).collect()}
    assert [json.loads(got[i]) for i in range(len(made))] == [plain_normal(v) for v in made]


def test_pointers_resolve_to_their_source(texts, spark):
    made, docs = texts
    nodes = adapter.nodes(docs)
    wanted = nodes.select("doc_id", "pointer").unionByName(spark.createDataFrame([(0, "/nowhere"), (901, "")], "doc_id int, pointer string"))
    got = rewrite.resolved(wanted, docs, nodes).collect()
    for r in got:
        if r.pointer == "/nowhere" or r.doc_id == 901:
            assert r.value is None and r.type is None
        elif r.doc_id < 900:
            v = made[r.doc_id]
            for part in r.pointer.split("/")[1:]:
                v = v[int(part)] if isinstance(v, list) else v[part.replace("~1", "/").replace("~0", "~")]
            assert json.loads(r.value) == v
            assert r.type == {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def test_profiles(spark):
    texts = cases()
    texts["other_type"] = cases()["exact"]
    texts["other_type"]["data"]["region"] = 5
    texts["other_field"] = cases()["exact"]
    texts["other_field"]["extra"] = "x"
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "doc_id string, text string")
    nodes = adapter.nodes(docs)
    found = discovery.discover(docs, nodes)
    got = profiles.profiles(nodes, found)
    rows = got.collect()
    assert {r.doc_id for r in rows} == {"exact", "groups", "mutated", "other_type", "other_field"}
    exact = {(r.section, r.field): (r.json_type, r.policy) for r in rows if r.doc_id == "exact"}
    sizes = {s: sum(k[0] == s for k in exact) for s in profiles.POLICIES}
    assert sizes == {"task_fields": 13, "procedure_fields": 20, "execution_fields": 15, "context_fields": 12, "envelope_fields": 3}
    assert exact["execution_fields", "result_items"] == ("array", "not_executed") and exact["envelope_fields", "code"] == ("integer", "empty") and exact["task_fields", "task00"] == ("string", "generated")
    assert all(r.errors == [] for r in profiles.checked(got).collect())
    stored = got.filter("doc_id = 'exact'").withColumnRenamed("doc_id", "profile_id")
    assert {r.doc_id for r in profiles.compatible(got, stored).collect()} == {"exact", "groups", "mutated"}
    from pyspark.sql import functions as F

    differ = profiles.differences(got.withColumn("profile_id", F.lit("exact")), stored).collect()
    assert {(r.doc_id, r.section, r.field, r.json_type, r.wanted) for r in differ} == {("other_type", "context_fields", "region", "integer", "string"), ("other_field", "envelope_fields", "extra", "string", None)}
    bad = got.filter("doc_id = 'exact' AND field != 'task03'").withColumn("policy", F.when(F.col("field") == "result_items", "generated").otherwise(F.col("policy"))).withColumn("json_type", F.when(F.col("field") == "title", "text").otherwise(F.col("json_type")))
    assert [r.errors for r in profiles.checked(bad).collect()] == [["COUNT task_fields", "POLICY execution_fields.result_items", "TYPE context_fields.title"]]
