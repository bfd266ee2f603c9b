"""Structured change records: signatures, roles, relations between steps, profiles and policies, draft gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import type_matches
from ..functions.text import EXPECTED_VALUE, RELATION_TARGET, TRANSITION, ascii_identity
from ..tables import spread

# Patterns of values that must come from the request.
SPECIFIC = r"\b(?:\d{1,3}(?:\.\d{1,3}){3}|[A-Za-z]+-[0-9a-f]{6,}|\d{4,})\b"


def record_signature(objects: Column, arity: int) -> Column:
    """The sorted keys that all maps of an array share, as text, if there are arity of them; else null."""
    keys = F.transform(objects, lambda o: F.array_join(F.array_sort(F.map_keys(o)), "\x1f"))
    first = F.get(keys, F.lit(0))
    same = F.size(F.array_distinct(keys)) == 1
    return F.when(same & (F.size(F.map_keys(F.get(objects, F.lit(0)))) == arity), first)


def relationship_signature(cards: DataFrame, text: str = "operation") -> DataFrame:
    """cards with targets, transition (from, to) and expected values of their text."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = lambda pattern: F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), ascii_identity), lambda x: x != "")))
    # The text is searched once; both values come from the match, which is short.
    found = cards.withColumn("_transition", F.when(F.rlike(t, F.lit("->|→|到")), F.regexp_extract(t, TRANSITION, 0)))
    old, new = (F.nullif(ascii_identity(F.regexp_extract("_transition", TRANSITION, k)), F.lit("")) for k in (1, 2))
    return found.withColumns({"targets": every(RELATION_TARGET), "from_value": old, "to_value": new, "expected_values": every(EXPECTED_VALUE)}).drop("_transition")


def relationships(signed: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, source_unit_id, target_unit_id, relation_type) between steps(unit_id, phase, signature) of a case.

    A validation that expects what an implementation sets VALIDATES it, a rollback that reverses its transition is
    ROLLBACK_OF it. Both are one equi-join on case, target, kind and values: an implementation has a row for each kind.
    Rows are dealt over a stated number of partitions, as their few bytes in a shuffle are many in a sort.
    """
    def of(phases: list[str], *found: Column) -> DataFrame:
        # The fields go through the generator, so that no filter on them is computed from the text once more.
        return signed.filter(F.col("phase").isin(phases)).select(key, "unit_id", F.inline(F.flatten(F.concat(*found))))

    def each(kind: str, old, new):
        return lambda x: F.struct(x.alias("target"), F.lit(kind).alias("relation_type"), old.alias("done_from"), new.alias("done_to"))

    old, new, any_, targets = F.col("from_value"), F.col("to_value"), F.lit(""), F.col("targets")
    at = lambda phase, rows: F.when(F.col("phase") == phase, rows).otherwise(F.slice(rows, 1, 0))
    done = of(["IMPLEMENTATION"], F.array(F.transform(targets, each("VALIDATES", any_, new))), F.array(F.transform(targets, each("ROLLBACK_OF", old, new))))
    checked = F.transform("expected_values", lambda v: F.transform(targets, each("VALIDATES", any_, v)))
    undone = F.array(F.transform(targets, each("ROLLBACK_OF", new, old)))
    asked = of(["VALIDATION", "ROLLBACK"], at("VALIDATION", checked), at("ROLLBACK", undone))
    by = [key, "target", "relation_type", "done_from", "done_to"]
    full = "done_from IS NOT NULL AND done_to IS NOT NULL"
    found = spread(asked.filter(full), *by).join(spread(done.filter(full), *by).withColumnRenamed("unit_id", "target_unit_id"), by)
    found = found.filter("unit_id != target_unit_id").select(key, F.col("unit_id").alias("source_unit_id"), "target_unit_id", "relation_type")
    return spread(found, key, "source_unit_id", "target_unit_id").distinct()


def apply_policies(fields: DataFrame, profile: DataFrame, inputs: DataFrame) -> DataFrame:
    """(record_id, field, value, source, error): a profile's policy applied to each of a record's generated fields.

    fields: record_id, field, value, json_type. profile: field, json_type, policy, fixed. inputs: record_id, path, value.
    Policies: generated, input:<path>, input_optional:<path>, empty, not_executed, fixed. Fields that the profile lacks
    are errors, as are missing inputs and types that don't match.
    """
    ids = fields.select("record_id").distinct()
    wanted = ids.crossJoin(F.broadcast(profile.select("field", F.col("json_type").alias("wanted"), "policy", "fixed")))
    got = wanted.join(fields, ["record_id", "field"], "full")
    path = F.regexp_extract("policy", "^input(?:_optional)?:(.*)$", 1)
    given = inputs.select("record_id", "path", F.col("value").alias("given"))
    got = got.withColumn("path", path).join(given, ["record_id", "path"], "left")
    kind = F.regexp_extract("policy", "^([a-z_]+)", 1)
    value = F.when(kind == "generated", F.col("value")).when(kind.isin("input", "input_optional"), F.col("given")).when(kind == "fixed", F.col("fixed")).when(kind == "empty", "").when(kind == "not_executed", "NOT_EXECUTED")
    error = F.when(F.col("policy").isNull(), "EXTRA_FIELD").when((kind == "input") & F.col("given").isNull(), "MISSING_INPUT").when((kind == "generated") & F.col("value").isNull(), "NOT_GENERATED").when((kind == "generated") & ~type_matches(F.col("json_type"), F.col("wanted")), "TYPE_MISMATCH")
    return got.select("record_id", "field", value.alias("value"), kind.alias("source"), F.coalesce(error, F.lit("")).alias("error"))


def unbound_parameters(values: DataFrame, known: DataFrame) -> DataFrame:
    """(record_id, path, unbound) of values(record_id, path, value): addresses, ids and numbers that known(record_id, value) lacks."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("value", F.lit("")), F.lit(SPECIFIC), 0))
    have = known.groupBy("record_id").agg(F.collect_set("value").alias("have"))
    got = values.join(have, "record_id", "left")
    return got.select("record_id", "path", F.array_sort(F.array_except(found, F.coalesce("have", F.array().cast("array<string>")))).alias("unbound")).filter(F.size("unbound") > 0)


def profile_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(section, field, a_type, b_type) where two profiles(section, field, json_type) differ; none means compatible."""
    left, right = (x.select("section", "field", F.col("json_type").alias(n)) for x, n in ((a, "a_type"), (b, "b_type")))
    return left.join(right, ["section", "field"], "full").filter(~F.col("a_type").eqNullSafe(F.col("b_type")))


def node_coverage(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, nodes, owned, coverage): share of nodes(doc_id, pointer) that lie at or below a root(doc_id, pointer).

    Prefixes of the depths that roots have are joined to them by equality, so no prefix join is needed; a node has a row
    for each such depth, and one if it has none.
    """
    parts = F.split("pointer", "/")
    depths = sorted(r[0] for r in roots.filter("pointer IS NOT NULL").select(F.size(parts)).distinct().collect())  # a handful of numbers
    prefixes = F.transform(F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = nodes.select("doc_id", "pointer", F.explode_outer(prefixes).alias("root"))
    hit = spread.join(roots.select("doc_id", F.col("pointer").alias("root")).distinct().withColumn("hit", F.lit(1)), ["doc_id", "root"], "left")
    each = hit.groupBy("doc_id", "pointer").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("own"))
    return each.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.sum("own").alias("owned"), F.round(F.avg("own"), 4).alias("coverage"))
