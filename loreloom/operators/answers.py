"""Evidence-pointer answers: claims are checked against the fields they point at, then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which category a field may support, and the order of categories in an answer.
CATEGORY_OF_FIELD = {
    "summary": "结论",
    "scenario": "适用条件",
    "object_name": "适用条件",
    "applicable_versions": "适用条件",
    "prerequisites": "适用条件",
    "procedure_steps": "执行步骤",
    "risks": "风险",
    "rollback_steps": "回退",
    "validation_steps": "验证",
}
CATEGORIES = ["适用条件", "执行步骤", "风险", "回退", "验证", "结论", "知识不足"]
INSUFFICIENT, MOST_CLAIMS = "知识不足", 30


def validate(claims: DataFrame, cards: DataFrame) -> DataFrame:
    """claims(answer_id, claim_no, category, card_id, field, index) with text and error (empty if none).

    cards: card_id and a map fields from field name to an array of values. A claim of insufficient knowledge must point
    at an empty field; all others at a value that is there. Repeats of category, text and card, and claims beyond the
    limit, are errors of their own.
    """
    allowed = F.create_map(*(F.lit(x) for kv in CATEGORY_OF_FIELD.items() for x in kv))
    got = claims.join(cards.select("card_id", "fields"), "card_id", "left")
    values = F.coalesce(F.filter(F.try_element_at("fields", F.col("field")), lambda v: F.length(F.trim(v)) > 0), F.array().cast("array<string>"))
    text = F.when(F.col("index") >= 0, F.get(values, F.col("index")))
    error = (
        F.when(F.col("fields").isNull(), "UNKNOWN_CARD")
        .when(~F.col("category").isin(CATEGORIES), "UNKNOWN_CATEGORY")
        .when((F.col("category") == INSUFFICIENT) & (F.size(values) > 0), "FIELD_NOT_EMPTY")
        .when((F.col("category") != INSUFFICIENT) & ~allowed[F.col("field")].eqNullSafe(F.col("category")), "CATEGORY_FIELD_MISMATCH")
        .when((F.col("category") != INSUFFICIENT) & text.isNull(), "INDEX_OUT_OF_RANGE")
    )
    got = got.withColumn("text", text).withColumn("error", F.coalesce(error, F.lit("")))
    again = F.row_number().over(Window.partitionBy("answer_id", "category", "text", "card_id", "error").orderBy("claim_no")) > 1
    got = got.withColumn("error", F.when((F.col("error") == "") & again, "DUPLICATE").otherwise(F.col("error")))
    place = F.sum((F.col("error") == "").cast("int")).over(Window.partitionBy("answer_id").orderBy("claim_no").rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn("error", F.when((F.col("error") == "") & (place > MOST_CLAIMS), "TOO_MANY").otherwise(F.col("error"))).drop("fields")


def render(claims: DataFrame) -> DataFrame:
    """(answer_id, answer): valid claims grouped under their categories in fixed order, each with its citation."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    line = F.concat(F.lit("- "), F.coalesce("text", F.concat(F.col("field"), F.lit(": -"))), F.lit(" [K-"), F.col("card_id"), F.lit("]"))
    ok = claims.filter("error = ''").withColumn("o", order).withColumn("line", line)
    sections = ok.groupBy("answer_id", "o", "category").agg(F.sort_array(F.collect_list(F.struct("claim_no", "line"))).alias("l"))
    body: Column = F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    sections = sections.withColumn("body", body)
    return sections.groupBy("answer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "body"))), lambda x: x["body"]), "\n\n").alias("answer"))
