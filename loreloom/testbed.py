"""Deterministic projections of the test tables onto the engine's records; the SQL runs alike on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations embeddings".split()

#: Documents as knowledge cards.
CARDS = """SELECT doc_id AS id, substr(text, 1, 80) AS title, substr(text, 81) AS summary, lang AS scenario, source AS object_name,
    CASE doc_id % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'PENDING_REVIEW' WHEN 2 THEN 'DRAFT' ELSE 'REJECTED' END AS status,
    CASE doc_id % 11 WHEN 0 THEN 'SKIPPED' WHEN 1 THEN NULL ELSE 'INDEXED' END AS publish_status,
    CASE doc_id % 13 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS retrieval_enabled, n_chars FROM documents"""
#: Line items as cards of a case (their order).
BUNDLE_CARDS = """SELECT CAST(l_orderkey AS STRING) AS case_id, l_orderkey * 10 + l_linenumber AS card_id, l_linenumber AS source_order,
    CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'REJECTED' ELSE 'SUPERSEDED' END
        ELSE CASE WHEN l_quantity < 25 THEN 'APPROVED' ELSE 'PENDING_REVIEW' END END AS status,
    CASE l_linenumber % 4 WHEN 0 THEN 'PRECHECK' WHEN 1 THEN 'IMPLEMENTATION' WHEN 2 THEN 'VALIDATION' ELSE 'ROLLBACK' END AS unit_role FROM lineitem"""
#: Card relations: each card to its third and fourth successors.
RELATIONS = """SELECT doc_id AS card_id, doc_id + 3 AS related_card_id, 'RELATED_TO' AS relation_type, CAST((doc_id % 10) / 10.0 AS DOUBLE) AS confidence FROM documents
    UNION ALL SELECT doc_id, doc_id + 4, 'DUPLICATE_OF', CAST((doc_id % 7) / 7.0 AS DOUBLE) FROM documents WHERE doc_id % 5 = 0"""
#: Events as run events: what happened to a user's run.
RUN_EVENTS = """SELECT event_id, user_id AS run_id, CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'CLAIMED' WHEN 'click' THEN 'APPROVAL_REQUESTED'
    WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS kind, ts, value FROM events"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers the test tables as temporary views."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def frame(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """One of the projections above (or other SQL over the tables it names)."""
    views(spark, sf_dir, *names)
    return spark.sql(sql)
