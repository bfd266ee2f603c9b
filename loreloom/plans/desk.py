"""Queries of views, memory copies, tickets and scalars over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import testbed as tb
from ..functions import json as fj
from ..functions import text as ft
from ..functions import time as fm
from ..operators import adapter, cards, discovery, governance, memory, profiles, records, rewrite, tickets, views
from ..operators.joins import merged
from ..tables import Table, spread
from .catalogue import ORACLES, _cards, _read, query

_CARD = "l_orderkey * 10 + l_linenumber"


def _card_id():
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, o_orderstatus AS source_name, p_name AS chunk_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def card_sources(spark, d):
    cards = _read(spark, d, "lineitem").select(_card_id().alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("chunk_id"))
    documents = _read(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("source_name"))
    chunks = _read(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("chunk_name"))
    return views.card_sources(cards, documents, chunks).select("id", "source_name", "chunk_name")


@query(f"""WITH l AS (SELECT DISTINCT l_suppkey AS case_id, {_CARD} AS card_id, l_linenumber AS source_order, l_orderkey AS document_id FROM lineitem)
    SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY source_order, card_id)::INTEGER AS place, card_id, o_orderpriority AS source_name FROM l JOIN orders ON o_orderkey = document_id""")
def case_card_order(spark, d):
    lines = _read(spark, d, "lineitem")
    lineage = lines.select(F.col("l_suppkey").alias("case_id"), _card_id().alias("card_id"), F.col("l_linenumber").alias("source_order")).distinct()
    cards = lines.select(_card_id().alias("card_id"), F.col("l_orderkey").alias("document_id")).distinct()
    documents = _read(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("source_name"))
    return views.case_cards(lineage, cards, documents).select("case_id", "place", "card_id", "source_name")


@query("SELECT o_orderkey AS case_id, c_name AS source_name, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def case_documents(spark, d):
    cases = _read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status"))
    return views.case_documents(cases, _read(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("source_name"))).select("case_id", "source_name", "status")


@query(f"""WITH r AS ({tb.RELATIONS}), c AS ({tb.CARDS}) SELECT card_id, related_card_id, title, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY card_id ORDER BY confidence DESC, related_card_id)::INTEGER AS rank FROM r JOIN c ON c.id = related_card_id""")
def relation_titles(spark, d):
    got = views.titled_relations(tb.frame(spark, d, tb.RELATIONS, "documents"), _cards(spark, d))
    return got.select("card_id", "related_card_id", "title", F.round("confidence", 6).alias("confidence"), "rank")


@query(f"SELECT fingerprint, arg_min(id, (status <> 'APPROVED', id)) AS id, arg_min(status, (status <> 'APPROVED', id)) AS status FROM (SELECT *, sha256(scenario || object_name) AS fingerprint FROM ({tb.CARDS})) GROUP BY fingerprint")
def preferred_card(spark, d):
    return views.preferred(_cards(spark, d).withColumn("fingerprint", F.sha2(F.concat("scenario", "object_name"), 256)))


@query(f"SELECT id, status FROM ({tb.CARDS}) WHERE status = 'PENDING_REVIEW'")
def cards_of_status(spark, d):
    return views.with_status(_cards(spark, d), "pending_review").select("id", "status")


@query(f"SELECT case_id, status FROM ({ORACLES['bundle_rollup_status']}) WHERE status = 'PARTIAL' ORDER BY case_id DESC LIMIT 20 OFFSET 5")
def case_status_page(spark, d):
    return views.case_page(governance.bundle_rollup(tb.frame(spark, d, tb.BUNDLE_CARDS, "lineitem")), "partial", limit=20, offset=5).select("case_id", "status")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS ref FROM lineitem), k AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS ref FROM lineitem WHERE l_returnflag IN ('A', 'R'))
    SELECT doc_id, count(*) AS refs, count(*) - count(k.ref) AS leftover, count(*) = count(k.ref) AS accounted FROM r LEFT JOIN k USING (doc_id, ref) GROUP BY doc_id""")
def references_accounted(spark, d):
    refs = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ref"), "l_returnflag")
    return views.accounted(refs, refs.filter("l_returnflag = 'A'"), refs.filter("l_returnflag = 'R'"), "doc_id")


@query("SELECT DISTINCT l_orderkey AS card_id, l_partkey AS memory_id FROM lineitem WHERE l_linenumber <= 3 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 3")
def retired_ids(spark, d):
    ids = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("card_id"), F.col("l_partkey").alias("memory_id"), "l_linenumber")
    return views.retired(ids.filter("l_linenumber <= 3"), ids.filter("l_linenumber >= 3"), ["card_id", "memory_id"])


@query("""WITH s AS (SELECT l_orderkey AS draft_id, l_suppkey % 5 AS item FROM lineitem WHERE l_linenumber % 2 = 0), r AS (SELECT DISTINCT l_orderkey AS draft_id, l_suppkey % 5 AS item FROM lineitem WHERE l_linenumber % 2 = 1)
    SELECT s.draft_id, bool_and(r.item IS NOT NULL) AS subset FROM s LEFT JOIN r ON r.draft_id = s.draft_id AND r.item = s.item GROUP BY s.draft_id""")
def selection_is_subset(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), (F.col("l_suppkey") % 5).alias("item"), "l_linenumber")
    return views.is_subset(rows.filter("l_linenumber % 2 = 0"), rows.filter("l_linenumber % 2 = 1"), "draft_id", "item")


@query("""WITH i AS (SELECT o_orderpriority || ':' || count(*) AS x FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority)
    SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 2) AS average, (SELECT string_agg(x, ',' ORDER BY x) FROM i) AS issues FROM orders""")
def evaluation_summary(spark, d):
    ok = F.col("o_orderstatus") == "F"
    got = views.evaluation(_read(spark, d, "orders").select(ok.alias("passed"), F.when(~ok, F.col("o_orderpriority")).alias("issue"), F.col("o_totalprice").alias("quality")))
    return got.withColumn("average", F.round("average", 2))


@query("SELECT count(*) FILTER (WHERE toxic = 1) AS negatives, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS accepted, count(*) FILTER (WHERE toxic = 1 AND quality = 1) / count(*) FILTER (WHERE toxic = 1) AS rate FROM labels")
def false_accepts(spark, d):
    return views.false_accept_rate(_read(spark, d, "labels").select((F.col("toxic") == 1).alias("negative"), (F.col("quality") == 1).alias("accepted")))


@query("SELECT l_suppkey AS case_id, l_linenumber % 4 AS role, arg_min('f' || l_partkey, l_orderkey * 1000000000 + l_partkey) FILTER (WHERE l_partkey % 3 <> 0) AS fields FROM lineitem GROUP BY 1, 2")
def first_fields_of_role(spark, d):
    p = F.col("l_partkey")
    rows = _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_linenumber") % 4).alias("role"), (F.col("l_orderkey") * 1_000_000_000 + p).alias("at"), F.when(p % 3 != 0, F.concat(F.lit("f"), p)).alias("fields"))
    return views.first_of_role(rows, "case_id", "role", "at", "fields")


@query("""WITH s AS (SELECT o_orderkey AS session_id, o_custkey AS owner, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS ended_at FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY owner) AS n FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ended_at, session_id) AS place FROM n WHERE ended_at IS NOT NULL) SELECT session_id, owner FROM r WHERE place <= n - 7""")
def evicted_sessions(spark, d):
    rows = _read(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ended_at"))
    return views.evicted(rows, "owner", 8).select("session_id", "owner")


@query('SELECT l_orderkey AS doc_id, l_partkey AS start, l_partkey + l_linenumber AS "end", (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_partkey + l_linenumber) - 1)::INTEGER AS unit_index FROM lineitem')
def unit_order(spark, d):
    p = F.col("l_partkey")
    return views.numbered_spans(_read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), p.alias("start"), (p + F.col("l_linenumber")).alias("end")), "doc_id")


@query("""SELECT doc_id AS card_id, CASE WHEN doc_id % 5 = 0 THEN 'COUNT_DIFFERS' WHEN doc_id % 7 = 0 THEN 'POINTERS_DIFFER' WHEN doc_id % 11 = 0 THEN 'SOURCE_CHANGED' ELSE '' END AS problem,
    source || '#pointer=/a/0;chars=0-' || length(text) || ';sha256=' || sha256(text) || ';match=structured' AS locator, source || '#chunk=' || (doc_id % 3 + 1) || ';chars=0-' || length(text) || CASE WHEN doc_id % 2 = 0 THEN ';match=exact' ELSE ';unverified' END AS quoted FROM documents""")
def evidence_gate(spark, d):
    docs, i = _read(spark, d, "documents"), F.col("doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    spans = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(f"/a/{k}").alias("pointer"), s.alias("start"), e.alias("end"), F.sha2(F.substring(F.col("text"), s + 1, e - s), 256).alias("sha256")) for k, (s, e) in enumerate(((F.lit(0), half), (half, F.length("text"))))))
    expected = docs.select(i.alias("card_id"), F.explode(spans).alias("s")).select("card_id", "s.*")
    k = F.col("card_id")
    given = expected.filter((k % 5 != 0) | (F.col("place") == 0)).select("card_id", "place", F.when((k % 7 == 0) & (F.col("place") == 1), "/b").otherwise(F.col("pointer")).alias("pointer"))
    content = docs.select(i.alias("card_id"), F.when(i % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    content = content.withColumn("content", F.when(k % 11 == 0, F.concat(F.lit("!"), "content")).otherwise(F.col("content")))
    n = F.length("text")
    locators = docs.select(i.alias("card_id"), views.pointer_locator(F.col("source"), F.lit("/a/0"), F.lit(0), n, F.sha2("text", 256)).alias("locator"), views.chunk_locator(F.col("source"), (i % 3).cast("int"), F.lit(0), n, F.when(i % 2 == 0, "exact")).alias("quoted"))
    return views.structured_evidence(expected, given, content).join(locators, "card_id")


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS absent, sha256('{"event_type":"' || event_type || '","k":' || json_extract(props, '$.k')::VARCHAR || ',"user_id":' || user_id || '}') AS snapshot FROM events""")
def decoded_events(spark, d):
    got = views.decoded(_read(spark, d, "events"), "props", "k long, absent string")
    return got.select("event_id", "k", "absent", views.snapshot_hash("user_id", "event_type", "k").alias("snapshot"))


@query("""WITH c AS (SELECT doc_id AS card_id, lang, source FROM documents WHERE doc_id % 9 <> 0) SELECT x.doc_id * 10 AS draft_id, x.doc_id AS card_id, c.card_id IS NULL OR x.doc_id % 4 = 0 AS drift FROM documents x LEFT JOIN c ON c.card_id = x.doc_id""")
def snapshot_drift(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("card_id"), "lang", "source")
    drafts = docs.select((F.col("card_id") * 10).alias("draft_id"), "card_id", views.snapshot_hash("lang", "source").alias("snapshot"))
    changed = docs.filter("card_id % 9 <> 0").withColumn("lang", F.when(F.col("card_id") % 4 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("lang")))
    return views.drifted(drafts, changed, "lang", "source")


@query(f"""WITH c AS ({tb.CARDS}), r AS (SELECT card_id, string_agg(related_card_id || ':' || relation_type, ',' ORDER BY related_card_id, relation_type) AS rs FROM ({tb.RELATIONS}) GROUP BY card_id)
    SELECT id, status, coalesce(rs, '') AS relations, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS n_lineage FROM c LEFT JOIN r ON r.card_id = id""")
def card_details(spark, d):
    cards = _cards(spark, d).select("id", "status")
    lineage = cards.filter("id % 3 = 0").select(F.col("id").alias("card_id"), F.lit("c").alias("case_id"), F.lit(1).alias("source_order"))
    got = views.card_detail(cards, tb.frame(spark, d, tb.RELATIONS, "documents"), lineage)
    return got.select("id", "status", F.array_join(F.transform("relations", lambda r: F.concat_ws(":", r["related_card_id"].cast("string"), r["relation_type"])), ",").alias("relations"), F.size("lineage").alias("n_lineage"))


@query(f"SELECT DISTINCT {_CARD} AS card_id, CASE WHEN l_linenumber % 2 = 0 THEN 'parametermaxconn' ELSE substr('do step ' || l_linenumber || ' of the order with care', 1, 28) END AS qualifier FROM lineitem")
def title_qualifiers(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    op = F.when(even, "set parameter max_conn a -> b").otherwise(F.concat(F.lit("\n  do step "), F.col("l_linenumber"), F.lit(" of the order with care\nmore")))
    cards = records.relationship_signature(_read(spark, d, "lineitem").select(_card_id().alias("card_id"), op.alias("operation")).distinct())
    return cards.select("card_id", views.title_qualifier(F.col("targets"), F.col("operation")).alias("qualifier"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS n FROM lineitem) SELECT o_orderkey AS case_id, '# order ' || o_orderkey || coalesce(chr(10) || chr(10) || string_agg('## step ' || n || chr(10) || chr(10) || 'do ' || n, chr(10) || chr(10) ORDER BY n), '') AS markdown FROM orders LEFT JOIN c ON case_id = o_orderkey GROUP BY o_orderkey""")
def case_export(spark, d):
    n = F.col("l_linenumber")
    cards = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), n.alias("source_order"), F.concat(F.lit("step "), n).alias("title"), F.concat(F.lit("do "), n).alias("summary")).distinct()
    return views.case_markdown(_read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("case_title")), cards)


@query("SELECT DISTINCT sha256(text) AS checksum FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def unpublished_documents(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return views.unpublished(docs, docs.filter("doc_id % 2 = 0")).select("checksum")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderpriority END AS priority, 1 AS schema_version, 'NEW' AS state FROM orders")
def migrated_orders(spark, d):
    old = _read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"))
    added = {"priority": F.lit("none"), "schema_version": F.lit(1), "state": F.lit("NEW")}
    return views.migrated(views.migrated(old, added), added)


_MEMORY_CARDS = f"SELECT *, 'doc' AS object_type, CASE WHEN id % 2 = 0 THEN [title, object_name] ELSE []::VARCHAR[] END AS keywords FROM ({tb.CARDS})"
_MEMORY_TEXT = "'Ops Knowledge Studio 已审核知识卡片 K' || id || chr(10) || '标题：' || title || chr(10) || '摘要：' || coalesce(summary, '') || chr(10) || '场景：' || scenario || chr(10) || '对象类型：doc' || chr(10) || '对象：' || object_name || CASE WHEN id % 2 = 0 THEN chr(10) || '关键词：' || title || '；' || object_name ELSE '' END"


def _memory_cards(spark, d):
    words = F.when(F.col("id") % 2 == 0, F.array("title", "object_name")).otherwise(F.array().cast("array<string>"))
    return _cards(spark, d).withColumn("object_type", F.lit("doc")).withColumn("keywords", words)


@query(f"""WITH c AS ({_MEMORY_CARDS}), n AS (SELECT id, sha256({_MEMORY_TEXT}) AS h, CASE WHEN status <> 'APPROVED' THEN 'SKIPPED_NOT_APPROVED' WHEN publish_status = 'SKIPPED' THEN 'SKIPPED_NOT_PUBLISHABLE' WHEN NOT retrieval_enabled THEN 'SKIPPED_RETRIEVAL_DISABLED' END AS reason FROM c),
    s AS (SELECT id AS card_id, CASE WHEN id % 3 = 0 THEN sha256({_MEMORY_TEXT}) ELSE 'old' END AS sh FROM c WHERE id % 5 <> 0 UNION ALL SELECT -1, 'x')
    SELECT coalesce(id, card_id) AS card_id, h AS content_hash, CASE WHEN sh IS NOT NULL AND (h IS NULL OR reason IS NOT NULL) THEN 'RETIRE' WHEN reason IS NOT NULL THEN reason WHEN h = sh THEN 'ALREADY_SYNCED' ELSE 'SYNC' END AS action FROM n FULL JOIN s ON card_id = id""")
def memory_sync_plan(spark, d):
    cards = _memory_cards(spark, d)
    synced = cards.filter("id % 5 <> 0").select(F.col("id").alias("card_id"), F.when(F.col("id") % 3 == 0, F.sha2(memory.card_text(cards), 256)).otherwise("old").alias("synced_hash"))
    return memory.sync_plan(cards, synced.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("card_id"), F.lit("x").alias("synced_hash"))))


@query(f"""WITH c AS ({tb.CARDS}) SELECT v.doc_id * 2 + 1 AS memory_id, id AS card_id, status, CASE WHEN id % 3 = 0 THEN 'case-' || id END AS case_id FROM documents v JOIN c ON id = v.doc_id WHERE status <> 'APPROVED'""")
def memory_stale_links(spark, d):
    cards = _cards(spark, d)
    links = _read(spark, d, "documents").select((F.col("doc_id") * 2 + 1).alias("memory_id"), F.col("doc_id").alias("card_id"))
    lineage = cards.filter("id % 3 = 0").select(F.col("id").alias("card_id"), F.concat(F.lit("case-"), "id").alias("case_id"))
    return memory.stale_links(links, cards, lineage).select("memory_id", "card_id", "status", "case_id")


_SYNC = {"F": "SUCCEEDED", "O": "FAILED", "P": "PROCESSING"}


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS processing, max(o_orderdate) AS last_update,
    (SELECT count(*) FROM lineitem) AS links, (SELECT count(*) FROM part) AS retirements FROM orders""")
def memory_sync_stats(spark, d):
    of = F.create_map(*(F.lit(x) for kv in _SYNC.items() for x in kv))
    sync = _read(spark, d, "orders").select(of[F.col("o_orderstatus")].alias("status"), F.col("o_orderdate").alias("updated_at"))
    return memory.sync_stats(sync, _read(spark, d, "lineitem"), _read(spark, d, "part"))


@query("SELECT o_orderkey AS memory_id, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 30")
def memory_retirements_due(spark, d):
    rows = _read(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("case_id"))
    return memory.due_retirements(rows, 30, "1-URGENT").select("memory_id", "created_at")


@query("SELECT count(*) FILTER (WHERE p_size > 10) AS removed, count(*) FILTER (WHERE p_size <= 10) AS failed FROM part WHERE p_partkey % 4 <> 0")
def memory_cleanup(spark, d):
    parts = _read(spark, d, "part")
    deleted = parts.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("memory_id"), (F.col("p_size") > 10).alias("ok"))
    return memory.cleanup(parts.select(F.col("p_partkey").alias("memory_id")), deleted)


@query("""WITH r AS (SELECT c_custkey AS card_id, 'h' || c_custkey % 2 AS h FROM customer), c AS (SELECT s_suppkey AS card_id, 'h0' AS sh, CASE s_suppkey % 3 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'PROCESSING' ELSE 'FAILED' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 'me' ELSE 'you' END AS holder, s_suppkey % 5 > 1 AS live FROM supplier),
    d AS (SELECT card_id, holder, CASE WHEN status = 'SUCCEEDED' AND sh = h THEN 'ALREADY_SYNCED' WHEN status = 'PROCESSING' AND holder <> 'me' AND live THEN 'IN_PROGRESS' ELSE 'CLAIMED' END AS decision FROM r LEFT JOIN c USING (card_id))
    SELECT card_id, decision, CASE decision WHEN 'CLAIMED' THEN 'me' ELSE holder END AS owner FROM d""")
def memory_claims(spark, d):
    k, now = F.col("s_suppkey"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    requests = _read(spark, d, "customer").select(F.col("c_custkey").alias("card_id"), F.concat(F.lit("h"), F.col("c_custkey") % 2).alias("content_hash"), F.lit("me").alias("owner_token"))
    until = F.when(k % 5 > 1, F.to_timestamp(F.lit("2024-02-01 00:00:00"))).otherwise(F.to_timestamp(F.lit("2023-02-01 00:00:00")))
    claims = _read(spark, d, "supplier").select(k.alias("card_id"), F.lit("h0").alias("synced_hash"), F.when(k % 3 == 0, "SUCCEEDED").when(k % 3 == 1, "PROCESSING").otherwise("FAILED").alias("status"), F.when(k % 4 == 0, "me").otherwise("you").alias("holder"), until.alias("lease_until"))
    return memory.claim_sync(requests, claims, now)


@query("""WITH t AS (SELECT o_orderkey AS id, o_custkey % 4 AS c, o_orderkey % 6 AS h FROM orders), g AS (SELECT id, unnest([{'v': 'synthetic_boundary', 'p': id % 7 <> 0}, {'v': 'vpc_exists', 'p': id % 5 <> 0}, {'v': 'destination_cidr', 'p': c <> 3}, {'v': 'standby_link_health', 'p': h < 5 AND h % 2 = 0},
      {'v': 'standby_capacity', 'p': h < 5 AND h * 15 < 60}, {'v': 'standby_prefix_advertisement', 'p': h < 5 AND c < 2}, {'v': 'approved_knowledge_only', 'p': id % 3 <> 0}, {'v': 'change_window', 'p': id % 4 <> 0}, {'v': 'snapshot_consistency', 'p': id % 11 <> 0}]) AS x FROM t),
    l AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS rt, l_partkey % 3 AS dst, l_linenumber % 2 AS f FROM lineitem),
    r AS (SELECT s_suppkey AS rt, s_suppkey % 3 AS dst, 1 AS n FROM supplier WHERE s_suppkey % 8 <> 0 UNION ALL SELECT s_suppkey, s_suppkey % 3, 1 FROM supplier WHERE s_suppkey % 8 = 1), e AS (SELECT rt, dst, count(*) AS n FROM r GROUP BY 1, 2),
    s AS (SELECT l.*, l.rt IN (SELECT rt FROM r) AS there, coalesce(n = 1, false) AS one FROM l LEFT JOIN e USING (rt, dst))
    SELECT id AS ticket_id, x.v AS validator, x.p AS passed FROM g UNION ALL SELECT id, 'resource_exists:' || rt, there FROM s UNION ALL SELECT id, 'single_exact_route:' || rt, one FROM s UNION ALL SELECT id, 'baseline_next_hop:' || rt, one AND f = 1 FROM s""")
def ticket_gates(spark, d):
    k, start = F.col("o_orderkey"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    destinations = F.array(*map(F.lit, ("10.0.0.0/8", "10.64.0.0/10", "192.168.4.0/22", "10.0.0.1/8")))
    end = F.when(k % 4 != 0, F.to_timestamp(F.lit("2024-01-01 00:30:00"))).otherwise(start)
    statuses = F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(F.lit("APPROVED"), F.lit("DRAFT"))).otherwise(F.array(F.lit("APPROVED")))
    asked = _read(spark, d, "orders").select(
        k.alias("ticket_id"), F.lit(True).alias("synthetic"), (k % 7 != 0).alias("environment_synthetic"), F.lit("vpc-1").alias("vpc_id"), F.when(k % 10 != 0, F.when(k % 5 == 0, "vpc-2").otherwise("vpc-1")).alias("actual_vpc_id"),
        F.element_at(destinations, (F.col("o_custkey") % 4 + 1).cast("int")).alias("destination"), F.concat(F.lit("hop-"), k % 6).alias("to_next_hop"), statuses.alias("statuses"), start.alias("starts"), end.alias("ends"), F.lit(30).alias("window_minutes"),
        F.lit(4).alias("expected_version"), F.when(k % 22 == 0, 5).otherwise(4).alias("actual_version"), F.lit("h").alias("expected_hash"), F.when(k % 11 == 0, "g").otherwise("h").alias("actual_hash"),
    )
    lines, s = _read(spark, d, "lineitem"), F.col("s_suppkey")
    steps = lines.select(F.col("l_orderkey").alias("ticket_id"), F.col("l_suppkey").alias("route_table_id"), (F.col("l_partkey") % 3).cast("string").alias("destination"), F.when(F.col("l_linenumber") % 2 == 1, "old").otherwise("older").alias("from_next_hop")).distinct()
    routes = _read(spark, d, "supplier").filter("s_suppkey % 8 <> 0").select(s.alias("route_table_id"), (s % 3).cast("string").alias("destination"), F.lit("old").alias("next_hop"), F.explode(F.when(s % 8 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col")
    hops = spark.range(5).select(F.concat(F.lit("hop-"), "id").alias("hop"), F.when(F.col("id") % 2 == 0, "UP").otherwise("DOWN").alias("status"), (F.col("id") * 15.0).alias("utilization"), F.array(F.lit("10.0.0.0/8"), F.lit("10.64.0.0/10")).alias("prefixes"))
    return tickets.gates(asked, steps, routes, hops)


@query("""SELECT o_orderkey AS ticket_id, sha256('{"price":' || o_custkey || ',"status":"' || o_orderstatus || '","ticket_id":' || o_orderkey || '}') AS plan_hash FROM orders""")
def ticket_plan_hash(spark, d):
    rows = _read(spark, d, "orders").select(F.col("o_orderkey").alias("ticket_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("price"))
    return rows.select("ticket_id", tickets.plan_hash("ticket_id", "status", "price").alias("plan_hash"))


@query("""WITH s AS (SELECT user_id AS env, event_type AS key, event_id AS seq, 'v' || event_id AS after, coalesce(lag('v' || event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 'start') AS before FROM events),
    w AS (SELECT *, min(CASE WHEN seq % 89 = 0 THEN seq END) OVER (PARTITION BY env) AS wrong FROM s) SELECT env, seq, key, before, after, coalesce(seq < wrong, true) AS applied FROM w""")
def plan_execution(spark, d):
    rows = _read(spark, d, "events").select(F.col("user_id").alias("env"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.concat(F.lit("v"), F.col("event_id")).alias("after"))
    true = F.coalesce(F.lag("after").over(Window.partitionBy("env", "key").orderBy("seq")), F.lit("start"))
    plan = rows.withColumn("expected", F.when(F.col("seq") % 89 == 0, "something else").otherwise(true))
    return tickets.executed(plan, rows.select("env", "key", F.lit("start").alias("value")).distinct())


@query("""WITH e AS (SELECT l_orderkey AS id, arg_max(l_returnflag, l_linenumber::BIGINT * 1000000000 + l_partkey) AS f, arg_max(l_suppkey % 2 = 0, l_linenumber::BIGINT * 1000000000 + l_partkey) AS m FROM lineitem WHERE l_orderkey % 6 <> 0 GROUP BY 1)
    SELECT o_orderkey AS ticket_id, CASE WHEN o_orderstatus <> 'F' THEN 'EXECUTING' WHEN f IS NULL THEN 'VERIFYING' WHEN f = 'R' AND NOT m THEN 'FAILED' WHEN f = 'R' THEN 'ROLLED_BACK' ELSE 'SUCCEEDED' END AS status FROM orders LEFT JOIN e ON id = o_orderkey""")
def ticket_recovery(spark, d):
    asked = _read(spark, d, "orders").select(F.col("o_orderkey").alias("ticket_id"), F.when(F.col("o_orderstatus") == "F", "VERIFYING").otherwise("EXECUTING").alias("status"))
    done = _read(spark, d, "lineitem").filter("l_orderkey % 6 <> 0").select(F.col("l_orderkey").alias("ticket_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_returnflag") == "R", "ROLLED_BACK").otherwise("SUCCEEDED").alias("outcome"), (F.col("l_suppkey") % 2 == 0).alias("matches_before"))
    return tickets.recovered(asked, done)


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'WAITING_APPROVAL' WHEN 1 THEN 'SUCCEEDED' WHEN 2 THEN 'FAILED' ELSE 'RUNNING' END AS r, CASE WHEN event_id % 3 = 0 THEN 'TOOL_APPROVAL_REJECTED' END AS e, CASE user_id % 4 WHEN 0 THEN 'WAITING_APPROVAL' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'REJECTED' END AS t FROM events)
    SELECT event_id, CASE WHEN r = 'WAITING_APPROVAL' THEN coalesce(t = 'WAITING_APPROVAL', false) WHEN r = 'SUCCEEDED' THEN coalesce(t = 'FAILED', false) WHEN r = 'FAILED' AND e IS NOT NULL THEN coalesce(t = 'REJECTED', false) ELSE true END AS consistent FROM p""")
def snapshot_pairs(spark, d):
    i, u = F.col("event_id") % 4, F.col("user_id") % 4
    run = F.when(i == 0, "WAITING_APPROVAL").when(i == 1, "SUCCEEDED").when(i == 2, "FAILED").otherwise("RUNNING")
    ticket = F.when(u == 0, "WAITING_APPROVAL").when(u == 1, "FAILED").when(u == 2, "REJECTED")
    return _read(spark, d, "events").select("event_id", tickets.consistent(run, F.when(F.col("event_id") % 3 == 0, tickets.REJECTED_RUN), ticket).alias("consistent"))


@query("""WITH r AS (SELECT DISTINCT user_id AS run_id, event_type AS tool, user_id % 3 AS digest FROM events), c AS (SELECT user_id AS run_id, event_type AS tool, event_id % 3 AS digest, arg_max(CASE WHEN event_id % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END, event_id) AS x FROM events GROUP BY 1, 2, 3)
    SELECT run_id, tool, coalesce(x, 'PENDING') AS state FROM r LEFT JOIN c USING (run_id, tool, digest)""")
def approval_states(spark, d):
    e = _read(spark, d, "events")
    requests = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("tool"), (F.col("user_id") % 3).alias("digest")).distinct()
    decisions = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("tool"), (F.col("event_id") % 3).alias("digest"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "APPROVED").otherwise("REJECTED").alias("decision"))
    return tickets.approvals(requests, decisions)


@query("""WITH c AS (SELECT l_orderkey AS run_id, max(l_linenumber) AS step FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
    SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'INTERRUPTED' ELSE 'CANCELLED' END AS status, CASE WHEN o_orderstatus = 'O' THEN step END AS resume_at FROM orders LEFT JOIN c ON run_id = o_orderkey""")
def restart_recovery(spark, d):
    s = F.col("o_orderstatus")
    runs = _read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(s == "F", "SUCCEEDED").when(s == "O", "RUNNING").otherwise("CANCEL_REQUESTED").alias("status"))
    return tickets.interrupted(runs, _read(spark, d, "lineitem").filter("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step")))


@query("""SELECT o_orderkey AS run_id, (o_custkey % 3 + 1)::BIGINT AS attempt FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 4 < 2) ORDER BY o_orderdate, o_orderkey LIMIT 40""")
def queue_claims(spark, d):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey") % 4
    until = F.when(k == 1, F.to_timestamp(F.lit("2023-01-01 00:00:00"))).when(k > 1, F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    queue = _read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(s == "P", "QUEUED").when(s == "O", "RUNNING").otherwise("SUCCEEDED").alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 3).alias("attempt"), until.alias("lease_until"))
    return tickets.claimed(queue, 40, F.to_timestamp(F.lit("2024-01-01 00:00:00")))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS queued FROM orders")
def queue_depth(spark, d):
    return tickets.queue_depth(_read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING").alias("status")))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS draft_id, l_linenumber AS revision FROM lineitem), c AS (SELECT o_orderkey AS draft_id, o_orderkey % 2 = 0 AS blocked FROM orders WHERE o_orderkey % 3 = 0)
    SELECT draft_id, revision, 'READY_FOR_REVIEW' AS status FROM r UNION ALL SELECT c.draft_id, coalesce(max(revision), 0) + 1, CASE WHEN any_value(blocked) THEN 'BLOCKED' ELSE 'READY_FOR_REVIEW' END FROM c LEFT JOIN r ON r.draft_id = c.draft_id GROUP BY c.draft_id""")
def draft_revisions(spark, d):
    drafts = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("revision"), F.lit("READY_FOR_REVIEW").alias("status")).distinct()
    changes = _read(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("draft_id"), (F.col("o_orderkey") % 2 == 0).alias("blocked"))
    return tickets.saved_revisions(drafts, changes)


@query("SELECT l_orderkey AS draft_id, CASE WHEN bool_or(l_suppkey % 10 = 3) THEN 'INVALIDATED' ELSE 'READY_FOR_REVIEW' END AS status FROM lineitem GROUP BY l_orderkey")
def drafts_invalidated(spark, d):
    drafts = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("draft_id")).agg(F.collect_set("l_suppkey").alias("case_ids")).withColumn("status", F.lit("READY_FOR_REVIEW"))
    return tickets.invalidated(drafts, _read(spark, d, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("case_id"))).select("draft_id", "status")


@query("""WITH c AS (SELECT l_orderkey AS case_id, list_distinct(list(l_suppkey % 4)) AS t FROM lineitem GROUP BY 1), p AS (SELECT case_id, t, case_id - case_id % 4 AS pid FROM c)
    SELECT p.case_id, p.case_id = pid OR coalesce(len(list_intersect(p.t, c.t)) / len(list_distinct(list_concat(p.t, c.t))) >= 0.9, false) AS leaks FROM p LEFT JOIN c ON c.case_id = pid""")
def blind_case_leaks(spark, d):
    cases = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(F.col("l_suppkey") % 4).alias("terms"))
    return tickets.blind_leaks(cases.withColumn("profile_case_id", F.col("case_id") - F.col("case_id") % 4), cases)


@query("""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Start-Time' WHEN 1 THEN 'total_time' WHEN 2 THEN 'count' WHEN 3 THEN 'note' WHEN 4 THEN 'update_time' ELSE 'flag' END AS k,
      CASE event_id % 6 WHEN 0 THEN CAST(1700000000 + event_id AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN ' text ' WHEN 4 THEN 'never' ELSE 'True' END AS x FROM events)
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'duration' WHEN 2 THEN 'number' WHEN 3 THEN 'string' WHEN 4 THEN 'invalid_timestamp' ELSE 'boolean' END AS type,
      CASE event_id % 6 WHEN 0 THEN strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN event_id || '.0' WHEN 2 THEN event_id || '.0' WHEN 3 THEN 'text' WHEN 4 THEN NULL ELSE 'true' END AS normalized,
      CASE WHEN event_id % 6 = 0 THEN (1700000000 + event_id) * CASE WHEN event_id % 4 = 0 THEN 1000 ELSE 1 END END AS epoch FROM v""")
def deterministic_values(spark, d):
    i = F.col("event_id")
    at = lambda *values: F.element_at(F.array(*values), (i % 6 + 1).cast("int"))
    key, text = at(*map(F.lit, ("Start-Time", "total_time", "count", "note", "update_time", "flag"))), i.cast("string")
    value = at((F.lit(1700000000) + i).cast("string"), text, text, F.lit(" text "), F.lit("never"), F.lit("True"))
    got = _read(spark, d, "events").select("event_id", fm.det_value(key, value).alias("v"))
    sample = F.when(i % 4 == 0, 1_700_000_000_000).otherwise(1_700_000_000)
    return got.select("event_id", "v.type", "v.normalized", F.when(F.col("v.type") == "timestamp", fm.epoch_back(F.col("v.normalized"), sample)).alias("epoch"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, octet_length(encode(html)) > 64 AS cut, octet_length(encode(html))::INTEGER AS original_bytes, starts_with(html, coalesce(substr(html, 1, 16), '')) AS kept FROM pages""")
def hosts_and_cuts(spark, d):
    t = ft.truncated(F.col("html"), 64)
    host = ft.hostname(F.upper(F.concat(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1), F.lit(".:443"))))
    got = _read(spark, d, "pages").select("page_id", host.alias("host"), t.alias("t"), "html")
    return got.select("page_id", "host", "t.cut", "t.original_bytes", (F.startswith("html", F.col("t.text")) & (F.octet_length("t.text") > F.least(F.col("t.original_bytes"), F.lit(64)) - 4)).alias("kept"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, ('/data/' || l_orderkey || '/a~1b/' || l_linenumber) AS pointer, 'data|' || l_orderkey || '|a/b|' || l_linenumber AS parts, CASE WHEN l_linenumber = 1 THEN 4 ELSE 3 END AS common FROM lineitem""")
def pointer_algebra(spark, d):
    base = F.concat(F.lit("/data/"), F.col("l_orderkey"), F.lit("/"), fj.escape_pointer(F.lit("a/b")), F.lit("/"))
    rows = _read(spark, d, "lineitem").select(_card_id().alias("id"), F.concat(base, F.col("l_linenumber")).alias("pointer"), F.concat(base, F.lit("1")).alias("other"))
    return rows.select("id", "pointer", F.array_join(fj.pointer_parts(F.col("pointer")), "|").alias("parts"), fj.common_depth(F.col("pointer"), F.col("other")).alias("common"))


# Orders as change records: an id, a status, a step for each line, and a note.
_RECORD = """SELECT o_orderkey AS doc_id, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","steps":[' || steps || '],"note":"' || o_orderpriority || '"}' AS text, steps, n, o_orderkey, o_orderstatus, o_orderpriority FROM orders
    JOIN (SELECT l_orderkey, {joined} AS steps, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
_RECORD_DUCK = _RECORD.replace("{joined}", """string_agg('{"n":' || l_linenumber || '}', ',' ORDER BY l_linenumber)""")
_RECORD_SPARK = _RECORD.replace("{joined}", """array_join(transform(sort_array(collect_list(l_linenumber)), x -> '{"n":' || x || '}'), ',')""")


def _plan(spark, d):
    docs = tb.frame(spark, d, _RECORD_SPARK, "orders", "lineitem")
    roots = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i")).select("doc_id", F.concat(F.lit("/steps/"), "i").alias("pointer"))
    return docs, adapter.plan(docs, roots, 40)


@query(f"""WITH r AS ({_RECORD_DUCK}), a AS (SELECT doc_id, length(CAST(doc_id AS VARCHAR)) AS w, n, length(text) AS len, length(o_orderpriority) AS p FROM r),
    u AS (SELECT doc_id, 'CONTEXT' AS role, 1 AS s, 6 + w + 13 AS e, '/id,/status' AS pointers FROM a WHERE w + 18 <= 40
      UNION ALL SELECT doc_id, 'PROCEDURE_STEP', 6 + w + 13 + 10 + 8 * i, 6 + w + 13 + 10 + 8 * i + 7, '/steps/' || i FROM a, unnest(range(n)) AS t(i)
      UNION ALL SELECT doc_id, 'CONTEXT', len - p - 10, len - 1, '/note' FROM a)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS unit_index, role, s AS start, e AS "end", pointers FROM u""")
def extraction_plan(spark, d):
    return _plan(spark, d)[1].select("doc_id", "unit_index", "role", "start", "end", F.array_join("pointers", ",").alias("pointers"))


@query(f"SELECT doc_id, n AS steps, 2 AS context_units, round((length(CAST(doc_id AS VARCHAR)) + 18 + 7 * n + length(o_orderpriority) + 9) / length(text), 4) AS covered, true AS safe FROM ({_RECORD_DUCK})")
def extraction_report(spark, d):
    docs, planned = _plan(spark, d)
    return adapter.plan_report(planned, docs)


# Order lines as steps: what is set, checked, undone, repeated, empty, of an equal title, and long with six sections.
_STEPS = """SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS position, CASE l_linenumber WHEN 2 THEN 'VALIDATION' WHEN 3 THEN 'ROLLBACK' WHEN 4 THEN 'PRECHECK' WHEN 6 THEN 'ROLLBACK' ELSE 'IMPLEMENTATION' END AS phase,
    CASE l_linenumber WHEN 1 THEN 'set it' WHEN 2 THEN 'see it' WHEN 3 THEN 'same' WHEN 4 THEN 'again' WHEN 5 THEN ' ' WHEN 6 THEN 'same' ELSE 'long' END AS name,
    CASE l_linenumber WHEN 1 THEN 'set parameter max_conn 10 -> 20' WHEN 2 THEN 'check parameter max_conn == 20' WHEN 3 THEN 'restore parameter max_conn 20 -> 10' WHEN 4 THEN 'Set parameter max_conn 10 -> 20!' WHEN 5 THEN '' WHEN 6 THEN 'export the list of hosts before it'
      ELSE """ + " || chr(10) || ".join(f"'{k}. part {k}' || chr(10) || 'check ' || repeat('{c}', 130)" for k, c in enumerate("abcde", 1)) + """ || chr(10) || '6. rest' || chr(10) || '无影响' END AS operation FROM lineitem"""


def _built(spark, d):
    # Lines are spread by order as narrow as they are; to drop repeated steps then needs no shuffle of their texts.
    spread(_read(spark, d, "lineitem"), "l_orderkey").createOrReplaceTempView("lineitem")
    source = spark.sql(_STEPS)
    return source, cards.canonical_cards(cards.step_cards(source, long_chars=600, child_chars=100), steps_of=source)


def _facts(spark, d):
    o, k = _read(spark, d, "orders"), F.col("o_orderkey")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    fields = F.array(pair("title", F.when(k % 4 == 0, " ").otherwise(F.col("o_orderpriority"))), pair("ticket_id", F.when(k % 2 == 0, F.concat(F.lit("T"), k))), pair("region", F.lit("r1")))
    results = F.array(pair("status", F.lit("done")), pair("verified_note", F.when(k % 5 == 0, "seen")), pair("change_result", F.lit(" ")))
    contexts = o.filter(k % 3 != 0).select(k.alias("case_id"), F.inline(fields))
    return cards.context_cards(contexts), cards.outcome_cards(o.filter("o_orderstatus = 'F'").select(k.alias("case_id"), F.inline(results)))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS n FROM lineitem WHERE l_linenumber <> 5), g AS (SELECT c, bool_or(n = 1) AS one, bool_or(n = 3) AND bool_or(n = 6) AS twice FROM l GROUP BY c),
    s AS (SELECT l.*, unnest(CASE WHEN n = 7 THEN [-1, 0, 1, 2, 3, 4] ELSE [-1] END) AS section FROM l)
    SELECT c AS case_id, n AS position, section, CASE n WHEN 1 THEN '实施：set it' WHEN 2 THEN '验证：see it' WHEN 4 THEN '前检：again' WHEN 7 THEN '实施：long' || CASE WHEN section >= 0 THEN ' · part ' || (section + 1) ELSE '' END
      ELSE '回退：same' || CASE WHEN NOT twice THEN '' WHEN n = 3 THEN ' · parametermaxconn' ELSE ' · export the list of hosts bef' END END AS title,
      CASE WHEN n = 7 AND section < 0 THEN 'CONTAINER' ELSE 'INDEXED' END AS publish_status, n = 4 AND one AS reused, section >= 0 AS child FROM s JOIN g USING (c)""")
def step_card_build(spark, d):
    got = _built(spark, d)[1]
    return got.select("case_id", "position", "section", "title", "publish_status", (F.col("canonical_id") != F.col("unit_id")).alias("reused"), F.col("parent_unit_id").isNotNull().alias("child"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS n FROM lineitem), g AS (SELECT c, count(*) AS k, count(*) FILTER (WHERE n = 5) AS p5, count(*) FILTER (WHERE n = 7) AS p7, count(*) FILTER (WHERE n = 1) AS p1,
      count(*) FILTER (WHERE n = 2) AS p2, count(*) FILTER (WHERE n = 3) AS p3, count(*) FILTER (WHERE n = 4) AS p4 FROM l GROUP BY c)
    SELECT c AS case_id, k AS source_steps, k - p5 - p4 * p1 AS parents, 5 * p7 AS children, k - p5 - p4 * p1 + 4 * p7 AS indexed, p7 AS containers, p4 * p1 AS reused, p7 AS noop_sections, 0 AS title_collisions, 0 AS parent_child_collisions,
      p1 * p2 AS validates, p1 * p3 AS rollbacks, CASE WHEN c % 3 <> 0 THEN 1 ELSE 0 END AS contexts, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcomes, p5 AS skipped, round((k - p5) / k, 6) AS coverage FROM g JOIN orders ON o_orderkey = c""")
def card_build_report(spark, d):
    source, built = _built(spark, d)
    return cards.build_report(source, built, *_facts(spark, d))


@query("""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 <> 0 THEN coalesce(nullif(concat_ws(' · ', CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN 'T' || o_orderkey END), ''), CAST(o_orderkey AS VARCHAR)) END AS title,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'EXECUTION_CONTEXT' END AS region_role, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'seen' ELSE 'done' END END AS summary FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderstatus = 'F'""")
def context_outcome_cards(spark, d):
    contexts, outcomes = _facts(spark, d)
    both = contexts.join(outcomes.select("case_id", "summary"), "case_id", "full")
    return both.select("case_id", "title", F.get(F.filter("context", lambda x: x["name"] == "region"), F.lit(0))["role"].alias("region_role"), "summary")


# Customers as change records: their orders are the tasks, again grouped in two; some views differ, lack a part, or are
# there twice, some have other names. The SQL counts what a record must give, without reading its JSON.
def _tasks(name, order, changed):
    fields = " || ".join([f"""'{{"t00":"' || o_orderkey || '","t01":"' || o_orderstatus || '","t02":"' || {changed} || '"'""", *(f"""',"t{i:02}":{"null" if i == 12 else i}'""" for i in range(3, 13)), "'}'"])
    return f"coalesce(array_join(transform(sort_array(collect_list(CASE WHEN {name} THEN struct(o_orderkey AS k, {fields} AS x) END)), s -> s.x), ','), '')"


_STEP = "'{' || '" + ",".join(f'"s{i:02}":"' + ("' || c_custkey || '" if i == 0 else str(i)) + '"' for i in range(20)) + "}'"
_RESULT = '{"result":{' + ",".join(f'"r{i:02}":{i}' for i in range(14)) + ',"items":["x"]}}'
_CHANGES = f"""WITH o AS (SELECT c_custkey, o_orderkey, o_orderstatus, max(o_orderkey) OVER (PARTITION BY c_custkey) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
    t AS (SELECT c_custkey, c_custkey % 6 AS v, {_tasks("true", "o_orderkey", "'same'")} AS flat, {_tasks("o_orderkey % 2 = 0", "o_orderkey", "CASE WHEN c_custkey % 6 = 2 AND o_orderkey = last THEN 'other' ELSE 'same' END")} AS even,
      {_tasks("o_orderkey % 2 = 1", "o_orderkey", "CASE WHEN c_custkey % 6 = 2 AND o_orderkey = last THEN 'other' ELSE 'same' END")} AS odd, {_STEP} AS step FROM o GROUP BY c_custkey)
    SELECT c_custkey AS doc_id, '{{"code":0,"data":{{"ticket_id":"' || c_custkey || '","region":' || CASE WHEN c_custkey % 4 = 0 THEN '5' ELSE '"r1"' END || ',"meta":{{"a":[],"b":""}},' || CASE WHEN v < 3 OR v = 4 THEN '"action_list":[' || flat || '],"change_tool_relate_action"' ELSE '"tasks":[' || flat || '],"grouped"' END
      || ':{{"a":[' || even || '],"b":[' || odd || ']}},' || CASE WHEN v = 5 THEN '"again":[' || flat || '],' ELSE '' END || CASE WHEN v < 3 OR v = 4 THEN '"sop_change_step":{{"check_before_change":[' ELSE '"steps":{{"w":[' END || step
      || CASE WHEN v < 3 OR v = 4 THEN '],"change_implement":[' ELSE '],"x":[' END || step || ',' || step || CASE WHEN v < 3 OR v = 4 THEN '],"change_verified":[' ELSE '],"y":[' END || step || CASE WHEN v < 3 OR v = 4 THEN '],"change_rollback":[' ELSE '],"z":[' END || step || ']}}'
      || CASE WHEN v = 4 THEN '' ELSE ',"' || CASE WHEN v < 3 THEN 'change_plan' ELSE 'plan' END || '":[{_RESULT}]' END || '}}}}' AS text FROM t"""

_CHANGES_DUCK = """o AS (SELECT c_custkey AS c, c_custkey % 6 AS v, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
    m AS (SELECT *, n > 0 AND v <= 3 AS mapped, n - CASE WHEN v = 2 THEN 1 ELSE 0 END AS matched FROM o)"""


def _extraction(spark, d):
    return discovery.extraction(tb.frame(spark, d, _CHANGES, "customer", "orders"), 100_000)


@query(f"""WITH {_CHANGES_DUCK}, s AS (SELECT *, 9 + 13 * n + 100 + 15 + CASE WHEN v = 2 THEN 13 * n - 4 ELSE 0 END AS x FROM m)
    SELECT c AS doc_id, CASE WHEN mapped THEN CASE WHEN v = 3 THEN 'HEURISTIC' ELSE 'CONFIRMED' END WHEN v < 3 OR v = 4 THEN 'CONFLICT' ELSE 'UNKNOWN' END AS status, mapped, n > 0 OR v <> 5 AS possible,
      CASE WHEN mapped THEN CASE WHEN v = 3 THEN '/data/tasks' ELSE '/data/action_list' END END AS tasks, CASE WHEN mapped THEN CASE WHEN v = 3 THEN '/data/plan/0/result' ELSE '/data/change_plan/0/result' END END AS result,
      CASE WHEN mapped THEN a || ',' || b END AS group_sizes, CASE WHEN mapped THEN n END AS flat_count, CASE WHEN mapped THEN n END AS grouped_count, CASE WHEN mapped THEN matched END AS matched, CASE WHEN mapped THEN matched = n END AS reconciled,
      CASE WHEN mapped THEN CASE WHEN matched = n THEN '' ELSE 'VIEWS_NOT_RECONCILED' END WHEN v = 4 THEN 'MISSING /data/change_plan/0/result' WHEN v < 3 THEN 'TASKS_SHAPE,GROUPS_SHAPE' WHEN n = 0 THEN 'NO_TASK_VIEWS' ELSE 'TASK_VIEWS_AMBIGUOUS' END AS blockers,
      CASE WHEN mapped THEN 1 END AS scalars_envelope, CASE WHEN mapped AND matched = n THEN 13 * n WHEN mapped THEN 0 END AS scalars_duplicate, CASE WHEN mapped THEN 19 + 100 + 13 * n + CASE WHEN matched = n THEN 0 ELSE 13 * n END - 1 END AS scalars_assigned,
      CASE WHEN mapped THEN 2 * n END AS null_nodes, CASE WHEN mapped THEN 1.0 END::DOUBLE AS node_ratio, mapped AND matched = n AS safe FROM s""")
def change_record_report(spark, d):
    got = _extraction(spark, d)[1]
    return got.select("doc_id", "status", "mapped", "possible", "tasks", "result", F.array_join("group_sizes", ",").alias("group_sizes"), "flat_count", "grouped_count", "matched", "reconciled", F.array_join("blockers", ",").alias("blockers"), "scalars_envelope", "scalars_duplicate", "scalars_assigned", "null_nodes", "node_ratio", "safe")


@query(f"""WITH {_CHANGES_DUCK}, u AS (SELECT c, unnest(CASE WHEN v = 3 THEN [('TASKS_CANONICAL', 1, n), ('UNMAPPED_PROCEDURE_STEPS', 5, 5), ('EXECUTION_RESULT', 1, 15), ('IDENTITY_METADATA_CONTEXT', 1, 3)]
      ELSE [('TASKS_CANONICAL', 1, n), ('TASKS_GROUPED_UNRECONCILED', CASE WHEN v = 2 THEN (a > 0)::INT + (b > 0)::INT ELSE 0 END, n), ('PRECHECK_STEPS', 1, 1), ('IMPLEMENTATION_STEPS', 2, 2), ('VALIDATION_STEPS', 1, 1), ('ROLLBACK_STEPS', 1, 1), ('EXECUTION_RESULT', 1, 15), ('IDENTITY_METADATA_CONTEXT', 1, 3)] END) AS r FROM m WHERE mapped)
    SELECT c AS doc_id, r[1] AS role, r[2] AS units, r[3] AS nodes FROM u WHERE r[2] > 0""")
def change_record_units(spark, d):
    return _extraction(spark, d)[0].groupBy("doc_id", "role").agg(F.count("*").alias("units"), F.sum(F.size("pointers")).alias("nodes"))


@query(f"""WITH {_CHANGES_DUCK}, k AS (SELECT c, min(c) OVER (PARTITION BY c % 4 = 0) AS profile_id, c % 4 = 0 AS numeric FROM m WHERE mapped AND v < 3)
    SELECT c AS doc_id, unnest(['task_fields', 'procedure_fields', 'execution_fields', 'context_fields', 'envelope_fields']) AS section, unnest([13, 20, 15, 3, 1]) AS fields,
      unnest(['integer:9,null:1,string:3', 'string:20', 'array:1,integer:14', CASE WHEN numeric THEN 'integer:1,object:1,string:1' ELSE 'object:1,string:2' END, 'integer:1']) AS types, profile_id, '' AS errors FROM k""")
def change_record_profiles(spark, d):
    docs = tb.frame(spark, d, _CHANGES, "customer", "orders")
    nodes = Table(discovery.structure(docs, members_of=profiles.members_of()), "json-nodes").df
    found = Table(discovery.discover(docs, nodes), "json-found").df
    mine = Table(profiles.profiles(nodes, found), "profiles").df
    kept = profiles.signature(mine).groupBy("profile_signature").agg(F.min("doc_id").alias("profile_id")).select("profile_id")
    stored = mine.join(kept, F.col("doc_id") == F.col("profile_id")).drop("doc_id")
    types = mine.groupBy("doc_id", "section", "json_type").count().groupBy("doc_id", "section").agg(F.sum("count").cast("int").alias("fields"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "json_type", "count"))), ",").alias("types"))
    errors = profiles.checked(mine).select("doc_id", F.array_join("errors", ",").alias("errors"))
    return types.join(merged(profiles.compatible(mine, stored)), "doc_id", "left").join(merged(errors), "doc_id")


@query("""SELECT conv_id AS doc_id, '{"conv_id":' || conv_id || ',"turns":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '","text":{"redacted":true,"length":' || length(text) || ',"sha256":"' || sha256(text) || '"},"auth":{"api_key":"[REDACTED]","notes":["Bearer [REDACTED]",' || turn || ']}}', ',' ORDER BY turn, role, text) || ']}' AS text
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id""")
def nested_redaction(spark, d):
    turn = F.struct("turn", "role", "text")
    auth = lambda t: F.struct(F.struct(t["role"].alias("user"), t["turn"].alias("n")).alias("api_key"), F.array(F.concat(F.lit('"Bearer abcdefgh.'), t["turn"], F.lit('"')), t["turn"].cast("string")).alias("notes"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), auth(t).alias("auth")))
    docs = _read(spark, d, "conversations").filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").alias("doc_id")).agg(turns.alias("turns"))
    docs = docs.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("conv_id"), "turns")).alias("text"))
    # The notes become a mixed array: a quoted text and a number.
    docs = docs.withColumn("text", F.regexp_replace("text", r'"notes":\["\\"(Bearer abcdefgh\.\d+)\\"","(\d+)"\]', r'"notes":["$1",$2]'))
    return rewrite.redacted(docs, Table(adapter.nodes(docs, columns=("scalar", "name", "type")), "json-nodes").df)


@query("""SELECT event_id AS doc_id, '{"Start-Time":{"raw":' || (1700000000 + event_id) || ',"normalized":"' || strftime((to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC') + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || '","timezone":"Asia/Shanghai","iso8601":"' || strftime((to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC') + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S')
    || '+08:00"},"in": {"total_time":[{"raw":' || event_id || ',"normalized":' || event_id || ',"unit":"seconds"},{"raw":1.0,"normalized":1,"unit":"seconds"}],"flag":{"raw":true,"normalized":true,"type":"boolean"},"kind":"' || event_type || '","n":{"raw":' || user_id || ',"normalized":' || user_id || ',"type":"number"},"at_end_time":{"raw":"' || event_type || '","normalization_error":"INVALID_TIMESTAMP"},"none":null}}' AS text,
    CAST(event_id AS VARCHAR) AS second FROM events""")
def normalised_values(spark, d):
    text = """concat('{"Start-Time":', 1700000000 + event_id, ',"in": {"total_time":[', event_id, ',1.0],"flag":true,"kind":" ', event_type, '\\\\t","n":', user_id, ',"at_end_time":"', event_type, '","none":null}}')"""
    docs = _read(spark, d, "events").selectExpr("event_id AS doc_id", f"{text} AS text")
    nodes = Table(adapter.nodes(docs, columns=("scalar", "name", "type")), "json-nodes").df
    found = rewrite.resolved(docs.select("doc_id", F.lit("/in/total_time/0").alias("pointer")), docs, nodes).select("doc_id", F.col("value").alias("second"))
    return rewrite.normalised(docs, nodes).join(found, "doc_id")
