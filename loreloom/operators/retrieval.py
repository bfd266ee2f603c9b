"""Fielded lexical retrieval, relevance gate, two-channel trusted search and case recommendation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..tables import Table, small_batches, spread
from .joins import containing, small

# Field weights.
FIELD_WEIGHTS = {
    "title": 5.0,
    "summary": 3.0,
    "scenario": 2.5,
    "object_name": 3.0,
    "applicable_versions": 3.0,
    "keywords": 3.5,
    "prerequisites": 1.5,
    "procedure_steps": 1.5,
    "risks": 1.5,
    "rollback_steps": 1.2,
    "validation_steps": 1.2,
}
TITLE_BOOST, OBJECT_BOOST = 12.0, 6.0
#: Cards whose terms, or whose scores for all queries, one task counts.
TASK_CARDS = 4096
# What a question is about, by its cues, and the card fields that must then be filled.
INTENTS = {
    "rollback": (["回退", "撤销", "恢复", "还原", "回滚", "失败", "出问题"], ["rollback_steps"]),
    "validation": (["验证", "确认", "检查", "观测", "成功率", "丢包", "时延", "健康"], ["validation_steps"]),
    "sequence": (["顺序", "先后", "阶段", "波次", "灰度", "逐批", "分批", "哪边", "开始"], ["procedure_steps", "rollback_steps"]),
    "execution": (["迁移", "切换", "替换", "挪走", "换通道", "操作", "执行"], ["procedure_steps"]),
    "prerequisite": (["前置", "条件", "准备", "容量"], ["prerequisites"]),
    "risk": (["风险", "影响", "故障", "中断"], ["risks"]),
}
OBJECTS = {
    "route": ["路由", "下一跳", "cidr"],
    "nat": ["nat", "出口", "egress"],
    "vpn": ["vpn", "隧道", "合作方", "合作伙伴"],
    "dns": ["dns", "解析", "域名"],
    "firewall": ["防火墙", "firewall", "服务链"],
    "kubernetes": ["kubernetes", "k8s", "容器", "集群"],
    "private_endpoint": ["privatelink", "私网终端", "私有入口", "终端节点"],
    "link": ["专线", "链路", "通道"],
    "database": ["数据库", "mysql", "postgresql", "主从", "索引"],
    "certificate": ["证书", "tls", "certificate", "密钥轮换"],
    "identity": ["账号", "权限", "iam", "用户授权", "登录"],
}
GENERIC_TERMS = ["回退", "失败", "切换", "变更", "验证", "步骤", "操作", "问题", "异常", "开始", "如何", "怎么"]


def publishable(cards: DataFrame) -> DataFrame:
    """Cards that may be found: not SKIPPED (null counts as CANDIDATE) and retrieval not switched off (null passes)."""
    return cards.filter((F.upper(F.coalesce("publish_status", F.lit("CANDIDATE"))) != "SKIPPED") & ~F.col("retrieval_enabled").eqNullSafe(False))


def _flat(cards: DataFrame, field: str) -> Column:
    return F.array_join(field, " ") if dict(cards.dtypes)[field].startswith("array") else F.coalesce(F.col(field).cast("string"), F.lit(""))


def _fields(cards: DataFrame) -> list[str]:
    return [f for f in FIELD_WEIGHTS if f in cards.columns]


def _by_card(rows: DataFrame, cards: int) -> DataFrame:
    """rows(id, ...) spread by card, TASK_CARDS of so many cards to a task: what is counted in a card is not shuffled again."""
    return spread(rows, "id", least=-(-cards // TASK_CARDS))


def term_frequency(cards: DataFrame) -> DataFrame:
    """(id, field, term, tf) of the weighted fields that cards has; lists are read as one text.

    Texts are shuffled, not their terms, which are many times as long.
    """
    texts = F.array(*(F.struct(F.lit(f).alias("field"), _flat(cards, f).alias("text")) for f in _fields(cards)))
    placed = _by_card(cards.select("id", texts.alias("fields")), cards.count())
    rows = placed.select("id", F.explode("fields").alias("f")).select("id", "f.field", F.explode(tokenize(F.col("f.text"))).alias("term"))
    return rows.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(term, df): cards that hold a term in any field."""
    return postings.select("id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def card_terms(cards: DataFrame) -> DataFrame:
    """(id, term, weight): how much a term weighs in a card, over its fields, before the term's rarity."""
    weights = F.create_map(*(F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv))
    return term_frequency(cards).groupBy("id", "term").agg(F.sum(weights[F.col("field")] * (1 + F.log("tf"))).alias("weight"))


def kept_index(cards: DataFrame) -> Table:
    """card_terms of the publishable cards, written once, for many searches."""
    return Table(card_terms(publishable(cards)), "card-terms")


def updated_index(index: Table, changed: DataFrame, gone: DataFrame) -> Table:
    """The index after cards changed (new ones, too) and ids went; only these cards are tokenized. The old one goes."""
    stale = gone.select("id").unionByName(changed.select("id")).distinct()
    after = Table(index.df.join(stale, "id", "left_anti").unionByName(card_terms(publishable(changed))), "card-terms")
    index.drop()
    return after


def search(cards: DataFrame, queries: DataFrame, *, top_k: int = 6, min_score: float = 0.0, min_coverage: float = 0.0, index: Table | None = None) -> DataFrame:
    """(query_id, rank, id, score, query_coverage, matched_terms) for stated queries(query_id, query).

    index: kept_index of the same cards; without one, cards are tokenized once and only the terms asked for are kept.
    Every query is matched in one pass: a card's terms are joined to all queries' terms, which are broadcast if they are
    few, and the terms that matched are read off the same rows. A query in a title, or an object's name in a query, is
    found by equal runs of characters. Scores count cards after the publishable filter. A query that stands in a title,
    or that names a card's object, gains a boost even without a matched term.
    """
    cards = publishable(cards)
    terms = Table(queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "query-terms").df
    sizes = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    asked_terms = small(terms.select("term").distinct())
    if index is None:  # terms that nobody asks for are dropped before cards' rows are summed
        weights = F.create_map(*(F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv))
        wanted = term_frequency(cards).join(asked_terms, "term", "left_semi").groupBy("id", "term").agg(F.sum(weights[F.col("field")] * (1 + F.log("tf"))).alias("weight"))
        wanted = Table(wanted, "wanted-terms").df
    else:
        wanted = index.df.join(asked_terms, "term", "left_semi")
    n = cards.count()
    idf = wanted.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 0.5)) + 1).alias("idf"))
    asked_terms = terms.join(idf, "term").select("query_id", "term", (F.col("idf") * (1 + F.log("qtf"))).alias("asked"))
    # A card's scores are summed where its terms are; only each task's best hits go on to the ranking.
    lexical = _by_card(wanted, n).join(small(asked_terms), "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("asked")).alias("score"), F.count("*").alias("matched"))
    asked = queries.join(sizes, "query_id").select("query_id", F.trim(F.lower("query")).alias("q"))
    title, name = (F.lower(F.coalesce(F.col(c), F.lit(""))) if c in cards.columns else F.lit("") for c in ("title", "object_name"))
    titled = containing(cards.select("id", title.alias("t")), asked, "t", "q").select("query_id", "id", F.lit(TITLE_BOOST).alias("boost"))
    objects = cards.select("id", name.alias("o")).filter("o != ''")
    naming = containing(asked, objects.select("o").distinct(), "q", "o").join(objects, "o").select("query_id", "id", F.lit(OBJECT_BOOST).alias("boost"))
    boosts = _by_card(titled.unionByName(naming).select("query_id", "id", F.col("boost").alias("score"), F.lit(0).cast("long").alias("matched")), n)
    hits = lexical.unionByName(boosts).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.sum("matched").alias("matched")).join(small(sizes), "query_id")
    hits = hits.select("query_id", "id", "score", (F.col("matched") / F.col("n_terms")).alias("query_coverage"))
    hits = hits.filter((F.col("score") > 0) & (F.col("score") >= max(0.0, min_score)) & (F.col("query_coverage") >= max(0.0, min(1.0, min_coverage))))
    found = Table(top_hits(hits, top_k), "search-hits").df
    held = found.select("query_id", "id").join(wanted.select("id", "term"), "id").join(terms.select("query_id", "term"), ["query_id", "term"])
    held = held.groupBy("query_id", "id").agg(F.array_sort(F.collect_set("term")).alias("matched_terms"))
    return found.join(held, ["query_id", "id"], "left").withColumn("matched_terms", F.coalesce("matched_terms", F.array().cast("array<string>")))


#: What a draft is compared by, and the statuses of cards that it is compared with.
COMPARED_FIELDS = ("title", "summary", "scenario", "object_name", "applicable_versions", "keywords")
COMPARED_STATUSES = ("DRAFT", "PENDING_REVIEW", "APPROVED", "SUPERSEDED")


def compared(drafts: DataFrame, cards: DataFrame, decide, *, top_k: int = 5, min_score: float = 0.0, min_coverage: float = 0.0, index: Table | None = None) -> DataFrame:
    """(draft_id, candidates, relation, related_ids, reason): what a plug-in makes of each draft and its candidates.

    drafts: draft_id and fields of cards. Candidates are the top_k hits of the draft's fields among cards of the compared
    statuses. decide(pandas batch with draft_id, query and candidates) gives a frame of relation, related_ids and reason,
    row by row; ids that are no candidates are left out, and a relation without an id becomes NEW. Drafts without a
    candidate are not asked about. index: kept_index of these cards.
    """
    live = cards.filter(F.col("status").isin(*COMPARED_STATUSES))
    query = F.concat_ws(" ", *(_flat(drafts, f) for f in COMPARED_FIELDS if f in drafts.columns))
    asked = drafts.select(F.col("draft_id").alias("query_id"), query.alias("query"))
    hits = search(live, asked, top_k=top_k, min_score=min_score, min_coverage=min_coverage, index=index)
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c")).select("query_id", F.transform("c", lambda x: x["id"]).alias("candidates"))
    rows = found.join(asked, "query_id").select(F.col("query_id").alias("draft_id"), "query", "candidates")
    kind, id_type = dict(drafts.dtypes)["draft_id"], dict(cards.dtypes)["id"]

    def run(batches):
        for pdf in batches:
            got = decide(pdf).reset_index(drop=True)
            yield pdf[["draft_id", "candidates"]].reset_index(drop=True).assign(relation=got["relation"], related_ids=got["related_ids"], reason=got["reason"])

    told = rows.mapInPandas(run, f"draft_id {kind}, candidates array<{id_type}>, relation string, related_ids array<{id_type}>, reason string")
    told = told.withColumn("related_ids", F.array_intersect(F.coalesce("related_ids", F.array().cast(f"array<{id_type}>")), "candidates"))
    told = told.withColumn("relation", F.when((F.size("related_ids") == 0) | F.col("relation").isNull(), "NEW").otherwise(F.upper("relation")))
    none = drafts.select("draft_id").join(told.select("draft_id"), "draft_id", "left_anti")
    empty = F.array().cast(f"array<{id_type}>")
    return told.unionByName(none.select("draft_id", empty.alias("candidates"), F.lit("NEW").alias("relation"), empty.alias("related_ids"), F.lit("").alias("reason")))


def top_hits(hits: DataFrame, top_k: int) -> DataFrame:
    """The best hits of each query: by score, then by larger id. Sums differ in their last bits from run to run, so scores compare to 9 places."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("id")))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= max(1, top_k))


def gate(cards: DataFrame, query: str | Column, *, minimum_anchors: int = 2) -> DataFrame:
    """cards with accepted, anchor_count, lexical_terms, intent_anchors, object_anchors and unmatched_object_groups.

    A card is relevant if shared terms (three at most count), intents whose fields it fills and objects it names reach
    the minimum, and if it names every object group that the query names.
    """
    q = F.lower(F.lit(query) if isinstance(query, str) else query)
    text = F.lower(F.concat_ws(" ", *(_flat(cards, f) for f in _fields(cards))))
    has = lambda where, cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(where, c))
    filled = lambda f: (F.size(f) > 0 if dict(cards.dtypes)[f].startswith("array") else F.length(F.coalesce(F.col(f), F.lit(""))) > 0) if f in cards.columns else F.lit(False)
    names = lambda pairs: F.filter(F.array(*(F.when(c, n) for n, c in pairs)), lambda x: x.isNotNull())
    any_filled = lambda fields: F.greatest(*(filled(f) for f in fields), F.lit(False))
    lexical = F.array_except(F.array_sort(F.array_intersect(tokenize(q), tokenize(text))), F.array(*map(F.lit, GENERIC_TERMS)))
    got = cards.withColumn("lexical_terms", F.sort_array(lexical)).withColumn("intent_anchors", names((n, has(q, cues) & any_filled(fields)) for n, (cues, fields) in INTENTS.items()))
    got = got.withColumn("query_object_groups", names((n, has(q, cues)) for n, cues in OBJECTS.items())).withColumn("object_anchors", names((n, has(q, cues) & has(text, cues)) for n, cues in OBJECTS.items()))
    got = got.withColumn("anchor_count", F.least(F.size("lexical_terms"), F.lit(3)) + F.size("intent_anchors") + F.size("object_anchors"))
    got = got.withColumn("unmatched_object_groups", F.sort_array(F.array_except("query_object_groups", "object_anchors")))
    return got.withColumn("accepted", (F.col("anchor_count") >= max(1, minimum_anchors)) & (F.size("unmatched_object_groups") == 0))


def trusted(lexical: DataFrame, recalled: DataFrame, cards: DataFrame, *, top_k: int = 6) -> DataFrame:
    """Gated lexical hits (query_id, id, score, accepted); queries without any take their best gated semantic hit.

    Both channels pass the same filter: only APPROVED, publishable cards. Columns: query_id, id, score, channel, rank.
    """
    live = publishable(cards).filter("status = 'APPROVED'").select("id")
    ok = lexical.filter("accepted").join(live, "id", "left_semi").select("query_id", "id", "score", F.lit("lexical").alias("channel"))
    other = recalled.filter("accepted").join(live, "id", "left_semi").join(ok.select("query_id").distinct(), "query_id", "left_anti")
    best = top_hits(other.select("query_id", "id", "score", F.lit("semantic").alias("channel")), 1)
    return top_hits(ok, top_k).unionByName(best)


def union_channels(*channels: DataFrame) -> DataFrame:
    """Hits (query_id, id, score) of several channels, each id once with its best score."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def case_scores(hits: DataFrame, lineage: DataFrame) -> DataFrame:
    """(query_id, case_id, score, card_ids, matched_roles): each case gains its hits' scores and 1 - 0.01 per rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
    ranked = hits.withColumn("place", F.row_number().over(order) - 1).join(lineage.select(F.col("card_id").alias("id"), "case_id", "unit_role"), "id").filter("case_id IS NOT NULL AND case_id != ''")
    entry = F.sort_array(F.collect_list(F.struct("place", "id", "unit_role")))
    gain = F.col("score") + F.greatest(F.lit(0.0), 1 - F.col("place") * 0.01)
    got = ranked.groupBy("query_id", "case_id").agg(F.sum(gain).alias("score"), entry.alias("e"))
    roles = F.array_distinct(F.filter(F.transform("e", lambda x: x["unit_role"]), lambda r: F.length(r) > 0))
    return got.select("query_id", "case_id", "score", F.transform("e", lambda x: x["id"]).alias("card_ids"), roles.alias("matched_roles"))


def recommend(scores: DataFrame, eligible: DataFrame, *, limit: int = 3) -> DataFrame:
    """The best eligible cases of each query, three at most, ties by case id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 4)), "case_id"))
    return scores.join(eligible.select("case_id"), "case_id", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= max(1, min(limit, 3)))


#: Vectors and queries that meet in one task, and queries of one matrix product.
CELL_VECTORS, CELL_QUERIES, CELL_PRODUCT = 8192, 4096, 256


def _cell_best(vectors: pa.Table, queries: pa.Table, top_k: int) -> tuple[list[int], list[int], list[float | None]]:
    """(place of the query, place of the vector, cosine) of each query's top_k vectors of its own length in a cell."""
    out: tuple[list, list, list] = ([], [], [])
    held, asked = vectors.column("embedding").to_pylist(), queries.column("asked").to_pylist()
    ids = np.array(vectors.column("vec_id").to_pylist())
    rows = lambda vs, size: np.array([k for k, v in enumerate(vs) if v is not None and len(v) == size], dtype=np.int64)
    matrix = lambda vs, at, size: np.array([[np.nan if x is None else x for x in vs[k]] for k in at], dtype=np.float64).reshape(len(at), size)
    for size in {len(q) for q in asked if q is not None}:
        at, mine = rows(held, size), rows(asked, size)
        if not len(at):
            continue
        with np.errstate(all="ignore"):
            x, q = matrix(held, at, size), matrix(asked, mine, size)
            n, m = (np.sqrt((v * v).sum(axis=1)) for v in (x, q))
            for i in range(0, len(mine), CELL_PRODUCT):
                like = (q[i : i + CELL_PRODUCT] @ x.T) / (m[i : i + CELL_PRODUCT, None] * n[None, :])
                order = np.where(np.isnan(like), -np.inf, np.round(like, 9))
                for j, (row, rounded) in enumerate(zip(like, order)):
                    k = min(top_k, len(at))
                    least = np.partition(rounded, len(at) - k)[len(at) - k]
                    near = np.flatnonzero(rounded >= least)
                    near = near[np.lexsort((ids[at[near]], -rounded[near]))][:k]
                    out[0].extend([int(mine[i + j])] * len(near))
                    out[1].extend(at[near].tolist())
                    out[2].extend(None if np.isnan(s) else float(s) for s in row[near])
    return out


def semantic_recall(vectors: DataFrame, queries: DataFrame, *, top_k: int = 5) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the nearest vectors by cosine, at nine decimals, to stated query vectors.

    All queries meet all vectors of their length: both are cut into blocks by a hash of their ids, and a task compares a
    block of each by matrix products in double precision and keeps top_k vectors a query. A vector without a direction
    (zero, or with a null) has a null likeness and comes last; null vectors are not compared.
    """
    small_batches(vectors.sparkSession)
    kind, asked_kind = vectors.schema["vec_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    parts, asked_parts = max(1, -(-vectors.count() // CELL_VECTORS)), max(1, -(-queries.count() // CELL_QUERIES))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select("vec_id", "embedding", part("vec_id", parts).alias("part")).select("*", upto(asked_parts).alias("asked_part"))
    asked = queries.select("query_id", F.col("embedding").alias("asked"), part("query_id", asked_parts).alias("asked_part")).select("*", upto(parts).alias("part"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, like = _cell_best(left, right, top_k)
        return pa.table({"query_id": right.column("query_id").take(pa.array(i, pa.int64())), "vec_id": left.column("vec_id").take(pa.array(j, pa.int64())), "similarity": pa.array(like, pa.float64())})

    cell = ["part", "asked_part"]
    found = held.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(best, f"query_id {asked_kind}, vec_id {kind}, similarity double")
    order = [F.round("similarity", 9).desc_nulls_last(), F.col("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= top_k)
