"""Views over cards, documents, chunks, lineage and cases: joins, pages, set checks, evidence, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_status(cards: DataFrame, status: str | None = None) -> DataFrame:
    """cards of a status, whatever its case; all of them where none is asked for."""
    return cards if not status else cards.filter(F.col("status") == status.upper())


def decoded(cards: DataFrame, payload: str, schema: T.StructType | str) -> DataFrame:
    """cards with the keys of a JSON column as typed columns; what does not fit is null."""
    return cards.withColumn("_decoded", F.from_json(payload, schema)).select("*", "_decoded.*").drop("_decoded")


def card_sources(cards: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """cards(document_id, chunk_id, ...) with the columns of their document and chunk."""
    return cards.join(documents, "document_id").join(chunks, "chunk_id")


def case_cards(lineage: DataFrame, cards: DataFrame, documents: DataFrame) -> DataFrame:
    """lineage(case_id, card_id, source_order) with cards(card_id, document_id, ...) and documents, numbered in each case."""
    got = lineage.join(cards, "card_id").join(documents, "document_id")
    return got.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("source_order", "card_id")))


def case_documents(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """cases(document_id, ...) with the columns of their document."""
    return cases.join(documents, "document_id")


def titled_relations(relations: DataFrame, cards: DataFrame) -> DataFrame:
    """relations with the related card's title, ranked in each card by confidence, then by related id."""
    got = relations.join(cards.select(F.col("id").alias("related_card_id"), "title"), "related_card_id")
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("card_id").orderBy(F.desc("confidence"), "related_card_id")))


def preferred(cards: DataFrame, key: str = "fingerprint") -> DataFrame:
    """One card of each key: an approved one before others, then the smallest id."""
    best = F.min(F.struct((F.col("status") != "APPROVED").alias("other"), "id", "status"))
    return cards.groupBy(key).agg(best.alias("b")).select(key, "b.id", "b.status")


def case_page(cases: DataFrame, status: str | None, *, limit: int, offset: int = 0) -> DataFrame:
    """A page of the cases whose derived status is asked for: filtered first, then cut, newest case first."""
    return with_status(cases, status).orderBy(F.desc("case_id")).offset(max(0, offset)).limit(max(1, limit))


def accounted(every: DataFrame, assigned: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """(key, refs, leftover, accounted): whether all references(key, ref) of a key are assigned or skipped."""
    known = assigned.select(key, "ref").unionByName(skipped.select(key, "ref")).distinct().withColumn("known", F.lit(1))
    got = every.select(key, "ref").distinct().join(known, [key, "ref"], "left").groupBy(key).agg(F.count("*").alias("refs"), F.count_if(F.col("known").isNull()).alias("leftover"))
    return got.withColumn("accounted", F.col("leftover") == 0)


def retired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of old that new lacks."""
    return old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti")


def is_subset(selected: DataFrame, offered: DataFrame, key: str, item: str) -> DataFrame:
    """(key, subset): whether every selected item of a key was offered."""
    got = selected.select(key, item).distinct().join(offered.select(key, item).distinct().withColumn("offered", F.lit(True)), [key, item], "left")
    return got.groupBy(key).agg(F.bool_and(F.coalesce("offered", F.lit(False))).alias("subset"))


def evaluation(results: DataFrame) -> DataFrame:
    """One row: total, passed, least, most and average quality, and the issues with their numbers, of results(passed, issue, quality)."""
    issues = results.filter("issue IS NOT NULL").groupBy("issue").count().agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "issue", "count"))), ",").alias("issues"))
    totals = results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.min("quality").alias("least"), F.max("quality").alias("most"), F.avg("quality").alias("average"))
    return totals.crossJoin(issues)  # one row each


def false_accept_rate(results: DataFrame) -> DataFrame:
    """One row: negatives, accepted negatives and their share (0 without negatives), of results(negative, accepted)."""
    n, wrong = F.count_if("negative"), F.count_if(F.col("negative") & F.col("accepted"))
    return results.agg(n.alias("negatives"), wrong.alias("accepted"), F.coalesce(F.try_divide(wrong, n), F.lit(0.0)).alias("rate"))


def first_of_role(records: DataFrame, key: str, role: str, order: str, value: str) -> DataFrame:
    """(key, role, value): the value of each role's first record that has one."""
    return records.groupBy(key, role).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def evicted(sessions: DataFrame, group: str, most: int, *, ended: str = "ended_at", name: str = "session_id") -> DataFrame:
    """The sessions to drop so that each group holds most at least one fewer: ended ones, those that ended first; live ones stay."""
    n = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group, F.col(ended).isNull()).orderBy(ended, name))
    got = sessions.withColumn("_n", n).withColumn("_place", place)
    return got.filter(F.col(ended).isNotNull() & (F.col("_place") <= F.col("_n") - most + 1)).drop("_n", "_place")


def numbered_spans(units: DataFrame, key: str) -> DataFrame:
    """units(key, start, end, ...) numbered from 0 in the order of their spans."""
    return units.withColumn("unit_index", F.row_number().over(Window.partitionBy(key).orderBy("start", "end")) - 1)


def structured_evidence(expected: DataFrame, given: DataFrame, documents: DataFrame) -> DataFrame:
    """(card_id, problem) for each card of expected(card_id, place, pointer, start, end, sha256): '' if its evidence holds.

    given(card_id, place, pointer) must have as many references, with equal pointers in order; the source at start..end
    of documents(card_id, content), hashed again, must have the digest.
    """
    source = F.sha2(F.expr("substring(content, start + 1, end - start)"), 256)
    mine = expected.join(documents, "card_id", "left").withColumn("same", F.coalesce(source == F.col("sha256"), F.lit(False))).select("card_id", "place", F.col("pointer").alias("wanted"), "same")
    both = mine.join(given.select("card_id", "place", "pointer"), ["card_id", "place"], "full")
    got = both.groupBy("card_id").agg(F.count("wanted").alias("n"), F.count("pointer").alias("m"), F.bool_and(F.col("wanted").eqNullSafe(F.col("pointer"))).alias("ordered"), F.bool_and(F.coalesce("same", F.lit(True))).alias("hashed"))
    return got.select("card_id", F.when(F.col("n") != F.col("m"), "COUNT_DIFFERS").when(~F.col("ordered"), "POINTERS_DIFFER").when(~F.col("hashed"), "SOURCE_CHANGED").otherwise("").alias("problem"))


def chunk_locator(name: Column, index: Column, start: Column, end: Column, method: Column) -> Column:
    """Where quoted evidence lies: document, chunk from 1, characters, and how it was matched (null: it was not)."""
    return F.concat(name, F.lit("#chunk="), index + 1, F.lit(";chars="), start, F.lit("-"), end, F.coalesce(F.concat(F.lit(";match="), method), F.lit(";unverified")))


def pointer_locator(name: Column, pointer: Column, start: Column, end: Column, digest: Column) -> Column:
    """Where structured evidence lies: document, pointer, characters and digest; a null pointer is unverified."""
    return F.coalesce(F.concat(name, F.lit("#pointer="), pointer, F.lit(";chars="), start, F.lit("-"), end, F.lit(";sha256="), digest, F.lit(";match=structured")), F.concat(name, F.lit("#unverified")))


def snapshot_hash(*fields: str) -> Column:
    """Digest of the named columns as JSON with sorted keys, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def drifted(drafts: DataFrame, cards: DataFrame, *fields: str) -> DataFrame:
    """(draft_id, card_id, drift) of drafts(draft_id, card_id, snapshot): whether a card is gone or not what was used."""
    now = cards.select("card_id", snapshot_hash(*fields).alias("now"))
    return drafts.join(now, "card_id", "left").select("draft_id", "card_id", (~F.col("now").eqNullSafe(F.col("snapshot"))).alias("drift"))


def card_detail(cards: DataFrame, relations: DataFrame, lineage: DataFrame) -> DataFrame:
    """cards with their relations and their lineage as lists, each empty where there is none."""
    r = relations.groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("related_card_id", "relation_type"))).alias("relations")).withColumnRenamed("card_id", "id")
    l = lineage.groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("case_id", "source_order"))).alias("lineage")).withColumnRenamed("card_id", "id")
    got = cards.join(r, "id", "left").join(l, "id", "left")
    return got.withColumns({c: F.coalesce(c, F.array().cast(dict(got.dtypes)[c])) for c in ("relations", "lineage")})


def title_qualifier(targets: Column, operation: Column, length: int = 28) -> Column:
    """The first target, else the operation's first line with text, else a constant; cut to length."""
    lines = F.filter(F.transform(F.split(F.coalesce(operation, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.coalesce(F.get(targets, F.lit(0)), F.get(lines, F.lit(0)), F.lit("不同目标")), 1, length)


def case_markdown(cases: DataFrame, cards: DataFrame) -> DataFrame:
    """(case_id, markdown): a case's title and its cards(case_id, source_order, title, summary) in order."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.coalesce("summary", F.lit("")))
    body = cards.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_order", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("body"))
    return cases.join(body, "case_id", "left").select("case_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "case_title"), "body").alias("markdown"))


def unpublished(candidates: DataFrame, stored: DataFrame, key: str = "checksum") -> DataFrame:
    """One candidate of each key that is not stored yet: to publish twice adds nothing."""
    return candidates.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def migrated(table: DataFrame, added: dict[str, Column]) -> DataFrame:
    """table with columns that it lacks added, and nulls of those it has filled; to migrate twice changes nothing."""
    return table.withColumns({c: F.coalesce(F.col(c), v) if c in table.columns else v for c, v in added.items()})
