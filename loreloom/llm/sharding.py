"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group and stay together, but for a group beyond one shard's fair share in any
dimension, which is divided. Groups of over 1/64 of a share (at most 64 a shard and dimension) are cut into pieces of
about that size by a hash of doc_id; all smaller groups are hashed into ``BUNDLES`` units. The pieces of a group within
a share are packed as one, those of a larger group one by one; slots run on from piece to piece. So the driver packs a
number of unit sums that depends on the number of shards only, whatever the corpus, and no task orders more than a piece
or a bundle: largest first, each goes to the shard with room for it where the dot product of its vector and the shard's
residual capacity is highest.

Defined cases: null text has no bytes and no words, all null texts are one group, and size is 8; null doc_ids are
hashed as a value of their own; repeated rows (equal in doc_id and text) each get a slot, in one piece; an empty table gives no rows; ``assign`` keeps every
column whatever its name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, fresh
from .mixing import word_count

#: Units of small groups, pieces for each shard's share, and the bytes that each row costs besides its text.
BUNDLES, OWN_UNITS, ROW_BYTES = 8192, 64, 8
DIMENSIONS = ("n_bytes", "n_tokens", "n_rows")


def text_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _unit(group, doc_id, pieces):
    """Pieces of a listed group (group, piece), or the bundle that a small group hashes to (null, bundle)."""
    return F.when(pieces.isNotNull(), group), F.when(pieces.isNotNull(), F.pmod(F.xxhash64(doc_id), pieces)).otherwise(F.pmod(F.xxhash64(group), F.lit(BUNDLES)))


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit. vectors: (units, dimensions), not negative.

    Largest first by the largest of its shares; a unit goes to the shard with the highest dot product among those that it fits
    in all dimensions, else among those it fits by the first dimension, else where most of that is left.
    """
    total = np.maximum(vectors.sum(axis=0), 1)
    need = vectors / total * shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-(need.max(axis=1)), kind="stable"):
        fits = (left >= need[i] - 1e-12).all(axis=1)
        if not fits.any():
            fits = left[:, 0] >= need[i, 0] - 1e-12
        at = np.argmax(np.where(fits, left @ need[i], -np.inf)) if fits.any() else np.argmax(left[:, 0])
        out[i] = at
        left[at] -= need[i]
    return out


def plan(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(listed groups with their pieces, units with shard and first slot) of rows(doc_id, grp, n_bytes, n_tokens).

    Both have bounded numbers of rows: at most 3 * OWN_UNITS groups a shard, and BUNDLES units besides their pieces,
    which are at most twice 3 * OWN_UNITS a shard.
    """
    spark = rows.sparkSession
    all_ = rows.agg(F.sum("n_bytes").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("r")).first()
    share = [max(x or 0, 1) / shards for x in all_]
    groups = rows.groupBy("grp").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    most = F.greatest(*(F.col(d) / s for d, s in zip(DIMENSIONS, share)))
    listed = groups.withColumn("most", most).filter(F.col("most") > 1 / OWN_UNITS).select("grp", F.ceil(F.col("most") * OWN_UNITS).cast("int").alias("pieces"))
    listed = spark.createDataFrame(listed.collect(), "grp long, pieces int")
    whole = {g["grp"] for g in listed.filter(F.col("pieces") <= OWN_UNITS).collect()}
    sums = with_units(rows, listed).groupBy("unit_group", "unit_part").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    units = sorted(sums.collect(), key=lambda u: (-(u["unit_group"] is None), u["unit_group"] or 0, u["unit_part"]))
    packed: dict[tuple, int] = {}  # the pieces of a group that stays together are one
    of = [packed.setdefault((u["unit_group"], u["unit_part"] if u["unit_group"] not in whole else None), len(packed)) for u in units]
    vectors = np.zeros((len(packed), 3))
    np.add.at(vectors, of, np.array([[u[d] for d in DIMENSIONS] for u in units], dtype=float).reshape(-1, 3))
    placed = pack(vectors, shards)[of] if units else np.zeros(0, dtype=np.int64)
    first, out = [0] * shards, []
    for u, shard in zip(units, placed.tolist()):
        out.append((u["unit_group"], u["unit_part"], shard, first[shard]))
        first[shard] += u["n_rows"]
    return listed, spark.createDataFrame(out, "unit_group long, unit_part long, shard int, first_slot long")


def with_units(rows: DataFrame, listed: DataFrame) -> DataFrame:
    got = rows.join(F.broadcast(listed), "grp", "left")
    group, part = _unit(F.col("grp"), F.col("doc_id"), F.col("pieces"))
    return got.withColumn("unit_group", group).withColumn("unit_part", part).drop("pieces")


def _placed(rows: DataFrame, units: DataFrame) -> DataFrame:
    u = F.broadcast(units)
    return rows.join(u, rows["unit_group"].eqNullSafe(u["unit_group"]) & (rows["unit_part"] == u["unit_part"])).drop(u["unit_group"]).drop(u["unit_part"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, n_bytes, n_tokens, text_crc32): one pass over the texts."""
    text = F.col("text")
    return docs.select("doc_id", F.xxhash64(text).alias("grp"), text_bytes(text).alias("n_bytes"), word_count(text).alias("n_tokens"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Where each document lies: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots follow units, then doc_id; each window sorts one unit, a piece or a bundle.
    """
    rows = Table(measured(docs), "shard-sizes").df
    listed, units = plan(rows, shards)
    got = _placed(with_units(rows, listed), units)
    order = Window.partitionBy("unit_group", "unit_part").orderBy("doc_id", "n_bytes", "text_crc32")
    slot = F.col("first_slot") + F.row_number().over(order) - 1
    return got.select("doc_id", F.col("n_bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """docs with column shard (renamed if it clashes), without a shuffle of the texts; write with partitionBy(shard)."""
    rows = Table(measured(docs), "shard-sizes").df
    listed, units = plan(rows, shards)
    grp, ug, up, pieces, shard = fresh(docs, "shard_grp", "shard_unit_group", "shard_unit_part", "shard_pieces", "shard")
    l = F.broadcast(listed.toDF("lg", pieces))
    got = docs.withColumn(grp, F.xxhash64("text"))
    got = got.join(l, got[grp] == l["lg"], "left").drop(l["lg"])
    group, part = _unit(F.col(grp), F.col("doc_id"), F.col(pieces))
    got = got.withColumns({ug: group, up: part})
    u = F.broadcast(units.select(F.col("unit_group").alias("ua"), F.col("unit_part").alias("ub"), F.col("shard").alias(shard)))
    got = got.join(u, got[ug].eqNullSafe(u["ua"]) & (got[up] == u["ub"]))
    return got.select(*(got[c] for c in docs.columns), u[shard])
