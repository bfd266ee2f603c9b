"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, one root, and a proof for each row.

Leaves of a source are numbered in the order of doc_id (then of digest) by ranges: rows are range-sorted, each range
counts its rows of each source, running sums of these counts give the first number. A level is one window: partition by
source and parent index, ordered by place; the full frame's collect_list is both the parent's preimage and the siblings
that a proof needs. Parents are deduplicated before the next level, so that each has a third of the rows; a source
with most of the rows is spread over all tasks, as no partition of the window has more than ``fan`` rows. The sources'
subroots are the leaves of one more tree. Proofs then go down: a node's path is its siblings and its parent's path, one
join for each level.

Defined cases: a null column counts as ``-``; null source comes first, null doc_id first in its source and is never
tampered with; rows equal in all columns have places of their own; a lone leaf is its source's subroot, a lone subroot
the root, and a proof without siblings is the digest of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, checked_broadcast

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, or - for null."""

    def said(v: Column) -> Column:
        s = v.cast("string")
        return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return digest(*map(said, values))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with their place from 0 in their group by order, and the group's number of rows n.

    Rows equal in group and order are told apart by a number, and so are cut into ranges, too.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "number")]
    marked = Table(rows.withColumn("number", F.monotonically_increasing_id()), "merkle-marked")
    ranged = Table(marked.df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "merkle-ranged").df
    marked.drop()
    counts = ranged.groupBy(group, "part").agg(F.count("*").alias("rows"))  # one row for each group and range that has some of it
    running, whole = Window.partitionBy(group).orderBy("part"), Window.partitionBy(group)
    starts = counts.select(F.col(group).alias("of"), F.col("part").alias("of_part"), (F.sum("rows").over(running) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*by[1:])) - 1
    got = ranged.withColumn("place", place).join(starts, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return got.withColumn("place", F.col("place") + F.col("before")).drop("number", "part", "of", "of_part", "before")


def climbed(nodes: DataFrame, group: str, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels, and the root (group, node) of each group, of nodes(group, place, n, node, ...).

    A level has group, place, n, parent, and the digests before and after the node in its run; the first also has the
    other columns of nodes and the groups of one node. Their number follows from the largest group.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots, levels, now = [nodes.filter("n = 1").select(group, "node")], [], nodes
    while most > 1 or not levels:
        run = Window.partitionBy(group, "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = now.withColumn("parent", F.floor(F.col("place") / fan)).withColumn("run", F.collect_list("node").over(run))
        slot = (F.col("place") % fan).cast("int")
        joined = lambda start, n: F.unhex(F.array_join(F.slice("run", start, n), ""))
        level = level.withColumns({"before": joined(F.lit(1), slot), "after": joined(slot + 2, F.lit(fan)), "preimage": F.when(slot == 0, F.array_join("run", ""))}).drop("run")
        levels.append(Table(level, "merkle-level").df)
        # The first of a run stands for its parent: that leaves one row of each.
        parents = levels[-1].filter("n > 1 AND preimage IS NOT NULL").select(group, F.col("parent").alias("place"), F.ceil(F.col("n") / fan).alias("n"), digest(F.col("preimage")).alias("node"))
        roots.append(parents.filter("n = 1").select(group, "node"))
        now, most = parents.filter("n > 1"), -(-most // fan)
    return levels, reduce(DataFrame.unionByName, roots)


def paths(levels: list[DataFrame], group: str) -> DataFrame:
    """The first level with path: (before, after) of the node and of each node above it, from below, without its root."""
    own = F.array(F.struct("before", "after"))
    above = None
    for level in reversed(levels):
        rows = level.drop("preimage")
        if above is None:
            rows = rows.withColumn("path", own)
        else:
            up = above.select(F.col(group).alias("up"), F.col("place").alias("up_place"), F.col("path").alias("up_path"))
            rows = rows.join(up, F.col(group).eqNullSafe(F.col("up")) & (F.col("parent") == F.col("up_place")), "left")
            rows = rows.withColumn("path", F.when(F.col("up_path").isNull(), own).otherwise(F.concat(own, F.col("up_path")))).drop("up", "up_place", "up_path")
        above = rows
    return above.withColumn("path", F.when(F.col("n") > 1, F.col("path")).otherwise(F.slice("path", 1, 0))).drop("parent", "before", "after")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf_digest, lambda node, s: digest(F.lower(F.hex(s["before"])), node, F.lower(F.hex(s["after"]))))


def proof(path: Column) -> Column:
    """The digest of a path's siblings."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(F.lower(F.hex(s["before"])), F.lower(F.hex(s["after"])))), ""))


def manifest(rows: DataFrame, leaf_columns: dict[str, Column], group: Column, order: Column, fan: int = FAN) -> tuple[DataFrame, str | None]:
    """(group, order, leaf_columns, subroot, path to the root) for each of rows, and the root.

    leaf_columns: what is kept of a row; its leaf is that named "node".
    """
    leaves = rows.select(group.alias("group"), order.alias("order"), *(c.alias(n) for n, c in leaf_columns.items()))
    levels, subroots = climbed(Table(numbered(leaves, "group", ["order", "node"]), "merkle-leaves").df, "group", fan)
    tops = Table(numbered(subroots.select(F.lit(0).alias("tree"), F.col("group").alias("of_group"), "node"), "tree", ["of_group"]), "merkle-subroots").df
    top_levels, top = climbed(tops, "tree", fan)
    found = top.first()
    high = Table(paths(top_levels, "tree").select("of_group", F.col("node").alias("subroot"), F.col("path").alias("top_path")), "merkle-top")
    got = paths(levels, "group").join(checked_broadcast(high.df), F.col("group").eqNullSafe(F.col("of_group")))
    return got.withColumn("path", F.concat("path", "top_path")).drop("of_group", "top_path", "place", "n"), found and found["node"]


def report(docs: DataFrame) -> DataFrame:
    """For each document its leaf, subroot, root and proof, and whether it is verified after the stated tampering."""
    values = {c: F.col(c) for c in COLUMNS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf(*(values | {"text": F.translate("text", "\n", "")}).values())
    kept = {"doc_id": F.col("doc_id").cast("long"), "node": leaf(*values.values()), "changed": F.when(tampered & F.col("text").contains("\n"), changed)}
    rows, root = manifest(docs, kept, F.col("source").cast("string"), F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "node"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The rows of report for DuckDB. The CRC-32 is taken bit by bit over the digits of doc_id.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, *, CASE WHEN doc_id IS NULL THEN 0 ELSE list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))) END AS crc FROM documents),
t AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text2 FROM d),
e AS (SELECT row, doc_id, source, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(text2) || ':' || text2, '-') AS tail2 FROM t),
f AS (SELECT row, doc_id, source, sha256(head || tail) AS leaf, sha256(head || tail2) AS leaf2 FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM f),
b AS (SELECT 0 AS depth, source, place, leaf AS node, n FROM l
    UNION ALL SELECT depth + 1, source, place // 3, sha256(string_agg(node, '' ORDER BY place)), (n + 2) // 3 FROM b WHERE n > 1 GROUP BY depth, source, place // 3, n),
s AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM b WHERE n = 1),
u AS (SELECT 0 AS depth, place, subroot AS node, n FROM s UNION ALL SELECT depth + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY depth, place // 3, n),
r AS (SELECT node AS root FROM u WHERE n = 1),
bs AS (SELECT depth, source, place, n, string_agg(node, '') OVER (PARTITION BY depth, source, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre,
    string_agg(node, '') OVER (PARTITION BY depth, source, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS post FROM b),
us AS (SELECT depth, place, n, string_agg(node, '') OVER (PARTITION BY depth, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre,
    string_agg(node, '') OVER (PARTITION BY depth, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS post FROM u),
w AS (SELECT row, l.source, 0 AS depth, l.place, l.n, leaf2 AS node, '' AS sibs FROM l
    UNION ALL SELECT row, w.source, w.depth + 1, w.place // 3, (w.n + 2) // 3, sha256(coalesce(pre, '') || node || coalesce(post, '')), sibs || coalesce(pre, '') || coalesce(post, '')
    FROM w JOIN bs ON bs.depth = w.depth AND bs.source IS NOT DISTINCT FROM w.source AND bs.place = w.place WHERE w.n > 1),
v AS (SELECT row, w.source, 0 AS depth, s.place, s.n, node, sibs FROM w JOIN s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
    UNION ALL SELECT row, v.source, v.depth + 1, v.place // 3, (v.n + 2) // 3, sha256(coalesce(pre, '') || node || coalesce(post, '')), sibs || coalesce(pre, '') || coalesce(post, '')
    FROM v JOIN us ON us.depth = v.depth AND us.place = v.place WHERE v.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(v.sibs) AS proof_sha256, v.node AS folded_root, v.node = r.root AS verified
FROM v JOIN l USING (row) JOIN s ON s.source IS NOT DISTINCT FROM v.source, r WHERE v.n = 1
"""
