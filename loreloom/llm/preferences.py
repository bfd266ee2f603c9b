"""Preference formatting: chosen and rejected conversations become one prompt and two masked completions.

The turns that both conversations start with, in order, equal in role and text, are rendered once as the prompt; what
follows in each is its completion. A completion's mask lists the spans, in code points from the completion's start,
that training counts: the text and end mark of assistant turns. Headers and the turns of others are masked out.

A turn is rendered as its header (role in marks), its text and an end mark; marks inside a text or role are broken up by
a backslash, so that no text can end its own turn.

Defined cases: null role is ``unknown``, null text is empty; turns are ordered by number (null first), then role and
text, and equal rows count once; identical conversations give a prompt and two empty completions; a pair with one side
missing gives an empty prompt and an empty completion for the other; an empty table gives no rows. One output row holds one
pair's conversations: that is the one thing gathered, and it is the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of a rendered turn.
HEAD, NECK, END = "<|", "|>\n", "<|end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def ordered(turns: DataFrame, key: str) -> DataFrame:
    """(key, idx, role, text): the conversation's distinct turns numbered from 0. One shuffle, by key."""
    rows = turns.select(key, "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).repartition(key).distinct()
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("turn", "role", "text")) - 1).drop("turn")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), _safe(role), F.lit(NECK), _safe(text), F.lit(END))


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) from (key, idx, role, text) of both.

    A mask is "start-end" spans, comma-joined. Null keys are one pair.
    """
    return format_sides(chosen.select(key, "idx", "role", "text", F.lit(True).alias("good")).unionByName(rejected.select(key, "idx", "role", "text", F.lit(False).alias("good"))).repartition(key), key)


def format_sides(sides: DataFrame, key: str) -> DataFrame:
    """format_pairs of both sides in one frame, told apart by good. All windows and groups are by key: no shuffle where rows lie by key."""
    at, pair = Window.partitionBy(key, "idx"), Window.partitionBy(key)
    both = (F.count("*").over(at) == 2) & (F.min("role").over(at) == F.max("role").over(at)) & (F.min("text").over(at) == F.max("text").over(at))
    first = F.coalesce(F.min(F.when(~F.col("both"), F.col("idx"))).over(pair), F.max("idx").over(pair) + 1)
    sides = sides.withColumn("both", both).withColumn("n_prompt_turns", first)
    turns = sides.withColumn("body", rendered(F.col("role"), F.col("text")))
    tail = F.col("idx") >= F.col("n_prompt_turns")
    turns = turns.withColumn("stop", F.sum(F.when(tail, F.length("body")).otherwise(0)).over(Window.partitionBy(key, "good").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    counted = F.concat_ws("-", F.col("stop") - F.length("body") + F.length(_safe(F.col("role"))) + len(HEAD + NECK), F.col("stop"))

    def joined(value: Column, side: bool | None, part: Column) -> Column:
        wanted = part if side is None else part & (F.col("good") == side)
        ordered_ = F.sort_array(F.collect_list(F.when(wanted, F.struct("idx", value.alias("v")))))
        return F.array_join(F.transform(ordered_, lambda x: x["v"]), "" if value is not counted else ",")

    is_reply = tail & (F.col("role") == "assistant")
    body = F.col("body")
    return turns.groupBy(key).agg(
        F.first("n_prompt_turns").alias("n_prompt_turns"),
        joined(body, True, ~tail).alias("prompt"),
        joined(body, True, tail).alias("chosen"),
        joined(body, False, tail).alias("rejected"),
        joined(counted, True, is_reply).alias("chosen_mask"),
        joined(counted, False, is_reply).alias("rejected_mask"),
    )


def swapped_sides(turns: DataFrame) -> DataFrame:
    """Chosen and rejected sides (conv_id, idx, role, text, good) from plain conversations(conv_id, turn, role, text).

    Chosen is a conversation up to its last assistant turn; rejected is the same with that turn's text taken from the
    conversation whose id differs in the lowest bit. Conversations without an assistant turn, or whose partner has none,
    and null ids give no pair.
    """
    rows = ordered(turns.filter("conv_id IS NOT NULL"), "conv_id")
    last = rows.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("idx").alias("last"), F.max_by("text", "idx").alias("reply"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("other"))
    mine = rows.join(last.select("conv_id", "last").join(other, "conv_id"), "conv_id").filter("idx <= last")
    bad = F.when(F.col("idx") == F.col("last"), F.col("other")).otherwise(F.col("text"))
    versions = F.array(F.struct(F.lit(True).alias("good"), "text"), F.struct(F.lit(False).alias("good"), bad.alias("text")))
    return mine.select("conv_id", "idx", "role", F.inline(versions))


def report(turns: DataFrame) -> DataFrame:
    """Preferences over swapped_sides, keyed by conv_id."""
    return format_sides(swapped_sides(turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")), "conv_id")


#: The same rows for DuckDB.
ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx FROM t),
l AS (SELECT conv_id, max(idx) AS last, arg_max(text, idx) AS reply FROM o WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT o.conv_id, o.idx, o.role, o.text, CASE WHEN o.idx = l.last THEN x.reply ELSE o.text END AS bad
    FROM o JOIN l USING (conv_id) JOIN l AS x ON x.conv_id = xor(o.conv_id, 1) WHERE o.idx <= l.last),
f AS (SELECT conv_id, coalesce(min(idx) FILTER (WHERE text <> bad), max(idx) + 1) AS k FROM c GROUP BY conv_id),
r AS (SELECT conv_id, idx, role, k, '<|' || replace(role, '<|', '<\|') || '|>' || chr(10) AS head,
    replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS a, replace(bad, '<|', '<\|') || '<|end|>' || chr(10) AS b FROM c JOIN f USING (conv_id)),
s AS (SELECT *, sum(CASE WHEN idx >= k THEN length(head || a) ELSE 0 END) OVER w AS ea, sum(CASE WHEN idx >= k THEN length(head || b) ELSE 0 END) OVER w AS eb
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT conv_id, max(k)::INTEGER AS n_prompt_turns, coalesce(string_agg(head || a, '' ORDER BY idx) FILTER (WHERE idx < k), '') AS prompt,
    coalesce(string_agg(head || a, '' ORDER BY idx) FILTER (WHERE idx >= k), '') AS chosen, coalesce(string_agg(head || b, '' ORDER BY idx) FILTER (WHERE idx >= k), '') AS rejected,
    coalesce(string_agg((ea - length(a)) || '-' || ea, ',' ORDER BY idx) FILTER (WHERE idx >= k AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((eb - length(b)) || '-' || eb, ',' ORDER BY idx) FILTER (WHERE idx >= k AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY conv_id
"""
