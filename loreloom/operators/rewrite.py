"""JSON texts rewritten through their node table: nested secrets redacted, values normalised, pointers resolved.

What changes is decided for all nodes of all documents at once; a text is then put together from the pieces of its source
between the changed spans. So what does not change stays as it was written, to the byte, and no text is parsed twice.

Defined cases: what is no strict JSON, and null, has no nodes and stays as it is; a change inside a changed node is lost
with it; documents are told apart by their key, which must be distinct and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_spans
from ..functions.time import MILLISECONDS_FROM

# Names of secrets and of texts, and tokens within other texts.
SECRET_NAME = r"(?i)(?:api[_-]?key|authorization|password|secret|access[_-]?token|refresh[_-]?token)"
TEXT_NAME = r"(?i)^(?:question|query|prompt|user_prompt|system_prompt|content|text)$"
BEARER = r"(?i)Bearer\s+[A-Za-z0-9._~+/-]{8,}"
# Names that mark times and durations.
TIME_MARKS = ("timestamp", "start_time", "end_time", "create_time", "update_time")
SPAN_MARKS = ("duration", "total_time", "elapsed")


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def outermost(changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The changes(key, start, end, ...) that lie in no other; a document's spans nest or are apart."""
    before = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return changes.withColumn("reach", F.max("end").over(before)).filter("reach IS NULL OR reach < end").drop("reach")


def patched(docs: DataFrame, changes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the spans of changes(key, start, end, replacement) replaced. Changes in changed spans are left out."""
    each = outermost(changes, key).groupBy(F.col(key).alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("c"))
    got = docs.join(each, F.col(key) == F.col("of"), "left")
    of = lambda name: F.transform("c", lambda x: x[name])
    return got.withColumn(text, F.when(F.col("c").isNull(), F.col(text)).otherwise(with_spans(text, of("start"), of("end"), of("replacement")))).drop("of", "c")


def source(node_text: str = "text") -> Column:
    """A node's source: the text between start and end."""
    return F.substring(F.col(node_text), F.col("start") + 1, F.col("end") - F.col("start"))


def redactions(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, replacement): values of secret names whatever they hold, texts by length and digest, tokens masked."""
    name = F.coalesce("name", F.lit(""))
    texts = F.concat(F.lit('{"redacted":true,"length":'), F.length("scalar"), F.lit(',"sha256":"'), F.sha2("scalar", 256), F.lit('"}'))
    masked = F.regexp_replace("scalar", BEARER, "Bearer [REDACTED]")
    is_text = F.col("type") == "string"
    new = (
        F.when(F.rlike(name, F.lit(SECRET_NAME)), F.lit('"[REDACTED]"')).when(is_text & F.rlike(name, F.lit(TEXT_NAME)), texts)
        .when(is_text & (masked != F.col("scalar")), quoted(masked))
    )
    return nodes.select(key, "start", "end", new.alias("replacement")).filter("replacement IS NOT NULL")


def redacted(docs: DataFrame, nodes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their JSON texts redacted at every depth."""
    return patched(docs, redactions(nodes, key), key, text)


def _offset(local: Column, utc: Column) -> Column:
    minutes = F.floor((F.unix_seconds(local) - F.unix_seconds(utc)) / 60)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), two(F.floor(F.abs(minutes) / 60)), F.lit(":"), two(F.abs(minutes) % 60))


def normalisations(nodes: DataFrame, zone: str = "Asia/Shanghai", key: str = "doc_id") -> DataFrame:
    """(key, start, end, replacement) of the scalars that have a normal form: times, durations, numbers, booleans, and
    strings with white space around them. A value goes by its own name or, in an array, by the array's."""
    name = F.replace(F.lower(F.trim(F.coalesce("name", F.lit("")))), F.lit("-"), F.lit("_"))
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(name, m))
    raw = F.when(F.col("type") == "string", quoted(F.col("scalar"))).otherwise(F.col("scalar"))
    number = F.when(F.rlike(F.trim("scalar"), F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), F.trim("scalar").try_cast("double"))
    at = F.when(F.abs(number) >= MILLISECONDS_FROM, F.timestamp_millis(number.cast("long"))).when(number.isNotNull(), F.timestamp_seconds(number))
    stated = F.rlike(F.trim("scalar"), F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    said = F.try_to_timestamp(F.trim("scalar"))
    utc = F.coalesce(at, F.when(stated, said).otherwise(F.to_utc_timestamp(said, zone)))
    local = F.from_utc_timestamp(utc, zone)
    of = lambda *parts: F.concat(F.lit('{"raw":'), raw, *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("}"))
    time = F.when(utc.isNull(), of(',"normalization_error":"INVALID_TIMESTAMP"')).otherwise(of(',"normalized":"', F.date_format(local, "yyyy-MM-dd HH:mm:ss"), f'","timezone":"{zone}","iso8601":"', F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), _offset(local, utc), '"'))
    numeric = F.col("type").isin("integer", "number")
    trimmed = F.regexp_replace("scalar", r"(?U)^\s+|\s+$", "")
    new = (
        F.when(F.col("type") == "boolean", of(',"normalized":', F.col("scalar"), ',"type":"boolean"')).when(has(TIME_MARKS) & (F.col("type") != "null"), time)
        .when(has(SPAN_MARKS) & numeric, of(',"normalized":', F.regexp_replace("scalar", r"\.0+$", ""), ',"unit":"seconds"')).when(has(SPAN_MARKS) & (F.col("type") == "string"), of(',"normalized":', raw, ',"unit":"source_defined"'))
        .when(numeric, of(',"normalized":', F.col("scalar"), ',"type":"number"')).when((F.col("type") == "string") & (trimmed != F.col("scalar")), quoted(trimmed))
    )
    return nodes.filter("kind = 'scalar'").select(key, "start", "end", new.alias("replacement")).filter("replacement IS NOT NULL")


def normalised(docs: DataFrame, nodes: DataFrame, zone: str = "Asia/Shanghai", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every scalar of their JSON texts in its normal form."""
    return patched(docs, normalisations(nodes, zone, key), key, text)


def resolved(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """wanted(key, pointer, ...) with type and value, the source of what the pointer names; null where there is nothing."""
    # Texts meet only the nodes that are named.
    named = nodes.join(wanted.select(key, "pointer").distinct(), [key, "pointer"], "left_semi").select(key, "pointer", "start", "end", "type")
    found = named.join(docs.select(key, F.col(text).alias("text")), key).select(key, "pointer", "type", source().alias("value"))
    return wanted.join(found, [key, "pointer"], "left")
