"""Document files as rows: text family, JSON, DOCX; anything else by a reader that the caller plugs in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from typing import IO
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import SpanError, spans

# What is read how, and limits.
TEXT_SUFFIXES = ("txt", "md", "markdown", "log", "csv", "yaml", "yml")
ENCODINGS = ("utf-8-sig", "utf-16", "gb18030")
MOST_CHARS, MOST_JSON_CHARS = 120_000, 500_000
MOST_ENTRIES, MOST_UNPACKED, MOST_RATIO, MOST_XML = 2_000, 64 << 20, 100, 16 << 20
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

Reader = Callable[[bytes], str]


class DocumentError(ValueError):
    pass


def decode(data: bytes) -> str:
    """The text in the first encoding that fits."""
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeError:
            continue
    raise DocumentError("no known encoding")


def read_json(data: bytes) -> str:
    text = decode(data)
    try:
        for _ in spans(text):
            pass
    except SpanError as e:
        raise DocumentError(str(e)) from e
    return text


def _paragraphs(part: IO[bytes], budget: int) -> list[str]:
    """Texts of the paragraphs of a document part, read block by block up to budget bytes; a DTD ends the reading."""
    found: list[list[str]] = []
    open_: list[list[str]] = []  # a paragraph's text also belongs to those around it
    depth = 0

    def start(name, _):
        nonlocal depth
        if name == f"{WORD} p":
            found.append([])
            open_.append(found[-1])
        depth += name == f"{WORD} t"

    def end(name):
        nonlocal depth
        if name == f"{WORD} p":
            open_.pop()
        depth -= name == f"{WORD} t"

    def characters(data):
        if depth:
            for p in open_:
                p.append(data)

    def refuse(*_):
        raise DocumentError("a DTD is not allowed")

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, characters, refuse
    while block := part.read(1 << 16):
        budget -= len(block)
        if budget < 0:
            raise DocumentError("the document is too large")
        parser.Parse(block)
    parser.Parse(b"", True)
    return ["".join(p) for p in found]


def read_docx(data: bytes) -> str:
    """Paragraphs of a DOCX, joined by blank lines; refuses archives that unpack too far and XML with a DTD."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            sizes = [(e.file_size, max(e.compress_size, 1)) for e in archive.infolist()]
            if len(sizes) > MOST_ENTRIES or sum(n for n, _ in sizes) > MOST_UNPACKED or max((n / m for n, m in sizes), default=0) > MOST_RATIO:
                raise DocumentError("the archive unpacks too far")
            with archive.open("word/document.xml") as part:
                return "\n\n".join(p for p in _paragraphs(part, MOST_XML) if p.strip())
    except (zipfile.BadZipFile, KeyError) as e:
        raise DocumentError("no DOCX") from e
    except expat.ExpatError as e:
        raise DocumentError(f"bad XML: {e}") from e


READERS: dict[str, Reader] = {**dict.fromkeys(TEXT_SUFFIXES, decode), "json": read_json, "docx": read_docx}


def read_documents(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(source_name, source_type, source_ref, content, checksum, error) of the files below path, by suffix.

    readers adds formats (a PDF or OCR reader, say). What can't be read, is empty or too long gives an error and no
    content; one bad file does not stop the others.
    """
    every = READERS | (readers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))

    @F.pandas_udf("struct<content:string,error:string>")
    def read(kind: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for k, d in zip(kind, data):
            try:
                text = every[k](d) if k in every else None
                limit = MOST_JSON_CHARS if k == "json" else MOST_CHARS
                error = "unknown format" if text is None else "empty" if not text.strip() else "too long" if len(text) > limit else None
            except DocumentError as e:
                text, error = None, str(e)
            rows.append((None if error else text, error))
        return pd.DataFrame(rows, columns=["content", "error"])

    got = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("source_name"), suffix.alias("source_type"), F.col("path").alias("source_ref"), read(suffix, F.col("content")).alias("r"))
    return got.select("source_name", "source_type", "source_ref", "r.content", F.sha2("r.content", 256).alias("checksum"), "r.error")


def ocr_text(lines: DataFrame, least: float = 0.45) -> DataFrame:
    """lines(page, line_no, text, score) as (page, content): lines of at least the given confidence; no score counts as 1, one that is no number as 0."""
    sure = F.when(F.col("score").isNull(), 1.0).otherwise(F.coalesce(F.col("score").cast("string").try_cast("double"), F.lit(0.0)))
    kept = lines.filter(sure >= least).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return kept.select("page", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))
