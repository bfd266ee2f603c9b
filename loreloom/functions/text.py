"""Text functions as column expressions; vectorised Python only where a rule has no built-in form."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from ipaddress import ip_address
from itertools import compress
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectorized

# Words that never count as terms.
LATIN_STOPWORDS = "a an and are be by for from how in is of on or the to what with".split()
CJK_STOPWORDS = list("的了和与或及在对将为是有中前后把被这那能可")
# Phrases that say that nothing is to be done, and filler around them.
NOOP_PHRASES = ["不涉及", "无影响", "无需操作", "无需处理", "无业务影响", "not applicable", "no impact", "no action required"]
NOOP_FILLER = r"[\s,，。.;；:：!！?？()（）\[\]【】_-]|本项|该项|当前|本次|确认|结果|为"
# Patterns.
LATIN_TOKEN = "[a-z0-9]+(?:[._/-][a-z0-9]+)*"
CJK_RUN = "[㐀-鿿]+"
HTML_RESIDUE = r"(?i)</?[a-zA-Z][^>]*>|&(?:nbsp|amp|lt|gt|quot|#\d+);"
URL = r"(?i)https?://\S+"
TRANSITION = r"(?i)([A-Za-z0-9_.-]+)\s*(?:->|→|到)\s*([A-Za-z0-9_.-]+)"
EXPECTED_VALUE = r"(?i)(?:==|equals?|应为|等于)\s*([A-Za-z0-9_.-]+)"
RELATION_TARGET = r"(?i)((?:parameter|param|setting|config|参数|配置项|系统参数)\s*[A-Za-z0-9_.-]*)"
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+"
PUNCTUATION = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "…": "..."}
DIRECTIVE = r"\{\{[%<].*?[>%]\}\}"
ANCHORS, LEAST_ANCHORED = (32, 24, 16), 0.78
RICH_BLOCKS = {"p", "div", "section", "article", "li", "tr", "h1", "h2", "h3", "h4"}
IMAGE_MARK = "[图片证据]"


def tokenize(text: Column) -> Column:
    """Terms of a text, repeats kept: Latin tokens without stop words, then CJK bigrams (lone characters unless stop words)."""
    low = F.lower(text)
    latin = F.filter(F.regexp_extract_all(low, F.lit(LATIN_TOKEN), 0), lambda t: ~t.isin(LATIN_STOPWORDS))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    alone = lambda r: F.when(r.isin(CJK_STOPWORDS), F.array().cast("array<string>")).otherwise(F.array(r))
    cjk = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(CJK_RUN), 0), lambda r: F.when(F.length(r) == 1, alone(r)).otherwise(pairs(r))))
    return F.concat(latin, cjk)


@vectorized("string")
def nfkc_fold(text: pd.Series) -> pd.Series:
    """NFKC and casefold, for which Spark has no function."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


def compact_tokens(text: Column, ascii_only: bool = False) -> Column:
    """Distinct folded runs of [0-9a-z一-鿿_-] of at least two characters."""
    folded = F.lower(text) if ascii_only else nfkc_fold(text)
    return F.array_distinct(F.filter(F.regexp_extract_all(folded, F.lit("[0-9a-z一-鿿_-]+"), 0), lambda t: F.length(t) > 1))


@vectorized("string")
def identity_key(text: pd.Series) -> pd.Series:
    """Folded text without anything but letters and digits."""
    return text.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()))


def ascii_identity(text: Column) -> Column:
    """identity_key for ASCII texts, without Python."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


@vectorized("string")
def with_spans(text: pd.Series, starts: pd.Series, ends: pd.Series, put: pd.Series) -> pd.Series:
    """Text with the spans from starts to ends, which are in order and apart, replaced. Spark would count characters from
    the text's start for each span."""

    def one(t, starts, ends, put):
        if t is None or starts is None:
            return t
        out, at = [], 0
        for start, end, new in zip(starts, ends, put):
            out += t[at:start], new
            at = end
        return "".join(out) + t[at:]

    return pd.Series(list(map(one, text, starts, ends, put)), dtype=object)


def string_list(values: Column) -> Column:
    """An array's values trimmed, empty ones dropped, first occurrences kept."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) > 0))


def noop_response(text: Column) -> Column:
    """The phrase that says nothing is to be done, if next to nothing else is said; else the empty string."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    rest = folded
    for phrase in NOOP_PHRASES:
        rest = F.replace(rest, F.lit(phrase), F.lit(""))
    # A text without a phrase, as most are, is not searched for the filler.
    said = [F.when(F.contains(folded, F.lit(p)), p) for p in NOOP_PHRASES]
    some = F.rlike(F.coalesce(text, F.lit("")), F.lit("(?i)" + "|".join(NOOP_PHRASES)))
    return F.when(some, F.when(F.length(F.regexp_replace(rest, NOOP_FILLER, "")) <= 6, F.coalesce(*said, F.lit(""))).otherwise("")).otherwise("")


def generalize(operation: Column, parameters: Column) -> Column:
    """Replaces the values of a map, longest first, by {{key}}; values of one character stay."""
    entries = F.array_sort(F.map_entries(parameters), lambda a, b: F.when(F.length(a["value"]) > F.length(b["value"]), -1).when(F.length(a["value"]) < F.length(b["value"]), 1).otherwise(0))
    literal = lambda e: F.concat(F.lit("(?i)"), F.regexp_replace(e["value"], r"([^A-Za-z0-9\s])", r"\\$1"))
    swap = lambda acc, e: F.when(F.length(e["value"]) >= 2, F.regexp_replace(acc, literal(e), F.concat(F.lit("{{"), F.regexp_replace(e["key"], r"([\\$])", r"\\$1"), F.lit("}}")))).otherwise(acc)
    return F.aggregate(entries, operation, swap)


def excerpt(limit: int, *candidates: Column) -> Column:
    """The first candidate that is not blank, white space squeezed, cut to limit."""
    clean = [F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) for c in candidates]
    return F.substring(F.coalesce(*clean, F.lit("")), 1, limit)


def redact(key: Column, value: Column, secret: str = r"(?i)(password|secret|token|api_?key|authorization)", texts: tuple[str, ...] = ("content", "prompt", "text")) -> Column:
    """Secret keys become a constant, long text keys their length and digest, bearer tokens in other values a mask."""
    digest = F.concat(F.lit('{"length":'), F.length(value), F.lit(',"sha256":"'), F.sha2(value, 256), F.lit('"}'))
    return F.when(F.rlike(key, F.lit(secret)), F.lit("[REDACTED]")).when(key.isin(*texts), digest).otherwise(F.regexp_replace(value, BEARER, "Bearer [REDACTED]"))


_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(?P<raw>script|style)(?=[\s/>])[^>]*>(?P<data>.*?)(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^"'>])*)>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_LINE_START = "\x02"  # where a line starts unless one does already


def rich_text(value: str | None) -> dict:
    """Plain text and image attachments of a marked-up value: markup becomes line ends and image marks, one by one."""
    images = []

    def plain(m: re.Match) -> str:
        tag = (m["tag"] or "").lower()
        if m["raw"]:
            return m["data"]
        if tag == "br" and not m["end"]:
            return "\n"
        if tag in RICH_BLOCKS:
            return "\n" if m["end"] else _LINE_START
        if tag == "img" and not m["end"]:
            got = {k.casefold(): html.unescape(v.strip("\"'")).strip() for k, v in _ATTRIBUTE.findall(m["rest"])}
            images.append({"type": "image", "source": got.get("src", ""), "alt": got.get("alt", "")})
            return IMAGE_MARK
        return ""

    raw = (value or "").replace(_LINE_START, "")
    if "\\" in raw:
        try:
            raw = json.loads(f'"{raw}"')
        except json.JSONDecodeError:
            pass
    text = _MARKUP.sub(plain, html.unescape(raw).replace("\xa0", " "))
    text = re.sub(f"{_LINE_START}+", "\n", re.sub(f"(^|\n){_LINE_START}+", r"\1", text))
    text = re.sub(URL, "", html.unescape(text))
    for pattern, by in ((r"[ \t]+", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, by, text)
    return {"text": text.strip(), "attachments": images}


@vectorized("struct<text:string,attachments:array<struct<type:string,source:string,alt:string>>>")
def rich_text_udf(value: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rich_text(v) for v in value], columns=["text", "attachments"])


class _Folds(dict):
    """What each code point folds to, for str.translate: compatible forms, plain punctuation, no case, any white space as a space."""

    def __missing__(self, code: int) -> str:
        plain = "".join(PUNCTUATION.get(c, c) for c in unicodedata.normalize("NFKC", chr(code)))
        self[code] = out = "".join(" " if c.isspace() else c for c in plain.casefold())
        return out


_FOLDS = _Folds()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _folded(text: str) -> tuple[str, np.ndarray]:
    """text folded, white space squeezed and trimmed, and the place in text of each character that is left."""
    long = text.translate(_FOLDS)
    kinds, which = np.unique(_codes(text), return_inverse=True)
    places = np.repeat(np.arange(len(text)), np.array([len(_FOLDS[k]) for k in kinds.tolist()], dtype=np.int64)[which])
    blank = _codes(long) == 32
    kept = ~blank | np.r_[False, ~blank[:-1]][: len(blank)]
    if kept.any() and blank[last := int(np.flatnonzero(kept)[-1])]:
        kept[last] = False
    return "".join(compress(long, kept.tolist())), places[kept]


def _between_ends(hay: str, needle: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of hay that begin and end as needle does, for ends of each length."""
    for size in ANCHORS:
        if len(needle) > 2 * size:
            before, head, after = hay.partition(needle[:size])
            inner, tail, _ = after.partition(needle[-size:])
            if head and tail:
                yield len(before), len(before) + 2 * size + len(inner)


def _likeness(needle: str, part: str) -> float:
    """Ratio of needle and part, or part without directives if that is higher; 0 where their lengths are too far apart."""
    if not 0.6 <= len(part) / len(needle) <= 2.0:
        return 0.0
    return max(SequenceMatcher(None, needle, x, autojunk=False).ratio() for x in (part, re.sub(DIRECTIVE, "", part, flags=re.S)))


def ground(source: str | None, quote: str | None) -> dict | None:
    """Where a quote stands in a source: exactly, up to normalisation, or between matching ends with a close middle."""
    want = (quote or "").strip()
    if not source or not want:
        return None
    if (at := source.find(want)) >= 0:
        return {"start": at, "end": at + len(want), "method": "exact", "similarity": 1.0}
    hay, places = _folded(source)
    needle, _ = _folded(want)
    if needle and (at := hay.find(needle)) >= 0:
        start, end, method, like = at, at + len(needle), "normalized", 1.0
    else:
        like, start, end = max(((_likeness(needle, hay[a:b]), a, b) for a, b in _between_ends(hay, needle)), key=lambda x: x[0], default=(0.0, 0, 0))
        if like < LEAST_ANCHORED:
            return None
        method = "anchored"
    return {"start": int(places[start]), "end": int(places[end - 1]) + 1, "method": method, "similarity": like}


@vectorized("struct<start:long,end:long,method:string,similarity:double>")
def ground_udf(source: pd.Series, quote: pd.Series) -> pd.DataFrame:
    rows = [ground(s, q) or {} for s, q in zip(source, quote)]
    return pd.DataFrame(rows, columns=["start", "end", "method", "similarity"]).astype({"start": "Int64", "end": "Int64", "method": "object", "similarity": "float64"})


@vectorized("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness with the popular-character rule, as deduplication uses it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@vectorized("string")
def hostname(value: pd.Series) -> pd.Series:
    """A host as it compares: IP addresses compressed, names lower-cased without port and closing dot; '' if it is none."""
    return value.map(lambda v: _host(v or ""))


def _host(raw: str) -> str:
    raw = raw.strip()
    if not raw or set(raw) & set("@/\\"):
        return ""
    try:
        name = raw if _address(raw) else (urlsplit(f"//{raw}").hostname or "").rstrip(".").lower()
    except ValueError:
        return ""
    return _address(name) or name


def _address(text: str) -> str | None:
    try:
        return ip_address(text).compressed.lower()
    except ValueError:
        return None


def truncated(value: Column, most: int) -> Column:
    """struct<text, cut, original_bytes>: a text of more than so many UTF-8 bytes is cut at the last whole character within."""
    data = F.encode(value, "UTF-8")
    ends = F.array(*(F.substring(data, 1, max(0, most - k)) for k in range(4)))
    whole = F.get(F.filter(F.transform(ends, lambda b: b.cast("string")), lambda t: F.is_valid_utf8(t)), F.lit(0))
    over = F.octet_length(value) > most
    return F.struct(F.when(over, whole).otherwise(value).alias("text"), over.alias("cut"), F.octet_length(value).alias("original_bytes"))
