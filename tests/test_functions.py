import json
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loreloom.functions import json as J
from loreloom.functions import text as X
from loreloom.functions import time as M


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, want", [
    ("How to restore NAT-gw v1.2 of the", ["restore", "nat-gw", "v1.2"]), ("检查路由表", ["检查", "查路", "路由", "由表"]), ("前 的 云", ["云"]), ("a/b a", ["a/b"]), ("", []), ("é1 x_y", ["1", "x_y"]), ("查 NAT 出口", ["nat", "查", "出口"]),
])
def test_tokenize(spark, text, want):
    assert one(spark, text, X.tokenize) == want


def test_identity_and_compact_tokens(spark):
    assert one(spark, "ＡＢ-c 中", X.identity_key) == "abc中"
    assert one(spark, "ＡＢ ab x 中文_1", X.compact_tokens) == ["ab", "中文_1"]
    assert one(spark, ["  a ", "", "b", "a"], X.string_list, "array<string>") == ["a", "b"]


def test_noop(spark):
    assert one(spark, "本项不涉及。", X.noop_response) == "不涉及"
    assert one(spark, "无影响，但需要检查数据库连接与主从同步", X.noop_response) == ""
    assert one(spark, "Not applicable", X.noop_response) == "not applicable"


def test_generalize_longest_first(spark):
    row = spark.createDataFrame([("scale web-1 to WEB-10 in x", {"small": "web-1", "large": "web-10", "tiny": "x"})], "op string, p map<string,string>").select(X.generalize(F.col("op"), F.col("p")).alias("y")).first()
    assert row["y"] == "scale {{small}} to {{large}} in x"
    row = spark.createDataFrame([("move ab", {"k$x\\y": "ab"})], "op string, p map<string,string>").select(X.generalize(F.col("op"), F.col("p")).alias("y")).first()
    assert row["y"] == "move {{k$x\\y}}"


def test_rich_text():
    got = X.rich_text("<p>One&nbsp; <b>two</b></p><div>see http://x.y/z <img src='a.png' alt=A></div>\\n\\n\\n\\nend")
    assert got["text"] == f"One two\nsee {X.IMAGE_MARK}\n\nend" and got["attachments"] == [{"type": "image", "source": "a.png", "alt": "A"}]
    assert X.rich_text(None) == {"text": "", "attachments": []}


def test_grounding():
    source = "Intro. “Set   the route” to the standby gateway before the window opens, then verify traffic on both links. End."
    assert X.ground(source, "the route")["method"] == "exact"
    assert X.ground(source, '"set the ROUTE"') == {"start": 7, "end": 24, "method": "normalized", "similarity": 1.0}
    got = X.ground(source, "to the standby gateway before the WINDOW closes, then verify traffic on both links")
    assert got["method"] == "anchored" and 0.78 <= got["similarity"] < 1
    assert source[got["start"] : got["end"]].startswith("to the standby") and X.ground(source, "nothing like it") is None and X.ground("", "x") is None


def test_ratio_keeps_the_popular_rule(spark):
    a, b = "ab" * 150, "ba" * 150
    got = spark.createDataFrame([(a, b)], "a string, b string").select(X.sequence_ratio("a", "b").alias("r")).first()["r"]
    assert got == SequenceMatcher(None, a, b).ratio()


def test_redact(spark):
    rows = spark.createDataFrame([("api_key", "v"), ("note", "Bearer abc.d x"), ("content", "é")], "k string, v string").select(X.redact(F.col("k"), F.col("v")).alias("r")).collect()
    assert [r.r for r in rows[:2]] == ["[REDACTED]", "Bearer [REDACTED] x"] and json.loads(rows[2].r)["length"] == 1


@pytest.mark.parametrize("text", ['{"a": [1, {"b/c": "x~y"}], "é": null}', "[]", '"s"', "-1.5e3", '[[[]], {"k": {}}]', " { } "])
def test_json_spans_cover_the_source(text):
    nodes = list(J.spans(text))
    whole = json.loads(text)
    for pointer, kind, start, end, _, _ in nodes:
        value = whole
        for p in pointer.split("/")[1:]:
            p = p.replace("~1", "/").replace("~0", "~")
            value = value[int(p)] if isinstance(value, list) else value[p]
        assert json.loads(text[start:end]) == value
        assert kind == ("object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar")


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "NaN", "[1,]", "{", '{"a" 1}', "[1 2]", "1 2", "", '{"a":1,}', "[" * 100 + "]" * 100, "01", "tru"])
def test_bad_json_is_refused(text):
    with pytest.raises(J.SpanError):
        list(J.spans(text))


def test_times(spark):
    got = one(spark, "1785772800000", M.normalized)
    assert (got["normalized"], got["iso8601"]) == ("2026-08-04 00:00:00", "2026-08-03T16:00:00Z")
    assert one(spark, "1785772800", M.normalized)["iso8601"] == "2026-08-03T16:00:00Z" and one(spark, "later", M.normalized)["iso8601"] is None
    assert one(spark, "ﬁ", X.nfkc_fold) == unicodedata.normalize("NFKC", "ﬁ")


@pytest.mark.parametrize("host, want", [("Example.COM.:8080", "example.com"), ("2001:DB8:0:0::1", "2001:db8::1"), ("[2001:db8::1]:443", "2001:db8::1"), ("10.0.0.1", "10.0.0.1"), ("u@h", ""), ("h/p", ""), ("  ", ""), (None, "")])
def test_hostname(spark, host, want):
    assert one(spark, host, X.hostname) == want


def test_truncated_at_whole_characters(spark):
    rows = spark.createDataFrame([("é" * 10,), ("ab",), ("a" + "日" * 9,), (None,)], "t string").select(X.truncated(F.col("t"), 6).alias("r")).collect()
    assert [(r.r.text, r.r.cut, r.r.original_bytes) for r in rows] == [("ééé", True, 20), ("ab", False, 2), ("a日", True, 28), (None, None, None)]


def test_numbered_markup_and_raw_elements():
    got = X.rich_text("<ul><li>a</li><li>b <!-- <p> --> c</li></ul><script>if (a<b) x('</p>')</script>")
    assert got["text"] == "a\nb c\nif (a<b) x('</p>')"
