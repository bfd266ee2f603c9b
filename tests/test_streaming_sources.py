import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreloom.operators import audit, runtime
from loreloom.sources import files, sinks
from loreloom.streaming import runs

T0 = datetime(2024, 1, 1)


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done
    return df.sparkSession.table(name).collect()


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "e")
    rows = [(i, i % 3, T0 + timedelta(seconds=s), 1.0, "k") for i, s in enumerate([0, 5, 10, 20, 30, 40, 61, 70, 80, 8000, 9000, 20000])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double, kind string")
    df.coalesce(1).write.parquet(path)
    return runs.event_stream(spark, path, df.schema), df


def test_cursor_and_idempotency(events):
    stream, table = events
    assert [r.event_id for r in runs.after(table, 3, 4).collect()] == [4, 5, 6, 7]
    assert {r.event_id for r in drain(runs.after(stream, 8), "cursor")} == {9, 10, 11}
    assert {r.event_id for r in drain(runs.first_of_key(stream.filter("event_id < 9"), ["user_id"]), "first")} == {0, 1, 2}


def test_sessions_and_windows(events):
    stream, table = events
    got = drain(runs.session_counts(stream, "user_id", "1 hour", "0 seconds"), "sessions")
    batch = {(r.user_id, r.n) for r in runtime.sessions(table, "user_id", "ts", 3600).collect()}
    assert {(r.user_id, r.n) for r in got} <= batch
    assert sum(r.n for r in drain(runs.windowed(stream, "user_id", "60 seconds", "60 seconds", "0 seconds"), "windows")) >= 9


def test_stream_rate_limit_equals_batch(events):
    stream, table = events
    got = {(r.user_id, r.event_id, r.accepted) for r in drain(runs.rate_limited(stream, "user_id", limit=2, width=60.0), "limited")}
    want = runtime.rate_limit(table.withColumn("us", F.unix_micros("ts")), "user_id", "us", "event_id", limit=2, width=60.0)
    assert got == {(r.user_id, r.event_id, r.accepted) for r in want.collect()}


def test_refused_calls_do_not_count(spark):
    calls = spark.createDataFrame([("a", i, s * 1_000_000) for i, s in enumerate([0, 1, 2, 59, 60, 61, 61])], "k string, i int, us long")
    got = [r.accepted for r in runtime.rate_limit(calls, "k", "us", "i", limit=2).orderBy("i").collect()]
    assert got == [True, True, False, False, True, True, False]


def test_trace_sink_chains_batches(spark, events, tmp_path):
    _, table = events
    path = str(tmp_path / "trace")
    add = sinks.trace_batch(spark, path, "user_id")
    rows = table.select("user_id", "event_id", "kind", "value")
    add(rows.filter("event_id < 6"), 0)
    add(rows.filter("event_id >= 6"), 1)
    add(rows.filter("event_id >= 6"), 1)  # an epoch that runs again
    got = sinks.trace_records(spark, path)
    first = [r for r in got.orderBy("event_id").collect() if r.user_id == 0]
    assert got.count() == 12 and first[0].previous_hash == "" and first[2].previous_hash == first[1].record_hash
    bad = lambda df: {r.event_id for r in audit.verify(df, "user_id", "event_id", "body").filter("NOT valid").collect()}
    assert bad(got) == set()
    assert bad(got.withColumn("body", F.when(F.col("event_id") == 4, "other").otherwise(F.col("body")))) == {4}
    assert bad(got.filter("event_id != 3")) == {6}
    swapped = got.withColumn("event_id", F.when(F.col("event_id") == 1, 4).when(F.col("event_id") == 4, 1).otherwise(F.col("event_id")))
    assert {1, 4} <= bad(swapped)


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"], "n").collect())) == [(1, "a", 1), (2, "d", 2), (3, "e", 1)]


def docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    put = {
        "a.txt": "é".encode("utf-16"), "b.md": "中文a".encode("gb18030"), "c.json": b'{"a": 1}', "d.json": b'{"a": 1, "a": 2}', "e.txt": b"  ", "f.xyz": b"?", "g.yaml": b"\xef\xbb\xbfk: v",
        "h.docx": docx(f"<w:d {w}><w:p><w:t>one</w:t></w:p><w:p/><w:p><w:t>two</w:t><w:t>!</w:t></w:p></w:d>"), "i.docx": docx("<!DOCTYPE x><x/>"), "l.docx": docx('<?xml version="1.0" encoding="utf-16"?><!DOCTYPE x [<!ENTITY e "y">]><x>&e;</x>'.encode("utf-16")), "m.docx": docx("<x>"), "j.docx": docx("<a>" + " " * 3_000_000 + "</a>"), "k.docx": b"no zip",
    }
    for name, data in put.items():
        (tmp_path / name).write_bytes(data)
    got = {r.source_name: (r.content, r.error) for r in files.read_documents(spark, str(tmp_path), {"xyz": lambda b: "plugged in"}).collect()}
    assert {k: v[0] for k, v in got.items() if v[1] is None} == {"a.txt": "é", "b.md": "中文a", "c.json": '{"a": 1}', "f.xyz": "plugged in", "g.yaml": "k: v", "h.docx": "one\n\ntwo!"}
    assert got["e.txt"] == (None, "empty") and got["i.docx"][1] == got["l.docx"][1] == "a DTD is not allowed" and got["m.docx"][1].startswith("bad XML") and got["j.docx"][1] == "the archive unpacks too far" and got["k.docx"][1] == "no DOCX"


def test_ocr_lines(spark):
    lines = spark.createDataFrame([(1, 0, "a", "0.9"), (1, 1, "b", "0.1"), (1, 2, "c", None), (1, 3, "d", "bad")], "page int, line_no int, text string, score string")
    assert [tuple(r) for r in files.ocr_text(lines).collect()] == [(1, "a\nc")]
