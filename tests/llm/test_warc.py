import hashlib
import io

import pytest
import zstandard

from loreloom.llm import warc as W

HTML = "<html>" + "x" * 200 + "é日本</html>"


def one(i, payload, **more):
    return W.record(i, "http://a/é b\r\nX: y", payload, hashlib.sha256(payload).hexdigest(), more.get("to"), more.get("revisit", False))


def archive(records, dictionary=b"", plain=False):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=d) if d else zstandard.ZstdCompressor()
    head = b"" if not dictionary else W.DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary if plain else W.dictionary_frame(dictionary)
    return head + b"".join(map(c.compress, records))


def test_reader_with_and_without_dictionary():
    samples = [one(i, (HTML * 3 + str(i) * 50).encode()) for i in range(300)]
    trained = zstandard.train_dictionary(4096, samples).as_bytes()
    for dictionary, plain in ((b"", False), (trained, False), (trained, True)):
        got = list(W.read_archive(io.BytesIO(archive(samples, dictionary, plain))))
        assert [W.page_of(*g)[0] for g in got] == list(range(300))
    assert list(W.read_archive(io.BytesIO(b""))) == []


def test_header_injection_is_encoded():
    headers, _ = W.parse_record(one(1, b"p"))
    assert headers[b"warc-target-uri"] == b"http://a/%C3%A9%20b%0D%0AX:%20y" and b"x" not in headers


@pytest.mark.parametrize("spoil", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"WARC-Date", b"Some-Date"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 2),
    lambda r: r[:-1], lambda r: r + b"x", lambda r: r.replace(b"payload", b"paiload"), lambda r: r.replace(b"\r\n\r\n", b""), lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "), lambda r: r + r,
])
def test_bad_records_fail(spoil):
    with pytest.raises(W.WarcError):
        [W.page_of(*g) for g in W.read_archive(io.BytesIO(archive([spoil(one(1, b"the payload"))])))]


def test_bad_archives_fail():
    good = archive([one(1, b"a" * 500), one(2, b"b" * 500)])
    for bad in (good[:-3], good[:-200], good + b"zz", b"abc" + good, W.DICTIONARY_MAGIC + b"\xff\0\0\0short", W.DICTIONARY_MAGIC + b"\1"):
        with pytest.raises(W.WarcError):
            list(W.read_archive(io.BytesIO(bad)))


def test_round_trip_equals_plain_reading(spark):
    rows = [(5, "http://a", HTML), (3, None, HTML), (9, "u", HTML), (3, None, HTML), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (7, "u", ""), (8, "u", "y" * 100), (6, "u", "y" * 100), (None, "u", HTML), (10, "u", "z" * 3_000_000)]
    got = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url").selectExpr("*", "1 AS digest", "2 AS payload")).collect()
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, k in rows if (k or "").encode() == p and j is not None]
        revisit = len(p) >= 100 and i != min(same)
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_urls(spark):
    urls = ["data:text/html," + "x" * 100_000, "http://a/" + "日" * 11_000]
    for url in urls:
        headers, _ = W.parse_record(W.record(1, url, b"p", hashlib.sha256(b"p").hexdigest(), None, False))
        assert len(headers[b"warc-target-uri"]) > 95_000
    rows = [(i, url, HTML * (i + 1)) for i, url in enumerate(urls)]
    got = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r[0], r[1]) for r in got) == [(i, len(h.encode())) for i, _, h in rows]
