import base64
import hashlib
import io
import uuid
import zlib
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import SF
from wayloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, last long, hot_key string, file string"


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def want(pages):
    last = {}
    for i, _, html in pages:
        k = html or ""
        last[k] = i if k not in last or last[k] is None else max(last[k], i if i is not None else last[k])
    out = []
    for i, _, html in pages:
        m, b = last[html or ""], (html or "").encode()
        again = m is not None and i != m
        out.append((i, len(b), sha(b), "revisit" if again else "response", m if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
@settings(max_examples=150, deadline=None)
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([iter(sorted(r)) for r in runs])) == sorted(x for r in runs for x in r)


def test_records_round_trip():
    payload = "é<p>\r\n\r\n".encode() * 3
    r = warc.parsed(warc.record("7", "response", "http://a/b c\r\nX: y", "2020-01-01T00:00:00Z", sha(payload), len(payload), None, payload))
    assert (r["payload"], r["digest"], r["payload_bytes"], r["url"]) == (payload, sha(payload), len(payload), "http://a/b%20c%0D%0AX:%20y")
    v = warc.parsed(warc.record("8", "revisit", None, "2020-01-01T00:00:00Z", sha(payload), len(payload), "7", b""))
    assert (v["payload_bytes"], v["digest"], v["refers_to"], v["url"]) == (len(payload), sha(payload), "7", None)
    data = b"".join(zlib.compress(x, wbits=31) for x in (b"a" * 200_000, b"", b"b"))
    assert [m[2] for m in warc.members(io.BytesIO(data))] == [b"a" * 200_000, b"", b"b"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


def test_edge_cases(spark, monkeypatch):
    pages = [(1, "http://b.example.com/x", "same"), (5, "http://www.a.example.com:80/x?q#f", "same"), (3, None, "same"), (None, "not a url", "same"), (2, "http://b.example.com/x", None), (4, "", ""), (7, "http://é.fr/ü", "é" * 300_000), (7, "http://é.fr/ü", "é" * 300_000), (None, None, "alone"), (None, None, "alone"), (2**53 + 1, "http://b.example.com/x", "z")]
    frame = spark.createDataFrame([(*p, "c", 1, "h", "f") for p in pages], SCHEMA)
    monkeypatch.setattr(warc, "table", lambda *a: frame)
    for share in (1000, 3):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        df = warc.op11_capture_histories(spark, "")
        assert got(df) == want(pages)
        assert sorted(r.capture_order for r in df.collect()) == list(range(len(pages)))
    empty = spark.createDataFrame([], SCHEMA)
    monkeypatch.setattr(warc, "table", lambda *a: empty)
    assert warc.op11_capture_histories(spark, "").collect() == []


def test_runs_merge_into_one_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MERGE_ROWS", 40)
    when = [datetime(2020, 1, 1 + (i * 7) % 28, microsecond=i * 3001, tzinfo=timezone.utc) for i in range(300)]
    rows = [(i, f"http://{'hot' if i % 3 else 'h%d' % (i % 20)}.org/p{i % 2}", when[i], f"body {i % 150}".encode()) for i in range(300)]
    caps = spark.createDataFrame(rows, "id long, url string, time timestamp, payload binary").repartition(7)
    path = str(tmp_path / "w")
    warc.write(caps, path, file_bytes=4000)
    runs = warc.read(spark, path, payload=False)
    assert runs.select("file").distinct().count() > 7
    index = warc.merged(runs)
    seen = [(r.url_key, r.time, r.record_id) for r in index.orderBy("capture_order").collect()]
    assert len(seen) == 300 and seen == sorted(seen)
    assert index.where("url_key LIKE 'org,hot)%'").select("capture_order").distinct().count() == 200
    back = {r.record_id: bytes(r.payload) for r in warc.fetched(index.where("record_type = 'response'"), path).collect()}
    assert back == {str(i): p for i, _, _, p in rows if i >= 150}
    assert {r.record_id: r.payload and bytes(r.payload) for r in warc.read(spark, path).collect()} == {str(i): p if i >= 150 else None for i, _, _, p in rows}
    (tmp_path / "w" / f"{uuid.uuid4().hex}.warc.gz").write_bytes(b"left by a failed attempt")
    assert warc.read(spark, path).count() == 300


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(warc.op11_capture_histories(spark, SF)) == want(pages)
