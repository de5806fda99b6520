"""WARC archives: exact round trip, record types by brute force, merges of many runs, awkward pages."""

import base64
import hashlib

import pytest

from seqwright.llm import warc
from seqwright.llm.common import written

SCHEMA = "page_id bigint, url string, html string, record_type string, size int"


def pages():
    rows = [(i, f"http://WWW.h{i % 7}.org/p{i % 11}?q={i}#f", f"<p>é {i % 23}" * (i % 5), "x", 1) for i in range(120)]
    rows += [(500, None, None, "x", 1), (501, "", "", "x", 1), (502, "no scheme \n", "\r\n\r\n", "x", 1), (None, "http://a/", "only", "x", 1),
             (None, "ftp://u@b:21", "<p>é 1", "x", 1), (-3, "http://c:80", "z" * 300_000, "x", 1)]
    return rows + [rows[5]]


def want(rows):
    first = {}
    for i, _, html, *_ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        f = first.get(html or "")
        revisit = f is not None and f != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_records_and_index(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    monkeypatch.setattr(warc, "RUN_ROWS", 9)
    rows, path = pages(), str(tmp_path / "a")
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    warc.write_archives(d, path, archive_bytes=2000)
    runs = written(warc.capture_runs(spark, path), "runs")
    for fan_in, size in ((256, None), (2, 20)):
        got = warc.merged_index(runs, fan_in=fan_in, range_rows=size).collect()
        keys = [warc.sort_key(r.url_key, r.ts, r.page_id) for r in got]
        assert keys == sorted(keys)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    back = sorted((str(r.page_id), bytes(r.payload)) for r in warc.replayed(spark, path).collect())
    assert back == sorted((str(r[0]), (r[2] or "").encode()) for r in rows)


def test_keys_empty_table_and_damage(spark):
    assert warc.url_key("HTTP://www.A.b.org:80/X?y#z") == "org,b,a)/X?y" and warc.url_key(None) == "-"
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0
    raw = warc.encode_record(1, "http://a/", "20200101000000", b"abc", base64.b32encode(hashlib.sha1(b"abd").digest()).decode())
    with pytest.raises(ValueError):
        warc.decode_record(next(warc.members(raw))[2])
