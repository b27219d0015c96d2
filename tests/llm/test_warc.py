import gzip
import hashlib
import base64
import io

import pytest

from tracewell.llm.warc import members, parse, read_archives, record, round_trip, write_archives

ROWS = [(5, "http://a/x y", "<p>ä</p>", 1), (3, None, "<p>ä</p>", 1), (9, "u", None, 1), (8, "u", "", 2), (1, "u\r\nX: y", "x" * 70000, 3), (4, "u", "solo", 3)]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string, payload int")
    got = {r.page_id: r for r in round_trip(spark, pages, str(tmp_path / "w")).collect()}
    first = {}
    for i, _, h, _ in sorted(ROWS):
        first.setdefault(h or "", i)
    assert len(got) == len(ROWS)
    for i, _, h, _ in ROWS:
        r, of = got[i], first[h or ""]
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), digest(h))
        assert (r.record_type, r.refers_to) == (("response", None) if of == i else ("revisit", of))


def test_payloads_come_back_and_small_ones_are_not_revisits(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string, payload int")
    folder = str(tmp_path / "w")
    back = read_archives(write_archives(pages, folder, least_revisit_bytes=100), folder, with_payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in back} == {i: h or "" for i, _, h, _ in ROWS}
    assert {r.record_type for r in back} == {"response"}


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path)).count() == 0


def test_members_are_plain_gzip_and_read_in_small_chunks():
    data = record(1, "u", b"abc", None) + record(2, "u", b"abc", 1)
    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    found = [parse(m) for m in members(io.BytesIO(data), chunk=7)]
    assert [(r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found] == [("response", None, 3), ("revisit", 1, 3)]


def test_damage_is_refused():
    data = record(1, "u", b"abcdef", None)
    with pytest.raises(ValueError):
        list(members(io.BytesIO(data[:-4])))
    plain = gzip.decompress(data)
    for bad in (plain.replace(b"abcdef", b"abcdeg"), plain[:-1], plain.replace(b"WARC/1.1", b"XARC/1.1")):
        with pytest.raises(ValueError):
            parse(bad)
