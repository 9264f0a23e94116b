"""Archives: what is written comes back, also where payloads hold what opens records."""

import base64
import hashlib

import pytest

from sediment.llm import warc
from sediment.staging import staging_folder

TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1."
PAGES = [
    (5, "http://a/1", "<p>één</p>"), (3, "http://a/2", "<p>één</p>"), (9, None, ""), (7, "http://a/\r\nX: y", None), (1, "http://é/日本", "unique"),
    (4, "http://a/4", TRAP), (6, "http://a/6", TRAP), (8, "http://a/8", "WARC/1."), (2, "http://a/2", "x" * 200_000), (None, "http://a/0", "no id"),
    (1, "http://é/日本", "unique"), (11, "http://a/11", "\r\n\r\n"), (12, "http://a/12", "Content-Length: 9\r\n\r\n"),
]


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


@pytest.fixture(scope="module", params=["gzip", "none"])
def folder(spark, request):
    where = staging_folder(spark)
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    warc.write_archive(pages.repartition(2), where, compression=request.param)
    return where


def test_round_trip(spark, folder):
    records = warc.read_records(spark, folder).cache()
    assert records.count() == 3 * len(PAGES) and warc.broken_records(spark, folder).count() == 0
    first = {}
    for page, url, html in sorted(PAGES, key=lambda p: (p[0] is not None, p[0] or 0)):
        first.setdefault(html or "", page)
    found = warc.resolved(warc.captures(records)).collect()
    seen = []
    for r in found:
        page = r["metadata"]["payload"].decode()
        page = int(page.split(": ")[1]) if page else None
        capture = r["capture"]
        again = capture["type"] == "revisit"
        payload = (r["original"] if again else capture)["payload"].decode()
        seen.append((page, capture["uri"], payload))
        assert again == (first[payload] != page)
        assert (r["original"] if again else capture)["payload_digest"] == digest(payload)
        assert r["n_requests"] >= 1 and r["request"]["payload"] is not None
        if again:
            assert r["original_metadata"]["payload"].decode() == f"page_id: {first[payload]}\r\n"
    url = lambda u: u and u.replace("\r", "%0D").replace("\n", "%0A")
    assert sorted(seen, key=repr) == sorted(((p, url(u), h or "") for p, u, h in PAGES), key=repr)


def test_small_payloads_are_all_responses(spark):
    where = staging_folder(spark)
    pages = spark.createDataFrame([(i, f"u{i}", "same") for i in range(4)] + [(9, "v", "longer than it"), (10, "w", "longer than it")], "page_id long, url string, html string")
    warc.write_archive(pages, where, min_bytes=5)
    types = [r["type"] for r in warc.read_records(spark, where).where("type in ('response', 'revisit')").collect()]
    assert sorted(types) == ["response"] * 5 + ["revisit"]


def test_records_of_others(spark, tmp_path):
    """Several requests, none at all, an unknown capture, another version, a record that breaks off."""
    def record(kind, own, block, *headers):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", *headers, f"content-length: {len(block)}"]
        return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"

    text = record("warcinfo", "i", "software: own\r\n") + record("response", "r1", "plain", "Content-Type: text/plain")
    text += record("request", "q2", "b", "WARC-Concurrent-To: <r1>") + record("request", "q1", "a", "WARC-Concurrent-To: <r1>", "WARC-Concurrent-To: <r0>")
    text += record("response", "r2", "two", "Content-Type: text/plain") + record("metadata", "m", "x", "WARC-Concurrent-To: <nowhere>")
    text += "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort"
    (tmp_path / "a.warc").write_bytes(text.encode())
    records = warc.read_records(spark, str(tmp_path))
    assert records.count() == 6
    found = {r["id"]: r for r in warc.captures(records).collect()}
    assert found["<r1>"]["n_requests"] == 2 and found["<r1>"]["request"]["payload"] == b"a"
    assert found["<r2>"]["n_requests"] == 0 and found["<r2>"]["request"] is None and found["<r2>"]["metadata"] is None
    assert [bytes(r["value"])[-5:] for r in warc.broken_records(spark, str(tmp_path)).collect()] == [b"short"]


def test_no_pages(spark):
    where = staging_folder(spark)
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), where)
    assert warc.captures(warc.read_records(spark, where)).collect() == []
