import hashlib

import pytest

from playtrace.llm import warc_zstd as w
from playtrace.scratch import scratch_path

BIG = "<p>" + "é" * 800 + "</p>"
ROWS = [
    (1, "http://a/\n1", BIG), (2, None, BIG), (9, "http://b", BIG), (9, "http://b", BIG), (3, "u", "small"),
    (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (7, "u", "x" * 400_000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    path = scratch_path(spark)
    w.write_archives(pages, path)
    rows = w.read_archives(spark, path).collect()
    assert [r.error for r in rows] == [None] * len(ROWS)
    want = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        again = html == BIG and page != 9
        digest = hashlib.sha1(body).hexdigest()
        want.append((page, len(body), digest, "revisit" if again else "response", 9 if again else None, None if again else body))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in rows]
    assert sorted(map(repr, got)) == sorted(repr((*x[:5], x[5] or (x[5] if x[5] is None else b""))) for x in want)


def test_empty(spark):
    path = scratch_path(spark)
    w.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert w.read_archives(spark, path).collect() == []


def archive(n=300):
    records = [w.record_bytes(i, "u", b"body %d " % i * 50, hashlib.sha1(b"body %d " % i * 50).hexdigest(), None) for i in range(n)]
    return records, w.EMPTY_FRAME.join(w.archive_frames(records))


def test_frames():
    records, data = archive()
    assert [r for _, r in w.read_frames(data)] == records
    assert list(w.read_frames(b"")) == []
    few, small = archive(1)
    assert [r for _, r in w.read_frames(small)] == few


@pytest.mark.parametrize("cut", [4, 30, -3, -40])
def test_cut_archives_are_refused(cut):
    with pytest.raises(ValueError):
        list(w.read_frames(archive()[1][:cut]))


@pytest.mark.parametrize(
    "old, new",
    [(b"WARC/1.1", b"WARC/0.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Date", b"X-Date"), (b"body", b"BODY"), (b"sha1:", b"md5:x")],
)
def test_wrong_records_are_refused(old, new):
    record = archive(1)[0][0]
    w.parse_record(record)
    with pytest.raises(ValueError):
        w.parse_record(record.replace(old, new, 1))


def foreign(version, kind, block, *lines):
    head = [f"warc-type: {kind}", "WARC-RECORD-ID: <urn:uuid:0-1>", "Warc-Date: 2020-01-01T00:00:00Z", *lines]
    return f"{version}\r\n".encode() + "\r\n".join([*head, f"content-length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = "content-type: application/http;msgtype=response"
BODY = b"HTTP/1.1 200 OK\r\nServer: x\r\nno name here\r\n\r\nbody"
SHA256 = "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"body").hexdigest()
FOREIGN = [
    (foreign("WARC/1.0", "warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), ("warcinfo", 13, b"software: x\r\n")),
    (foreign("WARC/1.0", "request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"), ("request", 18, b"GET / HTTP/1.1\r\n\r\n")),
    (foreign("WARC/1.0", "response", BODY, HTTP, "X-Long: a\r\n b"), ("response", 4, b"body")),
    (foreign("WARC/1.1", "response", BODY, HTTP, SHA256), ("response", 4, b"body")),
    (foreign("WARC/1.1", "response", BODY.replace(b"Server: x", b"Content-Length: 9"), HTTP, "WARC-Truncated: length"), ("response", 4, b"body")),
    (foreign("WARC/1.0", "response", b"1.2.3.4", "Content-Type: text/dns"), ("response", 7, b"1.2.3.4")),
    (foreign("WARC/1.0", "revisit", b"", "WARC-Profile: p", "WARC-Refers-To: <urn:uuid:0-2>"), ("revisit", None, None)),
]


def test_records_of_other_writers(spark, tmp_path):
    for record, want in FOREIGN:
        got = w.parse_record(record)
        assert (got["record_type"], got["payload_bytes"], got["payload"]) == (want[0], want[1] and len(want[2]), want[2])
        assert (got["record_id"], got["page_id"], got["refers_to"]) == ("<urn:uuid:0-1>", None, None)
    records = [record for record, _ in FOREIGN]
    (tmp_path / "a.warc.zst").write_bytes(b"".join(w.archive_frames(records)))
    (tmp_path / "b.warc.zst").write_bytes(b"".join(map(w.zstandard.ZstdCompressor().compress, records)))
    rows = w.read_archives(spark, str(tmp_path)).collect()
    assert [r.error for r in rows] == [None] * 2 * len(FOREIGN)
    kinds = sorted(want[0] for _, want in FOREIGN * 2)
    assert sorted(r.record_type for r in rows) == kinds


@pytest.mark.parametrize(
    "record",
    [
        foreign("WARC/1.1", "response", BODY, HTTP, SHA256[:-1] + "x"),
        foreign("WARC/1.1", "response", BODY + b"y", HTTP, SHA256),
        foreign("WARC/1.1", "response", BODY.replace(b"Server: x", b"Content-Length: 9"), HTTP),
        foreign("WARC/1.1", "revisit", b"", "X: y"),
        foreign("WARC/1.1", "response", b"no head", HTTP),
    ],
)
def test_wrong_records_of_other_writers(record):
    with pytest.raises(ValueError):
        w.parse_record(record)
