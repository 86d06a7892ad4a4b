import gzip
import hashlib
import io
import random

import pytest

from panelforge.llm import warc


def archive():
    draw = random.Random(1)
    payloads = [bytes(draw.randrange(256) for _ in range(draw.choice([0, 10, 4000]))) + warc.GZIP * draw.randrange(3) for _ in range(60)]
    parts = [warc.member(i, f"http://x/{i}\r\n%0A", p, hashlib.sha1(p).hexdigest(), len(p), None) for i, p in enumerate(payloads)]
    return payloads, parts


@pytest.mark.parametrize("step", [1, 7, 100, 5000, 1 << 30])
def test_each_record_is_owned_once(step):
    payloads, parts = archive()
    if step == 1:
        parts, payloads = parts[:4], payloads[:4]
    data = b"".join(parts)
    found = [warc.parse(m) for lo in range(0, len(data), step) for m in warc.members(io.BytesIO(data), lo, min(len(data), lo + step), len(data))]
    assert [f[0] for f in found] == list(range(len(payloads))) and [f[-1] for f in found] == payloads
    assert found[1][2] == "http://x/1\r\n%0A"


def test_cut_short():
    data = archive()[1][2][:-4]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data), 0, len(data), len(data)))


def test_round_trip(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "u1", big), (7, None, big), (3, "u3", big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (8, "u8", other), (8, "u8", other), (9, "u9", "y" * 200_000), (None, "n", big)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, refers_to int")
    manifest = warc.write_archives(pages)
    found = warc.read_archives(manifest, range_bytes=100).collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 7
        want.append((page, "revisit" if revisit else "response", 7 if revisit else None, len(data), hashlib.sha1(data).hexdigest()))
    assert got == sorted(want, key=str)
    assert {r["page_id"]: r["url"] for r in found}[7] is None
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in found)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


class Counted(io.BytesIO):
    n = 0

    def read(self, size=-1):
        data = super().read(size)
        self.n += len(data)
        return data


def test_reads_little_more_than_the_archive():
    draw = random.Random(2)
    payloads = [draw.randbytes(200) for _ in range(20_000)]
    data = b"".join(warc.member(i, None, p, hashlib.sha1(p).hexdigest(), len(p), None) for i, p in enumerate(payloads))
    file, step = Counted(data), 2 << 20
    assert sum(1 for lo in range(0, len(data), step) for _ in warc.members(file, lo, min(len(data), lo + step), len(data))) == len(payloads)
    assert file.n <= 1.1 * len(data)


def test_a_member_without_the_header_is_no_record():
    """Gzip members within a stored payload are passed over unless they decode as a record's header."""
    fakes = [gzip.compress(b"WARC/1.1\r\nno header\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"), gzip.compress(b"text"), warc.GZIP * 3]
    head = gzip.compress(b"x", 0)
    real = warc.member(1, None, b"p", hashlib.sha1(b"p").hexdigest(), 1, None)
    data = b"".join(fakes) + head + real
    found = [warc.parse(m)[0] for m in warc.members(io.BytesIO(data), 0, len(data), len(data))]
    assert found == [1]


def test_bytes_that_are_no_utf8(spark):
    pages = spark.sql("SELECT 1L AS page_id, CAST(X'75FF' AS STRING) AS url, CAST(X'FF41' AS STRING) AS html")
    row = warc.read_archives(warc.write_archives(pages)).first()
    assert bytes(row["payload"]) == "\ufffdA".encode() and row["url"] == "u\ufffd"


def foreign():
    """Records as other writers make them: ids of their own, lower-case names, folded lines, bytes that are no UTF-8, records that aren't HTTP."""
    body = b"x" * 3000 + b"\xff\xfe"
    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n" + body
    info = b"software: other\r\n"
    heads = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(info) + info,
        b"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID: <urn:uuid:5f2c-1>\r\nWARC-Target-URI: http://a/%41\xff\r\nX-Note: one\r\n\ttwo\r\ncontent-type: application/http; msgtype=response\r\ncontent-length:" + str(len(http)).encode() + b"\r\n\r\n" + http,
        b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:5f2c-2>\r\nWARC-Refers-To: <urn:uuid:5f2c-1>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n",
    ]
    return [gzip.compress(h + b"\r\n\r\n") for h in heads] * 20, body


def test_archives_of_others(spark, tmp_path):
    made, body = foreign()
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(made))
    files = spark.createDataFrame([(str(path), path.stat().st_size)], warc.MANIFEST)
    for size in (100, 1000, 1 << 20):
        found = warc.read_archives(files, size).collect()
        assert len(found) == 60
        by = {r["record_id"]: r for r in found}
        page, again, info = by["<urn:uuid:5f2c-1>"], by["<urn:uuid:5f2c-2>"], by["<urn:uuid:0>"]
        assert bytes(page["payload"]) == body and page["payload_digest"] == hashlib.sha1(body).hexdigest() and page["url"] == "http://a/%41\ufffd" and page["page_id"] is None
        assert (again["record_type"], again["refers_to_id"], again["payload_digest"], again["payload_bytes"]) == ("revisit", "<urn:uuid:5f2c-1>", "ABC", None)
        assert info["record_type"] == "warcinfo" and bytes(info["payload"]).startswith(b"software")


def test_a_record_that_can_not_be_read_is_an_error():
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.0\r\nWARC-Type: response\r\nno field\r\n\r\n")
