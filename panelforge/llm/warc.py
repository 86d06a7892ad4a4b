"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range of an archive, looks for the gzip magic from
the range's first byte on, and takes a place for a member's start only if what inflates there decodes as a record's header
(version, type, id, length). From the first such member it goes from one to the next, each beginning in what the last one
left over of a read, and owns those that start before its range ends. So each record is read once, whatever the ranges are,
and the bytes read are those of the range and one read more at each of its ends.

Writing: of pages with equal payloads of min_bytes bytes or more, that with the largest page_id is a response; the others
are revisit records that refer to it and carry the HTTP headers alone. Payloads are equal if length and SHA-1 are.

Null payloads count as empty, null URLs are left out, and a null page_id is never referred to if its payload has another
page; rows with the same page_id get a record each, and of equal payloads under the largest page_id all are responses.
An empty table gives no archive and an empty result. Archives of other
writers are read as well: their ids are texts (record_id, refers_to_id; page_id is null), header fields may be folded, in any
case and hold any bytes; payloads are as stored, and a record without a header that can be read is an error. Other columns are ignored, whatever their names. A record is held in
memory whole, as is a page by Spark; bytes of a page or URL that are no UTF-8 become replacement characters.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, fresh_path, open_fs, out_batch, parallelism, valid_text, write_file, written

#: Bytes of an archive before the next is begun, of a reader's range, and of a read.
ARCHIVE, RANGE, CHUNK = 64 << 20, 8 << 20, 1 << 16
GZIP = b"\x1f\x8b\x08"
#: Fixed values of the format.
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "file string, size long"
RECORDS = "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, record_id string, refers_to_id string, payload binary"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(record_id: str | None) -> int | None:
    """The page of a record id that this writer gave; None for ids of others."""
    own = re.fullmatch(r"<urn:page:(-?[0-9]+)>", record_id or "")
    return int(own[1]) if own else None


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before. ValueError for a line that is no field."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"{line[:40]!r} is no header field")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def member(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as a gzip member; payload None for a revisit."""
    revisit = payload is None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse(record: bytes) -> tuple:
    """The columns of RECORDS from an inflated member."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = fields_of(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    own, other = fields["warc-record-id"], fields.get("warc-refers-to")
    url = fields.get("warc-target-uri")
    if own.startswith("<urn:page:"):  # as this writer has them
        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if fields["warc-type"] == "revisit":
        size = fields_of(http).get("content-length") if http else None
        return _page(own), "revisit", url, _page(other), None if size is None else int(size), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, own, other, None
    return _page(own), fields["warc-type"], url, _page(other), len(payload), hashlib.sha1(payload).hexdigest(), own, other, payload


def members(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """Inflated members of file (any object with seek and read) that start in [start, end)."""
    at = _first(file, start, end, size)
    if at is None:
        return
    file.seek(at)
    data = b""
    while at < min(end, size):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            data = data or file.read(CHUNK)
            if not data:
                raise ValueError(f"the member at byte {at} is cut short")
            out.append(inflate.decompress(data))
            # what the member leaves over begins the next one
            at, data = at + len(data) - len(inflate.unused_data), inflate.unused_data
        yield b"".join(out)


def _first(file, start: int, end: int, size: int) -> int | None:
    """The first place in [start, end) where a member starts: gzip magic, and the header of a WARC record behind it."""
    at, kept = start, b""
    while at - len(kept) < end:
        file.seek(at)
        data = kept + file.read(min(CHUNK, size - at))
        base, i = at - len(kept), data.find(GZIP)
        while i >= 0 and base + i < end:
            if _starts(file, base + i):
                return base + i
            i = data.find(GZIP, i + 1)
        at = base + len(data)
        if at >= size:
            return None
        kept = data[-2:]
    return None


def _starts(file, at: int) -> bool:
    """Whether what inflates at a place begins with a whole record header: version, type, id and length of the block."""
    file.seek(at)
    inflate, head = zlib.decompressobj(31), b""
    try:
        while b"\r\n\r\n" not in head and not inflate.eof:
            data = file.read(4096)
            if not data or (len(head) >= len(VERSION) and not head.startswith(VERSION)):
                return False
            head += inflate.decompress(data)
        fields = fields_of(head.partition(b"\r\n\r\n")[0])
    except (zlib.error, ValueError):
        return False
    return head.startswith(VERSION) and {"warc-type", "warc-record-id"} <= set(fields) and fields.get("content-length", "").isdigit()


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest and refers_to (null for responses)."""
    html = F.coalesce(valid_text("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), valid_text("url"), html.alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "utf-8"))})
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    kept = large.groupBy("payload_bytes", "payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a table, so that Spark can split the rows of a payload that very many pages share
    joined = rows.join(written(kept, "kept"), ["payload_bytes", "payload_digest"], "left")
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Write all pages as archives of gzip members; returns the written manifest (file, size)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return out_batch(MANIFEST, [[write_file(folder, f"pages-{part:06d}-{seq:06d}-{TaskContext.get().taskAttemptId()}.warc.gz", parts)], [size]])

        for batch in batches(rows):
            for page_id, url, html, n, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(member(page_id, url, html.encode() if refers_to is None else None, digest, n, refers_to))
                size += len(parts[-1])
                if size >= ARCHIVE:
                    yield close()
                    seq, parts, size = seq + 1, [], 0
        if parts:
            yield close()

    return written(with_revisits(pages, min_bytes).mapInArrow(run, MANIFEST), "manifest")


def read_archives(files: DataFrame, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of archives (file, size), read by byte ranges; payload is null for revisits, and if not asked for."""
    ranges = files.select("file", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes))).alias("start"))
    ranges = ranges.repartition(parallelism(files.sparkSession))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_fs(path)
                found, held = [], 0
                with fs.open_input_file(at) as file:
                    for record in members(file, start, min(size, start + range_bytes), size):
                        *meta, payload = parse(record)
                        found.append((*meta, payload if payloads else None))
                        held += len(record) if payloads else 100
                        if held > 8 << 20:
                            yield out_batch(RECORDS, [list(c) for c in zip(*found, strict=True)])
                            found, held = [], 0
                if found:
                    yield out_batch(RECORDS, [list(c) for c in zip(*found, strict=True)])

    return ranges.mapInArrow(run, RECORDS)
