"""WARC derivatives: response records into linked metadata and plain-text conversion records.

A response record gives two others, each with ``WARC-Refers-To`` naming the response's record id,
its target URI and date, and digests of its own block.  The metadata record's block is JSON with the source
record's headers (its payload and block digests among them), the HTTP status and headers, the title and the
links of the page; the conversion record's block is the page's text in UTF-8.  Record ids are name-based, so that a task
that runs again writes the same records.

Defined cases: a response without an HTTP head is taken as a bare payload with status null; a null block
is empty; a null uri is left out of the headers; a repeated header has the list of its values; equal rows give equal records; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import blocks

DATE = "1970-01-01T00:00:00Z"
_LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's namespace of URLs
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length long, headers string, block binary"
NAMES = [f.split()[0] for f in RECORD.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, kind + ' ' + name)}>"


def record(kind: str, rid: str, uri: str | None, date: str, ctype: str, block: bytes, refers: str | None = None, payload: str | None = None) -> tuple:
    """The columns of ``RECORD``; ``headers`` is the head as it stands in a file."""
    own = digest(block)
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers), ("Content-Type", ctype), ("WARC-Block-Digest", own), ("WARC-Payload-Digest", payload), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    return rid, kind, refers, uri, date, ctype, own, payload, len(block), head, block


def serialise(head: str, block: bytes) -> bytes:
    return head.encode() + block + b"\r\n\r\n"


def fields(lines: list[str]) -> list[tuple[str, str]]:
    """Name and value of each header line; a line that begins with white space goes on with the value before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t"):
            if out:
                out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif colon:
            out.append((name.strip(), value.strip()))
    return out


def by_name(pairs: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """The value of each name; of a repeated one the list of its values."""
    out: dict[str, list[str]] = {}
    for name, value in pairs:
        out.setdefault(name, []).append(value)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def _records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = fields(data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        size = int(dict(head).get("Content-Length", 0))
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def parse(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of an uncompressed WARC file's content."""
    for head, block in _records(data):
        yield by_name(head), block


def _responses(date: str):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = []
                part = b.slice(lo, 256)
                for page, uri, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    body = (html or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                    rid = record_id("response", f"{page} {uri} {hashlib.sha1(body).hexdigest()}")
                    rows.append((page, *record("response", rid, uri, date, "application/http; msgtype=response", block, None, digest(body))))
                yield _batch(rows, ["page_id", *NAMES])

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "content_length": pa.int64(), "block": pa.binary()}
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, cols, strict=True)], names)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record of each row of ``pages`` (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_responses(date), "page_id long, " + RECORD)


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    status = lines[0].split(" ")
    return int(status[1]) if len(status) > 1 and status[1].isdigit() else None, fields(lines[1:]), body


def derive_one(rid: str, uri: str | None, date: str, payload: str | None, own: str, head: str, block: bytes) -> tuple[tuple, tuple]:
    """The metadata and the conversion record of one response."""
    status, sent, body = split_http(block)
    page = body.decode("utf-8", "replace")
    title = _TITLE.search(page)
    info = {
        "source": by_name(fields(head.split("\r\n")[1:])),
        "http": {"status": status, "headers": by_name(sent)},
        "html": {"title": " ".join(unescape(title.group(1)).split()) if title else None, "links": [unescape(a or b or c) for a, b, c in _LINK.findall(page)]},
        "payload": {"digest": payload or digest(body), "length": len(body)},
    }
    meta = json.dumps(info, ensure_ascii=False, separators=(",", ":")).encode()
    main, open_, _ = blocks(page)
    text = "\n".join(main + open_).encode()
    return (
        record("metadata", record_id("metadata", rid), uri, date, "application/json", meta, rid),
        record("conversion", record_id("conversion", rid), uri, date, "text/plain; charset=utf-8", text, rid),
    )


def _derive(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            rows = [r for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in derive_one(*x[:6], x[6] or b"")]
            yield _batch(rows, NAMES)


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response among ``records`` (the columns of ``RECORD``)."""
    cols = ["record_id", "target_uri", "warc_date", "payload_digest", "block_digest", "headers", "block"]
    return records.where("warc_type = 'response'").select(*cols).mapInArrow(_derive, RECORD)


def read(spark, path: str) -> DataFrame:
    """The records of uncompressed WARC files; a file is read by one task, record by record."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for pairs, block in _records(data):
                    h = dict(pairs)
                    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n"
                    rows.append((h.get("WARC-Record-ID"), h.get("WARC-Type"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("Content-Type"), h.get("WARC-Block-Digest"), h.get("WARC-Payload-Digest"), len(block), head, block))
                    if len(rows) == 256:
                        yield _batch(rows, NAMES)
                        rows = []
                yield _batch(rows, NAMES)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _linked(batches):
    """Response and derivatives of each page, side by side."""
    names = ["page_id", "url", "response_id", "metadata_id", "conversion_id", "refers_to", "payload_digest", "block_digest", "metadata_digest", "conversion_digest", "metadata", "text", "n_chars"]
    for b in batches:
        rows = []
        for page, rid, uri, date, payload, own, head, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
            m, c = derive_one(rid, uri, date, payload, own, head, block)
            text = c[10].decode()
            rows.append((page, uri, rid, m[0], c[0], c[2], payload, own, m[6], c[6], m[10].decode(), text, len(text)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("page_id", "n_chars") else pa.string()) for n, c in zip(names, cols, strict=True)], names)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    made = responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    cols = ["page_id", "record_id", "target_uri", "warc_date", "payload_digest", "block_digest", "headers", "block"]
    schema = "page_id long, url string, response_id string, metadata_id string, conversion_id string, refers_to string, payload_digest string, block_digest string, metadata_digest string, conversion_digest string, metadata string, text string, n_chars long"
    return made.select(*cols).mapInArrow(_linked, schema)
