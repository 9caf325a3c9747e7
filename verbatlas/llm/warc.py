"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A response record (its named fields and the HTTP message) gives two records. Both name it in
WARC-Refers-To and keep its target, date and payload digest:

- metadata (application/json): the source's WARC fields and the HTTP headers as lists of [name, value], in their
  order and with repeated names, the HTTP status, and the page's title, links and meta entries;
- conversion (text/plain): the blocks of text of the whole page, a line each. Chunked and compressed (gzip, deflate) payloads are decoded first, and
  read by the charset of the byte order mark, the Content-Type or the page's meta entry, which the metadata names; digests are those of the source as it is.

Each record has its own id and block digest; ids are name-based, so a second run, or a lost executor,
makes the same records. Records are whole rows of bytes, and ``write`` writes them as WARC files, a
gzip member for each, through Spark's own writer.

Defined results: a null page is an empty payload, a null url the target ``urn:page:<page_id>``.
Bytes that aren't of the charset are read as replacement characters; payloads that are broken, or in an unknown coding, as far as they go. A null record, and one that can't be read, gives
one row of record_type ``malformed`` whose other columns but page_id are null. Equal rows give equal records with
equal ids: drop duplicates first where ids must be unique. An empty table gives none; page_id may have any
type; columns other than those named are not read.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import json
import re
import uuid
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .html_leaves import parsed

#: Date of a response whose table has none.
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


class Record(NamedTuple):
    fields: list[tuple[str, str]]
    block: bytes

    def field(self, name: str) -> str:
        return next((v for k, v in self.fields if k.lower() == name.lower()), "")

    def to_bytes(self) -> bytes:
        """The record without the two line ends that close it in a file."""
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.fields).encode("utf-8", "replace") + CRLF + self.block


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def response(page_id: object, url: str | None, html: str | None, date: str = DATE) -> Record:
    """The response record of a page that came with status 200."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    target = one_line(url or "") or f"urn:page:{page_id}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    own = digest(payload)
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, target, own)), ("WARC-Date", date),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", own), ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return Record(fields, block)


def record_from(data: bytes) -> Record:
    """A record from its bytes; ValueError where they hold none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    size = next((int(v) for k, v in fields if k.lower() == "content-length" and v.isascii() and v.isdigit()), None)
    if size is None or len(rest) < size:
        raise ValueError("a record without its length or its whole block")
    return Record(fields, rest[:size])


def http_message(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status, headers and payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    parts = first.split(" ", 2)
    status = int(parts[1]) if len(parts) > 1 and re.fullmatch("[0-9]{1,9}", parts[1]) else 0
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def unchunked(payload: bytes) -> bytes:
    """The bytes of a payload in chunks; of a broken one those before the break."""
    out, at = [], 0
    while (end := payload.find(CRLF, at)) >= 0:
        size = payload[at:end].partition(b";")[0].strip()
        if not re.fullmatch(b"[0-9a-fA-F]{1,8}", size) or not (n := int(size, 16)):
            break
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + len(CRLF)
    return b"".join(out)


def inflated(payload: bytes, bits: int) -> bytes:
    """The bytes of a compressed payload; of a broken one those before the break. MOST_INFLATED at most, so that no small record is a huge page."""
    out, rest = [], payload
    total = 0
    while rest and total < MOST_INFLATED:
        z = zlib.decompressobj(bits)
        try:
            part = z.decompress(rest, MOST_INFLATED - total)
        except zlib.error:
            if bits == zlib.MAX_WBITS and not out:  # "deflate" without the zlib header is common
                return inflated(payload, -zlib.MAX_WBITS)
            break
        out.append(part)
        total += len(part)
        rest = z.unused_data if bits > zlib.MAX_WBITS else b""  # gzip may have several members
    return b"".join(out)


#: Bytes that a compressed payload gives at most.
MOST_INFLATED = 256 << 20
INFLATE = {"gzip": zlib.MAX_WBITS | 16, "x-gzip": zlib.MAX_WBITS | 16, "deflate": zlib.MAX_WBITS}
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.I)
MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
#: Bytes of a page in which its own name of a charset is looked for.
HEAD_BYTES = 1024


def known(charset: str) -> str:
    """Python's name of a text encoding, or none."""
    try:
        found = codecs.lookup(charset)
        b"a".decode(found.name)
    except (LookupError, ValueError):
        return ""
    return "cp1252" if found.name in ("iso8859-1", "ascii") else found.name  # as browsers read them


def body(headers: list[tuple[str, str]], payload: bytes) -> tuple[bytes, list[str]]:
    """A payload without its transfer and content encodings, and those that were taken off, in that order."""
    def named(name: str) -> list[str]:
        return [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",") if x.strip()]

    done = []
    for coding in [*reversed(named("transfer-encoding")), *reversed(named("content-encoding"))]:
        if coding == "chunked":
            payload = unchunked(payload)
        elif coding in INFLATE:
            payload = inflated(payload, INFLATE[coding])
        else:
            continue
        done.append(coding)
    return payload, done


def text_of(headers: list[tuple[str, str]], payload: bytes) -> tuple[str, str]:
    """The text of a decoded payload and the charset by which it was read: that of its byte order mark, of the Content-Type or of the page's own
    meta entry, else UTF-8; bytes that aren't of it are replaced."""
    for mark, charset in MARKS:
        if payload.startswith(mark):
            return payload[len(mark) :].decode(charset, "replace"), charset
    said = [m[1] for k, v in headers if k.lower() == "content-type" and (m := CHARSET.search(v))]
    said += [m[1] for m in CHARSET.finditer(payload[:HEAD_BYTES].decode("latin-1"))]
    charset = next((c for c in map(known, said) if c), "utf-8")
    return payload.decode(charset, "replace"), charset


def derived(source: Record) -> tuple[Record, Record]:
    """The metadata and conversion record of a response."""
    status, headers, payload = http_message(source.block)
    plain, codings = body(headers, payload)
    text, charset = text_of(headers, plain)
    page = parsed(text)
    origin, target, date = source.field("WARC-Record-ID"), source.field("WARC-Target-URI"), source.field("WARC-Date")
    payload_digest = source.field("WARC-Payload-Digest") or digest(payload)
    about = {
        "warc": source.fields, "http": {"status": status, "headers": headers},
        "html": {"title": page.title, "links": page.links, "metas": page.metas}, "payload": {"length": len(payload), "digest": payload_digest, "codings": codings, "charset": charset},
    }

    def linked(kind: str, content: str, block: bytes) -> Record:
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, origin)), ("WARC-Refers-To", origin), ("WARC-Date", date),
            ("WARC-Target-URI", target), ("WARC-Payload-Digest", payload_digest) if kind == "metadata" else ("WARC-Source-Payload-Digest", payload_digest),
            ("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block))),
        ]
        return Record(fields, block)

    lines = "\n".join(x.text for x in page.leaves)
    return (
        linked("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")),
        linked("conversion", "text/plain; charset=utf-8", lines.encode("utf-8", "replace")),
    )


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record binary): a response record for every row of (page_id, url, html)."""

    def task(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                ids, urls, bodies = (part.column(i).to_pylist() for i in range(3))
                raw = [response(i, u, h, date).to_bytes() for i, u, h in zip(ids, urls, bodies, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(task, f"page_id {dict(pages.dtypes)['page_id']}, record binary")


FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest",
}


#: The record_type of a row for what can't be read.
MALFORMED = "malformed"


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for every response in ``records`` (page_id, record): page_id, FIELDS, content_length,
    source_payload_digest, record; one row for what is no record. Other types of records are skipped."""

    def task(batches):
        for batch in batches:
            for part in slices(batch, "record"):
                rows: list[tuple[int, Record | None, str | None]] = []
                for i, raw in enumerate(part.column(1).to_pylist()):
                    try:
                        source = record_from(raw or b"")
                        made = derived(source) if source.field("WARC-Type") == "response" else ()
                    except (ValueError, LookupError, OverflowError, RecursionError):  # whatever is wrong with a record, others go on
                        rows.append((i, None, None))
                        continue
                    rows += [(i, r, source.field("WARC-Payload-Digest")) for r in made]
                text = [[r.field(f) if r else MALFORMED if f == "WARC-Type" else None for _, r, _ in rows] for f in FIELDS.values()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([i for i, _, _ in rows], pa.int64())), *[pa.array(t, pa.string()) for t in text],
                     pa.array([r and len(r.block) for _, r, _ in rows], pa.int64()), pa.array([d for _, _, d in rows], pa.string()),
                     pa.array([r and r.to_bytes() for _, r, _ in rows], pa.binary())],
                    names=["page_id", *FIELDS, "content_length", "source_payload_digest", "record"],
                )

    ddl, kind = ", ".join(f"{f} string" for f in FIELDS), dict(records.dtypes)["page_id"]
    return records.select("page_id", "record").mapInArrow(task, f"page_id {kind}, {ddl}, content_length long, source_payload_digest string, record binary")


def member(record: bytes) -> bytes:
    """A record with the line ends that close it as a gzip member, whose last byte is zero: the high byte of its
    size; after a record of 16 MB or more, an empty member ends so."""
    out = gzip.compress(record + CRLF + CRLF, mtime=0)
    return out if out.endswith(b"\0") else out + gzip.compress(b"", mtime=0)


def write(records: DataFrame, path: str) -> None:
    """WARC files under ``path``, each record a gzip member of its own; rows without a record are left out.

    Spark's text writer puts the bytes down as they are: a member's last byte, zero, is its separator.
    """

    def task(batches):
        for batch in batches:
            for part in slices(batch, "record"):
                yield pa.RecordBatch.from_arrays([pa.array([member(r)[:-1] for r in part.column(0).to_pylist()], pa.binary())], names=["value"])

    rows = records.where("record IS NOT NULL").select("record").mapInArrow(task, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)
