"""WARC derivatives: responses into linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm._text import trimmed

#: Fixed values of the format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
SPACE_NAMES = uuid.NAMESPACE_URL
#: Rows of an Arrow batch that are turned into records at once.
ROWS = 500
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*?\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_BREAK = re.compile(
    r"</?(?:p|div|article|section|main|header|footer|nav|aside|form|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|body|html|br|hr|figure|figcaption|option)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
Headers = list[tuple[str, str]]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(name: str) -> str:
    """A record's identifier, the same whenever it is made from the same name."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_NAMES, name)}>"


def build(headers: Headers, block: bytes) -> bytes:
    """A record; Content-Length and the block's digest are added."""
    lines = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    # A line end inside a value would begin another header.
    head = CRLF.join(f"{k}: {' '.join(v.split())}".encode() for k, v in lines)
    return VERSION + CRLF + head + CRLF + CRLF + block + CRLF + CRLF


def read_headers(raw: bytes) -> tuple[bytes, Headers]:
    """The first line, and the headers after it; a line that begins with white space continues the one before."""
    first, _, rest = raw.partition(b"\n")
    out: Headers = []
    for line in rest.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {text.strip()}"
        elif ":" in text:
            k, _, v = text.partition(":")
            out.append((k.strip(), v.strip()))
    return first.rstrip(b"\r"), out


def split_head(raw: bytes) -> tuple[bytes, bytes]:
    """What stands before and after the first empty line."""
    ends = [(raw.find(x), len(x)) for x in (b"\r\n\r\n", b"\n\n") if x in raw]
    if not ends:
        return raw, b""
    at, n = min(ends)
    return raw[:at], raw[at + n :]


def value(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def parse(record: bytes) -> tuple[Headers, bytes]:
    """Headers and block of a record; ValueError says what is wrong with it."""
    head, rest = split_head(record)
    first, headers = read_headers(head)
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC version")
    n = value(headers, "content-length")
    if n is None or not n.isdigit():
        raise ValueError("no Content-Length")
    if len(rest) < int(n):
        raise ValueError("block shorter than Content-Length")
    return headers, rest[: int(n)]


def payload(http: Headers, body: bytes) -> bytes:
    """The body without transfer and content codings; what can't be decoded stays as it is."""
    try:
        if "chunked" in (value(http, "transfer-encoding") or "").lower():
            out, at = [], 0
            while True:
                end = body.index(b"\r\n", at)
                n = int(body[at:end].split(b";")[0], 16)
                if not n:
                    break
                out.append(body[end + 2 : end + 2 + n])
                at = end + 4 + n
            body = b"".join(out)
        coding = (value(http, "content-encoding") or "").lower()
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
    except (ValueError, OSError, EOFError, zlib.error):
        pass
    return body


def decode(http: Headers, body: bytes) -> str:
    named = _CHARSET.search((value(http, "content-type") or "").encode()) or _CHARSET.search(body[:1024])
    try:
        return body.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(html: str) -> str:
    """All text a reader sees: one line for each block, with one space for white space inside it."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", html.replace("\r", " ").replace("\n", " "))))
    return "\n".join(y for x in text.split("\n") if (y := " ".join(unescape(x).split())))


def outlinks(html: str, base: str) -> list[str]:
    """The addresses that a page's links lead to, in page order, made whole by the page's own address."""
    out = []
    for link in _LINK.findall(_HIDDEN.sub("", html)):
        at = unescape(link.strip("\"'")).strip()
        try:
            out.append(urljoin(base, at))
        except ValueError:  # no address at all
            out.append(at)
    return out


def response_record(url: str | None, html: str | None, name: str, date: str) -> bytes:
    """A response as a crawler stores it."""
    body = (html or "").encode()
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode(), b"", b""]) + body
    return build([("WARC-Type", "response"), ("WARC-Record-ID", identifier(name)), ("WARC-Date", date), ("WARC-Target-URI", url or ""),
                  ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")], block)


def derive(record: bytes) -> list[tuple]:
    """(kind, id, refers_to, uri, date, content type, length, digest, source digests, record, problem): metadata and conversion, or one invalid row."""
    try:
        headers, block = parse(record)
        if (value(headers, "warc-type") or "").lower() != "response":
            raise ValueError("not a response")
        source = value(headers, "warc-record-id")
        if not source:
            raise ValueError("no WARC-Record-ID")
        stated = value(headers, "warc-block-digest")
        if stated and stated.startswith("sha1:") and stated != digest(block):
            raise ValueError("block differs from its digest")
    except ValueError as e:
        return [("invalid", None, None, None, None, None, None, None, None, None, None, str(e))]
    head, body = split_head(block)
    status, http = read_headers(head)
    text = payload(http, body)
    html = decode(http, text)
    is_html = "html" in (value(http, "content-type") or "html").lower()
    uri, date = value(headers, "warc-target-uri") or "", value(headers, "warc-date") or ""
    names = {k: identifier(f"{source}#{k}") for k in ("metadata", "conversion")}
    stated_payload = value(headers, "warc-payload-digest")
    title = " ".join(unescape(_TITLE.search(html)[1]).split()) if is_html and _TITLE.search(html) else ""
    fields = [("http-status", " ".join(status.decode("utf-8", "replace").split()[1:])), *[(f"http-header-{k.lower()}", v) for k, v in http],
              *[(f"source-{k.lower()}", v) for k, v in headers], ("title", title), *[("outlink", x) for x in (outlinks(html, uri) if is_html else [])], ("conversion", names["conversion"])]
    blocks = {"metadata": CRLF.join(f"{k}: {' '.join(v.split())}".encode() for k, v in fields) + CRLF, "conversion": (plain_text(html) if is_html else html).encode()}
    kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    out = []
    for kind in ("metadata", "conversion"):
        extra = [("WARC-Source-Block-Digest", stated or digest(block)), ("WARC-Source-Payload-Digest", stated_payload or digest(body))]
        made = build([("WARC-Type", kind), ("WARC-Record-ID", names[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source),
                      ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), *extra, ("Content-Type", kinds[kind])], blocks[kind])
        out.append((kind, names[kind], source, uri, date, kinds[kind], len(blocks[kind]), digest(blocks[kind]), extra[0][1], extra[1][1], made, None))
    return out


COLUMNS = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, "
    "source_block_digest string, source_payload_digest string, record binary, problem string")


#: Stands for a date that nobody knows.
NO_DATE = "1970-01-01T00:00:00Z"


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """key and record, a WARC response for each page.  The identifier is made from key and address, so equal rows have equal records.

    date: a column with the time of the crawl (a timestamp, or text as the format has it); without one, or where it is
    null, NO_DATE stands.  A null url or html counts as empty; a null key is a key like any other; an empty table gives no rows.
    """
    when = F.lit(None) if date is None else F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'") if pages.schema[date].dataType.typeName().startswith("timestamp") else pages[date].cast("string")
    rows = pages.select(
        pages[key].alias("_key"), F.concat_ws(" ", F.coalesce(pages[url].cast("string"), F.lit("")), pages[key].cast("string")).alias("name"), pages[url].cast("string"), pages[html].cast("string"),
        F.coalesce(when.cast("string"), F.lit(NO_DATE)).alias("when"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                made = [response_record(u, h, n, d) for n, u, h, d in zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["_key", "record"])

    out = rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, record binary")
    return out.withColumnRenamed("_key", key)


def derivatives(records: DataFrame, key: str = "page_id", record: str = "record") -> DataFrame:
    """key and COLUMNS: for each response record its metadata and its conversion record, which name it in WARC-Refers-To.

    The metadata record holds the response's HTTP and WARC headers, title and links, and names the conversion; both carry
    the response's block and payload digests.  record is the whole derived record: the records of a table, written one after the
    other, are a WARC file.  Null, broken and other records give one row of type invalid with the problem; repeated rows are
    converted one by one; an empty table gives no rows; other columns are not read.
    """
    rows = records.select(records[key].alias("_key"), records[record].alias("_record"))
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kinds = [pa.int64() if n == "content_length" else pa.binary() if n == "record" else pa.string() for n in names]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                made = [derive(x or b"") for x in part.column(1).to_pylist()]
                at = pa.array([i for i, m in enumerate(made) for _ in m])
                cells = list(zip(*(r for m in made for r in m), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=["_key", *names])

    out = rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, {COLUMNS}")
    return out.withColumnRenamed("_key", key)
