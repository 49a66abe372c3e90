"""WARC records, and a builder of metadata and plain-text conversion records derived from responses."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, raw, small_batches

CRLF = b"\r\n"
# fixed values: elements whose content is no text, and those that end a line
_NO_TEXT = ["script", "style", "noscript", "template", "head", "svg"]
_BREAKS = "address article aside blockquote br div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul body html".split()
_HIDDEN = re.compile(rb"<(script|style|noscript|template|head|svg)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", re.S | re.I)
_CLOSED = re.compile(rb"</(script|style|noscript|template|head|svg)\s*>", re.I)
_OPENED = re.compile(rb"<(script|style|noscript|template|head|svg)\b", re.I)
_BLOCK = re.compile(("</?(?:" + "|".join(_BREAKS) + r")\b[^>]*>").encode(), re.I)
_TAG = re.compile(rb"</?[a-zA-Z][^>]*>")
_BLANKS = re.compile(rb"[ \t\r\f\v]+")
_LINES = re.compile(rb" ?\n[ \n]*")
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(rb"<a\b[^<>]*\bhref\s*=", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    """The labelled digest that WARC uses: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that depends on the parts alone, so that a task run again writes the same records."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(0).join(parts).encode()).digest(), version=5)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record's bytes: version line, headers in order, Content-Length, block."""
    if any("\r" in v or "\n" in v for _, v in headers):
        raise ValueError("a header value has a line end")
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def fields(lines: list[str]) -> list[tuple[str, str]]:
    """Header fields `name: value`, blanks around either taken off; a line that begins with a blank goes on the one before."""
    out: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}")
        elif ":" in x:
            k, v = x.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def inflated(data: bytes) -> bytes:
    """data, or what its gzip members hold, as far as they are whole."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            out.append(one.decompress(data) + one.flush())
        except zlib.error:
            break
        data = one.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse(data: bytes, strict: bool = True) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers but Content-Length, block) of each record in bytes, plain or in gzip members.

    What is no record, or one of a wrong length, raises ValueError; unless strict, it is passed over up to
    the next version line.
    """
    data, at = inflated(data), 0
    while at < len(data):
        try:
            end = data.find(CRLF + CRLF, at)
            if end < 0 or data[at : at + 5] != b"WARC/":
                raise ValueError("no WARC record here")
            headers = fields(_text(data[at:end]).split("\r\n")[1:])
            size = next((v for k, v in headers if k.lower() == "content-length"), "")
            start = end + 4
            if not (size.isascii() and size.isdigit()) or data[start + int(size) : start + int(size) + 4] != CRLF + CRLF:
                raise ValueError("a record's length is wrong")
        except ValueError:
            if strict:
                raise
            at = data.find(b"\nWARC/", at + 1) + 1
            if not at:
                return
            continue
        yield [(k, v) for k, v in headers if k.lower() != "content-length"], data[start : start + int(size)]
        at = start + int(size) + 4


def response(url: str, date: str, body: bytes, content_type: str = "text/html; charset=utf-8") -> bytes:
    """A response record for a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: " + content_type.encode() + b"\r\nContent-Length: " + str(len(body)).encode() + CRLF + CRLF + body
    uri = "".join(c for c in url if c not in "\r\n")
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", uri, date, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http;msgtype=response")], http)


def plain_text(body: bytes) -> bytes:
    """The text of an HTML page: without hidden elements, tags and comments; blocks end lines; entities resolved.

    An open comment hides the rest; a hidden element that is never closed hides nothing.  Time is linear in
    the page's length, whatever it holds: the patterns run only where each of their beginnings has an end.
    """
    if (open_comment := body.find(b"<!--", body.rfind(b"-->") + 1)) >= 0:
        body = body[:open_comment]
    last = body.rfind(b">") + 1
    body, tail = body[:last], body[last:]
    closed = {m[1].lower(): m.start() for m in _CLOSED.finditer(body)}
    if any(m.start() > closed.get(m[1].lower(), -1) for m in _OPENED.finditer(body)):
        x = _visible(body)
    else:
        x = _HIDDEN.sub(b" ", body)
    x = x.replace(b"\n", b" ")
    x = _BLOCK.sub(b"\n", x)
    x = _TAG.sub(b"", x) + tail.replace(b"\n", b" ")
    if b"&" in x:
        x = html.unescape(x.decode("utf-8", "replace")).replace("\xa0", " ").encode("utf-8", "replace")
    return _LINES.sub(b"\n", _BLANKS.sub(b" ", x)).strip()


def _visible(body: bytes) -> bytes:
    """_HIDDEN.sub(b" ", body), where a search for the end of an element that has none is made once."""
    low, out, at = body.lower(), [], 0
    ends = {name.encode(): re.compile(f"</{name}\\s*>".encode()) for name in _NO_TEXT}
    for m in re.finditer(rb"<(?:!--|!doctype|(script|style|noscript|template|head|svg)\b)", low):
        if m.start() < at:
            continue
        if m[1] is None:
            stop = b"-->" if m[0] == b"<!--" else b">"
            end = low.find(stop, m.end()) + len(stop)
            if end < len(stop):
                continue
        else:
            begun = low.find(b">", m.end())
            found = ends[m[1]].search(low, begun) if begun >= 0 and ends[m[1]] else None
            if not found:
                ends[m[1]] = None
                continue
            end = found.end()
        out += [body[at : m.start()], b" "]
        at = end
    return b"".join([*out, body[at:]])


def payload(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """HTTP headers and body of a response block."""
    head, _, body = block.partition(CRLF + CRLF)
    return fields(head.decode("latin-1").split("\r\n")[1:]), body


def decoded(http: list[tuple[str, str]], body: bytes) -> bytes:
    """The body as UTF-8 text's bytes: chunks joined, gzip and deflate undone, the charset of the header's turned.

    What can't be undone stays as it is.
    """
    h = {k.lower(): v.lower() for k, v in http}
    if "chunked" in h.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := body.find(CRLF, at)) >= 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not size:
                break
            out.append(body[end + 2 : end + 2 + size])
            at = end + 2 + size + 2
        body = b"".join(out) or body
    if h.get("content-encoding", "") in ("gzip", "x-gzip"):
        body = inflated(body)
    elif h.get("content-encoding", "") == "deflate":
        for bits in (15, -15):
            with contextlib.suppress(zlib.error):
                body = zlib.decompress(body, bits)
                break
    charset = _CHARSET.search(h.get("content-type", ""))
    if charset and charset[1] not in ("utf-8", "utf8"):
        with contextlib.suppress(LookupError, UnicodeError):
            body = body.decode(charset[1], "replace").encode()
    return body


def _title(body: bytes) -> bytes:
    """What the first title element holds."""
    low = body.lower()
    i = low.find(b"<title")
    j = low.find(b">", i) + 1 if i >= 0 else 0
    end = low.find(b"</title", j) if j else -1
    return body[j:end] if end >= 0 else b""


def _language(body: bytes) -> str:
    i = body.lower().find(b"<html")
    found = _LANG.search(body, i, body.find(b">", i) + 1) if i >= 0 else None
    return found[1].decode() if found else ""


def derive(source: list[tuple[str, str]], block: bytes) -> list[bytes]:
    """The metadata and the conversion record of a response record; none for other types, or without an id or a date.

    Both refer to the response's id and carry its target, date and payload digest; the metadata record links to
    the conversion (WARC-Concurrent-To), and its block keeps the source's headers.
    """
    h = {k.lower(): v for k, v in source}
    own, date = h.get("warc-record-id"), h.get("warc-date")
    if h.get("warc-type") != "response" or not own or not date:
        return []
    http, body = payload(block)
    page = decoded(http, body)
    text = plain_text(page)
    uri = h.get("warc-target-uri", "")
    payload_digest = h.get("warc-payload-digest") or digest(body)
    names = [record_id("metadata", own), record_id("conversion", own)]
    shown = b" ".join(_title(page).split()).decode("utf-8", "replace")
    fields = [("title", html.unescape(shown)), ("language", _language(page)), ("outlinks", str(len(_LINK.findall(page)))), ("text-length", str(len(text))), ("payload-digest-valid", str(digest(body) == payload_digest).lower())]
    fields += [(f"source-{k}", v) for k, v in source] + [(f"http-{k}", v) for k, v in http]
    info = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = []
    for kind, name, other, mime, data in (("metadata", names[0], names[1], "application/warc-fields", info), ("conversion", names[1], names[0], "text/plain; charset=utf-8", text)):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", other), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(data)), ("Content-Type", mime)]
        out.append(record([(k, v) for k, v in headers if v], data))
    return out


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record): a response record of each page.  A null url is an empty target, null html an empty body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            out = [response(u or "", date, b or b"") for u, b in zip(batch.column(1).to_pylist(), raw(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page_id", "record"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return map_arrow(rows, run, f"page_id {kind}, record binary")


COLUMNS = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, payload_digest string, block_digest string, content_length long"


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record", with_data: bool = True) -> DataFrame:
    """One row for each metadata and conversion record of the response records in `records`.

    Columns: page_id, record_type, record_id, refers_to, concurrent_to, target_uri, date, payload_digest (of the
    source), block_digest, content_length, text (a conversion's plain text) and, with_data, data (the record's
    bytes).  A value may hold several records, plain or in gzip members; null and empty values give none, nor do
    records that are no responses or damaged, after which reading goes on at the next version line.  Ids follow from the source's id alone; repeated rows give repeated rows.  No shuffle.
    """
    kind = records.schema[id_col].dataType.simpleString()
    keys = ["warc-type", "warc-record-id", "warc-refers-to", "warc-concurrent-to", "warc-target-uri", "warc-date", "warc-source-payload-digest", "warc-block-digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "record"):
            rows: list[tuple] = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for source, block in parse(data or b"", strict=False):
                    for made in derive(source, block):
                        headers, own = next(parse(made))
                        h = {k.lower(): v for k, v in headers}
                        rows.append((i, *(h.get(k) for k in keys), len(own), own.decode("utf-8", "replace") if h["warc-type"] == "conversion" else None, *([made] if with_data else [])))
            if rows:
                kinds = [batch.schema.types[0], *[pa.string()] * 8, pa.int64(), pa.string(), *([pa.binary()] if with_data else [])]
                names = ["page_id", *[c.split()[0] for c in COLUMNS.split(", ")], "text", *(["data"] if with_data else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = records.select(records[id_col].alias("page_id"), records[record_col].alias("record"))
    return map_arrow(rows, run, f"page_id {kind}, {COLUMNS}, text string" + ", data binary" * with_data)
