"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

For every response (record id, URI, date, HTTP message) the builder emits a
``metadata`` record (application/warc-fields: every header of the source as it
stands, in order and with repeats, then title, language and out-links) and a
``conversion`` record (text/plain).  Both refer to the response by WARC-Refers-To;
block and payload digests are SHA-1 in base 32.  Record ids are name-based, so a
run that is repeated gives the same ids.

Defined results: a null body is an empty one, a null URI is empty; each input row
gives two records, repeated rows too (with equal ids); markup that is not closed
runs to the end; a charset that is unknown or cannot decode the body counts as
UTF-8, and halves of surrogate pairs become replacement characters, as do numeric
references of more than seven digits; control characters and blanks in a URI are
percent-encoded and those in other header values become blanks, so no value ends
its line; a chunked body ends where a chunk's size cannot be read, what follows is
kept as it stands; bodies may be of any length, all patterns read each character
a bounded number of times; a WARC file that is cut off or malformed is a
ValueError, its records are read one after another, and one file holds at most 2 GB
as stored (Spark's limit for a binary value); an empty table gives an empty table; other columns,
whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*+(?:\Z|>.*?(?:</\1\s*+>|\Z))", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|title|blockquote|pre)\b[^>]*+>?", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*+>?")
_GAPS = re.compile(r"[ \t\r\f\v]{2,}|[\t\r\f\v]")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*+>?", re.I)
_TITLE_END = re.compile(r"</title", re.I)
_ANCHOR = re.compile(r"<a\b([^>]*+)", re.I)
_HREF = re.compile(r"\bhref\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]+))", re.I)
_HTML = re.compile(r"<html\b([^>]*+)", re.I)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z-]+)", re.I)
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")
_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")
RECORDS = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, refers_to_payload_digest string, headers string, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, chr(10).join(parts))}>"


def response(uri: str, body: str) -> bytes:
    """The HTTP message of a page, as a response record's block holds it."""
    raw = body.encode("utf-8", "replace")
    return HTTP_HEAD.format(n=len(raw)).encode() + raw


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order (folded lines joined) and payload of an HTTP message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("latin-1")).splitlines()
    fields = [(name.strip(), value.strip()) for name, _, value in (x.partition(":") for x in lines[1:])]
    if first(fields, "transfer-encoding").lower() == "chunked":
        body = _unchunk(body)
    return (lines[0] if lines else ""), fields, body


def first(fields: list[tuple[str, str]], name: str) -> str:
    """The first header of that name (small letters), or nothing."""
    return next((v for k, v in fields if k.lower() == name), "")


def _unchunk(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n", at)
        size = data[at : end if end >= 0 else None].split(b";")[0].strip()
        if end < 0 or not size or size.strip(b"0123456789abcdefABCDEF"):
            out.append(data[at:])
            break
        n = int(size, 16)
        if n == 0:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def unescaped(text: str) -> str:
    """Character references as characters; a number that is no character of Unicode, however long, as U+FFFD."""
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


def header_uri(uri: str) -> str:
    """A URI as it may stand in a header: control characters and blanks percent-encoded."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def plain_text(markup: str) -> str:
    """Text of markup without hidden parts: a line for each block, runs of blanks as one."""
    text = _BLOCK.sub("\n", markup)
    text = unescaped(_TAG.sub("", text))
    return _LINES.sub("\n", _GAPS.sub(" ", text.replace("\xa0", " "))).strip()


def links(markup: str) -> list[str]:
    found = (_HREF.search(x[1]) for x in _ANCHOR.finditer(markup))
    return [unescaped(m[1] or m[2] or m[3] or "").strip() for m in found if m]


def title_of(markup: str) -> str:
    start = _TITLE.search(markup)
    if not start:
        return ""
    end = _TITLE_END.search(markup, start.end())
    return " ".join(unescaped(markup[start.end() : end.start() if end else None]).split())


def decoded(body: bytes, content_type: str) -> str:
    found = re.search(r"charset\s*+=\s*+\"?([\w-]+)", content_type, re.I)
    try:
        text = body.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):  # unknown, or no encoding of texts
        return body.decode("utf-8", "replace")
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # some encodings hold halves of pairs


def derive(source_id: str, uri: str, date: str, block: bytes) -> list[tuple]:
    """The two derived records of a response: (type, id, refers-to, uri, date, content type, block digest, payload digest, source's payload digest, header text, block)."""
    status, fields, body = split_http(block)
    markup = decoded(body, first(fields, "content-type"))
    source_digest = digest(body)
    visible = _HIDDEN.sub(" ", markup)
    page = _HTML.search(visible)
    language = _LANG.search(page[1]) if page else None
    meta = [("http-status", status.split(" ")[1] if " " in status else ""), *(("source-header", f"{k}: {v}") for k, v in fields), ("title", title_of(visible)), ("html-lang", language[1].lower() if language else "")]
    meta += [("outlink", x) for x in links(visible)]
    blocks = (
        ("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}{CRLF}" for k, v in meta if v).encode()),
        ("conversion", "text/plain; charset=utf-8", plain_text(visible).encode()),
    )
    out = []
    for kind, content, data in blocks:
        own, hashed = record_id(source_id, kind), digest(data)
        head = {
            "WARC-Type": kind,
            "WARC-Record-ID": own,
            "WARC-Refers-To": " ".join(source_id.split()),
            "WARC-Refers-To-Target-URI": header_uri(uri),
            "WARC-Refers-To-Date": " ".join(date.split()),
            "WARC-Target-URI": header_uri(uri),
            "WARC-Date": " ".join(date.split()),
            "WARC-Block-Digest": hashed,
            "WARC-Payload-Digest": hashed,
            "WARC-Source-Payload-Digest": source_digest,
            "Content-Type": content,
            "Content-Length": str(len(data)),
        }
        out.append((kind, own, source_id, uri, date, content, hashed, hashed, source_digest, "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head.items()) + CRLF, data))
    return out


def serialise(headers: str, block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    return headers.encode() + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """The parts of a WARC file as stored: the whole if it is plain, else each gzip member unpacked on its own."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(zlib.MAX_WBITS | 16), []
        while at < len(data) and not unpack.eof:
            piece = data[at : at + (1 << 16)]
            try:
                parts.append(unpack.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"a gzip member is damaged: {e}") from e
            at += len(piece)
        if not unpack.eof:
            raise ValueError("a gzip member is cut off")
        at -= len(unpack.unused_data)
        yield b"".join(parts)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file, plain or gzip, one after another: (headers, block)."""
    for part in members(data):
        at = 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                raise ValueError("a record header is cut off")
            head = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in part[at:end].decode("utf-8", "replace").split(CRLF)[1:])}
            if not head.get("Content-Length", "").isdecimal() or len(head["Content-Length"]) > 18:
                raise ValueError("a record has no length")
            size = int(head["Content-Length"])
            if end + 4 + size > len(part):
                raise ValueError("a record is cut off")
            yield head, part[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All records of a WARC file: (headers, block)."""
    return list(records(data))


RESPONSES = "page_id long, record_id string, target_uri string, warc_date string, block binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (a file is read by one task): what ``derived`` takes; ``page_id`` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for h, block in records(data.as_py()):
                    if h.get("WARC-Type") == "response":
                        held.append((None, h.get("WARC-Record-ID"), h.get("WARC-Target-URI", ""), h.get("WARC-Date", ""), block))
                        size += len(block)
                        if len(held) == 256 or size > 8 << 20:
                            yield _batch(held, RESPONSES)
                            held, size = [], 0
                if held:
                    yield _batch(held, RESPONSES)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSES)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """Response records of pages that came without their HTTP message; the record id is named by what it holds."""
    source = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(page, uri, response(uri, body)) for page, uri, body in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
                yield _batch([(page, record_id(uri, date, digest(block)), uri, date, block) for page, uri, block in found], RESPONSES)

    return source.mapInArrow(run, RESPONSES)


def derived(found: DataFrame) -> DataFrame:
    """Two records for each response (``RESPONSES``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(page, *x) for page, source, uri, date, block in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True) for x in derive(source or "", uri or "", date or "", block or b"")]
                yield _batch(rows, RECORDS)

    return found.select(*(x.split()[0] for x in RESPONSES.split(", "))).mapInArrow(run, RECORDS)


def derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """Two records for each page, built from its response record."""
    return derived(responses(pages, date, id_col, uri_col, body_col))
