"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

``responses`` are rows of record_id, target_uri, date and block (an HTTP message: status line, headers, blank line,
payload). ``derive`` gives two records for each, both with WARC-Refers-To the response and WARC-Concurrent-To each
other: a metadata record (JSON: status, source headers in their order with repeats, source digests, title, links)
and a conversion record (the payload's text). Their ids are made from the response's id, target, date and block, so that
responses without an id, or with one id and several blocks, get records of their own. Everything is row-local, one pass
and no shuffle. Markup is read once from front to back: time is in proportion to a page's length, whatever is in it.
``serialised`` turns records into gzip members of WARC/1.1, which may be put one after another in a file; ``parsed`` reads
them back, a member at a time; a file is one row of Spark's binaryFile reader (2 GB at most).

Defined cases: a null block is an empty one, without status; a null record_id or target_uri is left out of the record's
headers; heads may end in bare line feeds; chunked and gzip or deflate payloads are decoded for the text (source digests
are of the bytes as they came), and what can't be decoded is named in ``error`` and gives the text up to there; other
encodings give an empty conversion and an error; a payload that is not text has an empty conversion; bytes that don't fit
the named charset become U+FFFD; repeated rows give repeated records; damaged members and records without a length give a
row with ``error`` and no block, and reading goes on with the next one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import bound_batches, table

RECORD = "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, block binary, block_digest string, source_block_digest string, source_payload_digest string, error string"
SCHEMA = pa.schema([(x.split()[0], pa.binary() if x.split()[1] == "binary" else pa.string()) for x in RECORD.split(", ")])

MARK = re.compile(r"<(?:!--|[/!?A-Za-z])")
NAME = re.compile(r"<(/?[A-Za-z][A-Za-z0-9]*)")
#: Elements whose content is not text, elements that break lines, elements that link.
HIDDEN = ("script", "style", "noscript", "template")
BREAKS = frozenset("p div br hr li ul ol h1 h2 h3 h4 h5 h6 table tr td th article section nav header footer blockquote pre title head body main aside form dl dt dd figure".split())
LINKING = ("a", "link", "area", "base")
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*HIDDEN, "title")}
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLANKS = re.compile(r"[^\S\n]+")
HEAD_END = re.compile(rb"\r?\n\r?\n")
NEXT = re.compile(rb"\r?\n\r?\nWARC/(?=[0-9]\.[0-9]\r?\n)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message."""
    end = HEAD_END.search(block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    lines = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, payload


def unchunked(payload: bytes) -> tuple[bytes, str | None]:
    out, at = [], 0
    while True:
        end = payload.find(b"\n", at)
        size = payload[at : end if end >= 0 else at].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out), "damaged chunks"
        n, at = int(size, 16), end + 1
        if not n:
            return b"".join(out), None
        out.append(payload[at : at + n])
        at += n
        at += 2 if payload[at : at + 2] == b"\r\n" else 1


def inflated(payload: bytes, bits: int) -> tuple[bytes, str | None]:
    unzip = zlib.decompressobj(bits)
    out = []
    try:
        for lo in range(0, len(payload), 1 << 16):
            out.append(unzip.decompress(payload[lo : lo + (1 << 16)]))
        out.append(unzip.flush())
    except zlib.error:
        return b"".join(out), "damaged compression"
    return b"".join(out), None if unzip.eof or not payload else "damaged compression"


def decoded(headers: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str | None]:
    """The payload without its transfer and content encodings, and what went wrong."""
    error = None
    for header in ("transfer-encoding", "content-encoding"):
        for coding in reversed([x.strip().lower() for k, v in headers if k.lower() == header for x in v.split(",")]):
            if coding == "chunked":
                payload, wrong = unchunked(payload)
            elif coding in ("gzip", "x-gzip"):
                payload, wrong = inflated(payload, 31)
            elif coding == "deflate":
                payload, wrong = inflated(payload, 15 if payload[:1] == b"\x78" else -15)
            elif coding in ("", "identity"):
                wrong = None
            else:
                payload, wrong = b"", f"unknown encoding {coding}"
            error = error or wrong
    return payload, error


def collapsed(text: str) -> str:
    """Entities decoded, blanks collapsed, empty lines gone."""
    lines = (BLANKS.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def read_markup(markup: str) -> tuple[str, str | None, list[str]]:
    """Text, title and link targets of HTML, front to back: hidden elements go, block elements break lines."""
    text, links, title, titled, at = [], [], None, False, 0
    while mark := MARK.search(markup, at):
        text.append(markup[at : mark.start()])
        if mark[0] == "<!--":
            end = markup.find("-->", mark.end())
            text.append(" ")
            at = len(markup) if end < 0 else end + 3
            continue
        end = markup.find(">", mark.end() - 1)
        stop = len(markup) if end < 0 else end + 1
        tag = markup[mark.start() : stop]
        found = NAME.match(tag)
        name = found[1].lower() if found else ""
        at = stop
        if name in HIDDEN and end >= 0:
            closed = CLOSING[name].search(markup, stop)
            text.append(" ")
            at = closed.end() if closed else len(markup)
        elif name.lstrip("/") in BREAKS:
            text.append("\n")
        if name in LINKING and (href := HREF.search(tag)):
            links.append(html.unescape(next(x for x in href.groups() if x is not None)).strip())
        if name == "title" and not titled:
            titled, closed = True, CLOSING["title"].search(markup, stop)
            title = collapsed(markup[stop : closed.start()]) if closed else None
    text.append(markup[at:])
    return collapsed("".join(text)), title, links


def plain_text(markup: str) -> str:
    return read_markup(markup)[0]


def derived(record_id: str | None, target_uri: str | None, date: str | None, block: bytes | None) -> list[dict]:
    """The metadata and the conversion record of a response."""
    block = block or b""
    status, headers, payload = http_parts(block)
    body, error = decoded(headers, payload)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        markup = body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):
        markup = body.decode("utf-8", "replace")
    text, title, targets = read_markup(markup) if "html" in kind.lower() or not kind else (markup if kind.lower().startswith("text/") else "", None, [])
    links = []
    for href in targets:
        try:
            links.append(urljoin(target_uri or "", href))
        except ValueError:
            links.append(href)
    source = {"source_block_digest": digest(block), "source_payload_digest": digest(payload)}
    envelope = {"status": status, "headers": headers, "payload_bytes": len(payload), **source, "title": title, "links": links}
    named = json.dumps([record_id, target_uri, date, source["source_block_digest"]])
    names = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{named}#{kind}')}>" for kind in ("metadata", "conversion")]
    blocks = (json.dumps(envelope, ensure_ascii=False).encode("utf-8", "replace"), text.encode("utf-8", "replace"))
    kinds = (("metadata", "application/json"), ("conversion", "text/plain; charset=utf-8"))
    return [
        {"warc_type": t, "record_id": names[k], "refers_to": record_id, "concurrent_to": names[1 - k], "target_uri": target_uri, "date": date, "content_type": c, "block": blocks[k], "block_digest": digest(blocks[k]), "error": error} | source
        for k, (t, c) in enumerate(kinds)
    ]


def derive(responses: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in derived(*row)]
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    bound_batches(responses.sparkSession)
    return responses.select(*(F.col(c).cast("string") for c in ("record_id", "target_uri", "date")), F.col("block").cast("binary")).mapInArrow(run, RECORD)


#: Headers of a record, in the order in which they are written, and their columns.
HEADERS = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Concurrent-To": "concurrent_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "Content-Type": "content_type", "WARC-Block-Digest": "block_digest", "Source-Block-Digest": "source_block_digest", "Source-Payload-Digest": "source_payload_digest"}


def member(record: dict) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{name}: {record[column]}\r\n" for name, column in HEADERS.items() if record.get(column) is not None)
    data = record["block"] or b""
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(data)}\r\n\r\n".encode() + data + b"\r\n\r\n", 6, mtime=0)


def unzipped(data: bytes) -> Iterator[bytes | str]:
    """The gzip members' contents one after another, or what is wrong with one; plain data as it is."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            end = data.find(b"\x1f\x8b\x08", at)
            end = len(data) if end < 0 else end
            # What is between members; without a record it is padding or the rest of a damaged one.
            if b"WARC/" in data[at:end]:
                yield data[at:end]
            at = end
            continue
        unzip, out, begin = zlib.decompressobj(31), [], at
        try:
            while at < len(data) and not unzip.eof:
                chunk = view[at : at + (1 << 16)]
                out.append(unzip.decompress(chunk))
                at += len(chunk) - len(unzip.unused_data)
            if not unzip.eof:
                yield "damaged member"
            else:
                yield b"".join(out)
        except zlib.error:
            yield "damaged member"
            at = data.find(b"\x1f\x8b\x08", begin + 2)
            at = len(data) if at < 0 else at


def named(head: str) -> dict[str, str]:
    """A record's headers by lower-case name: a blank after the colon is optional, a line that begins with one goes on."""
    found: dict[str, str] = {}
    last = ""
    for line in head.replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t"):
            if last:
                found[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower() if colon else ""
        if last:
            found[last] = value.strip()
    return found


def members(data: bytes) -> Iterator[dict]:
    """The records of gzip members one after another (or of plain WARC); damaged ones have an error and no block.

    What follows a record without a usable length is not read as records, since it may be the payload: reading goes on at
    the next gzip member or, in plain WARC, at the next version line after an empty one.
    """
    gzipped = data[:2] == b"\x1f\x8b"

    def wrong(said: str) -> dict:
        return dict.fromkeys([*HEADERS.values(), "block"]) | {"error": said}

    for plain in unzipped(data):
        if isinstance(plain, str):
            yield wrong(plain)
            continue
        at = 0
        while (at := plain.find(b"WARC/", at)) >= 0:
            end = HEAD_END.search(plain, at)
            if not end:
                yield wrong("damaged record")
                break
            said = named(plain[at : end.start()].decode("utf-8", "replace"))
            own = {column: said.get(name.lower()) for name, column in HEADERS.items()}
            n = said.get("content-length", "")
            at = end.end()
            if not (n.isascii() and n.isdigit() and at + int(n) <= len(plain)):
                yield own | {"block": None, "error": "record without its length"}
                after = None if gzipped else NEXT.search(plain, at)
                if not after:
                    break
                at = after.end() - len(b"WARC/")
                continue
            yield own | {"block": plain[at : at + int(n)], "error": None}
            at += int(n)


def serialised(records: DataFrame) -> DataFrame:
    """record_id, member: each record's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array([member(r) for r in rows], pa.binary())], ["record_id", "member"])

    return records.mapInArrow(run, "record_id string, member binary")


def parsed(files: DataFrame) -> DataFrame:
    """Records of ``content``, as from Spark's binaryFile reader."""
    kept = [c for c in RECORD.split(", ") if c.split()[0] in {*HEADERS.values(), "block", "error"}]
    schema = pa.schema([SCHEMA.field(c.split()[0]) for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for record in members(content or b""):
                    rows.append(record)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("content").mapInArrow(run, ", ".join(kept))


def responses_of(pages: DataFrame) -> DataFrame:
    """Pages as response records, with an id made from page_id and a plain HTTP head."""
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit("page-"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    record_id = F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n\r\n"))
    return pages.select(record_id.alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.concat(head, page).cast("binary").alias("block"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive(responses_of(table(spark, sf_dir, "pages")))
    return records.withColumn("block", F.col("block").cast("string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_warc_derivatives": op2_warc_derivatives}
