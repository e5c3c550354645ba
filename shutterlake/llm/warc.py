"""WARC derivatives (operator 7): metadata and plain-text conversion records.

A response record becomes two derivatives that name it in WARC-Refers-To: a
``metadata`` record, a JSON object with the source record's headers, the HTTP
headers, digests, title and links; and a ``conversion`` record with the page's plain
text.  Both carry digests of their own blocks, and repeat the source's.  Records with
no HTML or plain text (by the HTTP Content-Type) have a metadata record only.

Source and HTTP headers are kept as lists of pairs, repeated ones too.  A body in chunks,
or coded by gzip or deflate, is decoded before its text is read; digests are of the
record as it is.

Reading goes through WARC files, plain or of one gzip member a record, without holding
more than a record and a part of the file; writing gives files of about FILE bytes,
under another name until complete.  ``responses`` makes response records of a table of
pages.

Defined results: a page with null html has an empty payload, one with null url the
URI ``urn:page:<page_id>``; ids come from the page and URI by name-based UUID, with a
running number for what is repeated in none: repeated rows give repeated records;
broken HTML (unclosed tags, comments, scripts) is read to its end; bytes that are
not UTF-8 are replaced; an empty table gives no record; other columns are not used.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import html as entities
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

VERSION = b"WARC/1.1"
#: Where the derivatives' and made records' names come from, and the date given to records made here.
NAMES, DATE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), "2024-01-01T00:00:00Z"
Headers = list[tuple[str, str]]

#: Bytes of a file that are read at a time; bytes of records passed on at a time; bytes of a written file, about.
PART, PASSED, FILE = 1 << 20, 8 << 20, 64 << 20
SCHEMA = "page_id bigint, record_type string, record_id string, refers_to string, refers_to_target_uri string, refers_to_date string, target_uri string, date string, content_type string, source_block_digest string, source_payload_digest string, block_digest string, content_length bigint, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, chr(31).join(parts))}>"


def value(headers: Headers, name: str) -> str | None:
    """The first header of that name, in whatever case."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def serialise(headers: Headers, block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if k.lower() != "content-length"), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> Headers:
    out: Headers = []
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, rest = line.partition(":")
            out.append((name.strip(), rest.strip()))
    return out


def _members(parts: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file that comes in parts, decompressed, or the file itself; each is to be used up before the next."""
    rest = next(parts, b"")
    while len(rest) < 2 and (part := next(parts, b"")):
        rest += part
    if rest[:2] != b"\x1f\x8b":
        yield itertools.chain([rest], parts)
        return
    while rest:
        member = zlib.decompressobj(31)

        def inside(member=member) -> Iterator[bytes]:
            nonlocal rest
            while not member.eof:
                data, rest = rest, b""
                while data and not member.eof:
                    yield member.decompress(data, PART)
                    data = member.unconsumed_tail
                if member.eof or not (rest := next(parts, b"")):
                    break
            rest = member.unused_data

        yield inside()
        rest = rest or next(parts, b"")


def _records(parts: Iterator[bytes]) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of one member; a cut-off last record is left out."""
    held = bytearray()

    def more(least: int) -> bool:
        while len(held) < least:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[: max(0, len(held) - 4)]
            if not more(len(held) + 1):
                return
        del held[:at]
        end = 0
        while (end := held.find(b"\r\n\r\n", max(0, end - 3))) < 0:
            end = len(held)
            if not more(end + 1):
                return
        headers = _headers(bytes(held[held.find(b"\r\n") + 2 : end]))
        length = value(headers, "Content-Length") or ""
        stop = end + 4 + (int(length) if length.isdigit() else 0)
        if not more(stop):
            return
        yield headers, bytes(held[end + 4 : stop])
        del held[:stop]


def parse(data: bytes | Iterator[bytes]) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of a WARC file, whole or in parts; broken compression ends it."""
    with contextlib.suppress(zlib.error):
        for member in _members(iter([data]) if isinstance(data, bytes) else data):
            yield from _records(member)
            for _ in member:  # what is left of a cut-off record
                pass


def _decoded(http: Headers, payload: bytes) -> bytes:
    """The payload without its transfer and content codings, as far as it can be decoded."""
    if "chunked" in (value(http, "Transfer-Encoding") or "").lower():
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            size = payload[at:end].split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
                break
            if not (n := int(size, 16)):
                at = len(payload)
                break
            out.append(payload[end + 2 : end + 2 + n])
            at = end + 2 + n + 2
        payload = b"".join(out) if out and at else payload
    for coding in reversed([x.strip().lower() for k, v in http if k.lower() == "content-encoding" for x in v.split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            coded = zlib.decompressobj(bits)
            try:
                payload = coded.decompress(payload)
                break
            except zlib.error:
                continue
    return payload


#: Elements whose content is no text, and those that end a line.
SILENT = {"script", "style", "template", "noscript", "svg", "iframe", "head"}
BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split())
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
LINK = re.compile(r"""\b(href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)


def _tag_end(page: str, at: int) -> int:
    """Just after the tag that begins at ``at``; quotes may hold its closing sign."""
    while at < len(page):
        close = page.find(">", at)
        if close < 0:
            return len(page)
        inside = page[at:close]
        open_quote = None
        for q in re.finditer("[\"']", inside):
            open_quote = None if open_quote == q[0] else open_quote or q[0]
        if open_quote is None:
            return close + 1
        quote = page.find(open_quote, close)
        if quote < 0 or quote - close > 4096:
            return close + 1
        at = quote + 1
    return len(page)


def read_page(page: str) -> tuple[str, str, list[tuple[str, str]]]:
    """Plain text, title and links (attribute, target) of a page, in one pass."""
    text: list[str] = []
    links: list[tuple[str, str]] = []
    title, at, lower = "", 0, page.lower()
    if len(lower) != len(page):  # a few letters change length
        lower = "".join(c.lower() if c.isascii() else c for c in page)
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text.append(page[at:])
            break
        text.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        tag = TAG.match(page, start)
        if not tag:
            if page[start + 1 : start + 2] in ("!", "?"):
                at = _tag_end(page, start + 1)
            else:
                text.append("<")
                at = start + 1
            continue
        name, end = tag[1].lower(), _tag_end(page, start + 1)
        if page[start + 1] != "/":
            links += [(m[1].lower(), entities.unescape(m[2].strip("\"'"))) for m in LINK.finditer(page, tag.end(), end)]
            if name in SILENT or name == "title":
                if name == "head":
                    at = end
                    continue
                close = lower.find(f"</{name}", end)
                if name == "title" and not title:
                    title = " ".join(entities.unescape(page[end : close if close >= 0 else len(page)]).split())
                at = _tag_end(page, close + 1) if close >= 0 else len(page)
                continue
        if name in BLOCKS:
            text.append("\n")
        at = end
    lines = (" ".join(x.split()) for x in entities.unescape("".join(text)).split("\n"))
    return "\n".join(x for x in lines if x), title, links


def response(page_id: int | None, url: str | None, html: str | None) -> tuple[Headers, bytes]:
    """A response record of a page."""
    payload = (html or "").encode()
    uri = url or f"urn:page:{page_id}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(page_id), uri)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", digest(payload)),
    ], block


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The derivatives of one record: none unless it is a response."""
    if (value(headers, "WARC-Type") or "").lower() != "response":
        return []
    source, uri = value(headers, "WARC-Record-ID") or "", value(headers, "WARC-Target-URI") or ""
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, _, rest = head.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        status, rest, payload = b"", b"", block
    http = _headers(rest)
    kind = (value(http, "Content-Type") or "text/html").lower()
    charset = re.search(r"charset=\"?([\w-]+)", kind)
    body = _decoded(http, payload)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    textual = kind.startswith(("text/html", "application/xhtml", "text/plain"))
    text, title, links = (page, "", []) if kind.startswith("text/plain") else read_page(page) if textual else ("", "", [])
    block_digest = value(headers, "WARC-Block-Digest") or digest(block)
    payload_digest = value(headers, "WARC-Payload-Digest") or digest(payload)

    def absolute(target: str) -> str:
        try:
            return urljoin(uri, target)
        except ValueError:
            return target

    about = {
        "source": headers,
        "http": {"status": status.decode("latin-1"), "headers": http},
        "payload": {"length": len(payload), "digest": payload_digest, "actual_digest": digest(payload)},
        "html": {"title": title, "links": [{"attribute": a, "url": absolute(t)} for a, t in links]},
    }
    metadata = json.dumps(about, ensure_ascii=False, sort_keys=True).encode()
    made = [("metadata", "application/json", metadata)] + ([("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))] if textual else [])
    out = []
    for name, content_type, data in made:
        out.append(
            (
                [
                    ("WARC-Type", name),
                    ("WARC-Record-ID", record_id(name, source, uri)),
                    ("WARC-Refers-To", source),
                    ("WARC-Refers-To-Target-URI", uri),
                    ("WARC-Refers-To-Date", value(headers, "WARC-Date") or ""),
                    ("WARC-Date", value(headers, "WARC-Date") or DATE),
                    ("WARC-Target-URI", uri),
                    ("Content-Type", content_type),
                    ("WARC-Source-Block-Digest", block_digest),
                    ("WARC-Source-Payload-Digest", payload_digest),
                    ("WARC-Block-Digest", digest(data)),
                ],
                data,
            )
        )
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id and record: the serialised response record of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            ids = b.column("page_id").to_pylist()
            made = [serialise(*response(i, u, h)) for i, u, h in zip(ids, b.column("url").to_pylist(), b.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["page_id", "record"])

    given = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return given.mapInArrow(run, "page_id bigint, record binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """record of each record in the WARC files under ``path``, with page_id null; files are dealt out and read in parts."""
    from .token_output import _file_system

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(made: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(made), pa.int64()), pa.array(made, pa.binary())], ["page_id", "record"])

        for b in batches:
            for name in b.column("path").to_pylist():
                system, place = _file_system(name)
                made, held = [], 0
                with system.open_input_stream(place, compression=None) as f:
                    for headers, block in parse(iter(lambda f=f: f.read(PART), b"")):
                        made.append(serialise(headers, block))
                        held += len(made[-1])
                        if held >= PASSED:
                            yield passed(made)
                            made, held = [], 0
                if made:
                    yield passed(made)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition("path").mapInArrow(run, "page_id bigint, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """One row per derivative of ``records`` (page_id, record): see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "record"):
            rows = []
            for page_id, record in zip(b.column("page_id").to_pylist(), b.column("record").to_pylist()):
                for headers, block in parse(record or b""):
                    for h, data in derive(headers, block):
                        get = lambda name, h=h: value(h, name)
                        rows.append((page_id, get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Refers-To-Target-URI"), get("WARC-Refers-To-Date"), get("WARC-Target-URI"), get("WARC-Date"), get("Content-Type"), get("WARC-Source-Block-Digest"), get("WARC-Source-Payload-Digest"), get("WARC-Block-Digest"), len(data), data.decode("utf-8", "replace")))
            if rows:
                kinds = [pa.int64(), *[pa.string()] * 11, pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return records.mapInArrow(run, SCHEMA)


#: Headers of a written record, and the columns that have them.
WRITTEN = [
    ("WARC-Type", "record_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Refers-To-Target-URI", "refers_to_target_uri"),
    ("WARC-Refers-To-Date", "refers_to_date"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Date", "date"),
    ("Content-Type", "content_type"),
    ("WARC-Source-Block-Digest", "source_block_digest"),
    ("WARC-Source-Payload-Digest", "source_payload_digest"),
    ("WARC-Block-Digest", "block_digest"),
]


def write(derived: DataFrame, out: str) -> DataFrame:
    """Write derivatives as gzipped WARC files under ``out``, one a task; returns file, records and bytes."""
    from pyspark import TaskContext

    from .token_output import _put

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part = f"derived-{TaskContext.get().partitionId():06d}", 0
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            _put(out, f"{name}-{part:04d}.warc.gz", b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{part:04d}.warc.gz"]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

        for b in batches:
            for r in b.to_pylist():
                headers = [(h, r[c]) for h, c in WRITTEN if r[c] is not None]
                held.append(gzip.compress(serialise(headers, (r["block"] or "").encode()), 6, mtime=0))
                size += len(held[-1])
                if size >= FILE:
                    yield flush()
                    held.clear()
                    part, size = part + 1, 0
        if held:
            yield flush()

    return derived.mapInArrow(run, "file string, records bigint, bytes bigint")
