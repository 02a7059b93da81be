"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

Each response gives one metadata and one conversion record that refer to its record id, carry its
target, date and source headers, and have block digests of their own; the response's payload
digest is preserved in both.  Records can be rendered to WARC bytes and parsed from WARC files.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch

#: Date of records built from pages that carry none.
DATE = "2024-01-01T00:00:00Z"
RESPONSE = "record_id string, target_uri string, warc_date string, http_headers string, payload binary, payload_digest string"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, block string"

#: What is left out with all that it holds: its opening, and its end.
_HELD = {
    "!--": (re.compile("<!--"), re.compile("-->")),
    **{n: (re.compile(rf"<{n}\b", re.I), re.compile(rf"</{n}\s*>", re.I)) for n in ("script", "style", "noscript")},
}
_OPENS = re.compile(r"<(!--|script\b|style\b|noscript\b)", re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^<>]*)?>", re.I)
_START = re.compile(r"<[A-Za-z/!?]")
_SPECIAL = re.compile(r"[<>\"']")
_LEFT = re.compile(r"<[A-Za-z/!?][^<>]*>")
_RUN = re.compile(r"[ \t\r\f\v\xa0]+")


def without_held(page: str) -> str:
    """The page without comments, scripts and styles; one that never ends is ordinary markup.

    One pass: what was looked for in vain once is not looked for again."""
    out, at, look, missing = [], 0, 0, set()
    while found := _OPENS.search(page, look):
        name = found[1].lower()
        look, end = found.end(), -1
        inside = look if name == "!--" else page.find(">", look) + 1 if ">" not in missing else 0
        if not inside:
            missing.add(">")
        elif name not in missing:
            close = _HELD[name][1].search(page, inside)
            end = close.end() if close else -1
            if not close:
                missing.add(name)
        if end >= 0:
            out.append(page[at : found.start()])
            at = look = end
    return "".join(out) + page[at:]


def without_tags(text: str) -> str:
    """The text without tags; > inside quotes does not end a tag, and a < outside of quotes ends the try.

    One pass: a quote from which no tag's end was reached once is not followed again."""
    out, at, look, dead, lonely = [], 0, 0, set(), {}
    while found := _START.search(text, look):
        place, tried, end = found.end(), [], -1
        while special := _SPECIAL.search(text, place):
            mark, i = special[0], special.start()
            if mark == ">":
                end = i + 1
            if mark in "<>" or i in dead or i >= lonely.get(mark, len(text)):
                break
            tried.append(i)
            place = text.find(mark, i + 1) + 1
            if not place:
                lonely[mark] = i
                break
        if end < 0:
            dead.update(tried)
            look = found.start() + 1
        else:
            out.append(text[at : found.start()])
            at = look = end
    return "".join(out) + text[at:]


def plain_text(page: str) -> str:
    """The text of a page, in time linear in its length: no comments, scripts or styles; a line for each
    block with text."""
    text = _LEFT.sub("", without_tags(_BREAK.sub("\n", without_held(page))))
    lines = (_RUN.sub(" ", x).strip(" ") for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def header(http_headers: str, name: str) -> str:
    """The last value of a header, lower case; empty if there is none."""
    found = ""
    for line in http_headers.replace("\r\n", "\n").split("\n")[1:]:
        key, colon, value = line.partition(":")
        if colon and key.strip().lower() == name:
            found = value.strip().lower()
    return found


def unchunked(body: bytes) -> bytes:
    """A body in chunked transfer encoding, put together; the body as it is where it is not chunked so."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else body


def uncompressed(body: bytes, coding: str) -> bytes:
    """A body of content coding gzip, deflate or zstd, as far as it can be read; any other as it is."""
    try:
        if coding in ("gzip", "x-gzip"):
            return zlib.decompressobj(47).decompress(body)
        if coding == "deflate":
            return zlib.decompressobj(15 if body[:1] and body[0] & 15 == 8 else -15).decompress(body)
        if coding == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except (zlib.error, zstandard.ZstdError):
        pass
    return body


_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.I)


def page_of(http_headers: str, payload: bytes) -> str:
    """The payload as text: transfer and content codings undone, in the charset that the headers or else the
    page's first 1024 bytes name, else UTF-8; bytes that it does not know become replacement characters."""
    body = unchunked(payload) if "chunked" in header(http_headers, "transfer-encoding") else payload
    for coding in reversed(header(http_headers, "content-encoding").split(",")):
        body = uncompressed(body, coding.strip())
    said = _CHARSET.search(header(http_headers, "content-type")) or _CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(said[1] if said else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def uuid_of(*parts: str) -> str:
    """A stable urn:uuid of the parts, so that a recomputed task writes the same ids."""
    h = hashlib.md5("|".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records (RESPONSE) and page_id for fetched pages.  A null page is an empty payload, a
    null url stays null; ids derive from page_id and url."""
    h = F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    payload = F.coalesce(F.col(page), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(payload).cast("string"))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">")).alias("record_id"), F.col(url).alias("target_uri"),
        F.lit(DATE).alias("warc_date"), head.alias("http_headers"), payload.alias("payload"), F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest"),
    )


def source_fields(http_headers: str, payload: bytes, payload_digest: str) -> str:
    """The metadata block (application/warc-fields): source headers kept, payload length and digest."""
    lines = [f"source-{k.strip().lower()}: {v.strip()}" for k, v in (x.split(":", 1) for x in http_headers.replace("\r\n", "\n").split("\n")[1:] if ":" in x)]
    status = http_headers.replace("\r\n", "\n").split("\n", 1)[0]
    return "\r\n".join([f"source-status: {status}", *lines, f"source-payload-length: {len(payload)}", f"source-payload-digest: {payload_digest}"]) + "\r\n"


def derive(df: DataFrame, key: str | None = None) -> DataFrame:
    """Two records (RECORD, and ``key`` if given) of each response: metadata and conversion.

    The conversion reads the payload with its codings undone (``page_of``); digests and lengths are those
    of the payload as it was sent.  An empty payload gives an empty conversion block.  Null record ids are derived from the target and payload; other nulls
    are empty headers.  Repeated responses give repeated records, an empty table none; columns beyond
    RESPONSE and ``key`` are left out.
    """
    schema = (f"{key} long, " if key else "") + RECORD

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "payload"}
            for i, raw in enumerate(batch.column("payload")):
                payload = raw.as_py() or b""
                own = {n: v[i] for n, v in columns.items()}
                kept = own["payload_digest"] or digest(payload)
                source = own["record_id"] or uuid_of("response", own["target_uri"] or "", kept)
                blocks = (
                    ("metadata", "application/warc-fields", source_fields(own["http_headers"] or "", payload, kept)),
                    ("conversion", "text/plain; charset=utf-8", plain_text(page_of(own["http_headers"] or "", payload))),
                )
                for kind, content, block in blocks:
                    data = block.encode()
                    row = {"record_type": kind, "record_id": uuid_of(kind, source), "refers_to": source, "target_uri": own["target_uri"], "warc_date": own["warc_date"] or DATE}
                    row |= {"content_type": content, "payload_digest": kept, "block_digest": digest(data), "content_length": len(data), "block": block}
                    if key:
                        row[key] = own[key]
                    for n, v in row.items():
                        out[n].append(v)
            return out

        return work

    names = [*([key] if key else []), "record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest"]
    return by_batch(df.select(*names), schema, make)


def render(kind: str, record_id: str, refers_to: str | None, uri: str | None, date: str, content: str, block: bytes, payload_digest: str | None = None) -> bytes:
    """One WARC/1.1 record."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    head += [("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def rendered(records: DataFrame) -> DataFrame:
    """record_id, warc (binary): each derived record as gzip-compressed WARC bytes of its own member."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = batch.to_pylist()
            data = [render(r["record_type"], r["record_id"], r["refers_to"], r["target_uri"], r["warc_date"], r["content_type"], (r["block"] or "").encode(), r["payload_digest"]) for r in rows]
            return {"record_id": batch.column("record_id"), "warc": [gzip.compress(d, 6, mtime=0) for d in data]}

        return work

    return by_batch(records, "record_id string, warc binary", make)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record in WARC bytes, plain or gzip members."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head.get("content-length") or 0))


SEPARATOR = "\r\n\r\nWARC/1."
_VERSION = re.compile(rb"(?:WARC/1\.)?[01]\r\n")


class Records:
    """Puts records together from a file's pieces between separators, one after the other."""

    def __init__(self):
        self.path, self.held, self.missing, self.head = None, b"", 0, {}

    def add(self, path: str, piece: bytes) -> tuple[dict[str, str], bytes] | None:
        """The record that the piece completes.  A separator inside of a block cuts it into several pieces."""
        if self.missing and path == self.path:
            self.held += SEPARATOR.encode() + piece
        else:
            self.end()
            if not piece.strip():
                return None
            start = _VERSION.match(piece)
            top, blank, block = piece.partition(b"\r\n\r\n")
            if not start:
                raise ValueError(f"no record starts at a piece of {path}: a block holds a record separator where the file was split; compress the file, or raise spark.sql.files.maxPartitionBytes")
            if not blank:
                raise ValueError(f"{path}: a record is cut short in its header")
            lines = (x.partition(":") for x in top[start.end() :].decode("utf-8", "replace").split("\r\n"))
            self.head = {n.strip().lower(): v.strip() for n, colon, v in lines if colon}
            self.path, self.held = path, block
        if not self.head.get("content-length"):
            raise ValueError(f"{path}: a record does not say how long it is")
        size = int(self.head["content-length"])
        self.missing = max(0, size - len(self.held))
        return None if self.missing else (self.head, self.held[:size])

    def end(self) -> None:
        if self.missing:
            raise ValueError(f"{self.path}: a record's block is {self.missing} bytes short")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """RESPONSE rows of the response records in WARC files under ``path``, plain or gzip.

    Spark's text reader streams a file from one record separator to the next, so a task holds a few
    records at a time, whatever the file's size.  A record that is cut short is an error."""
    text = spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", "true").text(path)
    pieces_ = text.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    names = [c.split()[0] for c in RESPONSE.split(", ")]

    def run(batches):
        records = Records()
        for batch in batches:
            for file, piece in zip(batch.column("path"), batch.column("piece")):
                whole = records.add(file.as_py(), piece.as_py())
                if whole and whole[0].get("warc-type") == "response":
                    head, block = whole
                    http, _, payload = block.partition(b"\r\n\r\n")
                    row = (head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), http.decode("utf-8", "replace"), payload, head.get("warc-payload-digest"))
                    yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row)})
        records.end()

    return pieces_.mapInArrow(run, RESPONSE)
