"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A response record becomes two records. The conversion record holds the text of its page; the metadata record
holds what was known of the source: its HTTP status and headers, its digests and how much text came of it.
Both name the source by WARC-Refers-To, with its target and date, and have digests of their own blocks. Record
identifiers are derived from the source's identifier, so a run that is repeated writes the same records.

Defined cases: a null page is an empty body; a page without URL has no target header; bytes that are no WARC
response give one row of type `invalid` with the reason; repeated rows each give their records; of headers that
are there twice, the last one counts and metadata keeps both; a very long page takes time in proportion to its length; an
empty table gives no rows; columns other than those named, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Date of records that are built from pages, which have none.
DATE = "2024-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HIDING = re.compile(r"<(?:(!--)|(script|style|noscript|template)\b|(head)\b|!doctype)", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "head")}
BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|nav|footer|header|article|section|aside|main|blockquote|pre|hr|title)\b[^>]*>", re.I)
TAG = re.compile(r"</?[a-z][^>]*>|<[?!][^>]*>", re.I)
#: Numeric references whose number is above all code points, and zeros in front of others.
TOO_LARGE, ZEROS = re.compile(r"&#(?:0*+[1-9][0-9]{7,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{7,}+);?"), re.compile(r"(&#[xX]?)0{2,}+")


def bare(page: str) -> str:
    """The page with a space for each comment, doctype, head, and element that shows nothing. What is never closed: a comment or
    element hides the rest, a head or a tag without > hides nothing. One pass: what was looked for in vain is not looked for again."""
    out, at, more, tags, heads = [], 0, 0, True, True
    while m := HIDING.search(page, more):
        end = -1
        if m[1]:
            end = page.find("-->", m.end())
            end = end + 3 if end >= 0 else len(page)
        elif m[3]:
            closed = CLOSING["head"].search(page, m.end()) if heads else None
            heads, end = closed is not None, closed.end() if closed else -1
        elif tags:
            end = page.find(">", m.end()) + 1 or -1
            tags = end > 0
            if m[2] and tags:
                closed = CLOSING[m[2].lower()].search(page, end)
                end = closed.end() if closed else len(page)
        if end < 0:
            more = m.start() + 1
            continue
        out += [page[at : m.start()], " "]
        at = more = end
    return "".join([*out, page[at:]])


def page_text(page: str) -> str:
    """The visible text of a page: a line for each block, white space within lines as one space."""
    shown = bare(page)
    for pattern, instead in ((BREAKS, "\n"), (TAG, "")):
        last = shown.rfind(">") + 1  # behind it no tag ends
        shown = pattern.sub(instead, shown[:last]) + shown[last:]
    shown = html.unescape(ZEROS.sub(r"\g<1>0", TOO_LARGE.sub("\ufffd", shown)))
    lines = (" ".join(line.split()) for line in shown.split("\n"))
    return "\n".join(line for line in lines if line)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record of headers (Content-Length is added) and a block."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers (in their order) and block of a record; ValueError if it is none."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])]
    length = dict((k.lower(), v) for k, v in headers).get("content-length", "")
    if not length.isdigit() or int(length) > len(rest):
        raise ValueError("the block is shorter than Content-Length")
    return headers, rest[: int(length)]


def response(page_id, url: str | None, page: str | None) -> bytes:
    """A response record of a page."""
    body = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    name = uuid.uuid5(SPACE_ID, f"{page_id} {url} {digest(body)}")
    target = [("WARC-Target-URI", url)] if url is not None else []
    return record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), *target, ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def derivatives(data: bytes | None) -> list[dict]:
    """Rows (record_type, record_id, refers_to, target_uri, source_digest, block_digest, content_length, record) of a response record."""
    try:
        headers, block = parse(data or b"")
        known = {k.lower(): v for k, v in headers}
        if known.get("warc-type") != "response" or "warc-record-id" not in known:
            raise ValueError("no response record")
        head, mark, body = block.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"HTTP/"):
            raise ValueError("no HTTP response")
    except ValueError as e:
        return [{"record_type": "invalid", "reason": str(e)}]
    source, target, date = known["warc-record-id"], known.get("warc-target-uri"), known.get("warc-date", DATE)
    http = head.decode("utf-8", "replace").split("\r\n")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", head.decode("latin-1"), re.I)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = page_text(page).encode()
    payload = known.get("warc-payload-digest") or digest(body)
    link = [("WARC-Refers-To", source), *([("WARC-Refers-To-Target-URI", target)] if target else []), ("WARC-Refers-To-Date", date)]
    fields = [("source-status", http[0]), *((f"source-header-{k.strip().lower()}", v.strip()) for k, _, v in (line.partition(":") for line in http[1:])), ("source-payload-digest", payload), ("source-block-digest", known.get("warc-block-digest") or digest(block)), ("text-digest", digest(text)), ("text-length", str(len(text)))]
    rows = []
    for kind, mime, own in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()), ("conversion", "text/plain; charset=utf-8", text)):
        name = f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{kind} {source}')}>"
        where = [("WARC-Target-URI", target)] if target else []
        made = record([("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *where, *link, ("WARC-Block-Digest", digest(own)), ("Content-Type", mime)], own)
        rows.append({"record_type": kind, "record_id": name, "refers_to": source, "target_uri": target, "source_digest": payload, "block_digest": digest(own), "content_length": len(own), "record": made})
    return rows


FIELDS = "record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, reason string, record binary"


def derive(responses: DataFrame) -> DataFrame:
    """page_id and the derivatives of each record of responses (page_id, record)."""

    def run(batches):
        import pyarrow as pa

        names = ("record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", "reason", "record")
        types = (*[pa.string()] * 6, pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            ids, made = [], []
            for page_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in derivatives(data):
                    ids.append(page_id)
                    made.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r.get(n) for r in made], t) for n, t in zip(names, types))], ["page_id", *names])

    return responses.select(F.col("page_id").cast("long"), F.col("record").cast("binary")).mapInArrow(run, f"page_id long, {FIELDS}")


def responses(pages: DataFrame) -> DataFrame:
    """page_id and a response record of each page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [response(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, record binary")
