"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Each response gives two records. ``metadata`` holds, as application/warc-fields, the source's
own headers, its payload digest, the title, the language and the out-links. ``conversion``
holds the visible text. Both name the response in WARC-Refers-To, keep its target uri and
date, and carry block digests of their own; the conversion also keeps the digest of the
payload it was made from. Identifiers are derived from content, so a rerun gives the same.

Defined results: a null page counts as empty; its records are there, with empty bodies. A
null url gives no WARC-Target-URI line; white space and control characters in a url are percent-encoded, so
that no header line breaks. Pages of different page_id have records of different ids, whatever they hold;
rows that repeat with their id give repeated records. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?:</head\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|nav|header|footer|main|aside|blockquote|pre|form|dd|dt|dl|hr|td|th)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
_BREAKS = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")


def digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=4)}>"


def visible(page: str) -> str:
    """The text a reader sees: one line per block, entities decoded, blanks folded."""
    body = _TAG.sub("", _BLOCK.sub("\n", _DROP.sub(" ", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(body))).strip()


def facts(page: str) -> list[tuple[str, str]]:
    out = [("title", " ".join(html.unescape(m[1]).split())) for m in [_TITLE.search(page)] if m]
    out += [("language", m[1]) for m in [_LANG.search(page)] if m]
    links = dict.fromkeys(html.unescape(next(g for g in m.groups() if g is not None)).strip() for m in _LINK.finditer(page))
    return out + [("outlink", " ".join(x.split())) for x in links if x]


def encoded(uri: str | None) -> str | None:
    """A uri that fits a header line."""
    return uri if uri is None else _BREAKS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def fields(pairs: list[tuple[str, str | None]]) -> str:
    return "".join(f"{k}: {v}{CRLF}" for k, v in pairs if v is not None)


def record(kind: str, pairs: list[tuple[str, str | None]], body: str) -> tuple[str, str]:
    """The header block of a record over body, and the digest of the block."""
    raw = body.encode("utf-8", "surrogatepass")
    sum_ = digest(raw)
    head = "WARC/1.1" + CRLF + fields([("WARC-Type", kind), *pairs, ("WARC-Block-Digest", sum_), ("Content-Length", str(len(raw)))])
    return head, sum_


def responses(pages: DataFrame, date: str = DATE, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records from raw pages: page_id, record_id, uri, date, http (headers), payload."""

    def run(batches):
        for b in batches:
            payload = [p or "" for p in b["payload"]]
            ids = [record_id("response", str(i), u or "", date, p) for i, u, p in zip(b["page_id"], b["uri"], payload, strict=True)]
            http = [f"Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(p.encode('utf-8', 'surrogatepass'))}{CRLF}" for p in payload]
            yield pd.DataFrame({"page_id": b["page_id"], "record_id": ids, "uri": b["uri"], "date": date, "http": http, "payload": payload})

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("uri"), F.col(page).alias("payload"))
    return rows.mapInPandas(run, f"page_id {dict(rows.dtypes)['page_id']}, record_id string, uri string, date string, http string, payload string")


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: page_id, warc_type, record_id, refers_to, payload_digest, block_digest, header, body."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                payload = r.payload or ""
                source = digest(payload.encode("utf-8", "surrogatepass"))
                shared = [("WARC-Refers-To", r.record_id), ("WARC-Target-URI", encoded(r.uri)), ("WARC-Date", r.date)]
                http = [(f"source-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in (r.http or "").split(CRLF) if x)]
                meta = fields([*http, ("source-payload-digest", source), *facts(payload)])
                text = visible(payload)
                for kind, body, mime in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
                    own = record_id(kind, r.record_id)
                    head, sum_ = record(kind, [("WARC-Record-ID", own), *shared, ("WARC-Source-Payload-Digest", source), ("Content-Type", mime)], body)
                    out.append((r.page_id, kind, own, r.record_id, source, sum_, head, body))
            yield pd.DataFrame(out, columns=["page_id", "warc_type", "record_id", "refers_to", "payload_digest", "block_digest", "header", "body"])

    return records.mapInPandas(run, f"page_id {dict(records.dtypes)['page_id']}, warc_type string, record_id string, refers_to string, payload_digest string, block_digest string, header string, body string")


def write(derived: DataFrame, path: str) -> None:
    """The records as gzipped WARC files under path, through Spark's text writer.

    A record ends in two line ends, which are the writer's line separator; a warcinfo record
    is not written, the WARC standard leaves it optional.
    """
    derived.select(F.concat("header", F.lit(CRLF), "body").alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
