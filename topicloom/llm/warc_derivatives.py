"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A record is a row: record_id, type, target_uri, date, headers (all named fields) and block. Derived records keep the source's identifier in
WARC-Refers-To, its target and date in WARC-Refers-To-Target-URI and WARC-Refers-To-Date, and its digests and HTTP headers in the
metadata record's fields. Digests are sha1 in hexadecimal form.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_consensus import Page
from .textbytes import pieces

END = "\r\n"
RECORD_SCHEMA = (
    "source_id string, type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, payload_digest string, headers array<struct<name:string,value:string>>, block string"
)


def _urn(text: Column) -> Column:
    h = F.md5(text)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses_of_pages(pages: DataFrame, date: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Response records (record_id, target_uri, date, block) of a page table, block being the HTTP head and the html; id is kept as `source_id`.

    A null html is an empty body and a null url an empty target. The identifier is a hash of id and url, so it repeats.
    """
    body = F.coalesce(F.col(html_column), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(body).cast("string"))
    return pages.select(
        F.col(id_column).cast("string").alias("source_id"),
        _urn(F.concat_ws("|", F.lit("response"), F.col(id_column).cast("string"), F.col(url_column))).alias("record_id"),
        F.coalesce(F.col(url_column), F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head, F.lit(END + END), body).alias("block"),
    )


def _digest(data: bytes) -> str:
    return "sha1:" + hashlib.sha1(data).hexdigest()


def _derived_id(kind: str, refers_to: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}|{refers_to}')}>"


def _split_http(block: str) -> tuple[list[tuple[str, str]], str]:
    """HTTP fields and body; a block without an HTTP head is all body."""
    head, found, body = block.partition(END + END)
    if not found or not head.startswith("HTTP/"):
        return [], block
    fields = [line.partition(":") for line in head.split(END)[1:]]
    return [(name.strip(), value.strip()) for name, _, value in fields if name.strip()], body


def _records(source: str | None, record: str | None, target: str | None, date: str | None, block: str | None) -> list[dict]:
    fields, body = _split_http(block or "")
    page = Page(body)
    text = "\n".join(page.blocks)
    whole, payload = (block or "").encode(), _digest(body.encode())
    conversion, metadata = _derived_id("conversion", record), _derived_id("metadata", record)
    notes = [("source-block-digest", _digest(whole)), ("source-payload-digest", payload), ("source-length", str(len(whole)))]
    notes += [(f"http-{name.lower()}", value) for name, value in fields]
    notes += [("text-blocks", str(len(page.blocks))), ("conversion-record", conversion)]
    out = []
    for kind, own, other, content_type, content in (
        ("conversion", conversion, metadata, "text/plain; charset=utf-8", text),
        ("metadata", metadata, conversion, "application/warc-fields", "".join(f"{n}: {v}{END}" for n, v in notes)),
    ):
        raw = content.encode()
        digest = _digest(raw)
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date or ""), ("WARC-Target-URI", target or ""), ("WARC-Refers-To", record or ""),
            ("WARC-Refers-To-Target-URI", target or ""), ("WARC-Refers-To-Date", date or ""), ("WARC-Concurrent-To", other),
            ("WARC-Block-Digest", digest), ("Content-Type", content_type), ("Content-Length", str(len(raw))),
        ]
        out.append({
            "source_id": source, "type": kind, "record_id": own, "refers_to": record, "concurrent_to": other, "target_uri": target, "date": date,
            "content_type": content_type, "content_length": len(raw), "block_digest": digest, "payload_digest": payload,
            "headers": [{"name": n, "value": v} for n, v in headers], "block": content,
        })
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response record: its conversion (text outside scripts, styles and page furniture) and its metadata.

    payload_digest is that of the source's body. Nulls are empty fields; an empty body gives an empty text. Equal responses give equal
    records. `responses` needs source_id, record_id, target_uri, date and block; other columns are not read.
    """
    names = ["source_id", "record_id", "target_uri", "date", "block"]
    kinds = None

    def convert(batches):
        nonlocal kinds
        kinds = kinds or pa.schema([
            *[(n, pa.string()) for n in ("source_id", "type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type")],
            ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()),
            ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.string()),
        ])
        for batch in batches:
            for piece in pieces(batch, "block"):
                rows = [r for x in zip(*(piece.column(n).to_pylist() for n in names)) for r in _records(*x)]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return responses.select(*names).mapInArrow(convert, RECORD_SCHEMA)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files, one for each partition; a record ends with two line ends."""
    fields = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), END)
    row = F.concat(F.lit(f"WARC/1.1{END}"), fields, F.lit(END + END), F.col("block")).alias("value")
    records.select(row).write.option("lineSep", END + END).option("compression", "gzip").text(path)
