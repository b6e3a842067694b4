"""WARC 1.1 records: responses, and the metadata and plain-text records derived from them.

A record is a version line, named fields, an empty line, ``Content-Length``
bytes and two line ends. Derived records refer to their response by
``WARC-Refers-To`` with its target and date, keep its payload digest and the
HTTP fields it came with, and have digests and ids of their own. Ids are made
from content, so that a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm.html_text import PageBlocks
from fluxweave.llm.tables import schema_with, table

VERSION, END = "WARC/1.1", b"\r\n"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture
BATCH_ROWS = 256
RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, http_headers map<string,string>, block binary"
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def clean_field(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def response_block(html: str | None) -> bytes:
    body = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def response_of(page_id: int | None, url: str | None, html: str | None, date: str) -> dict:
    """The response record of a page."""
    block = response_block(html)
    uri = clean_field(url or "") or f"urn:page:{page_id}"
    _, fields, body = split_http(block)
    whole = digest(block)
    return {
        "record_type": "response", "record_id": record_id("response", str(page_id), uri, whole), "refers_to": None, "target_uri": uri, "date": date,
        "content_type": "application/http; msgtype=response", "payload_digest": digest(body), "block_digest": whole, "http_headers": fields, "block": block,
    }


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, fields (names in lower case, repeated ones joined by a comma) and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            fields[name] = f"{fields[name]}, {value}" if name in fields else value
    return lines[0], fields, body


def http_body(fields: dict[str, str], body: bytes) -> bytes:
    """The body without its transfer and content coding; as it is where the coding is broken or unknown."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        out, rest = [], body
        while rest:
            size, found, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                break
            if not found or n == 0:
                break
            out.append(rest[:n])
            rest = rest[n + 2 :]
        body = b"".join(out)
    coding = fields.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            return zlib.decompress(body, 47 if "gzip" in coding else zlib.MAX_WBITS)
        except zlib.error:
            return body
    return body


ROOT = re.compile(r"https?://[a-z0-9.-]+(?=/|$)")
PLAIN_PATH = re.compile(r"(?:/[A-Za-z0-9_~%-][A-Za-z0-9_~%.-]*)+/?")
PLAIN_URL = re.compile(ROOT.pattern + f"(?:{PLAIN_PATH.pattern})?")


def resolved(base: str, root: str | None, href: str) -> str:
    """``href`` against ``base``, as ``urljoin`` has it; links that need no more than the base's ``root`` are told by their look."""
    if root is not None:
        if PLAIN_PATH.fullmatch(href):
            return root + href
        if PLAIN_URL.fullmatch(href):
            return href
    try:
        return urljoin(base, href)
    except ValueError:
        return href


class _Facts(PageBlocks):
    """Blocks, title and links of a page, from one pass."""

    def __init__(self, base: str) -> None:
        super().__init__()
        self.base, self.title, self.found, self._in_title = base, [], [], False
        self.root = root[0] if (root := ROOT.match(base)) else None

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "area", "link"):
            href = dict(attrs).get("href")
            if href:
                self.found.append((tag, resolved(self.base, self.root, href.strip())))
        else:
            self._in_title = tag == "title" and not self.title
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._in_title = self._in_title and tag != "title"
        super().handle_endtag(tag)

    def handle_data(self, data):
        if self._in_title:
            self.title.append(data)
        super().handle_data(data)


def charset_of(fields: dict[str, str]) -> str:
    kind = fields.get("content-type", "")
    name = kind.lower().partition("charset=")[2].split(";")[0].strip(" \"'")
    try:
        "".encode(name or "utf-8")
    except LookupError:
        return "utf-8"
    return name or "utf-8"


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response record.

    The conversion holds all text of an HTML body, a block a line; another text
    type is kept as it is and anything else becomes empty. The metadata holds
    the HTTP status and fields, sizes, title and links, as JSON.
    """
    status, fields, body = split_http(bytes(response["block"]))
    body = http_body(fields, body)
    kind = fields.get("content-type", "").split(";")[0].strip().lower()
    text, title, links, charset = "", "", [], charset_of(fields)
    if kind in ("text/html", "application/xhtml+xml", ""):
        page = body.decode(charset, "replace")
        facts = _Facts(response["target_uri"] or "")
        facts.feed(page)
        facts.close()
        text = "\n".join(b.text for b in facts.blocks)
        title, links = " ".join("".join(facts.title).split()), facts.found
    elif kind.startswith("text/"):
        text = body.decode(charset, "replace")
    plain = text.encode()
    of_text = digest(plain)
    told = {
        "http-status": status, "http-headers": fields, "payload-digest": response["payload_digest"], "payload-length": len(body),
        "charset": charset, "title": title, "text-length": len(text), "text-digest": of_text, "outlinks": [{"tag": t, "url": u} for t, u in links],
    }
    out = []
    metadata = json.dumps(told, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    for type_, content_type, block, of_block in (
        ("metadata", "application/json", metadata, digest(metadata)),
        ("conversion", "text/plain; charset=utf-8", plain, of_text),
    ):
        out.append(
            {
                "record_type": type_, "record_id": record_id(type_, response["record_id"]), "refers_to": response["record_id"], "target_uri": response["target_uri"],
                "date": response["date"], "content_type": content_type, "payload_digest": response["payload_digest"], "block_digest": of_block,
                "http_headers": fields, "block": block,
            }
        )
    return out


def record_bytes(record: dict) -> bytes:
    """The record as it stands in a file."""
    block = bytes(record["block"])
    fields = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Refers-To", record["refers_to"]), ("WARC-Refers-To-Target-URI", record["refers_to"] and record["target_uri"]),
        ("WARC-Refers-To-Date", record["refers_to"] and record["date"]), ("WARC-Payload-Digest", record["payload_digest"]),
        ("WARC-Block-Digest", record["block_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(len(block))),
    ]
    if record["record_type"] != "response":
        fields += [(f"WARC-Source-{name}", value) for name, value in sorted(dict(record["http_headers"] or {}).items())]
    head = "".join(f"{name}: {clean_field(value)}\r\n" for name, value in fields if value)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + END + END


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of an uncompressed file, or of one whose members are gzip. A file that breaks off ends with its last whole record."""
    while data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(47)
            parts.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (begin := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", begin)
        if stop < 0:
            return
        fields: dict[str, str] = {}
        for line in data[begin:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length", "0"))
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            return
        kind = fields.get("warc-type", "")
        source = {n.removeprefix("warc-source-"): v for n, v in fields.items() if n.startswith("warc-source-")}
        yield {
            "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"), "content_type": fields.get("content-type"), "payload_digest": fields.get("warc-payload-digest"),
            "block_digest": fields.get("warc-block-digest"), "http_headers": split_http(block)[1] if kind == "response" else source, "block": block,
        }
        at = stop + 4 + size


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ARROW = pa.schema([(n, pa.map_(pa.string(), pa.string()) if n == "http_headers" else pa.binary() if n == "block" else pa.string()) for n in NAMES])


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record for every row of ``pages(page_id, url, html)``, with its page_id.

    Null html is an empty body, a null url the target ``urn:page:<page_id>``.
    Rows repeated under one page_id, url and content give equal records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), *_ARROW])
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = []
                for r in batch.slice(at, BATCH_ROWS).to_pylist():
                    rows.append({"page_id": r["page_id"], **response_of(r["page_id"], r["url"], r["html"], date)})
                yield _batch(rows, schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, f"page_id long, {RECORD}")


def derivatives(records: DataFrame, *keep: str) -> DataFrame:
    """A metadata and a conversion record for every response among ``records``, with the columns ``keep`` of the response.

    Records of other types are passed over. A response without a block counts as empty.
    """
    chosen = records.filter("record_type = 'response'").select(*keep, *NAMES).withColumn("block", F.coalesce("block", F.lit(b"")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                schema = pa.schema([*[part.schema.field(k) for k in keep], *_ARROW])
                yield _batch([{**{k: r[k] for k in keep}, **d} for r in part.to_pylist() for d in derive(r)], schema)

    return chosen.mapInArrow(run, schema_with(chosen.select(*keep), **{f.name: f.dataType for f in chosen.select(*NAMES).schema}))


def with_bytes(records: DataFrame, name: str = "record") -> DataFrame:
    """``records`` with the bytes of every record as they stand in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [record_bytes(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, name])

    return records.mapInArrow(run, schema_with(records, **{name: "binary"}))


def write_files(records: DataFrame, path: str) -> None:
    """Records as text files of one record after another, in gzip, through Spark's own writer.

    Blocks must be UTF-8. The writer ends each row with a line end, the second of the two that end a record.
    """
    text = with_bytes(records.select(*NAMES)).select(F.expr("substring(record, 1, length(record) - 2)").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under ``path``, plain or gzip; a file is read by one task, as its format asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows: list[dict] = []
                for record in parse_records(data):
                    rows.append(record)
                    if len(rows) == BATCH_ROWS:
                        yield _batch(rows, _ARROW)
                        rows = []
                yield _batch(rows, _ARROW)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def page_derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The derived records of every page's response, from html in one pass: what ``derivatives(responses(pages), "page_id")`` gives.

    The response itself stays in the task. In place of the block stands its
    text as ``content``, and record_length and record_sha256 tell of the bytes
    that the record has in a file.
    """
    told = [n for n in NAMES if n != "block"]
    schema = f"page_id long, {RECORD.removesuffix(', block binary')}, content string, content_length long, record_length long, record_sha256 string"
    kinds = [_ARROW.field(n).type for n in told] + [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids, columns = [], [[] for _ in kinds]
                for page_id, url, html in zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                    for made in derive(response_of(page_id, url, html, date)):
                        ids.append(page_id)
                        data = record_bytes(made)
                        made["http_headers"] = list(made["http_headers"].items())
                        facts = made["block"].decode(), len(made["block"]), len(data), hashlib.sha256(data).hexdigest()
                        for column, value in zip(columns, (*[made[n] for n in told], *facts)):
                            column.append(value)
                arrays = [pa.array(ids, pa.int64()), *map(pa.array, columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", *told, "content", "content_length", "record_length", "record_sha256"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


def op10_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Both derived records of the response record of every page, with the bytes they have in a file."""
    return page_derivatives(table(spark, sf_dir, "pages")).withColumn("http_headers", F.to_json("http_headers"))
