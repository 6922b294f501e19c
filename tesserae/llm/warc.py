"""WARC archives: writing captures, reading records back, and assembling transactions.

Each capture is written as a request, a response (or a revisit, if its payload was seen) and a metadata
record, gzip members of one archive. Reading parses the members again; assembly joins the records of a
capture through their concurrent-to identifiers, following one that points to another dependent record
one step further, and emits one nested row per capture.

Archives are rows (path, content), the shape of Spark's binaryFile source, so `read_records` takes both
tables that `write_archives` made and folders of .warc or .warc.gz files read with that source.

Edge cases: a null payload counts as empty, and payloads of any length are one record, read and written
whole; of equal payloads the smallest page_id is the response, and rows that repeat it are responses too;
null, empty or broken urls are written without line breaks, null ones as about:blank, and asked for at the
root; repeated rows share their record ids and come back as often as they went in;
a null page_id sorts behind all others and comes back as null; a dependent record whose capture is
missing gives a row without response; damaged archives end at the damage; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

REVISIT_FROM = 100  # bytes of payload
ARCHIVE_BYTES = 4 << 20  # of records before compression
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, http string, fields map<string,string>, payload binary"
)


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, first_id: first_id is the smallest page_id with an equal payload, where there is another."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    same = rows.filter(F.octet_length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    same = common.staged(same.filter("n > 1").drop("n"), "digests")  # a table of its own, so that both sides of the join are dealt anew and a hot digest is split
    return rows.join(same, "digest", "left")


def _record(kind: str, record_id: str, uri: str, mime: str, block: bytes, extra: str = "") -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {mime}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def _target(uri: str) -> tuple[str, str]:
    """Path with query, and host, of a url; of what is none, the root and nothing."""
    try:
        parts = urlsplit(uri)
    except ValueError:
        return "/", ""
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return path if parts.netloc and path.startswith("/") else "/", parts.netloc


def archive_record(name: str) -> bytes:
    """The record about the archive itself, the first one in it."""
    block = b"software: tesserae\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{name}>\r\nWARC-Date: {_DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def capture_id(page_id: int | None, digest: str, part: str) -> str:
    return f"<urn:capture:{'null' if page_id is None else page_id}:{digest[:32]}:{part}>"


def capture_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None) -> list[bytes]:
    """The three records of one capture."""
    uri = "".join((url or "about:blank").split())
    path, host = _target(uri)
    asked = f"GET {path} HTTP/1.1\r\n" + (f"Host: {host}\r\n" if host else "") + "\r\n"
    own = capture_id(page_id, digest, "response")
    revisit = first_id is not None and first_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    extra = f"WARC-Payload-Digest: sha256:{digest}\r\n"
    if revisit:
        extra += f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: {capture_id(first_id, digest, 'response')}\r\n"
    beside = f"WARC-Concurrent-To: {own}\r\n"
    facts = f"page-id: {'null' if page_id is None else page_id}\r\npayload-length: {len(payload)}\r\n".encode()
    return [
        _record("request", capture_id(page_id, digest, "request"), uri, "application/http; msgtype=request", asked.encode("utf-8", "replace"), beside),
        _record("revisit" if revisit else "response", own, uri, "application/http; msgtype=response", http if revisit else http + payload, extra),
        _record("metadata", capture_id(page_id, digest, "metadata"), uri, "application/warc-fields", facts, beside),
    ]


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(captures: DataFrame) -> DataFrame:
    """(path, content): archives of gzip members. captures is what plan_captures gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, parts, size = TaskContext.get().partitionId(), 0, [], 0
        names = ["path", "content"]

        def archive() -> pa.RecordBatch:
            name = f"part-{task:06d}-{made:06d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([_member(archive_record(name)), *parts])], pa.binary())], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for record in capture_records(*row):
                    parts.append(_member(record))
                    size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    made, parts, size = made + 1, [], 0
        if parts:
            yield archive()

    return captures.select("page_id", "url", "payload", "digest", "first_id").mapInArrow(run, "path string, content binary")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes archives as .warc.gz files to a folder that all executors share, by a file: path or any address that pyarrow opens; gives (path, n_bytes).

    Evaluated by whoever reads the result. A file is written under another name and then moved, so a task that is run again leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                part = f"{root}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, f"{root}/{name}")
                paths.append(f"{folder.rstrip('/')}/{name}")
                sizes.append(content.as_buffer().size)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    return archives.select("path", "content").mapInArrow(run, "path string, n_bytes long")


def _members(content: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The uncompressed gzip members; bytes that are not gzip come as they are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        try:
            while not z.eof and at < len(view):
                part = view[at : at + step]
                out.append(z.decompress(part))
                at += len(part)
        except zlib.error:
            return
        if not z.eof:
            return
        at -= len(z.unused_data)
        yield b"".join(out)


def parse_records(content: bytes | None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every whole record."""
    for data in _members(content or b""):
        at = 0
        while data.startswith(b"WARC/", at):
            cut = data.find(b"\r\n\r\n", at)
            if cut < 0:
                return
            lines = data[at:cut].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = headers.get("content-length", "")
            end = cut + 4 + (int(length) if length.isdigit() else len(data))
            if end > len(data):
                return
            yield headers, data[cut + 4 : end]
            at = end + 4


def read_records(archives: DataFrame, content_col: str = "content", with_payload: bool = True) -> DataFrame:
    """One row per record. Of responses, payload_bytes and payload_digest are taken from the payload itself."""
    names = [p.split()[0] for p in RECORD_SCHEMA.split(", ")]
    kinds = (*[pa.string()] * 6, pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())

    def rows(content: bytes | None) -> Iterator[tuple]:
        for h, block in parse_records(content):
            kind, http, fields, payload, size = h.get("warc-type"), None, None, None, None
            digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
            if kind in ("request", "response", "revisit"):
                head, _, body = block.partition(b"\r\n\r\n")
                http = head.decode("utf-8", "replace")
                if kind == "response":
                    payload, size, digest = body, len(body), hashlib.sha256(body).hexdigest()
            elif kind == "metadata":
                pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x)
                fields = list({k.strip(): v.strip() for k, _, v in pairs}.items())
            yield h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, http, fields, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                found = list(rows(content))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return archives.select(content_col).mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, copies, request, response (of type response or revisit), metadata. Records about archives belong to none."""
    records = records.filter("type IS NULL OR type <> 'warcinfo'")
    linked = records.filter("concurrent_to IS NOT NULL").select(F.col("record_id").alias("_via"), F.col("concurrent_to").alias("_next")).dropDuplicates(["_via"])
    to = F.coalesce("concurrent_to", F.concat(F.lit("none "), "record_id"))  # records without one spread out instead of meeting at null
    onward = records.join(linked, to == F.col("_via"), "left").drop("_via")
    key = F.coalesce("_next", "concurrent_to", "record_id")
    parts = {
        "request": ("request", ["record_id", "target_uri", "http"]),
        "response": ("response", ["record_id", "type", "target_uri", "http", "payload_bytes", "payload_digest", "refers_to", "payload"]),
        "metadata": ("metadata", ["record_id", "fields"]),
    }
    kind = F.when(F.col("type") == "revisit", "response").otherwise(F.col("type"))
    aggs = [F.first(F.when(kind == k, F.struct(*cols)), ignorenulls=True).alias(name) for name, (k, cols) in parts.items()]
    return onward.withColumn("capture_id", key).groupBy("capture_id").agg(F.sum((kind == "response").cast("long")).alias("copies"), *aggs)


def resolve_revisits(captures: DataFrame, salts: int = 16) -> DataFrame:
    """Adds full_payload: a revisit gets the payload of the response it refers to. Popular responses are copied to `salts` places."""
    known = captures.filter("response.type = 'response'").select(F.col("capture_id").alias("_of"), F.col("response.payload").alias("full_payload"))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    again = captures.filter("response.type = 'revisit'").withColumn("_salt", F.pmod(F.xxhash64("capture_id"), F.lit(salts)).cast("int"))
    joined = again.join(known, (again["response.refers_to"] == known["_of"]) & (again["_salt"] == known["_salt"]), "left").drop("_of", "_salt")
    rest = captures.filter("response IS NULL OR response.type = 'response'").withColumn("full_payload", F.col("response.payload"))
    return rest.unionByName(joined)


def op4_warc(spark, sf_dir, pages: DataFrame | None = None) -> DataFrame:
    """Every page written to archives and read back; see the module's docstring."""
    common.prepare(spark)
    pages = common.documents(spark, sf_dir, "pages") if pages is None else pages
    archives = common.staged(write_archives(plan_captures(pages)), "warc")
    captures = assemble(read_records(archives, with_payload=False)).filter("response IS NOT NULL")
    number = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS BIGINT)")
    rows = captures.withColumn("_n", F.explode(F.expr("sequence(1L, copies)")))
    return rows.select(
        number("response.record_id").alias("page_id"),
        F.coalesce("response.payload_bytes", F.expr("try_cast(metadata.fields['payload-length'] AS BIGINT)")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number("response.refers_to").alias("refers_to"),
    )


QUERIES = {"op4_warc": op4_warc}
ORACLES = {
    "op4_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (d)""",
}
