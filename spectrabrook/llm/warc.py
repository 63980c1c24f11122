"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader inflates one member after another with incremental zlib, frames the
record by its Content-Length and verifies block and payload digests. It holds
one record at a time. Archives lie in the folder that driver and executors
share and are opened through ``pyarrow.fs``, so a URI of any store that PyArrow
knows will do.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrabrook.llm.common import shared_dir, small_batches, stage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


class WarcError(ValueError):
    """An archive that breaks the format, or a digest that doesn't match."""


@dataclass
class Record:
    """Header fields with lower-cased names, the block, and the payload inside the block."""

    fields: dict[str, str]
    block: bytes = b""
    payload: bytes = b""
    http: dict[str, str] = field(default_factory=dict)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _clean(value: str) -> str:
    """Header values hold no control characters: those are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def pack(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 4, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """The gzip member of one record: a response with its payload, or a revisit that names a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{_sha(block)}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF) + z.flush()


def _headers(raw: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in raw.split(CRLF):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return found


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated bytes of each gzip member in turn."""
    z, parts, fresh = zlib.decompressobj(31), [], True
    for chunk in chunks:
        while chunk:
            fresh = False
            try:
                parts.append(z.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            chunk = b""
            if z.eof:
                yield b"".join(parts)
                chunk, z, parts, fresh = z.unused_data, zlib.decompressobj(31), [], True
    if not fresh:
        raise WarcError("the archive ends inside a gzip member")


def parse(data: bytes) -> Record:
    """One record from the bytes of its member, framed by Content-Length, with digests verified."""
    head, gap, rest = data.partition(CRLF + CRLF)
    if not gap or not head.startswith(b"WARC/"):
        raise WarcError("a record has no WARC header")
    fields = _headers(head.partition(CRLF)[2])
    if not fields.get("content-length", "").isdigit():
        raise WarcError("a record has no Content-Length")
    n = int(fields["content-length"])
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != CRLF + CRLF:
        raise WarcError(f"Content-Length is {n}; the block and its end don't fit that")
    record = Record(fields, block, block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, record.payload = block.partition(CRLF + CRLF)
        record.http = _headers(http)
    said = fields.get("warc-block-digest")
    if said and said != f"sha256:{_sha(block)}":
        raise WarcError("the block digest doesn't match")
    said = fields.get("warc-payload-digest")
    if said and fields.get("warc-type") != "revisit" and said != f"sha256:{_sha(record.payload)}":
        raise WarcError("the payload digest doesn't match")
    return record


def _open(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


def read_archive(uri: str, chunk: int = 1 << 16) -> Iterator[Record]:
    """The records of one archive in order; WarcError if it is broken."""
    store, path = _open(uri)
    with store.open_input_stream(path, compression=None) as f:
        yield from map(parse, members(iter(lambda: f.read(chunk), b"")))


def plan(pages: DataFrame, least_bytes: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html", salts: int = 32) -> DataFrame:
    """page_id, url, html, digest, refers_to for each row: refers_to is null for responses.

    Of equal payloads of least_bytes or more the smallest page_id is the
    response; rows that repeat that page_id are responses too. A null page_id
    ranks above all others, so that it refers to a named page if there is one.
    Smaller payloads refer to nothing and stay where they lie. Copies of one
    payload meet their response in `salts` tasks, not in one.
    """
    text = F.coalesce(pages[html], F.lit(""))
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), text.alias("html"), F.sha2(text, 256).alias("digest"))
    large = F.octet_length("html") >= least_bytes
    first = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and first is not null")
    spread = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.filter(large).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(spread, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(F.col("first").eqNullSafe(F.col("page_id")), None).otherwise(F.col("first")).alias("refers_to"))
    return joined.unionByName(rows.filter(~large).withColumn("refers_to", F.lit(None).cast("long")))


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = 1 << 30, level: int = 4) -> DataFrame:
    """Write planned rows into folder; a staged table of archive, records, bytes.

    A task writes under a name of its attempt and renames at the end of each
    archive, so a task that is lost and run again leaves whole archives only.
    """
    small_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        out, done, size, count, k = None, [], 0, 0, 0

        def close():
            nonlocal out, size, count, k
            out.close()
            name = f"part-{ctx.partitionId():05d}-{k:03d}.warc.gz"
            store.move(draft, posixpath.join(base, name))
            done.append((f"{folder}/{name}", count, size))
            out, size, count, k = None, 0, 0, k + 1

        for b in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    draft = posixpath.join(base, f"_draft-{ctx.partitionId()}-{ctx.taskAttemptId()}-{k}")
                    out = store.open_output_stream(draft, compression=None)
                data = pack(page, url, html.encode("utf-8", "replace"), digest, refers, level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["archive", "records", "bytes"])

    return stage(planned.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per record of the archives that the column archive names, read in order within each.

    page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload
    (null for revisits). Archives are spread evenly over tasks.
    """
    names = archives.select("archive")
    tasks = tasks or max(1, min(100_000, names.count()))
    small_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, size = [], 0
                for r in read_archive(uri):
                    kind = r.fields.get("warc-type")
                    number = lambda key, r=r: int(r.fields[key]) if key in r.fields else None
                    n = len(r.payload) if kind != "revisit" else int(r.http.get("content-length", 0))
                    digest = r.fields.get("warc-payload-digest", "").removeprefix("sha256:") or _sha(r.payload)
                    rows.append((number("x-page-id"), r.fields.get("warc-target-uri"), kind, n, digest, number("x-refers-to-page-id"), None if kind == "revisit" else r.payload))
                    size += len(r.payload)
                    if len(rows) >= 1000 or size >= 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return names.repartition(tasks).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, least_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """Archive pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; payloads under least_bytes are always
    responses. Very long payloads are one record like any other. Rows repeat as
    they do in pages. An empty table writes no archive and gives an empty
    result; other columns, whatever their names, are not read.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(plan(pages, least_bytes), folder)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as d from pages),
q as (select *, octet_length(encode(h)) as n, min(page_id) over (partition by d) as f from p)
select page_id, n as payload_bytes, d as payload_digest,
       case when n >= 100 and f <> page_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and f <> page_id then f end as refers_to
from q
"""
