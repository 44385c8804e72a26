"""WARC archives: one gzip member per record, written by tasks and read back in sequence.

Writing: each payload gets its SHA-1; of equal payloads that with the largest page_id is a ``response`` and the
others ``revisit`` it. Each task writes one archive to a folder that all executors share; a repeated task
replaces its archive. Reading: a task streams an archive through an incremental decompressor, never holding more
than a record; records are framed by Content-Length, must end with their member, and the block of a response must
have the block and payload digests that its headers name.

A revisit record has no block of its own; its payload is read from what the record names (WARC-Refers-To). Its
length and digest stand in its headers, and must be those of a response under that name: ``checked`` tells where not.

Digests that occur once need no join; those that repeat are few against the pages, or hubs, or else joined by a shuffle.

Nulls: a null html is an empty payload, a null url is written as an empty target, a null page_id is kept as none
(the record's id is then made from the url's digest) and never preferred over a page that has one. Repeated rows are
written one by one: of rows equal in payload and page_id, all are responses. Very long payloads are one record. An
empty table leaves no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docraster.llm.shared import filesystem, hub_join, kept, shared_folder, write_file

DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


class BrokenArchive(ValueError):
    pass


# --- records --------------------------------------------------------------------------------------------------


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + CRLF * 2 + block + CRLF * 2
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_record(page_id: int | None, url: str | None, html: str | None, sha1: str, refers_to: int | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:url:{digest(target.encode('utf-8', 'surrogatepass'))}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if refers_to is None:
        return record([*headers, ("WARC-Block-Digest", f"sha1:{sha1}"), ("Content-Type", "text/html")], payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record([*headers, ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Payload-Length", str(len(payload)))], b"")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = field(repr=False)

    def page(self, name: str) -> int | None:
        value = self.headers.get(name, "")
        return int(value.removeprefix("<urn:page:").rstrip(">")) if value.startswith("<urn:page:") else None


def members(stream, step: int = 1 << 18) -> Iterator[bytes]:
    """The gzip members of a stream in turn, each decompressed as its bytes come in."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    started = False
    while block := rest or stream.read(step):
        started = True
        parts.append(inflate.decompress(block))
        rest = b""
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(parts)
            inflate, parts, started = zlib.decompressobj(31), [], bool(rest)
    if started or parts:
        raise BrokenArchive("the archive ends within a gzip member")


def parsed(member: bytes) -> Record:
    head, found, rest = member.partition(CRLF * 2)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise BrokenArchive("a member that is no WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != CRLF * 2:
        raise BrokenArchive(f"{headers.get('WARC-Record-ID')}: Content-Length {length} does not frame the record")
    block = rest[:length]
    names = ["WARC-Block-Digest"] + ["WARC-Payload-Digest"] * (headers.get("WARC-Type") == "response")
    wanted = {headers[name] for name in names if name in headers}
    if wanted and wanted != {own := f"sha1:{digest(block)}"}:
        raise BrokenArchive(f"{headers.get('WARC-Record-ID')}: the digest of its block is {own}, not as told")
    return Record(headers, block)


def records(stream) -> Iterator[Record]:
    return map(parsed, members(stream))


# --- tables ---------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """page_id, url, html, sha1 (binary) and refers_to: the page that a revisit's payload is found at."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    p = p.withColumn("sha1", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    same = kept(p.where(size >= at_least).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1"), "repeated")
    joined = hub_join(p.withColumn("n_bytes", size), same, "sha1", "left")
    refers = F.when((F.col("n_bytes") >= at_least) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("page_id", "url", "html", "sha1", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, at_least: int = 0) -> DataFrame:
    """Writes one archive per partition of the result; returns the list of archives (path, records, bytes), once written."""
    names = ["path", "records", "bytes"]

    def task(batches):
        n = 0

        def parts():
            nonlocal n
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                    page_id, url, html, sha1, refers_to = (x.as_py() for x in row)
                    n += 1
                    yield page_record(page_id, url, html, base64.b32encode(sha1).decode(), refers_to)

        own = parts()
        first = next(own, None)
        if first is not None:
            path = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
            size = write_file(path, (x for some in ((first,), own) for x in some))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])], names)

    return kept(with_revisits(pages, at_least).mapInArrow(task, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Each record of the archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and the block if wanted."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def row(r: Record) -> tuple:
        kind = r.headers["WARC-Type"]
        size = int(r.headers["WARC-Payload-Length"]) if kind == "revisit" else len(r.block)
        return (r.page("WARC-Record-ID"), r.headers["WARC-Target-URI"], kind, r.page("WARC-Refers-To"), size, r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), r.block)

    def task(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, name = filesystem(path)
                with where.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for r in records(stream):
                        rows.append(row(r)[: len(names)])
                        held += 200 + len(r.block) * payloads
                        if held > 1 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spark = archives.sparkSession
    n = max(1, archives.count())
    dealt = archives.select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")
    return dealt.mapInArrow(task, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads)


def checked(records: DataFrame) -> DataFrame:
    """The records; an error if a revisit's length or digest is not that of a response under the name it gives."""
    told = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_bytes", "payload_digest").agg(F.count("*").alias("n"))
    own = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    wrong = told.join(own, ["refers_to", "payload_bytes", "payload_digest"], "left_anti").first()
    if wrong is not None:
        raise BrokenArchive(f"{wrong['n']} revisits of page {wrong['refers_to']}, which has no payload of {wrong['payload_bytes']} bytes and digest {wrong['payload_digest']}")
    return records


def round_trip(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back and checks the revisits."""
    return checked(kept(read_archives(write_archives(pages, shared_folder(pages.sparkSession, "warc"), at_least)), "records"))
