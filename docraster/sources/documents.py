"""Pages of documents as a table that reads only the pages asked for.

A filter on ``page_no`` reaches the reader: of a document it reads the table of objects at the end and the wanted pages'
images, each by its place in the file, and inflates no other. Image-only documents as this package writes them are
read; of another one, or a broken one, a row with an error tells. One partition holds files of about ``PER_PARTITION``
bytes; a document's pages come one by one, so a task holds one of them. Paths are what pyarrow opens.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from docraster.functions import names as N
from docraster.sources import sinks

PER_PARTITION = 64 << 20
SCHEMA = "path string, name string, n_pages int, page_no int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, read_bytes long, error string"
_IMAGE = re.compile(rb"/Width (\d+) /Height (\d+) /ColorSpace /Device(Gray|RGB) /BitsPerComponent 8 /Filter /(FlateDecode|DCTDecode) /Length (\d+) >>\nstream\n")


class Document:
    """An open document: its object table, and single pages by their place in the file. ``taken`` counts the bytes read."""

    def __init__(self, source, size: int):
        self.source, self.size, self.taken = source, size, 0
        tail = self.part(max(0, size - 1024), 1024)
        at = re.search(rb"startxref\s+(\d+)\s+%%EOF\s*$", tail)
        if not at:
            raise ValueError("no table of objects")
        table = self.part(int(at[1]), size - int(at[1]))
        head = re.match(rb"xref\n0 (\d+)\n", table)
        if not head:
            raise ValueError("no table of objects")
        body = table[head.end() : head.end() + 20 * int(head[1])]
        self.places = [int(body[i : i + 10]) for i in range(0, len(body), 20)]
        pages = re.search(rb"/Count (\d+)", self.part(self.places[2], self.size - self.places[2])) if len(self.places) > 2 else None
        self.pages = int(pages[1]) if pages else -1
        if self.pages < 0 or len(self.places) != 3 + 3 * self.pages:
            raise ValueError("not a document of images alone")

    def part(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(min(size, self.size - at))
        self.taken += len(got)
        return got

    def image(self, page_no: int) -> np.ndarray:
        at = self.places[2 + 3 * page_no]
        m = _IMAGE.search(self.part(at, 512))
        if not m or m[4] != b"FlateDecode":
            raise ValueError("an image of another kind")
        w, h, n = int(m[1]), int(m[2]), int(m[5])
        raw = np.frombuffer(zlib.decompress(self.part(at + m.end(), n)), np.uint8)
        return raw.reshape(h, w) if m[3] == b"Gray" else np.ascontiguousarray(raw.reshape(h, w, 3)[..., ::-1])


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        paths = options.get("paths")
        self.paths = json.loads(paths) if paths else [options["path"]] if "path" in options else []
        self.counts_only = options.get("counts", "false").lower() == "true"
        self.tests: list[Filter] = []

    def pushFilters(self, filters):
        """Comparisons of page_no with a number are met here; all others are left to Spark."""
        for f in filters:
            known = isinstance(f, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull))
            if known and f.attribute == ("page_no",) and not self.counts_only:
                self.tests.append(f)
            else:
                yield f

    def wanted(self, pages: int) -> list[int]:
        """The page numbers that pass; without looking at each where a set or a bound tells."""
        chosen: set[int] | None = None
        low, high = 1, pages
        for f in self.tests:
            match f:
                case EqualTo(_, v) | EqualNullSafe(_, v):
                    chosen = {v} if chosen is None else chosen & {v}
                case In(_, some):
                    chosen = set(some) if chosen is None else chosen & set(some)
                case GreaterThan(_, v):
                    low = max(low, v + 1)
                case GreaterThanOrEqual(_, v):
                    low = max(low, v)
                case LessThan(_, v):
                    high = min(high, v - 1)
                case LessThanOrEqual(_, v):
                    high = min(high, v)
        return list(range(low, high + 1)) if chosen is None else sorted(n for n in chosen if n is not None and low <= n <= high)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        found = []
        for path in self.paths:
            where, plain = sinks._filesystem(path)
            info = where.get_file_info(plain)
            if info.type.name == "NotFound":
                raise FileNotFoundError(path)
            inside = where.get_file_info(fs.FileSelector(plain)) if info.type.name == "Directory" else [info]
            head = path.removesuffix("/")
            found += [(f"{head}/{f.base_name}" if f is not info else path, f.size) for f in inside if f.type.name == "File" and f.base_name.lower().endswith(".pdf")]
        out, held = [[]], 0
        for path, size in sorted(found):
            if out[-1] and held + size > PER_PARTITION:
                out.append([])
                held = 0
            out[-1].append((path, size))
            held += size
        return [Files(f) for f in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        from docraster.sources.files import pack

        for path, size in partition.files:
            where, plain = sinks._filesystem(path)
            name = plain.rpartition("/")[2]
            with where.open_input_file(plain) as source:
                try:
                    doc = Document(source, size)
                except ValueError as why:
                    if self.counts_only or not self.tests:  # not a page, so no page_no is equal to its own
                        yield (path, name, None, None, None, size, f"Cannot read document: {path} ({why})")
                    continue
                if self.counts_only:
                    yield (path, name, doc.pages, None, None, doc.taken, None)
                    continue
                for n in self.wanted(doc.pages):
                    before = doc.taken
                    try:
                        image, error = pack(doc.image(n), path), None
                    except (ValueError, zlib.error) as why:
                        image, error = None, f"Cannot read page {n} of {path} ({why})"
                    yield (path, name, doc.pages, n, image, doc.taken - before, error)


class DocumentPages(DataSource):
    """spark.dataSource.register(DocumentPages); read.format("docraster_documents").

    Options: path (a document, or a folder of them) or paths (a JSON list of either); counts=true gives one row a
    document, without pages.
    """

    @classmethod
    def name(cls) -> str:
        return "docraster_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def document_pages(spark: SparkSession, path: str | Sequence[str], counts: bool = False) -> DataFrame:
    spark.dataSource.register(DocumentPages)
    paths = [path] if isinstance(path, str) else list(path)
    if not any(spark.conf.get(k, "false") == "true" for k in [PUSHDOWN]):
        spark.conf.set(PUSHDOWN, "true")  # off by default in Spark; only sources that ask for filters are touched by it
    return spark.read.format("docraster_documents").option("paths", json.dumps(paths)).option("counts", str(counts).lower()).load()


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_selected(spark: SparkSession, path: str | Sequence[str], indices: Sequence[int]) -> DataFrame:
    """path, pos, idx, page_name, image and error of each document's pages at these indices from 0, in their order and as
    often as named. Each wanted page is inflated once, no other at all; an index out of range is its own row's error."""
    counts = document_pages(spark, path, counts=True).select("path", "name", "n_pages", F.col("error").alias("broken"))
    pages = document_pages(spark, path).where(F.col("page_no").isin(sorted({i + 1 for i in indices if i >= 0}))).select("path", "page_no", "image", F.col("error").alias("bad"))
    wanted = counts.select("*", F.posexplode(F.array(*map(F.lit, indices))).alias("pos", "idx")).withColumn("page_no", F.col("idx") + 1)
    ok = (F.col("idx") >= 0) & (F.col("idx") < F.col("n_pages"))
    error = F.coalesce("broken", F.when(~ok, F.concat(F.lit("PDF page index out of range: "), F.col("idx").cast("string"))), "bad")
    out = wanted.join(pages, ["path", "page_no"], "left")
    return out.select("path", "pos", "idx", F.when(ok, N.page_name("name", "page_no")).alias("page_name"), "image", error.alias("error"))
