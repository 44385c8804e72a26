"""Numbered page files, written exactly once: a sink for batches and for streams.

Tasks encode pages into a folder of their own attempt below ``_staging``; only what Spark commits is moved to its final
name, so neither a failed task nor one that ran twice leaves a file. A batch gets its names from ``page_seq``. A stream
numbers its pages by arrival: micro-batches in turn, within one by natural name and page number; a micro-batch starts
after the numbers that earlier ones have committed (``_committed``), so one that is run again after a crash writes the
same names again, and none twice.

The driver sees a line for each page of a batch and renames, sixteen at a time; pixels never reach it. Paths are what
pyarrow opens. Rows without an image and content are told in the record of their batch and get no number.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from docraster.sources import sinks


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder and, for each page in it, its order and staged name; and what could not be read."""

    folder: str = ""
    pages: list[tuple] = field(default_factory=list)
    unreadable: list[str] = field(default_factory=list)


def natural(name: str) -> list[tuple[str, int]]:
    """The key of ``names.natural_key`` for a name on the driver."""
    return [(text.lower(), int(digits) if digits else -1) for text, digits in re.findall(r"(\D*)(\d*)", name) if text or digits]


class _Pages:
    """What both writers share. The object is made anew on the driver for each query."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("docraster_pages needs a path")
        self.root = options["path"].rstrip("/")
        self.ext = options.get("ext", "png").strip().lower().lstrip(".") or "png"
        self.base, self.start = options.get("base", "page"), int(options.get("start", 1))
        self.job = uuid.uuid4().hex

    def file(self, number: int) -> str:
        return f"{self.base}_{number:05d}.{self.ext}" if self.base else f"{number:05d}.{self.ext}"

    def stage(self, batches: Iterator, order) -> Staged:
        from pyspark import TaskContext

        from docraster.sources.files import unpack

        task = TaskContext.get()
        out = Staged(f"{self.root}/_staging/{self.job}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}")
        where, path = sinks._filesystem(out.folder)
        try:
            for batch in batches:
                names = batch.schema.names
                for at in range(batch.num_rows):
                    row = {n: batch.column(n)[at] for n in names}
                    data = row["content"].as_py() if "content" in row else None
                    image = row["image"].as_py() if data is None and "image" in row else None
                    if data is None and unpack(image) is None:
                        out.unreadable.append(str(row["name"].as_py()) if "name" in row else str(order(row)))
                        continue
                    mine = f"{len(out.pages):08d}"
                    sinks.put(f"{out.folder}/{mine}", sinks.encode(unpack(image), self.ext) if data is None else data)
                    out.pages.append((order(row), mine))
        except BaseException:
            if where.get_file_info(path).type.name == "Directory":
                where.delete_dir(path)
            raise
        return out

    def publish(self, moves: list[tuple[str, str]]) -> None:
        where, root = sinks._filesystem(self.root)
        where.create_dir(root, recursive=True)
        move = lambda m: where.move(sinks._filesystem(m[0])[1], f"{root}/{m[1]}")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, moves))

    def clean(self) -> None:
        where, path = sinks._filesystem(f"{self.root}/_staging/{self.job}")
        if where.get_file_info(path).type.name == "Directory":
            where.delete_dir(path)
        top = path.rpartition("/")[0]
        from pyarrow import fs

        if where.get_file_info(top).type.name == "Directory" and not where.get_file_info(fs.FileSelector(top)):
            where.delete_dir(top)

    def give_up(self) -> None:
        """Tasks that are being killed may still stage a page; what they leave goes, too."""
        for _ in range(4):
            self.clean()
            time.sleep(0.5)
        self.clean()

    def record(self, name: str, **what) -> None:
        sinks.put(f"{self.root}/_committed/{name}.json", json.dumps(what).encode())


class BatchPages(_Pages, DataSourceArrowWriter):
    """Pages named by their page_seq."""

    def write(self, iterator):
        return self.stage(iterator, lambda row: row["page_seq"].as_py())

    def commit(self, messages) -> None:
        moves = [(f"{m.folder}/{mine}", self.file(seq + self.start - 1)) for m in messages if m for seq, mine in m.pages]
        if len({to for _, to in moves}) < len(moves):
            self.clean()
            raise ValueError("two pages have one number")
        self.publish(moves)
        self.record(self.job, count=len(moves), unreadable=[n for m in messages if m for n in m.unreadable])
        self.clean()

    def abort(self, messages) -> None:
        self.give_up()


class StreamPages(_Pages, DataSourceStreamArrowWriter):
    """Pages (name, page_no and image or content) numbered by arrival."""

    def write(self, iterator):
        return self.stage(iterator, lambda row: (row["name"].as_py() or "", row["page_no"].as_py() or 0))

    def committed(self, before: int) -> dict:
        """The record of the last micro-batch before this one."""
        from pyarrow import fs

        where, path = sinks._filesystem(f"{self.root}/_committed")
        done = [int(f.base_name.removesuffix(".json")) for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if re.fullmatch(r"\d+\.json", f.base_name)]
        last = max((b for b in done if b < before), default=None)
        if last is None:
            return {"first": self.start, "count": 0}
        with where.open_input_stream(f"{path}/{last}.json") as src:
            return json.loads(src.read())

    def commit(self, messages, batchId: int) -> None:
        last = self.committed(batchId)
        first = last["first"] + last["count"]
        pages = sorted(((natural(name), name, page_no), f"{m.folder}/{mine}") for m in messages if m for (name, page_no), mine in m.pages)
        self.publish([(staged, self.file(first + i)) for i, (_, staged) in enumerate(pages)])
        self.record(str(batchId), first=first, count=len(pages), unreadable=[n for m in messages if m for n in m.unreadable])
        self.clean()

    def abort(self, messages, batchId: int) -> None:
        self.give_up()


class PageFiles(DataSource):
    """spark.dataSource.register(PageFiles); write.format("docraster_pages").option("path", ...).

    Options: path, ext (png), base (page; empty for bare numbers) and start (1).
    """

    @classmethod
    def name(cls) -> str:
        return "docraster_pages"

    def schema(self) -> str:
        return "page_seq long, name string, page_no int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, content binary"

    def writer(self, schema, overwrite: bool) -> BatchPages:
        return BatchPages(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamPages:
        return StreamPages(dict(self.options))
