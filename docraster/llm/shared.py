"""Places and rows that all training-data operators share.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which driver and executors both see, so
a lost executor costs a retry and never a result.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below the cluster's shared folder; one of our own only where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            base = set_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="docraster-")
            spark.sparkContext.setCheckpointDir(base)
        else:  # executors would not see a folder of this machine
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are kept within are deleted at the end; nothing that is lazy may need them any longer."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            removed(spark, path)


def kept(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df once to the shared folder (or to a path in it) and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or shared_folder(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow's file system for a URI or plain path, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Writes byte strings under a task's own name, then moves them in place: a retry replaces, never mixes."""
    where, path = filesystem(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    mine, size = f"{path}.{uuid.uuid4().hex}", 0
    with where.open_output_stream(mine, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    where.move(mine, path)
    return size


_LOCAL: dict[str, str] = {}


def mapped(uri: str, dtype) -> np.ndarray:
    """A file of the shared folder as a memory map; from a remote store it is first copied beside the worker."""
    from pyarrow import fs

    where, path = filesystem(uri)
    if not isinstance(where, fs.LocalFileSystem):
        if uri not in _LOCAL:
            mine = os.path.join(tempfile.mkdtemp(prefix="docraster-"), os.path.basename(path))
            with where.open_input_stream(path, compression=None) as src, open(mine, "wb") as out:
                while block := src.read(1 << 22):
                    out.write(block)
            _LOCAL[uri] = mine
        path = _LOCAL[uri]
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def _libc(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):  # another C library
        pass


def hand_back() -> None:
    """Gives memory that this process no longer uses back to the system: allocators of processes that live on keep it."""
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim", 0)


M_MMAP_THRESHOLD = -3


def lean(task, drop: bool = False):
    """A task for mapInArrow that hands back memory when it ends: its worker goes on to other tasks, and what several of
    them keep adds up to an executor's limit. With ``drop`` large arrays go back as soon as they are dropped, which costs
    a tenth more time."""

    def run(batches):
        if drop:
            _libc("mallopt", M_MMAP_THRESHOLD, 2 << 20)
        try:
            yield from task(batches)
        finally:
            hand_back()

    return run


def fold(mod: int, left_out: int = 2, column: str = "doc_id") -> Column:
    """True for rows kept from learning: crc32 of the id as text leaves this remainder; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod == left_out, F.lit(False))


def batches_of(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20):
    """Slices of a record batch with about ``size`` bytes of text each; a longer text makes a slice of its own."""
    if not batch.num_rows:
        return
    lengths = np.diff(offsets_of(batch.column(column))) + 1
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def offsets_of(texts: pa.Array) -> np.ndarray:
    lengths = np.asarray(pc.binary_length(texts).fill_null(0), np.int64)
    return np.concatenate([[0], np.cumsum(lengths)])


def within(sample: DataFrame, chars: int) -> DataFrame:
    """Of a written sample of a bounded number of rows, those in order of ``u`` whose whole texts have ``chars`` characters
    between them. A text with over a tenth of that is left out whole, so that no few texts make up the sample."""
    fitting = sample.where(F.length("text") <= chars // 10)
    left = chars
    for r in fitting.select("u", F.length("text").alias("n")).orderBy("u", "n").collect():
        left -= r["n"]
        if left < 0:
            return fitting.where(F.col("u") < r["u"])
    return fitting


def sample_of_labels(spark: SparkSession, labels: DataFrame, docs: DataFrame, label: str, rows: int, chars: int) -> list[tuple[str, int]]:
    """A bounded sample (whole text, label) to fit a classifier on, about half of either class.

    ``rows`` bounds the rows of a class and ``chars`` the characters in all (see ``within``). Rows are picked by a hash of
    their id at a rate that follows from the class sizes; of texts that share an id the first in order is taken.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold(4))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for y, n in sizes.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, rows / n))).otherwise(rate)
    picked = known.where(u < rate).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = {r.doc_id: r.y for r in picked.orderBy(u, "doc_id").limit(3 * rows).collect()}
    if not ids:
        return []
    few = spark.createDataFrame(list(ids.items()), "doc_id long, y int")
    got = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(few), "doc_id")
    got = got.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).withColumn("u", u)
    with scratch(spark):
        got = within(kept(got, "sample"), chars).collect()
    return [(r.text, r.y) for r in sorted(got, key=lambda r: r.doc_id)]


def labelled_sample(labels: DataFrame, docs: DataFrame, label: str, rows: int) -> tuple[DataFrame | None, float]:
    """doc_id, y and whole text of at most 3 * rows labelled documents outside the held-out fold, about half of either
    class, picked by a hash of their id; and the share of class 1 among all such labels. None where no label is known.

    Only ids come to the driver. A repeated label counts once, the larger if they differ; of texts that share an id the
    first in order is taken.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold(4))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None, 0.5
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for y, n in sizes.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, rows / n))).otherwise(rate)
    ids = known.where(u < rate).orderBy(u, "doc_id").limit(3 * rows).collect()
    few = labels.sparkSession.createDataFrame([(r.doc_id, r.y) for r in ids], "doc_id long, y int")
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return sample.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")), sizes.get(1, 0) / sum(sizes.values())


def column(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def removed(spark: SparkSession, uri: str) -> None:
    """Deletes a folder that ``shared_folder`` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hub_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", count: str = "n", least: int = 64) -> DataFrame:
    """left with right, which has one row of each key and tells in ``count`` how many rows of left have it.

    A key with more than a 10,000th of all those rows, and than ``least``, is a hub: at most 10,000 of them are
    broadcast, and their rows never meet in one task. All other rows are joined as Spark sees fit. Both sides are read
    twice where there are hubs, so they should be written tables.
    """
    key = [key] if isinstance(key, str) else key
    about = right.agg(F.sum(count).alias("rows"), F.max(count).alias("most")).first()
    limit = max(least, (about["rows"] or 0) // 10_000)
    if (about["most"] or 0) <= limit:
        return left.join(right.drop(count), key, how)
    hubs, rest = right.where(F.col(count) > limit).drop(count), right.where(F.col(count) <= limit).drop(count)
    others = left.join(F.broadcast(hubs.select(*key)), key, "left_anti").join(rest, key, how)
    return left.join(F.broadcast(hubs), key).unionByName(others)


def salted_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner", counted: DataFrame | None = None, least: int = 64) -> DataFrame:
    """left with right, either with any number of rows of a key; how: inner, left, left_semi or left_anti.

    Of a key with more than a 10,000th of left's rows (and than ``least``), left's rows are dealt by one more number, of as
    many as keep each deal at about that share, and right's are copied to each. There are at most 10,000 such keys, and
    only a hash of each and that number are broadcast; numbers sum to 20,000 at most. ``counted`` has a row with the key for
    each row of left; left itself if not given. Both should be written tables: they are read twice, and a task that is
    repeated must see its rows in the same order to deal them alike.
    """
    h = F.xxhash64(*key)
    counts = kept((left if counted is None else counted).groupBy(h.alias("_h")).agg(F.count("*").alias("_n")), "key-counts")
    limit = max(least, (counts.agg(F.sum("_n")).first()[0] or 0) // 10_000)
    hubs = counts.where(F.col("_n") > limit).select("_h", F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))
    if hubs.isEmpty():
        return left.join(right, key, how)
    near = F.coalesce("_salts", F.lit(1))
    dealt = left.withColumn("_h", h).join(F.broadcast(hubs), "_h", "left").withColumn("_salt", F.floor(F.rand(17) * near).cast("int")).drop("_h", "_salts")
    copied = right.withColumn("_h", h).join(F.broadcast(hubs), "_h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), near - 1))).drop("_h", "_salts")
    return dealt.join(copied, [*key, "_salt"], how).drop("_salt")
