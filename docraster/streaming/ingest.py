"""Pages as streams: files are taken in small batches and appended, or written to numbered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docraster.functions import names as N
from docraster.sources import files

CHUNK = 4


def file_stream(spark: SparkSession, folder: str, per_batch: int = CHUNK) -> DataFrame:
    """path and name of the supported files that appear in a folder, a few per batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)
    return stream.select("path", files.file_name("path").alias("name")).where(N.supported("name"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, dpi: int = 300, per_batch: int = CHUNK):
    """Appends the pages of new files to a Parquet table (batch, page_seq, name, image, error), batch by batch: images of
    all codecs and documents. What an earlier batch wrote stays.

    page_seq runs on: a batch starts after the last number of the one before it, which its record in ``_counts``
    tells. A batch that is run again after a crash writes the same numbers into the same folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        listed = files.in_natural_order(batch)
        paths = [r["path"] for r in batch.select("path").collect()]  # per_batch of them
        first = _counted(spark, out, epoch)
        if paths:
            pages = files.read_pages(spark, listed, paths, dpi).withColumn("page_seq", F.col("page_seq") + first)
            pages.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            n = spark.read.parquet(f"{out}/batch={epoch}").count()
        else:
            n = 0
        spark.createDataFrame([(epoch, first, n)], "epoch long, first long, n long").coalesce(1).write.mode("overwrite").json(f"{out}/_counts/{epoch}")

    return file_stream(spark, folder, per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _counted(spark: SparkSession, out: str, epoch: int) -> int:
    """How many pages the batches before this one have."""
    from docraster.sources.sinks import exists

    for e in range(epoch - 1, -1, -1):  # the last batch has a record, unless the table is new
        if exists(spark, f"{out}/_counts/{e}/_SUCCESS"):
            r = spark.read.schema("epoch long, first long, n long").json(f"{out}/_counts/{e}").first()
            return r["first"] + r["n"]
    return 0


def to_files(spark: SparkSession, pages: DataFrame, folder: str, checkpoint: str, ext: str = "png", base: str = "page", start: int = 1):
    """Writes a stream of pages (name, page_no, image) to numbered files, exactly once."""
    from docraster.sources.pagefiles import PageFiles

    spark.dataSource.register(PageFiles)
    out = pages.writeStream.format("docraster_pages").outputMode("append").option("path", folder).option("ext", ext).option("base", base).option("start", start)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(log: DataFrame, **options) -> DataFrame:
    from docraster.streaming.sessions import session_stream as stream

    return stream(log, **options)
