"""Numbering rows over the whole table without bringing them into one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster names; one of our own only where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own and not sc.master.startswith("local"):  # executors would not see a folder of this machine
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or "file://" + tempfile.mkdtemp(prefix="docraster-"))
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """The rows spread evenly over the tasks of a shuffle, four to a core at least, for work that is far larger than they are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def numbered(df: DataFrame, name: str, *order: Column | str, start: int = 1) -> DataFrame:
    """Adds a running number in this order: rows are dealt by ranges of it and sorted there, and each range starts
    after the rows of those before it. Only one row per range goes to all tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, before = [], start
    for p in sorted(sizes):
        first.append((p, before))
        before += sizes[p]
    offsets = df.sparkSession.createDataFrame(first or [(0, start)], "_part long, _first long")
    local = F.col("_at").bitwiseAND((1 << 33) - 1)
    out = dealt.withColumn("_part", part.cast("long")).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_first") + local).drop("_at", "_part", "_first")


def numbered_apart(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like ``numbered`` for wide rows with unique keys: rows are made once and kept, only their keys are sorted."""
    df = settled(df)
    return df.join(numbered(df.select(*keys), name, *keys), [*keys])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below the checkpoint folder, which driver and executors both see."""
    settled(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
