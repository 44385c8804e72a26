"""Frames of a camera: bursts, names and health; and a data source that streams a test pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor


def burst(frames: DataFrame, shots: int, warmup_reads: int = 4) -> DataFrame:
    """Of each camera's numbered frames (cam, frame_no), those that a burst keeps: the one after each run of discarded ones."""
    if shots < 1:
        raise ValueError("shots must be at least 1")
    if warmup_reads < 0:
        raise ValueError("warmup_reads must not be negative")
    every = warmup_reads + 1
    kept = frames.where((F.col("frame_no") % every == warmup_reads) & (F.col("frame_no") < shots * every))
    return kept.withColumn("shot", F.floor(F.col("frame_no") / every).cast("long"))


class Shots:
    """A burst by time, one frame after another: for each shot some frames are discarded, the next one is kept, and no frame
    counts until ``delay`` has passed since. A failed read at a shot ends the burst."""

    def __init__(self, shots: int, warmup_reads: int, delay_us: int, state: tuple | None = None):
        self.shots, self.warmup, self.delay = shots, warmup_reads, delay_us
        self.shot, self.left, self.ready, self.over = state or (0, warmup_reads, None, False)

    def state(self) -> tuple:
        return self.shot, self.left, self.ready, self.over

    def take(self, at_us: int, ok: bool) -> tuple[int, str | None] | None:
        """The number of the shot that this frame is, and why it failed."""
        if self.over or (self.ready is not None and at_us < self.ready):
            return None
        if self.left:
            self.left -= 1
            return None
        self.shot, self.left, self.ready = self.shot + 1, self.warmup, at_us + self.delay
        self.over = self.shot == self.shots or not ok
        return self.shot, None if ok else f"Failed to capture frame {self.shot}/{self.shots}."


def _checked(shots: int, warmup_reads: int, delay_sec: float) -> tuple[int, int, int]:
    if shots < 1:
        raise ValueError("shots must be >= 1")
    if delay_sec < 0:
        raise ValueError("delay_sec must be >= 0")
    return shots, max(0, warmup_reads), int(delay_sec * 1_000_000)


def burst_by_time(frames: DataFrame, shots: int, delay_sec: float, warmup_reads: int = 4) -> DataFrame:
    """cam, frame_no, shot (from 1) and error of each camera's burst over its frames (cam, frame_no, ts, ok) in order of time:
    frames are dealt by camera and sorted, and of a camera only the burst's state is held."""
    import pyarrow as pa

    options = _checked(shots, warmup_reads, delay_sec)

    def task(batches):
        now, own = None, object()
        for b in batches:
            out = []
            for cam, no, at, ok in zip(*(b.column(c).to_pylist() for c in ("cam", "frame_no", "at", "ok"))):
                if cam != own:
                    now, own = Shots(*options), cam
                if found := now.take(at, bool(ok)):
                    out.append((cam, no, *found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["cam", "frame_no", "shot", "error"])

    f = frames.select(F.col("cam").cast("long").alias("cam"), F.col("frame_no").cast("long").alias("frame_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ok").where("at is not null")
    return f.repartition("cam").sortWithinPartitions("cam", "at", "frame_no").mapInArrow(task, "cam long, frame_no long, shot int, error string")


class Burst(StatefulProcessor):
    """The same on a stream: each camera's burst goes on from batch to batch."""

    def __init__(self, options: tuple[int, int, int]):
        self.options = options

    def init(self, handle) -> None:
        self.about = handle.getValueState("burst", "shot int, left int, ready long, over boolean")

    def handleInputRows(self, key, rows, timerValues):
        now = Shots(*self.options, state=tuple(self.about.get()) if self.about.exists() else None)
        for row in sorted(rows, key=lambda r: (r.at, r.frame_no)):
            if found := now.take(row.at, bool(row.ok)):
                yield Row(cam=key[0], frame_no=row.frame_no, shot=found[0], error=found[1])
        self.about.update(now.state())

    def close(self) -> None:
        pass


def burst_stream(frames: DataFrame, shots: int, delay_sec: float, warmup_reads: int = 4) -> DataFrame:
    """``burst_by_time`` for a stream whose batches come in order of time."""
    from docraster.streaming.sessions import PROVIDER

    frames.sparkSession.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    f = frames.select(F.col("cam").cast("long").alias("cam"), F.col("frame_no").cast("long").alias("frame_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ok")
    return f.groupBy("cam").transformWithState(Burst(_checked(shots, warmup_reads, delay_sec)), "cam long, frame_no long, shot int, error string", "Append", "None")


def capture_name(ts: Column | str, micros: bool = False) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss" + "_SSSSSS" * micros)


def health(is_open: Column, is_previewing: Column, error_text: Column) -> Column:
    """Struct (label, color), which are fixed values: an error comes first, then preview, then open."""
    state = lambda label, color: F.struct(F.lit(label).alias("label"), F.lit(color).alias("color"))
    bad = F.coalesce(error_text, F.lit("")) != ""
    return F.when(bad, state("Error", "red")).when(is_previewing, state("Previewing", "green")).when(is_open, state("Open", "orange")).otherwise(state("Closed", "gray"))


class _Part(InputPartition):
    def __init__(self, cam: int, start: int, end: int):
        super().__init__((cam, start))
        self.cam, self.start, self.end = cam, start, end


class PatternReader(DataSourceStreamReader):
    """Frames 0, 1, 2, ... of a moving ramp; ``per_batch`` of them each time that Spark asks, ``frames`` in all if given. Each
    of ``devices`` is a partition of its own. Every ``fail_every``-th read fails: a frame without data."""

    def __init__(self, options: dict):
        self.width, self.height = int(options.get("width", 16)), int(options.get("height", 12))
        self.step, self.at = int(options.get("per_batch", 8)), 0
        self.end = int(options.get("frames", 1 << 62))
        self.devices, self.fail = int(options.get("devices", 1)), int(options.get("fail_every", 0))

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.end, self.at + self.step)
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> list:
        return [_Part(cam, start["frame"], end["frame"]) for cam in range(self.devices)]

    def read(self, partition: _Part):
        import numpy as np

        ramp = np.add.outer(np.arange(self.height), np.arange(self.width))
        for i in range(partition.start, partition.end):
            failed = self.fail and i % self.fail == self.fail - 1
            yield (partition.cam, i, self.height, self.width, None if failed else ((ramp + i) % 256).astype(np.uint8).tobytes())

    def commit(self, end: dict) -> None:
        pass


class PatternCamera(DataSource):
    """spark.dataSource.register(PatternCamera); spark.readStream.format("docraster_camera"). Stands in for a device."""

    @classmethod
    def name(cls) -> str:
        return "docraster_camera"

    def schema(self) -> str:
        return "cam int, frame_no long, height int, width int, data binary"

    def streamReader(self, schema) -> PatternReader:
        return PatternReader(self.options)


#: Fixed value: the largest resolution that a camera is asked for.
MOST_RESOLUTION = (3264, 2448)


def resolution(text: Column) -> Column:
    """struct(width, height) of a text like 1920x1080; null for anything else."""
    t = F.trim(text)
    side = lambda k: F.regexp_extract(t, r"^(\d+)x(\d+)$", k).cast("int").alias(("width", "height")[k - 1])
    return F.when(F.rlike(t, F.lit(r"^\d{1,9}x\d{1,9}$")), F.struct(side(1), side(2)))
