"""The background job, and bursts by time."""

import time
from datetime import datetime, timedelta

import pytest

from docraster.plans.jobs import Busy, Jobs
from docraster.streaming import camera


def test_a_job_is_cancelled_and_keeps_what_it_wrote(spark, tmp_path):
    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    jobs = Jobs(spark)
    assert jobs.status() == "No running job." and not jobs.cancel()
    chunk = lambda k: lambda: spark.range(10).write.mode("overwrite").parquet(str(tmp_path / f"c{k}"))
    steps = [("first", chunk(1)), ("slow", lambda: spark.range(4).mapInPandas(slow, "id long").write.parquet(str(tmp_path / "c2"))), ("never", chunk(3))]
    jobs.start("Import", steps)
    with pytest.raises(Busy, match="already running"):
        jobs.start("Other", steps)
    for _ in range(300):
        if len(jobs.results) == 1 and "slow" in jobs.status() and spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.1)
    assert 33 <= jobs.percent() < 100 and jobs.status().startswith("Import | slow | ")
    began = time.time()
    assert jobs.cancel() and jobs.wait(60) == "cancelled" and time.time() - began < 15
    assert jobs.status() == "Import: cancelled"
    assert spark.read.parquet(str(tmp_path / "c1")).count() == 10 and not (tmp_path / "c3").exists()
    jobs.start("Again", [("count", lambda: spark.range(5).count())])
    assert jobs.wait(60) == "done" and jobs.results == [5] and jobs.percent() == 100
    jobs.start("Bad", [("fails", lambda: spark.sql("select * from nowhere_at_all"))])
    assert jobs.wait(60) == "failed" and "nowhere_at_all" in jobs.status()


def frames(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(1, i, at(i), True) for i in range(12)] + [(2, i, at(i), i != 5) for i in range(12)] + [(3, 0, at(0), True)]
    return spark.createDataFrame(rows, "cam long, frame_no long, ts timestamp, ok boolean")


def test_bursts_wait_and_fail(spark):
    got = sorted(tuple(r) for r in camera.burst_by_time(frames(spark), 3, 2.5, 1).collect())
    assert got == [(1, 1, 1, None), (1, 5, 2, None), (1, 9, 3, None), (2, 1, 1, None), (2, 5, 2, "Failed to capture frame 2/3.")]
    assert camera.burst_by_time(frames(spark).where("false"), 3, 1).collect() == []
    for bad, said in (((0, 1), "shots"), ((1, -1), "delay_sec")):
        with pytest.raises(ValueError, match=said):
            camera.burst_by_time(frames(spark), *bad)


def test_a_burst_goes_on_over_batches_and_devices(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.dataSource.register(camera.PatternCamera)
    src = spark.readStream.format("docraster_camera").option("per_batch", 5).option("frames", 20).option("devices", 2).option("fail_every", 10).load()
    timed = src.select("cam", "frame_no", F.timestamp_seconds("frame_no").alias("ts"), F.col("data").isNotNull().alias("ok"))
    q = camera.burst_stream(timed, 4, 3, 1).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["cam"], r["frame_no"], r["shot"], r["error"]) for r in spark.sql("select * from bursts").collect())
    assert got == [(c, n, s, e) for c in (0, 1) for n, s, e in ((1, 1, None), (5, 2, None), (9, 3, "Failed to capture frame 3/4."))]
