"""Pages through the detectors: dealt to many tasks, handed back a few at a time, and the kernels against plain loops."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docraster.functions import kernels as K
from docraster.operators import detect
from docraster.plans.queries import QUERIES, small_pages
from docraster.schema import ARROW_IMAGE
from docraster.sources import files


def test_pages_of_one_small_file_are_drawn_and_scanned_by_many_tasks(spark):
    out = QUERIES["detect_pages"](spark, "/root/testdata/sf0.001")
    rows = out.select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in rows}) >= 8 and len(rows) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    k = next(r for r in rows if r["page_seq"] == 37)
    assert (k["name"], k["backend"], k["detected"]) == ("37.png", "opencv_hough", True) and "paddleocr_uvdoc" in k["errors"]
    img = np.full((180, 240, 3), 30, np.uint8)
    img[20 + 37 % 7 : 150 + 37 % 11, 30 + 37 % 13 : 200 + 37 % 17] = 235
    assert (k["height"], k["width"]) == detect.scan(img, ("opencv_hough",))[0].warped.shape[:2]


def test_batches_are_parted_by_rows_and_by_bytes():
    sizes = [4, 4, 90, 4, 4, 4]
    batch = pa.RecordBatch.from_arrays([pa.array([files.pack(np.zeros((1, n), np.uint8)) for n in sizes] + [None], ARROW_IMAGE)], names=["image"])
    assert [p.num_rows for p in files.parts(batch.slice(1), "image", 3, 50)] == [1, 1, 3, 1]
    assert [None if i is None else i["data"].size for i in files.images_of(batch.slice(4).column("image"))] == [4, 4, None]


def test_lines_of_some_degrees_are_those_of_all():
    rng = np.random.default_rng(3)
    edges = rng.random((60, 90)) < 0.05
    edges[10], edges[:, 70] = True, True
    every, some = K.LineVotes(edges), K.LineVotes(edges, detect.STEEP_OR_LEVEL)
    plain = np.zeros_like(every.votes)
    for y, x in zip(*np.nonzero(edges)):
        for k, t in enumerate(np.deg2rad(np.arange(180))):
            plain[k, round(x * np.cos(t) + y * np.sin(t)) + every.reach] += 1
    assert (every.votes == plain).all()
    for least in (3, 20, 50):
        wanted = [(r, t) for r, t in every.lines(least) if np.degrees(t) < 30 or np.degrees(t) > 150 or 60 < np.degrees(t) < 120]
        assert wanted and set(wanted) <= set(some.lines(least))


def test_components_of_a_spiral_and_a_gray_page_in_colours():
    spiral = np.zeros((31, 31), bool)
    for k in range(0, 15, 2):
        spiral[k, k : 31 - k] = spiral[k : 31 - k, 30 - k] = spiral[30 - k, k : 31 - k] = spiral[k + 2 : 31 - k, k] = True
        spiral[k + 2, k : k + 2] = True
    assert K.components(spiral)[1] == 1
    assert K.components(np.eye(9, dtype=bool))[1] == 1 and K.components(np.zeros((3, 0), bool))[1] == 0
    gray = np.random.default_rng(1).integers(0, 256, (40, 50), np.uint8)
    quad = np.array([(3.5, 2), (47, 4), (44, 38), (1, 35)])
    colours = np.stack([gray, gray, 255 - gray], -1)
    assert (K.warp(np.stack([gray] * 3, -1), quad) == K.warp(gray, quad)[..., None]).all()
    assert all((K.warp(colours, quad)[..., c] == K.warp(np.ascontiguousarray(colours[..., c]), quad)).all() for c in range(3))


def test_small_pages_are_drawn_by_spark_and_take_one_python_worker(spark, tmp_path):
    odd = [0.25, None, float("nan"), float("inf"), float("-inf"), -1.5, 1.5, -1.0, 1.0, 0.003921569] + [k / 27 - 1 for k in range(54)]
    spark.createDataFrame([(5, odd), (-2, odd[::-1])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    pages = {r["page_seq"]: (r["name"], files.unpack(r["image"])) for r in small_pages(spark, str(tmp_path)).collect()}
    v = np.array([0 if x is None else x for x in odd], np.float32).astype(float)
    want = np.clip(np.floor((np.nan_to_num(v, nan=-9, posinf=9, neginf=-9) + 1) * 127.5), 0, 255).astype(np.uint8)
    want[1] = 0  # what is missing is black
    assert pages[5][0] == "5.png" and (pages[5][1].ravel() == want).all() and (pages[-2][1].ravel() == want[::-1]).all()
    made = small_pages(spark, "/root/testdata/sf0.001")
    assert not [x for x in ("MapInPandas", "MapInArrow") if x in made._jdf.queryExecution().toString()]
    from docraster.plans.pipeline import Options, processed

    twice = processed(made, Options(detect_document=False, two_page_mode=True))
    assert [r["page_seq"] for r in twice.orderBy("page_seq").collect()] == list(range(1, 2 * made.count() + 1))
