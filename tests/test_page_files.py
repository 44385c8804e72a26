"""The sink of numbered page files and the reader of single pages: what a lost task, a second run and a filter leave."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from docraster.functions import codec
from docraster.sources import documents, files, sinks
from docraster.sources.pagefiles import PageFiles

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def flat(v, h=4, w=5):
    return files.pack(np.full((h, w, 3), v, np.uint8))


def values(folder):
    return {n: int(codec.png_image((folder / n).read_bytes())[0, 0, 0]) for n in sorted(os.listdir(folder)) if n.endswith(".png")}


def test_a_batch_and_its_names(spark, tmp_path):
    pages = spark.createDataFrame([(i, flat(i)) for i in range(1, 8)], f"page_seq long, image {IMAGE}").repartition(3)
    out = tmp_path / "out"
    assert sorted(r["path"] for r in sinks.export_files(pages, str(out), ".PNG", base="", start=10).collect())[0].endswith("/00010.png")
    assert values(out) == {f"{i + 9:05d}.png": i for i in range(1, 8)} and not (out / "_staging").exists()
    sinks.export_files(pages.where("page_seq < 3").withColumn("image", F.first("image").over(__import__("pyspark").sql.Window.partitionBy())), str(out), base="", start=10)
    assert len(values(out)) == 7  # the same names again
    twice = pages.withColumn("page_seq", F.lit(1).cast("long"))
    with pytest.raises(Exception, match="one number"):
        sinks.export_files(twice, str(tmp_path / "twice"))
    assert values(tmp_path / "twice") == {} if (tmp_path / "twice").exists() else True
    with pytest.raises(ValueError, match="no encoder"):
        sinks.export_files(pages, str(out), "webp")


def test_a_failed_run_leaves_no_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, flat(i)) for i in range(1, 30)], f"page_seq long, image {IMAGE}").repartition(4)
    bad = pages.withColumn("image", F.when(F.col("page_seq") == 17, F.raise_error(F.lit("no page")).cast(files.schema.IMAGE)).otherwise(F.col("image")))
    out = tmp_path / "out"
    with pytest.raises(Exception, match="no page"):
        sinks.export_files(bad, str(out))
    left = [f for d, _, names in os.walk(out) for f in names]
    assert left == []


KILLED = """
import os, signal, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "2").getOrCreate()
import numpy as np
from docraster.sources import files, sinks
out, mark = sys.argv[1:]
image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
pages = spark.createDataFrame([(i, files.pack(np.full((3, 3, 3), i, np.uint8))) for i in range(1, 21)], f"page_seq long, image {image}").repartition(2)

def once(batches):
    for k, pdf in enumerate(batches):
        if k == 3 and not os.path.exists(mark):
            open(mark, "w").close()
            os.kill(os.getpid(), signal.SIGKILL)
        yield pdf

sinks.export_files(pages.mapInPandas(once, pages.schema), out)
"""


def test_a_killed_task_runs_again_and_leaves_its_pages_once(tmp_path):
    from conftest import ROOT

    out, mark = tmp_path / "out", tmp_path / "mark"
    done = subprocess.run([sys.executable, "-c", KILLED, str(out), str(mark)], cwd=ROOT, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    assert mark.exists()
    assert values(out) == {f"page_{i:05d}.png": i for i in range(1, 21)}
    assert sorted(os.listdir(out)) == ["_committed", *sorted(values(out))]


def test_numbers_run_on_across_batches(spark, tmp_path):
    from docraster.streaming.ingest import to_files

    src, out, ck = tmp_path / "src", tmp_path / "out", tmp_path / "ck"
    schema = f"name string, page_no int, image {IMAGE}"
    parts = [[("p10", 0, flat(3)), ("p2", 2, flat(2)), ("p2", 1, flat(1))], [("a1", 0, flat(4)), ("broken", 0, None)], [("z", 0, flat(5))]]
    for rows in parts[:2]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    to_files(spark, stream(), str(out), str(ck)).awaitTermination()
    assert sorted(values(out).values()) == [1, 2, 3, 4]
    records = [json.loads((out / "_committed" / f"{b}.json").read_bytes()) for b in (0, 1)]
    assert sum(r["count"] for r in records) == 4 and [n for r in records for n in r["unreadable"]] == ["broken"]
    assert records[1]["first"] == 1 + records[0]["count"]
    before = values(out)
    spark.createDataFrame(parts[2], schema).coalesce(1).write.mode("append").parquet(str(src))
    os.remove(ck / "commits" / "1")  # as if the driver had died before it noted the second batch: that runs again
    (ck / "commits" / ".1.crc").unlink(missing_ok=True)
    to_files(spark, stream(), str(out), str(ck)).awaitTermination()
    assert values(out) == {**before, "page_00005.png": 5}


def test_ingest_of_all_codecs_numbers_on(spark, tmp_path):
    from docraster.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    photo = spark._jvm.java.awt.image.BufferedImage(8, 6, 5)
    spark._jvm.javax.imageio.ImageIO.write(photo, "jpg", spark._jvm.java.io.File(str(folder / "photo.jpg")))
    (folder / "a.png").write_bytes(codec.png_bytes(np.full((3, 3, 3), 9, np.uint8)))
    run = lambda: ingest.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), per_batch=2).awaitTermination()
    run()
    (folder / "d.pdf").write_bytes(codec.pdf_bytes([np.full((3, 3, 3), v, np.uint8) for v in (1, 2)]))
    (folder / "e.jpg").write_bytes(b"broken")
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("page_seq", "name", F.col("error").isNull(), F.col("image.nChannels")).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5]
    assert [g[1:] for g in got] == [("a.png", True, 3), ("photo.jpg", True, 3), ("d.pdf [p0001]", True, 3), ("d.pdf [p0002]", True, 3), ("e.jpg", False, None)]


@pytest.mark.parametrize("ext", ["tif", "bmp", "png"])
def test_other_codecs_out_and_back(spark, tmp_path, ext):
    rng = np.random.default_rng(0)
    colour, gray = rng.integers(0, 256, (5, 7, 3), np.uint8), rng.integers(0, 256, (6, 3), np.uint8)
    pages = spark.createDataFrame([(1, files.pack(colour)), (2, files.pack(gray))], f"page_seq long, image {IMAGE}")
    sinks.export_files(pages, str(tmp_path / "out"), ext)
    got = {r["name"]: files.unpack(r["image"]) for r in files.images(spark, str(tmp_path / "out")).collect()}
    assert (got[f"page_00001.{ext}"] == colour).all()
    two = got[f"page_00002.{ext}"]
    assert (two == (gray if two.ndim == 2 else gray[..., None])).all()


def test_jpeg_to_png_and_into_a_document(spark, tmp_path):
    photo = spark._jvm.java.awt.image.BufferedImage(8, 6, 5)
    for name, kind in (("b.jpg", "jpg"), ("c.bmp", "bmp")):
        spark._jvm.javax.imageio.ImageIO.write(photo, kind, spark._jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "a.png").write_bytes(codec.png_bytes(np.full((3, 4), 7, np.uint8)))
    listed = files.in_natural_order(files.folder(spark, str(tmp_path)), "page_seq")
    out = tmp_path / "out"
    sinks.export_existing(listed, str(out), "png")
    assert (out / "page_00001.png").read_bytes() == (tmp_path / "a.png").read_bytes()
    assert [codec.png_image((out / f"page_0000{i}.png").read_bytes()).shape for i in (2, 3)] == [(6, 8, 3), (6, 8, 3)]
    raw = open(sinks.export_paths_pdf(listed, str(out / "all.pdf")), "rb").read()
    assert raw.count(b"/DCTDecode") == 1 and b"/Count 3" in raw
    (tmp_path / "d.bmp").write_bytes(b"no image")
    with pytest.raises(Exception, match="Cannot read image: d.bmp"):
        sinks.export_existing(files.in_natural_order(files.folder(spark, str(tmp_path)), "page_seq"), str(tmp_path / "none"), "png")
    assert not [f for _, _, names in os.walk(tmp_path / "none") for f in names]


@pytest.fixture()
def shelf(tmp_path):
    for name, n in (("long.pdf", 40), ("short.pdf", 2)):
        (tmp_path / name).write_bytes(codec.pdf_bytes([np.random.default_rng(i).integers(0, 256, (30, 20, 3), np.uint8) for i in range(n)]))
    (tmp_path / "other.pdf").write_bytes(b"%PDF-1.4 of others")
    (tmp_path / "notes.txt").write_text("no")
    return tmp_path


def test_a_filter_on_the_page_reaches_the_reader(spark, shelf, monkeypatch):
    pages = documents.document_pages(spark, str(shelf))
    assert pages.count() == 43 and pages.where("error is not null").count() == 1
    one = pages.where("page_no = 17")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("Filters", "").replace("BatchScan", "")  # met by the reader, not by Spark
    assert [r["name"] for r in one.collect()] == ["long.pdf"]
    some = pages.where("page_no > 1 AND page_no <= 3 AND name = 'long.pdf'").orderBy("page_no").collect()
    assert [r["page_no"] for r in some] == [2, 3]
    assert sum(r["read_bytes"] for r in some) < 5 * 1800 < os.path.getsize(shelf / "long.pdf") / 4
    # one page of many is inflated
    reader = documents.PageReader({"path": str(shelf / "long.pdf")})
    assert list(reader.pushFilters([documents.In(("page_no",), (5, 99, None)), documents.EqualTo(("name",), "x")])) == [documents.EqualTo(("name",), "x")]
    inflated = []
    real = documents.zlib.decompress
    monkeypatch.setattr(documents.zlib, "decompress", lambda b: inflated.append(len(real(b))) or real(b))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[3] for r in rows] == [5] and inflated.count(30 * 20 * 3) == 1  # Python itself inflates modules


def test_chosen_pages_come_in_order_and_as_often_as_named(spark, shelf):
    got = documents.read_selected(spark, str(shelf), [1, 0, 1, 5]).orderBy("path", "pos").collect()
    by = {n: [(r["idx"], r["page_name"], r["image"] is not None, r["error"]) for r in got if r["path"].endswith(n)] for n in ("long.pdf", "short.pdf", "other.pdf")}
    assert by["short.pdf"] == [(1, "short.pdf [p0002]", True, None), (0, "short.pdf [p0001]", True, None), (1, "short.pdf [p0002]", True, None), (5, None, False, "PDF page index out of range: 5")]
    assert [b[1] for b in by["long.pdf"]] == ["long.pdf [p0002]", "long.pdf [p0001]", "long.pdf [p0002]", "long.pdf [p0006]"]
    assert all("Cannot read document" in b[3] for b in by["other.pdf"])
    first = np.random.default_rng(1).integers(0, 256, (30, 20, 3), np.uint8)
    assert (files.unpack(got[0]["image"]) == first).all()


def test_natural_keys_agree(spark):
    from docraster.functions.names import natural_key
    from docraster.sources.pagefiles import natural

    names = ["a10.png", "a2.png", "A1", "10", "9b", "", "x_y", "b007c12"]
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", natural_key("name").alias("k")).collect()
    assert all([(p["s"], int(p["d"])) for p in r["k"]] == natural(r["name"]) for r in got)
    assert PageFiles({"path": "x"}).name() == "docraster_pages"
