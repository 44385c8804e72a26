"""Folders to pages to files and documents, sessions, streams and the registered queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docraster.functions import codec, geometry, names
from docraster.operators import presets, session
from docraster.plans import benchmark, pipeline
from docraster.sources import files, sinks


def image(value, h=24, w=32):
    return np.full((h, w, 3), value, np.uint8)


@pytest.fixture
def folder(tmp_path):
    for i, v in ((10, 10), (2, 20), (1, 30)):
        (tmp_path / f"page{i}.png").write_bytes(codec.png_bytes(image(v)))
    (tmp_path / "notes.txt").write_text("no page")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "page0.png").write_bytes(codec.png_bytes(image(1)))
    return tmp_path


def rows_of(pages):
    return [(r["name"], int(files.unpack(r["image"])[0, 0, 0])) for r in pages.orderBy("page_seq").collect()]


def test_folder_in_natural_order_with_documents(spark, folder):
    (folder / "page3.pdf").write_bytes(codec.pdf_bytes([image(40), image(50)], 72))
    assert rows_of(files.load(spark, str(folder))) == [("page1.png", 30), ("page2.png", 20), ("page3.pdf [p0001]", 40), ("page3.pdf [p0002]", 50), ("page10.png", 10)]


def test_unreadable_files_are_told(spark, folder):
    (folder / "page4.png").write_bytes(b"nothing")
    with pytest.raises(Exception, match="Cannot read image"):
        files.load(spark, str(folder)).collect()
    with pytest.raises(ValueError):
        files.pages(spark.range(0), 60)
    with pytest.raises(ValueError, match="Missing"):
        files.checked_list(spark, [str(folder / "gone.png")])
    with pytest.raises(ValueError, match="Unsupported"):
        files.checked_list(spark, [str(folder / "notes.txt")])
    given = files.checked_list(spark, [str(folder / "page2.png"), str(folder / "page1.png"), str(folder / "page2.png")])
    assert [r["name"] for r in given.orderBy("file_seq").collect()] == ["page2.png", "page1.png"]


def test_spark_image_source_agrees(spark, folder):
    got = {r["name"]: files.unpack(r["image"]) for r in files.images(spark, str(folder)).collect()}
    assert (got["page10.png"] == image(10)).all()


def test_extensions_and_keys(spark):
    df = spark.createDataFrame([(n,) for n in ("a.PNG", ".png", "a.", "a..jpg", "a", "b.pdf", "x.tar.tif")], "name string")
    assert [r[0] for r in df.where(names.supported("name")).collect()] == ["a.PNG", "a..jpg", "b.pdf", "x.tar.tif"]
    df = spark.createDataFrame([(n,) for n in ("page10.png", "Page1.png", "page2.png", "a", "10")], "name string")
    assert [r[0] for r in df.orderBy(names.natural_key("name")).collect()] == ["10", "a", "Page1.png", "page2.png", "page10.png"]


def test_page_numbers(spark):
    df = spark.createDataFrame([("3,9",), ("3 9;12",), (" 3,9,3,12,9 ",), ("  ",), (",;",)], "raw string")
    assert [r[0] for r in df.select(names.page_numbers(F.col("raw"))).collect()] == [[3, 9], [3, 9, 12], [3, 9, 12], None, None]
    for bad, said in (("0", "must be >= 1"), ("3,abc", "Invalid page value: abc")):
        with pytest.raises(Exception, match=said):
            spark.createDataFrame([(bad,)], "raw string").select(names.page_numbers(F.col("raw"))).collect()


def test_selected_pages_keep_the_callers_order(spark):
    docs = spark.createDataFrame([("d.pdf", 2)], "name string, n_pages int")
    got = files.selected_pages(docs, [1, 0, 1, 5]).orderBy("pos").select("page_name", "error").collect()
    assert [tuple(r) for r in got] == [("d.pdf [p0002]", None), ("d.pdf [p0001]", None), ("d.pdf [p0002]", None), (None, "PDF page index out of range: 5")]


def test_pipeline_splits_spreads(spark):
    spread = np.concatenate([np.full((20, 20, 3), (10, 20, 30), np.uint8), np.full((20, 20, 3), (40, 50, 60), np.uint8)], axis=1)
    pages = spark.createDataFrame([(1, "s", files.pack(spread))], "page_seq long, name string, image " + "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    out = pipeline.processed(pages, pipeline.Options(detect_document=False, two_page_mode=True)).orderBy("page_seq").collect()
    assert [files.unpack(r["image"])[0, 0].tolist() for r in out] == [[10, 20, 30], [40, 50, 60]]
    with pytest.raises(ValueError, match="Unsupported postprocess mode"):
        pipeline.processed(pages, pipeline.Options(postprocess="Sepia"))
    kept = pipeline.processed(pages, pipeline.Options(postprocess="Grayscale")).collect()  # no model: the image stays
    assert kept[0]["image"]["nChannels"] == 1 and not kept[0]["detected"]


def test_exports(spark, folder, tmp_path):
    pages = files.load(spark, str(folder))
    out = tmp_path / "out"
    paths = sorted(r["path"] for r in sinks.export_files(pages, str(out), ".PNG").collect())
    assert [p.rpartition("/")[2] for p in paths] == ["page_00001.png", "page_00002.png", "page_00003.png"]
    assert codec.png_image(open(paths[2], "rb").read())[0, 0, 0] == 10
    pdf = sinks.export_pdf(pages, str(tmp_path / "all.png"), 180)
    assert pdf.endswith("all.pdf") and [int(i[0, 0, 0]) for i in codec.pdf_images(open(pdf, "rb").read())] == [30, 20, 10]
    listed = files.numbered(files.folder(spark, str(folder)).where("name like '%.png'"), "page_seq", names.natural_key("name"), "name")
    copied = sinks.export_existing(listed, str(tmp_path / "copy"), "png").orderBy("page_seq").first()["path"]
    assert open(copied, "rb").read() == (folder / "page1.png").read_bytes()
    with pytest.raises(ValueError, match="No pages to export"):
        sinks.export_files(pages.where("false"), str(out))
    five = sinks.assets(pages.select(F.col("name").alias("entry_id"), "image").limit(1)).collect()
    assert {r["asset"] for r in five} == {"original", "current", "preview_original", "preview_current", "thumb"}


def test_sessions(spark):
    pages = spark.createDataFrame([(1, e, i, e, False, 10, 10) for i, e in enumerate("abc")], "session_id long, entry_id string, pos long, name string, selected boolean, original int, current int")
    order = lambda df: "".join(r["entry_id"] for r in df.orderBy("pos").collect())
    moved = session.move(pages, "c", -1)
    assert order(moved) == "acb" and order(session.move(moved, "c", 1)) == "abc"
    assert order(session.move(pages, "a", -1)) == "abc" and order(session.move(pages, "x", 1)) == "abc"
    assert session.remove_selected(session.select_all(pages)).count() == 0
    left = session.remove_selected(session.select_positions(pages, [1]))
    assert [(r["entry_id"], r["pos"]) for r in left.orderBy("pos").collect()] == [("a", 0), ("c", 1)]
    new = spark.createDataFrame([("b", 140, 220, " new_name "), ("x", 1, 1, "y")], "entry_id string, original int, current int, name string")
    got = {r["entry_id"]: (r["original"], r["current"], r["name"]) for r in session.replace(pages, new).collect()}
    assert got == {"a": (10, 10, "a"), "b": (140, 220, "new_name"), "c": (10, 10, "c")}
    more = spark.createDataFrame([(1, "d", 0), (2, "e", 0)], "session_id long, entry_id string, seq long")
    assert {(r["entry_id"], r["pos"]) for r in session.append(pages, more).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 0)}


def test_report_keeps_failed_backends(spark):
    results = spark.createDataFrame([(1, 0, "a", True), (2, 0, "a", False)], "page long, backend_ord int, backend string, detected boolean")
    assert benchmark.summary(benchmark.report(results, "in", [(1, "uvdoc", "uvdoc missing"), (2, "b", "")])) == "a: in_a.pdf (detected 1/2)\nuvdoc: failed - uvdoc missing\nb: failed - "


def test_crop_benchmark_ignores_its_own_outputs(spark, folder):
    from docraster.cli import crop_benchmark

    for _ in range(2):
        rows = {r["backend"]: r for r in crop_benchmark(spark, str(folder), str(folder), ["opencv_quad", "paddleocr_uvdoc"]).collect()}
        assert (rows["opencv_quad"]["total_pages"], rows["opencv_quad"]["detected_pages"]) == (3, 0)
        assert rows["paddleocr_uvdoc"]["output_pdf"] is None and "paddleocr_uvdoc" in rows["paddleocr_uvdoc"]["error"]


def test_file_stream(spark, folder, tmp_path):
    from docraster.streaming import ingest

    out = str(tmp_path / "table")
    ingest.ingest(spark, str(folder), out, str(tmp_path / "ck"), per_batch=2).awaitTermination()
    got = spark.read.parquet(out)
    assert {r["name"] for r in got.collect()} == {"page1.png", "page2.png", "page10.png"} and got.select("batch").distinct().count() == 2


def test_camera_stream(spark):
    from docraster.streaming import camera

    spark.dataSource.register(camera.PatternCamera)
    frames = spark.readStream.format("docraster_camera").option("per_batch", 10).option("frames", 20).load()
    q = camera.burst(frames, 3).select("frame_no", "shot").writeStream.format("memory").queryName("burst").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select * from burst").collect()) == [(4, 0), (9, 1), (14, 2)]


def test_session_stream(spark, tmp_path):
    from docraster.streaming import ingest

    log = [(1, i, op, arg) for i, (op, arg) in enumerate([("add", 0), ("add", 0), ("select", 0), ("remove_selected", 0), ("add", 1), ("replace", 0)])]
    schema = "session_id long, op_seq long, op string, arg int"
    for k in (0, 1):
        spark.createDataFrame(log[k * 3 : k * 3 + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = ingest.session_stream(stream).writeStream.outputMode("update").format("memory").queryName("pages").start()
    q.processAllAvailable()
    q.stop()
    final = {r["entry_id"]: r["name"] for r in session.folded(spark.createDataFrame(log, schema)).collect()}
    seen = {(r["entry_id"], r["name"]) for r in spark.sql("select * from pages").collect()}
    assert set(final.items()) <= seen


def test_geometry_and_presets(spark):
    one = spark.range(1)
    size = one.select(geometry.safe_dpi(F.lit(7200.0), F.lit(14400.0), 300), geometry.safe_dpi(F.lit(595.0), F.lit(842.0), 300), geometry.safe_dpi(F.lit(0.0), F.lit(1.0), 300)).first()
    assert tuple(size) == (86, 300, 300)
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 5), (0, 5))))
    got = one.select(geometry.convex(pts), geometry.area(pts), geometry.nearest_handle(pts, F.lit(1.0), F.lit(1.0)), geometry.nearest_handle(pts, F.lit(99.0), F.lit(1.0))).first()
    assert tuple(got) == (True, 50.0, 0, None)
    df = spark.createDataFrame([("Document", "Grayscale"), ("Photo", "Sharpen")], "preset string, post string")
    assert {r["lens_mode"] for r in presets.infer_lens_mode(df).collect()} == {"Document", "Custom"}


def test_entry_works_without_the_optional_part(tmp_path):
    """In a copy without those folders, and without a library that only they need."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e; print(sorted(e.queries()), len(e.oracle_sql()))"
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in ("llm", ".git", "corpus_pipeline.py")])
    said = []
    for where in (ROOT, copy):
        out = subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(where)})
        assert out.returncode == 0, out.stderr
        said.append(out.stdout)
    assert said[0] == said[1] and "session_fold" in said[0] and "op1" not in said[0]
