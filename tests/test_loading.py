"""Folders and lists of mixed codecs, and runs in which something is broken."""

import struct
import zlib

import numpy as np
import pytest

from docraster.functions import codec
from docraster.sources import files


@pytest.fixture()
def mixed(spark, tmp_path):
    """PNG (colour, gray, palette), JPEG and BMP written by the JVM, and a document."""
    image = spark._jvm.java.awt.image.BufferedImage
    for name, kind, value in (("b 10.jpg", "jpg", 200), ("a+2%.bmp", "bmp", 60)):
        img = image(16, 12, 5)
        for y in range(12):
            for x in range(16):
                img.setRGB(x, y, value << 16 | value << 8 | value)
        spark._jvm.javax.imageio.ImageIO.write(img, kind, spark._jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "a1.png").write_bytes(codec.png_bytes(np.full((5, 7, 3), (10, 20, 30), np.uint8)))
    (tmp_path / "gray3.png").write_bytes(codec.png_bytes(np.full((5, 7), 90, np.uint8)))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    palette = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 3, 0, 0, 0)) + chunk(b"PLTE", bytes([1, 2, 3, 7, 8, 9])) + chunk(b"IDAT", zlib.compress(b"\0\1\1\0\1\1")) + chunk(b"IEND", b"")
    (tmp_path / "p4.png").write_bytes(palette)
    (tmp_path / "doc5.pdf").write_bytes(codec.pdf_bytes([np.full((6, 6, 3), v, np.uint8) for v in (1, 2)]))
    (tmp_path / "notes.txt").write_text("no")
    return tmp_path


def seen(df):
    return [(r["name"], files.unpack(r["image"]).shape, int(files.unpack(r["image"])[0, 0, 0])) for r in df.orderBy("page_seq").collect()]


EXPECTED = [("a1.png", (5, 7, 3), 10), ("a+2%.bmp", (12, 16, 3), 60), ("b 10.jpg", (12, 16, 3), 200), ("doc5.pdf [p0001]", (6, 6, 3), 1), ("doc5.pdf [p0002]", (6, 6, 3), 2), ("gray3.png", (5, 7, 3), 90), ("p4.png", (2, 2, 3), 9)]


def test_a_folder_of_many_codecs(spark, mixed):
    got = seen(files.load(spark, str(mixed)))
    assert sorted(got) == sorted(EXPECTED)
    assert [g[0] for g in got].index("doc5.pdf [p0001]") + 1 == [g[0] for g in got].index("doc5.pdf [p0002]")


def test_a_list_keeps_its_order(spark, mixed):
    names = ["gray3.png", "doc5.pdf", "b 10.jpg", "a1.png", "gray3.png"]
    got = seen(files.load_list(spark, [str(mixed / n) for n in names]))
    assert [g[0] for g in got] == ["gray3.png", "doc5.pdf [p0001]", "doc5.pdf [p0002]", "b 10.jpg", "a1.png"]
    assert set(got) <= set(EXPECTED)


def test_broken_files_and_backends_leave_the_others(spark, mixed, monkeypatch):
    from docraster.cli import crop_benchmark
    from docraster.sources import sinks

    (mixed / "broken6.jpg").write_bytes(b"no image")
    (mixed / "broken7.pdf").write_bytes(b"%PDF-1.4 of others")
    with pytest.raises(Exception, match="Cannot read image"):
        files.load(spark, str(mixed)).collect()
    write = sinks.export_pdf

    def failing(pages, path, dpi):
        if path.endswith("_opencv_minrect.pdf"):
            raise RuntimeError("disk full")
        return write(pages, path, dpi)

    monkeypatch.setattr(sinks, "export_pdf", failing)
    rows = {r["backend"]: r for r in crop_benchmark(spark, str(mixed), str(mixed / "out"), ["opencv_minrect", "opencv_quad", "uvdoc"]).collect()}
    assert rows["opencv_minrect"]["error"] == "disk full" and rows["opencv_minrect"]["output_pdf"] is None
    assert "uvdoc" in rows["uvdoc"]["error"]
    assert rows["opencv_quad"]["total_pages"] == len(EXPECTED) and rows["opencv_quad"]["error"] is None
    assert len(codec.pdf_images((mixed / "out" / f"{mixed.name}_opencv_quad.pdf").read_bytes())) == len(EXPECTED)


def test_errors_of_backends_stay_with_their_page(spark):
    from docraster.plans import pipeline

    spread = np.full((20, 40, 3), 200, np.uint8)
    pages = spark.createDataFrame([(1, "s", files.pack(spread))], "page_seq long, name string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    rows = pipeline.processed(pages, pipeline.Options(two_page_mode=True)).orderBy("page_seq").collect()
    assert [r["page_seq"] for r in rows] == [1, 2] and all("paddleocr_uvdoc" in r["errors"][0] and not r["detected"] for r in rows)


def test_paths_to_one_document(spark, mixed):
    """JPEG bytes go in as they are, others decoded; the list of pages is whole and in order."""
    from docraster.sources import sinks

    listed = spark.createDataFrame([(2, "b 10.jpg"), (1, "a1.png"), (3, "gray3.png")], "page_seq long, name string")
    content = spark.read.format("binaryFile").load(str(mixed)).select(files.file_name("path").alias("name"), "content")
    raw = open(sinks.export_paths_pdf(listed.join(content, "name"), str(mixed / "all.x"), 144), "rb").read()
    assert raw.startswith(b"%PDF-1.4") and b"/Count 3" in raw and (mixed / "b 10.jpg").read_bytes() in raw
    assert raw.index(b"/Width 7") < raw.index(b"/Width 16") and raw.count(b"/DCTDecode") == 1 and raw.count(b"/DeviceGray") == 1
    places = [int(line[:10]) for line in raw[raw.rindex(b"\nxref") + 1 :].split(b"\n")[3:14]]
    assert all(raw[at:].startswith(b"%d 0 obj" % (i + 1)) for i, at in enumerate(places))
    assert codec.jpeg_size((mixed / "b 10.jpg").read_bytes()) == (16, 12, 3) and codec.jpeg_size(b"\xff\xd8\xff") is None
    with pytest.raises(ValueError, match="No image paths"):
        sinks.export_paths_pdf(listed.join(content, "name").where("false"), str(mixed / "all.pdf"))


def test_corners_make_a_new_original(spark):
    from docraster.operators.detect import cropped

    img = np.full((40, 60, 3), 20, np.uint8)
    img[10:30, 15:45] = 220
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    pages = spark.createDataFrame([("a", files.pack(img)), ("b", files.pack(img))], f"entry_id string, original {image}")
    corners = spark.createDataFrame([("a", [(15.0, 10.0), (44.0, 10.0), (44.0, 29.0), (15.0, 29.0)])], "entry_id string, contour array<struct<x:float,y:float>>")
    got = {r["entry_id"]: files.unpack(r["original"]) for r in cropped(pages, corners).collect()}
    assert got["a"].min() > 200 and got["a"].shape[0] < 25 and (got["b"] == img).all()
