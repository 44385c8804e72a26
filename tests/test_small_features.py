"""Aliases of backends, pages replaced from files, unreadable pages in the report, paths for exports."""

import numpy as np
import pytest

from docraster.functions import codec
from docraster.operators import detect, session
from docraster.sources import files

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def test_an_alias_runs_its_backend_under_its_own_name():
    registry = {"uvdoc": detect.by_model("uvdoc", lambda img: [{"doctr_img": img[:2]}])}
    found, errors = detect.scan(np.zeros((5, 5, 3), np.uint8), ["paddleocr_uvdoc"], registry)
    assert found.detected and found.backend == "paddleocr_uvdoc" and not errors
    assert detect.scan(np.zeros((5, 5, 3), np.uint8), ["uvdoc"], registry)[0].backend == "uvdoc"
    none = detect.scan(np.zeros((5, 5, 3), np.uint8), ["paddleocr_uvdoc"], {"x": None})
    assert none[1] and not none[0].detected


def test_lines_ask_for_four():
    three = np.full((300, 300), 20, np.uint8)
    three[:, 100:102] = 255  # two edges, both upright
    assert detect.find_lines(three, 4) is None and detect.find_lines(three) is None


def test_a_page_is_replaced_from_a_file(spark, tmp_path):
    (tmp_path / "new.png").write_bytes(codec.png_bytes(np.full((2, 3, 3), 9, np.uint8)))
    old = files.pack(np.zeros((1, 1, 3), np.uint8))
    pages = spark.createDataFrame([(1, "a", 0, "A", True, old, old, "/x/a"), (1, "b", 1, "B", False, old, old, "/x/b")], f"session_id long, entry_id string, pos long, name string, selected boolean, original {IMAGE}, current {IMAGE}, path string")
    got = {r["entry_id"]: r for r in session.replace_from_file(pages, "b", str(tmp_path / "new.png")).collect()}
    assert (got["b"]["name"], got["b"]["pos"], got["b"]["current"]["width"]) == ("new.png", 1, 3) and got["a"]["current"]["width"] == 1
    (tmp_path / "bad.png").write_bytes(b"no")
    with pytest.raises(Exception, match="Cannot read image"):
        session.replace_from_file(pages, "b", str(tmp_path / "bad.png")).collect()
    with pytest.raises(KeyError):
        session.replace_from_file(pages, "zz", str(tmp_path / "new.png"))
    paths = session.export_paths(pages, True)
    assert [tuple(r) for r in paths.collect()] == [(1, 1, "/x/a")]


def test_the_report_counts_unreadable_pages(spark, tmp_path):
    from docraster.cli import crop_benchmark

    (tmp_path / "a.png").write_bytes(codec.png_bytes(np.full((9, 9, 3), 9, np.uint8)))
    (tmp_path / "b.jpg").write_bytes(b"no image")
    row = crop_benchmark(spark, str(tmp_path), str(tmp_path / "out"), ["opencv_quad"]).first()
    assert (row["total_pages"], row["unreadable_pages"]) == (1, 1)
