"""Raster operators as Spark plans against the numpy kernels and known shapes, on pages of different sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docraster.functions import kernels as K
from docraster.operators import raster as R


def table(spark, pages):
    """page, y, x, p of arrays; and their sizes."""
    rows = [(k, y, x, int(img[y, x])) for k, img in pages.items() for y in range(img.shape[0]) for x in range(img.shape[1])]
    sizes = [(k, *img.shape) for k, img in pages.items()]
    return spark.createDataFrame(rows, "page long, y int, x int, p int").repartition(3), spark.createDataFrame(sizes, "page long, height int, width int")


def array(rows, page):
    own = [r for r in rows if r["page"] == page]
    out = np.zeros((1 + max(r["y"] for r in own), 1 + max(r["x"] for r in own)), int)
    for r in own:
        out[r["y"], r["x"]] = r["p"]
    return out


def turned(h, w, angle, half_h, half_w, inside=230, outside=20):
    y, x = np.mgrid[0:h, 0:w]
    t = math.radians(angle)
    u, v = (x - w / 2) * math.cos(t) + (y - h / 2) * math.sin(t), -(x - w / 2) * math.sin(t) + (y - h / 2) * math.cos(t)
    return np.where((abs(u) <= half_w) & (abs(v) <= half_h), inside, outside).astype(np.uint8)


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(5)
    return {1: rng.integers(0, 256, (30, 41), np.uint8), 2: rng.integers(90, 140, (12, 25), np.uint8), 3: np.full((3, 1), 77, np.uint8)}


def test_neighbourhoods_follow_the_kernels(spark, noisy):
    px, _ = table(spark, noisy)
    for made, kernel, off in ((R.blurred(px), lambda i: K.saturated(K.gaussian(i, 5)), 1), (R.sharpened(px), K.sharpen, 1)):
        rows = made.collect()
        for k in (1, 2):
            got, want = array(rows, k), kernel(noisy[k]).astype(int)
            if k == 1:  # the kernels repeat the border of pages that are smaller than their reach
                assert np.abs(got - want).max() <= off and (got != want).mean() < 0.02
        assert (array(rows, 3) == 77).all()
    rows = R.adaptive(px).collect()
    assert (array(rows, 1) != K.adaptive_threshold(noisy[1])).mean() < 0.01


def test_downscale_is_the_mean_of_what_is_covered(spark, noisy):
    px, sizes = table(spark, noisy)
    to = sizes.withColumns({"to_height": F.when(F.col("page") == 1, 15).otherwise(F.greatest(F.lit(1), (F.col("height") * 2 / 3).cast("int"))), "to_width": F.when(F.col("page") == 1, 41).otherwise(F.greatest(F.lit(1), (F.col("width") / 3).cast("int")))})
    rows = R.downscaled(px, to).collect()
    pairs = noisy[1].astype(int).reshape(15, 2, 41).sum(1)
    assert (array(rows, 1) == np.rint(pairs / 2)).all()
    assert array(rows, 2).shape == (8, 8) and abs(array(rows, 2).mean() - noisy[2].mean()) < 1
    same = R.downscaled(px, sizes.withColumns({"to_height": F.col("height"), "to_width": F.col("width")})).collect()
    assert all((array(same, k) == noisy[k]).all() for k in noisy)


def test_skew_of_turned_pages(spark):
    pages = {k: turned(60, 80, a, 12, 25, 20, 230) for k, a in enumerate((0, 7, -20, 33))} | {9: np.full((20, 20), 128, np.uint8)}
    px, _ = table(spark, pages)
    got = {r["page"]: r["angle"] for r in R.page_angles(px).collect()}
    assert got[0] == 0 and got[9] == 0 and all(abs(got[k] - a) < 2.5 for k, a in ((1, 7), (2, -20), (3, 33)))


def test_lines_between_the_outermost_edges(spark):
    img = np.zeros((120, 160), np.uint8)
    img[20:100, [30, 31, 130]] = 255
    img[[20, 99], 30:131] = 255
    blank = np.zeros((40, 40), np.uint8)
    three = np.zeros((100, 100), np.uint8)
    three[10:90, 20] = three[10:90, 70] = 255
    three[50, 10:90] = 255  # only one level line
    px, sizes = table(spark, {1: img, 2: blank, 3: three})
    peaks = R.hough_peaks(R.hough_votes(px.where("p > 0")))
    lines = R.hough_lines(peaks, sizes)
    assert {r["page"] for r in lines.collect()} <= {1, 3}
    # the steps and peaks are those of the kernel
    kernel = [(r, round(math.degrees(t))) for r, t in K.hough_lines(img, 60)]
    mine = {(float(r["rho"]), r["angle"]) for r in peaks.where("page = 1 and n > 60").collect()}
    assert mine == set(kernel)
    quads = {r["page"]: [(p["x"], p["y"]) for p in r["quad"]] for r in R.line_quads(lines).collect()}
    assert set(quads) == {1}
    assert np.abs(np.array(quads[1]) - [(30, 20), (130, 20), (130, 99), (30, 99)]).max() < 2.5


def test_a_frame_has_an_inner_outline(spark):
    frame = np.zeros((40, 50), np.uint8)
    frame[5:35, 5:45] = 255
    frame[12:28, 14:38] = 0
    frame[18:20, 20:22] = 255  # a speck in the hole
    snake = np.zeros((21, 21), np.uint8)
    snake[::2] = 255
    snake[1::4, -1] = snake[3::4, 0] = 255
    px, sizes = table(spark, {1: frame, 2: snake, 3: np.zeros((5, 5), np.uint8)})
    about, points = R.outlines(px.where("p > 0").select("page", "y", "x"), sizes)
    got = sorted((r["page"], r["kind"], r["n"], r["x0"], r["x1"], r["y0"], r["y1"]) for r in about.collect())
    assert got == [(1, "hole", 16 * 24 - 4, 14, 37, 12, 27), (1, "outer", 4, 20, 21, 18, 19), (1, "outer", 30 * 40 - 16 * 24, 5, 44, 5, 34), (2, "outer", int((snake > 0).sum()), 0, 20, 0, 20)]
    boxes = {(r["kind"], round(r["size"])) for r in R.smallest_boxes(points, ("page", "kind", "root")).where("page = 1").collect()}
    assert boxes == {("outer", 39 * 29), ("hole", 25 * 17), ("outer", 1)}
    best = {r["page"]: sorted((p["x"], p["y"]) for p in r["quad"]) for r in R.best_rectangles(px.where("p > 0").select("page", "y", "x"), sizes).collect()}
    assert best == {1: [(5.0, 5.0), (5.0, 34.0), (44.0, 5.0), (44.0, 34.0)], 2: [(0.0, 0.0), (0.0, 20.0), (20.0, 0.0), (20.0, 20.0)]}


def test_perspective_follows_the_kernel(spark):
    y, x = np.mgrid[0:40, 0:60]
    img = (x * 3 + y).astype(np.uint8)
    quad = [(10.0, 5.0), (50.0, 8.0), (47.0, 35.0), (6.0, 30.0)]
    px, _ = table(spark, {1: img})
    quads = spark.createDataFrame([(1, quad)], "page long, quad array<struct<x:double,y:double>>")
    got, want = array(R.straightened(px, quads).collect(), 1), K.warp(img, np.array(quad)).astype(int)
    assert got.shape == want.shape and np.abs(got - want).max() <= 2


def flooded(mask, corners):
    """Labels by a plain flood, in the order of the first pixels; 0 where not set."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n, todo = n + 1, [start]
        out[start] = n
        while todo:
            y, x = todo.pop()
            for b, a in ((b, a) for b in (y - 1, y, y + 1) for a in (x - 1, x, x + 1) if corners or b == y or a == x):
                if 0 <= b < mask.shape[0] and 0 <= a < mask.shape[1] and mask[b, a] and not out[b, a]:
                    out[b, a] = n
                    todo.append((b, a))
    return out


def test_outlines_over_several_bands_and_words_against_a_flood(spark, monkeypatch):
    from docraster.plans import ordering

    kept, plain = [], ordering.settled
    monkeypatch.setattr(ordering, "settled", lambda df: kept.append(1) or plain(df))
    rng = np.random.default_rng(8)
    comb = np.zeros((150, 70), bool)  # teeth that meet in the third band only, around the ground and holes
    comb[3:140, ::6] = comb[139] = comb[20, 40:60] = True
    pages = {1: rng.random((200, 131)) < 0.42, 2: comb, 3: ~comb, 4: np.ones((65, 64), bool), 5: np.zeros((128, 3), bool), 6: rng.random((40, 65)) < 0.5}
    sizes = spark.createDataFrame([(k, *m.shape) for k, m in pages.items()], "page long, height int, width int")
    mask = spark.createDataFrame([(k, int(y), int(x)) for k, m in pages.items() for y, x in zip(*np.nonzero(m))], "page long, y int, x int").repartition(3)
    want, hole_points = set(), set()
    for k, m in pages.items():
        for kind, labels in (("outer", flooded(m, True)), ("hole", flooded(~m, False))):
            for i in range(1, labels.max() + 1):
                y, x = np.nonzero(labels == i)
                if kind == "hole" and (min(y.min(), x.min()) == 0 or y.max() == m.shape[0] - 1 or x.max() == m.shape[1] - 1):
                    continue
                root = (int(y[0]) << 32) + int(x[0])
                want.add((k, kind, root, len(y), x.min(), x.max(), y.min(), y.max()))
                if kind == "hole":
                    hole_points |= {(k, root, b + d, a + e) for b, a in zip(y.tolist(), x.tolist()) for d, e in ((0, 1), (0, -1), (1, 0), (-1, 0)) if m[b + d, a + e]}
    about, points = R.outlines(mask, sizes)
    columns = ("page", "kind", "root", "n", "x0", "x1", "y0", "y1")
    assert {tuple(r[c] for c in columns) for r in about.collect()} == want
    got = {(r["page"], r["root"], r["y"], r["x"]) for r in points.where("kind = 'hole'").collect()}
    assert {p for p in got if pages[p[0]][p[2], p[3]]} <= hole_points

    def reach(points):  # that of their hulls in eight directions
        out = {}
        for k, root, y, x in points:
            for way in ((0, 1), (1, 0), (1, 1), (1, -1)):
                for sign in (1, -1):
                    key, at = (k, root, way, sign), sign * (way[0] * y + way[1] * x)
                    out[key] = max(out.get(key, at), at)
        return out

    assert hole_points and reach(got) == reach(hole_points)
    assert {tuple(r[c] for c in columns) for r in R.outline_bounds(mask, sizes).collect()} == want
    # pages of one band are done when that is labelled
    kept.clear()
    few = R.outline_bounds(mask.where("page = 6"), sizes.where("page = 6")).collect()
    assert {tuple(r[c] for c in columns) for r in few} == {w for w in want if w[0] == 6} and len(kept) == 1
