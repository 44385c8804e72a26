"""Geometry as column expressions: points are structs (x, y), quads arrays of four of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels of a rendered page, the longer side for detection, and the least share of a page.
MOST_PIXELS, DETECTION_SIDE, LEAST_AREA = 150_000_000, 1600, 0.12


def point(pts: Column, i: int) -> Column:
    return F.get(pts, F.lit(i))


def _first_by(pts: Column, key, smallest: bool) -> Column:
    """The first point with the smallest (largest) key."""
    ranked = F.transform(pts, lambda p, i: F.struct((key(p) if smallest else -key(p)).alias("k"), i.alias("i"), p.alias("p")))
    return F.array_min(ranked)["p"]


def order_quad(pts: Column) -> Column:
    """Top left, top right, bottom right, bottom left, by the sums and differences of the coordinates."""
    total, gap = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(_first_by(pts, total, True), _first_by(pts, gap, True), _first_by(pts, total, False), _first_by(pts, gap, False))


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def warp_size(quad: Column) -> Column:
    """Struct (width, height) of the page that an ordered quad is straightened to; 1 at least."""
    tl, tr, br, bl = (point(quad, i) for i in range(4))
    side = lambda a, b: F.greatest(F.lit(1), F.greatest(a, b).cast("int"))
    return F.struct(side(distance(tr, tl), distance(br, bl)).alias("width"), side(distance(bl, tl), distance(br, tr)).alias("height"))


def area(pts: Column, n: int = 4) -> Column:
    """Shoelace area of a polygon of n points."""
    total = F.lit(0.0)
    for i in range(n):
        a, b = point(pts, i), point(pts, (i + 1) % n)
        total = total + a["x"].cast("double") * b["y"] - b["x"].cast("double") * a["y"]
    return F.abs(total) / 2


def contour_score(pts: Column, image_area: Column | float) -> Column:
    """10 times the share of the image, plus the share of the integer bounding box (ends included); -1 without area."""
    image_area = image_area if isinstance(image_area, Column) else F.lit(float(image_area))
    span = lambda c: F.array_max(F.transform(pts, lambda p: p[c])) - F.array_min(F.transform(pts, lambda p: p[c])) + 1
    a = area(pts)
    return F.when(a <= 0, F.lit(-1.0)).otherwise(10 * a / F.greatest(F.lit(1.0), image_area) + a / F.greatest(F.lit(1.0), (span("x") * span("y")).cast("double")))


def convex(pts: Column) -> Column:
    """Whether all turns of a quad go the same way."""
    turns = []
    for i in range(4):
        a, b, c = (point(pts, (i + k) % 4) for k in range(3))
        turns.append((b["x"] - a["x"]).cast("double") * (c["y"] - b["y"]) - (b["y"] - a["y"]).cast("double") * (c["x"] - b["x"]))
    return F.least(*turns) * F.greatest(*turns) > 0


def line_x_at(rho: Column, theta: Column, y: Column) -> Column:
    return F.when(F.abs(F.cos(theta)) > 1e-6, (rho - y * F.sin(theta)) / F.cos(theta))


def line_y_at(rho: Column, theta: Column, x: Column) -> Column:
    return F.when(F.abs(F.sin(theta)) > 1e-6, (rho - x * F.cos(theta)) / F.sin(theta))


def line_kind(theta: Column) -> Column:
    """vertical, horizontal, or null for slanted lines."""
    deg = F.degrees(F.pmod(theta, F.lit(3.141592653589793)))
    return F.when((deg < 30) | (deg > 150), "vertical").when((deg > 60) & (deg < 120), "horizontal")


def intersection(rho_a: Column, theta_a: Column, rho_b: Column, theta_b: Column) -> Column:
    """Where two lines (rho, theta) meet, as (x, y); null if they are parallel."""
    det = F.cos(theta_a) * F.sin(theta_b) - F.sin(theta_a) * F.cos(theta_b)
    x = (rho_a * F.sin(theta_b) - rho_b * F.sin(theta_a)) / det
    y = (rho_b * F.cos(theta_a) - rho_a * F.cos(theta_b)) / det
    return F.when(F.abs(det) >= 1e-6, F.struct(x.alias("x"), y.alias("y")))


def safe_dpi(width_pt: Column, height_pt: Column, dpi: int, most: int = MOST_PIXELS) -> Column:
    """The resolution asked for, or the largest one at which a page stays within so many pixels."""
    w, h = width_pt / 72.0 * dpi, height_pt / 72.0 * dpi
    capped = F.greatest(F.lit(1), F.floor(dpi * F.sqrt(most / (w * h))).cast("int"))
    return F.when((width_pt <= 0) | (height_pt <= 0) | (w * h <= most), F.lit(dpi)).otherwise(capped)


def fitted(width: Column, height: Column, most_width: int, most_height: int) -> Column:
    """Struct (scale, width, height) of an image made to fit, never enlarged."""
    scale = F.least(most_width / width, most_height / height, F.lit(1.0))
    side = lambda v: F.greatest(F.lit(1), F.floor(v * scale).cast("int"))
    return F.struct(scale.alias("scale"), side(width).alias("width"), side(height).alias("height"))


def to_source(pts: Column, width: Column, height: Column, shown_width: Column, shown_height: Column) -> Column:
    """Points of a shown image in the coordinates of its source."""
    return F.transform(pts, lambda p: F.struct((p["x"] * width / F.greatest(F.lit(1), shown_width)).alias("x"), (p["y"] * height / F.greatest(F.lit(1), shown_height)).alias("y")))


def full_frame(width: Column, height: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero = F.lit(0)
    return F.array(corner(zero, zero), corner(width - 1, zero), corner(width - 1, height - 1), corner(zero, height - 1))


def clamped(pts: Column, width: Column, height: Column) -> Column:
    side = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, v))
    return F.transform(pts, lambda p: F.struct(side(p["x"], width).alias("x"), side(p["y"], height).alias("y")))


def nearest_handle(pts: Column, x: Column, y: Column, reach: float = 14.0) -> Column:
    """Index of the nearest point within reach, the last one if tied; null if there is none."""
    d2 = F.transform(pts, lambda p, i: F.struct(((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)).cast("double").alias("d2"), (-i).alias("i")))
    best = F.array_min(F.filter(d2, lambda s: s["d2"] <= reach * reach))
    return F.when(best.isNotNull(), -best["i"])
