"""Neighbourhood work on pixels as Spark plans: tables of page, y, x and p, with no Python in the workers but
for the labels of bands of rows.

Sums are of whole numbers throughout (taps, trigonometric tables and bilinear shares are fixed-point), so a result is
the same however Spark groups the rows. A page's rows spread over tasks by row, column, line or target pixel; only the
windows of ``hough_peaks`` and the hull of ``skew_angles`` see what one page has left after counting: a few thousand
cells of votes, and two points a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docraster.functions import geometry as G
from docraster.functions.kernels import joined, touching

UNIT_BITS = 12


def whole_taps(size: int, sigma: float) -> list[int]:
    """Gaussian taps in units of 2^-12; the middle one takes what rounding leaves."""
    x = [i - (size - 1) / 2 for i in range(size)]
    k = [math.exp(-(v * v) / (2 * sigma * sigma)) for v in x]
    taps = [round(v / sum(k) * (1 << UNIT_BITS)) for v in k]
    taps[size // 2] += (1 << UNIT_BITS) - sum(taps)
    return taps


def within(at: Column, size: Column, border: str) -> Column:
    """A place outside of 0 .. size - 1 brought inside: mirrored about the first and last (``reflect``), or the nearest (``edge``)."""
    if border == "edge":
        return F.greatest(F.lit(0), F.least(size - 1, at))
    turn = F.greatest(F.lit(1), 2 * (size - 1))
    m = F.pmod(at, turn)
    return F.when(size == 1, F.lit(0)).otherwise(F.when(m < size, m).otherwise(turn - m))


def correlated(px: DataFrame, taps: Sequence[int], border: str = "reflect", value: str = "p", name: str = "total") -> DataFrame:
    """page, y, x and the sum of the pixels around each, weighed by taps[dy] * taps[dx].

    A row is an array, over which the taps run as one expression; then rows become columns in one shuffle, over which
    they run again.
    """
    weights, r = F.array(*(F.lit(int(t)).cast("long") for t in taps)), len(taps) // 2

    def along(lines: DataFrame, keys: list[str], at: str, v: str, out: str) -> DataFrame:
        line = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(v).cast("long").alias("v")))).alias("s"))
        line = line.select(*keys, F.col("s.v").alias("v"))
        size = F.size("v")
        one = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(len(taps) - 1)), F.lit(0).cast("long"), lambda a, k: a + F.get(weights, k) * F.get(F.col("v"), within(i + k - r, size, border)))
        return line.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), one)).alias(at, out))

    across = along(px, ["page", "y"], "x", value, "h")
    return along(across, ["page", "x"], "y", "h", name).select("page", "y", "x", name)


def blurred(px: DataFrame, size: int = 5, sigma: float = 0.0, border: str = "reflect") -> DataFrame:
    """p as the Gaussian mean around it, rounded half to even."""
    taps = whole_taps(size, sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8)
    return correlated(px, taps, border).select("page", "y", "x", F.bround(F.col("total") / float(1 << 2 * UNIT_BITS)).cast("int").alias("p"))


def sharpened(px: DataFrame) -> DataFrame:
    """1.5 times the page less half of its blur (19 taps, sigma 3), within 0 .. 255."""
    unit = 1 << 2 * UNIT_BITS
    both = correlated(px, whole_taps(19, 3.0)).join(px, ["page", "y", "x"])
    v = F.bround((F.col("p").cast("long") * (3 * unit) - F.col("total")) / float(2 * unit))
    return both.select("page", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)).cast("int").alias("p"))


def adaptive(px: DataFrame, block: int = 21, c: int = 15) -> DataFrame:
    """255 where a pixel lies above the Gaussian mean of its block less c; borders repeat."""
    mean = blurred(px, block, border="edge").withColumnRenamed("p", "mean")
    return px.join(mean, ["page", "y", "x"]).select("page", "y", "x", F.when(F.col("p") > F.col("mean") - c, 255).otherwise(0).alias("p"))


def black_and_white(px: DataFrame) -> DataFrame:
    """The post-processing of that name on gray pages."""
    return adaptive(sharpened(px))


def downscaled(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pages as the means of what each target pixel covers; sizes: page, height, width, and those to come, to_height, to_width.

    In units of 1 / to_height a row of the source reaches from y * to_height on, a target row from ty * height on: their
    overlap is a whole number, and so is every sum.
    """
    s = px.join(sizes.select("page", "height", "width", "to_height", "to_width"), "page")

    def reach(at: str, n: str, to: str) -> Column:
        first = F.floor(F.col(at) * F.col(to) / F.col(n)).cast("int")
        last = F.ceil((F.col(at) + 1) * F.col(to) / F.col(n)).cast("int") - 1
        share = lambda t: F.least((F.col(at) + 1) * F.col(to), (t + 1) * F.col(n)) - F.greatest(F.col(at) * F.col(to), t * F.col(n))
        return F.explode(F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("t"), share(t).cast("long").alias("w"))))

    s = s.withColumn("ty", reach("y", "height", "to_height")).withColumn("tx", reach("x", "width", "to_width"))
    sums = s.groupBy("page", F.col("ty.t").alias("y"), F.col("tx.t").alias("x")).agg(F.sum(F.col("p") * F.col("ty.w") * F.col("tx.w")).alias("total"), F.first(F.col("height").cast("long") * F.col("width")).alias("area"))
    return sums.select("page", "y", "x", F.bround(F.col("total") / F.col("area")).cast("int").alias("p"))


# --- lines ----------------------------------------------------------------------------------------------------

TRIG_BITS, ANGLES = 16, 180


def hough_votes(edges: DataFrame) -> DataFrame:
    """page, angle (degrees), rho and n: how many edge pixels (page, y, x) lie on each line x cos + y sin = rho. Every pixel
    votes once for each angle; votes are summed before and after the shuffle."""
    table = lambda f: F.array(*(F.lit(round(f(math.radians(a)) * (1 << TRIG_BITS))).cast("long") for a in range(ANGLES)))
    voted = edges.select("page", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(ANGLES - 1))).alias("angle"))
    at = F.col("x") * F.get(table(math.cos), F.col("angle")) + F.col("y") * F.get(table(math.sin), F.col("angle"))
    rho = F.shiftright(at + (1 << TRIG_BITS - 1), TRIG_BITS).cast("int")
    return voted.groupBy("page", "angle", rho.alias("rho")).agg(F.count("*").alias("n"))


def hough_peaks(votes: DataFrame) -> DataFrame:
    """Votes that exceed their lower neighbours, and are not below their higher ones, in distance and in angle."""
    votes = votes.repartition("page")
    along, across = W.partitionBy("page", "angle").orderBy("rho"), W.partitionBy("page", "rho").orderBy("angle")
    near = lambda w, k: F.coalesce(F.max("n").over(w.rangeBetween(k, k)), F.lit(0))
    v = votes.withColumns({"r0": near(along, -1), "r1": near(along, 1), "a0": near(across, -1), "a1": near(across, 1)})
    n = F.col("n")
    return v.where((n > F.col("r0")) & (n >= F.col("r1")) & (n > F.col("a0")) & (n >= F.col("a1"))).select("page", "angle", "rho", "n")


#: The least votes asked for, and the share of a page's shorter side, step by step.
LADDER = ((60, 0.35), (45, 0.25), (30, 0.18))
LEAST_LINES = 4


def hough_lines(peaks: DataFrame, sizes: DataFrame, ladder: Sequence[tuple[int, float]] = LADDER, least: int = LEAST_LINES) -> DataFrame:
    """The peaks of the first step of the ladder at which a page has ``least`` lines; none of a page that never has.
    sizes: page, height, width."""
    side = F.least("height", "width")
    steps = F.array(*(F.greatest(F.lit(floor), (side * share).cast("int")) for floor, share in ladder))
    known = peaks.join(sizes.select("page", "height", "width", steps.alias("steps")), "page")
    met = [F.count_if(F.col("n") > F.get("steps", F.lit(i))) >= least for i in range(len(ladder))]
    step = F.coalesce(*(F.when(m, F.lit(i)) for i, m in enumerate(met)))
    chosen = known.groupBy("page").agg(step.alias("step")).where("step is not null")
    return known.join(chosen, "page").where(F.col("n") > F.get("steps", F.col("step"))).select("page", "height", "width", "step", "angle", "rho", "n")


def line_quads(lines: DataFrame, margin: float = 0.15, least_area: float = G.LEAST_AREA) -> DataFrame:
    """page and quad: the corners between each page's outermost upright and level lines, ordered; only where they lie
    within the page (and ``margin`` of its sides around it) and hold ``least_area`` of it."""
    theta, rho = F.radians(F.col("angle").cast("double")), F.col("rho").cast("double")
    a = F.col("angle")  # whole degrees, so the bounds are exact
    kind = F.when((a < 30) | (a > 150), "vertical").when((a > 60) & (a < 120), "horizontal")
    known = lines.withColumns({"kind": kind, "x": G.line_x_at(rho, theta, F.col("height") / 2.0), "y": G.line_y_at(rho, theta, F.col("width") / 2.0)})
    line = F.struct(rho.alias("rho"), theta.alias("theta"))
    upright, level = F.col("kind") == "vertical", F.col("kind") == "horizontal"
    # the outermost; of lines that cross the middle in one place, those with more votes, then by angle and distance
    tie = lambda at, sign, of: F.when(of, F.struct(sign * F.round(at, 6), -F.col("n"), F.col("angle"), F.col("rho")))
    ends = {"left": ("x", 1, upright), "right": ("x", -1, upright), "top": ("y", 1, level), "bottom": ("y", -1, level)}
    page = known.groupBy("page", "height", "width").agg(*(F.min_by(line, tie(F.col(at), sign, of)).alias(n) for n, (at, sign, of) in ends.items()), F.count_if(upright & F.col("x").isNotNull()).alias("uprights"), F.count_if(level & F.col("y").isNotNull()).alias("levels"))
    page = page.where("uprights >= 2 AND levels >= 2")
    meet = lambda a, b: G.intersection(F.col(f"{a}.rho"), F.col(f"{a}.theta"), F.col(f"{b}.rho"), F.col(f"{b}.theta"))
    corners = F.array(meet("top", "left"), meet("top", "right"), meet("bottom", "right"), meet("bottom", "left"))
    page = page.select("page", "height", "width", corners.alias("pts")).where(F.forall("pts", lambda p: p.isNotNull()))
    page = page.withColumn("quad", G.order_quad(F.col("pts")))
    inside = lambda c, n: F.forall("quad", lambda p: p[c].between(-margin * F.col(n), (1 + margin) * F.col(n)))
    return page.where(inside("x", "width") & inside("y", "height") & (G.area(F.col("quad")) >= least_area * F.col("height") * F.col("width"))).select("page", "quad")


# --- skew -----------------------------------------------------------------------------------------------------


def _turn(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def chain(points: Column) -> Column:
    """One side of the convex hull of sorted points. A point that comes takes the place of those that no longer turn
    left: along a convex chain that holds up to some place and nowhere after it, so the last place at which it holds tells
    how much stays."""
    kind = "array<struct<x:bigint,y:bigint>>"

    def step(kept: Column, p: Column) -> Column:
        holds = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(kept))), lambda i: (i <= F.size(kept)) & (_turn(F.get(kept, i - 2), F.get(kept, i - 1), p) > 0))
        stays = F.coalesce(F.array_max(holds), F.least(F.lit(1), F.size(kept)))
        return F.concat(F.slice(kept, F.lit(1), stays), F.array(p))

    return F.aggregate(points, F.array().cast(kind), step)


def hulls(points: DataFrame, keys: Sequence[str] = ("page",)) -> DataFrame:
    """hull: the convex hull of the points (x, y) of each page, or of whatever ``keys`` name; only the outermost of each
    row are gathered. One or two points are their own hull."""
    rows = points.groupBy(*keys, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    ends = rows.select(*keys, F.explode(F.array_distinct(F.array(*(F.struct(F.col(c).cast("long").alias("x"), F.col("y").cast("long").alias("y")) for c in ("x0", "x1"))))).alias("p"))
    page = ends.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("pts"))
    low, high = chain(F.col("pts")), chain(F.reverse("pts"))
    page = page.select(*keys, low.alias("low"), high.alias("high"))
    inner = lambda c: F.slice(c, F.lit(1), F.greatest(F.lit(1), F.size(c) - 1))
    return page.select(*keys, F.array_distinct(F.concat(inner("low"), inner("high"))).alias("hull"))


def smallest_boxes(points: DataFrame, keys: Sequence[str] = ("page",)) -> DataFrame:
    """The smallest box around each page's points (or of each of ``keys``): size, angle in (-45, 45] and its four corners.
    One of its sides lies along a side of the hull; of equal boxes the one turned least counts, clockwise first. A
    single point is a box of size and angle zero."""
    hull = F.col("hull")
    n = F.size(hull)

    def box(i: Column) -> Column:
        a, b = F.get(hull, i), F.get(hull, F.when(i + 1 < n, i + 1).otherwise(F.lit(0)))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        across = F.transform(hull, lambda p: p["y"] * dx - p["x"] * dy)
        along = F.transform(hull, lambda p: p["x"] * dx + p["y"] * dy)
        u0, u1, v0, v1 = F.array_min(along), F.array_max(along), F.array_min(across), F.array_max(across)
        square = (dx * dx + dy * dy).cast("double")
        deg = F.degrees(F.atan2(dy.cast("double"), dx.cast("double")))
        folded = F.round(deg - 90 * F.ceil((deg - 45) / 90), 6)
        corner = lambda u, v: F.struct(((u * dx - v * dy) / square).alias("x"), ((u * dy + v * dx) / square).alias("y"))
        size = (u1 - u0).cast("double") * (v1 - v0).cast("double") / square
        return F.struct(F.round(size, 6).alias("size"), F.abs(folded).alias("least"), folded.alias("angle"), F.array(corner(u0, v0), corner(u1, v0), corner(u1, v1), corner(u0, v1)).alias("corners"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), n - 1), box))
    point = F.get(hull, F.lit(0))
    spot = F.struct(point["x"].cast("double").alias("x"), point["y"].cast("double").alias("y"))
    single = F.struct(F.lit(0.0).alias("size"), F.lit(0.0).alias("least"), F.lit(0.0).alias("angle"), F.array(spot, spot, spot, spot).alias("corners"))
    found = hulls(points, keys).withColumn("box", F.when(n > 1, best).otherwise(single))
    return found.select(*keys, "box.size", "box.angle", "box.corners")


def skew_angles(points: DataFrame) -> DataFrame:
    """page and angle: how far the smallest box around each page's points is turned."""
    return smallest_boxes(points).select("page", "angle")


# --- outlines -------------------------------------------------------------------------------------------------


#: So many rows of a page, a band, are labelled in one place; a word holds the pixels of so many columns.
BAND = WORD = 64


def bands(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """page, band, height, width and words: each band's set pixels (page, y, x) as bits, summed up before they are shuffled."""
    y, x = F.col("y").cast("int"), F.col("x").cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(WORD)))
    keys = (F.floor(y / BAND).cast("int").alias("band"), y.alias("y"), F.floor(x / WORD).cast("int").alias("w"))
    words = mask.groupBy("page", *keys).agg(F.bit_or(bit).alias("bits"))
    words = words.groupBy("page", "band").agg(F.collect_list(F.struct("y", "w", "bits")).alias("words"))
    every = sizes.where("height > 0 AND width > 0").select("page", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    every = every.withColumn("band", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / BAND).cast("int"))))
    return every.join(words, ["page", "band"], "full")


def _band_runs(batch: pa.RecordBatch) -> dict[str, tuple[np.ndarray, ...]]:
    """By kind: the runs of all bands of a batch in order, as the band's place in it, y, x0 and the place after the last x."""
    lists = batch.column("words")
    own, word = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    y, w, bits = (word.field(k).to_numpy(zero_copy_only=False) for k in ("y", "w", "bits"))
    order = np.lexsort((w, y, own))
    at, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(bits[order]).view(np.uint8).reshape(-1, WORD // 8), axis=1, bitorder="little"))
    own, y, x = own[order][at], y[order][at].astype(np.int64), w[order][at].astype(np.int64) * WORD + bit
    new = np.ones(len(x), bool)
    new[1:] = (own[1:] != own[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    last = np.append(new[1:], True)[: len(new)]
    outer = own[new], y[new], x[new], x[last] + 1

    height, width, band = (batch.column(k).fill_null(0).to_numpy() for k in ("height", "width", "band"))
    rows = np.clip(height - band.astype(np.int64) * BAND, 0, BAND)
    b = np.repeat(np.arange(len(rows)), rows)
    row = np.arange(len(b)) - np.repeat(np.cumsum(rows) - rows, rows)
    g, gy, g0, g1 = outer
    g0, g1 = np.clip(g0, 0, width[g]), np.clip(g1, 0, width[g])
    inside = (gy >= 0) & (gy < height[g]) & (g1 > g0)
    line, ground = np.concatenate([b * BAND + row, g[inside] * BAND + gy[inside] % BAND]), np.zeros(len(b), np.int64)
    ordered = lambda x: x[np.lexsort((x, line))]
    # a row's gaps reach from its start, or the end of a run, to the next run, or its own end
    start, end = ordered(np.concatenate([ground, g1[inside]])), ordered(np.concatenate([width[b], g0[inside]]))
    line, gap = np.sort(line), end > start
    line = line[gap]
    return {"outer": outer, "hole": (line // BAND, band[line // BAND].astype(np.int64) * BAND + line % BAND, start[gap], end[gap])}


def _labelled_bands(every_run: bool):
    def task(batches):
        for batch in batches:
            height, width = (batch.column(k).fill_null(0).to_numpy() for k in ("height", "width"))
            for kind, (own, y, x0, x1) in _band_runs(batch).items():
                shift = min(0, int(x0.min(initial=0)))
                label = joined(len(y), *touching(own * (BAND + 1) + y % BAND, x0 - shift, x1 - shift, int(x1.max(initial=0)) - shift, kind == "outer"))
                first, part = np.unique(label, return_inverse=True)
                order = np.argsort(part, kind="stable")
                begin = np.searchsorted(part[order], np.arange(len(first)))
                over = lambda f, v: f.reduceat(v[order], begin) if len(first) else v[:0]  # noqa: B023,E731
                rim = ((y % BAND == 0) & (y > 0)) | (y % BAND == BAND - 1)
                edge = (kind == "hole") & ((y == 0) | (y == height[own] - 1) | (x0 == 0) | (x1 == width[own]))
                outside = over(np.logical_or, edge)
                kept = ~outside | over(np.logical_or, rim)  # the ground around is done with, unless it goes on in another band
                listed = (rim | every_run)[order] & kept[part[order]]
                counts = np.bincount(part[order][listed], minlength=len(first))[kept]
                starts = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                runs = [pa.ListArray.from_arrays(starts, pa.array(v[order][listed], pa.int32())) for v in (y, x0, x1 - 1)]
                numbers = [over(np.add, x1 - x0), over(np.minimum, x0), over(np.maximum, x1 - 1), over(np.minimum, y), over(np.maximum, y)]
                columns = [pa.array(v[kept], t) for v, t in zip(numbers, (pa.int64(), *[pa.int32()] * 4))]
                page = batch.column("page").take(pa.array(own[first][kept]))
                root = pa.array(((y[first] << 32) + x0[first])[kept], pa.int64())
                names = ["page", "kind", "root", "n", "x0", "x1", "y0", "y1", "outside", "ys", "x0s", "x1s"]
                yield pa.RecordBatch.from_arrays([page, pa.array([kind] * len(page), pa.string()), root, *columns, pa.array(outside[kept]), *runs], names=names)

    return task


def pieces(mask: DataFrame, sizes: DataFrame, every_run: bool) -> DataFrame:
    """page, kind, root, n, bounds, whether it is ground around (outside), and runs (ys, x0s, x1s: all, or those at the rims
    of bands) of what each band has of a component; root, the number of its first run, is the component's.

    Bands are labelled each in one place. What is left to join are the pieces that meet at the rims of bands: every one takes
    the least root among its neighbours' and then that root's own, until none changes; each step is kept, so a lost executor
    costs one.
    """
    from docraster.plans.ordering import settled

    form = "kind string, root long, n long, x0 int, x1 int, y0 int, y1 int, outside boolean, ys array<int>, x0s array<int>, x1s array<int>"
    found = bands(mask, sizes)
    made = settled(found.mapInArrow(_labelled_bands(every_run), f"page {found.schema['page'].dataType.simpleString()}, {form}"))
    run = made.select("page", "kind", "root", F.explode(F.arrays_zip("ys", "x0s", "x1s")).alias("r")).select("page", "kind", "root", "r.*")
    upper = run.where(F.pmod("ys", F.lit(BAND)) == BAND - 1).select("page", "kind", F.col("root").alias("a"), (F.col("ys") + 1).alias("ys"), F.col("x0s").alias("a0"), F.col("x1s").alias("a1"))
    lower = run.where(F.pmod("ys", F.lit(BAND)) == 0).withColumnRenamed("root", "b")
    e = F.when(F.col("kind") == "outer", 1).otherwise(0)
    meet = upper.join(lower, ["page", "kind", "ys"]).where((F.col("a0") <= F.col("x1s") + e) & (F.col("x0s") <= F.col("a1") + e)).select("page", "kind", "a", "b").distinct()
    if not upper.take(1):  # no page has a second band
        return made
    near = settled(meet.union(meet.select("page", "kind", "b", "a")))
    label = near.select("page", "kind", F.col("a").alias("run"), F.col("a").alias("root")).distinct()
    while True:
        best = near.join(label.select("page", "kind", F.col("run").alias("b"), F.col("root").alias("r")), ["page", "kind", "b"]).groupBy("page", "kind", F.col("a").alias("run")).agg(F.min("r").alias("r"))
        moved = label.join(best, ["page", "kind", "run"]).select("page", "kind", "run", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        of = moved.select("page", "kind", F.col("run").alias("root"), F.col("root").alias("next"))
        step = settled(moved.join(of, ["page", "kind", "root"]).select("page", "kind", "run", "old", F.col("next").alias("root")))
        label = step.select("page", "kind", "run", "root")
        if not step.where("old <> root").take(1):
            break
    made = made.join(label.select("page", "kind", F.col("run").alias("root"), F.col("root").alias("whole")), ["page", "kind", "root"], "left")
    made = made.withColumn("root", F.coalesce("whole", "root")).drop("whole")
    outside = made.where("outside").select("page", "kind", "root").distinct()
    return made.drop("outside").join(outside.withColumn("outside", F.lit(True)), ["page", "kind", "root"], "left").withColumn("outside", F.coalesce("outside", F.lit(False)))


def outline_bounds(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """The first table of ``outlines`` alone."""
    return _bounds(pieces(mask, sizes, False))


def _bounds(made: DataFrame) -> DataFrame:
    return made.where("not outside").groupBy("page", "kind", "root").agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def outlines(mask: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outer outlines of all components of set pixels (which may touch at corners), and the inner ones around their
    holes. First page, kind (outer or hole), root, n pixels and bounds x0, x1, y0, y1 of what each encloses; then points
    (page, kind, root, y, x) whose hull is the outline's. sizes: page, height, width."""
    made = pieces(mask, sizes, True)
    run = made.where("not outside").select("page", "kind", "root", F.explode(F.arrays_zip("ys", "x0s", "x1s")).alias("r")).select("page", "kind", "root", "r.*")
    pt = lambda dy, x: F.struct((F.col("ys") + dy).alias("y"), x.alias("x"))
    x0, x1 = F.col("x0s"), F.col("x1s")
    # an inner outline runs over the pixels around the hole
    ends = F.when(F.col("kind") == "outer", F.array(pt(0, x0), pt(0, x1))).otherwise(F.array(pt(0, x0 - 1), pt(0, x1 + 1), pt(-1, x0), pt(-1, x1), pt(1, x0), pt(1, x1)))
    return _bounds(made), run.select("page", "kind", "root", F.explode(ends).alias("p")).select("page", "kind", "root", "p.y", "p.x")


def best_rectangles(mask: DataFrame, sizes: DataFrame, least_area: float = G.LEAST_AREA) -> DataFrame:
    """page, quad and score: of the smallest boxes around each page's outlines, inner ones too, that with the best score;
    the first in its page, if tied. Boxes below ``least_area`` of the page are left out."""
    _, points = outlines(mask, sizes)
    found = smallest_boxes(points, ("page", "kind", "root")).join(sizes.select("page", "height", "width"), "page")
    area = F.col("height") * F.col("width").cast("double")
    found = found.where(F.col("size") >= least_area * area).withColumn("quad", G.order_quad(F.col("corners")))
    scored = found.withColumn("score", F.round(G.contour_score(F.col("quad"), area), 6))
    return scored.groupBy("page").agg(F.min_by("quad", F.struct(-F.col("score"), "root", "kind")).alias("quad"), F.max("score").alias("score"))


def dark(px: DataFrame) -> DataFrame:
    """The pixels at or below each page's Otsu level; none of a page of one colour."""
    from docraster.functions.pixels import otsu

    levels = otsu(px).join(px.groupBy("page").agg((F.min("p") < F.max("p")).alias("varied")), "page").where("varied")
    return px.join(levels, "page").where(F.col("p") <= F.col("threshold")).select("page", "y", "x")


def page_angles(px: DataFrame) -> DataFrame:
    """page and the angle that levels its dark pixels, after a slight blur; zero for pages of one colour."""
    found = skew_angles(dark(blurred(px)))
    return px.select("page").distinct().join(found, "page", "left").select("page", F.coalesce("angle", F.lit(0.0)).alias("angle"))


# --- perspective ----------------------------------------------------------------------------------------------

SHARE_BITS = 5


def straightened(px: DataFrame, quads: DataFrame) -> DataFrame:
    """The page inside each ordered quad (page, quad), straightened: every target pixel looks up the four source pixels
    around its place, by the closed form of the map from the unit square, and weighs them in units of a 32nd. What lies
    outside the page counts as 0."""
    q = quads.select("page", "quad", G.warp_size(F.col("quad")).alias("size"))
    x, y = (lambda i: G.point(F.col("quad"), i)["x"].cast("double")), (lambda i: G.point(F.col("quad"), i)["y"].cast("double"))
    dx1, dx2, dy1, dy2 = x(1) - x(2), x(3) - x(2), y(1) - y(2), y(3) - y(2)
    sx, sy = x(0) - x(1) + x(2) - x(3), y(0) - y(1) + y(2) - y(3)
    den = dx1 * dy2 - dx2 * dy1
    flat = q.where(den != 0).withColumns({"g": (sx * dy2 - dx2 * sy) / den, "h": (dx1 * sy - sx * dy1) / den})
    g, h = F.col("g"), F.col("h")
    m = flat.select("page", F.col("size.width").alias("tw"), F.col("size.height").alias("th"), "g", "h", (x(1) - x(0) + g * x(1)).alias("a"), (x(3) - x(0) + h * x(3)).alias("b"), x(0).alias("c"), (y(1) - y(0) + g * y(1)).alias("d"), (y(3) - y(0) + h * y(3)).alias("e"), y(0).alias("f"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = m.withColumn("ty", every("th")).withColumn("tx", every("tw"))
    u, v = F.col("tx") / F.greatest(F.lit(1), F.col("tw") - 1), F.col("ty") / F.greatest(F.lit(1), F.col("th") - 1)
    w = F.col("g") * u + F.col("h") * v + 1
    unit = 1 << SHARE_BITS
    place = lambda a, b, c: F.floor((F.col(a) * u + F.col(b) * v + F.col(c)) / w * unit + 0.5 + 1e-9)
    t = t.select("page", "ty", "tx", place("a", "b", "c").alias("sx"), place("d", "e", "f").alias("sy"))
    part = lambda s: F.array(*(F.struct((F.floor(F.col(s) / unit).cast("int") + k).alias("at"), (F.pmod(F.col(s), F.lit(unit)) if k else unit - F.pmod(F.col(s), F.lit(unit))).alias("w")) for k in (0, 1)))
    t = t.select("page", "ty", "tx", F.explode(part("sy")).alias("r"), part("sx").alias("cs")).select("page", "ty", "tx", "r", F.explode("cs").alias("c"))
    t = t.select("page", "ty", "tx", F.col("r.at").alias("y"), F.col("c.at").alias("x"), (F.col("r.w") * F.col("c.w")).alias("w")).where("w > 0")
    sums = t.join(px, ["page", "y", "x"], "left").groupBy("page", "ty", "tx").agg(F.sum(F.coalesce("p", F.lit(0)) * F.col("w")).alias("total"))
    return sums.select("page", F.col("ty").alias("y"), F.col("tx").alias("x"), F.bround(F.col("total") / float(unit * unit)).cast("int").alias("p"))
