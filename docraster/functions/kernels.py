"""Raster kernels in numpy, from their published definitions. Images are uint8: (h, w) gray or (h, w, 3) BGR."""

from __future__ import annotations

import math

import numpy as np


def saturated(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def to_gray(img: np.ndarray) -> np.ndarray:
    """Fixed-point luma; a gray image stays as it is."""
    if img.ndim == 2:
        return img
    b, g, r = (img[..., i].astype(np.int32) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def to_bgr(img: np.ndarray) -> np.ndarray:
    return np.repeat(img[..., None], 3, axis=2) if img.ndim == 2 else img[..., :3]


# --- neighbourhoods -------------------------------------------------------------------------------------------


def _part(a: np.ndarray, start: int, n: int, axis: int) -> np.ndarray:
    return a[start : start + n] if axis == 0 else a[:, start : start + n]


def gaussian_taps(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x * x) / (2 * sigma * sigma))
    return k / k.sum()


def separable(img: np.ndarray, taps: np.ndarray, mode: str = "edge") -> np.ndarray:
    """Correlation with the same taps along both axes, as floats."""
    r, out = len(taps) // 2, img.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        n, wide = out.shape[axis], np.pad(out, pad, mode=mode if out.shape[axis] > r or mode == "edge" else "edge")
        out = taps[0] * _part(wide, 0, n, axis)
        for i, t in enumerate(taps[1:], 1):
            out += t * _part(wide, i, n, axis)
    return out


def gaussian(img: np.ndarray, size: int, sigma: float = 0.0, mode: str = "reflect") -> np.ndarray:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    return separable(img, gaussian_taps(size, sigma), mode)


def sharpen(img: np.ndarray) -> np.ndarray:
    """1.5 times the image less half of its blur (sigma 3)."""
    return saturated(1.5 * img - 0.5 * gaussian(img, 19, 3.0))


def adaptive_threshold(gray: np.ndarray, block: int = 21, c: float = 15) -> np.ndarray:
    """255 where a pixel lies above its Gaussian mean less c; borders repeat."""
    return np.where(gray > saturated(gaussian(gray, block, mode="edge")) - c, 255, 0).astype(np.uint8)


def black_and_white(img: np.ndarray) -> np.ndarray:
    return adaptive_threshold(sharpen(to_gray(img)))


def otsu_level(gray: np.ndarray) -> int:
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w, s = w0[-1], s0[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w0 < w), (s0 * w - s * w0) ** 2 / (w0 * (w - w0)), 0)
    return int(between.argmax())


def binary(gray: np.ndarray, at: float) -> np.ndarray:
    return np.where(gray > at, 255, 0).astype(np.uint8)


def gain_bias(img: np.ndarray, contrast: float, brightness: float) -> np.ndarray:
    return np.minimum(255, np.rint(np.abs(contrast * img.astype(np.float64) + brightness))).astype(np.uint8)


def _extreme(img: np.ndarray, size: int, fn) -> np.ndarray:
    r = size // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        n, wide = img.shape[axis], np.pad(img, pad, mode="edge")
        img = _part(wide, 0, n, axis).copy()
        for i in range(1, size):
            fn(img, _part(wide, i, n, axis), out=img)
    return img


def closed(img: np.ndarray, size: int = 5, times: int = 1) -> np.ndarray:
    """Dilation ``times`` over, then as many erosions."""
    for fn in (np.maximum, np.minimum):
        for _ in range(times):
            img = _extreme(img, size, fn)
    return img


def canny(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Sobel gradients, thinning along them, and hysteresis; from the gradients on only where they are steep enough."""
    p = np.pad(gray, 1, mode="edge").astype(np.int16)
    right, under = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    gx, gy = right[:-2] + 2 * right[1:-1] + right[2:], under[:, :-2] + 2 * under[:, 1:-1] + under[:, 2:]
    mag = np.abs(gx) + np.abs(gy)
    at = np.flatnonzero(mag > low)
    dx, dy, own = gx.ravel()[at].astype(np.int64), gy.ravel()[at].astype(np.int64), mag.ravel()[at]
    angle = np.abs(np.degrees(np.arctan2(dy, dx))) % 180
    flat, upright, steep = (angle < 22.5) | (angle > 157.5), (angle > 67.5) & (angle < 112.5), np.sign(dx) == np.sign(dy)
    m, wide = np.pad(mag, 1).ravel(), gray.shape[1] + 2
    here = (at // gray.shape[1] + 1) * wide + at % gray.shape[1] + 1
    step = np.where(flat, 1, np.where(upright, wide, np.where(steep, wide + 1, wide - 1)))  # to the neighbour after, row by row
    thin = (own > m[here - step]) & (own >= m[here + step])
    weak = np.zeros(gray.shape, bool)
    weak.ravel()[at[thin]] = True
    found = touching_runs(weak)
    strong = at[thin & (own > high)]
    kept = np.unique(found.root[found.of(strong)])
    return np.where(found.painted(np.isin(found.root, kept)), 255, 0).astype(np.uint8)


def non_local_means(img: np.ndarray, strength: int, template: int = 7, search: int = 21) -> np.ndarray:
    """Mean of the pixels around, weighted by how alike their surroundings are."""
    if strength <= 0:
        return img
    planes = img[..., None] if img.ndim == 2 else img
    x = planes.astype(np.float64)
    r, half = search // 2, template // 2

    def box_mean(a: np.ndarray) -> np.ndarray:
        """Mean over the template, borders repeated, by running sums."""
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (half + 1, half)
            total = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis)
            n = a.shape[axis]
            a = np.take(total, range(template, template + n), axis) - np.take(total, range(n), axis)
        return a / template**2

    wide = np.pad(x, ((r, r), (r, r), (0, 0)), mode="reflect" if min(x.shape[:2]) > r else "edge")
    total, weight = np.zeros_like(x), np.zeros(x.shape[:2])
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + x.shape[0], dx : dx + x.shape[1]]
            gap = box_mean(((x - other) ** 2).mean(2))
            w = np.exp(-gap / (strength * strength))
            total += w[..., None] * other
            weight += w
    out = saturated(total / weight[..., None])
    return out[..., 0] if img.ndim == 2 else out


# --- shapes ---------------------------------------------------------------------------------------------------


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0 .. n - 1 along the pairs (a, b), in either direction."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not ((up := root[root]) == root).all():
            root = up


def touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, w: int, corners: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sorted runs (x1 is the place after the last pixel) that touch in rows one below the other, perhaps at corners."""
    row = w + 2
    first = np.searchsorted(y * row + x1, (y - 1) * row + x0, side="left" if corners else "right")
    after = np.searchsorted(y * row + x0, (y - 1) * row + x1, side="right" if corners else "left")
    n = np.maximum(0, after - first)
    lower = np.repeat(np.arange(len(y)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), lower


class Runs:
    """The unbroken runs of set pixels of each row (y, x0 and the place after the last one, x1), in order, and ``root``, the
    number of the first run of each one's component."""

    def __init__(self, shape: tuple[int, int], y: np.ndarray, x0: np.ndarray, x1: np.ndarray, root: np.ndarray):
        self.shape, self.y, self.x0, self.x1, self.root = shape, y, x0, x1, root

    def of(self, at: np.ndarray) -> np.ndarray:
        """The runs in which these set pixels lie, given by their places in the flattened mask."""
        return np.searchsorted(self.y * self.shape[1] + self.x0, at, side="right") - 1

    def painted(self, value: np.ndarray) -> np.ndarray:
        """An array of each run's value, zero elsewhere."""
        h, w = self.shape
        out, value = np.zeros((h, w + 1), np.int64), value.astype(np.int64)
        out[self.y, self.x0], out[self.y, self.x1] = value, -value  # where a run ends none begins
        return np.cumsum(out, axis=1)[:, :w]


def touching_runs(mask: np.ndarray) -> Runs:
    """Runs, joined where they touch runs of the row before, at corners too."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), bool)
    wide[:, 1:-1] = mask
    y, x = np.divmod(np.flatnonzero(wide[:, 1:] != wide[:, :-1]), w + 1)
    y, x0, x1 = y[::2], x[::2], x[1::2]
    return Runs((h, w), y, x0, x1, joined(len(y), *touching(y, x0, x1, w)))


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components: labels from 1, in the order of their first pixels, and their number."""
    found = touching_runs(mask)
    names, label = np.unique(found.root, return_inverse=True)
    return found.painted(label + 1), len(names)


#: Steps around a pixel, clockwise from the left.
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def outline(mask: np.ndarray) -> np.ndarray:
    """The outer border of a mask's first component, clockwise from its first pixel, as (x, y)."""
    m = np.pad(mask, 1)
    ys, xs = np.nonzero(m)
    if not len(ys):
        return np.zeros((0, 2))
    start = (int(ys[0]), int(xs[0]))
    at, back, out, first_move = start, 0, [start], None
    while True:
        for k in range(1, 9):
            way = (back + k) % 8
            to = (at[0] + _AROUND[way][0], at[1] + _AROUND[way][1])
            if m[to]:
                break
        else:
            break
        if (at, way) == first_move:
            break
        if first_move is None:
            first_move = (at, way)
        out.append(to)
        at, back = to, (way + 5) % 8
    return np.array(out[:-1] if len(out) > 1 else out)[:, ::-1].astype(np.float64) - 1


def polygon_area(pts: np.ndarray) -> float:
    x, y = pts[:, 0], pts[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def perimeter(pts: np.ndarray) -> float:
    return float(np.linalg.norm(np.roll(pts, -1, axis=0) - pts, axis=1).sum())


def simplified(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed curve, cut at its two points that lie far apart."""
    if len(pts) < 3:
        return pts
    a = int(np.argmax(np.linalg.norm(pts - pts[0], axis=1)))
    pts = np.roll(pts, -a, axis=0)
    b = int(np.argmax(np.linalg.norm(pts - pts[0], axis=1)))
    line = np.concatenate([pts, pts[:1]])
    keep, todo = {0, b, len(pts)}, [(0, b), (b, len(pts))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, own = line[j] - line[i], line[i + 1 : j] - line[i]
        n = np.hypot(*d)
        far = np.abs(d[0] * own[:, 1] - d[1] * own[:, 0]) / n if n else np.linalg.norm(own, axis=1)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[sorted(keep)[:-1]]


def hull(pts: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chains."""
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def min_area_rect(pts: np.ndarray) -> tuple[np.ndarray, float]:
    """The smallest rectangle around points, one of its sides along a side of their hull: corners, and angle in (-45, 45]."""
    h = hull(np.asarray(pts, np.float64))
    if len(h) < 3:
        lo, hi = h.min(0), h.max(0)
        d = h[-1] - h[0]
        turn = math.degrees(math.atan2(d[1], d[0])) if len(h) > 1 else 0.0
        return np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]), _level(turn)
    sides = np.roll(h, -1, axis=0) - h
    turn = np.arctan2(sides[:, 1], sides[:, 0])
    c, s = np.cos(turn), np.sin(turn)
    u, v = np.outer(c, h[:, 0]) + np.outer(s, h[:, 1]), np.outer(-s, h[:, 0]) + np.outer(c, h[:, 1])
    size = (u.max(1) - u.min(1)) * (v.max(1) - v.min(1))
    k = int(size.argmin())
    box = np.array([[u[k].min(), v[k].min()], [u[k].max(), v[k].min()], [u[k].max(), v[k].max()], [u[k].min(), v[k].max()]])
    back = np.array([[c[k], s[k]], [-s[k], c[k]]])
    return box @ back, _level(math.degrees(turn[k]))


def _level(angle: float) -> float:
    angle = (angle + 45) % 90 - 45
    return 45.0 if angle == -45 else angle


# --- geometry -------------------------------------------------------------------------------------------------


def order_quad(pts: np.ndarray) -> np.ndarray:
    total, gap = pts.sum(1), pts[:, 1] - pts[:, 0]
    return np.array([pts[total.argmin()], pts[gap.argmin()], pts[total.argmax()], pts[gap.argmax()]], np.float32)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    rows, rhs = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.lstsq(np.array(rows, float), np.array(rhs, float), rcond=None)[0], 1).reshape(3, 3)


#: So many samples are worked out at a time, as that many fit a processor's cache.
SAMPLES = 6_000


def sampled(img: np.ndarray, size: tuple[int, int], place, border: str = "black") -> np.ndarray:
    """Bilinear samples of an image of this size, some rows at a time; what lies outside is black or the nearest edge.
    place(y, x): the source's x and y of target rows y, a column, and columns x."""
    h, w = img.shape[:2]
    planes, cols, some = np.ascontiguousarray(img.reshape(h * w, -1).T), np.arange(size[1]), max(1, SAMPLES // max(1, size[1]))
    done = np.empty((*size, len(planes)), np.uint8)
    if (planes[1:] == planes[0]).all():  # a gray page in colours is sampled once
        planes = planes[:1]
    for first in range(0, size[0], some):
        x, y = place(np.arange(first, min(size[0], first + some))[:, None], cols)
        if border == "edge":
            x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
        left, top = np.floor(x), np.floor(y)
        fx, fy, x0, y0 = x - left, y - top, left.astype(np.int64), top.astype(np.int64)
        within = x0.size > 0 and x0.min() >= 0 and y0.min() >= 0 and x0.max() < w - 1 and y0.max() < h - 1
        out = np.zeros((len(planes), *x.shape))
        for dy, wy in ((0, 1 - fy), (1, fy)):
            for dx, wx in ((0, 1 - fx), (1, fx)):
                xi, yi, weight = x0 + dx, y0 + dy, wx * wy
                if not within:
                    weight = weight * ((xi >= 0) & (xi < w) & (yi >= 0) & (yi < h))
                    xi, yi = np.clip(xi, 0, w - 1), np.clip(yi, 0, h - 1)
                at = yi * w + xi
                for plane, total in zip(planes, out):
                    total += plane.take(at) * weight
        done[first : first + some] = np.moveaxis(saturated(out), 0, -1)
    return done[..., 0] if img.ndim == 2 else done


def warp(img: np.ndarray, pts: np.ndarray) -> np.ndarray:
    """The page inside four corners, straightened."""
    q = order_quad(np.asarray(pts, np.float64)).astype(np.float64)
    side = lambda a, b: float(np.linalg.norm(q[a] - q[b]))
    w, h = max(1, int(max(side(1, 0), side(2, 3)))), max(1, int(max(side(3, 0), side(2, 1))))
    to = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    m = homography(to, q)

    def place(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.ones((len(y), w, 3))
        p[..., 0], p[..., 1] = x, y
        p = p @ m.T
        return p[..., 0] / p[..., 2], p[..., 1] / p[..., 2]

    return sampled(img, (h, w), place)


def deskew(img: np.ndarray) -> tuple[np.ndarray, float]:
    """The image turned so that the box around its dark pixels is level, and the angle in (-45, 45]."""
    gray = saturated(gaussian(to_gray(img), 5))
    ys, xs = np.nonzero(gray <= otsu_level(gray))
    if not len(xs) or gray.min() == gray.max():
        return img, 0.0
    _, angle = min_area_rect(np.column_stack([xs, ys]))
    h, w = img.shape[:2]
    t, cx, cy = math.radians(angle), (w - 1) / 2, (h - 1) / 2

    def place(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return math.cos(t) * (x - cx) - math.sin(t) * (y - cy) + cx, math.sin(t) * (x - cx) + math.cos(t) * (y - cy) + cy

    return sampled(img, (h, w), place, "edge"), angle


def shrunk(img: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """The image at most so large, each pixel the mean of what it covers, and the scale."""
    h, w = img.shape[:2]
    scale = min(most / h, most / w, 1.0)
    if scale == 1.0:
        return img, 1.0
    out = img.astype(np.float64)
    for axis, n, size in ((0, max(1, int(h * scale)), h), (1, max(1, int(w * scale)), w)):
        edges = np.linspace(0, size, n + 1)
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        low = np.floor(edges).astype(int)
        part = edges - low
        shape = [1] * out.ndim
        shape[axis] = n + 1
        at = np.take(sums, low, axis) + part.reshape(shape) * (np.take(sums, np.minimum(low + 1, size), axis) - np.take(sums, low, axis))
        out = np.diff(at, axis=axis) / (size / n)
    return saturated(out), scale


def halves(img: np.ndarray) -> list[np.ndarray]:
    w = img.shape[1]
    return [img] if w < 2 else [img[:, : w // 2], img[:, w // 2 :]]


class LineVotes:
    """How many set pixels lie on each line x cos + y sin = rho, for whole degrees: all of them, or those asked for."""

    def __init__(self, edges: np.ndarray, degrees: np.ndarray | None = None):
        h, w = edges.shape
        ys, xs = np.divmod(np.flatnonzero(edges), w)
        self.reach = int(math.ceil(math.hypot(h, w)))
        degrees, size = np.arange(180) if degrees is None else degrees, 2 * self.reach + 1
        self.around = np.zeros((182, size + 2), np.int64)  # no votes beyond the first and last
        self.votes, some = self.around[1:-1, 1:-1], max(1, 30_000 // max(1, len(xs)))
        for part in (degrees[i : i + some] for i in range(0, len(degrees), some)):
            turn = [math.radians(k) for k in part]
            across, down = np.outer([math.cos(t) for t in turn], np.arange(w)), np.outer([math.sin(t) for t in turn], np.arange(h))
            at = across.take(xs, axis=1)
            at += down.take(ys, axis=1)
            place = np.rint(at, out=at).astype(np.int64) + (np.arange(len(part)) * size + self.reach)[:, None]
            self.votes[part] = np.bincount(place.ravel(), minlength=len(part) * size).reshape(-1, size)

    def lines(self, least: int) -> list[tuple[float, float]]:
        """(rho, theta) of all lines with over ``least`` votes that are peaks among their neighbours, most votes first."""
        p = self.around
        k, r = np.nonzero(self.votes > least)
        order = np.lexsort((k, r))
        k, r = k[order], r[order]
        n = self.votes[k, r]
        peak = (n > p[k + 1, r]) & (n >= p[k + 1, r + 2]) & (n > p[k, r + 1]) & (n >= p[k + 2, r + 1])
        r, k, n = r[peak], k[peak], n[peak]
        return [(float(r[i] - self.reach), math.radians(k[i])) for i in np.argsort(-n, kind="stable")]


def hough_lines(edges: np.ndarray, least: int) -> list[tuple[float, float]]:
    return LineVotes(edges).lines(least)
