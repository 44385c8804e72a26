"""Finding a page's outline: classical detectors, pluggable models, and the ordered chain that falls back.

All work on one page stays in one call, so that a page is handed to Python once; the chain stops at the first backend
that detects something. Errors of a backend are data of the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docraster.functions import kernels as K
from docraster.functions.geometry import DETECTION_SIDE, LEAST_AREA
from docraster.sources.files import images_of, pack, parts, unpack

#: Fixed value: pages of less standard deviation hold nothing.
LEAST_STD = 5.0


def candidate_maps(gray: np.ndarray):
    """Binary images in which a page may stand out, made one after another as they are needed."""
    smooth = K.saturated(K.gaussian(gray, 5))
    adaptive = K.adaptive_threshold(smooth)
    two = K.binary(smooth, K.otsu_level(smooth))
    for m in (lambda: adaptive, lambda: 255 - adaptive, lambda: two, lambda: 255 - two, lambda: K.canny(smooth, 60, 180)):
        yield K.closed(m(), 5, 2)


def shapes(mask: np.ndarray) -> list[np.ndarray]:
    """Outlines of the components whose box has a page's area at least."""
    labels, n = K.components(mask > 0)
    out = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero(labels == i) if n < 50 else (None, None)
        if ys is None:
            break
        if (np.ptp(ys) + 1) * (np.ptp(xs) + 1) >= LEAST_AREA * mask.size:
            out.append(K.outline(labels == i))
    if n >= 50:  # many specks: look at the boxes first
        ys, xs = np.nonzero(labels)
        own = labels[ys, xs]
        box = np.full((n + 1, 4), -1)
        box[:, :2] = max(mask.shape)
        np.minimum.at(box[:, 0], own, ys), np.minimum.at(box[:, 1], own, xs)
        np.maximum.at(box[:, 2], own, ys), np.maximum.at(box[:, 3], own, xs)
        size = (box[:, 2] - box[:, 0] + 1) * (box[:, 3] - box[:, 1] + 1)
        out = [K.outline(labels == i) for i in np.flatnonzero(size >= LEAST_AREA * mask.size) if i]
    return out


def score(pts: np.ndarray, image_area: float) -> float:
    area = K.polygon_area(pts)
    if area <= 0:
        return -1.0
    lo, hi = np.floor(pts.min(0)), np.ceil(pts.max(0))
    return 10 * area / max(1.0, image_area) + area / max(1.0, float(np.prod(hi - lo + 1)))


def is_convex(q: np.ndarray) -> bool:
    side = np.roll(q, -1, axis=0) - q
    turn = side[:, 0] * np.roll(side, -1, axis=0)[:, 1] - side[:, 1] * np.roll(side, -1, axis=0)[:, 0]
    return bool((turn > 0).all() or (turn < 0).all())


def find_quad(gray: np.ndarray) -> np.ndarray | None:
    """The best four-cornered outline of the first map that has one, else the best rectangle of the first map."""
    least, spare = LEAST_AREA * gray.size, None
    for i, m in enumerate(candidate_maps(gray)):
        best = None
        for pts in shapes(m):
            q = K.simplified(pts, 0.02 * K.perimeter(pts))
            if len(q) == 4 and is_convex(q) and K.polygon_area(q) >= least and (best is None or score(q, gray.size) > best[0]):
                best = (score(q, gray.size), q)
            if i == 0:
                box = K.min_area_rect(pts)[0]
                if K.polygon_area(box) >= least and (spare is None or score(box, gray.size) > spare[0]):
                    spare = (score(box, gray.size), box)
        if best:
            return best[1]
    return spare[1] if spare else None


def find_rectangle(gray: np.ndarray) -> np.ndarray | None:
    best = None
    for m in candidate_maps(gray):
        for pts in shapes(m):
            box = K.min_area_rect(pts)[0]
            if K.polygon_area(box) >= LEAST_AREA * gray.size and (best is None or score(box, gray.size) > best[0]):
                best = (score(box, gray.size), box)
    return best[1] if best else None


#: The least votes for a line, and the share of the shorter side, step by step.
LADDER = ((60, 0.35), (45, 0.25), (30, 0.18))


#: The degrees of upright and level lines, bounds included, and those beside them, which tell their peaks.
STEEP_OR_LEVEL = np.flatnonzero([k <= 31 or k >= 149 or 59 <= k <= 121 for k in range(180)])


def find_lines(gray: np.ndarray, least_lines: int | None = None) -> np.ndarray | None:
    """The quad between the outermost upright and level lines, of the first step of the ladder that leaves two of each, or
    where it is given ``least_lines`` of any kind."""
    h, w = gray.shape
    edges = K.closed(K.canny(K.saturated(K.gaussian(gray, 5)), 50, 150), 5, 1)
    deg = lambda t: np.degrees(t % np.pi)
    upright, level = [], []
    votes = K.LineVotes(edges, None if least_lines else STEEP_OR_LEVEL)
    for floor, share in LADDER:
        lines = votes.lines(max(floor, int(share * min(h, w))))
        upright = [((r - h / 2 * np.sin(t)) / np.cos(t), r, t) for r, t in lines if deg(t) < 30 or deg(t) > 150]
        level = [((r - w / 2 * np.cos(t)) / np.sin(t), r, t) for r, t in lines if 60 < deg(t) < 120]
        if len(lines) >= least_lines if least_lines else len(upright) >= 2 and len(level) >= 2:
            break
    if len(lines) < (least_lines or 0) or len(upright) < 2 or len(level) < 2:
        return None
    pts = []
    for _, ra, ta in (min(upright), max(upright)):
        for _, rb, tb in (min(level), max(level)):
            det = np.cos(ta) * np.sin(tb) - np.sin(ta) * np.cos(tb)
            if abs(det) < 1e-6:
                return None
            pts.append(((ra * np.sin(tb) - rb * np.sin(ta)) / det, (rb * np.cos(ta) - ra * np.cos(tb)) / det))
    q = K.order_quad(np.array(pts)).astype(float)
    inside = (q[:, 0] >= -0.15 * w).all() and (q[:, 0] <= 1.15 * w).all() and (q[:, 1] >= -0.15 * h).all() and (q[:, 1] <= 1.15 * h).all()
    return q if inside and K.polygon_area(q) >= LEAST_AREA * gray.size else None


def find_best(gray: np.ndarray) -> np.ndarray | None:
    """The best of the three; the earlier, if tied."""
    found = [q for q in (find_quad(gray), find_lines(gray), find_rectangle(gray)) if q is not None]
    return max(found, key=lambda q: score(q, gray.size)) if found else None


class Scan:
    """What a backend made of an image."""

    def __init__(self, backend: str, warped=None, contour=None, detected=False, reason=None):
        self.backend, self.warped, self.contour, self.detected, self.reason = backend, warped, contour, detected, reason


def classical(name: str, finder: Callable[[np.ndarray], np.ndarray | None]) -> Callable[[np.ndarray], Scan]:
    def run(img: np.ndarray) -> Scan:
        gray = K.to_gray(img)
        if gray.std() < LEAST_STD:
            return Scan(name, reason="low_variance")
        small, scale = K.shrunk(gray, DETECTION_SIDE)
        q = finder(small)
        if q is None:
            return Scan(name, reason="no_contour")
        q = K.order_quad(np.asarray(q, float) / scale)
        return Scan(name, K.warp(img, q), q, True)

    return run


def by_model(name: str, model: Callable[[np.ndarray], list[dict]]) -> Callable[[np.ndarray], Scan]:
    """A backend around a model that returns [{"doctr_img": straightened image}]."""

    def run(img: np.ndarray) -> Scan:
        out = model(img)
        got = out[0].get("doctr_img") if out else None
        if got is None or not np.size(got):
            return Scan(name, reason="no_contour")
        got = np.asarray(got)
        if got.dtype != np.uint8:
            got = np.clip(got, 0, 255).astype(np.uint8)
        if got.ndim == 3 and got.shape[2] == 4:
            got = got[..., 2::-1]
        return Scan(name, K.to_bgr(got), None, True)

    return run


BACKENDS: dict[str, Callable[[np.ndarray], Scan]] = {
    "opencv_quad": classical("opencv_quad", find_quad),
    "opencv_hough": classical("opencv_hough", find_lines),
    "opencv_minrect": classical("opencv_minrect", find_rectangle),
    "cv_hybrid": classical("cv_hybrid", find_best),
}
#: Backends that need a model which is not part of this package; register them in BACKENDS.
MODELS = ("paddleocr_uvdoc", "uvdoc", "camscan")
DEFAULT = ("paddleocr_uvdoc",)


#: Other names of a backend.
ALIASES = {"paddleocr_uvdoc": "uvdoc"}


def known_as(backend: str, registry: dict) -> Callable[[np.ndarray], Scan] | None:
    """The backend of this name, or the one that it is an alias of; what an alias detects bears the alias's name."""
    if backend in registry or ALIASES.get(backend) not in registry:
        return registry.get(backend)

    def run(img: np.ndarray) -> Scan:
        found = registry[ALIASES[backend]](img)
        if found.detected:
            found.backend = backend
        return found

    return run


def probe(backend: str) -> None:
    if known_as(backend, BACKENDS):
        return
    if backend in MODELS:
        raise ValueError(f"{backend} is not registered in this environment")
    raise ValueError(f"Unsupported detector backend: {backend}")


def scan(img: np.ndarray, backends: Sequence[str] = DEFAULT, registry: dict | None = None) -> tuple[Scan, list[str]]:
    """The first detection, or the image as it is; and what went wrong on the way."""
    registry, errors, last = registry or BACKENDS, [], None
    for b in backends or DEFAULT:
        try:
            run = known_as(b, registry)
            if run is None:
                probe(b)
            last = run(img)
            if last.detected:
                return last, errors
        except Exception as why:  # a backend's failure is data of the page; the next one is tried
            errors.append(f"{b}: {why}")
    return Scan("none", reason=last.reason if last else None), errors


#: So many pages, or so many bytes of them, are worked on and handed back at a time.
PAGES_AT_ONCE, BYTES_AT_ONCE = 32, 16 << 20


def scanned(pages: DataFrame, backends: Sequence[str] = DEFAULT, registry: dict | None = None, with_image: bool = True) -> DataFrame:
    """page_seq, name, image (if asked for) and scan (warped, contour, backend, detected, reason, errors) of each page."""
    from docraster import schema

    kept = ["page_seq", "name", *["image"] * with_image]
    out = T.StructType([*(f for f in schema.PAGE if f.name in kept), T.StructField("scan", schema.SCAN)])

    def one(image) -> dict:
        s, errors = scan(unpack(image), backends, registry)
        contour = None if s.contour is None else [{"x": float(x), "y": float(y)} for x, y in s.contour]
        return {"warped": None if s.warped is None else pack(s.warped), "contour": contour, "backend": s.backend, "detected": s.detected, "reason": s.reason, "errors": errors}

    def task(batches):
        for batch in batches:
            for part in parts(batch, "image", PAGES_AT_ONCE, BYTES_AT_ONCE):
                scans = pa.array([one(i) for i in images_of(part.column("image"))], schema.ARROW_SCAN)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), scans], names=[*kept, "scan"])

    return pages.select(F.col("page_seq").cast("long"), "name", "image").mapInArrow(task, out)


def cropped(pages: DataFrame, corners: DataFrame) -> DataFrame:
    """Pages (entry_id, original) with new originals, straightened from these corners (entry_id, contour) in the image's own
    coordinates; pages without corners stay as they are."""
    from docraster import schema

    def task(batches):
        for pdf in batches:
            done = [i if q is None else pack(K.warp(unpack(i), K.order_quad(np.array([(p["x"], p["y"]) for p in q], float)))) for i, q in zip(pdf["original"], pdf["contour"])]
            yield pdf.drop(columns="contour").assign(original=done)

    joined = pages.join(corners.select("entry_id", F.col("contour").cast(schema.CONTOUR)), "entry_id", "left").select(*pages.columns, "contour")
    return joined.mapInPandas(task, pages.schema)
