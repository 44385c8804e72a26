"""The batch pipeline: detect, post-process, enhance and split, in one pass over the pages.

The steps are fused into one function per page, so that an image crosses between the JVM and Python once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docraster import schema
from docraster.functions import kernels as K
from docraster.operators import detect
from docraster.plans.ordering import numbered_apart
from docraster.sources.files import few, images_of, pack, parts, unpack

#: The modes' names.
POSTPROCESSING: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "None": lambda img: img,
    "Sharpen": K.sharpen,
    "Grayscale": K.to_gray,
    "Black and White": K.black_and_white,
}


@dataclass(frozen=True)
class Settings:
    contrast: float = 1.0
    brightness: int = 0
    denoise: int = 0
    threshold: int = 170
    apply_threshold: bool = False


@dataclass(frozen=True)
class Options:
    detect_document: bool = True
    two_page_mode: bool = False
    postprocess: str = "None"
    backends: Sequence[str] = detect.DEFAULT
    settings: Settings | None = None


#: So many pages, or so many bytes of them, are worked on and handed back at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 16 << 20


def enhanced(img: np.ndarray, s: Settings) -> np.ndarray:
    out = K.gain_bias(K.non_local_means(img, max(0, int(s.denoise))), s.contrast, s.brightness)
    return K.binary(K.to_gray(out), s.threshold) if s.apply_threshold else out


def processed(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """page_seq (anew), image, detected and errors (of backends) of the pages (page_seq, name, image) that the steps leave."""
    if options.postprocess not in POSTPROCESSING:
        raise ValueError(f"Unsupported postprocess mode: {options.postprocess}")
    fn = POSTPROCESSING[options.postprocess]

    def one(img: np.ndarray) -> tuple[list[np.ndarray], bool, list[str]]:
        hit, errors = False, []
        if options.detect_document:
            s, errors = detect.scan(img, options.backends)
            img, hit = (img if s.warped is None else s.warped), s.detected
        img = fn(img)
        if options.settings:
            img = enhanced(img, options.settings)
        return (K.halves(img) if options.two_page_mode else [img]), hit, errors

    form = pa.schema([("_seq", pa.int64()), ("_half", pa.int32()), ("image", schema.ARROW_IMAGE), ("detected", pa.bool_()), ("errors", pa.list_(pa.string()))])

    def task(batches):
        for batch in batches:
            for part in parts(batch, "image", ROWS_AT_ONCE, BYTES_AT_ONCE):  # results of a whole batch are never held
                rows = []
                for seq, image in zip(part.column("page_seq").to_pylist(), images_of(part.column("image"))):
                    made, hit, errors = one(unpack(image))
                    rows += [(seq, k, pack(p), hit, errors) for k, p in enumerate(made)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)

    out = pages.select(F.col("page_seq").cast("long"), "image").mapInArrow(task, "_seq long, _half int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, detected boolean, errors array<string>")
    return numbered_apart(out, "page_seq", "_seq", "_half").select("page_seq", "image", "detected", "errors")


def transformed(pages: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pages with another image each: a registered post-processing, a turn, a straightening."""

    def task(batches):
        for pdf in few(batches):
            yield pdf.assign(image=[pack(fn(unpack(i))) for i in pdf["image"]])

    return pages.mapInPandas(task, pages.schema)


def deskewed(pages: DataFrame) -> DataFrame:
    """Pages with their image made level, and the angle."""
    from pyspark.sql import types as T

    def task(batches):
        for pdf in few(batches):
            done = [K.deskew(unpack(i)) for i in pdf["image"]]
            yield pdf.assign(image=[pack(i) for i, _ in done], angle=[a for _, a in done])

    return pages.mapInPandas(task, T.StructType([*pages.schema.fields, T.StructField("angle", T.DoubleType())]))
