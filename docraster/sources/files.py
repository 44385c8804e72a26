"""Pages from folders and file lists.

A folder is a ``binaryFile`` scan: names are filtered before any content is read, and one row is one file. Images and
documents are decoded in Arrow batches, a document giving one row per page. Every row carries its place
(``page_seq``), since tables have no order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docraster import schema
from docraster.functions import codec, kernels
from docraster.functions import names as N
from docraster.plans.ordering import numbered

#: A renderer of documents that are not our own: (bytes, dpi) -> page images in BGR. None raises on such documents.
RENDERERS: dict[str, Callable[[bytes, int], list[np.ndarray]]] = {}


def pack(img: np.ndarray, origin: str = "") -> dict:
    h, w = img.shape[:2]
    gray = img.ndim == 2
    return {"origin": origin, "height": h, "width": w, "nChannels": 1 if gray else 3, "mode": schema.GRAY_MODE if gray else schema.BGR_MODE, "data": np.ascontiguousarray(img).tobytes()}


def unpack(row) -> np.ndarray | None:
    """The array of an image struct; alpha is dropped."""
    if row is None or row["data"] is None or row["nChannels"] < 1:
        return None
    h, w, c = row["height"], row["width"], row["nChannels"]
    a = np.frombuffer(row["data"], np.uint8)
    return a.reshape(h, w) if c == 1 else a.reshape(h, w, c)[..., :3]


def images_of(column: pa.StructArray) -> Iterator[dict | None]:
    """The image structs of an Arrow column one by one; ``data`` stays where it is."""
    fields = {k: column.field(k).to_pylist() for k in ("origin", "height", "width", "nChannels", "mode")}
    data = column.field("data")
    for i in range(len(column)):
        if not column[i].is_valid:
            yield None
        else:
            yield {k: v[i] for k, v in fields.items()} | {"data": data[i].as_buffer() if data[i].is_valid else None}


def parts(batch: pa.RecordBatch, image: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of so many rows at most, and of so many bytes of images unless one alone is larger."""
    n = pc.fill_null(pc.binary_length(batch.column(image).field("data")), 0).to_pylist()
    first, held = 0, 0
    for i, own in enumerate(n):
        if i > first and (i - first >= rows or held + own > size):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += own
    if first < len(n):
        yield batch.slice(first)


def few(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The batches cut into frames of so many rows at most."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def url_decoded(path: Column | str) -> Column:
    """The image source's origins are URL-encoded; a plus sign stands for itself."""
    return F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B")))


def plain(path: Column | str) -> Column:
    """A path by which the sources' spellings of one local file are equal."""
    return F.regexp_replace(path, "^file:/*", "/")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length and content of a folder's supported files (not of folders in it). A missing one is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.select("path", file_name("path").alias("name"), "length", "content").where(N.supported("name"))


def in_natural_order(files: DataFrame, column: str = "file_seq") -> DataFrame:
    return numbered(files, column, N.natural_key("name"), "name")


def without_outputs(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files whose name is not among an earlier run's outputs."""
    return files.join(outputs.select("name").distinct(), "name", "left_anti")


def checked_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, file_seq of a given list, in its order and each path once. Missing paths, then unsupported ones, are errors."""
    from docraster.sources.sinks import exists

    paths = list(dict.fromkeys(paths))
    if missing := [p for p in paths if not exists(spark, p)]:
        raise ValueError("Missing files: " + ", ".join(missing))
    df = spark.createDataFrame(list(enumerate(paths)), "file_seq long, path string").withColumn("name", file_name("path"))
    if bad := [r["path"] for r in df.where(~N.supported("name")).collect()]:
        raise ValueError("Unsupported files: " + ", ".join(bad))
    return df


def decoded(name: str, content: bytes, dpi: int, unchanged: bool = False) -> list[np.ndarray] | None:
    """A file's images: one, or one per page of a document. None if it cannot be read."""
    end = name.lower().rpartition(".")[2]
    if end == "pdf":
        return codec.pdf_images(content) or (RENDERERS["pdf"](content, dpi) if "pdf" in RENDERERS else None)
    img = codec.png_image(content)
    if img is None and end in RENDERERS:
        return RENDERERS[end](content, dpi)
    return None if img is None else [img if unchanged else kernels.to_bgr(img)]


PAGES = "file_seq long, page_no int, name string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, error string"


def pages(files: DataFrame, dpi: int = 300) -> DataFrame:
    """file_seq, page_no (0 for images), name, image, error of each page of the files (file_seq, path, name, content).

    Only PNG and image-only PDF are read here; other codecs go through Spark's image source (``images``) or a
    registered renderer. What cannot be read is a row with an error, never a silent gap.
    """
    if dpi < 72:
        raise ValueError("PDF DPI must be >= 72")

    def task(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                found = decoded(r.name, r.content, dpi)
                if found is None:
                    rows.append((r.file_seq, 0, r.name, None, f"Cannot read image: {r.path}"))
                elif r.name.lower().endswith(".pdf"):
                    rows += [(r.file_seq, i, f"{r.name} [p{i:04d}]", pack(img, r.path), None) for i, img in enumerate(found, 1)]
                else:
                    rows.append((r.file_seq, 0, r.name, pack(found[0], r.path), None))
            yield pd.DataFrame(rows, columns=["file_seq", "page_no", "name", "image", "error"])

    return files.select("file_seq", "path", "name", "content").mapInPandas(task, PAGES)


def any_case(extensions: Sequence[str]) -> str:
    """A glob for file names with one of these extensions in whatever case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def images(spark: SparkSession, path: str | Sequence[str], extensions: Sequence[str] = tuple(e[1:] for e in N.IMAGE_EXTENSIONS)) -> DataFrame:
    """Images of all codecs that Spark's image source knows (JPEG, PNG, BMP, TIFF and others), decoded in the JVM; a broken
    file is an error row. Files of other extensions are never opened."""
    df = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", any_case(extensions)).load(path).select("image").withColumn("path", url_decoded("image.origin"))
    bad = (F.col("image.nChannels") < 1) | F.col("image.data").isNull()
    df = df.select("path", file_name("path").alias("name"), "image", F.when(bad, F.concat(F.lit("Cannot read image: "), "path")).alias("error"))
    return df.where(N.supported("name"))


def page_counts(files: DataFrame, dpi: int) -> DataFrame:
    """file_seq and n_pages of each document (file_seq, name, content); 1 for what cannot be read, which is one error row."""

    def task(batches):
        for pdf in batches:
            n = [codec.pdf_page_count(c) or len(decoded(name, c, dpi) or [None]) for name, c in zip(pdf["name"], pdf["content"])]
            yield pd.DataFrame({"file_seq": pdf["file_seq"], "n_pages": n})

    return files.select("file_seq", "name", "content").mapInPandas(task, "file_seq long, n_pages int")


def read_pages(spark: SparkSession, listed: DataFrame, path: str | Sequence[str], dpi: int = 300) -> DataFrame:
    """page_seq, name, image (BGR) and error of all pages of the listed files (file_seq, path, name) below ``path``.

    Documents and codecs with a renderer of their own are read as bytes, all other images by Spark's image source.
    Each source opens its own files alone. Pages are numbered by file_seq and page number, so numbering moves no pixels;
    the last join moves them by these keys where the keys are too many to broadcast.
    """
    listed = listed.select("file_seq", "name", plain("path").alias("at"))
    mine = ("pdf", *(e for e in RENDERERS if e != "pdf"))
    own = N.extension("name").isin(*("." + e for e in mine))
    whole = spark.read.format("binaryFile").option("pathGlobFilter", any_case(mine)).load(path).select(plain("path").alias("at"), "path", "content")
    files = whole.join(listed.where(own), "at")
    counts = page_counts(files, dpi)
    first = F.when(F.endswith(F.lower("name"), F.lit(".pdf")), 1).otherwise(0)
    keys = listed.join(counts, "file_seq", "left").select("file_seq", F.explode(F.sequence(first, first + F.coalesce("n_pages", F.lit(1)) - 1)).alias("page_no"))
    keys = numbered(keys, "page_seq", "file_seq", "page_no")
    found = pages(files, dpi).withColumn("page_no", F.when(F.col("error").isNull(), F.col("page_no")).otherwise(first))
    if listed.where(~own).take(1):
        other = images(spark, path, [e[1:] for e in N.IMAGE_EXTENSIONS if e[1:] not in mine]).select(plain("path").alias("at"), "image", "error").join(listed.where(~own), "at")
        found = found.unionByName(in_bgr(other.select("file_seq", F.lit(0).alias("page_no"), "name", "image", "error")))
    return found.join(keys, ["file_seq", "page_no"]).select("page_seq", "name", "image", "error")


def in_bgr(found: DataFrame) -> DataFrame:
    """Images of one or four channels as three; error rows have no image."""

    def task(batches):
        for pdf in batches:
            yield pdf.assign(image=[None if e is not None else pack(kernels.to_bgr(unpack(i)), i["origin"]) for i, e in zip(pdf["image"], pdf["error"])])

    usual = (F.col("image.nChannels") == 3) & F.col("error").isNull()
    return found.where(usual).union(found.where(~usual).mapInPandas(task, found.schema))


def stopping(found: DataFrame) -> DataFrame:
    """page_seq, name, image; a page that could not be read stops the run."""
    image = F.when(F.col("error").isNull(), F.col("image")).otherwise(F.raise_error(F.col("error")).cast(schema.IMAGE))
    return found.select("page_seq", "name", image.alias("image"))


def load(spark: SparkSession, path: str, dpi: int = 300) -> DataFrame:
    """page_seq, name, image of a folder in natural order. A file that cannot be read stops the run."""
    return stopping(read_pages(spark, in_natural_order(folder(spark, path).select("path", "name")), path, dpi))


def load_list(spark: SparkSession, paths: Sequence[str], dpi: int = 300) -> DataFrame:
    """page_seq, name, image of the files of a list in its own order, images and documents mixed."""
    listed = checked_list(spark, paths)
    return stopping(read_pages(spark, listed, [r["path"] for r in listed.select("path").collect()], dpi))


def selected_pages(documents: DataFrame, indices: Sequence[int]) -> DataFrame:
    """The pages of each document (name, n_pages) at these indices from 0, in their order and as often as named.

    Adds pos, idx, page_name, and error for an index out of range. It comes before any rendering, so that pages
    that nobody wants are never drawn.
    """
    wanted = F.posexplode(F.array(*map(F.lit, indices))).alias("pos", "idx")
    out = documents.select("*", wanted)
    ok = (F.col("idx") >= 0) & (F.col("idx") < F.col("n_pages"))
    error = F.concat(F.lit("PDF page index out of range: "), F.col("idx").cast("string"))
    return out.withColumns({"page_name": F.when(ok, N.page_name("name", F.col("idx") + 1)), "error": F.when(~ok, error)})
