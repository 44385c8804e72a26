"""Pages to numbered image files and to one document, and the derived assets of a page store.

Page files go through the sink of ``pagefiles``, which publishes what Spark commits and nothing else. A document has one writer by nature; it gets the pages in order, one Arrow batch at a time.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docraster.functions import codec, kernels
from docraster.functions import names as N
from docraster.sources.files import few, pack, unpack

#: Codecs that are written here; others (JPEG, WebP) can be registered.
ENCODERS = {"png": codec.png_bytes, "tif": codec.tiff_bytes, "tiff": codec.tiff_bytes, "bmp": codec.bmp_bytes}


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def put(uri: str, data: bytes) -> None:
    where, path = _filesystem(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(mine, compression=None) as out:
        out.write(data)
    where.move(mine, path)


def needs_encoding(name: Column, ext: str) -> Column:
    """False where the file already has the wanted extension, so that its bytes can be copied."""
    return N.extension(name) != "." + ext.lower().lstrip(".")


def encode(img, ext: str) -> bytes:
    if ext not in ENCODERS:
        raise ValueError(f"no encoder for .{ext}; register one in ENCODERS")
    return ENCODERS[ext](img)


def _nonempty(df: DataFrame, said: str) -> None:
    if not df.take(1):
        raise ValueError(said)


def _published(pages: DataFrame, folder: str, ext: str, base: str, start: int) -> DataFrame:
    """Writes pages (page_seq, image or content) exactly once; page_seq and path of each."""
    from docraster.sources.pagefiles import PageFiles

    ext = ext.strip().lower().lstrip(".") or "png"
    pages.sparkSession.dataSource.register(PageFiles)
    out = pages.write.format("docraster_pages").mode("append").option("path", folder).option("ext", ext).option("base", base).option("start", start)
    out.save()
    return pages.select("page_seq", F.concat(F.lit(folder.rstrip("/") + "/"), N.export_name(F.col("page_seq") + (start - 1), base, ext)).alias("path"))


def export_files(pages: DataFrame, folder: str, ext: str = "png", base: str = "page", start: int = 1) -> DataFrame:
    """Writes each page (page_seq from 1 on, image) to base_00001.ext; page_seq and path of each. No file is left by a run
    that fails."""
    _nonempty(pages, "No pages to export.")
    if (ext.strip().lower().lstrip(".") or "png") not in ENCODERS:
        encode(None, ext.strip().lower().lstrip("."))
    return _published(pages.select("page_seq", "image"), folder, ext, base, start)


def as_read(files: DataFrame, by_path: bool = True) -> DataFrame:
    """Adds ``image`` to image files (path, name, content): unchanged, by the package's own decoder where it can, else by
    Spark's image source if path is where the file is. What neither can read has an ``error``."""
    from docraster.sources.files import decoded, images, plain

    def own(batches):
        for pdf in batches:
            found = [decoded(n, c, 300, unchanged=True) for n, c in zip(pdf["name"], pdf["content"])]
            yield pdf[["path"]].assign(image=[pack(f[0]) if f else None for f in found])

    image = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    first = files.select("path", "name", "content").where(N.extension("name") == ".png").mapInPandas(own, f"path string, {image}").where("image is not null")
    rest = files.select("path", "name").join(first.select("path"), "path", "left_anti")
    paths = [r["path"] for r in rest.select("path").distinct().collect()] if by_path else []  # no more than Spark's own listing of them
    if paths:
        read = images(files.sparkSession, paths).where("error is null").select(plain("path").alias("at"), "image")
        other = rest.select("path", plain("path").alias("at")).join(read, "at").select("path", "image")
        first = first.unionByName(other)
    error = F.when(F.col("image").isNull(), F.concat(F.lit("Cannot read image: "), "name"))
    return files.join(first, "path", "left").withColumn("error", error)


def export_existing(files: DataFrame, folder: str, ext: str = "png", base: str = "page") -> DataFrame:
    """Files (page_seq, path, name, content) under new names: copied byte by byte where the extension is the same, else
    read and encoded anew, whatever codec of the image source they have. Two branches, so that what is only copied is
    never decoded."""
    _nonempty(files, "No image paths to export.")
    files, other = files.select("page_seq", "path", "name", "content"), needs_encoding(F.col("name"), ext)
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    from docraster import schema

    read = as_read(files.where(other))
    anew = read.select("page_seq", F.when(F.col("error").isNull(), F.col("image")).otherwise(F.raise_error(F.col("error")).cast(schema.IMAGE)).alias("image"), F.lit(None).cast("binary").alias("content"))
    same = files.where(~other).select("page_seq", F.lit(None).cast(image).alias("image"), "content")
    return _published(same.union(anew), folder, ext, base, 1)


def _one_pdf(pages: DataFrame, out_pdf: str, dpi: int, said: str, drawn) -> str:
    """One document of all pages in order. Tasks compress the pages; the writer gets them one Arrow batch at a time and
    streams them on, so it never holds more of them."""
    if dpi < 72:
        raise ValueError("PDF DPI must be >= 72")
    _nonempty(pages, said)
    head, _, last = out_pdf.rpartition("/")
    out_pdf = f"{head}/{last.rpartition('.')[0] or last}.pdf" if head else f"{last.rpartition('.')[0] or last}.pdf"

    def compress(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 8):
                rows = [codec.pdf_image(drawn(r)) for r in pdf.iloc[at : at + 8].itertuples(index=False)]
                yield pd.DataFrame({"page_seq": pdf["page_seq"].iloc[at : at + 8].to_numpy(), "width": [r[0] for r in rows], "height": [r[1] for r in rows], "kind": [r[2] for r in rows], "data": [r[3] for r in rows]})

    def task(batches):
        where, path = _filesystem(out_pdf)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        mine = f"{path}.{uuid.uuid4().hex}"
        with where.open_output_stream(mine, compression=None) as out:
            for part in codec.pdf_parts((r for pdf in batches for r in zip(pdf["width"], pdf["height"], pdf["kind"], pdf["data"])), dpi):
                out.write(part)
        where.move(mine, path)
        yield pd.DataFrame({"path": [out_pdf]})

    made = pages.mapInPandas(compress, "page_seq long, width int, height int, kind string, data binary")
    made.repartition(1).sortWithinPartitions("page_seq").mapInPandas(task, "path string").collect()
    return out_pdf


def export_pdf(pages: DataFrame, out_pdf: str, dpi: int = 300) -> str:
    """One document of all pages (page_seq, image) in order; the path gets the suffix .pdf."""
    return _one_pdf(pages.select("page_seq", "image"), out_pdf, dpi, "No pages to export.", lambda r: unpack(r.image))


def export_paths_pdf(files: DataFrame, out_pdf: str, dpi: int = 300) -> str:
    """One document of image files (page_seq, path, name, content) in order; JPEG files go in as they are, undecoded,
    others are read by whatever codec they have (without a path, by the package's own alone)."""
    by_path = "path" in files.columns
    files = files if by_path else files.withColumn("path", F.col("name"))
    jpeg = F.substring("content", 1, 2) == F.unhex(F.lit("FFD8"))
    files = files.select("page_seq", "path", "name", "content")
    read = as_read(files.where(~jpeg), by_path).select("page_seq", "name", F.lit(None).cast("binary").alias("content"), "image", "error")
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    as_is = files.where(jpeg).select("page_seq", "name", "content", F.lit(None).cast(image).alias("image"), F.lit(None).cast("string").alias("error"))

    def drawn(r):
        if r.error is not None:
            raise RuntimeError(r.error)
        if r.content is not None and codec.jpeg_size(r.content):
            return r.content
        if r.image is None:
            raise RuntimeError(f"Cannot read image: {r.name}")
        return unpack(r.image)

    return _one_pdf(as_is.union(read), out_pdf, dpi, "No image paths to export.", drawn)


def resized(img, most_width: int, most_height: int):
    """At most so large, gray as three channels."""
    out, _ = kernels.shrunk(kernels.to_bgr(img), max(most_width, most_height)) if max(img.shape[:2]) > max(most_width, most_height) else (kernels.to_bgr(img), 1.0)
    h, w = out.shape[:2]
    scale = min(most_width / w, most_height / h, 1.0)
    return out if scale == 1.0 else kernels.shrunk(out, int(max(h, w) * scale))[0]


def assets(pages: DataFrame) -> DataFrame:
    """entry_id, asset, image: the five assets of each page (entry_id, image)."""
    kinds = {"original": None, "current": None, "preview_original": (1920, 1080), "preview_current": (1920, 1080), "thumb": (320, 320)}

    def task(batches):
        for pdf in few(batches, 32):
            rows = []
            for entry, image in zip(pdf["entry_id"], pdf["image"]):
                img = unpack(image)
                rows += [(entry, k, pack(img if size is None else resized(img, *size))) for k, size in kinds.items()]
            yield pd.DataFrame(rows, columns=["entry_id", "asset", "image"])

    return pages.select("entry_id", "image").mapInPandas(task, "entry_id string, asset string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def without_assets(store: DataFrame, gone: DataFrame) -> DataFrame:
    """A store (entry_id, asset, ...) without all assets of the entries in gone."""
    return store.join(gone.select("entry_id").distinct(), "entry_id", "left_anti")


def renewed(store: DataFrame, changed: DataFrame, kind: str) -> DataFrame:
    """A store after some entries (entry_id, image) got a new original or current image: a new original brings its preview
    with it, a new current image its preview and the thumbnail."""
    names = {"original": ["original", "preview_original"], "current": ["current", "preview_current", "thumb"]}[kind]
    kept = store.join(changed.select("entry_id", F.explode(F.array(*map(F.lit, names))).alias("asset")), ["entry_id", "asset"], "left_anti")
    return kept.unionByName(assets(changed).where(F.col("asset").isin(names)).select(*kept.columns))
