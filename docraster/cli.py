"""python -m docraster.cli benchmark-crop --input FOLDER --output FOLDER [--pdf-dpi 300] [--backends ...]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

VERSION = "0.1.0"


def crop_benchmark(spark: SparkSession, input_dir: str, output_dir: str, backends: list[str], dpi: int = 300):
    """The report's rows: each backend runs over all pages of a folder and writes one document of what it made. Pages that
    cannot be read are in no document; ``unreadable_pages`` counts them."""
    from docraster.operators import detect
    from docraster.plans.benchmark import report
    from docraster.plans.ordering import settled
    from docraster.sources import files, sinks

    name = input_dir.rstrip("/").rpartition("/")[2]
    found = files.folder(spark, input_dir)
    if input_dir.rstrip("/") == output_dir.rstrip("/"):
        own = spark.createDataFrame([(f"{name}_{b}.pdf",) for b in backends], "name string")
        found = files.without_outputs(found, own)
    ordered = files.in_natural_order(found.select("path", "name"))
    if not ordered.take(1):
        raise ValueError("No supported files found for benchmark input.")
    read = settled(files.read_pages(spark, ordered, input_dir, dpi))  # decoded once for all backends
    pages, unreadable = read.where("error is null"), read.where("error is not null").count()
    results, failures = None, []
    for k, b in enumerate(backends):
        try:  # whatever stops a backend is its own row of the report
            detect.probe(b)
            scanned = settled(detect.scanned(pages, [b]))
            made = scanned.select("page_seq", F.coalesce("scan.warped", "image").alias("image"))
            sinks.export_pdf(made, f"{output_dir.rstrip('/')}/{name}_{b}.pdf", dpi)
        except Exception as why:
            failures.append((k, b, str(why)))
            continue
        one = scanned.select(F.col("page_seq").alias("page"), F.lit(k).alias("backend_ord"), F.lit(b).alias("backend"), F.col("scan.detected").alias("detected"))
        results = one if results is None else results.union(one)
    if results is None:
        results = spark.createDataFrame([], "page long, backend_ord int, backend string, detected boolean")
    return report(results, name, failures).withColumn("unreadable_pages", F.lit(unreadable))


def main(argv: list[str] | None = None) -> int:
    # The options of the command line
    parser = argparse.ArgumentParser(prog="docraster")
    parser.add_argument("--version", action="version", version=VERSION)
    bench = parser.add_subparsers(dest="command").add_parser("benchmark-crop")
    bench.add_argument("--input", required=True)
    bench.add_argument("--output", required=True)
    bench.add_argument("--pdf-dpi", type=int, default=300)
    bench.add_argument("--backends", nargs="+", default=["paddleocr_uvdoc"])
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 1
    from docraster.plans.benchmark import summary

    rows = crop_benchmark(SparkSession.builder.getOrCreate(), args.input, args.output, args.backends, args.pdf_dpi)
    print(summary(rows))
    if lost := rows.agg(F.max("unreadable_pages")).first()[0]:
        print(f"unreadable pages: {lost}")
    return 0 if rows.where("output_pdf is not null").take(1) else 1


if __name__ == "__main__":
    raise SystemExit(main())
