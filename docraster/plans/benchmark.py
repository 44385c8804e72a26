"""The detector report: pages and detected pages of each backend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(results: DataFrame, input_name: str, failures: Sequence[tuple[int, str, str]] = ()) -> DataFrame:
    """backend_ord, backend, output_pdf, total_pages, detected_pages, error.

    results: page, backend_ord, backend, detected. A backend that failed as a whole stands in failures
    (backend_ord, backend, error) and has no pages.
    """
    ok = results.groupBy("backend_ord", "backend").agg(F.count("*").alias("total_pages"), F.count_if("detected").alias("detected_pages"))
    ok = ok.select("backend_ord", "backend", F.concat(F.lit(f"{input_name}_"), "backend", F.lit(".pdf")).alias("output_pdf"), "total_pages", "detected_pages", F.lit(None).cast("string").alias("error"))
    if not failures:
        return ok
    bad = results.sparkSession.createDataFrame(list(failures), "backend_ord int, backend string, error string")
    return ok.unionByName(bad.select("backend_ord", "backend", F.lit(None).cast("string").alias("output_pdf"), F.lit(0).cast("long").alias("total_pages"), F.lit(0).cast("long").alias("detected_pages"), "error"))


def summary_line() -> Column:
    done = F.concat("backend", F.lit(": "), "output_pdf", F.lit(" (detected "), F.col("detected_pages").cast("string"), F.lit("/"), F.col("total_pages").cast("string"), F.lit(")"))
    return F.when(F.col("error").isNotNull(), F.concat("backend", F.lit(": failed - "), "error")).otherwise(done)


def summary(rows: DataFrame) -> str:
    """One line per backend in their order. The table has a row per backend."""
    return "\n".join(r[0] for r in rows.orderBy("backend_ord").select(summary_line()).collect())
