"""Choosing among candidates: the best, or the first that succeeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best(candidates: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Each key's row with the highest score; the first in order, if tied. One aggregate with partial sums, no sort."""
    row = F.struct(*[F.col(c) for c in candidates.columns])
    picked = candidates.groupBy(key).agg(F.min_by(row, F.struct(-F.col(score), F.col(order))).alias("_row"))
    return picked.select("_row.*")


def first_success(results: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Per key: the first backend that detected something, if any did."""
    hit = F.col("detected")
    return results.groupBy(key).agg(
        F.min(F.when(hit, F.col(order))).alias(order),
        F.min_by(F.when(hit, F.col(name)), F.when(hit, F.col(order))).alias(name),
        F.bool_or(hit).alias("detected"),
    )
