"""Pixel arithmetic as column expressions, on columns that hold one channel's value each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def image(height: int, width: int, channels: int, data: Column) -> Column:
    """An image of bytes that come row by row, in the layout of Spark's image source."""
    from docraster import schema

    whole = {"height": height, "width": width, "nChannels": channels, "mode": schema.GRAY_MODE if channels == 1 else schema.BGR_MODE}
    return F.struct(F.lit("").alias("origin"), *(F.lit(v).alias(k) for k, v in whole.items()), data.alias("data"))


def gray(b: Column, g: Column, r: Column) -> Column:
    """0.299 R + 0.587 G + 0.114 B in 14-bit fixed point, rounded."""
    return F.shiftright(b * 1868 + g * 9617 + r * 4899 + 8192, 14)


def gain_bias(p: Column, contrast: Column, brightness: Column) -> Column:
    """|contrast * p + brightness|, rounded half to even and capped at 255. The absolute value is part of it."""
    return F.least(F.lit(255), F.bround(F.abs(contrast * p + brightness), 0).cast("int"))


def threshold(p: Column, at: Column) -> Column:
    return F.when(p > at, 255).otherwise(0)


def low_variance(px: DataFrame, least: float = 5.0) -> DataFrame:
    """page, std (population) and whether the page is too even to hold anything."""
    return px.groupBy("page").agg(F.stddev_pop("p").alias("std")).withColumn("rejected", F.col("std") < least)


def otsu(px: DataFrame) -> DataFrame:
    """page and the threshold with the largest variance between the two sides (the lowest, if tied).

    Works on each page's histogram: 256 rows at most, whatever the page's size.
    """
    h = px.groupBy("page", "p").agg(F.count("*").alias("n"))
    up, all_of = W.partitionBy("page").orderBy("p"), W.partitionBy("page")
    h = h.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("p")).over(up), "w": F.sum("n").over(all_of), "s": F.sum(F.col("n") * F.col("p")).over(all_of)})
    gap = F.col("s0") * F.col("w") - F.col("s") * F.col("w0")
    between = (gap.cast("double") * gap) / (F.col("w0").cast("double") * F.greatest(F.lit(1), F.col("w") - F.col("w0")))
    scored = h.withColumn("v", F.when(F.col("w0") < F.col("w"), between).otherwise(0.0))
    return scored.groupBy("page").agg(F.min_by("p", F.struct(-F.col("v"), "p")).alias("threshold"))


def box_blur(px: DataFrame, height: int, width: int) -> DataFrame:
    """Sum of each pixel's 3 x 3 neighbourhood with the border repeated: each pixel is sent to the places that use it."""
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    to = px.select("page", "y", "x", step.alias("dy"), "p").select("page", "y", "x", "dy", step.alias("dx"), "p")
    # pixel (y, x) serves (y + dy, x + dx); at the border it also stands in for what lies outside
    own = to.select("page", (F.col("y") + F.col("dy")).alias("ty"), (F.col("x") + F.col("dx")).alias("tx"), "y", "x", "p").where(F.col("ty").between(0, height - 1) & F.col("tx").between(0, width - 1))
    times = lambda t, s, n: F.when((F.col(t) == F.col(s)) & F.col(s).isin(0, n - 1), 2 if n > 1 else 3).otherwise(1)
    weight = times("ty", "y", height) * times("tx", "x", width)
    return own.groupBy("page", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("p") * weight).alias("total"))


def rotated(px: DataFrame, height: int, width: int, left: bool = True) -> DataFrame:
    """Each pixel's place after a quarter turn."""
    y, x = (width - 1 - F.col("x"), F.col("y")) if left else (F.col("x"), height - 1 - F.col("y"))
    return px.select("page", y.cast("int").alias("y"), x.cast("int").alias("x"), "p")


def split_spread(px: DataFrame, width: int) -> DataFrame:
    """page, half, y, x, p: the left and right halves; the right one has the odd column. Pages of one column stay whole."""
    mid = width // 2
    right = F.lit(width >= 2) & (F.col("x") >= mid)
    return px.select("page", right.cast("int").alias("half"), "y", F.when(right, F.col("x") - mid).otherwise(F.col("x")).alias("x"), "p")
