"""Enhancement presets and lens modes: small dimension tables and the rules that couple them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, contrast, brightness, denoise, threshold, apply_threshold.
PRESETS = (
    ("Custom", 1.0, 0, 0, 170, False),
    ("Document", 1.25, 10, 4, 170, False),
    ("Whiteboard", 1.35, 20, 5, 185, False),
    ("Photo", 1.05, 0, 2, 170, False),
    ("B/W High Contrast", 1.45, 8, 4, 165, True),
)
#: Lens mode, preset, post-processing.
LENS_MODES = (
    ("Document", "Document", "Grayscale"),
    ("Whiteboard", "Whiteboard", "Grayscale"),
    ("Photo", "Photo", "None"),
    ("B/W", "B/W High Contrast", "Black and White"),
)
CUSTOM = "Custom"
#: What the settings' sliders allow.
RANGES = {"contrast": (0.7, 2.0), "brightness": (-80, 80), "denoise": (0, 20), "threshold": (80, 240)}


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "preset string, contrast double, brightness int, denoise int, threshold int, apply_threshold boolean")


def lens_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LENS_MODES), "lens_mode string, preset string, post string")


def resolve_lens_mode(df: DataFrame, mode: str = "lens_mode") -> DataFrame:
    """Adds the preset and post of a lens mode; null for Custom and unknown ones. The dimension has four rows."""
    return df.join(F.broadcast(lens_modes(df.sparkSession).withColumnRenamed("lens_mode", mode)), mode, "left")


def infer_lens_mode(df: DataFrame) -> DataFrame:
    """Adds the lens mode that has a row's preset and post, else Custom."""
    out = df.join(F.broadcast(lens_modes(df.sparkSession)), ["preset", "post"], "left")
    return out.withColumn("lens_mode", F.coalesce("lens_mode", F.lit(CUSTOM)))


def coupled_post(preset: Column, post: Column) -> Column:
    """The post-processing that a change of preset leaves or sets."""
    return (
        F.when(preset == "B/W High Contrast", "Black and White")
        .when(preset.isin("Document", "Whiteboard") & (post == "None"), "Grayscale")
        .when((preset == "Photo") & (post == "Black and White"), "None")
        .otherwise(post)
    )


def with_settings(df: DataFrame) -> DataFrame:
    """Adds the preset's settings; thresholding is also on if the post-processing is Black and White."""
    out = df.join(F.broadcast(presets(df.sparkSession)), "preset", "left")
    return out.withColumn("apply_threshold", F.col("apply_threshold") | (F.col("post") == "Black and White"))


def on_lens_mode_change(df: DataFrame) -> DataFrame:
    """preset and post after a change to the row's lens mode: Custom and unknown modes keep them, others set their own, and
    post then follows the preset's rule."""
    own = lens_modes(df.sparkSession).select("lens_mode", F.col("preset").alias("_preset"), F.col("post").alias("_post"))
    out = df.join(F.broadcast(own), "lens_mode", "left")
    post = F.when(F.col("_preset").isNotNull(), coupled_post(F.col("_preset"), F.col("_post"))).otherwise(F.col("post"))
    return out.withColumns({"post": post, "preset": F.coalesce("_preset", "preset")}).drop("_preset", "_post")


def in_range(setting: str, value: Column) -> Column:
    """The nearest value that the setting's slider allows."""
    low, high = RANGES[setting]
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
