"""Landmark measurement rows for orbit determination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfix.functions.frames import ecef_to_eci, epoch_jd, latlon_to_ecef, pixel_bearing, rescale_pixel


def measurements(ties: DataFrame) -> DataFrame:
    """(frame_id, idx, timestamp_jd, bearing_x/y/z, eci_x/y/z, group_start) from tie points of fixes.

    ties: frame_id, idx, timestamp, u, v, frame_h, frame_w, lat, lon. group_start marks the first row of each frame.
    """
    pixel = rescale_pixel(F.col("u"), F.col("v"), F.col("frame_h"), F.col("frame_w"))
    rows = ties.select("frame_id", "idx", "lat", "lon", pixel.alias("px"), epoch_jd(F.col("timestamp")).alias("timestamp_jd"))
    rows = rows.select(
        "frame_id", "idx", "timestamp_jd", pixel_bearing(F.col("px.u"), F.col("px.v")).alias("b"),
        latlon_to_ecef(F.col("lat"), F.col("lon")).alias("e"),
    )
    rows = rows.withColumn("i", ecef_to_eci(F.col("e"), F.col("timestamp_jd")))
    first = F.row_number().over(W.partitionBy("frame_id").orderBy("idx")) == 1
    return rows.select(
        "frame_id", "idx", "timestamp_jd", *(F.col(f"b.{k}").alias(f"bearing_{k}") for k in "xyz"),
        *(F.col(f"i.{k}").alias(f"eci_{k}") for k in "xyz"), first.alias("group_start"),
    )
