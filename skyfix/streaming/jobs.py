"""Structured Streaming jobs: localization of frame streams, measurement arcs, resource windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.operators.localize import MIN_INLIERS, localize
from skyfix.operators.tile_index import TileIndex, build_index, search_index


def localize_stream(frames: DataFrame, batch_job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger):
    """Start a query that runs the batch localization on each micro-batch of frames and appends its result, once for each
    batch: a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch_job(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def localization_job(
    descriptors: DataFrame | TileIndex, matcher: Callable[[DataFrame], DataFrame], tiles: DataFrame, dim: int, k: int, least: int = MIN_INLIERS,
) -> Callable[[DataFrame], DataFrame]:
    """A batch job for localize_stream: searches the reference descriptors for each frame (query_id, descriptor, query_h,
    query_w), matches the k best tiles and localizes.

    descriptors: an index, or a table of which one is made here, once: no micro-batch reads the table again. matcher: from (query_id, tile_id, rank, similarity) to the same with num_inliers, correspondences and homography. tiles:
    tile_id, corners, tile_h, tile_w. A frame that names its own_tile does not find that one.
    """
    index = descriptors if isinstance(descriptors, TileIndex) else build_index(descriptors, dim)

    def job(batch: DataFrame) -> DataFrame:
        own = [c for c in ("own_tile",) if c in batch.columns]
        found, _ = search_index(batch.select("query_id", "descriptor", *own), index, k, bool(own))
        candidates = matcher(found).join(tiles, "tile_id")
        return localize(batch.select("query_id", "query_h", "query_w"), candidates, least)

    return job


def measurement_arcs(
    ties: DataFrame, length: str = "15 minutes", late: str = "10 minutes", ts: str = "ts", camera: str = "camera",
) -> DataFrame:
    """(camera, arc_start, arc_end, n_rows, n_frames) of tumbling windows; works on streams and tables alike. Frames are counted
    exactly by two aggregations, one behind the other: rows of each frame in a window, then frames of the window. Open windows
    hold a row of two numbers for each frame, which keys of a store hold, never a list; null is no frame."""
    rows = ties.withWatermark(ts, late) if ties.isStreaming else ties
    of_frame = rows.groupBy(F.window(ts, length).alias("w"), camera, "frame_id").agg(F.count("*").alias("n"))
    arcs = of_frame.groupBy(F.window(F.window_time("w"), length).alias("arc"), camera)
    return arcs.agg(F.sum("n").alias("n_rows"), F.count("frame_id").alias("n_frames")).select(
        camera, F.col("arc.start").alias("arc_start"), F.col("arc.end").alias("arc_end"), "n_rows", "n_frames",
    )


def resource_windows(
    samples: DataFrame, length: str = "1 hour", late: str = "10 minutes", ts: str = "ts", value: str = "rss_mb",
) -> DataFrame:
    """(window_start, window_end, peak, mean, n) of a resource sample stream or table."""
    rows = samples.withWatermark(ts, late) if samples.isStreaming else samples
    return rows.groupBy(F.window(ts, length).alias("w")).agg(F.max(value).alias("peak"), F.avg(value).alias("mean"), F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "peak", "mean", "n",
    )
