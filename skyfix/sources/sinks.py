"""Writers: reference tables, exports, result documents and work tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def save_reference_db(tiles: DataFrame, descriptors: DataFrame, path: str, rebuild: bool = False) -> None:
    """Write tiles and descriptors by region. Without rebuild a database that is there stays as it is."""
    mode = "overwrite" if rebuild else "ignore"
    tiles.write.mode(mode).partitionBy("region").parquet(f"{path}/tiles")
    descriptors.write.mode(mode).partitionBy("region").parquet(f"{path}/descriptors")


def save_tiles(tiles: DataFrame, path: str) -> None:
    """Write tiles by year and zoom, so that scoped scans read only theirs."""
    tiles.write.mode("overwrite").partitionBy("year", "zoom").parquet(path)


def save_export(results: DataFrame, summary: DataFrame | Callable[[DataFrame], DataFrame], path: str) -> None:
    """Write localization results as JSON lines, gzipped, and the summary beside them. A summary given as a function is made of the
    results as they were written, which are then worked out once."""
    results.write.mode("overwrite").json(f"{path}/frames", compression="gzip")
    if callable(summary):
        summary = summary(results.sparkSession.read.schema(results.schema).json(f"{path}/frames"))
    summary.write.mode("overwrite").json(f"{path}/summary")


def save_document(document: DataFrame, path: str) -> None:
    """Write a one-row document as text."""
    document.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def save_results(documents: DataFrame, path: str) -> None:
    """Write documents (model, document), one for each model, as `results_<model>.json` files, each whole. A file of that name that
    is there is replaced. Models are few: the driver renames a file for each."""
    spark = documents.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    documents.select("model", F.col("document").alias("value")).repartition("model").write.partitionBy("model").text(staged)
    of = spark._jvm.org.apache.hadoop.fs.Path
    files = of(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(of(staged)):
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith("model="):
            target = of(f"{path}/results_{unquote(name.removeprefix('model='))}.json")
            files.delete(target, False)
            part = next(x.getPath() for x in files.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-"))
            files.rename(part, target)
    files.delete(of(staged), True)


def save_verified(verified: DataFrame, counts: DataFrame, path: str) -> None:
    """Write verified queries as JSON lines with their place (most inliers first, then by tile_id), and the outcome counts beside
    them. Places count within groups of equal inliers, which are added up in order."""
    groups = verified.groupBy("best_inliers").agg(F.count("*").alias("n"))
    before = groups.select("best_inliers", (F.sum("n").over(W.orderBy(F.desc("best_inliers"))) - F.col("n")).alias("before"))  # a row for each number of inliers
    place = F.col("before") + F.row_number().over(W.partitionBy("best_inliers").orderBy("tile_id"))
    rows = verified.select("tile_id", "best_inliers").join(before, "best_inliers").select(place.alias("place"), "tile_id", "best_inliers")
    rows.write.mode("overwrite").json(f"{path}/verified")
    counts.write.mode("overwrite").json(f"{path}/stats")


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
