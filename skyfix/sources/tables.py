"""Readers: image listings, manifests, result files and saved reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyfix.functions.ids import model_of_results, parse_footprint
from skyfix.operators.plugins import image_key

#: Fields of a manifest line; numbers come as text.
MANIFEST = "mission string, roll string, frame string, pdate string, directory string, filename string, nadir_lat string, nadir_lon string, orientation string, " + ", ".join(f"{c}_{k} string" for c in ("ul", "ur", "lr", "ll") for k in ("lat", "lon"))
RECALLS = "map<string, struct<recalls: map<string, double>, num_evaluated: bigint, coords: struct<num_scored: bigint, top1_correct_tile_rate: double, median_coord_error_km: double, mean_coord_error_km: double>, num_db_tiles: bigint>>"


def _footprints(files: DataFrame, strict: bool) -> DataFrame:
    rows = files.select(F.col("path").alias("image_path"), parse_footprint(F.col("path"), strict).alias("p"))
    place = F.regexp_extract("image_path", r"/(\d{4})_(\d{2})/", 1).try_cast("int"), F.regexp_extract("image_path", r"/(\d{4})_(\d{2})/", 2).try_cast("int")
    return rows.select("p.*", "image_path", place[0].alias("year"), place[1].alias("zoom"))


def reference_tiles(
    spark: SparkSession, path: str, strict: bool = True, year: int | None = None, zooms: tuple[int, ...] | None = None,
) -> DataFrame:
    """Footprints of all .jpg files below a folder, with year and zoom from their `YYYY_ZZ` folder. Images are not opened. With a
    year or zooms only folders of that name are listed; without, the whole tree is."""
    place = path
    if year is not None or zooms is not None:
        place = f"{path}/{'[0-9][0-9][0-9][0-9]' if year is None else f'{year:04d}'}_" + ("[0-9][0-9]" if zooms is None else "{" + ",".join(f"{z:02d}" for z in zooms) + "}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(place)
    return _footprints(files.select("path"), strict)


def query_set(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Footprints of the .jpg files in a folder, not below it."""
    return _footprints(spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path).select("path"), strict)


def scoped(tiles: DataFrame, year: int | None = None, zooms: tuple[int, ...] | None = None) -> DataFrame:
    """Tiles of a year and of some zooms; both prune partitions of saved tables."""
    if year is not None:
        tiles = tiles.where(F.col("year") == year)
    return tiles.where(F.col("zoom").isin(*zooms)) if zooms is not None else tiles


def frames(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(frame_id, path[, content]) of the images (.jpg, .jpeg, .png, any case) in a folder, by path."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))
    return files.select(image_key("path").alias("frame_id"), "path", *(["content"] if content else [])).orderBy("path")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines with nulls for missing fields and for lines that are not JSON, and `line`, which orders them: by file, by
    place in the file. Files are read in splits; a split's rows are numbered as they come."""
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    return text.select(F.from_json("value", MANIFEST).alias("m"), F.struct("file", "start", "at").alias("line")).select("m.*", "line")


def manifest_numbers(rows: DataFrame) -> DataFrame:
    """Manifest rows with numbers as doubles; a row with one that is missing or malformed is dropped."""
    fields = ["nadir_lat", "nadir_lon", "orientation", *(f"{c}_{k}" for c in ("ul", "ur", "lr", "ll") for k in ("lat", "lon"))]
    fields = [f for f in fields if f in rows.columns]
    typed = rows.select(*(c for c in rows.columns if c not in fields), *(F.col(f).try_cast("double").alias(f) for f in fields))
    return typed.dropna(subset=fields)


def reference_db(spark: SparkSession, path: str, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tiles, descriptors) of a saved database, of one region if given."""
    out = tuple(spark.read.parquet(f"{path}/{t}") for t in ("tiles", "descriptors"))
    return tuple(t.where(F.col("region") == region) for t in out) if region is not None else out


def results(spark: SparkSession, path: str) -> DataFrame:
    """(model, region, recalls, num_evaluated, coords, num_db_tiles) of `results_<model>.json` files; smoke tests are left out."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="results_*.json").withColumn("model", model_of_results(F.input_file_name()))
    docs = text.where(~F.col("model").contains("smoketest")).select("model", F.explode(F.from_json("value", RECALLS)).alias("region", "r"))
    return docs.select("model", "region", "r.*")


def saved_export(spark: SparkSession, path: str, shape: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(frames, summary) of an export; shape: the frames' columns and types."""
    summary = spark.read.schema("num_frames bigint, fix_rate_percent double").json(f"{path}/summary")
    return spark.read.schema(shape).json(f"{path}/frames"), summary


def verified_cache(spark: SparkSession, path: str) -> DataFrame:
    """(place, tile_id, best_inliers) of saved verified queries."""
    return spark.read.schema("place long, tile_id string, best_inliers int").json(f"{path}/verified")


def verified_document(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, best_inliers) of a verified-query document that holds them in one list."""
    shape = "verified array<struct<tile_id: string, best_inliers: int>>, stats struct<n_sampled: bigint, n_retrieval_miss: bigint, n_matcher_shortfall: bigint, n_verified: bigint>"
    return spark.read.schema(shape).json(path, multiLine=True).select(F.inline("verified"))


def training_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
