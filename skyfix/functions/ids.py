"""Footprint file names, tile ids and display strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the file name format: `@`-separated fields, eight corner numbers first, then these.
FIELDS = 14
TAIL = ("image_id", "timestamp", "nadir_lat", "nadir_lon", "sq_km_area", "orientation")
ROTATIONS = (0, 90, 180, 270)


def corner(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def name_fields(path: Column) -> Column:
    """The non-empty `@` fields of a path's base name without its extension."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.@/]*$", "")
    return F.filter(F.split(base, "@"), lambda x: x != "")


def parse_footprint(path: Column, strict: bool = True) -> Column:
    """struct(tile_id, corners, timestamp, nadir_lat, nadir_lon, sq_km_area, orientation, error) of a footprint file name.

    Names need exactly 14 fields and numbers where numbers belong. strict: a bad name fails the query; else its error says
    what is wrong and the rest is null.
    """
    f = name_fields(path)
    number = lambda i: F.get(f, F.lit(i)).try_cast("double")
    numeric = [number(i) for i in (*range(8), 10, 11, 12, 13)]
    bad = F.when(F.size(f) != FIELDS, F.concat(F.lit("expected 14 fields, got "), F.size(f).cast("string")))
    for n in numeric:
        bad = bad.when(n.isNull(), "a number is malformed")
    good = bad.isNull()
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("footprint name "), path, F.lit(": "), bad)).cast("boolean"))
    corners = F.array(*(corner(number(2 * i), number(2 * i + 1)) for i in range(4)))
    ok = lambda c: F.when(good, c)
    return F.struct(
        ok(tile_id(F.get(f, F.lit(8)), F.get(f, F.lit(9)))).alias("tile_id"), ok(corners).alias("corners"), ok(F.get(f, F.lit(9))).alias("timestamp"),
        *(ok(number(10 + i)).alias(name) for i, name in enumerate(TAIL[2:])), bad.alias("error"),
    )


def tile_id(image_id: Column, timestamp: Column) -> Column:
    """Image ids come back each year, so a tile's id has both."""
    return F.concat_ws("@", image_id, timestamp)


def footprint_name(
    corners: Column, image_id: Column, timestamp: Column, nadir_lat: Column, nadir_lon: Column, area: Column, orientation: Column,
) -> Column:
    """The file name that parse_footprint reads: coordinates with six decimals, the orientation with one."""
    spots = [corners[i][k] for i in range(4) for k in ("lat", "lon")]
    return F.format_string(
        "@" + "%.6f@" * 8 + "%s@%s@%.6f@%.6f@%d@%.1f@.jpg", *spots, image_id, timestamp, nadir_lat, nadir_lon, area.cast("long"),
        orientation,
    )


def add_rotation(tile: Column, degrees: Column) -> Column:
    return F.concat(tile, F.lit("::rot"), degrees.cast("string"))


def base_tile(variant: Column) -> Column:
    """The tile of a rotation variant; an id without a suffix is its own."""
    return F.substring_index(variant, "::rot", 1)


def rotation_of(variant: Column) -> Column:
    return F.coalesce(F.regexp_extract(variant, r"::rot(\d+)$", 1).try_cast("int"), F.lit(0))


def path_token(region: Column) -> Column:
    return F.replace(region, F.lit(" "), F.lit("_"))


def model_of_results(path: Column) -> Column:
    """`results_<model>.json` → model."""
    return F.regexp_extract(path, r"results_([^/]*)\.json$", 1)


def frame_key(mission: Column, roll: Column, frame: Column) -> Column:
    return F.concat_ws("-", mission, roll, frame)


def candidate_tag(inliers: Column, best: Column, least: int = 30) -> Column:
    return F.when(best, "BEST").when(inliers >= least, "ok").otherwise("would fail")
