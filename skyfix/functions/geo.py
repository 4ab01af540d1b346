"""Geometry of footprints on (lat, lon) degrees, planar as the data model has it, as Column expressions. The clip of two rings
is numpy on Arrow batches: hundreds of steps a pair, which generated code does not take and interpreted ones take long for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres a degree, for the rough snap distance.
DEGREE_KM = 111.0
#: Share of its box that a triangle's doubled area has at least.
FLAT = 1e-9


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def rough_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)) * DEGREE_KM


def _all(corners: Column, key: str) -> list[Column]:
    return [corners[i][key] for i in range(4)]


def bbox(corners: Column) -> Column:
    """struct(lat_min, lat_max, lon_min, lon_max)"""
    lat, lon = _all(corners, "lat"), _all(corners, "lon")
    return F.struct(
        F.least(*lat).alias("lat_min"), F.greatest(*lat).alias("lat_max"), F.least(*lon).alias("lon_min"),
        F.greatest(*lon).alias("lon_max"),
    )


def centroid(corners: Column) -> Column:
    """Mean of the four corners."""
    mean = lambda k: reduce(lambda a, b: a + b, _all(corners, k)) / 4
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def _twice_area(corners: Column) -> Column:
    x, y = _all(corners, "lon"), _all(corners, "lat")
    return reduce(
        lambda a, b: a + b, ((x[i] - x[0]) * (y[(i + 1) % 4] - y[0]) - (x[(i + 1) % 4] - x[0]) * (y[i] - y[0]) for i in range(1, 3)),
    )


def area(corners: Column) -> Column:
    return F.abs(_twice_area(corners)) / 2


def _side(a: Column, b: Column, c: Column) -> Column:
    return (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])


def _meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the closed segments ab and cd share a point."""
    s1, s2, s3, s4 = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    within = lambda p, q, r: r["lon"].between(F.least(p["lon"], q["lon"]), F.greatest(p["lon"], q["lon"])) & r["lat"].between(F.least(p["lat"], q["lat"]), F.greatest(p["lat"], q["lat"]))
    proper = (F.signum(s1) * F.signum(s2) < 0) & (F.signum(s3) * F.signum(s4) < 0)
    touch = [(s == 0) & within(p, q, r) for s, p, q, r in ((s1, a, b, c), (s2, a, b, d), (s3, c, d, a), (s4, c, d, b))]
    return reduce(lambda x, y: x | y, touch, proper)


def valid(corners: Column) -> Column:
    """A simple ring with area: opposite edges share no point. A corner that repeats its neighbour makes a triangle, which has
    more area than rounding gives corners on a line."""
    c = [corners[i] for i in range(4)]
    same = lambda a, b: (a["lat"] == b["lat"]) & (a["lon"] == b["lon"])
    triangle = reduce(lambda x, y: x | y, (same(c[i], c[(i + 1) % 4]) for i in range(4)))
    range_ = lambda k: F.greatest(*_all(corners, k)) - F.least(*_all(corners, k))
    wide = F.abs(_twice_area(corners)) > range_("lat") * range_("lon") * FLAT
    return F.when(triangle, wide).otherwise((_twice_area(corners) != 0) & ~_meet(c[0], c[1], c[2], c[3]) & ~_meet(c[1], c[2], c[3], c[0]))


def _fans(x: np.ndarray, y: np.ndarray):
    """The signed fan of each ring (rows of 4 corners) from its first corner: (sign, x, y) of two counter-clockwise triangles."""
    for i, j in ((1, 2), (2, 3)):
        turn = (x[:, i] - x[:, 0]) * (y[:, j] - y[:, 0]) - (y[:, i] - y[:, 0]) * (x[:, j] - x[:, 0])
        order = np.where((turn > 0)[:, None], [[0, i, j]], [[0, j, i]])
        yield np.sign(turn), np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1)


def _within(ax, ay, bx, by, shared: bool) -> np.ndarray:
    """Sum over the edges of triangles a of the cross products of their parts inside triangles b; shared: edges that lie on an
    edge of b count."""
    adx, ady, bdx, bdy = (np.roll(v, -1, 1) - v for v in (ax, ay, bx, by))
    low, high = np.zeros_like(ax), np.ones_like(ax)
    for k in range(3):
        hx, hy, hdx, hdy = (v[:, k : k + 1] for v in (bx, by, bdx, bdy))
        num = hdx * (ay - hy) - hdy * (ax - hx)
        den = hdx * ady - hdy * adx
        at = -num / np.where(den == 0, 1.0, den)
        along = hdx * adx + hdy * ady > 0 if shared else False
        away = (den == 0) & ((num < 0) | ((num == 0) & ~np.asarray(along)))
        low = np.where(den > 0, np.maximum(low, at), np.where(away, 2.0, low))
        high = np.where(den < 0, np.minimum(high, at), high)
    return (np.maximum(high - low, 0.0) * (ax * ady - ay * adx)).sum(1)


def clip_areas(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Area that each two rings (rows of 4 corners) share, by signed fans and Green's theorem."""
    x0, y0 = ax[:, :1], ay[:, :1]
    total = np.zeros(len(ax))
    for s, tx, ty in _fans(ax - x0, ay - y0):
        for r, ux, uy in _fans(bx - x0, by - y0):
            total += s * r * (_within(tx, ty, ux, uy, True) + _within(ux, uy, tx, ty, False))
    return np.abs(total) / 2


def ring_areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x - x[:, :1], y - y[:, :1]
    return np.abs(x[:, 1] * y[:, 2] - x[:, 2] * y[:, 1] + x[:, 2] * y[:, 3] - x[:, 3] * y[:, 2]) / 2


def _segments_meet(x: np.ndarray, y: np.ndarray, a: int, b: int, c: int, d: int) -> np.ndarray:
    def side(p, q, r):
        return np.sign((x[:, q] - x[:, p]) * (y[:, r] - y[:, p]) - (y[:, q] - y[:, p]) * (x[:, r] - x[:, p]))

    def between(p, q, r):
        return np.logical_and.reduce([(np.minimum(v[:, p], v[:, q]) <= v[:, r]) & (v[:, r] <= np.maximum(v[:, p], v[:, q])) for v in (x, y)])

    cases = ((a, b, c), (a, b, d), (c, d, a), (c, d, b))
    sides = [side(*k) for k in cases]
    touch = np.logical_or.reduce([(s == 0) & between(*k) for s, k in zip(sides, cases, strict=True)])
    return touch | ((sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0))


def ring_is_valid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As `valid`, of rings given as rows of 4 corners."""
    triangle, twice = ((x == np.roll(x, -1, 1)) & (y == np.roll(y, -1, 1))).any(1), 2 * ring_areas(x, y)
    wide = twice > np.ptp(x, axis=1) * np.ptp(y, axis=1) * FLAT
    simple = ~_segments_meet(x, y, 0, 1, 2, 3) & ~_segments_meet(x, y, 1, 2, 3, 0)
    return np.where(triangle, wide, (twice != 0) & simple)


def ious(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Intersection over union of each two rings; 0 if a ring is not valid or there is no union, or the value is below least and
    that shows in the overlap of the boxes already."""
    side = lambda v, w: np.maximum(np.minimum(v.max(1), w.max(1)) - np.maximum(v.min(1), w.min(1)), 0)
    sizes = ring_areas(ax, ay) + ring_areas(bx, by)
    some = np.flatnonzero((side(ax, bx) * side(ay, by) * (1 + least) * (1 + 1e-9) >= least * sizes) & ring_is_valid(ax, ay) & ring_is_valid(bx, by))
    out = np.zeros(len(ax))
    common = clip_areas(ax[some], ay[some], bx[some], by[some])
    union = sizes[some] - common
    out[some] = np.where(union > 0, common / np.where(union > 0, union, 1), 0)
    return out


def _pairwise(of):
    """A function of two ring columns, from one of their coordinates; null where one is null. It is computed once for each row,
    wherever it is named."""

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in pairs:
            some = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
            out = np.zeros(len(a))
            if some.any():
                rings = [v.filter(pa.array(some)).flatten() for v in (a, b)]
                out[some] = of(*(np.asarray(v.field(k), dtype=np.float64).reshape(-1, 4) for v in rings for k in ("lon", "lat")))
            yield pa.array(out, mask=~some)

    return F.arrow_udf(run, "double").asNondeterministic()


def intersection_area(a: Column, b: Column) -> Column:
    """Area that two simple rings share."""
    return _pairwise(clip_areas)(a, b)


def iou(a: Column, b: Column, least: float = 0.0) -> Column:
    """Intersection over union; 0 if a ring is not valid or there is no union. Values below `least` may come as 0."""
    return _pairwise(lambda *rings: ious(*rings, least))(a, b)


def size_km(corners: Column) -> Column:
    """struct(width_km, height_km, sq_km_area) from the first three corners of UL, UR, LR, LL; the area rounded half-even."""
    ul, ur, ll = corners[0], corners[1], corners[3]
    width = haversine_km(ul["lat"], ul["lon"], ur["lat"], ur["lon"])
    height = haversine_km(ul["lat"], ul["lon"], ll["lat"], ll["lon"])
    return F.struct(width.alias("width_km"), height.alias("height_km"), F.bround(width * height, 0).cast("long").alias("sq_km_area"))


def pixel_to_latlon(corners: Column, u: Column, v: Column, height: Column, width: Column) -> Column:
    """Bilinear between BL, TL, TR, BR; pixel (0, 0) is TL. One-pixel sides divide by 1."""
    fx, fy = u / F.greatest(width - 1, F.lit(1)), v / F.greatest(height - 1, F.lit(1))
    bl, tl, tr, br = (corners[i] for i in range(4))
    mix = lambda k: (tl[k] * (1 - fx) + tr[k] * fx) * (1 - fy) + (bl[k] * (1 - fx) + br[k] * fx) * fy
    return F.struct(mix("lat").alias("lat"), mix("lon").alias("lon"))


def corner_pixels(height: Column, width: Column) -> Column:
    """Corners of an image as pixels, in order (0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)."""
    zero, right, low = F.lit(0.0), (width - 1).cast("double"), (height - 1).cast("double")
    return F.array(*(F.struct(x.alias("u"), y.alias("v")) for x, y in ((zero, zero), (right, zero), (right, low), (zero, low))))


def project(homography: Column, u: Column, v: Column) -> Column:
    """Perspective transform by a row-major 3 x 3 matrix: struct(u, v)."""
    h = [homography[i] for i in range(9)]
    w = h[6] * u + h[7] * v + h[8]
    return F.struct(((h[0] * u + h[1] * v + h[2]) / w).alias("u"), ((h[3] * u + h[4] * v + h[5]) / w).alias("v"))


def reprojection_inlier(homography: Column, qu: Column, qv: Column, tu: Column, tv: Column, most: float = 3.0) -> Column:
    p = project(homography, qu, qv)
    return F.sqrt((p["u"] - tu) * (p["u"] - tu) + (p["v"] - tv) * (p["v"] - tv)) <= most
