"""Camera bearings, Earth frames and times as Column expressions.

Earth-fixed to inertial is a rotation by Greenwich mean sidereal time alone: precession, nutation, polar motion and UT1 are
left out. The camera is a pinhole with square pixels and the principal point in the middle of the frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-major axis (m) and flattening; the camera's frame and horizontal field of view.
EQUATOR_M, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY2 = FLATTENING * (2 - FLATTENING)
FRAME_WIDTH, FRAME_HEIGHT, FIELD_DEGREES = 4608, 2592, 66.1
#: Julian date of the Unix epoch, and of 2000-01-01 12:00.
UNIX_JD, J2000_JD = 2440587.5, 2451545.0


def rescale_pixel(u: Column, v: Column, height: Column, width: Column) -> Column:
    return F.struct((u * (F.lit(float(FRAME_WIDTH)) / width)).alias("u"), (v * (F.lit(float(FRAME_HEIGHT)) / height)).alias("v"))


def _vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _unit(x: Column, y: Column, z: Column) -> Column:
    norm = F.sqrt(x * x + y * y + z * z)
    return _vector(x / norm, y / norm, z / norm)


def pixel_bearing(u: Column, v: Column, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT, field: float = FIELD_DEGREES) -> Column:
    """Unit vector of a frame pixel: x right, y down, z ahead."""
    focal = width / 2 / math.tan(math.radians(field) / 2)
    return _unit((u - width / 2) / focal, (v - height / 2) / focal, F.lit(1.0))


def latlon_to_ecef(lat: Column, lon: Column, height: Column | float = 0.0) -> Column:
    h = height if isinstance(height, Column) else F.lit(height)
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(EQUATOR_M) / F.sqrt(1 - s * s * ECCENTRICITY2)
    return _vector((n + h) * c * F.cos(F.radians(lon)), (n + h) * c * F.sin(F.radians(lon)), (n * (1 - ECCENTRICITY2) + h) * s)


def epoch_jd(timestamp: Column) -> Column:
    """Julian date of midnight of a timestamp that begins with YYYYMMDD."""
    return F.unix_date(F.to_date(F.substring(timestamp, 1, 8), "yyyyMMdd")).cast("double") + UNIX_JD


def gmst(jd: Column) -> Column:
    """Greenwich mean sidereal time in radians, to first order in the date."""
    turns = F.lit(280.46061837) + (jd - J2000_JD) * 360.98564736629
    return F.radians(turns - F.floor(turns / 360) * 360)


def _rotate(v: Column, angle: Column) -> Column:
    return _vector(v["x"] * F.cos(angle) - v["y"] * F.sin(angle), v["x"] * F.sin(angle) + v["y"] * F.cos(angle), v["z"])


def ecef_to_eci(v: Column, jd: Column) -> Column:
    return _rotate(v, gmst(jd))


def eci_to_ecef(v: Column, jd: Column) -> Column:
    return _rotate(v, -gmst(jd))


def ecef_to_geodetic(v: Column, rounds: int = 5) -> Column:
    """struct(lat, lon) by a fixed number of Bowring steps on the reduced latitude. The steps carry what they need in their state,
    so `v` is worked out once for each row, not in each step."""
    polar = EQUATOR_M * (1 - FLATTENING)
    second = ECCENTRICITY2 / (1 - ECCENTRICITY2)

    def step(state: Column, _: Column) -> Column:
        s, c = F.sin(state["beta"]), F.cos(state["beta"])
        up, out = state["z"] + s * s * s * (second * polar), state["p"] - c * c * c * (ECCENTRICITY2 * EQUATOR_M)
        return F.struct(
            state["z"].alias("z"), state["p"].alias("p"), F.atan2(up, out).alias("lat"), F.atan2(up * (1 - FLATTENING), out).alias("beta"),
        )

    def solved(w: Column) -> Column:
        p = F.sqrt(w["x"] * w["x"] + w["y"] * w["y"])
        start = F.struct(w["z"].alias("z"), p.alias("p"), F.lit(0.0).alias("lat"), F.atan2(w["z"] * EQUATOR_M, p * polar).alias("beta"))
        lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["lat"])
        return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(w["y"], w["x"])).alias("lon"))

    return F.transform(F.array(v), solved)[0]


def nadir_eci(lat: Column, lon: Column, altitude_m: Column, jd: Column) -> Column:
    """Point above a ground point: the direction of its Earth-fixed vector, at the equatorial radius and the altitude."""
    v = latlon_to_ecef(lat, lon)
    norm = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    far = (altitude_m + EQUATOR_M) / norm
    return ecef_to_eci(_vector(v["x"] * far, v["y"] * far, v["z"] * far), jd)


def line_of_sight(landmark: Column, position: Column) -> Column:
    return _unit(landmark["x"] - position["x"], landmark["y"] - position["y"], landmark["z"] - position["z"])


def angular_error(a: Column, b: Column) -> Column:
    """Angle between unit vectors from the length of their difference."""
    d = (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d / 2)))


def altitude_m(position: Column) -> Column:
    return F.sqrt(position["x"] * position["x"] + position["y"] * position["y"] + position["z"] * position["z"]) - EQUATOR_M


def angular_noise(error: Column, distance: Column) -> Column:
    return F.atan(error / distance)
