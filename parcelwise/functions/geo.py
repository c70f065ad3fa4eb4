"""Great-circle distance, ring centroids and the planar-to-geographic projection as column maths."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_MILES = 3959.0
MILES_PER_DEGREE = 69.0


def _when_known(value: Column, *inputs: Column) -> Column:
    """``least`` and ``greatest`` pass over nulls, so a missing coordinate is tested for explicitly."""
    known = inputs[0].isNotNull()
    for c in inputs[1:]:
        known = known & c.isNotNull()
    return F.when(known, value)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, haversine form (exact for nearby points)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((p2 - p1) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    miles = F.lit(EARTH_MILES) * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))
    return _when_known(miles, lat1, lon1, lat2, lon2)


def cosine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, law-of-cosines form with the cosine held inside -1..1."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    cosine = F.cos(p1) * F.cos(p2) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(p1) * F.sin(p2)
    miles = F.lit(EARTH_MILES) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    return _when_known(miles, lat1, lon1, lat2, lon2)


def has_location(lat: Column, lon: Column) -> Column:
    """Coordinates are present when both are non-null and non-zero."""
    return F.coalesce((lat != 0) & (lon != 0), F.lit(False))


def bounding_box(lat: Column, lon: Column, at_lat: Column, at_lon: Column, miles: Column) -> Column:
    """Whether (lat, lon) lies in the box of half-width ``miles`` around (at_lat, at_lon)."""
    d_lat = miles / F.lit(MILES_PER_DEGREE)
    d_lon = miles / (F.lit(MILES_PER_DEGREE) * F.cos(F.radians(at_lat)))
    return lat.between(at_lat - d_lat, at_lat + d_lat) & lon.between(at_lon - d_lon, at_lon + d_lon)


def _with_ring_sums(df: DataFrame, ring: str) -> DataFrame:
    """Add ``_pts``, the ring shifted to its first point, and ``_sums``: shoelace weight, its moments, sums of points.

    Each step is a column of its own: the arrays are walked once, whatever refers to the result.
    """
    origin = F.element_at(F.col(ring), 1)
    shifted = F.transform(
        ring, lambda p: F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y"))
    )
    pts = F.col("_pts")
    following = F.concat(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    edges = F.zip_with(
        pts,
        following,
        lambda a, b: F.struct(
            (a["x"] * b["y"] - b["x"] * a["y"]).alias("w"),
            (a["x"] + b["x"]).alias("sx"),
            (a["y"] + b["y"]).alias("sy"),
            a["x"].alias("x"),
            a["y"].alias("y"),
        ),
    )
    zero = F.lit(0.0)
    sums = F.aggregate(
        edges,
        F.struct(*[zero.alias(n) for n in ("w", "mx", "my", "x", "y")]),
        lambda acc, e: F.struct(
            (acc["w"] + e["w"]).alias("w"),
            (acc["mx"] + e["w"] * e["sx"]).alias("mx"),
            (acc["my"] + e["w"] * e["sy"]).alias("my"),
            (acc["x"] + e["x"]).alias("x"),
            (acc["y"] + e["y"]).alias("y"),
        ),
    )
    return df.withColumn("_pts", F.when(F.size(ring) > 0, shifted)).withColumn("_sums", sums)


def with_ring_centroid(df: DataFrame, ring: str, out: str = "centroid") -> DataFrame:
    """Add the area centroid of a closed or open ring ``array<struct<x,y>>`` as ``struct<x,y>``.

    The ring is shifted to its first point before summing, so large planar coordinates keep their
    digits. A ring without area (a point, a line) falls back to the mean of its points.
    """
    origin = F.element_at(F.col(ring), 1)
    m, n = F.col("_sums"), F.size("_pts")
    # The shoelace weights add up to twice the area.
    cx = F.when(m["w"] != 0, m["mx"] / (3 * m["w"])).otherwise(m["x"] / n)
    cy = F.when(m["w"] != 0, m["my"] / (3 * m["w"])).otherwise(m["y"] / n)
    return (
        _with_ring_sums(df, ring)
        .withColumn(
            out,
            F.when(
                F.col("_sums").isNotNull(),
                F.struct((cx + origin["x"]).alias("x"), (cy + origin["y"]).alias("y")),
            ),
        )
        .drop("_pts", "_sums")
    )


def parcel_centroids(rings: DataFrame, keys: Sequence[str], ring: str = "ring", hole: str | None = None, out: str = "centroid") -> DataFrame:
    """The area centroid of every parcel of several rings, one row of ``rings`` per ring: ``keys`` and ``out``.

    Areas and moments are signed and add up, so a ring that runs the other way round is a hole and takes its area off, as the
    shape format has it; with ``hole``, a boolean column, that says it and directions do not matter. The sums are combined map-side, so
    a parcel of a million rings is one row of each task. Parcels without area have the mean of their points; rings without
    points add nothing, and a parcel of nothing else has a null centroid.
    """
    origin, m = F.element_at(F.col(ring), 1), F.col("_sums")
    sign = F.lit(1.0)
    if hole is not None:
        turn = F.when(m["w"] < 0, -1.0).otherwise(1.0)
        sign = F.when(F.coalesce(hole, F.lit(False)), -turn).otherwise(turn)
    n = F.size("_pts")
    parts = {
        "w": sign * m["w"],
        "mx": sign * (m["mx"] / 3 + m["w"] * origin["x"]),
        "my": sign * (m["my"] / 3 + m["w"] * origin["y"]),
        "x": m["x"] + n * origin["x"],
        "y": m["y"] + n * origin["y"],
        "n": n,
    }
    have = F.size(ring) > 0
    summed = _with_ring_sums(rings, ring).groupBy(*keys).agg(*[F.sum(F.when(have, c)).alias(f"_{name}") for name, c in parts.items()])
    at = lambda m, p: F.when(F.col("_w") != 0, F.col(m) / F.col("_w")).otherwise(F.col(p) / F.col("_n"))
    centre = F.struct(at("_mx", "_x").alias("x"), at("_my", "_y").alias("y"))
    return summed.select(*keys, F.when(F.col("_n") > 0, centre).alias(out))



# Published parameters of EPSG:2277 (NAD83 / Texas Central, US survey feet).
TEXAS_CENTRAL = {
    "semi_major_m": 6378137.0,
    "inverse_flattening": 298.257222101,
    "lat_origin": 29.0 + 40.0 / 60.0,
    "lon_origin": -(100.0 + 20.0 / 60.0),
    "parallel_1": 31.0 + 53.0 / 60.0,
    "parallel_2": 30.0 + 7.0 / 60.0,
    "false_easting_m": 700000.0,
    "false_northing_m": 3000000.0,
    "metres_per_unit": 1200.0 / 3937.0,
}
# Published parameters of EPSG:2278 (NAD83 / Texas South Central, US survey feet).
TEXAS_SOUTH_CENTRAL = TEXAS_CENTRAL | {
    "lat_origin": 27.0 + 50.0 / 60.0,
    "lon_origin": -99.0,
    "parallel_1": 30.0 + 17.0 / 60.0,
    "parallel_2": 28.0 + 23.0 / 60.0,
    "false_easting_m": 600000.0,
    "false_northing_m": 4000000.0,
}
#: The systems a parcel table may name; None: the rings are in degrees already.
SYSTEMS = {"EPSG:2277": TEXAS_CENTRAL, "EPSG:2278": TEXAS_SOUTH_CENTRAL, "EPSG:4326": None}


def lambert_to_wgs84(x: Column, y: Column, crs: dict[str, float]) -> Column:
    """Inverse Lambert conformal conic (two parallels): planar ``x, y`` to ``struct<lat,lon>``.

    The cone constants are scalars folded on the driver; the latitude series is evaluated as
    column maths with a fixed number of refinements.
    """
    a, flat = crs["semi_major_m"], 1.0 / crs["inverse_flattening"]
    ecc = math.sqrt(2 * flat - flat * flat)

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (ecc * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        es = ecc * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (ecc / 2)

    p0, p1, p2 = (math.radians(crs[k]) for k in ("lat_origin", "parallel_1", "parallel_2"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big_f = m(p1) / (n * t(p1) ** n)
    rho0 = a * big_f * t(p0) ** n

    east = x * F.lit(crs["metres_per_unit"]) - F.lit(crs["false_easting_m"])
    north = F.lit(rho0) - (y * F.lit(crs["metres_per_unit"]) - F.lit(crs["false_northing_m"]))
    rho = F.sqrt(east * east + north * north)
    ratio = F.pow(rho / F.lit(a * big_f), F.lit(1.0 / n))
    conformal = F.lit(math.pi / 2) - 2 * F.atan(ratio)

    # Geodetic latitude as a sine series of the conformal latitude (Snyder 1987, eq. 3-5).
    e2 = ecc * ecc
    e4, e6, e8 = e2 * e2, e2**3, e2**4
    lat = (
        conformal
        + F.lit(e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * conformal)
        + F.lit(7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * conformal)
        + F.lit(7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * conformal)
        + F.lit(4279 * e8 / 161280) * F.sin(8 * conformal)
    )
    lon = F.atan2(east, north) / F.lit(n) + F.lit(math.radians(crs["lon_origin"]))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))
