"""Coordinates: validation, rounding, distance and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .numbers import is_finite, round_half_up

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine_m(lat1, lng1, lat2, lng2) / 1000.0


def round6(c: Column) -> Column:
    return round_half_up(c * 1_000_000.0) / 1_000_000.0


def _decimals(c: Column) -> Column:
    """Digits after the point in the number's shortest form."""
    plain = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.length(F.regexp_extract(plain, r"\.(\d*)$", 1))


def check_coordinates(lat: Column, lng: Column) -> Column:
    """Struct: is_valid, latitude, longitude, precision, errors."""
    missing = lat.isNull() | lng.isNull()
    not_number = F.isnan(lat) | F.isnan(lng)
    errors = (
        F.when(missing, F.array(F.lit("Missing coordinate values")))
        .when(not_number, F.array(F.lit("Coordinates are not valid numbers")))
        .otherwise(F.array_compact(F.array(
            F.when((lat < -90) | (lat > 90), F.lit("Latitude must be between -90 and 90")),
            F.when((lng < -180) | (lng > 180), F.lit("Longitude must be between -180 and 180")),
            F.when((lat == 0) & (lng == 0), F.lit("Coordinates (0,0) are likely invalid")),
        )))
    )
    valid = F.size(errors) == 0
    digits = F.greatest(_decimals(lat), _decimals(lng))
    precision = (
        F.when(digits >= 5, "exact").when(digits >= 3, "approximate")
        .when(digits >= 1, "city").otherwise("region")
    )
    return F.struct(
        valid.alias("is_valid"),
        F.when(valid, round6(lat)).alias("latitude"),
        F.when(valid, round6(lng)).alias("longitude"),
        F.when(valid, precision).alias("precision"),
        errors.alias("errors"),
    )


def has_coordinates(lat: Column, lng: Column) -> Column:
    return is_finite(lat) & is_finite(lng)


def grid_edge(distance_m: float) -> float:
    """Cell edge for a threshold, a little larger so that rounding at a border loses nothing."""
    return distance_m * 1.001


def grid_cell(lat: Column, lng: Column, edge: float) -> Column:
    """The 3-D cell holding a point of the sphere. A straight line is no longer than
    the arc, so points within ``edge`` metres lie in the same or adjoining cells;
    poles and the antimeridian need no special care."""
    phi, lam = F.radians(lat), F.radians(lng)
    scale = EARTH_M / edge
    return F.struct(
        F.floor(F.cos(phi) * F.cos(lam) * scale).cast("bigint").alias("x"),
        F.floor(F.cos(phi) * F.sin(lam) * scale).cast("bigint").alias("y"),
        F.floor(F.sin(phi) * scale).cast("bigint").alias("z"),
    )


def unit_vector(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lng)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_limit(distance_m: float) -> float:
    """The longest straight line between unit vectors of points within ``distance_m``, a little longer so that rounding loses nothing."""
    return 2 * math.sin(min(distance_m / EARTH_M, math.pi) / 2) + 1e-9


def cells_around(cell: Column, edge: float, reach: int = 1) -> Column:
    """The cell and the cells up to ``reach`` away, less those the earth's surface misses."""
    radius, n = EARTH_M / edge, 2 * reach + 1

    def near(v: Column) -> Column:  # smallest |coordinate| in [v, v+1]
        return F.greatest(v, -v - 1, F.lit(0)).cast("double")

    def far(v: Column) -> Column:
        return F.greatest(F.abs(v), F.abs(v + 1)).cast("double")

    def touches(c: Column) -> Column:
        low = near(c["x"]) * near(c["x"]) + near(c["y"]) * near(c["y"]) + near(c["z"]) * near(c["z"])
        high = far(c["x"]) * far(c["x"]) + far(c["y"]) * far(c["y"]) + far(c["z"]) * far(c["z"])
        # the slack covers rounding of the squares
        return (low <= radius * radius * (1 + 1e-9)) & (high >= radius * radius * (1 - 1e-9))

    steps = F.array(*[
        F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z"))
        for i in range(-reach, n - reach) for j in range(-reach, n - reach) for k in range(-reach, n - reach)
    ])
    around = F.transform(steps, lambda s: F.struct(
        (cell["x"] + s["x"]).alias("x"), (cell["y"] + s["y"]).alias("y"), (cell["z"] + s["z"]).alias("z"),
    ))
    return F.filter(around, touches)
