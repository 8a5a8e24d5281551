"""Web Mercator (EPSG:3857, sphere of 6378137 m) as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
#: Half the side of the square that holds the projected world.
WORLD = math.pi * RADIUS


def mercator_x(lon: Column) -> Column:
    """Easting of a longitude in degrees."""
    return F.radians(lon) * F.lit(RADIUS)


def mercator_y(lat: Column) -> Column:
    """Northing of a latitude in degrees; NULL at and beyond the poles, which the projection does not reach."""
    return F.when((lat > -90) & (lat < 90), F.lit(RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)))


def lon_of(x: Column) -> Column:
    """Longitude in degrees of an easting."""
    return F.degrees(x / F.lit(RADIUS))


def lat_of(y: Column) -> Column:
    """Latitude in degrees of a northing."""
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(RADIUS))) - F.lit(math.pi / 2))
