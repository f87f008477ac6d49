"""Column expressions on coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 equatorial radius in metres, eccentricity squared, and metres in a degree of the sphere used for spans.
RADIUS, ECC2 = 6378137.0, 0.00669437999014
METRES_PER_DEGREE = 111319.49079327357


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on the ellipsoid's radii at their mean latitude; 0 for equal coordinates. Longitudes
    aren't wrapped at the date line. Null if any coordinate is."""
    mean = F.radians((lat1 + lat2) / 2)
    base = F.sqrt(1 - ECC2 * F.pow(F.sin(mean), 2))
    north = RADIUS * (1 - ECC2) / F.pow(base, 3) * F.radians(lat2 - lat1)
    east = RADIUS / base * F.cos(mean) * F.radians(lon2 - lon1)
    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(F.sqrt(north * north + east * east))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360, of the great circle from the first point to the second."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def turn(first: Column, second: Column) -> Column:
    """Degrees between two bearings, 0 to 180."""
    d = F.abs(first - second)
    return F.when(d > 180, 360 - d).otherwise(d)


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
