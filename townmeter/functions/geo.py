"""Great-circle geometry on column pairs of latitude and longitude, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth, and kilometres per degree that the search box uses.
EARTH_KM, DEGREE_KM = 6371.0088, 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((b - a) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def destination(lat: Column, lon: Column, km: Column, bearing: Column) -> tuple[Column, Column]:
    """(lat, lon) reached from a point after km along the great circle of a bearing in degrees."""
    d, a, t = km / F.lit(EARTH_KM), F.radians(lat), F.radians(bearing)
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def in_bbox(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, km: Column, pad: float = 0.0) -> Column:
    """Whether a point lies in the box around a centre: km / 111.32 degrees of latitude, as many of longitude over the cosine.

    That box cuts off up to 0.3 % of the circle; pad=0.01 makes it contain the circle for
    distances up to 500 km between the polar circles.
    """
    d_lat = km * (1 + pad) / F.lit(DEGREE_KM)
    d_lon = d_lat / F.greatest(F.cos(F.radians(centre_lat)), F.lit(1e-9))
    return lat.between(centre_lat - d_lat, centre_lat + d_lat) & lon.between(centre_lon - d_lon, centre_lon + d_lon)
