"""Coordinates and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def dms_to_decimal(dms: Column, ref: Column) -> Column:
    """[degrees, minutes, seconds] and a hemisphere; south and west are negative; null unless there are three parts."""
    value = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60 + F.get(dms, F.lit(2)) / 3600
    return F.when(F.size(dms) == 3, F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value))


def geo_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f,%.4f", lat, lon)


def formatted_address(display_name: Column, address: Column, city: Column, state: Column, country: Column) -> Column:
    """The display name, else the parts that exist, joined by commas."""
    part = lambda *keys: F.coalesce(*(F.element_at(address, k) for k in keys))
    some = lambda *xs: F.array_join(F.filter(F.array(*xs), lambda x: x.isNotNull() & (x != "")), ", ")
    from_map = some(part("road"), part("suburb"), part("city", "town", "village"), part("state"), part("country"))
    return F.when(display_name != "", display_name).otherwise(F.when(F.size(address) > 0, from_map).otherwise(some(city, state, country)))


def short_location(city: Column, country: Column, name: Column, lat: Column, lon: Column) -> Column:
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(has(city) & has(country), F.concat_ws(", ", city, country)).when(has(country), country).when(has(name), name).otherwise(F.format_string("%.4f, %.4f", lat, lon))
