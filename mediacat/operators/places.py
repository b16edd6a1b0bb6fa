"""Joins by place: radius search and the cache of known places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.geo import EARTH_KM, geo_key, haversine_km
from mediacat.storage import partitions, stored


def within_radius(centers: DataFrame, points: DataFrame, radius_km: float = 10.0) -> DataFrame:
    """(center_id, point_id, distance_km, confidence): points (id, lat, lon) within the radius of each center, confidence 1 - d/r.

    Both sides fall into bands of one radius in latitude, and cells of one radius in longitude at the band's wider side; a
    center looks into the cells around it, across 180 degrees, and into whole bands near the poles. Distances are found once for each pair
    of different places, whatever number of rows lies there.
    """
    step = math.degrees(radius_km / EARTH_KM)
    bands = math.ceil(180 / step)
    band = lambda lat: F.least(F.floor((lat + 90) / step), F.lit(bands - 1)).cast("int")

    def cells(b: Column) -> Column:
        """How many cells a band has: one if it lies within two steps of a pole."""
        edge = F.greatest(F.abs(b * step - 90), F.abs((b + 1) * step - 90))
        return F.when(edge + 2 * step >= 90, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / step))).cast("int")

    cell = lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n), n).cast("int")
    at_point = points.where("lat is not null and lon is not null").select(F.col("id").alias("point_id"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    p = at_point.select("plat", "plon").distinct().withColumn("band", band(F.col("plat")))
    p = p.withColumn("cell", cell(F.col("plon"), cells(F.col("band"))))
    at_center = centers.where("lat is not null and lon is not null").select(F.col("id").alias("center_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    c = at_center.select("clat", "clon").distinct()
    c = c.withColumn("band", F.explode(F.sequence(F.greatest(band(F.col("clat")) - 1, F.lit(0)), F.least(band(F.col("clat")) + 1, F.lit(bands - 1))))).withColumn("n", cells(F.col("band")))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("clon"), F.col("n")) + d, F.col("n"))))
    c = c.withColumn("cell", F.explode(around))
    d = haversine_km(F.col("clat"), F.col("clon"), F.col("plat"), F.col("plon"))
    near = c.join(p, ["band", "cell"]).withColumn("distance_km", d).where(F.col("distance_km") <= radius_km)
    near = near.select("clat", "clon", "plat", "plon", F.round("distance_km", 6).alias("distance_km"), F.round(1 - F.col("distance_km") / radius_km, 6).alias("confidence"))
    near = stored(near, "near-places").repartition(partitions(points.sparkSession))  # a few pairs of places may stand for very many rows
    return near.join(at_center, ["clat", "clon"]).join(at_point, ["plat", "plon"]).select("center_id", "point_id", "distance_km", "confidence")


def lookup_places(points: DataFrame, cache: DataFrame, as_of: Column, ttl_days: int = 7) -> DataFrame:
    """points (id, lat, lon) with the name of a cached place of the same rounded coordinates, if it is younger than the limit; the newest counts."""
    fresh = cache.where(F.col("timestamp") > as_of - F.make_dt_interval(F.lit(ttl_days)))
    known = fresh.groupBy(geo_key(F.col("latitude"), F.col("longitude")).alias("key")).agg(F.max_by("name", "timestamp").alias("place"))
    return points.withColumn("key", geo_key(F.col("lat"), F.col("lon"))).join(known, "key", "left")
