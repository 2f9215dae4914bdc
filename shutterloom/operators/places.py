"""Reverse geocoding: the nearest place within a limit, the regions around it, and tags from both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.operators.spatial import in_regions, nearest_other, valid_points


def nearest_place(points: DataFrame, places: DataFrame, km: float = 90.0) -> DataFrame:
    """(id, place_id, km) of the nearest place within ``km``; ties go to the smaller place id.

    points: (id, lat, lon), places: (place_id, lat, lon). Distinct positions ask the k-d index, in growing radii."""
    best = nearest_other(points, places.select(F.col("place_id").alias("key"), "lat", "lon"), km)
    return points.join(best, ["lat", "lon"]).select("id", F.col("key").alias("place_id"), "km")


def place_names(points: DataFrame, cities: DataFrame, regions: DataFrame, km: float = 90.0) -> DataFrame:
    """(id, name, how): the name of the nearest city within ``km``, else of the region around a point, else null: each source
    is asked in turn. cities: (place_id, name, lat, lon), regions: (code, bbox); of several regions the first code counts."""
    near = nearest_place(points, cities, km).join(cities.groupBy("place_id").agg(F.min("name").alias("city")), "place_id").select("id", "city")
    # positions have numbers here, so that points at one place are looked up once
    at = points.select("lat", "lon").distinct().withColumn("spot", F.xxhash64("lat", "lon"))
    held = in_regions(at, "spot", "lat", "lon", regions, "code", "bbox").groupBy("id").agg(F.min("key").alias("region")).withColumnRenamed("id", "spot")
    rows = points.join(near, "id", "left").join(at, ["lat", "lon"]).join(held, "spot", "left")
    how = F.when(F.col("city").isNotNull(), "city").when(F.col("region").isNotNull(), "region").otherwise("none")
    return rows.select("id", F.coalesce("city", "region").alias("name"), how.alias("how"))


def gps(files: DataFrame) -> DataFrame:
    """(file_id, lat, lon) read from the files' JSON; impossible coordinates are left out."""
    at = F.from_json("metadata_json", "gps struct<latitude: double, longitude: double>")
    rows = files.select("file_id", at.alias("j")).select("file_id", F.col("j.gps.latitude").alias("lat"), F.col("j.gps.longitude").alias("lon"))
    return rows.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def geo_tags(located: DataFrame) -> DataFrame:
    """(file_id, tag_type, tag_value): the coordinate to three and to seven places."""
    at = lambda shape: F.concat_ws(",", *[F.call_function("format_number", F.col(c), F.lit(shape)) for c in ("lat", "lon")])
    values = F.array(
        F.struct(F.lit("geo").alias("tag_type"), at("0.000").alias("tag_value")),
        F.struct(F.lit("geo_detail").alias("tag_type"), at("0.0000000").alias("tag_value")),
    )
    return located.select("file_id", F.inline(values))


def places_of(cities: DataFrame) -> DataFrame:
    return valid_points(cities, "city_id", "latitude", "longitude").select(F.col("id").alias("place_id"), "lat", "lon")
