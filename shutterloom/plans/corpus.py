"""Queries of the general operators over the catalogue tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.operators import hierarchy, spatial
from shutterloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.resolve(table(spark, d, "people"), "id", "merged_into_id")
    return found.where("linked").select("id", "root_id", "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.paths(table(spark, d, "people"), "id", "merged_into_id")
    return found.select("id", "root_id", "depth", F.array_join("path", ">").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "people"), "id", "merged_into_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cities = table(spark, d, "cities")
    near = spatial.near_pairs(cities, "city_id", "latitude", "longitude", 3.0)
    held = spatial.in_regions(cities, "city_id", "latitude", "longitude", table(spark, d, "countries"), "code", "bbox")
    return near.select(F.col("id_a").alias("city_id"), F.col("id_b").cast("string").alias("other_key")).unionByName(
        held.select(F.col("id").alias("city_id"), F.col("key").alias("other_key"))
    )


def p5_spots(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs between positions only, each by its smallest city: with the members of positions, the whole result."""
    _, met = spatial.near_spots(table(spark, d, "cities"), "city_id", "latitude", "longitude", 3.0)
    return met.where("pos_a <> pos_b").select(F.col("pos_a").alias("spot_a"), F.col("pos_b").alias("spot_b")).distinct()


_TREE = """
WITH RECURSIVE named AS (SELECT id, min(merged_into_id) AS parent FROM people WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT a.id, b.id AS parent, a.parent IS NOT NULL AS linked FROM named a LEFT JOIN named b ON a.parent = b.id),
down AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(id AS VARCHAR) AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, d.root_id, d.depth + 1, d.path || '>' || CAST(l.id AS VARCHAR) FROM links l JOIN down d ON l.parent = d.id),
stuck AS (SELECT id, parent FROM links WHERE id NOT IN (SELECT id FROM down)),
climb AS (SELECT id, parent AS here, 1 AS k FROM stuck
  UNION ALL SELECT c.id, s.parent, c.k + 1 FROM climb c JOIN stuck s ON c.here = s.id WHERE c.k < 2 * (SELECT count(*) FROM stuck) + 1),
loops AS (SELECT id, min(here) AS root_id FROM climb WHERE k > (SELECT count(*) FROM stuck) GROUP BY id),
solved AS (SELECT id, root_id, depth, path FROM down UNION ALL SELECT id, root_id, -1, NULL FROM loops)
"""

_KM = (
    "2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.la - a.la) / 2), 2)"
    " + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2))))"
)

QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p5_found": p5_found, "p5_spots": p5_spots}

SQL = {
    "p3_found": _TREE + "SELECT s.id, s.root_id, s.depth FROM solved s JOIN links l ON s.id = l.id WHERE l.linked",
    "p3_paths": _TREE + "SELECT id, root_id, depth, path FROM solved",
    "p3_descendants": _TREE
    + """, pairs AS (SELECT id AS ancestor_id, id AS descendant_id, CAST(0 AS BIGINT) AS distance FROM down
  UNION ALL SELECT p.ancestor_id, l.id, p.distance + 1 FROM pairs p JOIN links l ON l.parent = p.descendant_id)
SELECT ancestor_id, descendant_id, distance FROM pairs WHERE distance > 0""",
    "p5_spots": f"""
WITH c AS (SELECT latitude AS la, longitude AS lo, min(city_id) AS id FROM cities WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude) GROUP BY 1, 2)
SELECT DISTINCT a.id AS spot_a, b.id AS spot_b FROM c a JOIN c b ON a.id < b.id AND b.la BETWEEN a.la - 0.03 AND a.la + 0.03 WHERE {_KM} <= 3.0""",
    "p5_found": f"""
WITH c AS (SELECT DISTINCT city_id AS id, latitude AS la, longitude AS lo FROM cities
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude))
SELECT DISTINCT a.id AS city_id, CAST(b.id AS VARCHAR) AS other_key FROM c a JOIN c b
  ON a.id < b.id AND b.la BETWEEN a.la - 0.03 AND a.la + 0.03 WHERE {_KM} <= 3.0
UNION ALL SELECT DISTINCT c.id, k.code FROM c JOIN countries k ON c.la BETWEEN k.bbox[2] AND k.bbox[4]
  AND CASE WHEN k.bbox[1] <= k.bbox[3] THEN c.lo BETWEEN k.bbox[1] AND k.bbox[3] ELSE c.lo >= k.bbox[1] OR c.lo <= k.bbox[3] END
  WHERE k.code IS NOT NULL""",
}
