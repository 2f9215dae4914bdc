"""File listings, gazetteers, lexicons and the search log."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterloom.functions.predicates import media_kind, partial_digest


def scan(spark: SparkSession, roots: Iterable[str], content: bool = False) -> DataFrame:
    """(root, path, relative, size, mtime_ns, kind[, partial_hash]) of the images under ``roots``; hidden names are left
    out. The listing is Spark's own, so it is spread over the executors; bytes are read only where asked."""
    out = None
    for root in roots:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        bare = F.regexp_replace(F.col("path"), "^file:/+", "/")
        base = root.removeprefix("file://").rstrip("/")
        part = rows.select(
            F.lit(base).alias("root"),
            bare.alias("path"),
            F.substring(bare, len(base) + 2, 1 << 20).alias("relative"),
            F.col("length").alias("size"),
            (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
            media_kind(bare, F.lit(None).cast("string")).alias("kind"),
            *([partial_digest(F.col("content")).alias("partial_hash")] if content else []),
        ).where((F.col("kind") == "image") & ~F.col("relative").rlike(r"(^|/)\."))
        out = part if out is None else out.unionByName(part)
    return out


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(place_id, name, lat, lon, country, admin1) of a tab-separated gazetteer of eleven columns or more; rows without
    readable coordinates are left out."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 11)
    at = lambda i: F.get("c", F.lit(i))
    rows = rows.select(at(0).try_cast("long").alias("place_id"), at(1).alias("name"), at(4).try_cast("double").alias("lat"), at(5).try_cast("double").alias("lon"), at(8).alias("country"), at(10).alias("admin1"))
    return rows.where("place_id is not null and lat between -90 and 90 and lon between -180 and 180")


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(code, ring, points) of the rings of a GeoJSON collection of (multi)polygons; later rings of a part are holes."""
    kind = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j")).select(F.explode("j.features").alias("f"))
    single = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(single)).otherwise(multi)
    code = F.coalesce(F.element_at("f.properties", F.lit("ISO_A2")), F.element_at("f.properties", F.lit("code")))
    return rows.select(code.alias("code"), F.posexplode(parts).alias("part", "rings")).select("code", "part", F.posexplode("rings").alias("ring", "points"))


def lexicon(path: str) -> dict:
    """A vocabulary file, JSON or (where the library is there) YAML; a missing or unreadable one is empty."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError:
                return {}
            return yaml.safe_load(text) or {}
        return json.loads(text)
    except (OSError, ValueError):
        return {}


EVENT = T.StructType([T.StructField("query", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("intent", T.StringType()), T.StructField("result_count", T.LongType()), T.StructField("at", T.TimestampNTZType())])


def log_search(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append search events; queries are cut to 512 characters."""
    df = spark.createDataFrame([(r[0][:512], *r[1:]) for r in rows], EVENT)
    df.write.mode("append").parquet(path)


def sample_per_root(files: DataFrame, n: int) -> DataFrame:
    """At most ``n`` files of each root, each file once."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_root").orderBy("file_id")
    return files.dropDuplicates(["file_id"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
