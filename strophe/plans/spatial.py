"""Queries of problem 6: points near other points or regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.functions.text import is_missing
from strophe.operators.spatial import inside_regions, near_keys


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Measured sites within 0.5 km of each other, and the shape that contains a site without province."""
    rec = spark.read.parquet(f"{d}/recordings.parquet").where("geo_level = 'site'").select("item_id", "lon", "lat", "province")
    shapes = spark.read.parquet(f"{d}/province_shapes.parquet")
    near = near_keys(rec, "item_id", "lon", "lat", 0.5).select(F.lit("near").alias("kind"), "key_a", "key_b")
    inside = inside_regions(rec.where(is_missing("province")), "item_id", "lon", "lat", shapes, "adcode")
    return near.unionAll(inside.select(F.lit("inside").alias("kind"), F.col("key").alias("key_a"), F.col("adcode").alias("key_b")))


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": """
    WITH s AS (SELECT DISTINCT item_id, lon, lat, province FROM recordings
               WHERE geo_level = 'site' AND lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)
                 AND abs(lon) <= 180 AND abs(lat) <= 90 AND NOT (lon = 0 AND lat = 0)),
    near AS (SELECT DISTINCT 'near' AS kind, a.item_id AS key_a, b.item_id AS key_b FROM s a JOIN s b ON a.item_id < b.item_id
             WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
                   + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 0.5),
    e AS (SELECT adcode, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2
          FROM province_shapes WINDOW w AS (PARTITION BY adcode, ring ORDER BY seq)),
    ins AS (SELECT 'inside' AS kind, s.item_id AS key_a, e.adcode AS key_b
            FROM (SELECT DISTINCT item_id, lon, lat FROM s WHERE province IS NULL OR province IN ('', 'NA', 'nan', 'None')) s
            JOIN e ON e.x2 IS NOT NULL AND (e.y1 > s.lat) <> (e.y2 > s.lat)
              AND s.lon < (e.x2 - e.x1) * (s.lat - e.y1) / (e.y2 - e.y1) + e.x1
            GROUP BY s.item_id, s.lon, s.lat, e.adcode HAVING count(*) % 2 = 1)
    SELECT * FROM near UNION ALL SELECT * FROM ins""",
}
