"""Network files as DataFrames: GeoJSON, CSV with its types given, and Parquet; all read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON collections: the properties, by a schema such as "id long, toid long", and their geometry.

    geom has lines (arrays of points), polygon polygons (arrays of rings) and point points. A MultiLineString or
    MultiPolygon gives a row for each of its parts. A feature without geometry has nulls; other kinds are an error.
    """
    shape = f"features array<struct<properties:struct<{', '.join(p.strip().replace(' ', ':', 1) for p in properties.split(','))}>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(shape).option("multiLine", True).json(path)
    rows = raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("_t"), F.col("f.geometry.coordinates").alias("_c"))
    line = lambda ps: F.transform(ps, lambda p: g.point(p[0], p[1]))
    rings = lambda rs: F.transform(rs, line)
    parsed = lambda depth: F.from_json("_c", "array<" * depth + "double" + ">" * depth)
    kind = F.col("_t")
    lines = F.when(kind == "LineString", F.array(line(parsed(2)))).when(kind == "MultiLineString", rings(parsed(3)))
    polygons = F.when(kind == "Polygon", F.array(rings(parsed(3)))).when(kind == "MultiPolygon", F.transform(parsed(4), rings))
    known = ("Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
    rows = rows.withColumn("_t", F.when(kind.isNull() | kind.isin(*known), kind).otherwise(F.raise_error(F.concat(F.lit("no reader for geometry of the kind "), kind))))
    parts = F.when(kind.isin("LineString", "MultiLineString"), F.transform(lines, lambda x: F.struct(x.alias("geom"), F.lit(None).cast(g.POLYGON).alias("polygon"))))
    parts = parts.when(kind.isin("Polygon", "MultiPolygon"), F.transform(polygons, lambda x: F.struct(F.lit(None).cast(g.LINE).alias("geom"), x.alias("polygon"))))
    at = parsed(1)
    rows = rows.withColumn("point", F.when(kind == "Point", g.point(at[0], at[1])))
    return rows.withColumn("_p", F.explode_outer(parts)).select("*", "_p.geom", "_p.polygon").drop("_t", "_c", "_p")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
