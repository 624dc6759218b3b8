"""Planar geometry as column expressions: points are struct<x,y>, lines arrays of points, polygons arrays of rings.

A ring is closed (its first point is its last); the first ring of a polygon is its outer one. All
functions stay inside the JVM.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def get_node(line: Column | str, position: str = "end") -> Column:
    """The first (start) or last (end) vertex of a line."""
    return F.element_at(_c(line), 1 if position == "start" else -1)


def segments(line: Column | str) -> Column:
    """Array of (a, b) segments of a line or ring."""
    line = _c(line)
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.arrays_zip(F.slice(line, 1, n).alias("a"), F.slice(line, 2, n).alias("b"))


def length(line: Column | str) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, e: s + distance(e["a"], e["b"]))


def ring_area(ring: Column | str) -> Column:
    """Signed area of a ring; positive counterclockwise."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(polygon: Column | str) -> Column:
    """Area of the outer ring without the others."""
    rings = _c(polygon)
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s - F.abs(ring_area(r))) + 2 * F.abs(ring_area(F.element_at(rings, 1)))


def in_ring(p: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by the parity of crossings of a ray to the right."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"])
        return straddles & (p["x"] < at)

    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def in_polygon(p: Column, polygon: Column | str) -> Column:
    return F.size(F.filter(_c(polygon), lambda r: in_ring(p, r))) % 2 == 1


def densified(line: Column | str, most: float) -> Column:
    """The line with points added so that no segment is longer than `most`."""

    def pieces(e: Column) -> Column:
        n = F.greatest(F.ceil(distance(e["a"], e["b"]) / most).cast("int"), F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), n - 1), lambda k: point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * k / n, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * k / n)
        )

    line = _c(line)
    return F.concat(F.flatten(F.transform(segments(line), pieces)), F.array(F.element_at(line, -1)))


# The GRS 80 ellipsoid and the parameters of the conterminous US Albers projection (EPSG:5070).
_A, _F = 6378137.0, 1 / 298.257222101
_LAT0, _LON0, _LAT1, _LAT2 = (math.radians(d) for d in (23.0, -96.0, 29.5, 45.5))
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


def _q(lat: float) -> float:
    s = math.sin(lat)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


_N = (_m(_LAT1) ** 2 - _m(_LAT2) ** 2) / (_q(_LAT2) - _q(_LAT1))
_C = _m(_LAT1) ** 2 + _N * _q(_LAT1)
_RHO0 = _A * math.sqrt(_C - _N * _q(_LAT0)) / _N


def to_albers(p: Column) -> Column:
    """A longitude and latitude in degrees as metres in EPSG:5070."""
    s = F.sin(F.radians(p["y"]))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho, theta = _A * F.sqrt(_C - _N * q) / _N, _N * (F.radians(p["x"]) - _LON0)
    return point(rho * F.sin(theta), _RHO0 - rho * F.cos(theta))


def from_albers(p: Column) -> Column:
    """Metres in EPSG:5070 as longitude and latitude in degrees (series for the authalic latitude)."""
    dy = _RHO0 - p["y"]
    rho = F.sqrt(p["x"] * p["x"] + dy * dy)
    q = (_C - rho * rho * _N * _N / (_A * _A)) / _N
    beta = F.asin(q / _q(math.pi / 2))
    e4, e6 = _E2**2, _E2**3
    lat = (
        beta
        + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
        + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    return point(F.degrees(_LON0 + F.atan2(p["x"], dy) / _N), F.degrees(lat))


def reprojected(line: Column | str, source: int, target: int) -> Column:
    """A line's vertices from one reference system to the other; 4326 and 5070 are known."""
    if source == target:
        return _c(line)
    if {source, target} != {4326, 5070}:
        raise ValueError("only EPSG 4326 and 5070 are known")
    return F.transform(_c(line), to_albers if target == 5070 else from_albers)


def make_singlepart(df: DataFrame, geometry: str = "geom", stop_on_several: bool = False) -> DataFrame:
    """Rows of lines of rows of multi-part lines (arrays of lines): one row a part, with a warning if there are several of one.

    Columns of lines are given back as they are. With stop_on_several, rows with several parts are an error.
    """
    if not df.schema[geometry].dataType.simpleString().startswith("array<array"):
        return df
    if not df.filter(F.size(geometry) > 1).isEmpty():
        if stop_on_several:
            raise ValueError("geometries of several parts aren't supported here")
        warnings.warn("geometries of several parts become a row for each", stacklevel=2)
    return df.withColumn(geometry, F.explode_outer(geometry))


def rename_geometry(df: DataFrame, name: str, old: str = "geom") -> DataFrame:
    return df.withColumnRenamed(old, name)


def st_compatibalize(df: DataFrame, source: int, target: int, geometry: str = "geom", target_name: str = "geom") -> DataFrame:
    """df's lines in the target system, under the target's geometry name."""
    return df.withColumn(geometry, reprojected(geometry, source, target)).withColumnRenamed(geometry, target_name)


def rescale_measures(measure: float, from_: float, to: float) -> float:
    """One measure of an aggregate feature as 0 to 100 of the feature between from_ and to, with 0.1 to spare."""
    if not from_ <= measure <= to:
        if from_ > measure and round(from_ - measure, 1) <= 0.1:
            measure = from_
        elif measure > to and round(measure - to, 1) <= 0.1:
            measure = to
        else:
            raise ValueError("the measure must lie between from and to")
    return 100 * (measure - from_) / (to - from_)
