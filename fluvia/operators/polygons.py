"""Polygon unions, and repair of polygons.

Polygons of a coverage share their edges. Directed edges whose opposite another polygon of the group has cancel
out, which is an aggregation over all edges; cancelling changes no winding number. Only what is left, a
group's outline and the edges of overlaps, meets in one task: there it is split where it crosses, what
other polygons cover is left out, and the rest is joined to rings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.overlay import Edge, noded, outline


def _directed(rings: Column) -> Column:
    """Outer rings counterclockwise, holes clockwise."""
    return F.transform(rings, lambda r, k: F.when((g.ring_area(r) > 0) == (k == 0), r).otherwise(F.reverse(r)))


def dissolve_polygons(
    polys: DataFrame, group_id: str, fns: dict[str, Callable[[str], Column]] | None = None, max_hole_area: float = math.inf,
    gap_tolerance: float = 0.0, single_polygon: bool = False, crs: int | None = None, work_crs: int | None = None,
) -> DataFrame:
    """One row a group: the union as parts (array of polygons), without holes smaller than max_hole_area.

    polys has group_id and geom (rings; parts of a multipolygon as rows). fns makes columns: name to a
    function of the column. gap_tolerance snaps vertices to a grid of that size, which closes gaps up to
    half of it. single_polygon keeps the largest part. Polygons may overlap, touch in the middle of an edge or lie
    in one another; each must be valid by itself (check_valid). With work_crs, geometry comes in crs and areas,
    tolerances and the result are in work_crs (4326 and 5070).
    """
    if work_crs is not None and crs is not None:
        polys = polys.withColumn("geom", F.transform("geom", lambda r: g.reprojected(r, crs, work_crs)))
    rings = polys.select(F.col(group_id).alias("_g"), F.explode(_directed(F.col("geom"))).alias("_r"))
    edges = rings.select("_g", F.explode(g.segments("_r")).alias("_e")).select("_g", *[F.col(f"_e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    if gap_tolerance:
        snapped = {c: F.round(F.col(c) / gap_tolerance) * gap_tolerance for c in ("ax", "ay", "bx", "by")}
        edges = edges.withColumns(snapped)
    edges = edges.filter("ax <> bx or ay <> by")
    # Both directions of an edge meet under one key; what is left has one direction.
    forward = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    keyed = edges.select("_g", *[F.when(forward, F.col(f"a{c}")).otherwise(F.col(f"b{c}")).alias(f"p{c}") for c in "xy"], *[F.when(forward, F.col(f"b{c}")).otherwise(F.col(f"a{c}")).alias(f"q{c}") for c in "xy"], F.when(forward, 1).otherwise(-1).alias("way"))
    left = keyed.groupBy("_g", "px", "py", "qx", "qy").agg(F.sum("way").alias("way")).filter("way <> 0")
    kind = polys.schema[group_id].dataType.simpleString()

    def stitched(rows: pd.DataFrame) -> pd.DataFrame:
        edges = [((px, py), (qx, qy), int(way)) for px, py, qx, qy, way in rows[["px", "py", "qx", "qy", "way"]].itertuples(index=False)]
        parts = _polygons(_rings(outline(edges)), max_hole_area)
        if single_polygon and parts:
            parts = [max(parts, key=lambda p: abs(_area(p[0])) - sum(abs(_area(h)) for h in p[1:]))]
        shaped = [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]
        return pd.DataFrame({"_g": [rows["_g"].iloc[0]], "parts": [shaped]})

    unions = left.groupBy("_g").applyInPandas(stitched, f"_g {kind}, parts array<{g.POLYGON}>")
    out = unions.withColumnRenamed("_g", group_id)
    if fns:
        facts = polys.groupBy(F.col(group_id).alias("_f")).agg(*[fn(c).alias(c) for c, fn in fns.items()])
        out = out.join(facts, F.col(group_id) == F.col("_f"), "left").drop("_f")
    return out


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _rings(edges: list[Edge]) -> list[list[tuple[float, float]]]:
    """Directed edges joined to rings; at a vertex with several ways on, the sharpest turn left closes the smaller ring."""
    onward: dict[tuple, list[tuple]] = {}
    for a, b, _ in edges:
        onward.setdefault(a, []).append(b)
    out = []
    for start in sorted(onward):
        while onward[start]:
            ring, at = [start], onward[start].pop()
            before = start
            while at != start:
                ring.append(at)
                ways = onward[at]
                if len(ways) > 1:
                    back = math.atan2(before[1] - at[1], before[0] - at[0])
                    ways.sort(key=lambda p: -((back - math.atan2(p[1] - at[1], p[0] - at[0])) % (2 * math.pi)))
                before, at = at, ways.pop()
            out.append([*ring, start])
    return out


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


def _polygons(rings: list, max_hole_area: float) -> list:
    """Counterclockwise rings are parts, others holes of the smallest part around them."""
    parts = [[r] for r in rings if _area(r) > 0]
    for hole in (r for r in rings if _area(r) < 0):
        if abs(_area(hole)) < max_hole_area:
            continue
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        around = [p for p in parts if _inside(middle, p[0])]
        if around:
            min(around, key=lambda p: _area(p[0])).append(hole)
    return parts


def check_valid(df: DataFrame, source: int | None = None, target: int | None = None) -> DataFrame:
    """Lines or rings in order: rows without geometry go, repeated vertices and empty or flat rings too,
    rings are closed and directed, and coordinates reprojected (4326, 5070).

    Polygons whose rings cross, overlap or touch themselves or each other are taken apart: what an odd number of rings is
    around is inside. One of several parts gives a row for each, with its number in `part`; `simple`
    says which were whole as they came.
    """
    kind = df.schema["geom"].dataType.simpleString()
    step = lambda line: F.aggregate(line, F.slice(line, 1, 0), lambda s, p: F.when((F.size(s) > 0) & (F.element_at(s, -1) == p), s).otherwise(F.concat(s, F.array(p))))
    move = (lambda line: g.reprojected(line, source, target)) if source and target else (lambda line: line)
    out = df.filter("geom is not null and size(geom) > 0")
    if not kind.startswith("array<array"):
        return out.withColumn("geom", move(step(F.col("geom")))).filter("size(geom) > 1")
    closed = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    turn = lambda a, b, p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    flat = lambda r: F.forall(r, lambda p: turn(F.element_at(r, 1), F.element_at(r, 2), p) == 0)
    rings = F.transform(F.filter("geom", lambda r: F.size(r) > 2), lambda r: closed(step(r)))
    out = out.withColumn("geom", F.filter(rings, lambda r: (F.size(r) > 3) & ~flat(r))).filter("size(geom) > 0")
    # A file of many rows may be one task's, and taking apart is the work.
    out = out.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    own = out.withColumn("_parts", F.pandas_udf(_taken_apart, "array<array<array<array<double>>>>")(F.transform("geom", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))))
    own = own.withColumn("simple", F.col("_parts").isNull())
    parts = F.transform("_parts", lambda polygon: F.transform(polygon, lambda r: F.transform(r, lambda p: g.point(p[0], p[1]))))
    own = own.select(*[c for c in own.columns if c not in ("geom", "_parts")], F.posexplode(F.coalesce(parts, F.array(F.col("geom")))).alias("part", "geom"))
    own = own.select(*[c for c in df.columns if c != "geom"], "geom", "part", "simple")
    return own.withColumn("geom", F.transform(_directed(F.col("geom")), move))


def _taken_apart(geoms: pd.Series) -> pd.Series:
    """The parts of each polygon whose rings meet themselves or each other; null for those that are as they should be."""
    out = []
    for rings in geoms:
        points = [[(float(p[0]), float(p[1])) for p in ring] for ring in rings]
        edges = [(a, b, 1) for ring in points for a, b in zip(ring, ring[1:], strict=False)]
        if len({a for a, _, _ in edges}) == len(edges) and len(noded(edges)) == len(edges):
            out.append(None)
            continue
        parts = _polygons(_rings(outline(edges, lambda w: w % 2 == 1)), 0.0)
        out.append([[[[x, y] for x, y in ring] for ring in part] for part in parts])
    return pd.Series(out, dtype=object)
