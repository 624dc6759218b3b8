"""Projection, dissolve and repair of polygons."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluvia.functions import geometry as g
from fluvia.functions.overlay import outline
from fluvia.network import hy
from fluvia.operators import indexing
from fluvia.operators.polygons import _area, _polygons, _rings, check_valid, dissolve_polygons
from fluvia.sources.files import read_geojson


def square(x, y, side=1.0):
    x, y = float(x), float(y)
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def polys(spark, rows):
    return spark.createDataFrame(rows, f"grp string, geom {g.POLYGON}")


def test_neighbours_become_one(spark):
    out = dissolve_polygons(polys(spark, [("a", [square(0, 0)]), ("a", [square(1, 0)])]), "grp").collect()
    assert len(out) == 1 and len(out[0]["parts"]) == 1 and len(out[0]["parts"][0]) == 1


def test_holes_by_area(spark):
    ring = [("a", [square(x, y)]) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    holes = lambda **k: [len(p) - 1 for p in dissolve_polygons(polys(spark, ring), "grp", **k).first()["parts"]]
    assert holes() == [0]
    assert holes(max_hole_area=0.0) == [1]
    assert holes(max_hole_area=2.0) == [0]


def test_gap_and_largest_part(spark):
    gap = polys(spark, [("a", [square(0, 0, 1000.0)]), ("a", [square(1000.3, 0, 1000.0)])])
    assert len(dissolve_polygons(gap, "grp").first()["parts"]) == 2
    assert len(dissolve_polygons(gap, "grp", gap_tolerance=1.0).first()["parts"]) == 1
    two = polys(spark, [("a", [square(0, 0)]), ("a", [square(10, 10, 5.0)])])
    out = dissolve_polygons(two, "grp", {"geom": lambda c: F.count(c)}, single_polygon=True)
    assert out.select(g.area(F.col("parts")[0]).alias("a")).first()["a"] == 25.0


def test_repair(spark):
    open_ = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    out = check_valid(polys(spark, [("a", [open_]), ("b", None), ("c", [[(0.0, 0.0), (1.0, 1.0)]])])).collect()
    assert [r["grp"] for r in out] == ["a"] and out[0]["simple"]
    assert len(out[0]["geom"][0]) == 5


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(-89.4, 43.1), (-120.0, 38.0), (-96.0, 23.0)], "x double, y double").select(g.point("x", "y").alias("p"))
    m = df.select("p", g.to_albers(F.col("p")).alias("m")).select("p", "m", g.from_albers(F.col("m")).alias("b")).collect()
    for r in m:
        assert abs(r["p"]["x"] - r["b"]["x"]) < 1e-7 and abs(r["p"]["y"] - r["b"]["y"]) < 1e-7
    assert abs(m[2]["m"]["x"]) < 1e-6 and abs(m[2]["m"]["y"]) < 1e-6


def boxes_edges(boxes):
    out = []
    for x, y, w, h in boxes:
        ring = [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]
        out += [(a, b, 1) for a, b in zip(ring, ring[1:], strict=False)]
    return out


BOXES = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=7)


def covered(boxes):
    cells = {}
    for x, y, w, h in boxes:
        for c in ((i, j) for i in range(x, x + w) for j in range(y, y + h)):
            cells[c] = cells.get(c, 0) + 1
    return cells


@settings(max_examples=200, deadline=None)
@given(BOXES)
def test_outlines_of_overlapping_boxes(boxes):
    """Unions (and places that an odd number of boxes covers) have the area of their unit cells, holes included."""
    for rule, inside in ((lambda w: w > 0, lambda n: True), (lambda w: w % 2 == 1, lambda n: n % 2 == 1)):
        parts = _polygons(_rings(outline(boxes_edges(boxes), rule)), 0.0)
        total = sum(abs(_area(p[0])) - sum(abs(_area(h)) for h in p[1:]) for p in parts)
        assert abs(total - sum(inside(n) for n in covered(boxes).values())) < 1e-6


def test_polygons_that_are_not_noded(spark):
    rows = [("t", [square(0, 0, 2)]), ("t", [square(2, 0)]), ("t", [square(2, 1)])]  # corners in the middle of an edge
    rows += [("o", [square(0, 0, 3)]), ("o", [square(1, 1, 4)]), ("o", [square(1.5, 1.5)])]  # an overlap, and one inside
    rows += [("d", [square(0, 0)]), ("d", [square(0, 0)])]
    out = {r["grp"]: r["parts"] for r in dissolve_polygons(polys(spark, rows), "grp").collect()}
    areas = {k: sum(abs(_area([(p["x"], p["y"]) for p in part[0]])) for part in v) for k, v in out.items()}
    assert areas == {"t": 6.0, "o": 21.0, "d": 1.0} and {k: len(v) for k, v in out.items()} == {"t": 1, "o": 1, "d": 1}


def test_crossing_rings_come_apart(spark):
    eight = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    inner = [square(0, 0, 4), square(1, 1, 2)]
    out = check_valid(polys(spark, [("eight", [eight]), ("hole", inner), ("same", [square(0, 0)])])).select("grp", "part", "simple", g.area("geom").alias("a")).collect()
    assert sorted((r["grp"], r["part"], not r["simple"], round(r["a"], 9)) for r in out) == [("eight", 0, True, 1.0), ("eight", 1, True, 1.0), ("hole", 0, False, 12.0), ("same", 0, False, 1.0)]


def test_large_and_small_waterbodies(spark):
    """Grids by size: one polygon around everything doesn't bring all others into its cell."""
    rows = [(0, [square(-50, -50, 300)])] + [(k, [square(k % 10 * 3, k // 10 * 3)]) for k in range(1, 60)]
    water = spark.createDataFrame(rows, f"wbid long, geom {g.POLYGON}")
    points = spark.createDataFrame([(k, k % 10 * 3 + 0.5, k // 10 * 3 + 0.5) for k in range(1, 60)] + [(99, 200.0, 200.0), (98, 900.0, 0.0)], "point_id long, x double, y double")
    small = indexing.index_points_to_waterbodies(water.filter("wbid > 0"), points, 2.0)
    assert {r["point_id"]: r["in_wbid"] for r in small.collect()} == {k: k for k in range(1, 60)} | {99: None, 98: None}
    every = indexing.index_points_to_waterbodies(water, points, 2.0)
    assert {r["point_id"]: r["in_wbid"] for r in every.collect()} == {k: 0 for k in range(1, 60)} | {99: 0, 98: None}


def test_geojson_of_all_kinds(spark, tmp_path):
    shapes = [
        ("Point", [1, 2]), ("LineString", [[0, 0], [1, 1]]), ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]),
        ("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]]), ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]),
    ]
    features = [{"type": "Feature", "properties": {"id": k}, "geometry": {"type": t, "coordinates": c}} for k, (t, c) in enumerate(shapes)]
    features.append({"type": "Feature", "properties": {"id": 9}, "geometry": None})
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = read_geojson(spark, str(tmp_path / "a.geojson"), "id long").collect()
    kinds = sorted((r["id"], "line" if r["geom"] else "polygon" if r["polygon"] else "point" if r["point"] else "none") for r in rows)
    assert kinds == [(0, "point"), (1, "line"), (2, "line"), (2, "line"), (3, "polygon"), (4, "polygon"), (4, "polygon"), (9, "none")]


def test_radius_units_and_parts(spark):
    assert indexing.search_radius_of(None, 4326) == 0.01 and indexing.search_radius_of(None, 5070) == 200.0
    assert indexing.search_radius_of((2, "km"), 5070) == 2000.0 and indexing.search_radius_of((0.5, "degrees"), 4326) == 0.5
    with pytest.raises(ValueError):
        indexing.search_radius_of((2, "km"), 4326)
    with pytest.warns(UserWarning, match="large"):
        indexing.search_radius_of(2.0, 4326)
    multi = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 5.0), (6.0, 5.0)]]), (2, [[(9.0, 9.0), (9.0, 8.0)]])], f"id long, geom {g.POLYGON}")
    with pytest.warns(UserWarning, match="several parts"):
        single = g.make_singlepart(multi)
    assert sorted(r["id"] for r in single.collect()) == [1, 1, 2]
    with pytest.raises(ValueError):
        g.make_singlepart(multi, stop_on_several=True)
    assert g.make_singlepart(single) is single


def test_points_of_another_reference_system(spark):
    at = spark.createDataFrame([(1, -96.0, 40.0)], "point_id long, x double, y double")
    there = at.select(g.to_albers(g.point("x", "y")).alias("p")).first()["p"]
    line = spark.createDataFrame([(7, [(there["x"] + 50, there["y"]), (there["x"] + 900, there["y"])])], f"id long, geom {g.LINE}")
    with pytest.warns(UserWarning, match="reference system"):
        row = indexing.index_points_to_lines(hy(line), at, crs=5070, points_crs=4326).first()
    assert (row["point_id"], row["id"]) == (1, 7) and abs(row["offset"] - 50) < 1e-6
