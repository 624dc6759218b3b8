"""Points on lines and polygons: radius search, linear references, and what follows from them.

Searches are grid joins: cells as large as the radius make an equality join of points with the nine
cells around each, so no pair that is further apart than two cells ever meets.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..network import Network, given_back, hy, need
from ..plans.iterate import cut
from .navigation import rescaled


def near(points: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows within the radius, with _d, by a grid: points (px, py, ..) and places (vx, vy, ..)."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct((cell("px") + i).alias("cx"), (cell("py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    probes = points.withColumn("_cell", around)
    grid = places.withColumn("_gx", cell("vx")).withColumn("_gy", cell("vy"))
    d = F.sqrt((F.col("px") - F.col("vx")) * (F.col("px") - F.col("vx")) + (F.col("py") - F.col("vy")) * (F.col("py") - F.col("vy")))
    joined = probes.join(grid, (F.col("_cell.cx") == F.col("_gx")) & (F.col("_cell.cy") == F.col("_gy"))).withColumn("_d", d)
    return joined.filter(F.col("_d") <= radius).drop("_cell", "_gx", "_gy")


def _vertices(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row a vertex of each line: keys, _k, vx, vy."""
    return df.select(*keys, F.posexplode("geom").alias("_k", "_v")).select(*keys, "_k", F.col("_v.x").alias("vx"), F.col("_v.y").alias("vy"))


def _measured(vertices: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Vertices with id_measure: 100 at the first vertex of the line, falling with length to 0 at the last."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.coalesce(F.sqrt(F.pow(F.col("vx") - F.lag("vx").over(w), 2) + F.pow(F.col("vy") - F.lag("vy").over(w), 2)), F.lit(0.0))
    run = vertices.withColumn("_step", step).withColumn("_len", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.max("_len").over(Window.partitionBy(*by))
    return run.withColumn("id_measure", F.lit(100.0) - F.when(top > 0, F.lit(100.0) * F.col("_len") / top).otherwise(0.0)).drop("_step")


def add_measures(x: DataFrame | Network) -> Network | DataFrame:
    """aggregate_id_from_measure and aggregate_id_to_measure of each feature along its aggregate, upstream at 100."""
    from .topology import add_topo_sort

    net = hy(x)
    need(net, ["id", "aggregate_id", "geom"], "add_measures")
    full = net
    if not net.has("toid"):
        found = hy(make_attribute_topology(net, 1e-4)).df.select("id", "toid").distinct()
        full = net.with_df(net.df.join(found, "id", "left"))
    order = add_topo_sort(full.with_df(full.df.select("id", "toid").distinct())).df.select(F.col("id").alias("_id"), F.col("topo_sort").alias("_order")).distinct()
    lines = net.df.join(order, F.col("id") == F.col("_id"))
    vertices = _vertices(lines, ["id", "aggregate_id", "_order"]).withColumn("_up", -F.col("_order"))
    measured = _measured(vertices, ["aggregate_id"], ["_up", "_k"])
    spans = measured.groupBy(F.col("id").alias("_m")).agg(F.min("id_measure").alias("aggregate_id_from_measure"), F.max("id_measure").alias("aggregate_id_to_measure"))
    out = net.df.drop("aggregate_id_from_measure", "aggregate_id_to_measure").join(spans, F.col("id") == F.col("_m"), "left").drop("_m")
    return given_back(x, net.with_df(out))


# Radius by default in degrees and in metres, and units of length in metres.
DEFAULT_DEGREES, DEFAULT_METRES = 0.01, 200.0
METRES = {"m": 1.0, "km": 1000.0, "cm": 0.01, "ft": 0.3048, "mi": 1609.344}


def search_radius_of(radius: float | tuple[float, str] | None, crs: int | None) -> float:
    """A radius in the units of a reference system: degrees in EPSG 4326, else metres.

    A number has these units; (number, unit) is turned into metres; by default it is 0.01 degrees or 200 metres.
    """
    degrees = crs == 4326
    if radius is None:
        return DEFAULT_DEGREES if degrees else DEFAULT_METRES
    value, unit = radius if isinstance(radius, tuple) else (radius, None)
    if unit is not None:
        if (unit in ("degree", "degrees")) != degrees or not (degrees or unit in METRES):
            raise ValueError(f"a radius in {unit} doesn't fit the reference system")
        value = value if degrees else value * METRES[unit]
    if degrees and value > 1:
        warnings.warn("the search radius is large for degrees", stacklevel=3)
    return float(value)


def _placed(points: DataFrame, points_crs: int | None, crs: int | None) -> DataFrame:
    """points with x and y in the other table's reference system."""
    if points_crs is None or crs is None or points_crs == crs:
        return points
    warnings.warn("points are taken to the other table's reference system", stacklevel=3)
    moved = points.withColumn("_at", g.reprojected(F.array(g.point("x", "y")), points_crs, crs)[0])
    return moved.withColumn("x", F.col("_at.x")).withColumn("y", F.col("_at.y")).drop("_at")


def index_points_to_lines(
    x: DataFrame | Network, points: DataFrame, search_radius: float | tuple[float, str] | None = None, precision: float | None = None, max_matches: int = 1,
    ids: str | None = None, crs: int | None = None, points_crs: int | None = None,
) -> DataFrame:
    """point_id, id, [aggregate_id, aggregate_id_measure,] offset: the nearest lines of each point within the radius.

    points has point_id, x and y. A line counts by its nearest vertex; precision adds vertices first.
    ids names a column of points that forces the line. Points without a line in reach give no row. crs and points_crs
    name the reference systems (4326, 5070), which tell the radius's units and where points belong.
    """
    net = hy(x)
    need(net, ["id", "geom"], "index_points_to_lines")
    search_radius, points = search_radius_of(search_radius, crs), _placed(points, points_crs, crs)
    lines = net.df.withColumn("geom", g.densified("geom", precision)) if precision else net.df
    own = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), *([F.col(ids).alias("_want")] if ids else []))
    vertices = _measured(_vertices(lines.select("id", "geom"), ["id"]), ["id"], ["_k"]).select("id", "_k", "vx", "vy", "id_measure")
    pairs = near(own, vertices, search_radius)
    if ids:
        pairs = pairs.filter(F.col("_want") == F.col("id"))
    best = F.row_number().over(Window.partitionBy("point_id", "id").orderBy("_d", "_k"))
    per_line = pairs.withColumn("_rn", best).filter("_rn = 1")
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("_d", "id"))
    kept = per_line.withColumn("_rank", rank).filter(F.col("_rank") <= (1 if ids else max_matches))
    if not net.has("aggregate_id", "aggregate_id_from_measure", "aggregate_id_to_measure"):
        return kept.select("point_id", "id", F.col("_d").alias("offset"))
    facts = net.df.select(F.col("id").alias("_i"), "aggregate_id", "aggregate_id_from_measure", "aggregate_id_to_measure").distinct()
    joined = kept.join(facts, F.col("id") == F.col("_i"), "left")
    a, b = F.col("aggregate_id_from_measure"), F.col("aggregate_id_to_measure")
    measure = F.round(a + (b - a) * F.col("id_measure") / 100, 4)
    return joined.select("point_id", "id", "aggregate_id", measure.alias("aggregate_id_measure"), F.col("_d").alias("offset"))


def index_points_to_waterbodies(
    waterbodies: DataFrame, points: DataFrame, search_radius: float | tuple[float, str] | None = None, flowlines: DataFrame | Network | None = None,
    crs: int | None = None, points_crs: int | None = None,
) -> DataFrame:
    """One row a point: near_wbid and near_wb_dist (nearest boundary vertex), in_wbid (polygon around it) and,
    with flowlines (id, wbid, topo_sort), wb_outlet_id, the outlet feature of the waterbody.

    waterbodies has wbid and geom (rings), points point_id, x and y; radius and reference systems are as for lines.
    """
    search_radius, points = search_radius_of(search_radius, crs), _placed(points, points_crs, crs)
    own = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"))
    rings = waterbodies.select("wbid", "geom").hint("merge")  # a file's size tells little of what its corners and boxes take
    vertices = rings.select("wbid", F.explode(F.flatten("geom")).alias("_v")).select("wbid", F.col("_v.x").alias("vx"), F.col("_v.y").alias("vy"))
    closest = near(own, vertices, search_radius).groupBy(F.col("point_id").alias("_p")).agg(F.min(F.struct("_d", "wbid")).alias("_n"))
    # Containment: polygons and points meet in grid cells. A polygon lies in the grid whose cells are as large as its box,
    # to the next power of two, so it touches four cells at most, and points look into each grid that has polygons.
    boxed = rings.select(
        "wbid", "geom", *[F.expr(f"array_{k}(transform(element_at(geom, 1), p -> p.{axis}))").alias(f"{k}_{axis}") for k in ("min", "max") for axis in ("x", "y")]
    )
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1e-9))
    boxed = boxed.withColumn("_grid", F.ceil(F.log2(side)).cast("int"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_grid")))
    cells = boxed.withColumn("_cx", F.explode(F.sequence(cell("min_x"), cell("max_x")))).withColumn("_cy", F.explode(F.sequence(cell("min_y"), cell("max_y"))))
    grids = [r["_grid"] for r in boxed.select("_grid").filter("_grid is not null").distinct().collect()]  # as many as doubles have powers, at most
    probes = own.withColumn("_grid", F.explode(F.array(*[F.lit(k) for k in grids]).cast("array<int>"))).withColumn("_px", cell("px")).withColumn("_py", cell("py"))
    probes = probes.withColumnRenamed("_grid", "_g")
    inside = probes.join(cells, (F.col("_g") == F.col("_grid")) & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")))
    inside = inside.filter(F.col("px").between(F.col("min_x"), F.col("max_x")) & F.col("py").between(F.col("min_y"), F.col("max_y")) & g.in_polygon(g.point("px", "py"), "geom"))
    within = inside.groupBy(F.col("point_id").alias("_q")).agg(F.min("wbid").alias("in_wbid"))
    out = own.join(closest, F.col("point_id") == F.col("_p"), "left").join(within, F.col("point_id") == F.col("_q"), "left")
    out = out.select("point_id", F.col("_n.wbid").alias("near_wbid"), F.col("_n._d").alias("near_wb_dist"), "in_wbid")
    if flowlines is None:
        return out
    lines = hy(flowlines).df.filter("wbid is not null").groupBy(F.col("wbid").alias("_w")).agg(F.min_by("id", "topo_sort").alias("wb_outlet_id"))
    return out.join(lines, F.coalesce("in_wbid", "near_wbid") == F.col("_w"), "left").drop("_w")


def disambiguate_indexes(indexes: DataFrame, flowpath: DataFrame, hydro_location: DataFrame) -> DataFrame:
    """For each point the matches whose line's metric is closest to the point's: numbers by difference, texts by
    edit distance in proportion to the longer. Ties stay; pairs without a metric don't count."""
    from pyspark.sql.types import NumericType, StringType

    own = hy(indexes).df
    if len(flowpath.columns) != 2 or len(hydro_location.columns) != 2:
        raise ValueError("flowpath and hydro_location need two columns each")
    kinds = [df.schema[1].dataType for df in (flowpath, hydro_location)]
    f = flowpath.toDF("_id", "_fp")
    h = hydro_location.toDF("_point", "_hl")
    joined = own.join(f, F.col("id") == F.col("_id"), "left").join(h, F.col("point_id") == F.col("_point"), "left")
    if all(isinstance(k, NumericType) for k in kinds):
        score = -F.abs(F.col("_fp") - F.col("_hl"))
    elif all(isinstance(k, StringType) for k in kinds):
        longest = F.greatest(F.length("_fp"), F.length("_hl"))
        score = F.when(longest > 0, (longest - F.levenshtein(F.lower("_fp"), F.lower("_hl"))) / longest).otherwise(1.0)
    else:
        raise ValueError("both metrics must be numbers or both texts")
    scored = joined.withColumn("_score", score)
    best = F.max("_score").over(Window.partitionBy("point_id"))
    return scored.withColumn("_best", best).filter(F.col("_score") == F.col("_best")).select(own.columns)


def get_hydro_location(indexes: DataFrame, flowpath: DataFrame | Network) -> DataFrame:
    """indexes with geom_x and geom_y: the place of each measure along its line, by interpolation."""
    net = hy(flowpath)
    need(net, ["id", "aggregate_id_from_measure", "aggregate_id_to_measure", "geom"], "get_hydro_location")
    vertices = _measured(_vertices(net.df.select("id", "geom"), ["id"]), ["id"], ["_k"])
    w = Window.partitionBy("id").orderBy("_k")
    spans = vertices.select(
        F.col("id").alias("_i"), F.col("_k"), F.col("vx").alias("_ux"), F.col("vy").alias("_uy"), F.col("id_measure").alias("_hi"),
        F.lead("vx").over(w).alias("_dx"), F.lead("vy").over(w).alias("_dy"), F.lead("id_measure").over(w).alias("_lo"),
    ).filter("_lo is not null")
    facts = net.df.select(F.col("id").alias("_f"), "aggregate_id_from_measure", "aggregate_id_to_measure").distinct()
    own = indexes.select("point_id", "id", "aggregate_id_measure").join(facts, F.col("id") == F.col("_f"))
    own = own.withColumn("_m", rescaled("aggregate_id_measure", "aggregate_id_from_measure", "aggregate_id_to_measure"))
    hit = own.join(spans, (F.col("id") == F.col("_i")) & F.col("_m").between(F.col("_lo"), F.col("_hi")))
    one = hit.withColumn("_rn", F.row_number().over(Window.partitionBy("point_id", "id", "aggregate_id_measure").orderBy(F.col("_k").desc()))).filter("_rn = 1")
    part = F.when(F.col("_hi") > F.col("_lo"), (F.col("_m") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return one.select("point_id", "id", "aggregate_id_measure", (F.col("_dx") + part * (F.col("_ux") - F.col("_dx"))).alias("geom_x"), (F.col("_dy") + part * (F.col("_uy") - F.col("_dy"))).alias("geom_y"))


def make_attribute_topology(x: DataFrame | Network, min_distance: float) -> Network | DataFrame:
    """id and toid from lines: the lines whose first vertex is nearest to a line's last one, at most min_distance away.

    All lines at the same least distance count, which makes divergences; lines without one are outlets.
    """
    from ..network import Kind, outlet_value

    net = hy(x)
    need(net, ["id", "geom"], "make_attribute_topology")
    lines = net.df.select("id", g.get_node("geom", "start").alias("_s"), g.get_node("geom", "end").alias("_e"))
    ends = lines.select("id", F.col("_e.x").alias("px"), F.col("_e.y").alias("py"))
    starts = lines.select(F.col("id").alias("toid"), F.col("_s.x").alias("vx"), F.col("_s.y").alias("vy"))
    radius = max(min_distance, 1e-9)
    pairs = near(ends, starts, radius).filter("id <> toid")
    best = F.min("_d").over(Window.partitionBy("id"))
    kept = pairs.withColumn("_best", best).filter("_d = _best").select(F.col("id").alias("_i"), "toid")
    out = net.df.select("id").distinct().join(kept, F.col("id") == F.col("_i"), "left").select("id", F.coalesce("toid", outlet_value(net.df)).alias("toid"))
    return given_back(x, Network(cut(out), Kind.FLOW, net.names))


def fix_flowdir(x: DataFrame | Network) -> DataFrame:
    """Lines turned round where their outlet end doesn't touch the line downstream but their other end does.

    Outlets are held against the lines upstream of them, with their start.
    """
    net = hy(x)
    need(net, ["id", "toid", "geom"], "fix_flowdir")
    own = net.df
    touches = lambda p, line: F.exists(line, lambda v: (v["x"] == p["x"]) & (v["y"] == p["y"]))
    down = own.select(F.col("id").alias("_d"), F.col("geom").alias("_dgeom"))
    joined = own.join(down, F.col("toid") == F.col("_d"), "left")
    up = own.groupBy(F.col("toid").alias("_u")).agg(F.first("geom").alias("_ugeom"))
    joined = joined.join(up, F.col("id") == F.col("_u"), "left")
    right = F.when(F.col("_dgeom").isNotNull(), touches(g.get_node("geom", "end"), F.col("_dgeom"))).when(F.col("_ugeom").isNotNull(), touches(g.get_node("geom", "start"), F.col("_ugeom"))).otherwise(True)
    return joined.withColumn("geom", F.when(right, F.col("geom")).otherwise(F.reverse("geom"))).drop("_d", "_dgeom", "_u", "_ugeom")
