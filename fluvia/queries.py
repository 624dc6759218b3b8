"""The network operators over networks derived from the standard tables, with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .network import Network, capabilities, get_geometry, hy, hy_reverse, is_dendritic, is_hy, network_type, outlets_of, put_geometry, without_geometry
from .operators import attributes, indexing, navigation, polygons, topology
from .plans.iterate import checkpoint_dir
from .schema import alias_names, align_names, name_definitions
from .sources.files import read_csv, read_geojson

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A tree: each part flows to that of half its number.
TREE_SQL = """tree AS (
  SELECT p_partkey + 1 AS id, (p_partkey + 1) // 2 AS toid, CAST(p_size AS DOUBLE) AS length_km, p_retailprice AS da_sqkm,
         p_brand AS name, p_type AS feature_type
  FROM part
)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") + 1
    return _table(spark, sf_dir, "part").select(
        key.alias("id"), F.floor(key / 2).alias("toid"), F.col("p_size").cast("double").alias("length_km"),
        F.col("p_retailprice").alias("da_sqkm"), F.col("p_brand").alias("name"), F.col("p_type").alias("feature_type"),
    )


# The same with a diversion at every seventh part, between nodes.
NODES_SQL = TREE_SQL + """, nodes AS (
  SELECT id, id AS fromnode, id // 2 AS tonode, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS divergence, length_km, da_sqkm, name, feature_type
  FROM tree
  UNION ALL
  SELECT id + 1000000, id, id // 3, 2, length_km, da_sqkm, NULL, feature_type FROM tree WHERE id % 7 = 0
), flow AS (
  SELECT a.id, coalesce(b.id, 0) AS toid, a.divergence, a.length_km, a.da_sqkm, b.divergence AS to_divergence
  FROM nodes a LEFT JOIN nodes b ON a.tonode = b.fromnode
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = tree(spark, sf_dir).drop("toid")
    own = main.select(
        "id", F.col("id").alias("fromnode"), F.floor(F.col("id") / 2).alias("tonode"), F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("divergence"),
        "length_km", "da_sqkm", "name", "feature_type",
    )
    minor = main.filter("id % 7 = 0").select(
        (F.col("id") + 1000000).alias("id"), F.col("id").alias("fromnode"), F.floor(F.col("id") / 3).alias("tonode"), F.lit(2).alias("divergence"),
        "length_km", "da_sqkm", F.lit(None).cast("string").alias("name"), "feature_type",
    )
    return own.union(minor)


# Orders of a customer as a chain in order of time: many networks.
FOREST_SQL = """forest AS (
  SELECT o_orderkey + 1 AS id, coalesce(lead(o_orderkey + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS toid,
         o_totalprice AS da_sqkm
  FROM orders
)"""


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = F.col("o_orderkey") + 1
    return _table(spark, sf_dir, "orders").select(key.alias("id"), F.coalesce(F.lead(key).over(w), F.lit(0)).alias("toid"), F.col("o_totalprice").alias("da_sqkm"))


def leveled(spark: SparkSession, sf_dir: str) -> Network:
    """The tree with topo_sort (its id turned round), path lengths and main paths by name and drainage area."""
    net = attributes.accumulate_downstream(hy(tree(spark, sf_dir)), "da_sqkm")
    net = net.with_df(net.df.withColumnRenamed("da_sqkm_accumulated", "total_da_sqkm").withColumn("topo_sort", F.col("id")))
    return attributes.add_levelpaths(net, "name", "total_da_sqkm")


# Main paths of the tree: of two features upstream, by name, then (rounded) accumulated area, then id.
ACC_SQL = """up(id, anc) AS (
  SELECT id, id FROM tree
  UNION ALL
  SELECT up.id, t.toid FROM up JOIN tree t ON up.anc = t.id WHERE t.toid > 0
), acc AS (
  SELECT anc AS id, sum(da_sqkm) AS total_da_sqkm, sum(length_km) AS arbolate_sum FROM up JOIN tree USING (id) GROUP BY anc
)"""
PATH_SQL = "WITH RECURSIVE " + TREE_SQL + ", " + ACC_SQL + """, ranked AS (
  SELECT t.id, t.toid, row_number() OVER (PARTITION BY t.toid ORDER BY CASE WHEN t.name = d.name THEN 1 ELSE 2 END, a.total_da_sqkm DESC, t.id) AS rn
  FROM tree t JOIN acc a USING (id) LEFT JOIN tree d ON t.toid = d.id
), walk(id, levelpath) AS (
  SELECT id, id FROM ranked WHERE rn > 1 OR toid = 0
  UNION ALL
  SELECT r.id, w.levelpath FROM walk w JOIN ranked r ON r.toid = w.id AND r.rn = 1
), pathlen(id, below) AS (
  SELECT id, CAST(0 AS DOUBLE) FROM tree WHERE toid = 0
  UNION ALL
  SELECT t.id, p.below + d.length_km FROM pathlen p JOIN tree t ON t.toid = p.id JOIN tree d ON d.id = p.id
), net AS (
  SELECT t.*, w.levelpath, w.levelpath AS levelpath_outlet_id, t.id AS topo_sort, p.below AS pathlength_km, a.total_da_sqkm,
         coalesce(d.levelpath, 0) AS dn_levelpath, t.toid AS dn_topo_sort
  FROM tree t JOIN walk w USING (id) JOIN pathlen p USING (id) JOIN acc a USING (id) LEFT JOIN walk d ON t.toid = d.id
)
"""


def navigable(spark: SparkSession, sf_dir: str) -> Network:
    net = attributes.add_pathlength(leveled(spark, sf_dir))
    below = net.df.select(F.col("id").alias("_d"), F.col("levelpath").alias("dn_levelpath"), F.col("topo_sort").alias("dn_topo_sort"))
    df = net.df.join(below, F.col("toid") == F.col("_d"), "left").drop("_d").fillna(0, ["dn_levelpath", "dn_topo_sort"])
    return net.with_df(df)


@query("SELECT p_partkey AS id, (p_partkey + 1) // 2 AS toid, CAST(p_size AS DOUBLE) AS length_km, p_brand AS \"GNIS_name\" FROM part")
def names_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("COMID"), F.floor((F.col("p_partkey") + 1) / 2).alias("toCOMID"), F.col("p_size").cast("double").alias("LENGTHKM"), F.col("p_brand").alias("GNIS_name")
    )
    return align_names(raw)


@query("WITH " + FOREST_SQL + " SELECT id, toid FROM forest WHERE toid NOT IN (SELECT id FROM forest)")
def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlets_of(hy(forest(spark, sf_dir)).df).select("id", "toid")


@query("""SELECT operator, operator NOT IN ('add_pfafstetter', 'add_streamlevel', 'to_flownetwork', 'make_attribute_topology', 'index_points_to_lines') AS available
FROM (VALUES ('sort_network'), ('add_topo_sort'), ('add_levelpaths'), ('add_streamorder'), ('accumulate_downstream'), ('navigate_network_dfs'), ('make_index_ids'),
  ('make_node_topology'), ('add_pathlength'), ('check_hy_graph'), ('navigate_hydro_network'), ('add_pfafstetter'), ('add_streamlevel'), ('add_toids'), ('add_divergence'),
  ('subset_network'), ('make_attribute_topology'), ('index_points_to_lines'), ('to_flownetwork'), ('add_return_divergence')) t(operator)""")
def operators_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capabilities(hy(nodes(spark, sf_dir)), include_conversions=True)
    return spark.createDataFrame(sorted(found.items()), "operator string, available boolean")


@query("WITH " + NODES_SQL + """
SELECT a.id, coalesce(b.id, 0) AS toid, a.divergence FROM nodes a
LEFT JOIN (SELECT * FROM nodes WHERE divergence <> 2) b ON a.tonode = b.fromnode""")
def add_toids_dendritic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.add_toids(hy(nodes(spark, sf_dir))).df.select("id", "toid", "divergence")


@query("WITH " + NODES_SQL + " SELECT id, toid FROM flow")
def add_toids_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.add_toids(hy(nodes(spark, sf_dir)), return_dendritic=False).df.select("id", "toid")


@query("WITH " + NODES_SQL + " SELECT DISTINCT id, toid FROM flow")
def flownetwork_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.to_flownetwork(hy(nodes(spark, sf_dir))).df


@query(PATH_SQL + """SELECT n.id, n.toid, coalesce(d.levelpath = n.levelpath, false) AS upmain, true AS downmain
FROM net n LEFT JOIN net d ON n.toid = d.id""")
def flownetwork_from_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.to_flownetwork(leveled(spark, sf_dir), warn_dendritic=False).df


@query("WITH RECURSIVE " + TREE_SQL + """, far(id, d) AS (
  SELECT id, 0 FROM tree WHERE toid = 0 UNION ALL SELECT t.id, d + 1 FROM far JOIN tree t ON t.toid = far.id
), place AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS fromnode FROM far)
SELECT t.id, p.fromnode, coalesce(q.fromnode, (SELECT count(*) + 1 FROM tree)) AS tonode
FROM tree t JOIN place p USING (id) LEFT JOIN place q ON t.toid = q.id""")
def node_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.make_node_topology(hy(tree(spark, sf_dir).select("id", "toid"))).df.select("id", "fromnode", "tonode")


@query("WITH " + NODES_SQL + """, s AS (
  SELECT a.id, coalesce(string_agg(DISTINCT CAST(b.id AS VARCHAR), '|' ORDER BY CAST(b.id AS VARCHAR)), 'end|' || a.id) AS k
  FROM nodes a LEFT JOIN nodes b ON a.tonode = b.fromnode GROUP BY a.id
) SELECT id, min(id) OVER (PARTITION BY k) AS first_of_node, count(*) OVER (PARTITION BY k) AS at_node FROM s""")
def node_topology_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of non-dendritic nodes, which features end together (node numbers themselves are arbitrary)."""
    flow = topology.to_flownetwork(hy(nodes(spark, sf_dir)))
    found = topology.make_node_topology(flow).df.select("id", "tonode").distinct()
    grouped = found.groupBy(F.col("tonode").alias("t")).agg(F.min("id").alias("first_of_node"), F.count("*").alias("at_node"))
    return found.join(grouped, F.col("tonode") == F.col("t")).select("id", "first_of_node", "at_node")


LOOPED_SQL = "looped AS (SELECT p_partkey + 1 AS id, CASE WHEN p_partkey % 50 = 1 THEN p_partkey + 2 WHEN p_partkey % 50 = 2 THEN p_partkey ELSE (p_partkey + 1) // 2 END AS toid FROM part)"


def _looped(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    to = F.when(k % 50 == 1, k + 2).when(k % 50 == 2, k).otherwise(F.floor((k + 1) / 2))
    return _table(spark, sf_dir, "part").select((k + 1).alias("id"), to.alias("toid"))


@query("WITH " + LOOPED_SQL + " SELECT a.id, a.toid FROM looped a JOIN looped b ON a.id = b.toid AND a.toid = b.id")
def check_graph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.check_hy_graph(hy(_looped(spark, sf_dir)))


@query("WITH RECURSIVE " + LOOPED_SQL + """, r(a, b) AS (SELECT id, toid FROM looped UNION SELECT r.a, l.toid FROM r JOIN looped l ON r.b = l.id)
SELECT l.id, l.toid FROM looped l WHERE EXISTS (SELECT 1 FROM r WHERE r.a = l.id AND r.b = l.id)""")
def loop_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.check_hy_graph(hy(_looped(spark, sf_dir)), loop_check=True)


@query("WITH RECURSIVE " + TREE_SQL + """, far(id, d) AS (
  SELECT id, 0 FROM tree WHERE toid = 0 UNION ALL SELECT t.id, d + 1 FROM far JOIN tree t ON t.toid = far.id
) SELECT id, row_number() OVER (ORDER BY d, id DESC) AS topo_sort FROM far""")
def topo_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.add_topo_sort(hy(tree(spark, sf_dir))).df.select("id", "topo_sort")


@query("WITH RECURSIVE " + FOREST_SQL + """, w(id, terminal_id) AS (
  SELECT id, id FROM forest WHERE toid = 0 UNION ALL SELECT f.id, w.terminal_id FROM w JOIN forest f ON f.toid = w.id
) SELECT id, terminal_id FROM w""")
def terminal_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.sort_network(hy(forest(spark, sf_dir)), split=True).df.select("id", "terminal_id")


@query("WITH " + TREE_SQL + """, i AS (SELECT id, row_number() OVER (ORDER BY id) AS indid FROM tree)
SELECT t.id, a.indid, t.toid, coalesce(b.indid, 0) AS toindid FROM tree t JOIN i a USING (id) LEFT JOIN i b ON t.toid = b.id""")
def index_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.make_index_ids(hy(tree(spark, sf_dir)))


@query("WITH " + TREE_SQL + """, i AS (SELECT id, row_number() OVER (ORDER BY id) AS indid FROM tree)
SELECT a.indid, coalesce(c.indid, 0) AS fromindid FROM i a LEFT JOIN tree t ON t.toid = a.id LEFT JOIN i c ON t.id = c.id""")
def from_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.make_fromids(topology.make_index_ids(hy(tree(spark, sf_dir))))


@query("WITH RECURSIVE " + TREE_SQL + ", " + ACC_SQL + " SELECT id, round(total_da_sqkm, 2) AS total_da_sqkm FROM acc")
def accumulate_dendritic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attributes.accumulate_downstream(hy(tree(spark, sf_dir)), "da_sqkm").df
    return out.select("id", F.round("da_sqkm_accumulated", 2).alias("total_da_sqkm"))


@query("WITH RECURSIVE " + TREE_SQL + ", " + ACC_SQL + " SELECT id, round(arbolate_sum, 2) AS arbolate_sum FROM acc")
def arbolate_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attributes.accumulate_downstream(hy(tree(spark, sf_dir)), "length_km").df
    return out.select("id", F.round("length_km_accumulated", 2).alias("arbolate_sum"))


@query("WITH RECURSIVE " + NODES_SQL + """, above(id, anc) AS (
  SELECT id, id FROM nodes UNION SELECT a.id, f.toid FROM above a JOIN flow f ON a.anc = f.id WHERE f.toid > 0
) SELECT anc AS id, round(sum(da_sqkm), 2) AS total_da_sqkm FROM above JOIN nodes USING (id) GROUP BY anc""")
def accumulate_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attributes.accumulate_downstream(hy(nodes(spark, sf_dir)), "da_sqkm", total=True).df
    return out.select("id", F.round("da_sqkm_accumulated", 2).alias("total_da_sqkm"))


@query("WITH RECURSIVE " + NODES_SQL + """, share AS (SELECT id, CASE divergence WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.25 END AS f FROM nodes
), moved(id, place, part) AS (
  SELECT id, id, CAST(da_sqkm AS DOUBLE) FROM nodes
  UNION ALL
  SELECT m.id, f.toid, m.part * s.f FROM moved m JOIN flow f ON m.place = f.id JOIN share s ON s.id = f.toid
) SELECT place AS id, round(sum(part) + 1e-7, 2) AS total_da_sqkm FROM moved GROUP BY place""")
def accumulate_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = topology.add_toids(hy(nodes(spark, sf_dir)), return_dendritic=False).df
    fraction = F.when(F.col("divergence") == 0, 1.0).when(F.col("divergence") == 1, 0.75).otherwise(0.25)
    out = attributes.accumulate_downstream(hy(flow.withColumn("divergence_fraction", fraction)), "da_sqkm").df
    return out.select("id", F.round(F.col("da_sqkm_accumulated") + 1e-7, 2).alias("total_da_sqkm")).distinct()


@query(PATH_SQL + "SELECT id, pathlength_km FROM net")
def pathlength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.add_pathlength(hy(tree(spark, sf_dir))).df.select("id", "pathlength_km")


@query(PATH_SQL + "SELECT id, levelpath, levelpath_outlet_id FROM net")
def levelpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leveled(spark, sf_dir).df.select("id", "levelpath", "levelpath_outlet_id")


@query(PATH_SQL + """, lv(levelpath, stream_level) AS (
  SELECT DISTINCT levelpath, CAST(1 AS BIGINT) FROM net WHERE id = levelpath AND dn_levelpath = 0
  UNION ALL
  SELECT n.levelpath, lv.stream_level + 1 FROM lv JOIN net n ON n.dn_levelpath = lv.levelpath AND n.id = n.levelpath AND n.dn_levelpath <> n.levelpath
) SELECT id, stream_level FROM net JOIN lv USING (levelpath)""")
def streamlevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.add_streamlevel(navigable(spark, sf_dir)).df.select("id", "stream_level")


_ORDER_LEVELS = 16
STREAMORDER_SQL = "WITH " + TREE_SQL + ", o0 AS (SELECT id, toid, CAST(1 AS BIGINT) AS o FROM tree)" + "".join(
    f""", o{k} AS (
  SELECT t.id, t.toid, coalesce(CASE WHEN u.n > 1 THEN u.m + 1 ELSE u.m END, 1) AS o
  FROM tree t LEFT JOIN (SELECT toid, max(o) AS m, count(*) FILTER (WHERE o = mo) AS n FROM (SELECT toid, o, max(o) OVER (PARTITION BY toid) AS mo FROM o{k - 1}) GROUP BY toid) u ON u.toid = t.id)"""
    for k in range(1, _ORDER_LEVELS + 1)
) + f" SELECT id, o AS stream_order, o AS stream_calculator FROM o{_ORDER_LEVELS}"


@query(STREAMORDER_SQL)
def streamorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.add_streamorder(hy(tree(spark, sf_dir))).df.select("id", "stream_order", "stream_calculator")


# As many rounds over all features as the longest way may have; each looks at what flows in after the round before.
DIVERTED_ORDER_SQL = "WITH " + NODES_SQL + ", o0 AS (SELECT id, CAST(1 AS BIGINT) AS o, CAST(CASE WHEN divergence = 2 THEN 0 ELSE 1 END AS BIGINT) AS c FROM nodes)" + "".join(
    f""", u{k} AS (
  SELECT id, lo, hi, m, count(*) FILTER (WHERE o = m) AS n FROM (
    SELECT *, CASE WHEN lo = 0 AND hi > 0 THEN mm ELSE am END AS m FROM (
      SELECT f.toid AS id, o, min(c) OVER w AS lo, max(c) OVER w AS hi, max(o) OVER w AS am, max(CASE WHEN c > 0 THEN o END) OVER w AS mm
      FROM (SELECT DISTINCT id, toid FROM flow WHERE toid > 0) f JOIN o{k - 1} USING (id) WINDOW w AS (PARTITION BY f.toid)))
  GROUP BY id, lo, hi, m
), o{k} AS (
  SELECT n.id, CASE WHEN u.id IS NULL THEN 1 WHEN n.divergence <> 2 AND u.n >= 2 AND u.lo > 0 THEN u.m + 1 ELSE u.m END AS o,
         CASE WHEN n.divergence = 2 THEN 0 WHEN u.id IS NULL THEN 1 WHEN u.n >= 2 AND u.lo > 0 THEN u.m + 1 WHEN u.hi > 0 THEN u.m ELSE 0 END AS c
  FROM nodes n LEFT JOIN u{k} u ON u.id = n.id)"""
    for k in range(1, _ORDER_LEVELS + 1)
) + f" SELECT id, CAST(o AS BIGINT) AS stream_order, CAST(c AS BIGINT) AS stream_calculator FROM o{_ORDER_LEVELS}"


@query(DIVERTED_ORDER_SQL)
def streamorder_diversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.add_streamorder(hy(nodes(spark, sf_dir))).df.select("id", "stream_order", "stream_calculator").distinct()


def _pfafstetter_sql(levels: int) -> str:
    """One level after another: the four largest tributaries of every part of a main path."""
    out = PATH_SQL + """, trib AS (SELECT n.levelpath AS t, d.levelpath AS path, n.toid AS spot, n.total_da_sqkm AS da FROM net n JOIN net d ON n.toid = d.id WHERE n.levelpath <> d.levelpath
), b0 AS (SELECT CAST(1 AS BIGINT) AS path, CAST(0 AS BIGINT) AS lo, CAST(1000000000000 AS BIGINT) AS hi, CAST(0 AS BIGINT) AS code)"""
    for k in range(1, levels + 1):
        out += f""", t{k} AS (
  SELECT *, row_number() OVER (PARTITION BY path, lo, code ORDER BY spot, t) AS k, lag(spot, 1, lo) OVER (PARTITION BY path, lo, code ORDER BY spot, t) AS prev
  FROM (SELECT b.*, r.t, r.spot, rank() OVER (PARTITION BY b.path, b.lo, b.code ORDER BY r.da DESC) AS rk FROM b{k - 1} b JOIN trib r ON r.path = b.path AND r.spot > b.lo AND r.spot <= b.hi)
  WHERE rk <= 4
), b{k} AS (
  SELECT t AS path, CAST(0 AS BIGINT) AS lo, CAST(1000000000000 AS BIGINT) AS hi, code * 10 + 2 * k AS code FROM t{k}
  UNION ALL SELECT path, prev, spot, code * 10 + 2 * k - 1 FROM t{k}
  UNION ALL SELECT path, max(spot), max(hi), code * 10 + 2 * max(k) + 1 FROM t{k} GROUP BY path, lo, code
), m{k} AS (SELECT n.id, max(b.code) AS c FROM net n JOIN b{k} b ON n.levelpath = b.path AND n.id > b.lo AND n.id <= b.hi GROUP BY n.id)"""
    if levels == 1:
        return out + " SELECT n.id, m1.c AS pf_level_1 FROM net n LEFT JOIN m1 USING (id)"
    return out + """ SELECT n.id, coalesce(m1.c, m2.c // 10) AS pf_level_1, coalesce(m2.c, m1.c * 10 + 1) AS pf_level_2
FROM net n LEFT JOIN m1 USING (id) LEFT JOIN m2 USING (id)"""


@query(_pfafstetter_sql(1))
def pfafstetter_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.add_pfafstetter(leveled(spark, sf_dir), 1).df.select("id", "pf_level_1")


@query(_pfafstetter_sql(2))
def pfafstetter_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.add_pfafstetter(leveled(spark, sf_dir), 2).df.select("id", "pf_level_1", "pf_level_2")


@query("WITH RECURSIVE " + NODES_SQL + ", r(id) AS (SELECT CAST(5 AS BIGINT) UNION SELECT f.id FROM r JOIN flow f ON f.toid = r.id) SELECT CAST(5 AS BIGINT) AS start, id FROM r")
def navigate_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.reachable(hy(nodes(spark, sf_dir)), [5], "up")


@query("WITH RECURSIVE " + NODES_SQL + ", r(id) AS (SELECT CAST(133 AS BIGINT) UNION SELECT f.toid FROM r JOIN flow f ON f.id = r.id WHERE f.toid > 0) SELECT CAST(133 AS BIGINT) AS start, id FROM r")
def navigate_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.reachable(hy(nodes(spark, sf_dir)), [133], "down")


@query(PATH_SQL + "SELECT CAST(2 AS BIGINT) AS start, id FROM net WHERE levelpath = (SELECT levelpath FROM net WHERE id = 2) AND id >= 2")
def navigate_upmain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.reachable(topology.to_flownetwork(leveled(spark, sf_dir), warn_dendritic=False), [2], "upmain")


@query("WITH RECURSIVE " + TREE_SQL + ", r(id) AS (SELECT CAST(100 AS BIGINT) UNION SELECT t.toid FROM r JOIN tree t ON t.id = r.id WHERE t.toid > 0) SELECT CAST(100 AS BIGINT) AS start, id FROM r")
def navigate_downmain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.reachable(topology.to_flownetwork(leveled(spark, sf_dir), warn_dendritic=False), [100], "downmain")


@query("WITH RECURSIVE " + NODES_SQL + """, adj AS (SELECT id, list(DISTINCT toid ORDER BY toid) AS ways FROM flow GROUP BY id
), s(n, which, stack, closed, path_id, seq, node) AS (
  SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT), [CAST(133 AS BIGINT)], CAST([] AS BIGINT[]), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT n + 1, CASE WHEN len(stack) = 0 THEN which + 1 ELSE which END,
    CASE WHEN len(stack) = 0 THEN [CAST(100 AS BIGINT)] WHEN stack[-1] = 0 OR list_contains(closed, stack[-1]) THEN stack[1:len(stack) - 1] ELSE list_concat(stack[1:len(stack) - 1], ways) END,
    CASE WHEN len(stack) = 0 OR stack[-1] = 0 OR list_contains(closed, stack[-1]) THEN closed ELSE list_append(closed, stack[-1]) END,
    CASE WHEN (len(stack) = 0 OR stack[-1] = 0 OR list_contains(closed, stack[-1])) AND seq > 0 THEN path_id + 1 ELSE path_id END,
    CASE WHEN len(stack) = 0 OR stack[-1] = 0 OR list_contains(closed, stack[-1]) THEN 0 ELSE seq + 1 END,
    CASE WHEN len(stack) = 0 OR stack[-1] = 0 OR list_contains(closed, stack[-1]) THEN NULL ELSE stack[-1] END
  FROM s LEFT JOIN adj ON adj.id = stack[-1] WHERE NOT (which = 2 AND len(stack) = 0)
) SELECT CASE which WHEN 1 THEN CAST(133 AS BIGINT) ELSE CAST(100 AS BIGINT) END AS start, path_id, seq, node AS id FROM s WHERE node IS NOT NULL""")
def dfs_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.navigate_network_dfs(hy(nodes(spark, sf_dir)), [133, 100], "down")


@query(PATH_SQL + """, s AS (SELECT * FROM net WHERE id = 2)
SELECT n.id FROM net n, s WHERE n.levelpath = s.levelpath AND n.id >= s.id AND CASE WHEN s.length_km > 120 THEN n.id = s.id ELSE n.pathlength_km <= s.pathlength_km - s.length_km + 120 END""")
def navigate_um_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.navigate_hydro_network(navigable(spark, sf_dir), 2, "UM", 120.0)


@query("WITH RECURSIVE " + TREE_SQL + ", r(id) AS (SELECT CAST(3 AS BIGINT) UNION SELECT t.id FROM r JOIN tree t ON t.toid = r.id) SELECT id FROM r")
def navigate_ut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.navigate_hydro_network(navigable(spark, sf_dir), 3, "UT")


@query(PATH_SQL + """, g(id) AS (
  SELECT CAST(3 AS BIGINT)
  UNION
  SELECT f.id FROM g JOIN net s ON s.id = g.id AND s.length_km <= 150 JOIN up ON up.anc = s.id JOIN net f ON f.id = up.id AND f.id % 7 = 0 AND f.pathlength_km > s.pathlength_km - s.length_km + 150
    JOIN up u2 ON u2.anc = s.id AND u2.id = f.id // 3 JOIN net t ON t.id = u2.id AND t.pathlength_km <= s.pathlength_km - s.length_km + 150
) SELECT DISTINCT CASE WHEN s.length_km > 150 THEN s.id ELSE f.id END AS id
FROM g JOIN net s USING (id) JOIN up ON up.anc = s.id JOIN net f ON f.id = up.id WHERE s.length_km > 150 OR f.pathlength_km <= s.pathlength_km - s.length_km + 150""")
def navigate_ut_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = navigable(spark, sf_dir)
    minor = F.when(F.col("id") % 7 == 0, F.floor(F.col("id") / 3)).otherwise(0)
    return navigation.navigate_hydro_network(net.with_df(net.df.withColumn("dn_minor_topo_sort", minor)), 3, "UT", 150.0)


@query("WITH RECURSIVE " + TREE_SQL + ", r(id) AS (SELECT CAST(101 AS BIGINT) UNION SELECT t.toid FROM r JOIN tree t ON t.id = r.id WHERE t.toid > 0) SELECT id FROM r")
def navigate_dm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.navigate_hydro_network(navigable(spark, sf_dir), 101, "DM")


@query("WITH RECURSIVE " + TREE_SQL + """, r(id) AS (SELECT CAST(98 AS BIGINT) UNION
  SELECT unnest([t.toid, CASE WHEN t.id % 7 = 0 THEN t.id // 3 ELSE 0 END]) FROM r JOIN tree t ON t.id = r.id
) SELECT id FROM r WHERE id > 0""")
def navigate_dd(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = navigable(spark, sf_dir)
    minor = F.when(F.col("id") % 7 == 0, F.floor(F.col("id") / 3)).otherwise(0)
    return navigation.navigate_hydro_network(net.with_df(net.df.withColumn("dn_minor_topo_sort", minor)), 98, "DD")


CONNECTED = [40, 77, 130, 181]


@query("WITH RECURSIVE " + TREE_SQL + """, s(start) AS (VALUES (CAST(40 AS BIGINT)), (77), (130), (181)), r(start, id) AS (
  SELECT start, start // 2 FROM s UNION ALL SELECT r.start, t.toid FROM r JOIN tree t USING (id) WHERE t.toid > 0
), p AS (SELECT a.start AS id_1, b.start AS id_2 FROM s a JOIN s b ON a.start < b.start), u AS (
  SELECT id_1, id_2, id, count(*) AS n FROM p JOIN r ON r.start IN (id_1, id_2) GROUP BY ALL
) SELECT id_1, id_2, count(*) AS n_features, round(sum(length_km), 2) AS network_distance_km FROM u JOIN tree USING (id) WHERE n = 1 GROUP BY id_1, id_2""")
def connected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = navigation.navigate_connected_paths(hy(tree(spark, sf_dir)), CONNECTED)
    return found.select("id_1", "id_2", F.size("path").cast("long").alias("n_features"), F.round("network_distance_km", 2).alias("network_distance_km"))


@query("WITH RECURSIVE " + NODES_SQL + ", r(id) AS (SELECT CAST(1 AS BIGINT) UNION SELECT f.id FROM r JOIN flow f ON f.toid = r.id) SELECT id FROM r")
def subset_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.subset_network(hy(nodes(spark, sf_dir)), 1).df.select("id").distinct()


@query("WITH " + NODES_SQL + """, heads AS (SELECT fromnode FROM nodes GROUP BY fromnode HAVING count(*) > 1), up AS (
  SELECT h.fromnode AS node, u.id, u.name AS nm, u.feature_type = 'STANDARD' AS major FROM heads h JOIN nodes u ON u.tonode = h.fromnode
), freq AS (SELECT name AS nm, count(*) AS times FROM nodes WHERE name IS NOT NULL GROUP BY name), cand AS (
  SELECT fromnode AS node, id, name AS nm, feature_type = 'STANDARD' AS major FROM nodes WHERE fromnode IN (SELECT fromnode FROM heads)
), flags AS (
  SELECT u.*, exists(SELECT 1 FROM cand c WHERE c.node = u.node AND c.nm = u.nm) AS goes_on, f.times FROM up u LEFT JOIN freq f USING (nm)
), picked AS (
  SELECT node, CASE WHEN count(nm) = 1 THEN max(nm) WHEN count(*) FILTER (WHERE goes_on) = 1 THEN max(nm) FILTER (WHERE goes_on)
    WHEN count(*) FILTER (WHERE major) = 1 THEN max(nm) FILTER (WHERE major)
    WHEN count(DISTINCT nm) FILTER (WHERE times = mx) = 1 THEN max(nm) FILTER (WHERE times = mx) ELSE arg_min(nm, id) END AS up_nm,
    count(*) AS n
  FROM (SELECT *, max(times) OVER (PARTITION BY node) AS mx FROM flags) GROUP BY node
), d AS (
  SELECT c.node, c.id, c.nm IS NOT NULL AS named, coalesce(c.nm = p.up_nm, false) AS same, c.major,
         bool_or(c.major) OVER (PARTITION BY c.node) AS am FROM cand c LEFT JOIN picked p USING (node)
), win AS (
  SELECT node, coalesce(
    CASE WHEN count(*) FILTER (WHERE same AND major) = 1 THEN max(id) FILTER (WHERE same AND major) END,
    CASE WHEN count(*) FILTER (WHERE same) = 1 THEN max(id) FILTER (WHERE same) END,
    CASE WHEN count(*) FILTER (WHERE named AND am) = 1 THEN max(id) FILTER (WHERE named AND am) END,
    CASE WHEN count(*) FILTER (WHERE major) = 1 THEN max(id) FILTER (WHERE major) END,
    CASE WHEN count(*) FILTER (WHERE named) = 1 THEN max(id) FILTER (WHERE named) END, min(id)) AS w
  FROM d GROUP BY node
) SELECT n.id, CASE WHEN w.w IS NULL THEN 0 WHEN n.id = w.w THEN 1 ELSE 2 END AS divergence FROM nodes n LEFT JOIN win w ON w.node = n.fromnode""")
def add_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = hy(nodes(spark, sf_dir).drop("divergence"))
    ends = [1]
    return attributes.add_divergence(net, [], ends, "name", "feature_type", ["STANDARD"]).df.select("id", "divergence")


@query("WITH RECURSIVE " + NODES_SQL + """, far(id, d) AS (
  SELECT id, 0 FROM flow WHERE toid = 0 UNION SELECT f.id, far.d + 1 FROM far JOIN flow f ON f.toid = far.id
), dist AS (SELECT id, max(d) AS d FROM far GROUP BY id
), rm(start, id) AS (
  SELECT fromnode, id FROM nodes WHERE divergence = 1 UNION SELECT r.start, f.toid FROM rm r JOIN flow f USING (id) WHERE f.toid > 0
), rd(start, id) AS (
  SELECT fromnode, id FROM nodes WHERE divergence = 2 UNION SELECT r.start, f.toid FROM rd r JOIN flow f USING (id) WHERE f.toid > 0
), back AS (
  SELECT DISTINCT o.start, f.toid AS id FROM (SELECT * FROM rd EXCEPT SELECT * FROM rm) o JOIN flow f USING (id) JOIN rm ON rm.start = o.start AND rm.id = f.toid
), picked AS (SELECT DISTINCT id FROM (SELECT b.id, row_number() OVER (PARTITION BY start ORDER BY d DESC, b.id) AS rn FROM back b JOIN dist USING (id)) WHERE rn = 1)
SELECT n.id, CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS return_divergence FROM nodes n LEFT JOIN picked p USING (id)""")
def return_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.add_return_divergence(hy(nodes(spark, sf_dir))).df.select("id", "return_divergence")


@query("WITH RECURSIVE " + NODES_SQL + """, up(start, place) AS (
  SELECT id, fromnode FROM nodes WHERE divergence = 2 UNION ALL SELECT start, place // 2 FROM up WHERE place > 1
), side(start, place) AS (
  SELECT id, tonode FROM nodes WHERE divergence = 2 AND tonode > 0 UNION ALL SELECT start, place // 2 FROM side WHERE place > 1
), held AS (SELECT start, place FROM (SELECT * FROM up UNION ALL SELECT * FROM side) GROUP BY start, place HAVING count(*) = 1)
SELECT id FROM tree WHERE id NOT IN (SELECT place FROM held)""")
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.get_bridge_flowlines(hy(nodes(spark, sf_dir)))


# Lines: a feature runs from a place given by its number to that of the feature below; corners half way.
LINES_SQL = TREE_SQL + """, placed AS (SELECT id, toid, CAST(id % 64 AS DOUBLE) AS x, CAST(id // 64 AS DOUBLE) AS y, id // 10 AS aggregate_id FROM tree
), lines AS (
  SELECT a.id, a.toid, a.aggregate_id, a.x AS x0, a.y AS y0, coalesce(b.x, a.x) AS x1, a.y AS y1, coalesce(b.x, a.x) AS x2, coalesce(b.y, a.y + 1) AS y2
  FROM placed a LEFT JOIN placed b ON a.toid = b.id
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = tree(spark, sf_dir).select("id", "toid", (F.col("id") % 64).cast("double").alias("x"), F.floor(F.col("id") / 64).cast("double").alias("y"), F.floor(F.col("id") / 10).alias("aggregate_id"))
    to = at.select(F.col("id").alias("_d"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    joined = at.join(to, F.col("toid") == F.col("_d"), "left")
    tx = F.coalesce("tx", "x")
    geom = F.array(g.point("x", "y"), g.point(tx, "y"), g.point(tx, F.coalesce("ty", F.col("y") + 1)))
    return joined.select("id", "toid", "aggregate_id", F.lit(0.0).alias("aggregate_id_from_measure"), F.lit(100.0).alias("aggregate_id_to_measure"), geom.alias("geom"))


VERTEX_SQL = LINES_SQL + """, v AS (
  SELECT id, 0 AS k, x0 AS x, y0 AS y, 0.0 AS d, abs(x1 - x0) + abs(y2 - y1) AS len FROM lines
  UNION ALL SELECT id, 1, x1, y1, abs(x1 - x0), abs(x1 - x0) + abs(y2 - y1) FROM lines
  UNION ALL SELECT id, 2, x2, y2, abs(x1 - x0) + abs(y2 - y1), abs(x1 - x0) + abs(y2 - y1) FROM lines
), pts AS (SELECT vec_id AS point_id, (vec_id % 97) * 0.61 AS x, (vec_id % 41) * 0.37 AS y FROM embeddings
), near AS (
  SELECT point_id, id, k, sqrt((p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y)) AS dist, 100 - CASE WHEN len > 0 THEN 100 * d / len ELSE 0 END AS m
  FROM pts p JOIN v ON v.x BETWEEN p.x - 0.9 AND p.x + 0.9 AND v.y BETWEEN p.y - 0.9 AND p.y + 0.9
), best AS (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, id) AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY point_id, id ORDER BY dist, k) AS rn FROM near WHERE dist <= 0.9) WHERE rn = 1
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("point_id"), ((F.col("vec_id") % 97) * 0.61).alias("x"), ((F.col("vec_id") % 41) * 0.37).alias("y"))


@query("WITH " + VERTEX_SQL + " SELECT point_id, id, round(m, 4) AS aggregate_id_measure, round(dist, 6) AS \"offset\" FROM best WHERE r = 1")
def index_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexing.index_points_to_lines(hy(lines(spark, sf_dir)), points(spark, sf_dir), 0.9)
    return found.select("point_id", "id", "aggregate_id_measure", F.round("offset", 6).alias("offset"))


@query("WITH " + VERTEX_SQL + " SELECT point_id, id, round(dist, 6) AS \"offset\" FROM best WHERE r = 1")
def index_points_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius in another unit."""
    found = indexing.index_points_to_lines(hy(lines(spark, sf_dir)), points(spark, sf_dir), (0.0009, "km"), crs=5070)
    return found.select("point_id", "id", F.round("offset", 6).alias("offset"))


@query("WITH " + VERTEX_SQL + " SELECT point_id, id, round(dist, 6) AS \"offset\" FROM best WHERE r <= 3")
def index_points_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexing.index_points_to_lines(hy(lines(spark, sf_dir)), points(spark, sf_dir), 0.9, max_matches=3)
    return found.select("point_id", "id", F.round("offset", 6).alias("offset"))


@query("WITH RECURSIVE " + LINES_SQL + """, top(id, aggregate_id) AS (
  SELECT id, id FROM lines WHERE id % 2 = 1 OR id = 1 UNION ALL SELECT l.id, t.aggregate_id FROM top t JOIN lines l ON l.toid = t.id WHERE l.id % 2 = 0
), far(id, d) AS (
  SELECT id, 0 FROM lines WHERE toid = 0 UNION ALL SELECT l.id, far.d + 1 FROM far JOIN lines l ON l.toid = far.id
), v AS (
  SELECT l.id, t.aggregate_id, far.d, p.k, p.x, p.y FROM lines l JOIN top t USING (id) JOIN far USING (id), LATERAL (VALUES (0, l.x0, l.y0), (1, l.x1, l.y1), (2, l.x2, l.y2)) p(k, x, y)
), steps AS (
  SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM v WINDOW w AS (PARTITION BY aggregate_id ORDER BY d DESC, k)
), runs AS (
  SELECT *, sum(step) OVER (PARTITION BY aggregate_id ORDER BY d DESC, k ROWS UNBOUNDED PRECEDING) AS run, sum(step) OVER (PARTITION BY aggregate_id) AS total FROM steps
), m AS (SELECT id, 100 - CASE WHEN total > 0 THEN 100 * run / total ELSE 0 END AS m FROM runs)
SELECT id, round(min(m), 6) AS aggregate_id_from_measure, round(max(m), 6) AS aggregate_id_to_measure FROM m GROUP BY id""")
def add_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of connected features: from an odd feature upstream by even ones."""
    own = lines(spark, sf_dir).drop("aggregate_id", "aggregate_id_from_measure", "aggregate_id_to_measure")
    # An id without its factors of two names the feature at the aggregate's lower end.
    odd = F.expr("id div (id & -id)")
    out = indexing.add_measures(hy(own.withColumn("aggregate_id", odd))).df
    return out.select("id", F.round("aggregate_id_from_measure", 6).alias("aggregate_id_from_measure"), F.round("aggregate_id_to_measure", 6).alias("aggregate_id_to_measure"))


@query("WITH " + VERTEX_SQL + """, m AS (
  SELECT point_id, b.id, (point_id * 37 + b.id) % 101 AS m, x0, y0, x1, y1, x2, y2, abs(x1 - x0) AS l1, abs(y2 - y1) AS l2 FROM best b JOIN lines l USING (id) WHERE r = 1
), d AS (SELECT *, (100 - m) / 100 * (l1 + l2) AS d FROM m)
SELECT point_id, id, round(CASE WHEN l1 > 0 AND d < l1 THEN x0 + d / l1 * (x1 - x0) ELSE x1 END, 3) AS geom_x,
       round(CASE WHEN d <= l1 OR l2 = 0 THEN y1 ELSE y1 + (d - l1) / l2 * (y2 - y1) END, 3) AS geom_y FROM d""")
def hydro_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places between vertices as well: each index gets a measure of its own."""
    every = hy(lines(spark, sf_dir))
    found = indexing.index_points_to_lines(every, points(spark, sf_dir), 0.9)
    indexes = found.withColumn("aggregate_id_measure", ((F.col("point_id") * 37 + F.col("id")) % 101).cast("double"))
    out = indexing.get_hydro_location(indexes, every)
    return out.select("point_id", "id", F.round("geom_x", 3).alias("geom_x"), F.round("geom_y", 3).alias("geom_y"))


@query("""WITH p AS (SELECT p_partkey AS aggregate_id, CAST(p_size AS DOUBLE) AS length_km, CAST(p_partkey % 101 AS DOUBLE) AS m FROM part)
SELECT aggregate_id, round(length_km * m / 100, 6) AS dn, round(length_km * (1 - m / 100), 6) AS up FROM p""")
def partial_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    net = hy(part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("aggregate_id"), F.lit(0.0).alias("aggregate_id_from_measure"), F.lit(100.0).alias("aggregate_id_to_measure"), F.col("p_size").cast("double").alias("length_km")))
    located = part.select(F.col("p_partkey").alias("aggregate_id"), (F.col("p_partkey") % 101).cast("double").alias("aggregate_id_measure"))
    out = navigation.get_partial_length(located, net)
    return out.select("aggregate_id", F.round("dn", 6).alias("dn"), F.round("up", 6).alias("up"))


@query("""WITH m AS (SELECT p_partkey AS k, CAST(p_partkey % 101 AS DOUBLE) AS m FROM part)
SELECT k, round(CASE WHEN m BETWEEN 20 AND 80 THEN 100 * (m - 20) / 60 END, 6) AS rescaled FROM m""")
def rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 101).cast("double").alias("m"))
    return m.select("k", F.round(navigation.rescaled("m", F.lit(20.0), F.lit(80.0)), 6).alias("rescaled"))


CANDIDATES_SQL = VERTEX_SQL + ", cand AS (SELECT point_id, id FROM best WHERE r <= 3)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.index_points_to_lines(hy(lines(spark, sf_dir)), points(spark, sf_dir), 0.9, max_matches=3)


@query("WITH " + CANDIDATES_SQL + """, s AS (SELECT c.*, abs(t.da_sqkm - (c.point_id % 1000)) AS d FROM cand c JOIN tree t USING (id))
SELECT point_id, id FROM s QUALIFY d = min(d) OVER (PARTITION BY point_id)""")
def disambiguate_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = tree(spark, sf_dir).select("id", "da_sqkm")
    located = points(spark, sf_dir).select("point_id", (F.col("point_id") % 1000).cast("double").alias("area"))
    return indexing.disambiguate_indexes(_candidates(spark, sf_dir), flow, located).select("point_id", "id")


@query("WITH " + CANDIDATES_SQL + """, s AS (
  SELECT c.*, (greatest(length(t.name), length('Brand#' || c.point_id % 60)) - levenshtein(lower(t.name), lower('Brand#' || c.point_id % 60))) / greatest(length(t.name), length('Brand#' || c.point_id % 60)) AS d
  FROM cand c JOIN tree t USING (id))
SELECT point_id, id FROM s QUALIFY d = max(d) OVER (PARTITION BY point_id)""")
def disambiguate_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = tree(spark, sf_dir).select("id", "name")
    located = points(spark, sf_dir).select("point_id", F.concat(F.lit("Brand#"), (F.col("point_id") % 60).cast("string")).alias("label"))
    return indexing.disambiguate_indexes(_candidates(spark, sf_dir), flow, located).select("point_id", "id")


@query("WITH " + LINES_SQL + """, hit AS (SELECT a.id, b.id AS toid, sqrt((a.x2 - b.x0) * (a.x2 - b.x0) + (a.y2 - b.y0) * (a.y2 - b.y0)) AS d FROM lines a JOIN lines b ON a.id <> b.id AND b.x0 BETWEEN a.x2 - 0.5 AND a.x2 + 0.5 AND b.y0 BETWEEN a.y2 - 0.5 AND a.y2 + 0.5)
SELECT l.id, coalesce(h.toid, 0) AS toid FROM lines l LEFT JOIN (SELECT * FROM hit WHERE d <= 0.5 QUALIFY d = min(d) OVER (PARTITION BY id)) h USING (id)""")
def attribute_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.make_attribute_topology(hy(lines(spark, sf_dir).select("id", "geom")), 0.5).df


# Unit squares in 64 columns as waterbodies and as a coverage.
SQUARES_SQL = "squares AS (SELECT p_partkey AS wbid, CAST(p_partkey % 64 AS DOUBLE) AS x, CAST(p_partkey // 64 AS DOUBLE) AS y, p_partkey % 64 // 8 AS grp, p_retailprice AS price FROM part)"


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k % 64).cast("double"), F.floor(k / 64).cast("double")
    ring = F.array(g.point(x, y), g.point(x + 1, y), g.point(x + 1, y + 1), g.point(x, y + 1), g.point(x, y))
    return _table(spark, sf_dir, "part").select(k.alias("wbid"), F.array(ring).alias("geom"), F.floor((k % 64) / 8).alias("grp"), F.col("p_retailprice").alias("price"))


@query("WITH " + SQUARES_SQL + """, pts AS (SELECT vec_id AS point_id, (vec_id % 97) * 0.61 + 0.003 AS x, (vec_id % 41) * 0.37 + 0.003 AS y FROM embeddings
), c AS (SELECT wbid, x + dx AS x, y + dy AS y FROM squares, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) t(dx, dy)
), n AS (SELECT point_id, arg_min(wbid, (d, wbid)) AS near_wbid, min(d) AS near_wb_dist FROM (
  SELECT point_id, wbid, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d FROM pts p JOIN c ON c.x BETWEEN p.x - 1 AND p.x + 1 AND c.y BETWEEN p.y - 1 AND p.y + 1) WHERE d <= 1 GROUP BY point_id
) SELECT p.point_id, near_wbid, round(near_wb_dist, 6) AS near_wb_dist, s.wbid AS in_wbid, coalesce(s.wbid, near_wbid) * 2 AS wb_outlet_id
FROM pts p LEFT JOIN n USING (point_id) LEFT JOIN squares s ON p.x > s.x AND p.x < s.x + 1 AND p.y > s.y AND p.y < s.y + 1""")
def index_waterbodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = points(spark, sf_dir).withColumns({"x": F.col("x") + 0.003, "y": F.col("y") + 0.003})
    flow = _table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id"), F.col("p_partkey").alias("wbid"), (F.col("p_partkey") + 1).alias("topo_sort"))
    flow = flow.union(flow.select((F.col("id") + 1000001).alias("id"), "wbid", (F.col("topo_sort") + 5).alias("topo_sort")))
    found = indexing.index_points_to_waterbodies(squares(spark, sf_dir).select("wbid", "geom"), moved, 1.0, flow)
    return found.select("point_id", "near_wbid", F.round("near_wb_dist", 6).alias("near_wb_dist"), "in_wbid", "wb_outlet_id")


@query("WITH " + SQUARES_SQL + " SELECT grp, CAST(count(*) AS DOUBLE) AS area, round(sum(price), 2) AS price FROM squares GROUP BY grp")
def dissolve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = polygons.dissolve_polygons(squares(spark, sf_dir), "grp", {"price": F.sum})
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + g.area(p))
    return out.select("grp", F.round(total, 6).alias("area"), F.round("price", 2).alias("price"))


@query("WITH " + SQUARES_SQL + """, bars AS (SELECT grp, y, min(x) AS x0, max(x) + 1.5 AS x1, count(*) AS n FROM squares GROUP BY grp, y)
SELECT grp, CAST(sum(n) + 0.5 * count(*) AS DOUBLE) AS area FROM bars GROUP BY grp""")
def dissolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of squares, each drawn half a unit too wide, so that neighbours overlap."""
    k = F.col("p_partkey")
    x, y = (k % 64).cast("double"), F.floor(k / 64).cast("double")
    ring = F.array(g.point(x, y), g.point(x + 1.5, y), g.point(x + 1.5, y + 1), g.point(x, y + 1), g.point(x, y))
    wide = _table(spark, sf_dir, "part").select(F.array(ring).alias("geom"), F.floor((k % 64) / 8).alias("grp"))
    out = polygons.dissolve_polygons(wide, "grp")
    return out.select("grp", F.round(F.aggregate("parts", F.lit(0.0), lambda s, p: s + g.area(p)), 6).alias("area"))


@query("SELECT p_partkey AS wbid, CAST(2 AS BIGINT) AS parts, CAST(1 AS DOUBLE) AS area FROM part WHERE p_partkey % 5 = 0")
def repaired_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings in the shape of an eight come apart."""
    k = F.col("p_partkey")
    x, y = (k % 64).cast("double"), F.floor(k / 64).cast("double")
    ring = F.array(g.point(x, y), g.point(x + 2, y + 1), g.point(x + 2, y), g.point(x, y + 1), g.point(x, y))
    eights = _table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select(k.alias("wbid"), F.array(ring).alias("geom"))
    parts = polygons.check_valid(eights)
    return parts.groupBy("wbid").agg(F.count("*").alias("parts"), F.round(F.sum(g.area("geom")), 6).alias("area"))


@query("WITH " + SQUARES_SQL + " SELECT wbid, CAST(1 AS DOUBLE) AS area FROM squares")
def valid_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.check_valid(squares(spark, sf_dir).select("wbid", "geom")).select("wbid", g.area("geom").alias("area"))


@query("WITH " + LINES_SQL + " SELECT id, x2 AS x, y2 AS y FROM lines")
def end_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = g.get_node("geom", "end")
    return lines(spark, sf_dir).select("id", node["x"].alias("x"), node["y"].alias("y"))


@query("WITH " + LINES_SQL + " SELECT id, x2 AS x, y2 AS y FROM lines")
def flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line turned round and put right again."""
    turned = lines(spark, sf_dir).withColumn("geom", F.when((F.col("id") % 3 == 0) & (F.col("id") * 2 > 100), F.reverse("geom")).otherwise(F.col("geom")))
    fixed = indexing.fix_flowdir(hy(turned))
    node = g.get_node("geom", "end")
    return fixed.select("id", node["x"].alias("x"), node["y"].alias("y"))


RAW_NAMES = ["COMID", "toCOMID", "LENGTHKM", "GNIS_name"]


@query(PATH_SQL + """SELECT id AS "COMID", toid AS "toCOMID", length_km AS "LENGTHKM", name AS "GNIS_name", pathlength_km FROM net""")
def names_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table under its own names through an operator: new columns come, the others keep their names."""
    net = hy(tree(spark, sf_dir).select("id", "toid", "length_km", "name").toDF(*RAW_NAMES))
    return hy_reverse(attributes.add_pathlength(net))


@query("""SELECT * FROM (VALUES ('COMID', 'id', true), ('ToNode', 'tonode', true), ('Hydroseq', 'topo_sort', true), ('LevelPathI', 'levelpath', true), ('TotDASqKM', 'total_da_sqkm', true),
  ('ArbolateSu', 'arbolate_sum', true), ('REACHCODE', 'aggregate_id', true), ('ToMeas', 'aggregate_id_to_measure', true), ('StreamOrde', 'stream_order', true), ('stream_level', 'stream_level', true),
  ('my_key', 'wbid', true), ('Other', 'Other', false)) t(given, known, is_defined)""")
def names_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the registry, one added to it, and one that it doesn't have."""
    alias_names({"My_Key": "wbid"})
    try:
        given = ["COMID", "ToNode", "Hydroseq", "LevelPathI", "TotDASqKM", "ArbolateSu", "REACHCODE", "ToMeas", "StreamOrde", "stream_level", "my_key", "Other"]
        known = align_names(spark.range(1).select(*[F.lit(0).alias(c) for c in given])).columns
    finally:
        alias_names(clear=True)
    return spark.createDataFrame([(a, b, b in name_definitions()) for a, b in zip(given, known, strict=True)], "given string, known string, is_defined boolean")


@query("""SELECT * FROM (VALUES ('tree', 'TOPO', true, true), ('nodes', 'NODE', false, true), ('junctions', 'FLOW', false, true), ('paths', 'LEVELED', true, true), ('ids', 'BASE', true, true),
  ('plain', 'TOPO', true, false)) t(network, kind, dendritic, is_network)""")
def network_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    several = {
        "tree": hy(tree(spark, sf_dir)), "nodes": hy(nodes(spark, sf_dir)), "junctions": topology.to_flownetwork(hy(nodes(spark, sf_dir))),
        "paths": leveled(spark, sf_dir), "ids": hy(tree(spark, sf_dir).select("id", "length_km")), "plain": tree(spark, sf_dir),
    }
    rows = [(name, network_type(x), is_dendritic(x), is_hy(x)) for name, x in several.items()]
    return spark.createDataFrame(rows, "network string, kind string, dendritic boolean, is_network boolean")


_INDEXED_SQL = "WITH " + NODES_SQL + ", i AS (SELECT id, row_number() OVER (ORDER BY id) AS indid FROM nodes)"


@query(_INDEXED_SQL + """SELECT f.id, a.indid, string_agg(DISTINCT CAST(coalesce(b.indid, 0) AS VARCHAR), ',' ORDER BY CAST(coalesce(b.indid, 0) AS VARCHAR)) AS ways,
  count(DISTINCT coalesce(b.indid, 0)) AS lengths FROM flow f JOIN i a USING (id) LEFT JOIN i b ON f.toid = b.id GROUP BY f.id, a.indid""")
def index_ids_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topology.format_index_ids(topology.make_index_ids(hy(nodes(spark, sf_dir))))
    return found.select("id", "indid", F.array_join(F.array_sort(F.transform("toindid", lambda x: x.cast("string"))), ",").alias("ways"), "lengths")


@query(_INDEXED_SQL + """SELECT i.id, i.indid, f.id AS fromid, coalesce(b.indid, 0) AS fromindid FROM i LEFT JOIN flow f ON f.toid = i.id LEFT JOIN i b ON f.id = b.id""")
def index_ids_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.make_index_ids(hy(nodes(spark, sf_dir)), mode="from").select("id", "indid", "fromid", "fromindid")


@query(_INDEXED_SQL + """SELECT 'to' AS direction, a.indid, coalesce(b.indid, 0) AS other FROM flow f JOIN i a USING (id) LEFT JOIN i b ON f.toid = b.id
UNION ALL SELECT 'from', i.indid, coalesce(b.indid, 0) FROM i LEFT JOIN flow f ON f.toid = i.id LEFT JOIN i b ON f.id = b.id""")
def index_ids_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.make_index_ids(hy(nodes(spark, sf_dir)), mode="both").select("direction", "indid", F.coalesce("toindid", "fromindid").alias("other"))


@query("WITH " + FOREST_SQL + " SELECT id, toid FROM forest")
def outlets_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets that each have a mark of their own get the common one."""
    own = forest(spark, sf_dir).withColumn("toid", F.when(F.col("toid") == 0, -F.col("id")).otherwise(F.col("toid")))
    return topology.check_hy_outlets(hy(own), fix=True).df.select("id", "toid")


@query(PATH_SQL.replace("CASE WHEN t.name = d.name THEN 1 ELSE 2 END, a.total_da_sqkm DESC", "a.total_da_sqkm * CASE WHEN t.name = d.name THEN 3 ELSE 1 END DESC") + "SELECT id, levelpath FROM net")
def levelpaths_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main paths by weight alone, three times that of features with the name below."""
    net = attributes.accumulate_downstream(hy(tree(spark, sf_dir)), "da_sqkm")
    net = net.with_df(net.df.withColumnRenamed("da_sqkm_accumulated", "total_da_sqkm").withColumn("topo_sort", F.col("id")))
    return attributes.add_levelpaths(net, "name", "total_da_sqkm", override_factor=3.0).df.select("id", "levelpath")


@query("WITH " + LINES_SQL + " SELECT id, toid, x2 AS x, y2 AS y FROM lines")
def geometry_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry that is put aside while a network is sorted, and put back by id."""
    net = hy(lines(spark, sf_dir).select("id", "toid", "geom"))
    aside = get_geometry(net)
    back = put_geometry(topology.sort_network(without_geometry(net)), aside)
    node = g.get_node("geom", "end")
    return back.df.select("id", "toid", node["x"].alias("x"), node["y"].alias("y"))


# The Albers projection by its definition on the ellipsoid.
ALBERS_SQL = """WITH c AS (SELECT 6378137.0 AS a, 2 / 298.257222101 - 1 / (298.257222101 * 298.257222101) AS e2, sqrt(2 / 298.257222101 - 1 / (298.257222101 * 298.257222101)) AS e
), p AS (SELECT p_partkey AS id, -120.0 + p_partkey % 50 AS lon, 25.0 + p_partkey % 24 AS lat FROM part
), s AS (
  SELECT id, lon, lat, a, e2, e, name, sin(radians(x)) AS s, cos(radians(x)) AS k FROM p, c, LATERAL (VALUES ('lat', lat), ('0', 23.0), ('1', 29.5), ('2', 45.5)) v(name, x)
), q AS (
  SELECT id, lon, lat, a, name, k * k / (1 - e2 * s * s) AS m2, (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) AS q FROM s
), w AS (
  SELECT id, lon, lat, max(a) AS a, max(q) FILTER (WHERE name = 'lat') AS q, max(q) FILTER (WHERE name = '0') AS q0, max(q) FILTER (WHERE name = '1') AS q1, max(q) FILTER (WHERE name = '2') AS q2,
         max(m2) FILTER (WHERE name = '1') AS m1, max(m2) FILTER (WHERE name = '2') AS m2 FROM q GROUP BY id, lon, lat
), n AS (SELECT *, (m1 - m2) / (q2 - q1) AS n FROM w), t AS (SELECT *, a * sqrt(m1 + n * q1 - n * q) / n AS rho, a * sqrt(m1 + n * q1 - n * q0) / n AS rho0, n * radians(lon + 96) AS theta FROM n)
"""


@query(ALBERS_SQL + "SELECT id, round(rho * sin(theta), 3) + 0 AS x, round(rho0 - rho * cos(theta), 3) AS y, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM t")
def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes and latitudes to metres, under the other table's geometry name, and back again."""
    k = F.col("p_partkey")
    at = _table(spark, sf_dir, "part").select(k.alias("id"), F.array(g.point(-120.0 + k % 50, 25.0 + k % 24)).alias("shape"))
    there = g.st_compatibalize(at, 4326, 5070, "shape", "geom")
    out = there.select("id", F.col("geom")[0].alias("p"), g.reprojected("geom", 5070, 4326)[0].alias("b"))
    return out.select("id", (F.round("p.x", 3) + 0).alias("x"), F.round("p.y", 3).alias("y"), F.round("b.x", 7).alias("lon"), F.round("b.y", 7).alias("lat"))


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV in the shared folder and read again."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).write.csv(path, header=True)
    return read_csv(spark, path, "id long, name string, price double")


@query("WITH " + LINES_SQL + """ SELECT id, toid, x0, y0, x2, y2, CASE WHEN id % 3 = 0 THEN 'polygon' WHEN id % 3 = 1 THEN 'line' ELSE 'point' END AS kind FROM lines""")
def geojson_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, polygons and points written as collections of GeoJSON features in the shared folder, and read again."""
    path = f"{checkpoint_dir(spark)}/geojson-{uuid.uuid4().hex}"
    rows = lines(spark, sf_dir).select("id", "toid", F.col("geom")[0].alias("a"), F.col("geom")[2].alias("b"))
    pair = lambda p: F.array(p["x"], p["y"])
    text = lambda x: F.to_json(F.struct(x.alias("c")))
    a, b = pair(F.col("a")), pair(F.col("b"))
    inner = lambda x: F.regexp_extract(text(x), r"^\{\"c\":(.*)\}$", 1)
    shape = F.when(F.col("id") % 3 == 0, F.concat(F.lit('"Polygon","coordinates":'), inner(F.array(F.array(a, b, a))))).when(
        F.col("id") % 3 == 1, F.concat(F.lit('"LineString","coordinates":'), inner(F.array(a, b)))
    ).otherwise(F.concat(F.lit('"Point","coordinates":'), inner(b)))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("id", "toid", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"))), F.lit(',"geometry":{"type":'), shape, F.lit("}}"))
    several = rows.groupBy(F.floor(F.col("id") / 1000).alias("file")).agg(F.array_join(F.collect_list(feature), ",").alias("features"))
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("features"), F.lit("]}"))
    several.select(collection.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = read_geojson(spark, path, "id long, toid long, x0 double, y0 double")
    end = F.coalesce(F.col("geom")[1], F.col("polygon")[0][1], F.col("point"))
    kind = F.when(F.col("geom").isNotNull(), "line").when(F.col("polygon").isNotNull(), "polygon").when(F.col("point").isNotNull(), "point")
    return read.select("id", "toid", "x0", "y0", end["x"].alias("x2"), end["y"].alias("y2"), kind.alias("kind"))


FLAGSHIP = "accumulate_total"
