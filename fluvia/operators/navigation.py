"""Navigation: reachable features, depth-first paths, main paths and tributaries, and paths between features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Kind, Network, edges_of, hy, need
from ..plans.iterate import Rounds, cut, reach, walk_to_root
from .topology import components, with_toid

DIRECTIONS = ("down", "up", "downmain", "upmain")


def _ways(x: DataFrame | Network, direction: str) -> DataFrame:
    """(src, dst) in the direction; main connections only for downmain and upmain."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    net = with_toid(hy(x), dendritic=False)
    df = net.df
    if direction.endswith("main"):
        need(net, [direction], f"navigation {direction}")
        df_main = df.filter(F.col(direction))
        edges = df_main.select(F.col("id").alias("src"), F.col("toid").alias("dst")).distinct().join(df.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    else:
        edges = edges_of(df)
    return edges if direction.startswith("down") else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _starts(x: DataFrame | Network, starts: list) -> DataFrame:
    df = hy(x).df
    rows = df.sparkSession.createDataFrame([(s,) for s in starts], df.select("id").schema)
    missing = rows.join(df.select("id"), "id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("all starts must be in the network")
    return rows


def reachable(x: DataFrame | Network, starts: list, direction: str = "down") -> DataFrame:
    """(start, id): the features that each start reaches in the direction, itself included; distributed."""
    rows = _starts(x, starts)
    return reach(cut(_ways(x, direction)), rows.select(F.col("id").alias("start"), "id"))


def navigate_network_dfs(x: DataFrame | Network, starts: list, direction: str = "down", reset: bool = False) -> DataFrame:
    """(start, path_id, seq, id): what each start reaches, split into paths as a depth-first walk takes them.

    At a branch the last connection (by id) is followed first. Ends of branches close a path. Without
    reset, later starts find visited features closed; with it each start walks anew. Only features that
    some start reaches are walked, one connected part of the network a task.
    """
    rows = _starts(x, starts)
    ways = cut(_ways(x, direction))
    found = cut(reach(ways, rows.select(F.lit(0).alias("start"), "id")).select("id").distinct())
    inside = ways.join(found, F.col("src") == F.col("id"), "left_semi")
    loose = found.select(F.col("id").alias("a"), F.col("id").alias("b"))
    part = components(inside.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(loose))
    # Which ends close a path: features whose way goes on outside the network or nowhere.
    net = with_toid(hy(x), dendritic=False).df
    kind = net.schema["id"].dataType.simpleString()
    if direction.startswith("down"):
        everything = net.select(F.col("id").alias("src"), F.col("toid").alias("dst"))
        known = net.select(F.col("id").alias("_k")).distinct()
        if direction == "downmain":
            everything = net.filter("downmain").select(F.col("id").alias("src"), F.col("toid").alias("dst"))
        everything = everything.join(found, F.col("src") == F.col("id"), "left_semi").join(known, F.col("dst") == F.col("_k"), "left").select("src", F.col("_k").alias("dst")).distinct()
    else:
        everything = inside
    table = found.join(everything, F.col("id") == F.col("src"), "left").groupBy("id").agg(F.collect_list(F.struct(F.coalesce(F.col("dst").cast("string"), F.lit("")).alias("to"))).alias("ways"), F.count("src").alias("n"))
    # Upstream, a headwater has nothing that closes a path; downstream, an outlet closes it.
    ways_to = F.col("ways.to") if direction.startswith("down") else F.filter("ways.to", lambda w: w != "")
    table = table.join(part, F.col("id") == F.col("node")).select("part", "id", F.col("id").cast("string").alias("key"), ways_to.alias("ways"))
    order = {str(s): k for k, s in enumerate(starts)}
    numeric, number = kind != "string", float if kind in ("float", "double") else int

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        value = (lambda k: number(k)) if numeric else (lambda k: k)
        ids = dict(zip(rows["key"], rows["id"], strict=True))
        ways = {k: sorted(w, key=lambda t: (t != "", value(t) if t else 0)) for k, w in zip(rows["key"], rows["ways"], strict=True)}
        out: list[tuple] = []
        closed: set[str] = set()
        used: set[tuple[str, str]] = set()
        path = 1
        for start in sorted((k for k in ids if k in order), key=order.get):
            if reset:
                closed, used = set(), set()
            stack, seq, wrote = [start], 0, False
            while stack:
                node = stack.pop()
                if node == "" or node in closed:
                    if wrote:
                        path, seq, wrote = path + 1, 0, False
                    continue
                closed.add(node)
                seq, wrote = seq + 1, True
                out.append((ids[start], path, seq, ids[node]))
                for to in ways[node]:
                    if (node, to) not in used:
                        used.add((node, to))
                        stack.append(to)
            if wrote:
                path += 1
        return pd.DataFrame(out, columns=["start", "path_id", "seq", "id"])

    return table.groupBy("part").applyInPandas(walk, f"start {kind}, path_id long, seq long, id {kind}")


MODES = {"upmain": "UM", "downmain": "DM", "up": "UT", "down": "DD"}


def navigate_hydro_network(x: DataFrame | Network, start, mode: str, distance: float | None = None) -> DataFrame:
    """(id): main path up (UM) or down (DM), tributaries up (UT) or diversions down (DD), within a distance in km.

    Works on the graph of main paths (levelpath): rounds count tributaries passed, and their rows are paths, not
    features. With a distance, UT goes on from features beyond it whose minor connection
    (dn_minor_topo_sort) leads to a feature within it, by the same distance from there.
    """
    net = hy(x)
    mode = MODES.get(mode, mode)
    if mode not in MODES.values():
        raise ValueError("mode must be UM, DM, UT or DD")
    columns = ["id", "levelpath", "topo_sort", "pathlength_km", "length_km"]
    columns += {"UM": [], "DM": ["dn_levelpath", "dn_topo_sort"], "UT": ["dn_topo_sort"], "DD": ["dn_levelpath", "dn_topo_sort"]}[mode]
    need(net, columns, f"navigation {mode}")
    minor = mode in ("UT", "DD") and net.has("dn_minor_topo_sort")
    df = cut(net.df.select(*columns, *(["dn_minor_topo_sort"] if minor else [])).distinct())
    first = df.filter(F.col("id") == start).collect()
    if len(first) != 1:
        raise ValueError("start must be one feature of the network")
    s = first[0]
    alone = df.sparkSession.createDataFrame([(start,)], df.select("id").schema)
    if distance is not None and (s["length_km"] > distance):
        return alone
    own = alone.select(F.lit(0).alias("start"), "id")
    if mode == "UM":
        found = df.filter((F.col("levelpath") == s["levelpath"]) & (F.col("topo_sort") >= s["topo_sort"]))
    elif mode == "UT" and distance is not None and minor:
        return _upstream_within(df, alone, distance)
    else:
        found = _spread(df, _path_links(df, minor), own, up=mode == "UT")
    if distance is not None and mode in ("UM", "UT"):
        found = found.filter(F.col("pathlength_km") <= s["pathlength_km"] - s["length_km"] + distance)
    elif distance is not None:
        found = found.filter(F.col("pathlength_km") + F.col("length_km") >= s["pathlength_km"] + s["length_km"] - distance)
    return found.select("id").distinct()


def _path_links(df: DataFrame, minor: bool) -> DataFrame:
    """(above, above_at, below, below_at): where a path, at a feature's topo_sort, flows to a feature of another path."""
    ways = df.select(F.col("levelpath").alias("above"), F.col("topo_sort").alias("above_at"), F.col("dn_topo_sort").alias("below_at"))
    if minor:
        ways = ways.union(df.select("levelpath", "topo_sort", "dn_minor_topo_sort"))
    to = df.select(F.col("topo_sort").alias("_t"), F.col("levelpath").alias("below")).distinct()
    return cut(ways.join(to, F.col("below_at") == F.col("_t")).filter("above <> below").select("above", "above_at", "below", "below_at").distinct())


def _spread(df: DataFrame, links: DataFrame, starts: DataFrame, up: bool) -> DataFrame:
    """(start, *df.columns) of all that (start, id) rows reach along whole paths and links between them, up or down.

    A path is known by how far it is taken: from a topo_sort upward (up), or down from one.
    """
    if not up:
        links = links.select(F.col("below").alias("above"), F.col("below_at").alias("above_at"), F.col("above").alias("below"), F.col("above_at").alias("below_at"))
    end = F.min if up else F.max
    beyond = (lambda a, b: a >= b) if up else (lambda a, b: a <= b)
    begin = df.join(starts.select("start", F.col("id").alias("_s")), F.col("id") == F.col("_s")).select("start", F.col("levelpath").alias("path"), F.col("topo_sort").alias("end"))
    taken = Rounds(df.sparkSession, begin.schema)
    frontier = taken.append(begin.groupBy("start", "path").agg(end("end").alias("end")))
    while not frontier.isEmpty():
        known = taken.all().groupBy("start", "path").agg(end("end").alias("end")).select(F.col("start").alias("_s"), F.col("path").alias("_p"), F.col("end").alias("_e"))
        step = frontier.join(links, (F.col("path") == F.col("below")) & beyond(F.col("below_at"), F.col("end"))).groupBy("start", "above").agg(end("above_at").alias("end"))
        step = step.join(known, (F.col("start") == F.col("_s")) & (F.col("above") == F.col("_p")), "left").filter(F.col("_e").isNull() | ~beyond(F.col("end"), F.col("_e")))
        frontier = taken.append(step.select("start", F.col("above").alias("path"), "end"))
    known = taken.all().groupBy("start", "path").agg(end("end").alias("end"))
    return df.join(known, (F.col("levelpath") == F.col("path")) & beyond(F.col("topo_sort"), F.col("end"))).select("start", *df.columns)


def _upstream_within(df: DataFrame, start: DataFrame, distance: float) -> DataFrame:
    """(id): what lies within the distance upstream, and of what flows there by minor connections only, likewise."""
    links = _path_links(df, False)
    begun, found = Rounds(df.sparkSession, start.schema), Rounds(df.sparkSession, start.schema)
    frontier = begun.append(start)
    while not frontier.isEmpty():
        facts = df.join(frontier.select(F.col("id").alias("start")), F.col("id") == F.col("start"))
        short = facts.filter(F.col("length_km") > distance).select("id")
        limits = facts.filter(F.col("length_km") <= distance).select("start", "id", (F.col("pathlength_km") - F.col("length_km") + distance).alias("_far"))
        reached = _spread(df, links, limits.select("start", "id"), up=True)
        reached = cut(reached.join(limits.select(F.col("start").alias("_s"), "_far"), F.col("start") == F.col("_s")).withColumn("near", F.col("pathlength_km") <= F.col("_far")))
        near = reached.filter("near")
        found.append(near.select("id").union(short).distinct())
        at = near.select(F.col("start").alias("_s2"), F.col("topo_sort").alias("_t"))
        more = reached.filter("not near").join(at, (F.col("start") == F.col("_s2")) & (F.col("dn_minor_topo_sort") == F.col("_t")), "left_semi")
        frontier = begun.append(more.select("id").distinct().join(begun.all(), "id", "left_anti"))
    return found.all().distinct()


def navigate_connected_paths(x: DataFrame | Network, outlets: list | tuple[list, list]) -> DataFrame:
    """(indid_1, indid_2, path, distance): the features between pairs of features of a dendritic network.

    All combinations of a list, pairs of two lists of equal length, or all of one with all of the other.
    A path is what lies below one of the two but not both; pairs without a common end have none.
    """
    net = with_toid(hy(x))
    if net.kind is Kind.FLOW or not net.df.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("paths between features need a dendritic network")
    need(net, ["id", "toid", "length_km"], "navigate_connected_paths")
    df = net.df
    if isinstance(outlets, tuple):
        a, b = outlets
        pairs = list(zip(a, b, strict=True)) if len(a) == len(b) else [(i, j) for i in a for j in b]
    else:
        pairs = [(i, j) for k, i in enumerate(outlets) for j in outlets[k + 1 :]]
    spark = df.sparkSession
    kind = df.schema["id"].dataType.simpleString()
    wanted = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], f"pair long, id_1 {kind}, id_2 {kind}")
    starts = sorted({i for p in pairs for i in p})
    found = reachable(Network(df, net.kind), starts, "down")
    ids = df.select(F.col("id").alias("_k"))
    ends = df.join(ids, F.col("toid") == F.col("_k"), "left_anti").select(F.col("id").alias("_e"))
    # A start is on its own way down only if it is the end.
    terminal = found.join(ends, F.col("id") == F.col("_e"), "left_semi").select(F.col("start").alias("_s"), F.col("id").alias("terminal"))
    lists = cut(found.join(terminal, F.col("start") == F.col("_s")).filter((F.col("id") != F.col("start")) | (F.col("id") == F.col("terminal"))).select("start", "id", "terminal"))
    size = lists.groupBy("start").agg(F.count("*").alias("n"), F.first("terminal").alias("terminal"))
    l1, l2 = (size.select(F.col("start").alias(f"_s{k}"), F.col("n").alias(f"n{k}"), F.col("terminal").alias(f"t{k}")) for k in (1, 2))
    both = wanted.join(l1, F.col("id_1") == F.col("_s1")).join(l2, F.col("id_2") == F.col("_s2")).filter("t1 = t2")
    sides = both.select("pair", "id_1", "id_2", "n1", "n2", F.col("id_1").alias("_from"), F.lit(1).alias("side")).union(both.select("pair", "id_1", "id_2", "n1", "n2", F.col("id_2"), F.lit(2)))
    steps = sides.join(lists.select("start", "id"), F.col("_from") == F.col("start"))
    kept = steps.groupBy("pair", "id_1", "id_2", "n1", "n2", "id").agg(F.count("*").alias("c"), F.max("side").alias("side"))
    # A list of one feature gives the other list whole.
    keep = F.when((F.col("n1") == 1) | (F.col("n2") == 1), F.when(F.col("n1") == 1, (F.col("c") == 2) | (F.col("side") == 2)).otherwise((F.col("c") == 2) | (F.col("side") == 1))).otherwise(F.col("c") == 1)
    path = kept.filter(keep).join(df.select(F.col("id").alias("_i"), "length_km"), F.col("id") == F.col("_i"))
    out = path.groupBy("pair", "id_1", "id_2").agg(F.array_sort(F.collect_set("id")).alias("path"), F.sum("length_km").alias("network_distance_km"))
    return out.select("id_1", "id_2", "path", "network_distance_km")


def rescaled(measure, from_, to):
    """A measure of an aggregate feature as one (0 to 100) of a feature that spans from_ to to; null beyond 0.1."""
    m, a, b = (F.col(c) if isinstance(c, str) else c for c in (measure, from_, to))
    near = F.when(m.between(a, b), m).when((a > m) & (F.round(a - m, 1) <= 0.1), a).when((m > b) & (F.round(m - b, 1) <= 0.1), b)
    return F.when(a == b, F.lit(None).cast("double")).otherwise(F.lit(100.0) * (near - a) / (b - a))


def get_partial_length(locations: DataFrame, network: DataFrame | Network) -> DataFrame:
    """locations with dn and up: the feature's length below and above each location."""
    net = hy(network)
    need(net, ["aggregate_id", "aggregate_id_from_measure", "aggregate_id_to_measure", "length_km"], "get_partial_length")
    own = hy(locations).df
    lines = net.df.select(F.col("aggregate_id").alias("_a"), F.col("aggregate_id_from_measure").alias("_from"), F.col("aggregate_id_to_measure").alias("_to"), F.col("length_km").alias("_len"))
    m = F.col("aggregate_id_measure")
    inside = (m >= F.col("_from")) & ((m < F.col("_to")) | ((m == 100) & (F.col("_to") == 100)))
    joined = own.join(lines, (F.col("aggregate_id") == F.col("_a")) & inside)
    part = rescaled(m, F.col("_from"), F.col("_to")) / 100
    return joined.withColumn("dn", F.col("_len") * part).withColumn("up", F.col("_len") * (1 - part)).drop("_a", "_from", "_to", "_len")


def downstream_sums(x: DataFrame | Network, columns: list[str]) -> DataFrame:
    """(id, root, depth, *columns): the outlet of each feature and totals of the columns on the way there."""
    net = hy(x)
    return walk_to_root(net.df.select("id", F.col("toid").alias("parent"), *columns), columns)
