"""Derived attributes: accumulation, path length, main paths, orders, levels, divergences, Pfafstetter codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..network import Kind, Network, edges_of, get_geometry, given_back, hy, need, put_geometry, without_geometry
from ..plans.iterate import by_levels, closure, cut, forest_sums, reach, reach_set, walk_to_root
from .topology import add_toids, add_topo_sort, with_toid


def accumulate_downstream(x: DataFrame | Network, var: str, total: bool = False) -> Network | DataFrame:
    """x with <var>_accumulated: what comes from upstream, the feature's own value included.

    Dendritic (the default): nothing flows into diversions (divergence 2). With divergence_fraction on a
    junction table, the receiving feature takes its fraction. total counts every feature upstream
    once, along all connections.
    """
    net = hy(x)
    var = var if net.has(var) else net.df.columns[[c.lower() for c in net.df.columns].index(var.lower())] if var.lower() in [c.lower() for c in net.df.columns] else var
    need(net, ["id", var], "accumulate_downstream")
    full = with_toid(net, dendritic=False)
    df = full.df
    facts = df.groupBy("id").agg(F.max(var).cast("double").alias("_w"), *([F.max("divergence").alias("_div")] if full.has("divergence") else []))
    facts = cut(facts)
    edges = edges_of(df)
    if total:
        sums = _total_sums(facts, edges)
    elif full.kind is Kind.FLOW and full.has("divergence_fraction"):
        fraction = df.groupBy("id").agg(F.coalesce(F.max("divergence_fraction"), F.lit(1.0)).alias("_f"))
        sums = _by_levels(facts.join(fraction, "id"), edges)
    else:
        if full.has("divergence"):
            main = facts.filter("_div is null or _div <> 2").select(F.col("id").alias("dst"))
            edges = edges.join(main, "dst", "left_semi").select("src", "dst")
        edges = cut(edges)
        if edges.groupBy("src").count().filter("count > 1").isEmpty():
            parents = facts.join(edges, F.col("id") == F.col("src"), "left").select("id", F.col("dst").alias("parent"), F.col("_w").alias("_acc"))
            sums = forest_sums(parents, ["_acc"])
        else:
            sums = _by_levels(facts.withColumn("_f", F.lit(1.0)), edges)
    out = net.df.join(sums.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id").withColumnRenamed("_acc", f"{var}_accumulated")
    return given_back(x, net.with_df(out))


def bridge_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) edges of an acyclic graph in two tables: those whose removal parts all above from the rest, and the others.

    The least way down of each id makes a forest. Every other edge puts a random number on both its ends; an
    edge of the forest lies on no cycle if the numbers above it cancel out in an exclusive or.
    """
    edges = cut(edges)
    tree = edges.groupBy("src").agg(F.min("dst").alias("parent"))
    rest = cut(edges.join(tree.withColumnRenamed("src", "_s"), (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("parent")), "left_anti"))
    marks = rest.withColumn("_x", F.xxhash64("src", "dst"))
    marks = marks.select(F.col("src").alias("_n"), "_x").union(marks.select("dst", "_x")).groupBy("_n").agg(F.bit_xor("_x").alias("_x"))
    own = nodes.select("id").join(tree, F.col("id") == F.col("src"), "left").join(marks, F.col("id") == F.col("_n"), "left")
    crossed = forest_sums(own.select("id", "parent", F.coalesce("_x", F.lit(0).cast("long")).alias("_x")), ["_x"], F.bit_xor)
    tree = tree.join(crossed, F.col("src") == F.col("id")).select("src", F.col("parent").alias("dst"), (F.col("_x") == 0).alias("alone"))
    tree = cut(tree)
    return tree.filter("alone").select("src", "dst"), rest.union(tree.filter("not alone").select("src", "dst"))


def _total_sums(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, _acc): the sum over all ids that reach each id, itself included, each counted once.

    Pairs are made only between ids that cycles join. All else comes over bridges, and the sums above two of
    them have nothing in common: these are added up by doubling along the bridges.
    """
    bridges, others = bridge_edges(facts, edges)
    same = facts.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    inside = cut(closure(others).union(same))
    base = cut(inside.join(facts.select(F.col("id").alias("_i"), "_w"), F.col("src") == F.col("_i")).groupBy(F.col("dst").alias("id")).agg(F.sum("_w").alias("_acc")))
    # Of ids that end at a bridge: the next such ids that they reach behind it.
    ends = bridges.select(F.col("src").alias("_b"))
    ways = bridges.join(inside.select(F.col("src").alias("_in"), F.col("dst").alias("_at")), F.col("dst") == F.col("_in")).join(ends, F.col("_at") == F.col("_b")).select("src", F.col("_at").alias("dst"))
    ways = cut(ways)
    now = cut(base.join(ends, F.col("id") == F.col("_b"), "left_semi"))
    while not ways.isEmpty():
        more = ways.join(now, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("_d")).agg(F.sum("_acc").alias("_more"))
        now = cut(now.join(more, F.col("id") == F.col("_d"), "left").select("id", (F.col("_acc") + F.coalesce("_more", F.lit(0.0))).alias("_acc")))
        ways = cut(ways.join(ways.select(F.col("src").alias("_m"), F.col("dst").alias("_n")), F.col("dst") == F.col("_m")).select("src", F.col("_n").alias("dst")))
    brought = bridges.join(now, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("_in")).agg(F.sum("_acc").alias("_from"))
    brought = inside.join(brought, F.col("src") == F.col("_in")).groupBy(F.col("dst").alias("_d")).agg(F.sum("_from").alias("_from"))
    return base.join(brought, F.col("id") == F.col("_d"), "left").select("id", (F.col("_acc") + F.coalesce("_from", F.lit(0.0))).alias("_acc"))


def _by_levels(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """own + fraction * sum of what flows in, level by level from the headwaters down."""

    def step(here: DataFrame, given: DataFrame | None) -> DataFrame:
        if given is None:
            return here.select("id", F.col("_w").alias("_acc"))
        more = given.groupBy("dst").agg(F.sum("_acc").alias("_in"))
        return here.join(more, F.col("id") == F.col("dst"), "left").select("id", (F.col("_w") + F.col("_f") * F.coalesce("_in", F.lit(0.0))).alias("_acc"))

    return by_levels(facts, cut(edges), step)


def add_pathlength(x: DataFrame | Network) -> Network | DataFrame:
    """pathlength_km: length of all features below each one."""
    net = hy(x)
    need(net, ["id", "toid", "length_km"], "add_pathlength")
    if net.kind is Kind.FLOW:
        raise ValueError("path length needs one way down for each feature")
    df = net.df
    walked = walk_to_root(df.select("id", F.col("toid").alias("parent"), F.col("length_km").cast("double").alias("_sum")), ["_sum"])
    out = df.drop("pathlength_km").join(walked.select(F.col("id").alias("_id"), "_sum"), F.col("id") == F.col("_id"), "left")
    return given_back(x, net.with_df(out.withColumn("pathlength_km", F.col("_sum") - F.col("length_km")).drop("_id", "_sum")))


def add_levelpaths(
    x: DataFrame | Network, name_attribute: str, weight_attribute: str, override_factor: float | None = None
) -> Network | DataFrame:
    """levelpath, levelpath_outlet_id (and topo_sort): main paths by name, then weight.

    Of the features that flow to one, that continues the path which has its name; else a named one;
    else, and between equals, that of the largest weight, then the smallest topo_sort. With
    override_factor only weights count, those of features with the name below times the factor.
    """
    net = hy(x)
    aside = get_geometry(net)
    net = with_toid(without_geometry(net))
    name, weight = (next((c for c in net.df.columns if c == a or c.lower() == a.lower()), a) for a in (name_attribute, weight_attribute))
    need(net, ["id", "toid", name, weight], "add_levelpaths")
    if not net.has("topo_sort"):
        net = add_topo_sort(net)
    df = cut(net.df.drop("levelpath", "levelpath_outlet_id"))
    blank = lambda c: F.when(F.col(c).isNull() | F.trim(F.col(c).cast("string")).isin("", "-1"), F.lit(None)).otherwise(F.col(c).cast("string"))
    rows = df.select("id", "toid", "topo_sort", blank(name).alias("_name"), F.col(weight).cast("double").alias("_weight"), *(["divergence"] if "divergence" in df.columns else [])).distinct()
    below = rows.select(F.col("id").alias("_d"), F.col("_name").alias("_dn_name"), *([F.col("divergence").alias("_dn_div")] if "divergence" in df.columns else []))
    rows = rows.join(below, F.col("toid") == F.col("_d"), "left")
    if "divergence" in df.columns:
        rows = rows.withColumn("_d", F.when(F.coalesce(F.col("_dn_div") > 1, F.lit(False)), F.lit(None)).otherwise(F.col("_d")))
    same = F.col("_name").isNotNull() & F.coalesce(F.col("_name") == F.col("_dn_name"), F.lit(False))
    priority = F.when(same, 1).when(F.col("_name").isNotNull(), 2).otherwise(3)
    order = [priority, F.col("_weight").desc_nulls_last()]
    if override_factor is not None:
        order = [F.when(same, F.col("_weight") * override_factor).otherwise(F.col("_weight")).desc_nulls_last()]
    w = Window.partitionBy("_d").orderBy(*order, F.col("topo_sort"), F.col("id"))
    parent = rows.filter("_d is not null").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(F.col("id").alias("_p"), F.col("_d").alias("parent"))
    ids = rows.groupBy("id").agg(F.min("topo_sort").alias("topo_sort"))
    walked = walk_to_root(ids.join(parent, F.col("id") == F.col("_p"), "left").select("id", "parent"))
    ends = ids.select(F.col("id").alias("_r"), F.col("topo_sort").alias("levelpath"))
    paths = walked.join(ends, F.col("root") == F.col("_r")).select(F.col("id").alias("_id"), F.col("root").alias("levelpath_outlet_id"), "levelpath")
    out = cut(df.join(paths.hint("merge"), F.col("id") == F.col("_id")).drop("_id"))
    first = ["id", "toid", "levelpath_outlet_id", "topo_sort", "levelpath"]
    return given_back(x, put_geometry(net.with_df(out.select(*first, *[c for c in out.columns if c not in first])), aside))


def add_streamlevel(x: DataFrame | Network, coastal: str | None = None) -> Network | DataFrame:
    """stream_level: 1 for paths that end a network (4 where coastal is false), one more for each tributary."""
    net = hy(x)
    need(net, ["levelpath", "dn_levelpath"], "add_streamlevel")
    columns = [F.col("levelpath").alias("id"), F.coalesce("dn_levelpath", F.lit(0)).alias("parent"), *([F.col(coastal)] if coastal else [])]
    paths = cut(net.df.select(*columns).filter("id <> parent").distinct())
    walked = walk_to_root(paths.select("id", "parent").distinct())
    base = paths.select(F.col("id").alias("_r"), (F.when(F.col(coastal), 1).otherwise(4) if coastal else F.lit(1)).alias("_base")).groupBy("_r").agg(F.min("_base").alias("_base"))
    level = walked.join(base, F.col("root") == F.col("_r")).select(F.col("id").alias("_id"), (F.col("_base") + F.col("depth")).cast("long").alias("stream_level"))
    return given_back(x, net.with_df(net.df.join(level, F.col("levelpath") == F.col("_id"), "left").drop("_id")))


def add_streamorder(x: DataFrame | Network) -> Network | DataFrame:
    """stream_order and stream_calculator: Strahler order that diversions (divergence 2) pass on but never raise.

    Level by level from the headwaters, all features of a level at once.
    """
    net = hy(x)
    if net.has("stream_order"):
        raise ValueError("the network already has stream_order")
    full = with_toid(net, dendritic=False)
    need(full, ["id", "toid"], "add_streamorder")
    div = F.coalesce(F.col("divergence") == 2, F.lit(False)) if full.has("divergence") else F.lit(False)
    edges = cut(edges_of(full.df))
    rows = full.df.groupBy("id").agg(F.max(div).alias("_minor"))

    def step(here: DataFrame, above: DataFrame | None) -> DataFrame:
        if above is None:
            return here.select("id", F.lit(1).cast("long").alias("order"), F.when(F.col("_minor"), 0).otherwise(1).cast("long").alias("calc"))
        seen = above.groupBy("dst").agg(
            F.max("order").alias("_all_max"),
            F.max(F.when(F.col("calc") > 0, F.col("order"))).alias("_main_max"),
            F.min("calc").alias("_least"), F.max("calc").alias("_most"),
            F.array_agg("order").alias("_orders"),
        )
        zeros = F.col("_least") == 0
        most = F.when(zeros & (F.col("_most") > 0), F.col("_main_max")).otherwise(F.col("_all_max"))
        at_most = F.size(F.filter("_orders", lambda o: o == F.col("_max")))
        found = here.join(seen.withColumn("_max", most), F.col("id") == F.col("dst"))
        raised = ~F.col("_minor") & (at_most >= 2) & ~zeros
        return found.select(
            "id", F.when(raised, F.col("_max") + 1).otherwise(F.col("_max")).alias("order"),
            F.when(F.col("_minor"), 0).when(raised, F.col("_max") + 1).when(F.col("_most") > 0, F.col("_max")).otherwise(0).cast("long").alias("calc"),
        )

    done = by_levels(rows, edges, step)
    orders = done.select(F.col("id").alias("_id"), F.col("order").alias("stream_order"), F.col("calc").alias("stream_calculator"))
    return given_back(x, net.with_df(net.df.join(orders, F.col("id") == F.col("_id"), "left").drop("_id")))


def add_pfafstetter(x: DataFrame | Network, max_level: int = 2) -> Network | DataFrame:
    """pf_level_1 .. pf_level_<max_level>: codes by the four largest tributaries of each main path, repeatedly.

    All basins of a level are coded at once: windows over the tributaries of each basin's main path.
    """
    net = hy(x)
    need(net, ["id", "toid", "total_da_sqkm", "topo_sort", "levelpath"], "add_pfafstetter")
    rows = cut(net.df.select("id", "toid", "total_da_sqkm", "topo_sort", "levelpath").distinct())
    path_of = rows.select(F.col("id").alias("_d"), F.col("levelpath").alias("_dn_path"), F.col("topo_sort").alias("_dn_sort"))
    tribs = cut(rows.join(path_of, F.col("toid") == F.col("_d")).filter("levelpath <> _dn_path").select("levelpath", "total_da_sqkm", "_dn_path", "_dn_sort"))
    outlet = rows.agg(F.min_by("levelpath", "topo_sort").alias("p")).first()
    spark = net.df.sparkSession
    # Basins to be cut: part of a path (lo, hi] in topo_sort, with the code so far.
    schema = "path long, lo double, hi double, parent long"
    todo = spark.createDataFrame([] if outlet is None or outlet["p"] is None else [(int(outlet["p"]), float("-inf"), float("inf"), 0)], schema)
    coded = None
    for level in range(1, max_level + 1):
        own = todo.join(tribs, (F.col("path") == F.col("_dn_path")) & (F.col("_dn_sort") > F.col("lo")) & (F.col("_dn_sort") <= F.col("hi")))
        w = Window.partitionBy("path", "parent", "lo")
        top = own.withColumn("_rank", F.rank().over(w.orderBy(F.col("total_da_sqkm").desc()))).filter("_rank <= 4")
        # Tributaries in order upstream; the main path is cut where each comes in.
        top = top.withColumn("_k", F.row_number().over(w.orderBy("_dn_sort", "levelpath")).cast("long"))
        top = cut(top.select("path", "lo", "hi", "parent", "_k", "_dn_sort", F.col("levelpath").alias("_trib")))
        evens = top.select(F.col("_trib").alias("path"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), (F.col("parent") * 10 + 2 * F.col("_k")).alias("parent"))
        cuts = top.withColumn("_prev", F.coalesce(F.lag("_dn_sort").over(w.orderBy("_k")), F.col("lo")))
        odds = cuts.select("path", F.col("_prev").cast("double").alias("lo"), F.col("_dn_sort").cast("double").alias("hi"), (F.col("parent") * 10 + 2 * F.col("_k") - 1).alias("parent"))
        last = top.groupBy("path", "lo", "hi", "parent").agg(F.max("_k").alias("_n"), F.max("_dn_sort").alias("_top"))
        open_end = last.select("path", F.col("_top").cast("double").alias("lo"), "hi", (F.col("parent") * 10 + 2 * F.col("_n") + 1).alias("parent"))
        parts = cut(evens.union(odds).union(open_end))
        members = rows.join(parts, (F.col("levelpath") == F.col("path")) & (F.col("topo_sort") > F.col("lo")) & (F.col("topo_sort") <= F.col("hi")))
        found = members.groupBy("id").agg(F.max("parent").alias(f"_{level}"))
        coded = found if coded is None else coded.join(found, "id", "full")
        todo = parts
    out = rows.select("id").distinct() if coded is None else coded
    for level in range(1, max_level + 1):
        if f"_{level}" not in out.columns:
            out = out.withColumn(f"_{level}", F.lit(None).cast("long"))
    # Missing deeper codes are the basin's first; missing shallower ones follow from the deeper.
    for level in range(max_level - 1, 0, -1):
        out = out.withColumn(f"_{level}", F.coalesce(f"_{level}", F.floor(F.col(f"_{level + 1}") / 10)))
    for level in range(2, max_level + 1):
        out = out.withColumn(f"_{level}", F.coalesce(F.col(f"_{level}"), F.col(f"_{level - 1}") * 10 + 1))
    names = {f"_{k}": f"pf_level_{k}" for k in range(1, max_level + 1)}
    return given_back(x, net.with_df(net.df.join(out.withColumnsRenamed(names | {"id": "_id"}), F.col("id") == F.col("_id"), "left").drop("_id")))


def add_divergence(
    x: DataFrame | Network, coastal_outlet_ids: list, inland_outlet_ids: list, name_attr: str, type_attr: str, major_types: list
) -> Network | DataFrame:
    """divergence: of features that start at one node 1 for the main one and 2 for the others; 0 elsewhere.

    One feature upstream stands for the node: the only named one, else the one whose name goes on
    below, else that of a major type, else the most frequent name's, else the least id. Then, among
    the features below, the first rule that picks exactly one decides.
    """
    net = hy(x)
    name, kind = (next((c for c in net.df.columns if c == a or c.lower() == a.lower()), a) for a in (name_attr, type_attr))
    need(net, ["id", "fromnode", "tonode", name, kind], "add_divergence")
    blank = F.when(F.trim(F.col(name).cast("string")).isin("", "-1"), F.lit(None)).otherwise(F.col(name).cast("string"))
    rows = cut(net.df.select("id", "fromnode", "tonode", blank.alias("nm"), F.coalesce(F.col(kind).isin(major_types), F.lit(False)).alias("major")).distinct())
    ends = rows.join(rows.select(F.col("fromnode").alias("_f")).distinct(), F.col("tonode") == F.col("_f"), "left_anti").select("id")
    told = [*coastal_outlet_ids, *inland_outlet_ids]
    if not ends.filter(~F.col("id").isin(told) if told else F.lit(True)).isEmpty():
        raise ValueError("every terminal feature must be a coastal or an inland outlet")
    back = rows.select(F.col("id").alias("dst"), "tonode").join(rows.select(F.col("id").alias("src"), "fromnode"), F.col("tonode") == F.col("fromnode")).select("src", "dst")
    start = net.df.sparkSession.createDataFrame([(i,) for i in coastal_outlet_ids], rows.select("id").schema)
    coast = reach_set(back, start).withColumn("coastal", F.lit(True)).withColumnRenamed("id", "_c")
    rows = cut(rows.join(coast, F.col("id") == F.col("_c"), "left").drop("_c").withColumn("coastal", F.coalesce("coastal", F.lit(False))))
    split = rows.groupBy("fromnode").count().filter("count > 1").select(F.col("fromnode").alias("node"))
    down = cut(rows.join(split, F.col("fromnode") == F.col("node")).select("node", "id", "nm", "major", "coastal"))
    frequent = rows.filter("nm is not null").groupBy(F.col("nm").alias("_nm")).agg(F.count("*").alias("times"))
    up = rows.join(split, F.col("tonode") == F.col("node")).select("node", "id", "nm", "major").join(frequent, F.col("nm") == F.col("_nm"), "left").drop("_nm")
    goes_on = down.filter("nm is not null").select(F.col("node").alias("_n"), F.col("nm").alias("_m")).distinct()
    up = up.join(goes_on, (F.col("node") == F.col("_n")) & (F.col("nm") == F.col("_m")), "left").withColumn("goes_on", F.col("_m").isNotNull()).drop("_n", "_m")
    chosen = _only(up, "node", [F.col("nm").isNotNull(), F.col("goes_on"), F.col("major")])
    best = up.groupBy("node").agg(F.max_by("nm", F.struct(F.coalesce("times", F.lit(0)))).alias("often"), F.max("times").alias("m"), F.min_by("nm", "id").alias("least_nm"))
    tops = up.join(best.select(F.col("node").alias("_n"), "m"), (F.col("node") == F.col("_n")) & (F.col("times") == F.col("m"))).groupBy(F.col("node").alias("_t")).agg(F.countDistinct("nm").alias("k"), F.max("nm").alias("top_nm"))
    stands = best.join(tops, F.col("node") == F.col("_t"), "left").join(chosen.select(F.col("node").alias("_c"), F.col("pick")), F.col("node") == F.col("_c"), "left")
    named = up.select(F.col("node").alias("_u"), F.col("id").alias("_i"), F.col("nm").alias("picked_nm"))
    stands = stands.join(named, (F.col("node") == F.col("_u")) & (F.col("pick") == F.col("_i")), "left")
    up_name = F.when(F.col("pick").isNotNull(), F.col("picked_nm")).when(F.col("k") == 1, F.col("top_nm")).otherwise(F.col("least_nm"))
    stands = stands.select(F.col("node").alias("_s"), up_name.alias("up_nm"))
    down = down.join(stands, F.col("node") == F.col("_s"), "left").drop("_s")
    winners = down_level(down, "node")
    flags = down.select("node", "id").join(winners, "node").select(F.col("id").alias("_id"), F.col("node").alias("_from"), F.when(F.col("id") == F.col("pick"), 1).otherwise(2).alias("divergence"))
    out = net.df.drop("divergence").join(flags, (F.col("id") == F.col("_id")) & (F.col("fromnode") == F.col("_from")), "left").drop("_id", "_from").withColumn("divergence", F.coalesce("divergence", F.lit(0)).cast("int"))
    return given_back(x, net.with_df(out))


def _only(df: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    """(key, pick): the id that the first rule fitting exactly one row of the key picks; null if none does."""
    flags = df.select(key, "id", *[F.coalesce(r, F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)])
    out = flags.groupBy(key).agg(*[F.when(F.count_if(f"r{k}") == 1, F.max(F.when(F.col(f"r{k}"), F.col("id")))).alias(f"p{k}") for k in range(len(rules))])
    return out.select(key, F.coalesce(*[f"p{k}" for k in range(len(rules))]).alias("pick"))


def down_level(down: DataFrame, key: str) -> DataFrame:
    """(key, pick): the main one of the features below a node, of rows (key, id, nm, major, coastal, up_nm).

    Ten rules in order, each of which decides if it fits exactly one feature; then the least id.
    """
    w = Window.partitionBy(key)
    some = lambda c: F.max(c).over(w)
    named, same = F.col("nm").isNotNull(), F.coalesce(F.col("nm") == F.col("up_nm"), F.lit(False))
    any_named, any_major, any_coast = some(named), some(F.col("major")), some(F.col("coastal"))
    down = down.select(key, "id", "nm", "major", "coastal", same.alias("same"), any_named.alias("an"), any_major.alias("am"), any_coast.alias("ac"))
    named, same, major, coast = F.col("nm").isNotNull(), F.col("same"), F.col("major"), F.col("coastal")
    rules = [
        same & major & coast, same & major, same,
        named & major & coast,
        ~F.col("an") & major & coast,
        named & coast,
        coast,
        named & ~F.col("ac") & F.col("am"),
        major,
        named & ~F.col("ac"),
    ]
    least = down.groupBy(F.col(key).alias("_k")).agg(F.min("id").alias("_least"))
    return _only(down, key, rules).join(least, F.col(key) == F.col("_k")).select(key, F.coalesce("pick", "_least").alias("pick"))


def add_return_divergence(x: DataFrame | Network) -> Network | DataFrame:
    """return_divergence: 1 where flow that a diversion took off comes back to its main path.

    For each divergence: of what the diversions reach, the features that flow to what the main feature
    reaches, without being reached by it, where that is furthest upstream.
    """
    net = hy(x)
    need(net, ["id", "fromnode", "tonode", "divergence"], "add_return_divergence")
    rows = net.df.select("id", "fromnode", "tonode", "divergence").distinct()
    flow = add_topo_sort(add_toids(Network(rows, Kind.NODE), return_dendritic=False))
    df = cut(flow.df)
    edges = cut(edges_of(df))
    split = rows.groupBy("fromnode").count().filter("count > 1").select(F.col("fromnode").alias("_n"))
    starts = cut(rows.join(split, F.col("fromnode") == F.col("_n")).select(F.col("fromnode").alias("node"), "id", "divergence"))
    main = reach(edges, starts.filter("divergence = 1").select(F.col("node").alias("start"), "id"))
    minor = reach(edges, starts.filter("divergence = 2").select(F.col("node").alias("start"), "id"))
    off = minor.join(main, ["start", "id"], "left_anti").join(edges, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"))
    back = off.join(main, ["start", "id"], "left_semi")
    order = df.select(F.col("id").alias("_i"), "topo_sort").distinct()
    first = back.join(order, F.col("id") == F.col("_i")).groupBy("start").agg(F.max_by("id", "topo_sort").alias("_r")).select("_r").distinct()
    out = net.df.join(first, F.col("id") == F.col("_r"), "left").withColumn("return_divergence", F.when(F.col("_r").isNotNull(), 1).otherwise(0)).drop("_r")
    return given_back(x, net.with_df(out))
