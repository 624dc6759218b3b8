"""Names, kinds, capabilities and outlet rules."""

import pytest

from fluvia import network as n
from fluvia.operators import topology
from fluvia.schema import alias_names, align_names, name_definitions


def edges(spark, pairs, schema="id long, toid long"):
    return spark.createDataFrame(pairs, schema)


def test_names_are_aligned_and_restored(spark):
    df = spark.createDataFrame([(1, 2, 0.5, "x")], "COMID long, toCOMID long, AreaSqKM double, Other string")
    net = n.hy(df)
    assert net.df.columns == ["id", "toid", "da_sqkm", "Other"]
    assert n.hy_reverse(net).columns == df.columns
    assert n.hy(df, clean=True).df.columns == ["id", "toid", "da_sqkm"]


def test_alias_conflicts(spark):
    df = spark.createDataFrame([(1, 2)], "permanent_identifier long, comid long")
    assert align_names(df).columns == ["permanent_identifier", "id"]
    two = spark.createDataFrame([(1, 2)], "comid long, featureid long")
    with pytest.warns(UserWarning):
        assert align_names(two).columns == ["comid", "id"]


def test_registry_can_be_extended():
    assert alias_names({"My_Key": "id"})["my_key"] == "id"
    assert "my_key" not in alias_names(clear=True)
    with pytest.raises(ValueError):
        alias_names({"a": "no such name"})
    assert set(alias_names().values()) <= set(name_definitions())


def test_kinds(spark):
    assert n.network_type(edges(spark, [(1, 2), (2, 3), (3, 0)])) == "TOPO"
    leveled = spark.createDataFrame([(1, 2, 2, 1, 2), (2, 0, 1, 1, 2)], "id long, toid long, topo_sort long, levelpath long, levelpath_outlet_id long")
    assert n.network_type(leveled) == "LEVELED"
    assert n.network_type(edges(spark, [(1, 2), (1, 3), (2, 0)])) == "FLOW"
    assert n.network_type(spark.createDataFrame([(1, 1, 2)], "comid long, fromnode long, tonode long")) == "NODE"
    assert n.network_type(spark.createDataFrame([(1, "a")], "id long, x string")) == "BASE"


def test_junctions_have_one_main_connection(spark):
    schema = "id long, toid long, upmain boolean, downmain boolean"
    with pytest.raises(ValueError, match="multiple downmain"):
        n.hy(spark.createDataFrame([(1, 2, True, True), (1, 3, True, True), (2, 0, True, True), (3, 0, True, True)], schema))
    with pytest.raises(ValueError, match="multiple upmain"):
        n.hy(spark.createDataFrame([(1, 3, True, True), (2, 3, True, True), (3, 0, True, True), (1, 2, False, False)], schema))


def test_dendritic(spark):
    assert n.is_dendritic(edges(spark, [(1, 2), (2, 0)]))
    assert not n.is_dendritic(edges(spark, [(1, 2), (1, 3), (2, 0), (3, 0)]))
    assert not n.is_dendritic(spark.createDataFrame([(1, 0, 2)], "id long, toid long, divergence int"))


def test_capabilities(spark):
    topo = n.capabilities(edges(spark, [(1, 2), (2, 0)]))
    assert topo["sort_network"] and not topo["add_toids"] and not topo["add_pfafstetter"]
    node = n.hy(spark.createDataFrame([(1, 1, 2)], "id long, fromnode long, tonode long"))
    assert n.capabilities(node)["add_toids"] and not n.capabilities(node)["sort_network"]
    assert n.capabilities(node, include_conversions=True)["sort_network"]


@pytest.mark.parametrize(("mark", "kind"), [(0, "long"), (None, "long"), (999, "long"), (-1, "long"), ("", "string"), ("OUT", "string")])
def test_outlet_conventions(spark, mark, kind):
    own = (lambda v: v) if kind == "long" else (lambda v: None if v is None else str(v))
    df = edges(spark, [(own(i), own(t)) for i, t in zip(range(1, 6), [2, 3, 5, 5, mark], strict=True)], f"id {kind}, toid {kind}")
    net = n.hy(df)
    assert [str(r["id"]) for r in n.outlets_of(net.df).collect()] == ["5"]
    assert [str(r["id"]) for r in topology.sort_network(net).df.collect()] == ["1", "2", "3", "4", "5"]
    nodes = topology.make_node_topology(net)
    assert nodes.df.count() == 5 and {"fromnode", "tonode"} <= set(nodes.df.columns)


def test_empty_network(spark):
    net = n.hy(edges(spark, []))
    assert n.outlets_of(net.df).count() == 0
    assert topology.add_topo_sort(net).df.count() == 0
