"""Accumulation, levels, orders and divergences against values worked out by hand."""

import pytest

from fluvia.network import Network, hy
from fluvia.operators import attributes as a


def values(df, column):
    return {r["id"]: r[column] for r in (df.df if isinstance(df, Network) else df).collect()}


def test_dendritic_accumulation(spark):
    rows = list(zip([1, 2, 3, 4, 6, 7, 8, 9], [2, 3, 4, 0, 7, 8, 9, 4], [1.0, 2.0, 3.0, 4.0, 1.0, 2.0, 3.0, 4.0], strict=True))
    out = a.accumulate_downstream(spark.createDataFrame(rows, "id long, toid long, v double"), "v")
    assert values(out, "v_accumulated") == dict(zip([1, 2, 3, 4, 6, 7, 8, 9], [1, 3, 6, 20, 1, 3, 6, 10], strict=True))


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([(1, 2), (1, 3), (3, 4), (3, 5), (4, 6), (5, 6), (2, 7), (6, 7), (7, 0)], {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 5, 7: 7}),
        ([(1, 2), (1, 3), (1, 4), (5, 6), (2, 6), (3, 7), (4, 7), (6, 8), (7, 8), (8, 0)], {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 4, 7: 4, 8: 8}),
    ],
)
def test_total_accumulation_counts_once(spark, pairs, want):
    df = spark.createDataFrame([(i, to, 1.0) for i, to in pairs], "id long, toid long, v double")
    assert values(a.accumulate_downstream(df, "v", total=True), "v_accumulated") == want


def test_fractions_apply_to_the_receiver(spark):
    rows = [(1, 2, 1.0, 1.0), (1, 3, 1.0, 1.0), (2, 4, 1.0, 0.75), (3, 4, 1.0, 0.25), (4, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, toid long, v double, divergence_fraction double")
    assert values(a.accumulate_downstream(df, "v"), "v_accumulated") == {1: 1, 2: 1.75, 3: 1.25, 4: 4}


def test_pathlength_uses_the_outlet_rule(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "OUT", 3.0)], "id string, toid string, length_km double")
    assert values(a.add_pathlength(df), "pathlength_km") == {"a": 5, "b": 3, "c": 0}


def test_levelpaths(spark):
    rows = [(1, 3, "n", 1.0), (2, 3, "", 9.0), (3, 5, "n", 10.0), (4, 5, None, 3.0), (5, 0, "n", 14.0)]
    df = spark.createDataFrame(rows, "id long, toid long, name string, w double")
    out = a.add_levelpaths(df, "name", "w")
    assert out.columns[:5] == ["id", "toid", "levelpath_outlet_id", "topo_sort", "levelpath"]
    assert values(out, "levelpath_outlet_id") == {1: 5, 3: 5, 5: 5, 2: 2, 4: 4}
    heavy = a.add_levelpaths(df, "name", "w", override_factor=2)
    assert values(heavy, "levelpath_outlet_id")[2] == 5
    one = a.add_levelpaths(spark.createDataFrame([(1, 0, "n", 1.0)], "id long, toid long, name string, w double"), "name", "w").first()
    assert (one["topo_sort"], one["levelpath"]) == (1, 1)


def test_streamorder(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 7), (4, 6), (5, 6), (6, 7), (7, 8), (9, 8), (8, 0)], "id long, toid long")
    assert values(a.add_streamorder(df), "stream_order") == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 3, 9: 1, 8: 3}
    rows = [(1, 1, 2, 0), (2, 2, 3, 1), (3, 2, 3, 2), (4, 3, 4, 0)]
    nodes = spark.createDataFrame(rows, "id long, fromnode long, tonode long, divergence int")
    out = a.add_streamorder(nodes)
    assert values(out, "stream_order") == {1: 1, 2: 1, 3: 1, 4: 1}
    assert values(out, "stream_calculator") == {1: 1, 2: 1, 3: 0, 4: 1}
    with pytest.raises(ValueError):
        a.add_streamorder(out)


def test_streamlevel(spark):
    rows = [(1, 1, 0, True), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 0, False), (5, 5, 4, False)]
    df = spark.createDataFrame(rows, "id long, levelpath long, dn_levelpath long, coast boolean")
    assert values(a.add_streamlevel(df), "stream_level") == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}
    assert values(a.add_streamlevel(df, "coast"), "stream_level") == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


MINI = [(1, 1, 3), (2, 2, 3), (3, 3, 4), (4, 3, 5), (5, 4, 6), (6, 5, 6), (7, 6, 7)]


@pytest.mark.parametrize(
    ("names", "kinds", "want"),
    [
        ([None] * 7, [1] * 7, (1, 2)),
        (["test", None, "test2", "bbb", None, "test2", None], [1] * 7, None),
        (["test1", "test2", "test1", "test2", None, None, None], [1, 2, 2, 1, 1, 1, 1], (1, 2)),
        (["test1", "test2", "test3", "test4", None, None, None], [1, 2, 2, 1, 1, 1, 1], (2, 1)),
    ],
)
def test_divergence(spark, names, kinds, want):
    rows = [(*m, n, k) for m, n, k in zip(MINI, names, kinds, strict=True)]
    df = spark.createDataFrame(rows, "id long, fromnode long, tonode long, nm string, ty int")
    out = values(a.add_divergence(df, [7], [], "nm", "ty", [1]), "divergence")
    assert sorted((out[3], out[4])) == [1, 2]
    if want:
        assert (out[3], out[4]) == want
    assert all(out[i] == 0 for i in (1, 2, 5, 6, 7))
    with pytest.raises(ValueError):
        a.add_divergence(df, [], [], "nm", "ty", [1])


RULES = [
    # up name, (id, name, major, coastal) of the features below, the one that is picked
    ("s", [("2", None, True, True), ("7", "s", True, True)], "7"),
    (None, [("5", None, True, True), ("4", "c", True, True)], "4"),
    ("e", [("1", None, True, False), ("9", "e", True, False)], "9"),
    (None, [("6", None, True, True), ("a", None, False, True)], "6"),
    (None, [("b", None, True, False), ("c", None, True, False)], "b"),
    ("x", [("d", "y", False, False), ("e", None, True, False)], "d"),
]


@pytest.mark.parametrize(("up", "below", "want"), RULES)
def test_rules_of_divergence(spark, up, below, want):
    df = spark.createDataFrame([(1, *b, up) for b in below], "node int, id string, nm string, major boolean, coastal boolean, up_nm string")
    assert a.down_level(df, "node").first()["pick"] == want


def test_return_divergence(spark):
    rows = [(1, 1, 2, 0), (2, 2, 3, 1), (3, 2, 4, 2), (4, 4, 3, 0), (5, 3, 5, 0)]
    df = spark.createDataFrame(rows, "id long, fromnode long, tonode long, divergence int")
    assert values(a.add_return_divergence(df), "return_divergence") == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_pfafstetter_on_a_comb(spark):
    """A main path 1 < 2 < .. with a tributary at each feature: the four largest cut it in nine."""
    main = [(i, i - 1, 100.0 - i, i, 1) for i in range(1, 7)]
    comb = [(i + 10, i, 50.0 - i, i + 10, i + 10) for i in range(1, 6)]
    df = spark.createDataFrame(main + comb, "id long, toid long, total_da_sqkm double, topo_sort long, levelpath long")
    out = values(a.add_pfafstetter(df, 1), "pf_level_1")
    assert [out[i] for i in range(1, 7)] == [1, 3, 5, 7, 9, 9]
    assert [out[i + 10] for i in range(1, 6)] == [2, 4, 6, 8, None]


def test_total_is_the_sum_over_what_is_upstream(spark):
    from fluvia.operators.navigation import reachable

    pairs = [(1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 0)]
    df = spark.createDataFrame([(i, to, float(i)) for i, to in pairs], "id long, toid long, v double")
    total = values(a.accumulate_downstream(df, "v", total=True), "v_accumulated")
    for i in (3, 4, 6):
        assert total[i] == sum(r["id"] for r in reachable(df, [i], "up").collect())
    assert hy(df).kind.name == "FLOW"


def random_dag(seed, n):
    import random

    rng = random.Random(seed)
    pairs = [(i, rng.randrange(max(0, i - 6), i)) for i in range(2, n + 1) if rng.random() < 0.95]
    pairs += [(i, rng.randrange(1, i)) for i in rng.sample(range(10, n + 1), n // 8)]
    return sorted({(x, y) for x, y in pairs if y > 0} | {(i, 0) for i in range(1, n + 1) if not any(x == i and y > 0 for x, y in pairs)})


def test_totals_by_bridges(spark):
    """Every feature upstream counts once, whatever cycles and bridges there are."""
    for seed in range(3):
        pairs = random_dag(seed, 70)
        above = {i: {i} for i in range(71)}
        for x, y in sorted(pairs, reverse=True):  # ids fall downstream
            above[y] |= above[x]
        net = hy(spark.createDataFrame([(x, y, float(x)) for x, y in pairs], "id long, toid long, da_sqkm double"))
        got = {r["id"]: round(r["da_sqkm_accumulated"], 6) for r in a.accumulate_downstream(net, "da_sqkm", total=True).df.collect()}
        assert got == {i: float(sum(above[i])) for i in range(1, 71)}


def test_bridges_of_connections(spark):
    """Against taking each connection away; a tree has bridges only, so no pairs are made."""
    pairs = [(x, y) for x, y in random_dag(5, 50) if y]

    def parts(left):
        part = {i: i for i in range(1, 51)}

        def root(i):
            while part[i] != i:
                i = part[i]
            return i

        for x, y in left:
            part[root(x)] = root(y)
        return len({root(i) for i in part})

    nodes = spark.range(1, 51)
    bridges, others = a.bridge_edges(nodes, spark.createDataFrame(pairs, "src long, dst long"))
    found = {(r["src"], r["dst"]) for r in bridges.collect()}
    assert found | {(r["src"], r["dst"]) for r in others.collect()} == set(pairs)
    whole = parts(pairs)
    true = {p for p in pairs if parts([q for q in pairs if q != p]) > whole}
    # Connections that join two networks with outlets of their own aren't looked for.
    assert found <= true and len(found) > len(true) / 2
    tree = [(i, i // 2) for i in range(2, 51)]
    assert a.bridge_edges(nodes, spark.createDataFrame(tree, "src long, dst long"))[1].count() == 0


def test_rounds_write_each_row_once(spark):
    from fluvia.plans import iterate

    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 9)], "src long, dst long")
    written = []
    append = iterate.Rounds.append

    def counted(self, df):
        out = append(self, df)
        written.append(out.count())
        return out

    iterate.Rounds.append = counted
    try:
        found = iterate.reach(chain, spark.createDataFrame([(0, 0)], "start long, id long"))
        assert found.count() == 13 and sum(written) == 13
        written.clear()
        net = hy(spark.createDataFrame([(i, i - 1, 1) for i in range(2, 9)] + [(1, 0, 1), (20, 5, 1)], "id long, toid long, divergence int"))
        a.add_streamorder(net).df.collect()
        rows, ways = 9, 8  # features with their levels, connections, orders, and what each connection brings
        assert sum(written) == rows + ways + rows + ways
    finally:
        iterate.Rounds.append = append
