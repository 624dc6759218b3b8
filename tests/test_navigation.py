"""Paths as a depth-first walk takes them, and measures."""

import pytest

from fluvia.functions.geometry import rescale_measures
from fluvia.operators import navigation as nav

ONE = [(2, 3), (3, 4), (3, 5), (4, 6), (5, 7), (6, 8), (7, 8), (8, 9), (9, 0)]
TWO = [(2, 3), (3, 4), (3, 5), (4, 6), (5, 7), (6, 8), (7, 9), (8, 10), (9, 0), (10, 0)]


def paths(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["path_id"], r["seq"])):
        out.setdefault((r["start"], r["path_id"]), []).append(r["id"])
    return out


@pytest.mark.parametrize(
    ("pairs", "starts", "direction", "reset", "want"),
    [
        (ONE, [2], "down", False, {(2, 1): [2, 3, 5, 7, 8, 9], (2, 2): [4, 6]}),
        (ONE, [9], "up", False, {(9, 1): [9, 8, 7, 5, 3, 2, 6, 4]}),
        (TWO, [2, 5], "down", False, {(2, 1): [2, 3, 5, 7, 9], (2, 2): [4, 6, 8, 10]}),
        (TWO, [2, 5], "down", True, {(2, 1): [2, 3, 5, 7, 9], (2, 2): [4, 6, 8, 10], (5, 3): [5, 7, 9]}),
    ],
)
def test_depth_first_paths(spark, pairs, starts, direction, reset, want):
    df = spark.createDataFrame(pairs, "id long, toid long")
    assert paths(nav.navigate_network_dfs(df, starts, direction, reset)) == want


def test_starts_and_directions_are_checked(spark):
    df = spark.createDataFrame(ONE, "id long, toid long")
    with pytest.raises(ValueError):
        nav.navigate_network_dfs(df, [77])
    with pytest.raises(ValueError):
        nav.reachable(df, [2], "sideways")


def test_partial_length(spark):
    net = spark.createDataFrame([(1, "r", 0.0, 50.0, 4.0), (2, "r", 50.0, 100.0, 2.0)], "id long, aggregate_id string, aggregate_id_from_measure double, aggregate_id_to_measure double, length_km double")
    where = spark.createDataFrame([("r", 25.0), ("r", 50.0)], "aggregate_id string, aggregate_id_measure double")
    out = {r["aggregate_id_measure"]: (r["dn"], r["up"]) for r in nav.get_partial_length(where, net).collect()}
    assert out == {25.0: (2.0, 2.0), 50.0: (0.0, 2.0)}


def test_rescaling():
    assert rescale_measures(50, 50, 100) == rescale_measures(49.95, 50, 100) == 0
    assert rescale_measures(50, 0, 50) == rescale_measures(50.01, 0, 50) == 100
    assert rescale_measures(25, 0, 50) == 50
    with pytest.raises(ValueError):
        rescale_measures(75, 0, 50)
