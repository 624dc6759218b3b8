"""What must not grow with a network, or with the number of rounds."""

import random

import pytest
from pyspark.sql import functions as F

from fluvia import queries as q
from fluvia.functions import overlay
from fluvia.network import hy
from fluvia.operators import indexing, polygons, topology
from fluvia.plans import iterate


def constraints(df):
    return df._jdf.queryExecution().optimizedPlan().constraints().size()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_carry_no_constraints(spark):
    """Of a table joined with itself again and again, which doubles what is known of its columns."""
    now = iterate.cut(spark.range(100).select("id", (F.col("id") + 1).alias("ptr")))
    for _ in range(3):
        far = now.select(F.col("id").alias("at"), F.col("ptr").alias("next"))
        now = iterate.cut(now.join(far, F.col("ptr") == F.col("at")).select("id", F.col("next").alias("ptr")))
        assert constraints(now) <= 2
    assert now.count() == 93


def test_walk_moves_only_what_goes_on(spark, monkeypatch):
    """Rows that have come to their root are written once, and don't meet under one key."""
    written = []
    kept = iterate.Rounds.append
    monkeypatch.setattr(iterate.Rounds, "append", lambda self, df: (written.append(n.count()) or n) if (n := kept(self, df)) else n)
    star = spark.range(1, 1001).select("id", F.when(F.col("id") > 3, (F.col("id") % 3) + 1).otherwise(F.lit(None)).alias("parent"))
    walked = {r["id"]: (r["root"], r["depth"]) for r in iterate.walk_to_root(star).collect()}
    assert walked == {k: (k, 0) if k <= 3 else (k % 3 + 1, 1) for k in range(1, 1001)}
    assert written == [1000, 997]


def test_waterbodies_are_not_broadcast_by_estimate(spark, sf_dir):
    """A file of parts is far smaller than the corners and boxes made of it."""
    points = spark.range(50_000).select(F.col("id").alias("point_id"), F.lit(3.5).alias("x"), F.lit(1.5).alias("y"))
    found = indexing.index_points_to_waterbodies(q.squares(spark, sf_dir).select("wbid", "geom"), points, 1.0)
    plan = physical(found)
    made = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert "SortMergeJoin" in plan and not made


def test_loops_end_levels_soon(spark, monkeypatch):
    """Where ids have several ways, a loop is found by peeling, and not after a round for each id."""
    rounds, kept = [], iterate.Rounds.append

    def counted(self, df):
        rounds.append(1)
        assert len(rounds) < 40
        return kept(self, df)

    monkeypatch.setattr(iterate.Rounds, "append", counted)
    monkeypatch.setattr(iterate, "PATIENCE", 3, raising=False)
    table = spark.createDataFrame([(k, k + 1) for k in range(8)] + [(3, 1), (5, 7), (0, 2)], "src long, dst long")
    with pytest.raises(ValueError, match="loops"):
        iterate.levels(spark.range(1000), table)


def test_few_edges_need_no_arrays(monkeypatch):
    """Most polygons have few edges; what is found of them is the same in both ways."""
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randrange(3, 12)
        ring = [(float(draw.randrange(5)), draw.randrange(5) / 2) for _ in range(n)]
        edges = [(a, b, 1) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]
        odd = lambda w: w % 2 == 1
        with monkeypatch.context() as m:
            m.setattr(overlay, "SMALL", 0, raising=False)
            slow = overlay.noded(edges), overlay.outline(edges, odd)
        with monkeypatch.context() as m:
            m.setattr(overlay, "_pairs", None)
            assert (overlay.noded(edges), overlay.outline(edges, odd)) == slow


def test_polygons_of_one_file_are_spread(spark, sf_dir):
    found = polygons.check_valid(q.squares(spark, sf_dir).select("wbid", "geom"))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_networks_are_not_broadcast_by_estimate(spark, sf_dir):
    assert "BroadcastHashJoin" not in physical(topology.add_toids(hy(q.nodes(spark, sf_dir)), return_dendritic=False).df)
