"""Network tables: a DataFrame with its kind, its columns' original names, and what can be done with it."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .schema import DEFINITIONS, aligned_names


class Kind(Enum):
    """What the rows of a network table are."""

    BASE = "table"  # canonical names only
    TOPO = "edge list"  # unique id with toid
    LEVELED = "leveled edge list"  # with topo_sort, levelpath and levelpath_outlet_id
    NODE = "node topology"  # unique id with fromnode and tonode
    FLOW = "junction table"  # id and toid, neither unique


#: Column in which geometry is kept: points are struct<x,y>, lines arrays of points, polygons arrays of rings.
GEOMETRY = "geom"


@dataclass(frozen=True)
class Network:
    df: DataFrame
    kind: Kind
    names: dict[str, str] = field(default_factory=dict)  # original name of every renamed column

    def __repr__(self) -> str:
        return f"Network({self.kind.value}: {', '.join(self.df.columns)})"

    def has(self, *columns: str) -> bool:
        return set(columns) <= set(self.df.columns)

    @property
    def is_topo(self) -> bool:
        return self.kind in (Kind.TOPO, Kind.LEVELED)

    def with_df(self, df: DataFrame, recount: bool = False) -> Network:
        """The same network over other columns, classified anew.

        Whether ids are unique is taken over, as operators add columns to rows; recount looks again.
        """
        known = None if recount or self.kind is Kind.BASE else self.kind is not Kind.FLOW
        return Network(df, classify(df, known), self.names)


def outlet_value(df: DataFrame, column: str = "id") -> Column:
    """What marks an outlet in toid: an empty string or 0, by the type of the identifiers."""
    text = isinstance(df.schema[column].dataType, StringType)
    return F.lit("") if text else F.lit(0).cast(df.schema[column].dataType)


def _unique(df: DataFrame) -> bool:
    return df.groupBy("id").count().filter("count > 1").isEmpty()


def classify(df: DataFrame, unique: bool | None = None) -> Kind:
    """Edge lists before junction tables before node topologies; id, toid and their uniqueness decide.

    Uniqueness costs a shuffle by id, unless the caller knows it.
    """
    has = set(df.columns)
    if {"id", "toid"} <= has:
        if not (_unique(df) if unique is None else unique):
            return Kind.FLOW
        return Kind.LEVELED if {"topo_sort", "levelpath", "levelpath_outlet_id"} <= has else Kind.TOPO
    if {"id", "fromnode", "tonode"} <= has and (_unique(df) if unique is None else unique):
        return Kind.NODE
    return Kind.BASE


def check_junctions(df: DataFrame) -> None:
    """At most one main connection for each id downstream and each toid upstream."""
    for flag, key in (("downmain", "id"), ("upmain", "toid")):
        if flag in df.columns:
            several = df.filter(F.col(flag)).select("id", "toid").distinct()
            if key == "toid":
                several = several.join(df.select(F.col("id").alias("toid")).distinct(), "toid", "left_semi")
            if not several.groupBy(key).count().filter("count > 1").isEmpty():
                raise ValueError(f"multiple {flag} connections for one {key}")


def hy(x: DataFrame | Network, clean: bool = False, add_topo: bool = False) -> Network:
    """x as a network with canonical names; null toid becomes the outlet mark.

    clean drops geometry and every column outside the vocabulary; add_topo makes toid from nodes.
    """
    if isinstance(x, Network):
        return x
    renamed = aligned_names(x.columns)
    df = x.withColumnsRenamed(renamed)
    if clean:
        df = df.select([c for c in df.columns if c in DEFINITIONS])
    if "toid" in df.columns and "id" in df.columns:
        df = df.withColumn("toid", F.coalesce("toid", outlet_value(df)))
    # Estimates of a network's size come from its source's files, and are too low for what is made of them to be broadcast by.
    df = df.hint("merge")
    net = Network(df, classify(df), {new: old for old, new in renamed.items() if old != new})
    if net.kind is Kind.FLOW:
        check_junctions(df)
    if add_topo and "toid" not in df.columns and net.has("fromnode", "tonode"):
        from .operators.topology import add_toids

        return add_toids(net, return_dendritic=net.has("divergence"))
    return net


def is_hy(x: object) -> bool:
    return isinstance(x, Network)


def hy_reverse(net: Network) -> DataFrame:
    """The table under its original names; columns that operators added keep theirs."""
    return net.df.withColumnsRenamed(net.names)


def given_back(x: DataFrame | Network, net: Network) -> Network | DataFrame:
    """Networks for networks, and plain tables with their own names for plain tables."""
    return net if isinstance(x, Network) else hy_reverse(net)


def get_geometry(net: Network) -> DataFrame | None:
    """(id, geometry), one row an id, to be put aside while rows are shuffled; None without geometry."""
    if not net.has("id", GEOMETRY):
        return None
    return net.df.select("id", GEOMETRY).dropDuplicates(["id"])


def without_geometry(net: Network) -> Network:
    return net.with_df(net.df.drop(GEOMETRY)) if net.has(GEOMETRY) else net


def put_geometry(net: Network, geometry: DataFrame | None) -> Network:
    """The network with the geometry that get_geometry took from it; rows without one have null."""
    if geometry is None:
        return net
    own = geometry.select(F.col("id").alias("_g"), GEOMETRY)
    return net.with_df(net.df.drop(GEOMETRY).join(own, F.col("id") == F.col("_g"), "left").drop("_g"))


def network_type(x: DataFrame | Network) -> str:
    """The most specific kind."""
    return hy(x).kind.name


def is_dendritic(x: DataFrame | Network) -> bool:
    """Whether no row is a diversion and no id has several ways down."""
    net = hy(x)
    if net.has("divergence") and not net.df.filter("divergence = 2").isEmpty():
        return False
    return not (net.has("toid") and not _unique(net.df.select("id", "toid").distinct()))


def capabilities(x: DataFrame | Network, include_conversions: bool = False) -> dict[str, bool]:
    """Which operators run on this network, as it is or after a conversion."""
    net = hy(x)
    topo, leveled, node, flow = net.is_topo, net.kind is Kind.LEVELED, net.kind is Kind.NODE, net.kind is Kind.FLOW
    edges = topo or flow
    out = dict.fromkeys(
        ("sort_network", "add_topo_sort", "add_levelpaths", "add_streamorder", "accumulate_downstream", "navigate_network_dfs", "make_index_ids", "make_node_topology"),
        edges,
    )
    out |= dict.fromkeys(("add_pathlength", "check_hy_graph", "navigate_hydro_network"), topo)
    out |= dict.fromkeys(("add_pfafstetter", "add_streamlevel"), leveled)
    out |= dict.fromkeys(("add_toids", "add_divergence", "subset_network"), node)
    out |= dict.fromkeys(("make_attribute_topology", "index_points_to_lines"), net.has(GEOMETRY))
    out["to_flownetwork"] = leveled and net.has("divergence")
    out["add_return_divergence"] = node and net.has("divergence")
    if include_conversions:
        if node:
            out |= {k: True for k, v in out.items() if not v and k not in ("add_pfafstetter", "add_streamlevel", "to_flownetwork", "make_attribute_topology", "index_points_to_lines", "add_return_divergence")}
        elif topo:
            out |= dict.fromkeys(("add_toids", "add_divergence", "add_return_divergence", "subset_network"), True)
    return out


def edges_of(df: DataFrame) -> DataFrame:
    """(src, dst) inside the network: a toid that is no id is an outlet."""
    ids = df.select(F.col("id").alias("dst")).distinct()
    return df.select(F.col("id").alias("src"), F.col("toid").alias("dst")).distinct().join(ids, "dst", "left_semi").select("src", "dst")


def outlets_of(df: DataFrame) -> DataFrame:
    """Rows that are outlets: their toid is no id of the table, whatever marks it."""
    ids = df.select(F.col("id").alias("_known")).distinct()
    return df.join(ids, F.col("toid") == F.col("_known"), "left_anti")


def need(net: Network, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in net.df.columns]
    if missing:
        raise ValueError(f"{what} needs column(s) {', '.join(missing)}; this is a {net.kind.value}")
