"""The controlled vocabulary of network tables, and the aliases under which its columns arrive."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

# Canonical column names and what they hold.
DEFINITIONS: dict[str, str] = {
    "id": "identifier shared by a catchment and the feature that drains it",
    "toid": "identifier of the next feature downstream; several are possible in a network with diversions",
    "fromnode": "node at the upstream end of a feature",
    "tonode": "node at the downstream end of a feature",
    "divergence": "0: not below a divergence, 1: main path below one, 2: diversion",
    "divergence_fraction": "share of the flow that a feature below a divergence receives",
    "wbid": "waterbody identifier",
    "total_da_sqkm": "drainage area of everything upstream, at the feature's outlet",
    "da_sqkm": "drainage area of the feature's own catchment",
    "length_km": "length of the feature",
    "pathlength_km": "distance from the feature's outlet to the end of its network",
    "arbolate_sum": "total length of all features upstream, the feature's own included",
    "topo_sort": "a topological order; upstream features have larger values",
    "up_topo_sort": "topo_sort of the main feature upstream",
    "dn_topo_sort": "topo_sort of the main feature downstream",
    "dn_minor_topo_sort": "topo_sort of the minor feature downstream",
    "terminal_topo_sort": "topo_sort of the outlet of the network",
    "terminal_flag": "1 at the end of a network, else 0",
    "terminal_id": "identifier of the outlet feature of the basin",
    "start_flag": "1 for a headwater, else 0",
    "levelpath": "identifier of the main path that a feature belongs to",
    "up_levelpath": "levelpath of the main feature upstream",
    "dn_levelpath": "levelpath of the main feature downstream",
    "levelpath_outlet_id": "identifier of the outlet feature of the levelpath",
    "stream_level": "1 (coastal) or 4 (inland) for paths that end a network, one more for each tributary",
    "dn_stream_level": "stream level of the main feature downstream",
    "stream_order": "Strahler order that diversions pass on without raising it",
    "stream_calculator": "stream order along the dendritic network, 0 along diversions",
    "feature_type": "name of the feature's type",
    "feature_type_code": "code of the feature's type",
    "vector_proc_unit": "processing unit of vector data",
    "raster_proc_unit": "processing unit of raster data",
    "id_measure": "linear reference along one feature",
    "aggregate_id": "identifier of a reach or path of several features",
    "aggregate_id_measure": "linear reference along the aggregate feature",
    "aggregate_id_from_measure": "aggregate measure at the feature's downstream end",
    "aggregate_id_to_measure": "aggregate measure at the feature's upstream end",
    "point_id": "identifier of a located point",
    "offset": "distance from a point to its line",
    "upmain": "whether this is the main connection upstream",
    "downmain": "whether this is the main connection downstream",
}

# Lower-case aliases and their canonical names.
ALIASES: dict[str, str] = {
    "id3dhp": "id", "comid": "id", "nhdplusid": "id", "featureid": "id", "permanent_identifier": "id",
    "from_permanent_identifier": "id", "reconciled_id": "id", "aggregated_id": "id",
    "toid": "toid", "tocomid": "toid", "to_permanent_identifier": "toid", "reconciled_toid": "toid", "aggregated_toid": "toid",
    "tonode": "tonode", "fromnode": "fromnode", "divergence": "divergence", "divergence_fraction": "divergence_fraction",
    "wbareacomi": "wbid", "totdasqkm": "total_da_sqkm", "totda": "total_da_sqkm", "areasqkm": "da_sqkm",
    "lengthkm": "length_km", "pathlength": "pathlength_km", "arbolatesu": "arbolate_sum",
    "hydroseq": "topo_sort", "uphydroseq": "up_topo_sort", "dnhydroseq": "dn_topo_sort", "dnminorhyd": "dn_minor_topo_sort",
    "terminalpa": "terminal_topo_sort", "terminalfl": "terminal_flag", "startflag": "start_flag",
    "levelpathi": "levelpath", "levelpathid": "levelpath", "outletid": "levelpath_outlet_id",
    "uplevelpat": "up_levelpath", "dnlevelpat": "dn_levelpath", "streamleve": "stream_level", "dnlevel": "dn_stream_level",
    "streamorde": "stream_order", "streamcalc": "stream_calculator", "ftype": "feature_type", "fcode": "feature_type_code",
    "vpuid": "vector_proc_unit", "rpuid": "raster_proc_unit",
    "reachcode": "aggregate_id", "mainstemid": "aggregate_id",
    "reach_meas": "aggregate_id_measure", "reachcode_measure": "aggregate_id_measure",
    "frommeas": "aggregate_id_from_measure", "mainstemid_from_measure": "aggregate_id_from_measure",
    "tomeas": "aggregate_id_to_measure", "mainstemid_to_measure": "aggregate_id_to_measure",
}

_registry = dict(ALIASES)


def alias_names(new: dict[str, str] | None = None, clear: bool = False) -> dict[str, str]:
    """The alias map. new adds aliases (keys are matched in lower case); clear first drops all others."""
    if clear:
        _registry.clear()
        _registry.update(ALIASES if new is None else {})
    for alias, name in (new or {}).items():
        if name not in DEFINITIONS:
            raise ValueError(f"{name} is not a canonical name")
        _registry[alias.lower()] = name
    return dict(_registry)


def name_definitions() -> dict[str, str]:
    return dict(DEFINITIONS)


def aligned_names(columns: list[str]) -> dict[str, str]:
    """New name of every column that gets one; others keep their own, in their own case."""
    wanted: dict[str, list[str]] = {}
    for column in columns:
        low = column.lower()
        if (name := low if low in DEFINITIONS else _registry.get(low)) is not None:
            wanted.setdefault(name, []).append(column)
    out = {}
    for name, own in wanted.items():
        if len(own) > 1 and any(c.lower() == "permanent_identifier" for c in own):
            own = [c for c in own if c.lower() != "permanent_identifier"]
        if len(own) > 1 and name in own:
            own = [name]
        elif len(own) > 1:
            warnings.warn(f"{', '.join(own)} all stand for {name}; the last is used", stacklevel=3)
        out[own[-1]] = name
    return out


def align_names(df: DataFrame) -> DataFrame:
    """df with its columns under their canonical names."""
    return df.withColumnsRenamed(aligned_names(df.columns))


def require(df: DataFrame, names: list[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} needs column(s) {', '.join(missing)}")
