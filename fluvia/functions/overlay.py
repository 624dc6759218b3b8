"""Planar overlay of directed edges: crossings become vertices, and an outline keeps what parts inside from outside.

Edges of polygons run with the inside on their left. The winding number of a place tells how many polygons
cover it; an edge belongs to the outline if the rule holds on one of its sides only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

#: Places closer than this, in proportion to an edge's length, are one.
SNAP = 1e-9
#: How far beside an edge's middle its sides are looked at, in proportion to its length.
BESIDE = 1e-5

#: Up to so many edges, plain numbers are faster than arrays, which cost the same for few as for many.
SMALL = 24

Edge = tuple[tuple[float, float], tuple[float, float], int]


def _pairs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each box in order of its left side, the later ones that touch it."""
    order = np.argsort(low[:, 0], kind="stable")
    left = low[order, 0]
    for k, i in enumerate(order[:-1]):
        end = int(np.searchsorted(left, high[i, 0], "right"))
        near = order[k + 1 : end]
        near = near[(low[near, 1] <= high[i, 1]) & (high[near, 1] >= low[i, 1])]
        if len(near):
            yield int(i), near


def _cuts(edges: list[Edge]) -> list[dict[float, tuple[float, float]]]:
    """Where others cross, touch or overlap each edge: places by how far along it they are, from 0 to 1."""
    a, b = (np.array([e[k] for e in edges], float).reshape(-1, 2) for k in (0, 1))
    low, high = np.minimum(a, b), np.maximum(a, b)
    cuts: list[dict[float, tuple[float, float]]] = [{} for _ in edges]

    def cut(i: int, t: float, p: tuple[float, float]) -> None:
        if SNAP < t < 1 - SNAP:
            cuts[i][t] = p

    for i, near in _pairs(low, high):
        r, s, d = b[i] - a[i], b[near] - a[near], a[near] - a[i]
        scale = np.hypot(*r) * np.hypot(s[:, 0], s[:, 1])
        turn = r[0] * s[:, 1] - r[1] * s[:, 0]
        off = d[:, 0] * r[1] - d[:, 1] * r[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / turn
            u = off / turn
        skew = np.abs(turn) > 1e-12 * scale
        hit = skew & (t >= -SNAP) & (t <= 1 + SNAP) & (u >= -SNAP) & (u <= 1 + SNAP)
        for k in np.flatnonzero(hit):
            j, tt, uu = int(near[k]), float(t[k]), float(u[k])
            # A crossing near an end is that end, for both edges.
            ends = [p for p, at in ((a[i], tt), (b[i], 1 - tt), (a[j], uu), (b[j], 1 - uu)) if at <= SNAP]
            p = tuple(map(float, ends[0] if ends else a[i] + tt * r))
            cut(i, tt, p)
            cut(j, uu, p)
        for k in np.flatnonzero(~skew & (np.abs(off) <= 1e-12 * np.hypot(*r) * max(np.hypot(*r), 1e-300))):
            j = int(near[k])
            for x, y in ((i, j), (j, i)):
                along = b[x] - a[x]
                size = float(along @ along)
                for p in (a[y], b[y]):
                    cut(x, float((p - a[x]) @ along) / size, tuple(map(float, p)))
    return cuts


def _cuts_of_few(edges: list[Edge]) -> list[dict[float, tuple[float, float]]]:
    """The same by the same rules, pair by pair."""
    cuts: list[dict[float, tuple[float, float]]] = [{} for _ in edges]
    flat = [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b, _ in edges]
    left = [min(ax, bx) for ax, _, bx, _ in flat]
    order = sorted(range(len(edges)), key=left.__getitem__)
    for k, i in enumerate(order):
        ax, ay, bx, by = flat[i]
        right, low, high = max(ax, bx), min(ay, by), max(ay, by)
        rx, ry = bx - ax, by - ay
        size = math.hypot(rx, ry)
        for j in order[k + 1 :]:
            if left[j] > right:
                break
            cx, cy, ex, ey = flat[j]
            if min(cy, ey) > high or max(cy, ey) < low:
                continue
            sx, sy, dx, dy = ex - cx, ey - cy, cx - ax, cy - ay
            turn, off = rx * sy - ry * sx, dx * ry - dy * rx
            if abs(turn) > 1e-12 * (size * math.hypot(sx, sy)):
                t, u = (dx * sy - dy * sx) / turn, off / turn
                if not (-SNAP <= t <= 1 + SNAP and -SNAP <= u <= 1 + SNAP):
                    continue
                ends = [p for p, at in (((ax, ay), t), ((bx, by), 1 - t), ((cx, cy), u), ((ex, ey), 1 - u)) if at <= SNAP]
                p = ends[0] if ends else (ax + t * rx, ay + t * ry)
                for x, at in ((i, t), (j, u)):
                    if SNAP < at < 1 - SNAP:
                        cuts[x][at] = p
            elif abs(off) <= 1e-12 * size * max(size, 1e-300):
                for x, y in ((i, j), (j, i)):
                    x0, y0, x1, y1 = flat[x]
                    ux, uy = x1 - x0, y1 - y0
                    for p in (flat[y][:2], flat[y][2:]):
                        at = ((p[0] - x0) * ux + (p[1] - y0) * uy) / (ux * ux + uy * uy)
                        if SNAP < at < 1 - SNAP:
                            cuts[x][at] = p
    return cuts


def noded(edges: list[Edge]) -> list[Edge]:
    """The edges split where they cross, touch or overlap others; what lies on one another is one edge, opposite ways cancel."""
    cuts = _cuts_of_few(edges) if len(edges) <= SMALL else _cuts(edges)
    net: dict[tuple, int] = {}
    for (p, q, way), own in zip(edges, cuts, strict=True):
        places = [tuple(map(float, p)), *(own[t] for t in sorted(own)), tuple(map(float, q))]
        for x, y in zip(places, places[1:], strict=False):
            if x != y:
                key, sign = ((x, y), 1) if x < y else ((y, x), -1)
                net[key] = net.get(key, 0) + sign * way
    return [(x, y, way) for (x, y), way in net.items() if way]


def windings(edges: list[Edge], places: np.ndarray) -> np.ndarray:
    """How often the edges wind around each place: crossings of a ray to the right, in bands of like height."""
    if len(edges) <= SMALL:
        out = []
        for px, py in places.tolist():
            n = 0
            for (ax, ay), (bx, by), way in edges:
                if (ay <= py) != (by <= py) and ax + (py - ay) * (bx - ax) / (by - ay) > px:
                    n += way if ay <= py else -way
            out.append(n)
        return np.array(out, int)
    a, b = (np.array([e[k] for e in edges], float).reshape(-1, 2) for k in (0, 1))
    way = np.array([e[2] for e in edges])
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    bottom, top = low.min(), high.max()
    n = max(1, min(len(edges) // 8, 4096))
    band = lambda y: np.clip(((y - bottom) / max(top - bottom, 1e-300) * n).astype(int), 0, n - 1)
    first, last = band(low), band(high)
    members: list[list[int]] = [[] for _ in range(n)]
    for k in range(len(edges)):
        for at in range(first[k], last[k] + 1):
            members[at].append(k)
    out = np.zeros(len(places), int)
    own = band(places[:, 1])
    for at in np.unique(own):
        some = np.array(members[at], int)
        if not len(some):
            continue
        inside = np.flatnonzero(own == at)
        p = places[inside]
        ay, by = a[some, 1], b[some, 1]
        up = (ay[None] <= p[:, 1:]) & (by[None] > p[:, 1:])
        down = (by[None] <= p[:, 1:]) & (ay[None] > p[:, 1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[some, 0] + (p[:, 1:] - ay) * (b[some, 0] - a[some, 0]) / (by - ay)
        right = x > p[:, :1]
        out[inside] = ((up & right).astype(int) - (down & right).astype(int)) @ way[some]
    return out


def outline(edges: list[Edge], rule: Callable[[np.ndarray], np.ndarray] = lambda w: w > 0) -> list[Edge]:
    """The edges around all places whose winding number the rule takes for inside, which lies on their left."""
    own = noded(edges) if edges else []
    if not own:
        return []
    p, q = (np.array([e[k] for e in own], float) for k in (0, 1))
    along = q - p
    beside = np.stack([along[:, 1], -along[:, 0]], 1) * BESIDE  # to the right
    right = windings(own, (p + q) / 2 + beside)
    left = right + np.array([e[2] for e in own])
    kept = []
    for (x, y, _), a, b in zip(own, rule(left), rule(right), strict=True):
        if a != b:
            kept.append((x, y, 1) if a else (y, x, 1))
    return kept
