"""Roads grouped into routes of bounded size: greedy by nature, so one task works on one ward.

The grouped map is over wards, and no ward depends on another. A ward's roads are in the memory of its task;
growing and folding keep heaps and cells, so their time follows the roads of a ward and how densely they lie.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from roadloom.operators.network import dealt

WALK_M, HYBRID_M = 700.0, 1100.0
MERGE_CAP = 450.0
ROADS = "ward string, ord long, road string, residences double, size double, dist_m double, lon double, lat double, neighbours array<string>"
CLUSTERS = "ward string, cluster long, seq long, road string, residences double, kind string, min_dist_m double, merged_by_distance boolean"


def _metres(a: tuple[float, float], b: tuple[float, float], lat0: float) -> float:
    return math.hypot((a[0] - b[0]) * 111320.0 * math.cos(math.radians(lat0)), (a[1] - b[1]) * 111320.0)


def _grow(roads: pd.DataFrame, near: dict[str, set[str]], soft: float, most: float, strict: bool) -> list[list[str]]:
    """From the unassigned road nearest the start outwards, always the nearest neighbour that still fits."""
    dist, size = dict(zip(roads.road, roads.dist_m)), dict(zip(roads.road, roads["size"]))
    place = {r: i for i, r in enumerate(roads.road)}
    rank = lambda r: (dist[r], place[r], r)
    left, out = set(place), []
    for *_, seed in sorted(map(rank, place)):
        if seed not in left:
            continue
        members, total = [seed], size[seed]
        left.remove(seed)
        edge, seen = [], {seed}

        def reach(road: str) -> None:
            for r in near.get(road, ()):
                if r in left and r not in seen:
                    seen.add(r)
                    heapq.heappush(edge, rank(r))

        reach(seed)
        while edge and total < soft:
            chosen = heapq.heappop(edge)[-1]
            # what doesn't fit now never will, as the total only grows
            if total + size[chosen] > most or strict and abs(total + size[chosen] - soft) >= abs(total - soft):
                continue
            members.append(chosen)
            total += size[chosen]
            left.remove(chosen)
            reach(chosen)
        out.append(sorted(members))
    return out


class Cells:
    """Items by square cells of ``side`` metres."""

    def __init__(self, side: float, lat0: float):
        self.x, self.y = 111320.0 * math.cos(math.radians(lat0)) / side, 111320.0 / side
        self.items: dict[tuple[int, int], set[int]] = {}

    def cell(self, at: tuple[float, float]) -> tuple[int, int]:
        return math.floor(at[0] * self.x), math.floor(at[1] * self.y)

    def add(self, i: int, at: tuple[float, float]) -> None:
        self.items.setdefault(self.cell(at), set()).add(i)

    def remove(self, i: int, at: tuple[float, float]) -> None:
        self.items[self.cell(at)].discard(i)

    def around(self, at: tuple[float, float]) -> list[int]:
        """The items of the place's cell and its neighbours: all within ``side``, and some more."""
        x, y = self.cell(at)
        return [i for dx in (-1, 0, 1) for dy in (-1, 0, 1) for i in self.items.get((x + dx, y + dy), ())]


def _fold(groups: list[dict | None], partner: Callable[[int], int | None], least: float, merged: Callable[[int, int], Iterable[int]]) -> None:
    """Folds groups below the least size into their partners, always the first that has one; None is left in its place.

    ``merged(i, j)`` tells of each fold and returns the groups that may have a partner since, besides j.
    """
    waiting = [i for i, g in enumerate(groups) if g is not None and g["size"] < least]
    while waiting:
        i = heapq.heappop(waiting)
        if groups[i] is None or groups[i]["size"] >= least or (j := partner(i)) is None:
            continue
        more = [j, *merged(i, j)]
        groups[j]["roads"] += groups[i]["roads"]
        groups[j]["size"] += groups[i]["size"]
        groups[i] = None
        for k in more:
            heapq.heappush(waiting, k)


def cluster_ward(roads: pd.DataFrame, soft: float, least: float, most: float, strict: bool, gap_m: float, by_effort: bool) -> pd.DataFrame:
    """The clusters of one ward; roads of nothing left take no part."""
    roads = roads[roads.residences > 0].sort_values("ord").reset_index(drop=True)
    if roads.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in CLUSTERS.split(", ")])
    own = set(roads.road)
    near = {r: {x for x in n if x in own} for r, n in zip(roads.road, roads.neighbours)}
    size, where = dict(zip(roads.road, roads["size"])), dict(zip(roads.road, zip(roads.lon, roads.lat)))
    dist, homes, lat0 = dict(zip(roads.road, roads.dist_m)), dict(zip(roads.road, roads.residences)), roads.lat.mean()
    groups = [{"roads": g, "size": sum(size[r] for r in g), "far": False} for g in _grow(roads, near, soft, most, strict)]
    cap = most if strict or by_effort else max(most, MERGE_CAP)

    owner = {r: i for i, g in enumerate(groups) for r in g["roads"]}

    def adjacent(i: int) -> int | None:
        touching = {owner[x] for r in groups[i]["roads"] for x in near[r]} - {i}
        return min(((t, j) for j in touching if (t := groups[i]["size"] + groups[j]["size"]) <= cap), default=(0, None))[1]

    def joined(i: int, j: int) -> tuple:
        owner.update(dict.fromkeys(groups[i]["roads"], j))
        return ()

    _fold(groups, adjacent, least, joined)
    groups = [g for g in groups if g is not None]
    centre = lambda own: tuple(sum(where[r][k] for r in own) / len(own) for k in (0, 1))
    centres = [centre(g["roads"]) for g in groups]
    cells = Cells(max(gap_m, 1.0) * 1.001, lat0)
    for i, at in enumerate(centres):
        cells.add(i, at)

    def close(i: int) -> int | None:
        fits = [(d, j) for j in cells.around(centres[i]) if j != i and groups[i]["size"] + groups[j]["size"] <= cap and (d := _metres(centres[i], centres[j], lat0)) <= gap_m]
        return min(fits, default=(0, None))[1]

    def moved(i: int, j: int) -> list[int]:
        groups[j]["far"] = True
        cells.remove(i, centres[i])
        cells.remove(j, centres[j])
        centres[j] = centre(groups[j]["roads"] + groups[i]["roads"])
        cells.add(j, centres[j])
        # its centre may have come within reach of groups that had no partner
        return [k for k in cells.around(centres[j]) if k != j and groups[k]["size"] < least]

    _fold(groups, close, least, moved)
    groups = [g for g in groups if g is not None]
    for g in groups:
        g["dist"] = math.floor(min(dist[r] for r in g["roads"]) + 0.5)
    groups.sort(key=lambda g: g["dist"])
    rows = []
    for k, g in enumerate(groups):
        kind = "walk" if g["dist"] <= WALK_M else "hybrid" if g["dist"] <= HYBRID_M else "drive"
        rows += [(roads.ward.iloc[0], k, i, r, homes[r], kind, float(g["dist"]), g["far"]) for i, r in enumerate(g["roads"])]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CLUSTERS.split(", ")])


def cluster_roads(roads: DataFrame, target: float = 150, least: float | None = None, most: float | None = None, strict: bool = False, gap_m: float = 1000.0, by_effort: bool = False) -> DataFrame:
    """Clusters of every ward of roads (see ROADS); sizes default to shares of the target."""
    low = target * 0.75 if least is None else least
    high = target * (1.25 if strict else 2.25) if most is None else most
    return dealt(roads, "ward").groupBy("ward").applyInPandas(lambda pdf: cluster_ward(pdf, target, low, high, strict, gap_m, by_effort), CLUSTERS)


def settle_ward(roads: pd.DataFrame, radius_m: float, seed_m: float, least: float) -> pd.DataFrame:
    """Settlements of one ward: around the road with the most homes, all within both radii, until none is added."""
    roads = roads[roads.residences > 0].sort_values("ord").reset_index(drop=True)
    names = ["ward", "settlement", "road", "residences"]
    if roads.empty:
        return pd.DataFrame(columns=names)
    where, homes, lat0 = dict(zip(roads.road, zip(roads.lon, roads.lat))), dict(zip(roads.road, roads.residences)), roads.lat.mean()
    middle = lambda g: tuple(sum(where[r][k] for r in g) / len(g) for k in (0, 1))
    names_of = list(dict.fromkeys(roads.road))
    cells, groups = Cells(max(seed_m, 1.0) * 1.001, lat0), []
    for i, r in enumerate(names_of):
        cells.add(i, where[r])
    for first in sorted(range(len(names_of)), key=lambda i: (-homes[names_of[i]], i)):
        seed = names_of[first]
        at = where[seed]
        if first not in cells.items[cells.cell(at)]:
            continue
        cells.remove(first, at)
        group, near = [seed], sorted(i for i in cells.around(at) if _metres(where[names_of[i]], at, lat0) <= seed_m)
        while True:
            centre = middle(group)
            inside = [_metres(where[names_of[i]], centre, lat0) <= radius_m for i in near]
            if not any(inside):
                break
            for i, taken in zip(near, inside):
                if taken:
                    group.append(names_of[i])
                    cells.remove(i, where[names_of[i]])
            near = [i for i, taken in zip(near, inside) if not taken]
        groups.append(group)
    # the groups before the first small one stay large, so one way through is enough
    total, at = [sum(homes[r] for r in g) for g in groups], np.array([middle(g) for g in groups])
    there, scale = np.ones(len(groups), bool), np.array([math.cos(math.radians(lat0)), 1.0]) * 111320.0
    for i in range(len(groups)):
        if total[i] < least and there.sum() > 1:
            there[i] = False
            d = np.where(there, np.hypot(*((at - at[i]) * scale).T), np.inf)
            # the last bits as in the exact distance, the first of equals
            j = min(np.flatnonzero(d <= d.min() + 1e-6), key=lambda j: _metres(tuple(at[i]), tuple(at[j]), lat0))
            groups[j] += groups[i]
            total[j], at[j] = sum(homes[r] for r in groups[j]), middle(groups[j])
    groups = [g for g, t in zip(groups, there) if t]
    groups.sort(key=lambda g: -sum(homes[r] for r in g))
    return pd.DataFrame([(roads.ward.iloc[0], k, r, homes[r]) for k, g in enumerate(groups) for r in g], columns=names)


def find_settlements(roads: DataFrame, radius_m: float = 1000.0, seed_m: float = 1300.0, least: float = 60.0) -> DataFrame:
    return dealt(roads.select("ward", "ord", "road", "residences", "lon", "lat"), "ward").groupBy("ward").applyInPandas(lambda pdf: settle_ward(pdf, radius_m, seed_m, least), "ward string, settlement long, road string, residences double")
