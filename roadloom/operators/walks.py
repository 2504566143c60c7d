"""Walks over a network: links over gaps, shortest walks, tours of every pavement, and the sentences that tell them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import text
from roadloom.functions.geo import X_DEGREE, Y_WALK, compass, halves_up, metres
from roadloom.operators.junctions import _around, _grid
from roadloom.operators.network import Rounds, connected, dealt, relaxed

GAP_M = 120.0
FORK_DEGREES, STRAIGHT_DEGREES, ROUND_DEGREES, NEAR_START_M = 50.0, 35.0, 150.0, 25.0
STEPS = "route string, seq int, type string, edge long, forward boolean, node long, streets array<string>, back boolean, uturn boolean, dist_m double"

# The words of the sides
SIDES = {"N": "north", "NE": "north-east", "E": "east", "SE": "south-east", "S": "south", "SW": "south-west", "W": "west", "NW": "north-west"}


def gap_links(nodes: DataFrame, edges: DataFrame, lat0: float, most_m: float = GAP_M) -> DataFrame:
    """a, b, length_m: one straight link, the shortest, for each two components with junctions within ``most_m``.

    nodes: node, lon, lat; edges: a, b. Junctions without an edge are left alone; ties go to the least junctions.
    """
    ways = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = ways.union(ways.select("dst", "src")).distinct()
    used = both.select(F.col("src").alias("node")).distinct()
    placed = Rounds(nodes).write(nodes.join(connected(used, both), "node"))
    x, y = _grid(F.col("lon"), F.col("lat"), lat0, most_m)
    other = placed.select(F.col("node").alias("_n"), F.col("component").alias("_c"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), x.alias("_x"), y.alias("_y"))
    near = _around(placed, lat0, most_m).join(other, (F.col("_cx") == F.col("_x")) & (F.col("_cy") == F.col("_y")) & (F.col("component") < F.col("_c")))
    far = metres(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"), F.lit(lat0), Y_WALK)
    pair = F.struct(far.alias("length_m"), F.least("node", "_n").alias("a"), F.greatest("node", "_n").alias("b"))
    best = near.select("component", "_c", pair.alias("m")).filter(F.col("m.length_m") <= most_m).groupBy("component", "_c").agg(F.min("m").alias("m"))
    return best.select("m.a", "m.b", "m.length_m")


def shortest_walks(links: DataFrame, starts: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """walk, node, dist_m, streets of the shortest way from each walk's start to every junction it reaches.

    links: a, b, length_m, street (walked both ways; null for a link over a gap); starts: walk, node, dist_m. Streets
    that follow each other are named once. Ties go to the least junction before. All walks relax in the same rounds (see ``network.relaxed``), and the
    streets of ways are put together by doubling them.
    """
    there = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "length_m", "street")
    both = there.union(links.select("b", "a", "length_m", "street"))
    found = relaxed(both.select(F.struct("src", "street").alias("edge"), "src", "dst", "length_m"), starts, most_rounds)
    rounds = Rounds(links)
    none = F.array().cast("array<string>")
    state = rounds.write(found.select("walk", "node", "dist_m", F.col("prev").alias("up"), F.when(F.col("edge.street").isNull(), none).otherwise(F.array("edge.street")).alias("streets")))
    while not state.filter("up is not null").isEmpty():
        before = state.select(F.col("walk").alias("_w"), F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("streets").alias("_s"))
        met = state.join(before, (F.col("walk") == F.col("_w")) & (F.col("up") == F.col("_n")), "left")
        again = (F.size("_s") > 0) & (F.size("streets") > 0) & (F.get("_s", F.size("_s") - 1) == F.get("streets", F.lit(0)))
        joined = F.when(F.col("_w").isNull(), F.col("streets")).when(again, F.concat("_s", F.slice("streets", F.lit(2), F.size("streets")))).otherwise(F.concat("_s", "streets"))
        state = rounds.write(met.select("walk", "node", "dist_m", F.col("_u").alias("up"), joined.alias("streets")))
    return state.select("walk", "node", "dist_m", "streets")


def taken_walk(walk_m: Column, straight_m: Column) -> Column:
    """The way's length, or the straight line's where the network has no way or an absurdly long one."""
    return F.when(walk_m <= 3 * straight_m + 300, walk_m).otherwise(straight_m)


class _Pavements:
    """The half-edges of one route: who follows whom, and the faces they go round."""

    def __init__(self, part: pd.DataFrame):
        self.edge, self.forward = part["edge"].to_numpy(), part["forward"].to_numpy()
        self.tail, self.street, self.homes = part["tail"].to_numpy(), part["street"].to_numpy(), part["homes"].to_numpy()
        self.bearing, self.at = part["bearing"].to_numpy(), part[["x", "y"]].to_numpy(float)
        n = len(part)
        order = np.lexsort((np.arange(n), self.bearing, self.tail))
        self.around = {int(self.tail[run[0]]): run.tolist() for run in np.split(order, np.flatnonzero(np.diff(self.tail[order])) + 1)}
        self.place = {h: i for run in self.around.values() for i, h in enumerate(run)}
        self.rank = {h ^ 1: i for i, h in enumerate(order.tolist())}
        self.after = [run[(self.place[h ^ 1] + 1) % len(run)] for h in range(n) for run in [self.around[self.head(h)]]]
        self.face, self.members = [-1] * n, {}
        for first in range(n):
            h = first
            while self.face[h] < 0:
                self.face[h] = first
                self.members.setdefault(first, []).append(h)
                h = self.after[h]

    def head(self, h: int) -> int:
        return int(self.tail[h ^ 1])

    def parts(self) -> list[list[int]]:
        """Junctions of each connected part."""
        left, found = set(self.around), []
        while left:
            reached, grow = set(), [min(left)]
            while grow:
                v = grow.pop()
                if v not in reached:
                    reached.add(v)
                    grow += [self.head(h) for h in self.around[v]]
            left -= reached
            found.append(sorted(reached))
        return found

    def crossed(self, a: int, b: int) -> list[str]:
        """Streets between two corners of a junction, the shorter way round."""
        run = self.around[self.head(a)]
        i, j = self.place[a ^ 1], self.place[b ^ 1]
        right = (j - i) % len(run)
        steps = range(1, right + 1) if 2 * right <= len(run) else range(0, right - len(run), -1)
        return list(dict.fromkeys(self.street[run[(i + k) % len(run)]] for k in steps))

    def bridges(self, start: int) -> dict[int, list[int]]:
        """Where to cross from face to face: each new face by the fewest streets, ties by the order of corners."""
        inside, heap, out = set(), [], {}

        def enter(face: int) -> None:
            inside.add(face)
            for h in self.members[face]:
                for o in self.around[self.head(h)]:
                    if self.face[o ^ 1] not in inside:
                        heapq.heappush(heap, (len(self.crossed(h, o ^ 1)), self.rank[h], self.rank[o ^ 1], h, o ^ 1))

        enter(self.face[start])
        while heap:
            *_, h, to = heapq.heappop(heap)
            if self.face[to] not in inside:
                out.setdefault(h, []).append(to)
                enter(self.face[to])
        return out

    def tour(self, start: int) -> Iterator[tuple]:
        """(type, half-edge or corner left, corner entered, streets, back) round all faces of a connected part."""
        bridges = self.bridges(start)
        open_faces = [(start, start, iter(bridges.get(start, ())))]
        while open_faces:
            origin, h, over = open_faces[-1]
            to = next(over, None)
            if to is not None:
                yield "cross", h, to, self.crossed(h, to), False
                open_faces.append((to, to, iter(bridges.get(to, ()))))
                continue
            h = self.after[h]
            yield "walk", h, h, None, False
            if h != origin:
                open_faces[-1] = (origin, h, iter(bridges.get(h, ())))
                continue
            open_faces.pop()
            if open_faces:
                home = open_faces[-1][1]
                yield "cross", origin, home, self.crossed(origin, home), True

    def corner_facing(self, v: int, point: np.ndarray) -> int:
        run, (dx, dy) = self.around[v], point - self.at[self.around[v][0]]
        if np.hypot(dx, dy) >= 1:
            to = np.degrees(np.arctan2(dx, dy))
            for k, h in enumerate(run):
                span = (self.bearing[run[(k + 1) % len(run)]] - self.bearing[h]) % 360 or 360
                if (to - self.bearing[h]) % 360 <= span:
                    return h ^ 1
        return run[0] ^ 1


def _planned(part: pd.DataFrame, road_on_left: bool) -> pd.DataFrame:
    part = part.sort_values(["edge", "forward"], ascending=[True, False], ignore_index=True)
    net, rows = _Pavements(part), []
    place = {v: net.at[run[0]] for v, run in net.around.items()}
    here = part[["start_x", "start_y"]].iloc[0].to_numpy(float)
    if np.isnan(here).any():
        here = place[min(net.around, key=lambda v: (-len(net.around[v]), -sum(net.homes[h] for h in net.around[v]), v))]
    left = net.parts()
    while left:
        gone, _, v = min((float(np.hypot(*(place[v] - here))), i, v) for i, nodes in enumerate(left) for v in nodes)
        left = [nodes for nodes in left if v not in nodes]
        corners = list(dict.fromkeys(net.street[h] for h in net.around[v]))
        rows.append(("approach", None, None, v, corners, False, False, gone))
        steps = list(net.tour(net.corner_facing(v, here)))
        if road_on_left:  # the same pavements the other way round
            steps = [(t, a ^ 1, a ^ 1, s, False) if t == "walk" else (t, b, a, s, not back) for t, a, b, s, back in reversed(steps)]
        before = None
        for t, a, _, streets, back in steps:
            if t == "walk":
                rows.append((t, int(net.edge[a]), bool(net.forward[a]), net.head(a), None, False, before == a ^ 1, None))
                before = a
            else:
                rows.append((t, None, None, net.head(a), streets, back, False, None))
        here = place[v]
    out = pd.DataFrame(rows, columns=["type", "edge", "forward", "node", "streets", "back", "uturn", "dist_m"], dtype=object)
    out.insert(0, "route", part["route"].iloc[0])
    out.insert(1, "seq", np.arange(len(out), dtype="int32"))
    return out.astype({"edge": "Int64", "forward": "boolean", "node": "int64", "back": bool, "uturn": bool, "dist_m": float})


def tours(halves: DataFrame, lat0: float, road_on_left: bool = True) -> DataFrame:
    """route, seq, type (approach, walk, cross), edge, forward, node, streets, back, uturn, dist_m: every pavement of a route once.

    halves: route, edge, forward, tail, head, bearing, street, homes, and lon and lat of the tail; start_lon and start_lat
    may be null, then a route begins at its busiest junction. Following faces needs no crossing; faces are joined by
    the fewest streets crossed, there and back. Connected parts come nearest first by straight line. A route is one task's
    group: it is one walk (some hundred homes) by definition.
    """
    x, y = X_DEGREE * np.cos(np.radians(lat0)), Y_WALK
    put = lambda c, k: (F.col(c).cast("double") * F.lit(float(k)))
    flat = halves.select(F.col("route").cast("string").alias("route"), "edge", "forward", "tail", "head", "bearing", "street", F.coalesce(F.col("homes").cast("double"), F.lit(0.0)).alias("homes"), put("lon", x).alias("x"), put("lat", y).alias("y"), put("start_lon", x).alias("start_x"), put("start_lat", y).alias("start_y"))
    return dealt(flat, "route").groupBy("route").applyInPandas(lambda part: _planned(part, road_on_left), STEPS)


def passes(steps: DataFrame, sparse: Column, side_done: Column) -> DataFrame:
    """Adds pass: a sparse road is done on both sides at first and driven back later; other pavements one by one."""
    turn = F.row_number().over(Window.partitionBy("route", "edge").orderBy("seq"))
    return steps.withColumn("pass", F.when(sparse & (turn == 1), "both").when(sparse, "back").when(side_done, "sidedone").otherwise("side"))


def _said(streets: Column) -> Column:
    """A, B and C."""
    head = F.array_join(F.slice(streets, F.lit(1), F.greatest(F.size(streets) - 1, F.lit(1))), ", ")
    return F.when(F.size(streets) > 1, F.concat(head, F.lit(" and "), F.element_at(streets, -1))).otherwise(head)


def walk_legs(steps: DataFrame, drive: bool = False) -> DataFrame:
    """route, n, street, cue, homes, length_m, dir, side, pavement, already_done, end_cue: steps in a row along one street are a leg, with its sentence.

    steps: route, seq, type, streets, back, uturn, dist_m as of ``tours``, and for walks street, pass, homes, length_m, out_bearing,
    in_bearing, degree (roads at the junction it leaves), and a_x, a_y, b_x, b_y in metres. Where known also: drive (of the route, else for
    all as given), label and start_kind (parking, spot, hub or me) of where the route starts, via (streets of a walk-in), quiet (a crossing that
    means nothing from a car), one_sided (the edge's other side is done), right (the pavement is on the right), includes (very short roads), parts
    (of the route). Texts of approaches and crossings go before the walk that follows. Everything runs in windows over one route.
    """
    lacking = {"drive": F.lit(drive), "label": F.lit(None).cast("string"), "start_kind": F.lit(None).cast("string"), "via": F.array().cast("array<string>"), "quiet": F.lit(False), "one_sided": F.lit(False), "right": F.lit(True), "includes": F.array().cast("array<string>"), "parts": F.lit(1)}
    steps = steps.withColumns({c: v for c, v in lacking.items() if c not in steps.columns}).filter(~((F.col("type") == "cross") & F.coalesce("quiet", F.lit(False))))
    order = Window.partitionBy("route").orderBy("seq")
    walk = F.col("type") == "walk"
    where = F.when(F.size("streets") > 1, F.concat(F.lit("the corner of "), F.get("streets", F.lit(0)), F.lit(" and "), F.get("streets", F.lit(1)))).otherwise(F.get("streets", F.lit(0)))
    about = (halves_up(F.col("dist_m") / 10) * 10).cast("long").cast("string")
    # The sentences
    go, begun = F.when(F.col("drive"), "drive").otherwise("walk"), F.coalesce("_first", F.lit(False))
    label = text.base_name(F.col("label"))
    lead = F.when(begun & (F.col("start_kind") == "parking") & label.isNotNull(), F.concat(F.lit("Park on "), label, F.lit(". "))).otherwise("")
    leaving = F.when(begun & (F.col("start_kind") == "me"), F.concat(F.lit("From where you are, "), go)).when(begun & label.isNotNull() & ~F.coalesce("start_kind", F.lit("")).isin("parking", "spot"), F.concat(F.lit("From "), label, F.lit(", "), go)).otherwise(F.initcap(go))
    passed = F.slice(F.filter(F.array_except("via", "streets"), lambda s: ~s.rlike("^Unknown Road")), F.lit(1), F.lit(3))
    along_via = F.when(F.size(passed) > 0, F.concat(F.lit(" via "), _said(passed))).otherwise("")
    coming = F.when(F.col("dist_m") > NEAR_START_M, F.concat(lead, leaving, F.lit(" to "), where, along_via, F.lit(" (about "), about, F.lit(" m, nothing to deliver on the way)."))).when(F.col("_first"), F.concat(lead, F.lit("Start at "), where, F.lit(".")))
    over = F.concat(F.when(F.col("back"), "Cross back over ").otherwise("Cross over "), F.array_join("streets", " / "), F.lit("."))
    told = steps.withColumn("_first", F.row_number().over(Window.partitionBy("route", "type").orderBy("seq")) == 1)
    told = told.withColumn("_said", F.when(F.col("type") == "approach", coming).when(F.col("type") == "cross", over)).withColumn("_w", F.sum(F.when(walk, 1).otherwise(0)).over(order) + F.when(walk, 0).otherwise(1))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_said").isNotNull(), F.struct("seq", "_said")))), lambda s: s["_said"]), " ")
    before = told.filter(~walk).groupBy("route", "_w").agg(text_of.alias("pre"), F.lit(True).alias("apart"))
    ways = told.filter(walk).join(before, ["route", "_w"], "left").withColumns({"apart": F.col("apart").isNotNull(), "pre": F.coalesce("pre", F.lit(""))})
    ways = ways.withColumns({f"_{c}": F.lag(c).over(order) for c in ("street", "pass", "in_bearing")})
    change = F.pmod(F.col("out_bearing") - F.col("_in_bearing") + 540.0, F.lit(360.0)) - 180.0
    ways = ways.withColumns({"_turn": change, "_fork": (F.col("_street") == F.col("street")) & (F.col("degree") >= 3) & (F.abs(change) >= FORK_DEGREES)})
    fresh = F.col("_street").isNull() | F.col("apart")
    on_back = (F.col("pass") == "back") & (F.col("_pass") == "back")
    begins = fresh | (~on_back & ((F.col("_street") != F.col("street")) | F.col("uturn") | F.col("_fork") | (F.col("_pass") != F.col("pass"))))
    ways = ways.withColumns({"_fresh": fresh, "n": F.sum(F.when(begins, 1).otherwise(0)).over(order)})
    homes = F.when((F.col("pass") == "side") & F.col("one_sided"), F.col("homes")).when(F.col("pass") == "side", F.col("homes") / 2).when(F.col("pass") == "both", F.col("homes")).otherwise(0.0)
    kept = ("street", "pass", "pre", "uturn", "a_x", "a_y", "_street", "_turn", "_fork", "_fresh", "right", "parts")
    sign = F.when(F.col("right"), -1.0).otherwise(1.0)
    beside = [F.sum((F.col("a_y") - F.col("b_y")) * sign).alias("side_x"), F.sum((F.col("b_x") - F.col("a_x")) * sign).alias("side_y")]
    short = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("pass") != "back", F.struct("seq", "includes")))), lambda s: s["includes"]))).alias("short")
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "street"))), lambda s: s["street"]))
    legs = ways.groupBy("route", "n").agg(*[F.min_by(c, "seq").alias(c) for c in kept], F.max_by("b_x", "seq").alias("b_x"), F.max_by("b_y", "seq").alias("b_y"), F.sum(homes).alias("homes"), F.sum("length_m").alias("length_m"), seen.alias("seen"), *beside, short)
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    far = F.sqrt(dx * dx + dy * dy) > F.greatest(F.lit(20.0), F.col("length_m") * 0.25)
    legs = legs.withColumn("dir", F.when(far, compass(F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0)))))
    sides = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])
    along = F.when(F.col("dir").isNotNull(), F.concat(sides[F.col("dir")], F.lit(" along "), F.col("street"))).otherwise(F.concat(F.lit("round "), F.col("street")))
    verb = lambda w, d: F.when(F.col("pass") == "side", w).otherwise(d)
    rest = F.slice("seen", F.lit(2), F.greatest(F.size("seen") - 1, F.lit(1)))
    via = F.when(F.size("seen") > 1, F.concat(F.get("seen", F.lit(0)), F.lit(", then "), _said(rest))).otherwise(F.col("street"))
    turned = F.when(F.abs("_turn") < STRAIGHT_DEGREES, "straight").when(F.abs("_turn") > ROUND_DEGREES, "round").when(F.col("_turn") < 0, "left").otherwise("right")
    returning = F.col("uturn") & ~F.col("_fresh")
    back = F.when(returning, F.concat(F.lit("At the end of "), F.col("_street"), F.lit(", turn round and head back along "), via, F.lit(". Both sides are already done."))).otherwise(F.concat(F.lit("Head back along "), via, F.lit(" (already done).")))
    on = (
        F.when(F.col("_fresh") & (F.col("pre") != ""), F.concat(F.lit("Then "), verb("walk ", "drive "), along, F.lit(".")))
        .when(F.col("_fresh"), F.concat(verb("Walk ", "Drive "), along, F.lit(".")))
        .when(F.col("uturn"), F.concat(F.lit("At the end of "), F.col("_street"), F.lit(", cross over and come back down the other side.")))
        .when(F.col("_fork") & (turned == "straight"), F.concat(F.lit("Carry straight on, staying on "), F.col("street"), F.lit(".")))
        .when(F.col("_fork"), F.concat(F.lit("Turn "), turned, F.lit(" to stay on "), F.col("street"), F.lit(" (it branches here).")))
        .when(turned == "straight", F.concat(F.lit("Carry straight on into "), F.col("street"), F.lit(".")))
        .when(turned == "round", F.concat(F.lit("Turn round into "), F.col("street"), F.lit(".")))
        .otherwise(F.concat(F.lit("Turn "), turned, F.lit(" into "), F.col("street"), F.lit(".")))
    )
    tail = F.when(F.col("pass") == "both", " Deliver both sides as you go.").when(F.col("pass") == "sidedone", " This side's already been done, so nothing to deliver.").otherwise("")
    others = F.array_remove("short", F.col("street"))
    named = F.when(F.size(others) > 0, F.concat(F.lit(" Includes "), F.array_join(others, " and "), F.lit(" (a very short road here)."))).otherwise("")
    action = F.when(F.col("pass") == "back", back).otherwise(F.concat(on, tail, named))
    word = sides[compass(F.pmod(F.degrees(F.atan2("side_x", "side_y")) + 360.0, F.lit(360.0)))]
    side = F.when(F.col("pass") == "back", "already done").when(F.col("pass") == "both", "both sides").otherwise(F.concat(word, F.when(F.col("pass") == "sidedone", " side (already done)").otherwise(" side")))
    pavement = F.when(F.col("pass").isin("both", "back"), F.col("pass")).when(F.col("right"), "right").otherwise("left")
    # what is said after a route's last walk
    last = told.groupBy("route").agg(F.count_if(walk).alias("_walks"))
    after = told.filter(~walk).groupBy("route", "_w").agg(text_of.alias("_rest")).join(last, "route").filter(F.col("_w") > F.col("_walks")).select(F.col("route").alias("_r"), "_rest")
    final = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("n"))) == 1
    # The closing words
    end = F.when(F.col("parts") == 1, "That's the route done, and you're back where you started.").otherwise("That's the route done.")
    out = legs.join(after, F.col("route") == F.col("_r"), "left").withColumn("_last", final)
    return out.select("route", "n", "street", F.trim(F.concat_ws(" ", "pre", action)).alias("cue"), "homes", "length_m", "dir", side.alias("side"), pavement.alias("pavement"), (F.col("pass") == "sidedone").alias("already_done"), F.when(F.col("_last"), F.concat_ws(" ", F.when(F.col("_rest") != "", F.col("_rest")), end)).alias("end_cue"))
