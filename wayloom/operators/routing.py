"""Travel times, reachability, routes and stop orders over a directed edge table (src, dst, seconds)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.staging import staged
from .areas import convex_hull
from .overlay import Overlay

#: Tours of so many stops are solved exactly.
EXACT_STOPS = 11


def _leading(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges to nodes from which a target (node) can be reached: all that ways to the targets can use."""
    found = staged(targets.select("node", F.lit(True).alias("new")).distinct(), "leading")
    e = edges.select(F.col("dst").alias("node"), "src")
    while not (front := found.where("new")).isEmpty():
        step = front.join(e, "node").select(F.col("src").alias("node"), F.lit(True).alias("new"))
        found = staged(found.select("node", F.lit(False).alias("new")).union(step).groupBy("node").agg(F.min("new").alias("new")), "leading")
    return staged(edges.join(found.select(F.col("node").alias("dst")), "dst", "left_semi"), "edges")


def shortest(edges: DataFrame, sources: DataFrame, limit: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(source, node, seconds, via): least time from each source (at most `limit` seconds), and the node before it.

    Frontier relaxation: each round joins only the nodes that got a better time with their edges, until none did; rounds
    are as many as a shortest path has edges. No adjacency is gathered anywhere. Seconds must not be negative. With
    `targets` (node) only nodes on ways to one of them are searched, each still with its least time.
    """
    if targets is not None:
        edges = _leading(edges, targets)
    if not edges.where("seconds < 0").isEmpty():
        raise ValueError("seconds must not be negative")
    start = sources.select(F.col("node").alias("source"), "node").distinct()
    best = staged(start.select("source", "node", F.lit(0).cast("long").alias("seconds"), F.lit(None).cast("long").alias("via"), F.lit(True).alias("new")), "reached")
    e = edges.select(F.col("src").alias("node"), "dst", F.col("seconds").alias("cost"))
    while not (front := best.where("new")).isEmpty():
        step = front.join(e, "node").select("source", F.col("dst").alias("node"), (F.col("seconds") + F.col("cost")).alias("seconds"), F.col("node").alias("via"))
        if limit is not None:
            step = step.where(F.col("seconds") <= limit)
        both = best.select("source", "node", "seconds", "via", F.lit(False).alias("new")).union(step.withColumn("new", F.lit(True)))
        m = both.groupBy("source", "node").agg(F.min(F.struct("seconds", "new", "via")).alias("m"))
        best = staged(m.select("source", "node", "m.seconds", "m.via", "m.new"), "reached")
    return best.drop("new")


def matrix(edges: DataFrame, sources: DataFrame, targets: DataFrame, limit: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(source, target, seconds) for every pair; null where there is no way, or none within `limit` seconds.

    With a limit the search spreads that far by frontiers; without one it climbs an overlay of cells, which are cut by
    the positions of nodes (node, x_e7, y_e7) or, without them, by node.
    """
    if limit is None:
        reached = Overlay.build(edges, nodes).times(sources, targets)
    else:
        reached = shortest(edges, sources, limit, targets).select("source", F.col("node").alias("target"), "seconds")
    pairs = sources.select(F.col("node").alias("source")).distinct().crossJoin(targets.select(F.col("node").alias("target")).distinct())
    return pairs.join(reached, ["source", "target"], "left").select("source", "target", "seconds")


def contours(edges: DataFrame, sources: DataFrame, every: int, levels: int) -> DataFrame:
    """(source, node, seconds, contour): nodes within every * levels seconds by the contour they first lie in."""
    near = shortest(edges, sources, every * levels)
    return near.select("source", "node", "seconds", F.greatest(F.lit(1), F.ceil(F.col("seconds") / every)).cast("long").alias("contour"))


def contour_hulls(reached: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(source, contour, corner, x, y): the convex hull of the nodes (node, x_e7, y_e7) reached within each contour, the inner ones included.

    Corners are found by source, contour and part of the nodes first, so a group's task sees corners only.
    """
    up_to = F.explode(F.sequence(F.col("contour"), F.lit(levels).cast("long")))
    placed = reached.select("source", "node", up_to.alias("contour")).join(nodes, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(64)))

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(convex_hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True))), columns=["x", "y"], dtype="int64")
        return out.assign(source=pdf["source"].iloc[0], contour=pdf["contour"].iloc[0], corner=range(len(out)))[["source", "contour", "corner", "x", "y"]]

    kind = "source long, contour long, corner long, x long, y long"
    some = placed.select("source", "contour", "part", F.col("x_e7").alias("x"), F.col("y_e7").alias("y")).groupBy("source", "contour", "part").applyInPandas(corners, kind)
    return some.groupBy("source", "contour").applyInPandas(corners, kind)


def routes(edges: DataFrame, requests: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(request, step, node, seconds) along one shortest route of each request (request, source, target), through an overlay of cells."""
    return Overlay.build(edges, nodes).routes(requests)


def _exact(cost: dict, stops: list, closed: bool) -> tuple[float, list]:
    """The cheapest order that starts at stops[0] (of equal ones the least), by the sets of stops visited."""
    far, first, n = float("inf"), stops[0], len(stops)
    best = {(1, 0): (0.0, [first])}
    for size in range(1, n):
        after: dict = {}
        for (seen, last), (c, order) in best.items():
            for k in range(1, n):
                if not seen >> k & 1:
                    new = (c + cost.get((stops[last], stops[k]), far), [*order, stops[k]])
                    key = (seen | 1 << k, k)
                    if key not in after or new < after[key]:
                        after[key] = new
        best = after
    back = lambda o: cost.get((o[-1], first), far) if closed and n > 1 else 0
    return min((c + back(o), o) for c, o in best.values())


def _order(cost: dict, stops: list, closed: bool) -> tuple[float, list]:
    """The cheapest order that starts at stops[0]: exact for up to EXACT_STOPS, nearest neighbour and 2-opt beyond (tours are hard)."""

    def total(order):
        legs = [cost.get(p, float("inf")) for p in zip(order, order[1:], strict=False)]
        return sum(legs) + (cost.get((order[-1], order[0]), float("inf")) if closed and len(order) > 1 else 0)

    first, rest = stops[0], stops[1:]
    if len(stops) <= EXACT_STOPS:
        return _exact(cost, stops, closed)
    order, left = [first], set(rest)
    while left:
        n = min(left, key=lambda s: (cost.get((order[-1], s), float("inf")), s))
        order.append(n)
        left.remove(n)
    better = True
    while better:
        better = False
        for i in range(1, len(order) - 1):
            for j in range(i + 1, len(order)):
                new = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if total(new) < total(order) - 1e-9:
                    order, better = new, True
    return total(order), order


def stop_orders(costs: DataFrame, closed: bool = True) -> DataFrame:
    """(request, cost, visit, stop) for requests of (request, a, b, cost) with every pair of stops; the smallest stop is first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cost = {(a, b): c for a, b, c in zip(pdf["a"], pdf["b"], pdf["cost"], strict=True)}
        total, order = _order(cost, sorted(set(pdf["a"]) | set(pdf["b"])), closed)
        return pd.DataFrame({"request": pdf["request"].iloc[0], "cost": total, "visit": range(len(order)), "stop": order})

    return costs.groupBy("request").applyInPandas(run, "request long, cost double, visit long, stop long")


def maneuvers(line: str = "shape", steps: str = "maneuvers") -> str:
    """SQL for the points of each maneuver (begin, end inclusive) of a route's line; shorter ones than two points go."""
    return f"filter(transform({steps}, (m, i) -> struct(i AS rank, slice({line}, m.begin + 1, m.end - m.begin + 1) AS points, m.length AS length, m.time AS time)), x -> size(x.points) >= 2)"
