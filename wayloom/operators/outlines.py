"""Outlines of what is reached: squares along the reached edges, the sides between them and the rest, traced into rings."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import connected_components

PLACE = ["source", "contour"]


def squares(reached: DataFrame, edges: DataFrame, nodes: DataFrame, size: int, levels: int) -> DataFrame:
    """(source, contour, cx, cy): squares of the plane on the edges (src, dst) between nodes (node, x_e7, y_e7) reached within
    each contour, and those of the nodes. reached: source, node, contour, the first in which a node lies; inner contours count."""
    at = nodes.select("node", F.col("x_e7").alias("x"), F.col("y_e7").alias("y"))
    placed = reached.select("source", "node", "contour").join(at, "node")
    a = placed.select("source", F.col("node").alias("src"), F.col("contour").alias("c1"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = placed.select("source", F.col("node").alias("dst"), F.col("contour").alias("c2"), F.col("x").alias("bx"), F.col("y").alias("by"))
    ways = edges.select("src", "dst").distinct().join(a, "src").join(b, ["source", "dst"]).select("source", F.greatest("c1", "c2").alias("contour"), "ax", "ay", "bx", "by")
    alone = placed.select("source", "contour", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    steps = (F.lit(1) + F.floor(2 * F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / F.lit(size))).cast("long")
    walked = ways.union(alone).withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    cell = lambda c: F.floor((F.col(f"a{c}") + F.floor((F.col(f"b{c}") - F.col(f"a{c}")) * F.col("i") / F.col("n"))) / F.lit(size)).cast("long")
    first = walked.groupBy("source", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.min("contour").alias("first"))
    return first.withColumn("contour", F.explode(F.sequence(F.col("first"), F.lit(levels).cast("long")))).select(*PLACE, "cx", "cy")


def without_islands(cells: DataFrame, share: float) -> DataFrame:
    """cells without the parts, connected through sides or corners, of less than `share` of the squares of their contour's largest part."""
    name = F.concat_ws("/", *PLACE, "cx", "cy")
    here = cells.withColumn("id", name)
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))))
    beside = here.withColumn("m", F.explode(moves)).select("source", "contour", (F.col("cx") + F.col("m.dx")).alias("cx"), (F.col("cy") + F.col("m.dy")).alias("cy"), F.col("id").alias("a"))
    part = connected_components(beside.join(here.withColumnRenamed("id", "b"), [*PLACE, "cx", "cy"]).select("a", "b"))
    sized = here.join(part, here["id"] == part["node"]).select(*PLACE, "cx", "cy", "component")
    n = sized.groupBy(*PLACE, "component").agg(F.count("*").alias("n"))
    most = n.groupBy(*PLACE).agg(F.max("n").alias("most"))
    kept = n.join(most, PLACE).where(F.col("n") >= share * F.col("most")).select(*PLACE, "component")
    return sized.join(kept, [*PLACE, "component"], "left_semi").select(*PLACE, "cx", "cy")


def sides(cells: DataFrame) -> DataFrame:
    """(source, contour, ax, ay, bx, by): the outer sides of cells, with the inside on the left; sides in one line that follow each other are one."""
    # The neighbour across, and the side's ends in the square's own corners.
    four = [(0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)]
    names = ("dx", "dy", "ax", "ay", "bx", "by")
    each = cells.withColumn("s", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, f, strict=True))) for f in four))))
    across = each.withColumn("nx", F.col("cx") + F.col("s.dx")).withColumn("ny", F.col("cy") + F.col("s.dy"))
    there = cells.select(*PLACE, F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    outer = across.join(there, [*PLACE, "nx", "ny"], "left_anti")
    flat = F.col("s.dx") == 0
    line, along = F.when(flat, F.col("cy") + F.col("s.ay")).otherwise(F.col("cx") + F.col("s.ax")), F.when(flat, F.col("cx")).otherwise(F.col("cy"))
    kind = F.col("s.dx") + 2 * F.col("s.dy")  # which of the four
    runs = outer.select(*PLACE, kind.alias("kind"), line.alias("line"), along.alias("along"))
    w = W.partitionBy(*PLACE, "kind", "line").orderBy("along")
    runs = runs.withColumn("run", F.col("along") - F.row_number().over(w)).groupBy(*PLACE, "kind", "line", "run").agg(F.min("along").alias("lo"), (F.max("along") + 1).alias("hi"))
    kinds = {-2: ("lo", "line", "hi", "line"), 1: ("line", "lo", "line", "hi"), 2: ("hi", "line", "lo", "line"), -1: ("line", "hi", "line", "lo")}
    value = lambda i: F.coalesce(*(F.when(F.col("kind") == k, F.col(v[i])) for k, v in kinds.items()))
    return runs.select(*PLACE, *(value(i).alias(n) for i, n in enumerate(names[2:])))


def traced(runs: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Rings of the sides (ax, ay, bx, by). Where two leave a corner the way turns left, so squares that touch at a corner only have rings of their own."""
    out = defaultdict(list)
    for ax, ay, bx, by in runs:
        out[ax, ay].append((bx, by))
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, at, to = [], start, out[start].pop()
            while True:
                ring.append(at)
                if to == start:
                    break
                turn = lambda n: (to[0] - at[0]) * (n[1] - to[1]) - (to[1] - at[1]) * (n[0] - to[0])  # noqa: B023, E731
                best = max(out[to], key=turn)
                out[to].remove(best)
                at, to = to, best
            rings.append(ring)
    return rings


def outlines(cells: DataFrame, size: int) -> DataFrame:
    """(source, contour, ring, corner, x, y): closed rings around cells, outer ones counter-clockwise and holes clockwise. A task sees the corners of one contour of one source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = traced(list(zip(*(pdf[c].tolist() for c in ("ax", "ay", "bx", "by")), strict=True)))
        rows = [(pdf["source"].iloc[0], pdf["contour"].iloc[0], i, k, x * size, y * size) for i, ring in enumerate(rings) for k, (x, y) in enumerate([*ring, ring[0]])]
        return pd.DataFrame(rows, columns=["source", "contour", "ring", "corner", "x", "y"])

    return sides(cells).groupBy(*PLACE).applyInPandas(run, "source long, contour long, ring long, corner long, x long, y long")


def areas(rings: DataFrame) -> DataFrame:
    """(source, contour, area): what the rings enclose, holes taken off."""
    w = W.partitionBy(*PLACE, "ring").orderBy("corner")
    step = rings.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).where("nx IS NOT NULL")
    twice = F.sum((F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).cast("decimal(38,0)"))
    return step.groupBy(*PLACE).agg((twice / 2).cast("long").alias("area"))
