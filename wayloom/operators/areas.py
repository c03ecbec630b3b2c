"""Shards, tiles, noding and coverage: work cut by area through cell keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def bounds(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.min("x_e7").alias("x0"), F.min("y_e7").alias("y0"), F.max("x_e7").alias("x1"), F.max("y_e7").alias("y1"))


def boxes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("way_id").agg(F.min("x_e7").alias("bx0"), F.min("y_e7").alias("by0"), F.max("x_e7").alias("bx1"), F.max("y_e7").alias("by1"))


def shard_assign(vertices: DataFrame, rows: int, cols: int, overlap_percent: int = 15) -> DataFrame:
    """(way_id, shard_row, shard_col, is_core): each way in every shard whose widened box its own box meets. A way is core
    in the shard of its box's middle; the last row and column are closed."""
    b = bounds(vertices)  # one row
    all_ = boxes(vertices).crossJoin(F.broadcast(b))
    w = F.floor((F.col("x1") - F.col("x0")) / cols) + 1
    h = F.floor((F.col("y1") - F.col("y0")) / rows) + 1
    placed = all_.withColumn("w", w.cast("long")).withColumn("h", h.cast("long"))
    placed = placed.withColumn("ow", F.floor(F.col("w") * overlap_percent / 100)).withColumn("oh", F.floor(F.col("h") * overlap_percent / 100))
    cell = lambda v, lo, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - F.col(lo)) / F.col(size)))).cast("long")
    spread = placed.withColumn("shard_row", F.explode(F.sequence(cell(F.col("by0") - F.col("oh"), "y0", "h", rows), cell(F.col("by1") + F.col("oh"), "y0", "h", rows))))
    spread = spread.withColumn("shard_col", F.explode(F.sequence(cell(F.col("bx0") - F.col("ow"), "x0", "w", cols), cell(F.col("bx1") + F.col("ow"), "x0", "w", cols))))
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    core = (F.col("shard_row") == cell(mid("by0", "by1"), "y0", "h", rows)) & (F.col("shard_col") == cell(mid("bx0", "bx1"), "x0", "w", cols))
    return spread.select("way_id", "shard_row", "shard_col", core.alias("is_core"))


def occupied(vertices: DataFrame, size: int) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / F.lit(size)).cast("long")
    return vertices.select(cell("x_e7").alias("cx"), cell("y_e7").alias("cy")).distinct()


def crossings(segs: DataFrame, cell: int = 4000) -> DataFrame:
    """Where two segments of different ways cross or touch at one point: (way_a, seq_a, way_b, seq_b, x, y), a < b.

    Segments go to every cell of their box; a pair counts in the cell that holds the lower corner of the boxes' overlap,
    so it is found once. Parallel segments have no single point.
    """
    floor = lambda v: F.floor(v / F.lit(cell)).cast("long")
    lo_x, hi_x, lo_y, hi_y = F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")
    s = segs.withColumn("cx", F.explode(F.sequence(floor(lo_x), floor(hi_x)))).withColumn("cy", F.explode(F.sequence(floor(lo_y), floor(hi_y))))
    a = s.select("cx", "cy", F.col("way_id").alias("way_a"), F.col("seq_a").alias("sa"), F.col("ax").alias("px"), F.col("ay").alias("py"), (F.col("bx") - F.col("ax")).alias("rx"), (F.col("by") - F.col("ay")).alias("ry"), lo_x.alias("alx"), hi_x.alias("ahx"), lo_y.alias("aly"), hi_y.alias("ahy"))
    b = s.select("cx", "cy", F.col("way_id").alias("way_b"), F.col("seq_a").alias("sb"), F.col("ax").alias("qx"), F.col("ay").alias("qy"), (F.col("bx") - F.col("ax")).alias("sx"), (F.col("by") - F.col("ay")).alias("sy"), lo_x.alias("blx"), hi_x.alias("bhx"), lo_y.alias("bly"), hi_y.alias("bhy"))
    met = a.join(b, ["cx", "cy"]).where("way_a < way_b AND alx <= bhx AND blx <= ahx AND aly <= bhy AND bly <= ahy")
    met = met.where((floor(F.greatest("alx", "blx")) == F.col("cx")) & (floor(F.greatest("aly", "bly")) == F.col("cy")))
    c = lambda n: F.col(n)
    den = c("rx") * c("sy") - c("ry") * c("sx")
    t = F.try_divide(((c("qx") - c("px")) * c("sy") - (c("qy") - c("py")) * c("sx")).cast("double"), den.cast("double"))
    u = F.try_divide(((c("qx") - c("px")) * c("ry") - (c("qy") - c("py")) * c("rx")).cast("double"), den.cast("double"))
    hit = met.withColumn("den", den).where("den <> 0").withColumn("t", t).withColumn("u", u).where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    return hit.select("way_a", F.col("sa").alias("seq_a"), "way_b", F.col("sb").alias("seq_b"), F.floor(c("px") + c("t") * c("rx") + 0.5).cast("long").alias("x"), F.floor(c("py") + c("t") * c("ry") + 0.5).cast("long").alias("y"))


def node_segments(segs: DataFrame, cell: int = 4000) -> DataFrame:
    """Segments cut at their crossings: (way_id, seq_a, piece, ax, ay, bx, by); each piece keeps its source's ids."""
    x = crossings(segs, cell)
    cuts = x.select(F.col("way_a").alias("way_id"), "seq_a", "x", "y").union(x.select("way_b", "seq_b", "x", "y")).distinct()
    points = cuts.groupBy("way_id", "seq_a").agg(F.collect_list(F.struct("x", "y")).alias("cuts"))
    joined = segs.join(points, ["way_id", "seq_a"], "left")
    far = lambda p: (p["x"] - F.col("ax")) * (p["x"] - F.col("ax")) + (p["y"] - F.col("ay")) * (p["y"] - F.col("ay"))
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<struct<x:bigint,y:bigint>>")), lambda p: ~((p["x"] == F.col("ax")) & (p["y"] == F.col("ay"))) & ~((p["x"] == F.col("bx")) & (p["y"] == F.col("by"))))
    ordered = F.transform(F.array_sort(F.transform(inner, lambda p: F.struct(far(p).alias("d"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    line = F.concat(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))), ordered, F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    lined = joined.select("way_id", "seq_a", line.alias("p"))
    pieces = lined.select("way_id", "seq_a", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("piece"))
    at = lambda i, f: F.get("p", i)[f]
    return pieces.select("way_id", "seq_a", F.col("piece").cast("long").alias("piece"), at(F.col("piece"), "x").alias("ax"), at(F.col("piece"), "y").alias("ay"), at(F.col("piece") + 1, "x").alias("bx"), at(F.col("piece") + 1, "y").alias("by"))


def coverage(vertices: DataFrame, size: int) -> DataFrame:
    """Ways by the grid cell of their box's middle: (gc, gr, n_ways), cells counted from the lower left corner."""
    b = F.broadcast(bounds(vertices))  # one row
    mid = lambda a, b_: F.floor((F.col(a) + F.col(b_)) / 2)
    cell = boxes(vertices).crossJoin(b).select(F.floor((mid("bx0", "bx1") - F.col("x0")) / size).cast("long").alias("gc"), F.floor((mid("by0", "by1") - F.col("y0")) / size).cast("long").alias("gr"))
    return cell.groupBy("gc", "gr").agg(F.count("*").alias("n_ways"))


def coverage_ratio(vertices: DataFrame, size: int) -> DataFrame:
    cells = coverage(vertices, size).agg(F.count("*").alias("n_cells"), F.sum("n_ways").alias("n_ways"))
    n = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / size), F.lit(1)).cast("long")
    return cells.crossJoin(bounds(vertices)).select("n_cells", "n_ways", (n("x0", "x1") * n("y0", "y1")).alias("n_all")).withColumn("percent", F.round(100.0 * F.col("n_cells") / F.col("n_all"), 4))


def convex_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def hull(points: DataFrame, x: str = "x_e7", y: str = "y_e7") -> DataFrame:
    """Corners (corner, x, y) of the convex hull, counter-clockwise: first by partition, so that one task sees corners only."""

    def part(batches):
        kept: list = []
        for pdf in batches:
            kept = convex_hull(kept + list(zip(pdf[x].tolist(), pdf[y].tolist(), strict=True)))
        yield pd.DataFrame(kept, columns=["x", "y"], dtype="int64")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = convex_hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        return pd.DataFrame([(i, *p) for i, p in enumerate(out)], columns=["corner", "x", "y"], dtype="int64")

    return points.select(x, y).mapInPandas(part, "x long, y long").groupBy().applyInPandas(whole, "corner long, x long, y long")


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map column and row."""
    n = float(1 << zoom)
    r = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * n)
    return x.cast("long"), y.cast("long")
