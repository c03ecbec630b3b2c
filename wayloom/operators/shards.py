"""A graph built by shards: their bounds, ids of their own, the merge; and tiles that are finer where it is dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.staging import staged, with_offsets
from .areas import bounds, shard_assign
from .topology import extract_nodes

#: Ids of a shard's nodes start at its number times this.
STRIDE = 1_000_000_000


def shard_bounds(vertices: DataFrame, rows: int, cols: int) -> DataFrame:
    """(shard_row, shard_col, core_x0, core_y0, core_x1, core_y1), upper bounds exclusive: a table of rows * cols rows."""
    b = bounds(vertices)  # one row
    w, h = (F.floor((F.col("x1") - F.col("x0")) / cols) + 1).cast("long"), (F.floor((F.col("y1") - F.col("y0")) / rows) + 1).cast("long")
    cells = b.select("x0", "y0", w.alias("w"), h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("i"))
    cells = cells.select("*", F.floor(F.col("i") / cols).cast("long").alias("shard_row"), (F.col("i") % cols).cast("long").alias("shard_col"))
    at = lambda lo, k, size: F.col(lo) + F.col(k) * F.col(size)
    return cells.select("shard_row", "shard_col", at("x0", "shard_col", "w").alias("core_x0"), at("y0", "shard_row", "h").alias("core_y0"), (at("x0", "shard_col", "w") + F.col("w")).alias("core_x1"), (at("y0", "shard_row", "h") + F.col("h")).alias("core_y1"))


def by_shard(vertices: DataFrame, rows: int, cols: int) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) with the ids that each shard gives its own nodes: negative, in the shard's range, by position.

    A way belongs to the shard it is core in. Positions that two shards share have a node in each.
    """
    core = shard_assign(vertices, rows, cols).where("is_core").select("way_id", (F.col("shard_row") * cols + F.col("shard_col") + 1).alias("shard"))
    own = staged(vertices.join(core, "way_id").select("shard", "way_id", "seq", "x_e7", "y_e7"), "sharded")
    at = own.select("shard", "x_e7", "y_e7").distinct()
    # Numbered over all shards, so that no task has to hold a whole one; each shard's numbers then start at 1.
    placed = with_offsets(at, ["shard", "x_e7", "y_e7"], "placed")
    first = placed.groupBy("shard").agg(F.min("row_no").alias("_first"))
    number = F.col("row_no") - F.col("_first") + 1
    nodes = staged(placed.join(first, "shard").select("x_e7", "y_e7", "shard", (-(F.col("shard") * STRIDE + number)).alias("node_id")), "shard_nodes")
    ways = own.join(nodes, ["shard", "x_e7", "y_e7"]).select("way_id", "seq", "node_id")
    return ways, nodes.select("node_id", "x_e7", "y_e7")


def merged(parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) of all shards as one: nodes at one position are one, numbered by position, and references follow."""
    ways, nodes = parts
    whole = staged(extract_nodes(nodes), "merged")
    became = nodes.join(whole.withColumnRenamed("node_id", "new_id"), ["x_e7", "y_e7"]).select("node_id", "new_id")
    return ways.join(became, "node_id").select("way_id", "seq", F.col("new_id").alias("node_id")), whole


def adaptive_tiles(points: DataFrame, size: int, most: int, depth: int) -> DataFrame:
    """(depth, cx, cy, size, n): tiles of points(x_e7, y_e7); one with more than `most` is cut in 4 x 4, `depth` times at most."""
    cell = lambda c, s: F.floor(F.col(c) / F.lit(s)).cast("long")
    out, left = None, points.select("x_e7", "y_e7")
    for d in range(depth + 1):
        placed = left.select("x_e7", "y_e7", cell("x_e7", size).alias("cx"), cell("y_e7", size).alias("cy"))
        counted = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"))
        done = counted if d == depth else counted.where(F.col("n") <= most)
        rows = done.select(F.lit(d).alias("depth"), "cx", "cy", F.lit(size).alias("size"), "n")
        out = rows if out is None else out.union(rows)
        left = placed.join(counted.where(F.col("n") > most).select("cx", "cy"), ["cx", "cy"], "left_semi")
        size //= 4
    return out
