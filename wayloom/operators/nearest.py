"""Exact nearest-neighbour joins through grids that grow coarser until the k-th distance is proven."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.staging import staged
from .gridjoin import around


#: Pairs that one task compares, as expected from the density.
TASK_PAIRS = 1_000_000


def nearest_join(points: DataFrame, others: DataFrame, k: int = 1, key: str = "id", other: str = "node", per_cell: int = 1) -> DataFrame:
    """(key, rank, other, d2): the k of others (other, x_e7, y_e7) nearest each of points (key, x_e7, y_e7) by planar distance, ties by other.

    A point meets the 3 x 3 cells around it, at first with about per_cell * k others each. What lies outside is at least
    as far as the edge of those cells; where the k-th distance is not less, or fewer than k are there, the point goes on
    with cells of twice the size. At one position the k smallest of others are enough, so a hot position is no hot cell.
    With fewer than k others every point has all of them. keys are unique; rows with nulls have no neighbours.
    """
    place = "x_e7 IS NOT NULL AND y_e7 IS NOT NULL"
    right = others.where(place).select(F.col(other).alias("other"), F.col("x_e7").cast("long").alias("bx"), F.col("y_e7").cast("long").alias("by"))
    right = staged(right.withColumn("_r", F.row_number().over(W.partitionBy("bx", "by").orderBy("other"))).where(F.col("_r") <= k).drop("_r"), "others") if k else right
    box = right.agg(F.min("bx"), F.min("by"), F.max("bx"), F.max("by"), F.count("*")).first()
    left = points.where(place).select(F.col(key).alias("key"), F.col("x_e7").cast("long").alias("x"), F.col("y_e7").cast("long").alias("y"))
    todo = left.count()
    if box[0] is None or not todo:
        return left.select(F.col("key").alias(key), F.lit(1).cast("long").alias("rank"), F.lit(None).cast(others.schema[other].dataType).alias(other), F.lit(None).cast("long").alias("d2")).limit(0)
    x0, y0, x1, y1, n = box
    size = 1
    while size * size * n < (x1 - x0 + 1) * (y1 - y0 + 1) * k * per_cell:
        size *= 2
    found = []
    while todo:
        cell = lambda c: F.floor(F.col(c) / F.lit(size)).cast("long")  # noqa: B023, E731
        # The block of a point holds all others: nothing is outside.
        whole = (cell("x") * size - size <= x0) & (cell("x") * size + 2 * size > x1) & (cell("y") * size - size <= y0) & (cell("y") * size + 2 * size > y1)
        edge = F.least(*(size + F.least(F.col(c) - cell(c) * size, (cell(c) + 1) * size - F.col(c)) for c in ("x", "y")))
        # A pair is made from few bytes, so tasks are dealt out by the pairs to come, not by the bytes that make them.
        tasks = 1 + 9 * todo * min(n, 1 + n * size * size // ((x1 - x0 + 1) * (y1 - y0 + 1))) // TASK_PAIRS
        near = around(left.withColumn("edge", F.when(~whole, edge)), "x", "y", size).repartition(tasks, "cx", "cy")
        met = near.join(right.withColumn("cx", cell("bx")).withColumn("cy", cell("by")).repartition(tasks, "cx", "cy"), ["cx", "cy"])
        met = met.withColumn("d2", (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))
        w = W.partitionBy("key").orderBy("d2", "other")
        best = staged(met.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("key", "edge", "rank", "other", "d2"), "nearest")
        last = best.groupBy("key", "edge").agg(F.count("*").alias("n"), F.max("d2").alias("far"))
        proven = last.where(F.col("edge").isNull() | ((F.col("n") == min(k, n)) & (F.col("far") < F.col("edge") * F.col("edge")))).select("key")
        found.append(best.join(proven, "key", "left_semi"))
        left = staged(left.join(proven, "key", "left_anti"), "unproven")
        todo = left.count()
        size *= 2
    return reduce(DataFrame.union, found).select(F.col("key").alias(key), "rank", F.col("other").alias(other), "d2")
