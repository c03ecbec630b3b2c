"""Proximity joins as equi joins on grid cells: one side is in its own cell, the other in the cells around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _cell(v: Column, size: int) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def around(df: DataFrame, x: str, y: str, tol: int) -> DataFrame:
    """df once for each of the 3 x 3 cells around its position: cx, cy."""
    step = lambda: F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return df.withColumn("cx", F.explode(F.transform(step(), lambda i: _cell(F.col(x), tol) + i))).withColumn("cy", F.explode(F.transform(step(), lambda i: _cell(F.col(y), tol) + i)))


#: A cell is so many tolerances wide: a position is within tol of 2.25 cells on average, and of four at most.
WIDE = 4


def within(a: DataFrame, b: DataFrame, tol: int, *, circle: bool = True) -> DataFrame:
    """Pairs of rows of a (node_a, ax, ay, ..) and b (node_b, bx, by, ..) within tol, each once; d2 is the squared distance.

    Rows of a go to all cells within tol of them, rows of b to their own, so each pair meets in one cell only.
    """
    size = WIDE * tol
    span = lambda c: F.explode(F.sequence(_cell(F.col(c) - tol, size), _cell(F.col(c) + tol, size)))
    left = a.withColumn("cx", span("ax")).withColumn("cy", span("ay"))
    right = b.withColumn("cx", _cell(F.col("bx"), size)).withColumn("cy", _cell(F.col("by"), size))
    met = left.join(right, ["cx", "cy"]).drop("cx", "cy")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    met = met.withColumn("d2", dx * dx + dy * dy)
    return met.where(F.col("d2") <= tol * tol) if circle else met.where((F.abs(dx) < tol) & (F.abs(dy) < tol))


def once(df: DataFrame, keep: list, **made: Column) -> DataFrame:
    """df's columns `keep` and those of `made`, computed once for each row.

    Spark would put filters on plain columns into the condition of the join below, each with all that its columns are
    made of. The condition of a join of many pairs then becomes a method that is too long for the JVM to compile, and
    every pair is interpreted. What explode gives is not moved.
    """
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items())))).alias("_once")
    out = df.select(*keep, one)
    return out.select(*out.columns[:-1], *(F.col(f"_once.{n}").alias(n) for n in made))


def point_segments(points: DataFrame, segments: DataFrame, tol: int, cell: int) -> DataFrame:
    """Points (px, py, ..) with the segments (ax, ay, bx, by, ..) whose box is within tol: segments go to the cells they cover."""
    low = lambda a, b: _cell(F.least(a, b) - tol, cell)
    high = lambda a, b: _cell(F.greatest(a, b) + tol, cell)
    spread = segments.withColumn("cx", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx")))).withColumn("cy", F.explode(F.sequence(low("ay", "by"), high("ay", "by"))))
    placed = points.withColumn("cx", _cell(F.col("px"), cell)).withColumn("cy", _cell(F.col("py"), cell))
    met = placed.join(spread, ["cx", "cy"]).drop("cx", "cy")
    return met.where(F.col("px").between(F.least("ax", "bx") - tol, F.greatest("ax", "bx") + tol) & F.col("py").between(F.least("ay", "by") - tol, F.greatest("ay", "by") + tol))
