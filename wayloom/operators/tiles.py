"""Tiles that are finer where there is more: leaves of a tree of squares, and rows dealt out to them.

A tile is (size, tx, ty): the square [tx * size, (tx + 1) * size) x [ty * size, (ty + 1) * size). Sizes go down by FANOUT.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import staged

FANOUT = 4


def _cell(v: Column, size: Column | int) -> Column:
    return F.floor(v / (F.lit(size) if isinstance(size, int) else size)).cast("long")


@dataclass
class Tree:
    cut: DataFrame  # size, tx, ty: the tiles that are cut
    sizes: list[int]  # from the largest down


def tree(segs: DataFrame, size: int, most: int, depth: int) -> Tree:
    """Tiles of `size`, cut where the middles of more than `most` segments (ax, ay, bx, by) lie in one, `depth` times at
    most; then it stays whole. Counted in one pass, the smallest tiles first and the larger ones as sums of them."""
    sizes = [size // FANOUT**d for d in range(depth + 1) if size >= FANOUT**d]
    middle = lambda a, b: _cell(F.floor((F.col(a) + F.col(b)) / 2), sizes[-1])
    fine = segs.groupBy(middle("ax", "bx").alias("fx"), middle("ay", "by").alias("fy")).agg(F.count("*").alias("n"))
    up = fine.withColumn("size", F.explode(F.array(*map(F.lit, sizes)).cast("array<long>")))
    up = up.select("size", *(F.floor(F.col(f) * sizes[-1] / F.col("size")).cast("long").alias(t) for f, t in (("fx", "tx"), ("fy", "ty"))), "n")
    cut = staged(up.groupBy("size", "tx", "ty").agg(F.sum("n").alias("n")).where((F.col("n") > most) & (F.col("size") > sizes[-1])).select("size", "tx", "ty"), "tiles")
    used = {r["size"] for r in cut.select("size").distinct().collect()}  # one for each depth at most
    return Tree(cut, sizes[: len(used) + 1])


def over(rows: DataFrame, size: int, margin: int = 0) -> DataFrame:
    """rows (ax, ay, bx, by, ..) in each tile of one size that its box, widened by margin, meets."""
    span = lambda a, b: F.explode(F.sequence(_cell(F.least(a, b) - margin, size), _cell(F.greatest(a, b) + margin, size)))
    return rows.withColumn("size", F.lit(size).cast("long")).withColumn("tx", span("ax", "bx")).withColumn("ty", span("ay", "by"))


def deal(rows: DataFrame, tiles: Tree | int, margin: int = 0) -> DataFrame:
    """rows (ax, ay, bx, by, ..) with size, tx, ty: once for each tile that is not cut and that its box, widened by margin, meets. tiles: a tree, or one size for all.

    In one pass: at each size rows of cut tiles go on to the smaller tiles that they meet, the others stay where they are."""
    if isinstance(tiles, int):
        return over(rows, tiles, margin)
    out = over(rows, tiles.sizes[0], margin)
    names = out.columns
    for size in tiles.sizes[:-1]:
        met = out.join(tiles.cut.where(F.col("size") == size).withColumn("_cut", F.lit(True)), ["size", "tx", "ty"], "left").select(*names, F.coalesce("_cut", F.lit(False)).alias("_cut"))
        small = size // FANOUT

        def span(a, b, t, small=small):
            low, high = F.col(t) * FANOUT, F.col(t) * FANOUT + FANOUT - 1
            cut = F.sequence(F.greatest(low, _cell(F.least(a, b) - margin, small)), F.least(high, _cell(F.greatest(a, b) + margin, small)))
            return F.explode(F.when(F.col("_cut"), cut).otherwise(F.array(t)))

        met = met.withColumn("_x", span("ax", "bx", "tx")).withColumn("_y", span("ay", "by", "ty")).withColumn("size", F.when(F.col("_cut"), F.lit(small).cast("long")).otherwise(F.col("size")))
        out = met.drop("tx", "ty", "_cut").withColumnsRenamed({"_x": "tx", "_y": "ty"}).select(names)
    return out


def inside(x: Column, y: Column) -> Column:
    """Whether a position is in the row's own tile: of a pair that meets in many tiles, the one that counts."""
    held = lambda v, t: (v >= F.col(t) * F.col("size")) & (v < (F.col(t) + 1) * F.col("size"))
    return held(x, "tx") & held(y, "ty")
