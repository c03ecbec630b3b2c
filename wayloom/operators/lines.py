"""Lines as arrays of points (x, y) in whole units: snapping, repair, filters, measures, text, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .gridjoin import once

POINTS = "array<struct<x:bigint,y:bigint>>"
MAX_POINTS = 10_000


def from_vertices(vertices: DataFrame) -> DataFrame:
    """(way_id, line) of (way_id, seq, x_e7, y_e7)."""
    points = F.array_sort(F.collect_list(F.struct("seq", F.col("x_e7").alias("x"), F.col("y_e7").alias("y"))))
    return vertices.groupBy("way_id").agg(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def without_repeats(line: Column) -> Column:
    """The line without points that are missing or equal the one before."""
    there = F.filter(line, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    before = F.concat(F.array(F.lit(None).cast("struct<x:bigint,y:bigint>")), there)  # one longer, so the last pair has no point
    pairs = F.zip_with(there, before, lambda p, q: F.struct(p.alias("p"), (p.isNotNull() & ~p.eqNullSafe(q)).alias("new")))
    return F.transform(F.filter(pairs, lambda x: x["new"]), lambda x: x["p"])


def snapped(df: DataFrame, grid: int) -> DataFrame:
    """Every point on the nearest multiple of grid (halves up)."""
    at = lambda v: F.floor((v + grid // 2) / F.lit(grid)).cast("long") * grid
    moved = df.withColumn("line", F.transform("line", lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y"))))
    return moved.withColumn("line", without_repeats(F.col("line")))


def usable(df: DataFrame, most: int = MAX_POINTS) -> DataFrame:
    """Lines that are not null, of 2 to `most` points and some length."""
    return df.where(F.col("line").isNotNull() & F.size("line").between(2, most) & (length("line") > 0))


def wkt(line) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def distinct_lines(df: DataFrame) -> DataFrame:
    """(way_id, n_points, wkt, n_same): the smallest way of each geometry."""
    text = df.select("way_id", F.size("line").cast("long").alias("n_points"), wkt("line").alias("wkt"))
    return text.groupBy("n_points", "wkt").agg(F.min("way_id").alias("way_id"), F.count("*").alias("n_same")).select("way_id", "n_points", "wkt", "n_same")


def _steps(line) -> Column:
    """Each segment's length d and middle x, y."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    dx, dy = (lambda a, b: b["x"] - a["x"]), (lambda a, b: b["y"] - a["y"])
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(F.sqrt((dx(a, b) * dx(a, b) + dy(a, b) * dy(a, b)).cast("double")).alias("d"), ((a["x"] + b["x"]) / 2.0).alias("x"), ((a["y"] + b["y"]) / 2.0).alias("y")))


def length(line) -> Column:
    return F.aggregate(_steps(line), F.lit(0.0), lambda acc, s: acc + s["d"])


def centroid(line, axis: str, origin: int) -> Column:
    """The middle along one axis, segments weighed by length, counted from origin."""
    return F.try_divide(F.aggregate(_steps(line), F.lit(0.0), lambda acc, s: acc + s["d"] * (s[axis] - origin)), length(line))


def best_overlap(pieces: DataFrame, sources: DataFrame, cell: int = 4000) -> DataFrame:
    """(piece_way, piece_seq, src, overlap): the source way that a piece lies on for longest (ties: the smallest way).

    Both go to the cells of their boxes; a pair counts in the cell of the lower corner of the boxes' overlap, so once.
    """
    floor = lambda v: F.floor(v / F.lit(cell)).cast("long")
    c = F.col
    lo_x, hi_x, lo_y, hi_y = F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")

    def spread(df: DataFrame, s: str) -> DataFrame:
        cells = df.withColumn("cx", F.explode(F.sequence(floor(lo_x), floor(hi_x)))).withColumn("cy", F.explode(F.sequence(floor(lo_y), floor(hi_y))))
        return cells.select("cx", "cy", *(c(k).alias(f"{s}_{k}") for k in ("way_id", "seq_a", "ax", "ay", "bx", "by")), lo_x.alias(f"{s}_lx"), hi_x.alias(f"{s}_hx"), lo_y.alias(f"{s}_ly"), hi_y.alias(f"{s}_hy"))

    met = spread(pieces, "p").join(spread(sources, "s"), ["cx", "cy"]).where("p_lx <= s_hx AND s_lx <= p_hx AND p_ly <= s_hy AND s_ly <= p_hy")
    met = met.where((floor(F.greatest("p_lx", "s_lx")) == c("cx")) & (floor(F.greatest("p_ly", "s_ly")) == c("cy")))
    sx, sy = c("s_bx") - c("s_ax"), c("s_by") - c("s_ay")
    ends = [(c(f"p_{k}x") - c("s_ax"), c(f"p_{k}y") - c("s_ay")) for k in ("a", "b")]
    along = [x * sx + y * sy for x, y in ends]
    on = [x * sy - y * sx == 0 for x, y in ends]
    full = sx * sx + sy * sy
    shared = F.greatest(F.lit(0), F.least(F.greatest(*along), full) - F.greatest(F.least(*along), F.lit(0))).cast("double") / F.sqrt(full.cast("double"))
    tried = once(met, [c("p_way_id").alias("piece_way"), c("p_seq_a").alias("piece_seq"), c("s_way_id").alias("src")], on=on[0] & on[1] & (full > 0), exact=F.when(full > 0, shared))
    held = tried.where(F.col("on") & (F.col("exact") > 0)).withColumn("overlap", F.round("exact", 3))
    best = held.groupBy("piece_way", "piece_seq").agg(F.max(F.struct("overlap", (-c("src")).alias("m"))).alias("b"))
    return best.select("piece_way", "piece_seq", (-c("b.m")).alias("src"), c("b.overlap").alias("overlap"))
