"""Lines as vector tiles: positions on a zoom's grid, segments clipped to tiles with a margin, parts, and their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.wire import field, fields, numbers, varint
from .maps import BUFFER, EXTENT, MAX_LATITUDE


def on_zoom(vertices: DataFrame, zoom: int) -> DataFrame:
    """vertices (way_id, seq, x_e7, y_e7) as (way_id, seq, gx, gy): whole steps of the zoom's grid, EXTENT a tile, counted from the north-west."""
    n = float((1 << zoom) * EXTENT)
    lat = F.radians(F.col("y_e7") / 1e7)
    gx = F.floor((F.col("x_e7") / 1e7 + 180.0) / 360.0 * n).cast("long")
    gy = F.floor((1.0 - F.ln(F.tan(lat) + 1.0 / F.cos(lat)) / F.pi()) / 2.0 * n).cast("long")
    return vertices.where(F.abs("y_e7") <= MAX_LATITUDE * 1e7).select("way_id", "seq", gx.alias("gx"), gy.alias("gy"))


def rounded_sql(n: str, d: str) -> str:
    """SQL: n / d to the nearest whole number, halves up."""
    return f"CAST(floor(CAST({n} AS DOUBLE) / ({d}) + 0.5) AS BIGINT)"


def clip_sql(c: str, o: str) -> tuple[str, dict[str, str]]:
    """SQL: whether the segment (ax, ay, bx, by) has a part with -BUFFER <= c <= EXTENT + BUFFER, and the ends of that part. o is the other axis."""
    lo, hi = -BUFFER, EXTENT + BUFFER

    def other(p: str, q: str) -> str:
        low = rounded_sql(f"({lo} - {p}{c}) * ({q}{o} - {p}{o})", f"{q}{c} - {p}{c}")
        high = rounded_sql(f"({p}{c} - {hi}) * ({q}{o} - {p}{o})", f"{p}{c} - {q}{c}")
        return f"CASE WHEN {p}{c} < {lo} THEN {p}{o} + {low} WHEN {p}{c} > {hi} THEN {p}{o} + {high} ELSE {p}{o} END"

    there = f"NOT (a{c} < {lo} AND b{c} < {lo}) AND NOT (a{c} > {hi} AND b{c} > {hi})"
    return there, {f"{p}{c}": f"greatest({lo}, least({hi}, {p}{c}))" for p in "ab"} | {"a" + o: other("a", "b"), "b" + o: other("b", "a")}


def clipped(placed: DataFrame, zoom: int) -> DataFrame:
    """(way_id, seq, x, y, ax, ay, bx, by): the segments of lines (way_id, seq, gx, gy), in every tile that they or its
    margin meet, clipped to tile and margin and counted from the tile's corner; those of no length there go."""
    w = W.partitionBy("way_id").orderBy("seq")
    segs = placed.select("way_id", "seq", "gx", "gy", F.lead("gx").over(w).alias("hx"), F.lead("gy").over(w).alias("hy")).where("hx IS NOT NULL AND (gx <> hx OR gy <> hy)")
    span = lambda g, h: F.explode(F.sequence(F.greatest(F.floor((F.least(g, h) - BUFFER) / F.lit(EXTENT)), F.lit(0)), F.least(F.floor((F.greatest(g, h) + BUFFER) / F.lit(EXTENT)), F.lit((1 << zoom) - 1))))
    spread = segs.withColumn("x", span("gx", "hx")).withColumn("y", span("gy", "hy"))
    own = lambda g, t: (F.col(g) - F.col(t) * EXTENT)
    local = spread.select("way_id", "seq", "x", "y", own("gx", "x").alias("ax"), own("gy", "y").alias("ay"), own("hx", "x").alias("bx"), own("hy", "y").alias("by"))
    for c, o in (("x", "y"), ("y", "x")):
        there, ends = clip_sql(c, o)
        # Through explode, which keeps the two steps apart: as one, their expressions would be written out in each other.
        ends = F.struct(*(F.expr(e).alias(n) for n, e in ends.items()))
        local = local.select("way_id", "seq", "x", "y", F.explode(F.when(F.expr(there), F.array(ends))).alias("s")).select("way_id", "seq", "x", "y", "s.*")
    return local.where("ax <> bx OR ay <> by").select("way_id", "seq", "x", "y", "ax", "ay", "bx", "by")


def parts(segs: DataFrame) -> DataFrame:
    """segs with part: segments of a line that follow each other in a tile without a gap have the same one, from 0."""
    w = W.partitionBy("x", "y", "way_id").orderBy("seq")
    gap = (F.lag("bx").over(w) != F.col("ax")) | (F.lag("by").over(w) != F.col("ay"))
    cut = segs.withColumn("_gap", F.when(gap, 1).otherwise(0))
    return cut.withColumn("part", F.sum("_gap").over(w)).drop("_gap")


# --- bytes ------------------------------------------------------------------------------------------------------------


def _zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def feature(number: int, lines: list[list[tuple[int, int]]]) -> bytes:
    """A line feature: for each part a move and its lines, every position as the step from the one before."""
    commands, x, y = [], 0, 0
    for line in lines:
        for i, (px, py) in enumerate(line):
            if i == 0:
                commands.append(1 << 3 | 1)
            elif i == 1:
                commands.append((len(line) - 1) << 3 | 2)
            commands += [_zigzag(px - x), _zigzag(py - y)]
            x, y = px, py
    geometry = b"".join(map(varint, commands))
    return varint(1 << 3) + varint(number) + varint(3 << 3) + varint(2) + field(4, geometry)


def tile_bytes(layer: str, features: list[bytes]) -> bytes:
    inner = varint(15 << 3) + varint(2) + field(1, layer.encode()) + b"".join(field(2, f) for f in features) + varint(5 << 3) + varint(EXTENT)
    return field(3, inner)


def decoded(data: bytes) -> list[tuple[int, list[list[tuple[int, int]]]]]:
    """(number, parts) of each line feature of a tile."""
    out = []
    for _, inner in (f for f in fields(data) if f[0] == 3):
        for _, body in (f for f in fields(inner) if f[0] == 2):
            said = dict(fields(body))
            commands, i, x, y, lines = numbers(said[4]).tolist(), 0, 0, 0, []
            while i < len(commands):
                kind, count = commands[i] & 7, commands[i] >> 3
                i += 1
                for _ in range(count):
                    dx, dy = ((v >> 1) ^ -(v & 1) for v in commands[i : i + 2])
                    x, y, i = x + dx, y + dy, i + 2
                    if kind == 1:
                        lines.append([])
                    lines[-1].append((x, y))
            out.append((said[1], lines))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [feature(w, [[(p["x"], p["y"]) for p in line] for line in lines]) for w, lines in zip(b.column("way_id").to_pylist(), b.column("lines").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), b.column("way_id"), pa.array(rows, pa.binary())], ["x", "y", "way_id", "feature"])


def line_tiles(vertices: DataFrame, zoom: int, layer: str = "lines") -> DataFrame:
    """(x, y, n_features, tile): the tiles of a zoom that lines (way_id, seq, x_e7, y_e7) meet, as bytes; features in order of way_id, which must not be negative.

    Features are encoded where they are gathered, tile by line; a tile is one value and holds all of its features.
    """
    p = parts(clipped(on_zoom(vertices, zoom), zoom))
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    own = F.array_sort(F.collect_list(F.struct("seq", point("ax", "ay").alias("a"), point("bx", "by").alias("b"))))
    lines = p.groupBy("x", "y", "way_id", "part").agg(own.alias("s")).select("x", "y", "way_id", "part", F.concat(F.array(F.get("s", F.lit(0))["a"]), F.transform("s", lambda s: s["b"])).alias("line"))
    whole = lines.groupBy("x", "y", "way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda s: s["line"]).alias("lines"))
    coded = whole.mapInArrow(_features, "x long, y long, way_id long, feature binary")
    gathered = coded.groupBy("x", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("way_id", "feature"))), lambda s: s["feature"]).alias("f"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [tile_bytes(layer, f) for f in b.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), b.column("n"), pa.array(out, pa.binary())], ["x", "y", "n_features", "tile"])

    return gathered.select("x", "y", F.size("f").cast("long").alias("n"), "f").mapInArrow(tiles, "x long, y long, n_features long, tile binary")


def tile_points(tiles: DataFrame) -> DataFrame:
    """(x, y, way_id, part, no, px, py): every position in tiles (x, y, tile), read from their bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, tile in zip(*(b.column(c).to_pylist() for c in ("x", "y", "tile")), strict=True):
                rows = [(x, y, w, i, k, px, py) for w, lines in decoded(tile) for i, line in enumerate(lines) for k, (px, py) in enumerate(line)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["x", "y", "way_id", "part", "no", "px", "py"])

    return tiles.select("x", "y", "tile").mapInArrow(read, "x long, y long, way_id long, part long, no long, px long, py long")
