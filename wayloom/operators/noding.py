"""Snap rounding: segments cut and moved so that they meet at their ends only, on a grid, in whole numbers throughout.

The hot pixels are the grid squares that hold an end of a segment or a point where two segments cross. Each segment
becomes the line through the centres of all hot pixels that it passes through. Segments that share a stretch pass
through each other's ends, so they share the pieces of the stretch; so do those that only touch. Pieces found in many
tiles count in one of them, so any tiles give the same pieces.

Conditions are over whole numbers, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.staging import staged
from . import tiles as T
from .gridjoin import once
from .resume import ShardRun

#: Tiles where none are given.
CELL = 4000
#: Boxes and grids below this are computed in 64 bits: 2 * t * r + den * grid stays below 2^63 where den, t < 2^41.
NARROW = 1 << 20
SEG = ["way_id", "seq_a", "ax", "ay", "bx", "by"]


def hit_sql(g: int, made: bool = False) -> str:
    """SQL: whether a segment passes through a pixel, the half-open square from -g to g around zero.

    u, v lead from the pixel's centre to the segment's first end, twice; du, dv are twice the segment. On each axis the
    segment is inside between two shares of its length, with |du| and |dv| as denominators; one end of each range is
    open. Both ranges and the whole segment have a share in common if each two of them do. With made the shares and
    denominators are columns (hit_columns).
    """
    m = {"u": "(CASE WHEN du < 0 THEN -u ELSE u END)", "v": "(CASE WHEN dv < 0 THEN -v ELSE v END)"}
    low, high, full = {c: f"(-{g} - {m[c]})" for c in m}, {c: f"({g} - {m[c]})" for c in m}, {c: f"abs(d{c})" for c in m}
    if made:
        low, high, full = ({c: f"{k}_{c}" for c in m} for k in ("low", "high", "full"))
    axis = lambda c: f"(CASE WHEN d{c} = 0 THEN {c} >= -{g} AND {c} < {g} ELSE ({low[c]} < {full[c]} OR ({low[c]} = {full[c]} AND d{c} > 0)) AND ({high[c]} > 0 OR ({high[c]} = 0 AND d{c} < 0)) END)"
    both = lambda c, e: f"({low[c]} * {full[e]} < {high[e]} * {full[c]} OR ({low[c]} * {full[e]} = {high[e]} * {full[c]} AND d{c} > 0 AND d{e} < 0))"
    return f"{axis('u')} AND {axis('v')} AND (du = 0 OR dv = 0 OR ({both('u', 'v')} AND {both('v', 'u')}))"


def hit_columns(g: int) -> dict[str, Column]:
    """What hit_sql(g, True) reads, from ax, ay, bx, by and the pixel's x, y."""
    out = {}
    for c, d in (("u", "x"), ("v", "y")):
        u, du = f"(2 * (a{d} - {d}))", f"(2 * (b{d} - a{d}))"
        m = f"CASE WHEN b{d} < a{d} THEN -{u} ELSE {u} END"
        out |= {c: F.expr(u), f"d{c}": F.expr(du), f"low_{c}": F.expr(f"-{g} - {m}"), f"high_{c}": F.expr(f"{g} - {m}"), f"full_{c}": F.expr(f"abs({du})")}
    return out


def on_grid(segs: DataFrame, grid: int) -> DataFrame:
    """Segments with ends on the nearest multiples of grid (halves up), without those of no length."""
    at = lambda c: (F.floor((F.col(c) + grid // 2) / F.lit(grid)).cast("long") * grid).alias(c)
    return segs.select("way_id", "seq_a", *(at(c) for c in SEG[2:])).where("ax <> bx OR ay <> by")


def _whole(segs: DataFrame, grid: int) -> DataFrame:
    """on_grid, written out where segs are not."""
    whole = on_grid(segs, grid)
    return whole if hasattr(segs, "staged_at") else staged(whole, "on_grid")


def cross_points(segs: DataFrame, grid: int, tiles: T.Tree | int = CELL) -> DataFrame:
    """(x, y): the grid points nearest to where two segments that are not parallel meet, exactly rounded."""
    return _crossings(T.deal(segs, tiles), grid).distinct()


def _crossings(s: DataFrame, grid: int) -> DataFrame:
    """cross_points of segments dealt out to tiles (size, tx, ty); each tile's own, which can be the same in several.

    Pairs of narrow segments are met in 64 bits, those with a wide one in decimals, which cost several times as much.
    """
    box = {f"{e}{c}": f(f"a{c}", f"b{c}") for c in "xy" for e, f in (("l", F.least), ("h", F.greatest))}
    side = lambda k: s.select("size", "tx", "ty", *(F.col(c).alias(f"{k}_{c}") for c in SEG), *(e.alias(f"{k}_{n}") for n, e in box.items()))
    met = lambda p: p.join(side("q"), ["size", "tx", "ty"]).where("p_lx <= q_hx AND q_lx <= p_hx AND p_ly <= q_hy AND q_ly <= p_hy").where(T.inside(F.greatest("p_lx", "q_lx"), F.greatest("p_ly", "q_ly")))
    most, wide = NARROW if grid < NARROW else 0, lambda k: f"greatest({k}_hx - {k}_lx, {k}_hy - {k}_ly)"
    before = "(p_way_id < q_way_id OR (p_way_id = q_way_id AND p_seq_a < q_seq_a))"
    small = met(side("p")).where(f"{before} AND greatest({wide('p')}, {wide('q')}) < {most}")
    large = met(side("p").where(f"{wide('p')} >= {most}")).where(f"{before} OR ((p_way_id <> q_way_id OR p_seq_a <> q_seq_a) AND {wide('q')} < {most})")
    return _meet(small, grid, "bigint").union(_meet(large, grid, "decimal(38,0)"))


def _meet(met: DataFrame, grid: int, kind: str) -> DataFrame:
    """(x, y): the grid points nearest to where pairs p, q of segments meet, in whole numbers of a kind that holds 2 * t * r + den * grid."""
    step = lambda a, b: f"CAST({a} - {b} AS {kind})"
    rx, ry, sx, sy, wx, wy = (step(f"{k}{c}", f"{o}{c}") for k, o in (("p_b", "p_a"), ("q_b", "q_a"), ("q_a", "p_a")) for c in "xy")
    d = once(met, ["p_ax", "p_ay", "p_bx", "p_by"], den=F.expr(f"{rx} * {sy} - {ry} * {sx}"), t=F.expr(f"{wx} * {sy} - {wy} * {sx}"), w=F.expr(f"{wx} * {ry} - {wy} * {rx}")).where("den <> 0")
    d = d.select("p_ax", "p_ay", F.expr(rx).alias("rx"), F.expr(ry).alias("ry"), "t", "w", "den")
    for c in ("t", "w", "den"):
        d = d.withColumn(f"_{c}", F.when(F.col("den") < 0, -F.col(c)).otherwise(F.col(c)).cast(kind))
    hit = d.where("_t BETWEEN 0 AND _den AND _w BETWEEN 0 AND _den")
    n, den = (lambda r: f"CAST(2 * _t * {r} + _den * {grid} AS {kind})"), f"CAST({2 * grid} * _den AS {kind})"
    at = lambda c: F.expr(f"p_a{c} + {grid} * (({n(f'r{c}')} - pmod({n(f'r{c}')}, {den})) div {den})").alias(c)
    return hit.select(at("x"), at("y"))


def hot_pixels(segs: DataFrame, grid: int, tiles: T.Tree | int = CELL) -> DataFrame:
    """(x, y): the centres of the hot pixels of segments on the grid."""
    ends = segs.select(F.col("ax").alias("x"), F.col("ay").alias("y")).union(segs.select("bx", "by"))
    return ends.union(_crossings(T.deal(segs, tiles), grid)).distinct()


def cut(segs: DataFrame, hot: DataFrame, grid: int, tiles: T.Tree | int = CELL) -> DataFrame:
    """Segments (way_id, seq_a, piece, ax, ay, bx, by) as their pieces between the hot pixels that they pass through, in order."""
    return _pieces(_hits(T.deal(segs, tiles, grid), _placed(hot, tiles), grid))


def _placed(hot: DataFrame, tiles: T.Tree | int) -> DataFrame:
    at = hot.select("x", "y", *(F.col(c).alias(n) for n, c in (("ax", "x"), ("ay", "y"), ("bx", "x"), ("by", "y"))))
    return T.deal(at, tiles).select("size", "tx", "ty", "x", "y")


def _hits(dealt: DataFrame, points: DataFrame, grid: int) -> DataFrame:
    """Each hot pixel that a segment, dealt out to tiles, passes through, with its place along the segment; each pixel is in one tile."""
    key = [c for c in dealt.columns if c not in (*SEG[2:], "size", "tx", "ty", "shard")]
    box = {f"_{e}{c}": f"{f}(a{c}, b{c}) {sign} {grid}" for c in "xy" for e, f, sign in (("l", "least", "-"), ("h", "greatest", "+"))}
    met = dealt.select("size", "tx", "ty", *key, *SEG[2:], *(F.expr(e).alias(n) for n, e in box.items())).join(points, ["size", "tx", "ty"]).where("x BETWEEN _lx AND _hx AND y BETWEEN _ly AND _hy")
    placed = once(met, [*key, "x", "y"], **hit_columns(grid), along=F.expr("(x - ax) * (bx - ax) + (y - ay) * (by - ay)"))
    return placed.where(hit_sql(grid, True)).select(*key, "x", "y", "along")


def _pieces(on: DataFrame) -> DataFrame:
    key = [c for c in on.columns if c not in ("x", "y", "along")]
    w = W.partitionBy(*key).orderBy("along", "x", "y")
    return on.select(*key, (F.row_number().over(w) - 1).cast("long").alias("_no"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx IS NOT NULL")


def noded(segs: DataFrame, grid: int = 10, tiles: T.Tree | int = CELL, again: bool = True) -> DataFrame:
    """(way_id, seq_a, piece, ax, ay, bx, by): the pieces of segs (way_id, seq_a, ax, ay, bx, by); each keeps its source's ids.

    With again the pieces are cut anew until none passes through a hot pixel but its own ends; each round adds points
    from a fixed set, so it ends. Null ends and segments of no length on the grid have no piece; what stands twice in
    segs under the same ids should not.
    """
    whole = _whole(segs, grid)
    hot = staged(hot_pixels(whole, grid, tiles), "hot_pixels")
    pieces = staged(cut(whole, hot, grid, tiles).withColumnRenamed("_no", "piece"), "pieces")
    while again:
        finer = staged(cut(pieces, hot, grid, tiles), "pieces")
        again = not finer.where("_no > 0").isEmpty()
        w = W.partitionBy("way_id", "seq_a").orderBy("piece", "_no")
        pieces = finer.select("way_id", "seq_a", (F.row_number().over(w) - 1).cast("long").alias("piece"), *SEG[2:]) if again else pieces
    return pieces.select("way_id", "seq_a", "piece", *SEG[2:])


def noded_by_shards(segs: DataFrame, path: str, grid: int = 10, tiles: T.Tree | int = CELL, shards: int = 16, together: int = 4, steps: int | None = None) -> DataFrame | None:
    """noded(.., again=False) as two runs by shards of tiles, for crossings and for the pixels on each segment, that go on
    where they stopped: a call over the same segs finds in path what earlier ones finished. None where it stopped after `steps` steps of a run."""
    whole = _whole(segs, grid)
    told = whole.agg(F.count("*"), F.bit_xor(F.xxhash64(*SEG))).first()  # the work's sign: the same segments, grid and tiles
    shape = tiles if isinstance(tiles, int) else tuple(tiles.cut.agg(F.count("*"), F.bit_xor(F.xxhash64("size", "tx", "ty"))).first())
    sign = f"{told[0]} {told[1]} {grid} {shape} {shards}"
    shard = F.pmod(F.xxhash64("size", "tx", "ty"), F.lit(shards)).cast("int")
    run = lambda name: ShardRun(segs.sparkSession, f"{path}/{name}", sign)
    found = run("crossings").run(T.deal(whole, tiles).withColumn("shard", shard), shards, lambda s: _crossings(s, grid), together, steps)
    if found is None:
        return None
    ends = whole.select(F.col("ax").alias("x"), F.col("ay").alias("y")).union(whole.select("bx", "by"))
    placed = _placed(ends.union(found).distinct(), tiles).withColumn("shard", F.lit(0))
    points = run("hot_pixels").run(placed, 1, lambda s: s.drop("shard"), 1)  # one step that runs to its end, kept for calls to come
    on = run("hits").run(T.deal(whole, tiles, grid).withColumn("shard", shard), shards, lambda s: _hits(s, points, grid), together, steps)
    return None if on is None else _pieces(on).select("way_id", "seq_a", F.col("_no").alias("piece"), *SEG[2:])


def unique_pieces(pieces: DataFrame) -> DataFrame:
    """(ax, ay, bx, by, way_id, seq_a, n_sources): each piece of line once, its lower end first, with the smallest of the segments that lie on it."""
    turn = F.struct("ax", "ay") <= F.struct("bx", "by")
    p = pieces.select("way_id", "seq_a", *(F.when(turn, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))))
    of = p.groupBy("ax", "ay", "bx", "by").agg(F.min(F.struct("way_id", "seq_a")).alias("s"), F.count("*").alias("n_sources"))
    return of.select("ax", "ay", "bx", "by", "s.way_id", "s.seq_a", "n_sources")


def faults(pieces: DataFrame, tiles: T.Tree | int = CELL) -> DataFrame:
    """(n_pieces, n_crossing, n_touching): pairs of different pieces that cross between their ends, and ends that lie inside a piece. Noded pieces have none."""
    p = staged(unique_pieces(pieces).select("ax", "ay", "bx", "by"), "unique")
    s = T.deal(p, tiles)
    side = lambda k: s.select("size", "tx", "ty", *(F.col(c).alias(f"{k}{c}") for c in SEG[2:]))
    met = side("p").join(side("q"), ["size", "tx", "ty"]).where("struct(pax, pay, pbx, pby) < struct(qax, qay, qbx, qby)")
    low = lambda c: F.greatest(F.least(f"pa{c}", f"pb{c}"), F.least(f"qa{c}", f"qb{c}"))
    high = lambda c: F.least(F.greatest(f"pa{c}", f"pb{c}"), F.greatest(f"qa{c}", f"qb{c}"))
    met = met.where((low("x") <= high("x")) & (low("y") <= high("y")) & T.inside(low("x"), low("y")))
    side_of = lambda o, e, x: F.expr(f"sign(CAST(({e}x - {o}x) * ({x}y - {o}y) AS DECIMAL(38,0)) - CAST(({e}y - {o}y) * ({x}x - {o}x) AS DECIMAL(38,0)))")
    ends = [f"{k}{c}" for k in ("pa", "pb", "qa", "qb") for c in "xy"]
    met = once(met, ends, s1=side_of("pa", "pb", "qa"), s2=side_of("pa", "pb", "qb"), s3=side_of("qa", "qb", "pa"), s4=side_of("qa", "qb", "pb"))
    within = lambda x, a, b: f"{x}x BETWEEN least({a}x, {b}x) AND greatest({a}x, {b}x) AND {x}y BETWEEN least({a}y, {b}y) AND greatest({a}y, {b}y) AND NOT ({x}x = {a}x AND {x}y = {a}y) AND NOT ({x}x = {b}x AND {x}y = {b}y)"
    touch = " + ".join(f"CASE WHEN {s} = 0 AND {within(x, a, b)} THEN 1 ELSE 0 END" for s, x, a, b in (("s1", "qa", "pa", "pb"), ("s2", "qb", "pa", "pb"), ("s3", "pa", "qa", "qb"), ("s4", "pb", "qa", "qb")))
    counted = met.agg(F.count_if(F.expr("s1 * s2 < 0 AND s3 * s4 < 0")).alias("n_crossing"), F.coalesce(F.sum(F.expr(touch)), F.lit(0)).cast("long").alias("n_touching"))
    return p.agg(F.count("*").alias("n_pieces")).crossJoin(counted)  # one row each
