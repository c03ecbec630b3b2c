"""Snap rounding against fractions, and tiles against no tiles."""

from collections import Counter
from fractions import Fraction as Q
from itertools import combinations

import numpy as np
import pytest

from wayloom.operators import noding, tiles

SEGS = "way_id long, seq_a long, ax long, ay long, bx long, by long"


def hits(a, b, c, g):
    """Whether the segment a-b meets the half-open pixel of side g around c."""
    h, lo, hi, lo_open, hi_open = Q(g, 2), Q(0), Q(1), False, False
    for k in range(2):
        p, d = a[k] - c[k], b[k] - a[k]
        if d == 0:
            if not -h <= p < h:
                return False
            continue
        l, u = sorted([(-h - p) / d, (h - p) / d])
        if l > lo or (l == lo and d < 0):
            lo, lo_open = l, d < 0
        if u < hi or (u == hi and d > 0):
            hi, hi_open = u, d > 0
    return lo < hi or (lo == hi and not lo_open and not hi_open)


def pieces(segs, g):
    at = lambda v: (v + g // 2) // g * g
    segs = [(w, s, (at(ax), at(ay)), (at(bx), at(by))) for w, s, ax, ay, bx, by in segs]
    segs = [s for s in segs if s[2] != s[3]]
    hot = {p for s in segs for p in s[2:]}
    for (_, _, a, b), (_, _, c, d) in combinations(segs, 2):
        r, s, w = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1]), (c[0] - a[0], c[1] - a[1])
        den = r[0] * s[1] - r[1] * s[0]
        if den:
            t, u = Q(w[0] * s[1] - w[1] * s[0], den), Q(w[0] * r[1] - w[1] * r[0], den)
            if 0 <= t <= 1 and 0 <= u <= 1:
                hot.add(tuple(((a[k] + t * r[k]) / g + Q(1, 2)).__floor__() * g for k in range(2)))
    out = []
    for w, s, a, b in segs:
        line = sorted((p for p in hot if hits(a, b, p, g)), key=lambda p: ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]), p))
        out += [(w, s, i, *p, *q) for i, (p, q) in enumerate(zip(line, line[1:], strict=False))]
    return out


def some(n, size, seed=3):
    g = np.random.default_rng(seed)
    ends = g.integers(-size, size, (n, 4))
    rows = [(i // 3, i % 3, *map(int, e)) for i, e in enumerate(ends)]
    # stretches that lie on each other, and ends on segments
    return rows + [(100, 0, 0, 0, 40, 40), (101, 0, 10, 10, 60, 60), (102, 0, 60, 60, 20, 20), (103, 0, -50, 5, 50, 5), (104, 0, 0, 5, 0, 60), (105, 0, 5, 5, 5, 5), (106, 0, -50, 5, 50, 5)]


def collected(df):
    return Counter(tuple(r) for r in df.select("way_id", "seq_a", "piece", "ax", "ay", "bx", "by").collect())


def test_against_fractions(spark):
    for g, size in ((1, 60), (4, 60), (10, 300)):
        rows = some(30, size)
        assert collected(noding.noded(spark.createDataFrame(rows, SEGS), g, 50, again=False)) == Counter(pieces(rows, g))


def test_pieces_meet_at_ends_only_and_tiles_change_nothing(spark):
    segs = spark.createDataFrame(some(45, 90), SEGS)
    assert noding.faults(noding.on_grid(segs, 2)).first().n_crossing > 10
    whole = noding.noded(segs, 2, 1000)
    assert tuple(noding.faults(whole, 50).first())[1:] == (0, 0)
    tree = tiles.tree(segs, 64, 3, 2)
    assert tree.cut.count() > 0 and tree.sizes == [64, 16, 4]
    assert collected(noding.noded(segs, 2, tree)) == collected(whole) == collected(noding.noded(segs, 2, 16))
    assert tuple(noding.faults(whole, tree).first()) == tuple(noding.faults(whole, 50).first())
    again = noding.noded(whole.selectExpr("way_id * 10 + seq_a AS way_id", "piece AS seq_a", "ax", "ay", "bx", "by"), 2, 50)
    assert again.where("piece > 0").count() == 0


def test_shared_stretches_are_one_piece(spark):
    segs = spark.createDataFrame([(1, 0, 0, 0, 100, 0), (2, 0, 30, 0, 160, 0), (3, 0, 100, 0, 30, 0)], SEGS)
    got = {tuple(r) for r in noding.unique_pieces(noding.noded(segs, 10)).collect()}
    assert got == {(0, 0, 30, 0, 1, 0, 1), (30, 0, 100, 0, 1, 0, 3), (100, 0, 160, 0, 2, 0, 1)}


def test_no_segments(spark):
    assert noding.noded(spark.createDataFrame([], SEGS), 10).collect() == []
    assert noding.noded(spark.createDataFrame([(1, 0, 3, 3, 4, 4)], SEGS), 10, tiles.tree(spark.createDataFrame([], SEGS), 64, 2, 2)).collect() == []


def test_a_run_that_stops_goes_on(spark, tmp_path, monkeypatch):
    segs = spark.createDataFrame(some(40, 90), SEGS)
    whole = collected(noding.noded(segs, 2, 16, again=False))
    run = lambda steps=None, s=segs: noding.noded_by_shards(s, str(tmp_path), 2, 16, 6, 2, steps)
    assert run(1) is None
    done = noding.ShardRun(spark, f"{tmp_path}/crossings", "").path
    assert len(list((tmp_path / "crossings" / "done").glob("[!.]*"))) == 1, done
    # a step that fails after its rows are written and before it is named
    with monkeypatch.context() as m:
        m.setattr(noding.ShardRun, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run()
    assert run(2) is None and collected(run()) == whole == collected(run())
    assert len(list((tmp_path / "crossings" / "done").glob("[!.]*"))) == 3 < len(list((tmp_path / "crossings" / "parts").iterdir()))
    other = spark.createDataFrame(some(20, 90, 8), SEGS)
    assert collected(run(s=other)) == collected(noding.noded(other, 2, 16, again=False))


def test_joins_of_pairs_keep_short_conditions(spark):
    """What pairs are tested for is computed after the join, not in its condition, whose code would not be compiled."""
    segs = spark.createDataFrame([(1, 1, 0, 0, 5000, 5000), (2, 1, 0, 5000, 5000, 0)], "way_id long, seq_a long, ax long, ay long, bx long, by long")
    hot = noding.hot_pixels(segs, 10)
    for made in (noding.cross_points(segs, 10), noding.cut(segs, hot, 10)):
        joins = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
        assert joins and not any("decimal" in j or "CASE WHEN" in j for j in joins)
    assert sorted(map(tuple, noding.cross_points(segs, 10).collect())) == [(2500, 2500)]


def test_rows_are_dealt_out_in_one_pass_and_narrow_pairs_need_no_decimals(spark):
    segs = spark.createDataFrame(some(45, 90), SEGS).repartition(3)
    tree = tiles.tree(segs, 64, 3, 2)
    assert tree.cut.count() > 0 and len(tree.sizes) == 3
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tiles.deal(segs, tree)).count("Repartition") == 1
    pairs = plan(noding.cross_points(segs, 2, tree)).split("Union")[1].split("Join")
    assert len(pairs) > 2 and "decimal" not in pairs[0]  # what is computed of narrow pairs, above their join
    x = 2**21
    wide = [(1, 0, -x, -x, x, x), (2, 0, -x, x, x, -x), (3, 0, 0, 6, 40, 6), (4, 0, 20, 0, 20, 40), (5, 0, -x, 8, x, 12)]
    got = [tuple(r) for r in noding.cross_points(spark.createDataFrame(wide, SEGS), 2, 1 << 22).collect()]
    assert len(got) == len(set(got)) and set(got) == meeting_points(wide, 2)


def meeting_points(segs, g):
    out = set()
    for (_, _, *p), (_, _, *q) in combinations(segs, 2):
        r, s, w = (p[2] - p[0], p[3] - p[1]), (q[2] - q[0], q[3] - q[1]), (q[0] - p[0], q[1] - p[1])
        den = r[0] * s[1] - r[1] * s[0]
        if den:
            t, u = Q(w[0] * s[1] - w[1] * s[0], den), Q(w[0] * r[1] - w[1] * r[0], den)
            if 0 <= t <= 1 and 0 <= u <= 1:
                out.add(tuple(((p[k] + t * r[k]) / g + Q(1, 2)).__floor__() * g for k in range(2)))
    return out
