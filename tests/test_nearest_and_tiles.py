"""Nearest neighbours against all pairs; vector tiles against their clipped input."""

import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from wayloom.operators import nearest, vector_tiles as vt
from wayloom.operators.nearest import nearest_join

LEFT, RIGHT = "id long, x_e7 long, y_e7 long", "node long, x_e7 long, y_e7 long"


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_equal_all_pairs(spark, k):
    g = np.random.default_rng(k)
    # a dense spot with many equal positions, a thin plane, and points far outside of all others
    others = [(i, int(x), int(y)) for i, (x, y) in enumerate(np.concatenate([g.integers(0, 3, (40, 2)), g.integers(-5000, 5000, (40, 2))]))] + [(900, None, 1)]
    points = [(i, int(x), int(y)) for i, (x, y) in enumerate(np.concatenate([g.integers(-2, 5, (20, 2)), g.integers(-9000, 9000, (40, 2)), [[10**9, -(10**9)]]]))] + [(901, 1, None)]
    got = defaultdict(list)
    for r in nearest_join(spark.createDataFrame(points, LEFT), spark.createDataFrame(others, RIGHT), k).orderBy("id", "rank").collect():
        got[r.id].append((r.d2, r.node))
    want = {i: sorted(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in others if a is not None)[:k] for i, x, y in points if y is not None}
    assert got == want


def test_few_or_no_neighbours(spark):
    points, none = spark.createDataFrame([(1, 0, 0), (2, 50, 50)], LEFT), spark.createDataFrame([], RIGHT)
    assert nearest_join(points, none, 3).collect() == []
    two = spark.createDataFrame([(7, 0, 1), (8, 0, 1)], RIGHT)
    assert sorted((r.id, r.rank, r.node) for r in nearest_join(points, two, 3).collect()) == [(1, 1, 7), (1, 2, 8), (2, 1, 7), (2, 2, 8)]


@given(st.lists(st.lists(st.tuples(st.integers(-64, 4160), st.integers(-64, 4160)), min_size=2, max_size=9), min_size=1, max_size=4), st.integers(0, 2**40))
@settings(max_examples=100, deadline=None)
def test_bytes_round_trip(lines, number):
    assert vt.decoded(vt.tile_bytes("l", [vt.feature(number, lines), vt.feature(1, lines[:1])])) == [(number, lines), (1, lines[:1])]


def test_clipped_lines(spark):
    e = vt.EXTENT
    # a line through two tiles, one that leaves a tile and comes back, one within a margin, one outside and one of no length
    rows = [(1, 1, 100, 100), (1, 2, e + 3000, 100), (2, 1, 4000, 2000), (2, 2, 5000, 2000), (2, 3, 5000, 2100), (2, 4, 4000, 2100), (3, 1, 10, e - 10), (3, 2, 90, e - 10), (4, 1, 7, 7), (4, 2, 7, 7)]
    segs = vt.clipped(spark.createDataFrame(rows, "way_id long, seq long, gx long, gy long"), 1)
    got = {(r.x, r.y, r.way_id, r.seq): (r.ax, r.ay, r.bx, r.by) for r in segs.collect()}
    b = vt.BUFFER
    assert got == {
        (0, 0, 1, 1): (100, 100, e + b, 100), (1, 0, 1, 1): (-b, 100, 3000, 100),
        (0, 0, 2, 1): (4000, 2000, e + b, 2000), (0, 0, 2, 3): (e + b, 2100, 4000, 2100), (1, 0, 2, 1): (-b, 2000, 5000 - e, 2000), (1, 0, 2, 2): (5000 - e, 2000, 5000 - e, 2100), (1, 0, 2, 3): (5000 - e, 2100, -b, 2100),
        (0, 0, 3, 1): (10, e - 10, 90, e - 10), (0, 1, 3, 1): (10, -10, 90, -10),
    }
    assert {(r.x, r.way_id, r.seq): r.part for r in vt.parts(segs.where("way_id = 2")).collect()} == {(0, 2, 1): 0, (0, 2, 3): 1, (1, 2, 1): 0, (1, 2, 2): 0, (1, 2, 3): 0}


def test_pairs_to_come_are_dealt_out(spark, monkeypatch):
    """Tasks are as many as the pairs they will make ask for, and the neighbours stay the same."""
    points = spark.range(300).selectExpr("id", "id * 7919 % 2000 AS x_e7", "id * 3571 % 2000 AS y_e7")
    others = spark.range(500).selectExpr("id AS node", "id * 6007 % 2000 AS x_e7", "id * 4447 % 2000 AS y_e7")
    want = sorted(map(tuple, nearest.nearest_join(points, others, 3).collect()))
    plans, written = [], nearest.staged
    monkeypatch.setattr(nearest, "TASK_PAIRS", 1000)
    monkeypatch.setattr(nearest, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString() if name == "nearest" else "") or written(df, name))
    assert sorted(map(tuple, nearest.nearest_join(points, others, 3).collect())) == want
    tasks = [int(n) for p in plans for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", p)]
    assert tasks and max(tasks) > 5
