"""The word index against every word; outlines against the squares they enclose; circles against what they start from."""

import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from wayloom.operators import outlines, rings, search
from wayloom.operators.search_index import SearchIndex, filtered, shortened


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=400, deadline=None)
def test_near_words_share_a_shortened_text(a, b):
    for d in range(3):
        if distance(a, b) <= d:
            assert shortened(a, d) & shortened(b, d)


def test_index_finds_what_the_scan_finds(spark):
    g = np.random.default_rng(4)
    some = ["".join(g.choice(list("abcd"), g.integers(1, 14))) for _ in range(250)] + ["été", "o'neill", "x" * 60, "x" * 59 + "y"]
    rows = [(i, " ".join(g.choice(some, 4)), str(g.choice(some)) if i % 5 else None) for i in range(200)] + [(500, None, None), (501, "", "--")]
    df = spark.createDataFrame(rows, "id long, name string, kind string")
    index = SearchIndex.build(df, "id", ["name", "kind"])
    for query in (f"{some[0]} {some[1]}", "abcd", "ab " + some[7][:-1], "x" * 61, "été o", "", "zzzzzz"):
        want = search.fuzzy_search(df, "id", {"name": 2.0, "kind": 1.0}, query).collect()
        assert index.search(query, {"name": 2.0, "kind": 1.0}).collect() == want
    only = df.where("id % 2 = 0")
    assert index.search("abcd", {"name": 1.0}, 500, only).collect() == search.fuzzy_search(only, "id", {"name": 1.0}, "abcd", 500).collect()


def test_filters(spark):
    df = spark.createDataFrame([(1, "Clinic", 0, 0), (2, " CLINIC ", 10**7, 0), (3, "other", 0, 0), (4, None, 0, 0)], "id long, type string, lon_e7 long, lat_e7 long")
    assert [r.id for r in filtered(df, {"type": "clinic"}).collect()] == [1, 2]
    assert [r.id for r in filtered(df, {"type": "clinic"}, 0.0, 0.0, 50.0).collect()] == [1]


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                n += 1
    return n % 2 == 1


def test_outlines_enclose_the_squares_and_nothing_else(spark):
    g = np.random.default_rng(9)
    cells = {(1, c, int(x), int(y)) for c in (1, 2) for x, y in g.integers(0, 9, (40, 2))} | {(2, 1, x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)}
    df = spark.createDataFrame(sorted(cells), "source long, contour long, cx long, cy long")
    got = outlines.outlines(df, 10)
    rings = defaultdict(lambda: defaultdict(list))
    for r in got.orderBy("source", "contour", "ring", "corner").collect():
        rings[r.source, r.contour][r.ring].append((r.x, r.y))
    for key in {c[:2] for c in cells}:
        own = list(rings[key].values())
        assert all(ring[0] == ring[-1] for ring in own)
        for x in range(-1, 10):
            for y in range(-1, 10):
                assert inside(own, 10 * x + 5, 10 * y + 5) == ((*key, x, y) in cells)
    assert {(r.source, r.contour): r.area for r in outlines.areas(got).collect()} == {k: 100 * sum(c[:2] == k for c in cells) for k in {c[:2] for c in cells}}
    assert sorted(map(len, rings[2, 1].values())) == [5, 5]


def test_outlines_hold_reached_nodes_nest_and_lose_islands(spark):
    nodes = spark.createDataFrame([(1, 0, 0), (2, 100, 0), (3, 100, 70), (4, 900, 900)], "node long, x_e7 long, y_e7 long")
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 9)], "src long, dst long, seconds long")
    reached = spark.createDataFrame([(7, 1, 0, 1), (7, 2, 1, 1), (7, 3, 10, 2), (7, 4, 11, 2)], "source long, node long, seconds long, contour long")
    cells = outlines.squares(reached, edges, nodes, 10, 3)
    by = defaultdict(set)
    for r in cells.collect():
        by[r.contour].add((r.cx, r.cy))
    assert by[1] == {(x, 0) for x in range(11)} and by[1] < by[2] == by[3] and {(10, 7), (90, 90)} < by[2]
    assert {(r.cx, r.cy) for r in outlines.without_islands(cells, 0.1).where("contour = 3").collect()} == by[3] - {(90, 90)}


def test_circles_on_the_radius(spark):
    g = np.random.default_rng(2)
    rows = []
    for k in range(12):
        for a in g.uniform(0, 0.6 + k / 2, 15):
            rows.append((k, 100 * k + 20 * math.cos(a) + float(g.normal(0, 0.8)), 20 * math.sin(a) + float(g.normal(0, 0.8))))
    rows += [(50, float(i), 2.0 * i) for i in range(5)] + [(51, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "k long, x double, y double")

    def sse(k, cx, cy, r=None):
        d = [math.dist((x, y), (cx, cy)) for i, x, y in rows if i == k]
        r = sum(d) / len(d) if r is None else r
        return sum((e - r) ** 2 for e in d)

    start = {r.k: sse(r.k, r.cx, r.cy, r.r) for r in rings.algebraic_circles(points, "k").collect()}
    got = {r.k: r for r in rings.fit_circles(points, "k").collect()}
    assert got.keys() == start.keys() == set(range(12))
    for k, r in got.items():
        assert abs(r.sse - sse(k, r.cx, r.cy, r.r)) < 1e-6 and r.sse <= start[k] + 1e-9
        assert all(sse(k, r.cx + dx, r.cy + dy) >= r.sse - 1e-7 for dx in (-0.01, 0, 0.01) for dy in (-0.01, 0, 0.01))
    assert sum(r.sse < start[k] * 0.999 for k, r in got.items()) > 5


def test_rings_are_fitted_without_a_table_a_step(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate((2, 3, 7, 60, 2600)):
        angle = rng.uniform(0, 6.3, n)
        rows += [(k, float(100 + 40 * np.cos(t) + e), float(7 + 40 * np.sin(t) - e)) for t, e in zip(angle, rng.normal(0, 2, n), strict=True)]
    rows += [(9, float(i), 3.0 * i) for i in range(5)] + [(None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "k long, x double, y double")
    sums = {r.k: r for r in rings._fit_large(points.where("k IN (1, 2, 3, 4)"), "k").collect()}
    written = []
    whole = rings.staged
    monkeypatch.setattr(rings, "staged", lambda df, name: written.append(name) or whole(df, name))
    small = {r.k: r for r in rings.fit_circles(points.where("k <> 4 OR k IS NULL"), "k").collect()}
    assert written == ["ring_rows"] and small.keys() == {1, 2, 3}
    both = {r.k: r for r in rings.fit_circles(points, "k").collect()}
    assert both.keys() == sums.keys() == {1, 2, 3, 4}
    for k, r in both.items():
        assert all(abs(r[c] - sums[k][c]) < 1e-6 * max(1, abs(r[c])) for c in ("cx", "cy", "r")) and abs(r.sse - sums[k].sse) < 1e-5


def test_ring_points_are_whole_and_made_as_they_are_read(spark, monkeypatch):
    rows = [(k, 10.0 * k + 5 * math.cos(a), 20 + 5 * math.sin(a)) for k in (1, 2) for a in range(7)]
    written = []
    whole = rings.staged
    monkeypatch.setattr(rings, "staged", lambda df, name: written.append(name) or whole(df, name))
    made = rings.regular_ring(spark.createDataFrame(rows, "k long, x double, y double"), "k")
    assert written == ["ring_rows"] and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    angles = np.append(np.linspace(0, 2 * np.pi, 360), 0)
    for k in (1, 2):
        got = made.where(made.k == k).orderBy("i").collect()
        assert [r.i for r in got] == list(range(361))
        assert np.allclose([(r.x, r.y) for r in got], np.column_stack([10 * k + 5 * np.cos(angles), 20 + 5 * np.sin(angles)]))
