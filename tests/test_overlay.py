"""The overlay of cells against Dijkstra on the whole graph."""

import heapq
from collections import defaultdict

import numpy as np
import pytest

from wayloom.operators import routing
from wayloom.operators.overlay import Overlay, cells_of, square

EDGES, NODES = "src long, dst long, seconds long", "node long, x_e7 long, y_e7 long"


def dijkstra(edges, source):
    out = defaultdict(list)
    for a, b, t in edges:
        if None not in (a, b, t):
            out[a].append((b, t))
    best, heap = {}, [(0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for m, c in out[n]:
                heapq.heappush(heap, (d + c, m))
    return best


def grid(w, h, seed):
    g = np.random.default_rng(seed)
    at = lambda x, y: x * h + y
    edges = []
    for x in range(w):
        for y in range(h):
            for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1)):
                if 0 <= x + dx < w and 0 <= y + dy < h and g.random() < 0.8:
                    edges.append((at(x, y), at(x + dx, y + dy), int(g.integers(0, 9))))
    return edges, [(at(x, y), 1000 * x, 1000 * y) for x in range(w) for y in range(h)]


@pytest.mark.parametrize("most", [6, 60])
def test_times_and_routes_equal_dijkstra(spark, most):
    edges, spots = grid(14, 11, most)
    edges += [(3, 9000, 2), (9000, 120, 1), (None, 4, 1), (4, None, 1), (5, 6, None), (7, 7, 0), (9001, 9002, 4)]
    e, n = spark.createDataFrame(edges, EDGES), spark.createDataFrame([*spots, (9001, None, 3)], NODES)
    overlay = Overlay.build(e, n, most)
    assert len(overlay.levels) > (3 if most == 6 else 1)
    sources, targets = [0, 3, 77, 9000, 9001, 12345], [*range(0, 154, 6), 9000, 9002, 12345]
    frame = lambda x: spark.createDataFrame([(i,) for i in x], "node long")
    got = {(r.source, r.target): r.seconds for r in overlay.times(frame(sources), frame(targets)).collect()}
    best = {s: dijkstra(edges, s) for s in sources if s != 12345}
    assert got == {(s, t): best[s][t] for s in best for t in targets if t in best[s]}
    asked = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in (0, 77, 9000, 9001) for t in targets[::3])]
    steps = defaultdict(list)
    for r in overlay.routes(spark.createDataFrame(asked, "request long, source long, target long")).orderBy("step").collect():
        steps[r.request].append((r.step, r.node, r.seconds))
    least = defaultdict(lambda: 10**9)
    for a, b, t in edges:
        if None not in (a, b, t):
            least[a, b] = min(least[a, b], t)
    for i, s, t in asked:
        if t not in best[s]:
            assert i not in steps
            continue
        assert [x[0] for x in steps[i]] == list(range(len(steps[i])))
        assert steps[i][0][1:] == (s, 0) and steps[i][-1][1:] == (t, best[s][t])
        assert all(q[2] - p[2] == least[p[1], q[1]] for p, q in zip(steps[i], steps[i][1:], strict=False))


def test_without_positions_and_without_edges(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 1)], EDGES)
    one, two = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(4,), (9,)], "node long")
    assert {(r.target, r.seconds) for r in routing.matrix(e, one, two).collect()} == {(4, 11), (9, None)}
    assert routing.matrix(spark.createDataFrame([], EDGES), one, two).where("seconds IS NOT NULL").collect() == []
    with pytest.raises(ValueError):
        Overlay.build(spark.createDataFrame([(1, 2, -1)], EDGES))


def test_cells_are_small_and_nested(spark):
    g = np.random.default_rng(0)
    at = np.concatenate([g.integers(0, 10**6, (300, 2)), g.integers(500, 520, (300, 2))])
    points = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(at)], "node long, x long, y long")
    whole = {r.node: r.cell for r in cells_of(points, 20, square(points)).collect()}
    assert len(whole) == 600
    sizes = defaultdict(int)
    for c in whole.values():
        sizes[c] += 1
    assert max(sizes.values()) <= 20
    some = {r.node: r.cell for r in cells_of(points.where("node % 5 = 0"), 20, square(points)).collect()}
    met = defaultdict(set)
    for n, c in some.items():
        met[whole[n]].add(c)
    assert all(len(c) == 1 for c in met.values())
