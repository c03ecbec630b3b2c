"""Hand-made cases for the graph and geometry operators."""

import heapq
import math

import pytest
from hypothesis import given, settings, strategies as st

from wayloom.functions import geo
from wayloom.operators import areas, routing, search, streets, topology as topo
from wayloom.operators.components import connected_components
from wayloom.operators.rings import fit_circles
from wayloom.plans import registry
from wayloom.sources import osm

VERTICES = "way_id long, seq long, x_e7 long, y_e7 long"


def test_components_join_pairs_that_meet_in_either_direction(spark):
    e = spark.createDataFrame([(1, 3), (2, 3), (7, 7), (8, None), (5, 4)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 7)] == [1, 1, 1, 4, 4, 7] and {got[i] for i in range(100, 141)} == {100} and 8 not in got


def test_crossing_lines_share_a_node(spark):
    v = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 1000, 1000), (2, 1, 0, 1000), (2, 2, 1000, 0)], VERTICES)
    pieces = areas.node_segments(topo.segments(v)).collect()
    assert len(pieces) == 4 and sum((p.bx, p.by) == (500, 500) for p in pieces) == 2


def test_end_near_a_segment_becomes_its_vertex(spark):
    v = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 10000, 0), (2, 1, 3000, 300), (2, 2, 3000, 9000), (3, 1, 7000, 300), (3, 2, 7000, 9000)], VERTICES)
    nodes = topo.extract_nodes(v)
    feet = topo.best_projection(topo.project(topo.dangling(topo.way_nodes(v, nodes)).join(nodes, "node_id"), topo.segments(v)))
    got = topo.inject(v, feet).where("way_id = 1").orderBy("seq").collect()
    assert [(r.seq, r.x_e7) for r in got] == [(1, 0), (2, 3000), (3, 7000), (4, 10000)]


def test_cleaning_and_dangling_ends(spark):
    w = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 3), (2, 1, 5), (2, 2, 5), (3, 1, 1), (3, 2, 7), (3, 3, 8), (3, 4, 1), (4, 1, 9), (4, 2, 1)], "way_id long, seq long, node_id long")
    clean = topo.clean_way_nodes(w)
    assert {(r.way_id, r.seq) for r in clean.collect()} == {(1, 1), (1, 2), (1, 4), (3, 1), (3, 2), (3, 3), (3, 4), (4, 1), (4, 2)}
    assert {r.node_id for r in topo.dangling(clean).collect()} == {3, 9}
    assert {r.way_id for r in topo.clean_way_nodes(w, drop_closed=True).collect()} == {1, 4}


def test_snapping_again_changes_nothing(spark):
    v = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 5000, 0), (2, 1, 5100, 50), (2, 2, 9000, 0), (3, 1, 9400, 100), (3, 2, 9400, 8000)], VERTICES)
    nodes = topo.extract_nodes(v)
    once = topo.snap_node_to_node(topo.way_nodes(v, nodes), nodes)
    twice = topo.snap_node_to_node(once, nodes)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()}
    assert once.select("node_id").distinct().count() == 4


@given(st.lists(st.tuples(st.integers(-180 * 10**6, 180 * 10**6), st.integers(-90 * 10**6, 90 * 10**6)), max_size=20))
@settings(max_examples=60, deadline=None)
def test_polylines_round_trip(points):
    p = [(x / 1e6, y / 1e6) for x, y in points]
    got = geo.decode_polyline(geo.encode_polyline(p))
    assert all(abs(a - b) < 1e-9 for u, v in zip(p, got, strict=True) for a, b in zip(u, v, strict=True))


def test_routes_and_orders(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 1)], "src long, dst long, seconds long")
    s = spark.createDataFrame([(1,)], "node long")
    t = spark.createDataFrame([(4,), (9,)], "node long")
    assert {(r.target, r.seconds) for r in routing.matrix(e, s, t).collect()} == {(4, 11), (9, None)}
    asked = spark.createDataFrame([(1, 1, 4)], "request long, source long, target long")
    assert [r.node for r in routing.routes(e, asked).orderBy("step").collect()] == [1, 2, 3, 4]
    square = {1: (0, 0), 2: (1, 1), 3: (0, 1), 4: (1, 0)}
    costs = [(1, a, b, math.dist(p, q)) for a, p in square.items() for b, q in square.items() if a != b]
    got = routing.stop_orders(spark.createDataFrame(costs, "request long, a long, b long, cost double")).collect()
    assert got[0].cost == pytest.approx(4.0)


def test_queries_read_whole_tables(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 150, 1), (150, 201, 1), (201, 100, 1), (1, 100, 9), (121, 190, 2), (100, 300, 1)], "src long, dst long, seconds long")
    points = spark.createDataFrame([(w, round(10**7 * math.cos(a)), round(10**7 * math.sin(a))) for w in (1, 41) for a in range(4)], "way_id long, x_e7 long, y_e7 long")
    spots = spark.createDataFrame([(i, i, -i) for i in (1, 100, 150)], "node long, x_e7 long, y_e7 long")
    places = spark.createDataFrame([(i, 100 * i, i * i) for i in range(1, 17)], "id long, lon_e7 long, lat_e7 long")
    monkeypatch.setattr(registry, "view", lambda s, d, name: {"road_edges": edges, "road_nodes": spots, "way_vertices": points, "places": places}[name])
    assert [r.node for r in registry.QUERIES["route_paths"](spark, "").where("request = 1").orderBy("step").collect()] == [1, 150, 201, 100]
    assert {r.way_id for r in registry.QUERIES["ring_fit"](spark, "").select("way_id").distinct().collect()} == {1, 41}
    assert sorted(r.stop for r in registry.QUERIES["stop_order"](spark, "").collect()) == list(range(1, 17))


def test_whole_travel_matrix_has_every_time(spark):
    sf = "/root/testdata/sf0.001"
    out = {}
    for r in registry.view(spark, sf, "road_edges").collect():
        out.setdefault(r.src, []).append((r.dst, r.seconds))
    want = {}
    for source in (1, 121):
        best, heap = {}, [(0, source)]
        while heap:
            d, n = heapq.heappop(heap)
            if n not in best:
                best[n] = d
                for m, c in out.get(n, []):
                    heapq.heappush(heap, (d + c, m))
        want |= {(source, t): best.get(t) for t in range(1, 200, 9)}
    assert {(r.source, r.target): r.seconds for r in registry.QUERIES["travel_matrix"](spark, sf).collect()} == want
    assert max(filter(None, want.values())) > 30


def test_ring_is_a_circle(spark):
    pts = [(1, 10 + 5 * math.cos(a / 7), 20 + 5 * math.sin(a / 7)) for a in range(30)]
    r = fit_circles(spark.createDataFrame(pts, "k long, x double, y double"), "k").first()
    assert (r.cx, r.cy, r.r) == pytest.approx((10, 20, 5))


def test_street_rules(spark):
    rows = [(1, "a", 1, 0, 0.6, 3, 3, 4), (2, None, None, -1, None, 1, 3, 4), (3, "c", 2, 5, 60.0, 0, 3, 4)]
    df = spark.createDataFrame(rows, "pkStreetID long, EnglishName string, Direction int, NoOfLane int, SpeedLimit double, FOW int, Subtype int, fkEmirateID int")
    got = {r.orig_id: r for r in streets.ingest(df).collect()}
    assert (got[1].lanes, got[1].maxspeed, got[1].highway, got[1].oneway) == ("1", "0.6", "secondary_link", "yes")
    assert (got[2].lanes, got[2].maxspeed, got[2].highway, got[2].oneway) == ("1", None, "road", "no")
    assert {r.id: r.highway for r in streets.full_tags(df).collect()} == {1: "secondary_link", 2: "secondary", 3: "primary"}


def test_xml_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(1, 1, 466000001, 246000000), (1, 2, 466001000, 246000000)], VERTICES)
    nodes = topo.extract_nodes(v)
    ways = topo.way_nodes(v, nodes)
    tags = spark.createDataFrame([(1, "road", "a & <b>", "no", "1", None)], "way_id long, highway string, name string, oneway string, lanes string, maxspeed string")
    osm.write_xml(osm.xml_lines(nodes, ways, tags).coalesce(1), str(tmp_path / "out"))
    assert {tuple(r) for r in osm.read_nodes(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in nodes.collect()}
    assert {tuple(r) for r in osm.read_ways(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in ways.collect()}


def test_search_parameters(spark):
    df = spark.createDataFrame([(1, "blue widget"), (2, "red bolt"), (3, None)], "id long, name string")
    assert [r.id for r in search.fuzzy_search(df, "id", {"name": 2.0}, "Blu widgit").collect()] == [1]
    with pytest.raises(ValueError):
        search.nearest_places(df, 0, 0, "school")
