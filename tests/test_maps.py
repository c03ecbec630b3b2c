"""Hand-made cases for snapping steps, lines, shards, facilities, readers and map styles."""

import heapq
import json
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayloom.functions import geo, wkb
from wayloom.operators import facilities, lines, maps, routing, shards, streets, topology as topo
from wayloom.plans import registry
from wayloom.plans.views import view
from wayloom.sources import extract, osm

VERTICES = "way_id long, seq long, x_e7 long, y_e7 long"
SF = "/root/testdata/sf0.001"


def graph(spark, rows):
    v = spark.createDataFrame(rows, VERTICES)
    nodes = topo.extract_nodes(v)
    return topo.way_nodes(v, nodes), nodes


def test_two_ends_with_one_foot_share_its_node(spark):
    ways, nodes = graph(spark, [(1, 1, 0, 0), (1, 2, 10000, 0), (2, 1, 3000, 300), (2, 2, 3000, 9000), (3, 1, 3000, -300), (3, 2, 3000, -9000)])
    new, all_ = topo.snap_to_segments(ways, nodes)
    refs = defaultdict(list)
    for r in new.orderBy("way_id", "seq").collect():
        refs[r.way_id].append(r.node_id)
    assert all_.count() == nodes.count() + 1 and len(refs[1]) == 3 and refs[1][1] == refs[2][0] == refs[3][0]


def test_feet_on_one_segment_come_in_its_order(spark):
    ways, nodes = graph(spark, [(1, 1, 0, 0), (1, 2, 10000, 0), (2, 1, 7000, 300), (2, 2, 7000, 9000), (3, 1, 3000, 300), (3, 2, 3000, 9000)])
    new, all_ = topo.snap_to_segments(ways, nodes)
    x = {r.node_id: r.x_e7 for r in all_.collect()}
    assert [x[r.node_id] for r in new.where("way_id = 1").orderBy("seq").collect()] == [0, 3000, 7000, 10000]


def test_the_build_joins_what_nearly_meets(spark):
    v = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 50000, 0), (2, 1, 50100, 50), (2, 2, 90000, 0), (3, 1, 20000, 300), (3, 2, 20000, 9000)], VERTICES)
    ways, nodes = topo.build_graph(v)
    at = defaultdict(set)
    for r in ways.collect():
        at[r.node_id].add(r.way_id)
    assert {1, 2} in at.values() and {1, 3} in at.values() and nodes.count() == len(at) == 5


def test_tags_of_status_and_odd_numbers(spark):
    row = {"pkStreetID": 1, "ArabicName": None, "EnglishName": "a", "Strar": None, "Stren": None, "Width": 1.0, "Direction": "1", "NoOfLane": "-0.5", "SpeedLimit": "-0.5", "FOW": "1.0", "Subtype": "x", "StreetStat": "3"}
    kind = "pkStreetID long, ArabicName string, EnglishName string, Strar string, Stren string, Width double, Direction string, NoOfLane string, SpeedLimit string, FOW string, Subtype string, StreetStat string"
    got = streets.safe_tags(spark.createDataFrame([row], kind)).first()
    assert (got.lanes, got.maxspeed, got.junction, got.access, got.surface, got.highway) == ("1", None, "roundabout", "no", "dirt", "road")


def test_lines_are_repaired_measured_and_kept_once(spark):
    df = spark.createDataFrame([(1, [(0, 0), (3, 0), (40, 0)]), (2, [(0, 0), (40, 1)]), (3, [(5, 5)]), (4, None)], "way_id long, line array<struct<x:bigint,y:bigint>>")
    got = lines.distinct_lines(lines.usable(lines.snapped(df, 10))).collect()
    assert [(r.way_id, r.n_points, r.wkt, r.n_same) for r in got] == [(1, 2, "LINESTRING (0 0, 40 0)", 2)]
    m = df.where("way_id = 1").select(lines.length("line").alias("d"), lines.centroid("line", "x", 0).alias("x")).first()
    assert (m.d, m.x) == (40.0, 20.0)


def test_overlap_takes_the_longest(spark):
    seg = "way_id long, seq_a long, ax long, ay long, bx long, by long"
    piece = spark.createDataFrame([(9, 1, 10, 0, 100, 0)], seg)
    source = spark.createDataFrame([(1, 1, 0, 0, 50, 0), (2, 1, 40, 0, 200, 0), (3, 1, 0, 1, 200, 1), (4, 1, 60, -50, 60, 50)], seg)
    assert [tuple(r) for r in lines.best_overlap(piece, source).collect()] == [(9, 1, 2, 60.0)]


def test_shards_merge_to_the_graph_built_at_once(spark):
    v = view(spark, SF, "way_vertices")
    ways, nodes = shards.merged(shards.by_shard(v, 3, 2))
    at = {r.node_id: (r.x_e7, r.y_e7) for r in nodes.collect()}
    want = Counter((r.way_id, r.seq, (r.x_e7, r.y_e7)) for r in v.collect())
    assert Counter((r.way_id, r.seq, at[r.node_id]) for r in ways.collect()) == want and len(set(at.values())) == len(at)
    assert sum(r.n for r in shards.adaptive_tiles(v, 80_000, 50, 3).collect()) == v.count()


def dijkstra(edges, source):
    best, heap = {}, [(0, source)]
    out = defaultdict(list)
    for a, b, s in edges:
        out[a].append((b, s))
    while heap:
        d, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = d
        for m, s in out[n]:
            heapq.heappush(heap, (d + s, m))
    return best


def test_nearest_facilities_by_travel_time(spark):
    places, nodes, edges = (view(spark, SF, n) for n in ("places", "road_nodes", "road_edges"))
    lon, lat = 46.7, 24.7
    got = facilities.nearest_facilities(places, nodes, edges, lon, lat, "hospital", 3, 20).orderBy("rank").collect()
    at = [(r.node, r.x_e7, r.y_e7) for r in nodes.collect()]
    near = lambda x, y: min((((a - x) ** 2 + (b - y) ** 2), n) for n, a, b in at)[1]
    times = dijkstra([(r.src, r.dst, r.seconds) for r in edges.collect()], near(round(lon * 1e7), round(lat * 1e7)))
    candidates = registry.search.nearest_places(places, lon, lat, "hospital", 3, 20).collect()
    spot = {r.id: (r.lon_e7, r.lat_e7) for r in places.collect()}
    want = sorted((times[near(*spot[c.id])], c.distance_m, c.id) for c in candidates if near(*spot[c.id]) in times)[:3]
    assert [(r.seconds, r.distance_m, r.id) for r in got] == want and [r.rank for r in got] == list(range(1, len(want) + 1))
    with pytest.raises(ValueError):
        facilities.speed("boat", F.lit("road"))


def test_contours_have_hulls_around_what_is_reached(spark):
    nodes = spark.createDataFrame([(i, (i % 5) * 10, (i // 5) * 10) for i in range(25)], "node long, x_e7 long, y_e7 long")
    reached = spark.createDataFrame([(0, i, 1, 1 if i < 10 else 2) for i in range(25)], "source long, node long, seconds long, contour long")
    got = defaultdict(set)
    for r in routing.contour_hulls(reached, nodes, 2).collect():
        got[r.contour].add((r.x, r.y))
    assert got == {1: {(0, 0), (40, 0), (40, 10), (0, 10)}, 2: {(0, 0), (40, 0), (40, 40), (0, 40)}}


def test_features_are_json(spark):
    for name, kind in (("gap_lines_geojson", "LineString"), ("grid_cells_geojson", "Polygon"), ("ways_geojson", "LineString"), ("hull_geojson", "Polygon")):
        r = json.loads(registry.QUERIES[name](spark, SF).first().feature)
        assert r["type"] == "Feature" and r["geometry"]["type"] == kind


def test_locations_in_both_forms(spark):
    text = spark.createDataFrame([("24.5, 46.5",), ("x",), (None,)], "location string")
    lon, lat = maps.location(text)
    assert [tuple(r) for r in text.select(lon, lat).collect()] == [(46.5, 24.5), (None, None), (None, None)]
    struct = spark.createDataFrame([((46.5, 24.5),)], "location struct<lon:double,lat:double>")
    lon, lat = maps.location(struct)
    assert tuple(struct.select(lon, lat).first()) == (46.5, 24.5)


def test_readers_by_ending_and_sinks(spark, tmp_path):
    (tmp_path / "s.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}}]}))
    got = extract.read_streets(spark, str(tmp_path / "s.geojson"), properties="name string").first()
    assert got.properties.name == "a" and got.geometry.coordinates == [[1.0, 2.0], [3.0, 4.0]]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    extract.swap_view(df, "swapped", str(tmp_path / "one.parquet"))
    extract.swap_view(df.where("id = 2"), "swapped", str(tmp_path / "two.parquet"))
    assert spark.table("swapped").count() == 1 and extract.read_streets(spark, str(tmp_path / "*.parquet")).count() == 3
    extract.require_tables(spark, ["swapped"])
    with pytest.raises(ValueError, match="nowhere"):
        extract.require_tables(spark, ["nowhere"])
    with pytest.raises(ValueError):
        extract.read_streets(spark, "a.xyz")
    assert json.loads(extract.response(df, "rows", "id").first().body) == {"rows": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}]}
    w, n = graph(spark, [(1, 1, 10, 20), (1, 2, 30, 40)])
    tags = spark.createDataFrame([(1, "road", "a & b", "no", "1", None)], "way_id long, highway string, name string, oneway string, lanes string, maxspeed string")
    osm.write_xml(osm.xml_lines(n, w, tags), str(tmp_path / "x.osm"))
    assert osm.read_nodes(spark, str(tmp_path / "x.osm")).count() == 2 and osm.read_ways(spark, str(tmp_path / "x.osm")).count() == 2


def test_geometry_of_lines_as_degrees(spark):
    whole = struct.pack("<BII4d", 1, 2, 2, 1.0, 2.0, 3.0, 4.0)
    df = spark.createDataFrame([(bytearray(whole),), (bytearray(b"broken"),), (None,)], "geometry binary")
    assert extract.geometry_kind(df) == "wkb"
    parts = [r[0] for r in df.select(wkb.to_parts("geometry")).collect()]
    assert [[(p.lon, p.lat) for p in line] for line in parts[0]] == [[(1.0, 2.0), (3.0, 4.0)]] and parts[1:] == [None, None]
    line = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.0), (float("nan"), 1.0), (3.0, 4.0)],), ([(1.0, 1.0)],)], f"line {geo.LINE}")
    fixed = line.select(geo.repaired(F.col("line")).alias("line"))
    assert [None if r.line is None else len(r.line) for r in fixed.collect()] == [2, None]
    assert fixed.select(geo.length(F.col("line")).alias("d"), geo.linestring_json(F.col("line")).alias("j")).first().d == 5.0
    point = spark.createDataFrame([(5.0, 5.0)], "x double, y double")
    assert point.select(geo.projection_t(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0))).first()[0] == 0.5


def test_tours_are_exact_up_to_eleven_stops():
    from itertools import permutations
    from random import Random

    r = Random(8)
    for n, closed in ((1, True), (2, True), (6, True), (6, False)):
        cost = {(a, b): r.randint(1, 30) for a in range(n) for b in range(n) if a != b}
        legs = lambda o: sum(cost[p] for p in zip(o, o[1:])) + (cost[o[-1], o[0]] if closed and n > 1 else 0)  # noqa: B023, E731
        want = min((legs((0, *p)), [0, *p]) for p in permutations(range(1, n)))
        assert routing._order(cost, list(range(n)), closed) == want
    cost = {(a, b): r.randint(1, 30) for a in range(11) for b in range(11) if a != b}
    assert sorted(routing._order(cost, list(range(11)), True)[1]) == list(range(11))
