"""Queries for maps and services: features as GeoJSON, tiles, styles, profiles, facilities by travel time, typed extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import areas, facilities, maps, routing, streets as tags, topology as topo
from ..operators.overlay import Overlay
from ..sources import extract, osm
from .registry import _BOX, _FULL, _GAPS, _PI_TILE, _WN, PLACES, STREETS, V, _ends, _graph, _sources, base, query
from .staging import staged
from .views import sql, view

_DEG = "printf('%.7f', {} / 1e7)"


def _pos(x: str, y: str) -> str:
    return f"'[' || {_DEG.format(x)} || ',' || {_DEG.format(y)} || ']'"


def _feature(kind: str, coordinates: str, **properties: str) -> str:
    listed = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in properties.items())
    return "'{\"type\":\"Feature\",\"properties\":{' || " + listed + " || '},\"geometry\":{\"type\":\"" + kind + "\",\"coordinates\":' || " + coordinates + " || '}}'"


# --- features --------------------------------------------------------------------------------------------------------


@query(f"{_GAPS}, top AS (SELECT * FROM gaps ORDER BY d2 DESC, way_a, way_b, node_a, node_b LIMIT 200000) SELECT " + _feature("LineString", "'[' || " + _pos("a.x_e7", "a.y_e7") + " || ',' || " + _pos("b.x_e7", "b.y_e7") + " || ']'", way_a="way_a", way_b="way_b", d2="d2") + " AS feature FROM top JOIN nodes a ON a.node_id = node_a JOIN nodes b ON b.node_id = node_b")
def gap_lines_geojson(spark, sf_dir):
    """The 200,000 widest gaps as lines."""
    ends, nodes, _ = _ends(spark, sf_dir)
    top = topo.gap_pairs(ends).orderBy(F.desc("d2"), "way_a", "way_b", "node_a", "node_b").limit(200_000)
    at = lambda s: nodes.select(F.col("node_id").alias(f"node_{s}"), F.col("x_e7").alias(f"{s}x"), F.col("y_e7").alias(f"{s}y"))
    placed = top.join(at("a"), "node_a").join(at("b"), "node_b")
    line = maps.path([maps.position(F.col("ax"), F.col("ay")), maps.position(F.col("bx"), F.col("by"))])
    return placed.select(maps.feature("LineString", line, {k: F.col(k) for k in ("way_a", "way_b", "d2")}).alias("feature"))


@query(f"{_GAPS}, pts AS (SELECT node_a AS node_id FROM gaps UNION SELECT node_b FROM gaps) SELECT " + _feature("Point", _pos("x_e7", "y_e7"), node_id="node_id") + " AS feature FROM pts JOIN nodes USING (node_id)")
def gap_points_geojson(spark, sf_dir):
    ends, nodes, _ = _ends(spark, sf_dir)
    g = topo.gap_pairs(ends)
    both = g.select(F.col("node_a").alias("node_id")).union(g.select("node_b")).distinct().join(nodes, "node_id")
    return both.select(maps.feature("Point", maps.position(F.col("x_e7"), F.col("y_e7")), {"node_id": F.col("node_id")}).alias("feature"))


_CORNERS = [("0", "0"), ("10000", "0"), ("10000", "10000"), ("0", "10000"), ("0", "0")]


@query(f"{_BOX}, cells AS (SELECT CAST(floor((floor((bx0 + bx1) / 2.0) - x0) / 10000.0) AS BIGINT) AS gc, CAST(floor((floor((by0 + by1) / 2.0) - y0) / 10000.0) AS BIGINT) AS gr, min(x0) AS x0, min(y0) AS y0, count(*) AS n_ways FROM bx, b GROUP BY 1, 2), c AS (SELECT *, x0 + gc * 10000 AS x, y0 + gr * 10000 AS y FROM cells) SELECT " + _feature("Polygon", "'[[' || " + " || ',' || ".join(_pos(f"(x + {a})", f"(y + {b})") for a, b in _CORNERS) + " || ']]'", n_ways="n_ways") + " AS feature FROM c")
def grid_cells_geojson(spark, sf_dir):
    v = view(spark, sf_dir, "way_vertices")
    cells = areas.coverage(v, 10_000).crossJoin(F.broadcast(areas.bounds(v)))  # one row
    x, y = F.col("x0") + F.col("gc") * 10_000, F.col("y0") + F.col("gr") * 10_000
    ring = maps.path([maps.path([maps.position(x + int(a), y + int(b)) for a, b in _CORNERS])])
    return cells.select(maps.feature("Polygon", ring, {"n_ways": F.col("n_ways")}).alias("feature"))


@query(f"WITH v AS {V}, l AS (SELECT way_id, '[' || string_agg(" + _pos("x_e7", "y_e7") + ", ',' ORDER BY seq) || ']' AS c FROM v GROUP BY way_id HAVING count(*) >= 2) SELECT " + _feature("LineString", "c", way_id="way_id") + " AS feature FROM l")
def ways_geojson(spark, sf_dir):
    v = view(spark, sf_dir, "way_vertices")
    points = F.array_sort(F.collect_list(F.struct("seq", maps.position(F.col("x_e7"), F.col("y_e7")).alias("p"))))
    lines = v.groupBy("way_id").agg(points.alias("p")).where(F.size("p") >= 2)
    line = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["p"]), ","), F.lit("]"))
    return lines.select(maps.feature("LineString", line, {"way_id": F.col("way_id")}).alias("feature"))


@query()
def hull_geojson(spark, sf_dir):
    """The hull of all vertices as one polygon."""
    corners = areas.hull(view(spark, sf_dir, "way_vertices"))
    listed = corners.agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", maps.position(F.col("x"), F.col("y")).alias("p")))), lambda x: x["p"]).alias("p"))  # a hull's corners
    ring = F.concat(F.lit("[["), F.array_join(F.concat("p", F.slice("p", 1, 1)), ","), F.lit("]]"))
    return listed.select(maps.feature("Polygon", ring, {"n": F.size("p")}).alias("feature"))


@query(f"{_WN}, t AS (SELECT way_id, string_agg('<nd ref=\"' || node_id || '\"/>', '' ORDER BY seq) AS nds FROM wn GROUP BY way_id HAVING count(*) >= 2) SELECT 0 AS kind, node_id AS id, '<node id=\"' || node_id || '\" lat=\"' || " + _DEG.format("y_e7") + " || '\" lon=\"' || " + _DEG.format("x_e7") + " || '\" version=\"1\"/>' AS line FROM nodes UNION ALL SELECT 1, way_id, '<way id=\"' || way_id || '\" version=\"1\">' || nds || '<tag k=\"highway\" v=\"road\"/></way>' FROM t")
def osm_xml_plain(spark, sf_dir):
    """Nodes and ways as map XML, every way a road without attributes of its own."""
    _, nodes, ways = _graph(spark, sf_dir)
    no = F.lit(None).cast("string")
    tagged = ways.select("way_id").distinct().select("way_id", F.lit("road").alias("highway"), *(no.alias(k) for k in osm.TAGS[1:]))
    return osm.xml_lines(nodes, ways, tagged)


@query(f"SELECT id, '{{\"properties\":{{\"name\":\"' || name || '\",\"type\":\"' || type || '\"}},\"geometry\":{{\"type\":\"Point\",\"coordinates\":' || " + _pos("lon_e7", "lat_e7") + f" || '}}}}' AS doc FROM {PLACES} p")
def bulk_documents(spark, sf_dir):
    """One document for the search index for each place: properties and geometry."""
    p = view(spark, sf_dir, "places")
    properties = F.to_json(F.struct("name", "type"), {"ignoreNullFields": "false"})
    return p.select("id", F.concat(F.lit('{"properties":'), properties, F.lit(',"geometry":{"type":"Point","coordinates":'), maps.position(F.col("lon_e7"), F.col("lat_e7")), F.lit("}}")).alias("doc"))


# --- tiles and styles ------------------------------------------------------------------------------------------------

_GRID = "SELECT id, CAST(floor((lon + 180.0) / 360.0 * 4096.0 * 4096) AS BIGINT) AS gx, CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096.0 * 4096) AS BIGINT) AS gy FROM (SELECT id, lon_e7 / 1e7 AS lon, lat_e7 / 1e7 AS lat"


@query(f"SELECT id, x, y, gx - x * 4096 AS px, gy - y * 4096 AS py FROM (SELECT id, gx, gy, x, unnest(range(CAST(floor((gy - 64) / 4096.0) AS BIGINT), CAST(floor((gy + 64) / 4096.0) AS BIGINT) + 1)) AS y FROM (SELECT id, gx, gy, unnest(range(CAST(floor((gx - 64) / 4096.0) AS BIGINT), CAST(floor((gx + 64) / 4096.0) AS BIGINT) + 1)) AS x FROM ({_GRID} FROM {PLACES} p) q) g) h) k")
def tile_points(spark, sf_dir):
    """Places in the tiles of zoom 12, clipped to tile and margin, in the tile's own grid."""
    return maps.tile_points(view(spark, sf_dir, "places"), 12, ["id"])


@query(f"SELECT id, z AS zoom, round(w * CASE WHEN z <= 5 THEN 0.5 WHEN z < 10 THEN 0.5 + (z - 5) / 5.0 * 1.5 WHEN z < 18 THEN 2.0 + (z - 10) / 8.0 * 10.0 ELSE 12.0 END, 6) AS width, CASE WHEN z >= 16 THEN 3.0 WHEN z >= 12 THEN 2.0 ELSE 1.0 END AS size FROM (SELECT pkStreetID AS id, pkStreetID % 23 AS z, coalesce(NoOfLane, 1) AS w FROM {STREETS} s) q")
def zoom_style(spark, sf_dir):
    """Line width by lanes and zoom and text size by zoom, for each street at one zoom."""
    s = view(spark, sf_dir, "streets").select(F.col("pkStreetID").alias("id"), (F.col("pkStreetID") % 23).alias("zoom"), F.coalesce("NoOfLane", F.lit(1)).alias("lanes"))
    width = F.col("lanes") * maps.interpolated(F.col("zoom"), [(5, 0.5), (10, 2.0), (18, 12.0)])
    return s.select("id", "zoom", F.round(width, 6).alias("width"), maps.stepped(F.col("zoom"), 1.0, [(12, 2.0), (16, 3.0)]).alias("size"))


@query("SELECT p_partkey AS id, f AS floor, round(h * f, 6) AS base, round(h * (f + 1), 6) AS top FROM (SELECT p_partkey, p_retailprice / nullif(p_size % 5, 0) AS h, unnest(range(0, p_size % 5)) AS f FROM part) q")
def floor_extrusions(spark, sf_dir):
    """Base and top of every floor of buildings."""
    n = F.col("p_size") % 5
    b = base(spark, sf_dir, "part").where(n > 0).select("p_partkey", "p_retailprice", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("f"))
    low, high = maps.floor_extrusion(F.col("p_retailprice"), F.col("n"), F.col("f"))
    return b.select(F.col("p_partkey").alias("id"), F.col("f").cast("long").alias("floor"), F.round(low, 6).alias("base"), F.round(high, 6).alias("top"))


@query(f"SELECT pkStreetID AS id, row_number() OVER (PARTITION BY pkStreetID ORDER BY n) AS rank, label, value FROM (SELECT pkStreetID, 1 AS n, 'English Name' AS label, EnglishName AS value FROM {STREETS} s UNION ALL SELECT pkStreetID, 2, 'No Of Lane', CAST(NoOfLane AS VARCHAR) FROM {STREETS} s UNION ALL SELECT pkStreetID, 3, 'Strar', Strar FROM {STREETS} s) q WHERE value IS NOT NULL")
def property_labels(spark, sf_dir):
    """The properties shown for a street: those that are there, with names for people."""
    return maps.properties(view(spark, sf_dir, "streets").withColumnRenamed("pkStreetID", "id"), "id", ["EnglishName", "NoOfLane", "Strar"])


@query(f"SELECT id, name FROM {PLACES} p WHERE abs(lon_e7 - 466900000) <= 200000 AND abs(lat_e7 - 246900000) <= 200000 ORDER BY (lon_e7 - 466900000) * (lon_e7 - 466900000) + (lat_e7 - 246900000) * (lat_e7 - 246900000), id LIMIT 1")
def feature_at(spark, sf_dir):
    """The first feature in a box around a point, the nearest one: one row by its meaning."""
    dx, dy = F.col("lon_e7") - 466_900_000, F.col("lat_e7") - 246_900_000
    p = view(spark, sf_dir, "places").where((F.abs(dx) <= 200_000) & (F.abs(dy) <= 200_000))
    return p.orderBy(dx * dx + dy * dy, "id").limit(1).select("id", "name")


@query(f"SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM (SELECT id, lon_e7 / 1e7 AS lon, lat_e7 / 1e7 AS lat FROM {PLACES} p WHERE id % 5 <> 0 UNION ALL SELECT id, NULL, NULL FROM {PLACES} p WHERE id % 5 = 0) q")
def locations(spark, sf_dir):
    """Longitude and latitude from text "lat,lon"; null where the text is something else."""
    p = view(spark, sf_dir, "places")
    text = F.when(F.col("id") % 5 == 0, "nowhere").otherwise(F.concat((F.col("lat_e7") / 1e7).cast("string"), F.lit(", "), (F.col("lon_e7") / 1e7).cast("string")))
    df = p.select("id", text.alias("location"))
    lon, lat = maps.location(df)
    return df.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


# --- travel ----------------------------------------------------------------------------------------------------------


def _speed_sql(profile: str) -> str:
    factor = "1.0"
    for name, f in facilities.CLASSES[profile].items():
        factor = f"CASE WHEN highway = '{name}' THEN {f} ELSE {factor} END"
    return f"SELECT pkStreetID AS id, '{profile}' AS profile, round(Width * 100 / nullif({factor} * {facilities.SPEEDS[profile]}, 0), 6) AS seconds FROM (SELECT *, {_FULL} AS highway FROM {STREETS} s) t"


@query(" UNION ALL ".join(_speed_sql(p) for p in sorted(facilities.SPEEDS)))
def profile_seconds(spark, sf_dir):
    """Seconds along each street (its width a stand-in for length) by profile; null where a profile may not go."""
    s = view(spark, sf_dir, "streets").withColumn("highway", tags.highway_full(F.col("FOW"), F.col("Subtype"), F.col("NoOfLane")))
    parts = [s.select(F.col("pkStreetID").alias("id"), F.lit(p).alias("profile"), F.round(F.try_divide(F.col("Width") * 100, facilities.speed(p, F.col("highway"))), 6).alias("seconds")) for p in sorted(facilities.SPEEDS)]
    return parts[0].union(parts[1]).union(parts[2])


@query()
def nearest_facilities(spark, sf_dir):
    """Hospitals soonest reached over the road network; no SQL, as travel times need a search without a limit."""
    return facilities.nearest_facilities(view(spark, sf_dir, "places"), view(spark, sf_dir, "road_nodes"), view(spark, sf_dir, "road_edges"), 46.7, 24.7, "Hospital ", 5, 20)


@query()
def facility_routes(spark, sf_dir):
    """The ways to the facilities that nearest_facilities finds."""
    nodes, edges = view(spark, sf_dir, "road_nodes"), view(spark, sf_dir, "road_edges")
    overlay = Overlay.build(edges, nodes)
    found = staged(facilities.nearest_facilities(view(spark, sf_dir, "places"), nodes, edges, 46.7, 24.7, "hospital", 5, 20, overlay), "found")
    return facilities.facility_routes(found, nodes, edges, 46.7, 24.7, overlay)


@query()
def isochrone_polygons(spark, sf_dir):
    """The hull of what is reached from each source within each contour: (source, contour, corner, x, y)."""
    nodes = view(spark, sf_dir, "road_nodes")
    return routing.contour_hulls(routing.contours(view(spark, sf_dir, "road_edges"), _sources(spark), 10, 3), nodes, 3)


_ROUTES = "SELECT p_partkey AS request, p_size % 7 + 3 AS n FROM part"


@query(f"SELECT request, CAST(m AS BIGINT) AS rank, CAST(least(2 * m + 3, n) - 2 * m AS BIGINT) AS n_points, (request + 2 * m) AS first_x FROM ({_ROUTES}) r, range(0, 4) k(m) WHERE least(2 * m + 3, n) - 2 * m >= 2")
def maneuver_slices(spark, sf_dir):
    """The points of each maneuver of a route; those of fewer than two go."""
    r = base(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), (F.col("p_size") % 7 + 3).alias("n"))
    shape = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("request") + i).alias("x"), i.cast("long").alias("y")))
    steps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda m: F.struct((2 * m).alias("begin"), F.least(2 * m + 2, F.col("n") - 1).alias("end"), F.lit(1.0).alias("length"), F.lit(1.0).alias("time")))
    kept = r.select("request", shape.alias("shape"), F.filter(steps, lambda s: s["begin"] <= s["end"]).alias("maneuvers"))
    each = kept.select("request", F.explode(F.expr(routing.maneuvers())).alias("m"))
    return each.select("request", F.col("m.rank").cast("long").alias("rank"), F.size("m.points").cast("long").alias("n_points"), F.get("m.points", F.lit(0))["x"].alias("first_x"))


@query("SELECT request, leg, a, b, leg % 8 AS colour FROM (SELECT CAST(floor((c_custkey + 6) / 7.0) AS BIGINT) AS request, row_number() OVER w - 1 AS leg, c_custkey AS a, lead(c_custkey) OVER w AS b FROM customer WINDOW w AS (PARTITION BY floor((c_custkey + 6) / 7.0) ORDER BY c_acctbal, c_custkey)) q WHERE b IS NOT NULL")
def tour_legs(spark, sf_dir):
    """The legs between the stops of tours, coloured in turn."""
    c = base(spark, sf_dir, "customer").select(F.floor((F.col("c_custkey") + 6) / 7).cast("long").alias("request"), F.col("c_custkey").alias("stop"), "c_acctbal")
    visit = F.row_number().over(routing.W.partitionBy("request").orderBy("c_acctbal", "stop")) - 1
    return facilities.legs(c.select("request", visit.cast("long").alias("visit"), "stop"))


@query("SELECT l_orderkey AS id, CAST(l_quantity AS DOUBLE) AS quantity, '{' || l_partkey || '}' AS part_guid, epoch_ms(l_shipdate) AS shipdate, CAST(l_suppkey AS BIGINT) AS legacyfksupp FROM lineitem")
def extract_by_schema(spark, sf_dir):
    """Columns cast by what the table's own schema says of them."""
    li = base(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), F.col("l_partkey").cast("string").alias("part_guid"), F.col("l_shipdate").alias("shipdate"), F.col("l_suppkey").cast("string").alias("legacyfksupp"))
    return extract.typed(li)
