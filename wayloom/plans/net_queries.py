"""Queries on the street network: snap rounding on adaptive tiles, vector tiles of lines, nearest neighbours,
isochrones as outlines, search through an index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import nearest, noding, outlines, routing, search_index, streets as tags, tiles, topology as topo, vector_tiles
from ..operators.maps import BUFFER, EXTENT
from .registry import _GAIN, _INGEST, _KM, _REACH, _SEGS, _WORDS, PLACES, V, _search_sql, _sources, base, query
from .staging import shared_dir, staged
from .views import sql, view

#: The grid, 1e-6 degrees, and tiles: cut where more than so many segments meet them.
GRID, LARGE, MOST, DEPTH = 10, 64_000, 40, 3


def _round(c: str) -> str:
    return f"CAST(floor(({c} + {GRID // 2}) / {GRID}.0) AS BIGINT) * {GRID} AS {c}"


def _spread(source: str, margin: int = 0) -> str:
    """source in every square of 4000 units that a segment's box meets: tx, ty."""
    span = lambda c: f"unnest(range(CAST(floor((least(a{c}, b{c}) - {margin}) / 4000.0) AS BIGINT), CAST(floor((greatest(a{c}, b{c}) + {margin}) / 4000.0) AS BIGINT) + 1)) AS t{c}"
    return f"(SELECT *, {span('y')} FROM (SELECT *, {span('x')} FROM {source}) q)"


_OVERLAP = " AND ".join(f"least(a.a{c}, a.b{c}) <= greatest(b.a{c}, b.b{c}) AND least(b.a{c}, b.b{c}) <= greatest(a.a{c}, a.b{c})" for c in "xy")
_AT = ", ".join(f"p{c} + {GRID} * ((2 * t * r{c} + {GRID} * den - (((2 * t * r{c} + {GRID} * den) % ({2 * GRID} * den)) + {2 * GRID} * den) % ({2 * GRID} * den)) // ({2 * GRID} * den)) AS {c}" for c in "xy")
_NODED = f"""WITH v AS {V}, raw AS ({_SEGS}), segs AS MATERIALIZED (SELECT * FROM (SELECT way_id, seq_a, {", ".join(map(_round, ("ax", "ay", "bx", "by")))} FROM raw) z WHERE ax <> bx OR ay <> by),
 cells AS MATERIALIZED {_spread('segs')},
 m AS (SELECT DISTINCT a.ax AS px, a.ay AS py, a.bx - a.ax AS rx, a.by - a.ay AS ry, b.bx - b.ax AS sx, b.by - b.ay AS sy, b.ax - a.ax AS wx, b.ay - a.ay AS wy FROM cells a JOIN cells b ON a.tx = b.tx AND a.ty = b.ty AND (a.way_id < b.way_id OR (a.way_id = b.way_id AND a.seq_a < b.seq_a)) AND {_OVERLAP}),
 d AS (SELECT px, py, rx, ry, rx * sy - ry * sx AS n, wx * sy - wy * sx AS t, wx * ry - wy * rx AS w FROM m),
 e AS (SELECT px, py, rx, ry, abs(n) AS den, CASE WHEN n < 0 THEN -t ELSE t END AS t, CASE WHEN n < 0 THEN -w ELSE w END AS w FROM d WHERE n <> 0),
 x AS (SELECT {_AT} FROM e WHERE t BETWEEN 0 AND den AND w BETWEEN 0 AND den),
 hot AS MATERIALIZED (SELECT x, y, CAST(floor(x / 4000.0) AS BIGINT) AS tx, CAST(floor(y / 4000.0) AS BIGINT) AS ty FROM (SELECT ax AS x, ay AS y FROM segs UNION SELECT bx, by FROM segs UNION SELECT x, y FROM x) z),
 h AS (SELECT way_id, seq_a, x, y, 2 * (ax - x) AS u, 2 * (ay - y) AS v, 2 * (bx - ax) AS du, 2 * (by - ay) AS dv, (x - ax) * (bx - ax) + (y - ay) * (by - ay) AS along FROM {_spread('segs', GRID)} s JOIN hot USING (tx, ty)),
 pieces AS MATERIALIZED (SELECT * FROM (SELECT way_id, seq_a, row_number() OVER k - 1 AS piece, x AS ax, y AS ay, lead(x) OVER k AS bx, lead(y) OVER k AS by FROM h WHERE {noding.hit_sql(GRID)} WINDOW k AS (PARTITION BY way_id, seq_a ORDER BY along, x, y)) z WHERE bx IS NOT NULL)"""
_TURN = "(ax < bx OR (ax = bx AND ay <= by))"
_LINES = ", lines AS MATERIALIZED (SELECT ax, ay, bx, by, min(way_id) AS way_id, min(seq_a) AS seq_a, sum(n) AS n_sources FROM (SELECT way_id, min(seq_a) AS seq_a, count(*) AS n, rank() OVER (PARTITION BY ax, ay, bx, by ORDER BY way_id) AS r, ax, ay, bx, by FROM (SELECT way_id, seq_a, " + ", ".join(f"CASE WHEN {_TURN} THEN {a} ELSE {b} END AS {a}" for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))) + " FROM pieces) t GROUP BY ax, ay, bx, by, way_id) g GROUP BY ax, ay, bx, by)"


def _segments(spark, sf_dir):
    segs = staged(noding.on_grid(topo.segments(view(spark, sf_dir, "way_vertices")), GRID), "segments")
    return segs, tiles.tree(segs, LARGE, MOST, DEPTH)


@query(f"{_NODED} SELECT * FROM pieces")
def snap_noding(spark, sf_dir):
    """Every segment as the line through the hot pixels on its way, dealt out over adaptive tiles."""
    segs, tree = _segments(spark, sf_dir)
    return noding.noded(segs, GRID, tree, again=False)


@query(f"{_NODED} SELECT * FROM pieces")
def resumed_noding(spark, sf_dir):
    """The pieces of snap_noding by a run over shards that stops after its first step, twice, and is taken up again."""
    segs, tree = _segments(spark, sf_dir)
    path = f"{shared_dir(spark)}/wayloom/{uuid.uuid4().hex}-shards"
    for steps in (1, 1, None):
        out = noding.noded_by_shards(segs, path, GRID, tree, 8, 4, steps)
    return out


def _side(o: str, e: str, p: str) -> str:
    return f"sign(({e}x - {o}x) * ({p}y - {o}y) - ({e}y - {o}y) * ({p}x - {o}x))"


def _within(p: str, a: str, b: str) -> str:
    return f"{p}x BETWEEN least({a}x, {b}x) AND greatest({a}x, {b}x) AND {p}y BETWEEN least({a}y, {b}y) AND greatest({a}y, {b}y) AND NOT ({p}x = {a}x AND {p}y = {a}y) AND NOT ({p}x = {b}x AND {p}y = {b}y)"


_PAIRS = f"""pc AS MATERIALIZED {_spread('lines')}, pr AS (SELECT DISTINCT a.ax AS pax, a.ay AS pay, a.bx AS pbx, a.by AS pby, b.ax AS qax, b.ay AS qay, b.bx AS qbx, b.by AS qby FROM pc a JOIN pc b ON a.tx = b.tx AND a.ty = b.ty AND (a.ax, a.ay, a.bx, a.by) < (b.ax, b.ay, b.bx, b.by) AND {_OVERLAP}),
 sd AS (SELECT *, {_side('pa', 'pb', 'qa')} AS s1, {_side('pa', 'pb', 'qb')} AS s2, {_side('qa', 'qb', 'pa')} AS s3, {_side('qa', 'qb', 'pb')} AS s4 FROM pr)"""
_TOUCH = " + ".join(f"CASE WHEN {s} = 0 AND {_within(p, a, b)} THEN 1 ELSE 0 END" for s, p, a, b in (("s1", "qa", "pa", "pb"), ("s2", "qb", "pa", "pb"), ("s3", "pa", "qa", "qb"), ("s4", "pb", "qa", "qb")))


@query(f"{_NODED}{_LINES}, {_PAIRS} SELECT (SELECT count(*) FROM lines) AS n_pieces, count(*) FILTER (WHERE s1 * s2 < 0 AND s3 * s4 < 0) AS n_crossing, CAST(coalesce(sum({_TOUCH}), 0) AS BIGINT) AS n_touching FROM sd")
def snap_noding_faults(spark, sf_dir):
    """How many pieces of line there are, and pairs of them that meet anywhere but at their ends: none."""
    segs, tree = _segments(spark, sf_dir)
    return noding.faults(noding.noded(segs, GRID, tree, again=False), tree)


_TAGS = f"SELECT orig_id, coalesce(name, 'unknown') AS name, coalesce(highway, 'road') AS highway, oneway, lanes, maxspeed FROM ({_INGEST}) i"


@query(f"{_NODED}{_LINES} SELECT ax, ay, bx, by, way_id, CAST(n_sources AS BIGINT) AS n_sources, name, highway, oneway, coalesce(lanes, '1') AS lanes, maxspeed FROM lines LEFT JOIN ({_TAGS}) s ON way_id = orig_id")
def noded_streets(spark, sf_dir):
    """Each piece of line once, with the attributes of the smallest street that lies on it."""
    segs, tree = _segments(spark, sf_dir)
    lines = noding.unique_pieces(noding.noded(segs, GRID, tree, again=False)).drop("seq_a")
    streets = tags.with_defaults(tags.ingest(view(spark, sf_dir, "streets")))
    out = lines.join(streets.withColumnRenamed("orig_id", "way_id"), "way_id", "left")
    return out.select("ax", "ay", "bx", "by", "way_id", "n_sources", "name", "highway", "oneway", F.coalesce("lanes", F.lit("1")).alias("lanes"), "maxspeed")


# --- tiles of lines ---------------------------------------------------------------------------------------------------

ZOOM = 16
_STEPS = f"{float((1 << ZOOM) * EXTENT)}"


def _tiles_over(g: str, h: str, name: str) -> str:
    return f"unnest(range(greatest(CAST(floor((least({g}, {h}) - {BUFFER}) / {EXTENT}.0) AS BIGINT), 0), least(CAST(floor((greatest({g}, {h}) + {BUFFER}) / {EXTENT}.0) AS BIGINT), {(1 << ZOOM) - 1}) + 1)) AS {name}"


def _clip(c: str, o: str, source: str) -> str:
    there, ends = vector_tiles.clip_sql(c, o)
    return f"SELECT way_id, seq, x, y, {', '.join(f'{e} AS {n}' for n, e in ends.items())} FROM {source} WHERE {there}"


_CLIPPED = f"""WITH v AS {V}, g AS (SELECT way_id, seq, CAST(floor((lon + 180.0) / 360.0 * {_STEPS}) AS BIGINT) AS gx, CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * {_STEPS}) AS BIGINT) AS gy FROM (SELECT *, x_e7 / 1e7 AS lon, y_e7 / 1e7 AS lat FROM v) z),
 s AS (SELECT * FROM (SELECT *, lead(gx) OVER w AS hx, lead(gy) OVER w AS hy FROM g WINDOW w AS (PARTITION BY way_id ORDER BY seq)) z WHERE hx IS NOT NULL AND (gx <> hx OR gy <> hy)),
 t AS (SELECT *, {_tiles_over('gy', 'hy', 'y')} FROM (SELECT *, {_tiles_over('gx', 'hx', 'x')} FROM s) z),
 l AS (SELECT way_id, seq, x, y, gx - x * {EXTENT} AS ax, gy - y * {EXTENT} AS ay, hx - x * {EXTENT} AS bx, hy - y * {EXTENT} AS by FROM t),
 c1 AS ({_clip('x', 'y', 'l')}), c2 AS ({_clip('y', 'x', 'c1')}), segs AS (SELECT way_id, seq, x, y, ax, ay, bx, by FROM c2 WHERE ax <> bx OR ay <> by)"""


@query(f"{_CLIPPED} SELECT * FROM segs")
def line_tile_segments(spark, sf_dir):
    """The segments of all lines in the tiles of zoom 16, clipped to tile and margin."""
    return vector_tiles.clipped(vector_tiles.on_zoom(view(spark, sf_dir, "way_vertices"), ZOOM), ZOOM)


_TILE_LINE = "w AS (PARTITION BY x, y, way_id ORDER BY seq)"


@query(f"""{_CLIPPED}, p AS (SELECT *, sum(gap) OVER {_TILE_LINE[5:]} AS part FROM (SELECT *, CASE WHEN lag(bx) OVER w <> ax OR lag(by) OVER w <> ay THEN 1 ELSE 0 END AS gap FROM segs WINDOW {_TILE_LINE}) z),
 n AS (SELECT *, row_number() OVER (PARTITION BY x, y, way_id, part ORDER BY seq) AS no FROM p)
 SELECT x, y, way_id, CAST(part AS BIGINT) AS part, 0 AS no, ax AS px, ay AS py FROM n WHERE no = 1 UNION ALL SELECT x, y, way_id, CAST(part AS BIGINT), no, bx, by FROM n""")
def line_tiles(spark, sf_dir):
    """All positions of the vector tiles of zoom 16, read back from the tiles' bytes."""
    return vector_tiles.tile_points(vector_tiles.line_tiles(view(spark, sf_dir, "way_vertices"), ZOOM))


# --- neighbours -------------------------------------------------------------------------------------------------------

_PLANAR = "(a.{x} - b.{x}) * (a.{x} - b.{x}) + (a.{y} - b.{y}) * (a.{y} - b.{y})"


@query(f"SELECT id, rank, node, d2 FROM (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY (lon_e7 - x_e7) * (lon_e7 - x_e7) + (lat_e7 - y_e7) * (lat_e7 - y_e7), node) AS rank, node, (lon_e7 - x_e7) * (lon_e7 - x_e7) + (lat_e7 - y_e7) * (lat_e7 - y_e7) AS d2 FROM {PLACES} a, {sql('road_nodes')} b) q WHERE rank = 1")
def nearest_road_nodes(spark, sf_dir):
    """The road node nearest each place in the plane."""
    places = view(spark, sf_dir, "places").select("id", F.col("lon_e7").alias("x_e7"), F.col("lat_e7").alias("y_e7"))
    return nearest.nearest_join(places, view(spark, sf_dir, "road_nodes"))


@query(f"SELECT id, rank, hospital, d2 FROM (SELECT a.id, b.id AS hospital, {_PLANAR.format(x='lon_e7', y='lat_e7')} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_PLANAR.format(x='lon_e7', y='lat_e7')}, b.id) AS rank FROM {PLACES} a JOIN {PLACES} b ON a.type = 'clinic' AND b.type = 'hospital') q WHERE rank <= 5")
def knn_places(spark, sf_dir):
    """The five hospitals nearest each clinic in the plane, in order."""
    p = view(spark, sf_dir, "places").select("id", "type", F.col("lon_e7").alias("x_e7"), F.col("lat_e7").alias("y_e7"))
    return nearest.nearest_join(p.where("type = 'clinic'"), p.where("type = 'hospital'").withColumnRenamed("id", "hospital"), 5, other="hospital")


# --- isochrones as outlines -------------------------------------------------------------------------------------------

SQUARE = 20_000
_WALK = ", ".join(f"CAST(floor((a{c} + floor((b{c} - a{c}) * i / CAST(n AS DOUBLE))) / {SQUARE}.0) AS BIGINT) AS c{c}" for c in "xy")
_SQUARES = f"""{_REACH}, p AS (SELECT source, node, greatest(1, CAST(ceil(seconds / 10.0) AS BIGINT)) AS contour, x_e7 AS x, y_e7 AS y FROM best JOIN {sql('road_nodes')} k USING (node)),
 ways AS (SELECT a.source, greatest(a.contour, b.contour) AS contour, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM e JOIN p a ON e.src = a.node JOIN p b ON e.dst = b.node AND a.source = b.source UNION ALL SELECT source, contour, x, y, x, y FROM p),
 walked AS (SELECT *, unnest(range(n + 1)) AS i FROM (SELECT *, CAST(1 + floor(2 * greatest(abs(bx - ax), abs(by - ay)) / {SQUARE}.0) AS BIGINT) AS n FROM ways) z),
 first AS (SELECT source, cx, cy, min(contour) AS first FROM (SELECT source, contour, {_WALK} FROM walked) z GROUP BY ALL),
 squares AS (SELECT source, unnest(range(first, 4)) AS contour, cx, cy FROM first)"""


def _reached_squares(spark, sf_dir):
    edges = view(spark, sf_dir, "road_edges")
    reached = staged(routing.contours(edges, _sources(spark), 10, 3), "reached")
    return outlines.squares(reached, edges, view(spark, sf_dir, "road_nodes"), SQUARE, 3)


@query(f"{_SQUARES} SELECT * FROM squares")
def isochrone_squares(spark, sf_dir):
    """The squares on the edges reached within each contour."""
    return _reached_squares(spark, sf_dir)


@query(f"{_SQUARES} SELECT source, contour, count(*) * {SQUARE * SQUARE} AS area FROM squares GROUP BY ALL")
def isochrone_areas(spark, sf_dir):
    """What the outlines of each contour enclose."""
    return outlines.areas(outlines.outlines(_reached_squares(spark, sf_dir), SQUARE))


@query()
def isochrone_outlines(spark, sf_dir):
    """The outlines of each contour without islands of under a tenth of its largest part, as rings of corners; without SQL, tested by what they hold."""
    return outlines.outlines(outlines.without_islands(staged(_reached_squares(spark, sf_dir), "squares"), 0.1), SQUARE)


# --- search -----------------------------------------------------------------------------------------------------------


@query(_search_sql())
def indexed_search(spark, sf_dir):
    """The rows of fuzzy_search, found through the index of words."""
    index = search_index.SearchIndex.build(base(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"])
    return index.search("Blu widgit", {"p_name": 3.0, "p_type": 1.0})


_NEAR_TERMS = " + ".join(_GAIN.format(w=_WORDS.format(f="name"), t=t, k=2, n=float(len(t) + 1)) for t in ("custmer", "000000112"))


@query(f"SELECT id, score FROM (SELECT id, round(({_NEAR_TERMS}) * 1.5, 6) AS score FROM (SELECT *, pow(sin(radians(lat - 24.7) / 2), 2) + cos(radians(24.7)) * cos(radians(lat)) * pow(sin(radians(lon - 46.7) / 2), 2) AS h FROM (SELECT *, lon_e7 / 1e7 AS lon, lat_e7 / 1e7 AS lat FROM {PLACES} p WHERE lower(type) = 'hospital') a) b WHERE {_KM} <= 20) q WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def indexed_search_near(spark, sf_dir):
    """Hospitals within 20 km by parts of their names."""
    places = view(spark, sf_dir, "places")
    index = search_index.SearchIndex.build(places, "id", ["name"])
    return index.search("custmer 000000112", {"name": 3.0}, only=search_index.filtered(places, {"type": "Hospital "}, 46.7, 24.7, 20))
