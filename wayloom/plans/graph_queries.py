"""Queries on the street graph as a whole: snapping steps with their nodes, cleaning of lines, shards, exact overlaps."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from ..operators import lines, shards, streets, topology as topo
from ..sources import map_binary, osm
from .registry import _BOX, _CLEAN, _DANGLES, _ENDS, _FEET, _INGEST, _NODES, _SEGS, _WN, V, _graph, query
from .staging import shared_dir, staged
from .views import view

_D2 = "(a.x_e7 - b.x_e7) * (a.x_e7 - b.x_e7) + (a.y_e7 - b.y_e7) * (a.y_e7 - b.y_e7)"
_NEAREST = f"""{_WN}{_ENDS}{_DANGLES}, near AS (SELECT node_a, node_b FROM (SELECT node_a, node_b, row_number() OVER (PARTITION BY node_a ORDER BY d2, node_b) AS rn
 FROM (SELECT a.node_id AS node_a, b.node_id AS node_b, {_D2} AS d2 FROM (SELECT * FROM pos WHERE node_id IN (SELECT node_id FROM dangles)) a JOIN pos b ON a.node_id <> b.node_id AND b.x_e7 BETWEEN a.x_e7 - 200 AND a.x_e7 + 200 AND b.y_e7 BETWEEN a.y_e7 - 200 AND a.y_e7 + 200) p WHERE d2 <= 40000) r WHERE rn = 1),
 sym AS (SELECT node_a AS u, node_b AS w FROM near UNION SELECT node_b, node_a FROM near), reach AS (SELECT u AS node, u AS root FROM sym UNION SELECT sym.w, reach.root FROM reach JOIN sym ON sym.u = reach.node),
 comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node), lw AS (SELECT way_id, seq, coalesce(component, node_id) AS node_id FROM wn LEFT JOIN comp ON node_id = node)"""


@query(f"{_NEAREST} " + _CLEAN.format(src="lw"))
def step_a_snap(spark, sf_dir):
    """Dangling ends joined with the nearest end, with components, relabelling and cleaning."""
    _, nodes, ways = _graph(spark, sf_dir)
    return topo.snap_ends(ways, nodes)[0]


@query(f"{_NEAREST} SELECT node_id, x_e7, y_e7 FROM nodes LEFT JOIN comp ON node_id = node WHERE component IS NULL OR component = node_id")
def step_a_nodes(spark, sf_dir):
    _, nodes, ways = _graph(spark, sf_dir)
    return topo.snap_ends(ways, nodes)[1]


_STEP_B = f"""{_FEET}, fresh AS (SELECT x_e7, y_e7, min(node_id) AS dangle FROM best WHERE (x_e7, y_e7) NOT IN (SELECT (x_e7, y_e7) FROM nodes) GROUP BY x_e7, y_e7),
 added AS (SELECT (SELECT min(node_id) FROM nodes) - row_number() OVER (ORDER BY dangle) AS node_id, x_e7, y_e7 FROM fresh), full_nodes AS (SELECT node_id, x_e7, y_e7 FROM nodes UNION ALL SELECT * FROM added),
 res AS (SELECT b.node_id AS dangle, b.way_id, b.seq_a, b.t, a.node_id AS shared FROM best b JOIN full_nodes a USING (x_e7, y_e7)),
 expanded AS (SELECT way_id, seq AS s, 0.0::DOUBLE AS t, node_id FROM wn WHERE way_id IN (SELECT way_id FROM res) UNION ALL SELECT DISTINCT way_id, seq_a, t, shared FROM res),
 rebuilt AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY s, t, node_id) AS seq, node_id FROM expanded UNION ALL SELECT way_id, seq, node_id FROM wn WHERE way_id NOT IN (SELECT way_id FROM res)),
 moved AS (SELECT way_id, seq, coalesce(shared, node_id) AS node_id FROM rebuilt LEFT JOIN (SELECT DISTINCT dangle, shared FROM res) r ON node_id = dangle)"""


@query(f"{_STEP_B} " + _CLEAN.format(src="moved"))
def step_b_snap(spark, sf_dir):
    """Dangling ends moved to their foot on another way: new nodes, split segments, remapped ends, cleaning."""
    _, nodes, ways = _graph(spark, sf_dir)
    return topo.snap_to_segments(ways, nodes)[0]


@query(f"{_STEP_B} SELECT node_id, x_e7, y_e7 FROM full_nodes")
def step_b_nodes(spark, sf_dir):
    _, nodes, ways = _graph(spark, sf_dir)
    return topo.snap_to_segments(ways, nodes)[1]


@query()
def build_graph(spark, sf_dir):
    """The whole build: every reference of the finished graph with its node's position."""
    ways, nodes = topo.build_graph(staged(view(spark, sf_dir, "way_vertices"), "vertices"))
    return ways.join(nodes, "node_id").select("way_id", "seq", "node_id", "x_e7", "y_e7")


_GAP_LABELS = f"{_WN}{_ENDS}, ep AS (SELECT way_id, node_id, x_e7, y_e7 FROM ends JOIN nodes USING (node_id)), gaps AS (SELECT a.node_id AS node_a, b.node_id AS node_b FROM ep a JOIN ep b ON a.way_id <> b.way_id AND a.node_id <> b.node_id AND b.x_e7 BETWEEN a.x_e7 - 499 AND a.x_e7 + 499 AND b.y_e7 BETWEEN a.y_e7 - 499 AND a.y_e7 + 499), reach AS (SELECT node_a AS node, node_a AS root FROM gaps UNION SELECT g.node_b, r.root FROM reach r JOIN gaps g ON g.node_a = r.node), lab AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"


@query(f"{_GAP_LABELS} SELECT coalesce(component, node_id) AS node_id, CAST(floor(CAST(sum(x_e7) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS x_e7, CAST(floor(CAST(sum(y_e7) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS y_e7, count(*) AS n_merged FROM nodes LEFT JOIN lab ON node_id = node GROUP BY 1")
def boundary_fix_nodes(spark, sf_dir):
    """The nodes after the gaps are closed: clusters at their mean, with how many they were."""
    _, nodes, ways = _graph(spark, sf_dir)
    return topo.at_mean(nodes, topo.gap_labels(ways, nodes))


# --- lines -----------------------------------------------------------------------------------------------------------

_SNAPPED = f"""WITH v AS {V}, s AS (SELECT way_id, seq, CAST(floor((x_e7 + 5) / 10.0) AS BIGINT) * 10 AS x, CAST(floor((y_e7 + 5) / 10.0) AS BIGINT) * 10 AS y FROM v),
 k AS (SELECT way_id, seq, x, y FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM s WINDOW w AS (PARTITION BY way_id ORDER BY seq)) q WHERE px IS NULL OR px <> x OR py <> y),
 l AS (SELECT way_id, count(*) AS n_points, string_agg(CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR), ', ' ORDER BY seq) AS pts FROM k GROUP BY way_id HAVING count(*) BETWEEN 2 AND 10000)"""


@query(f"{_SNAPPED} SELECT min(way_id) AS way_id, n_points, 'LINESTRING (' || pts || ')' AS wkt, count(*) AS n_same FROM l GROUP BY n_points, pts")
def clean_lines(spark, sf_dir):
    """Lines on a grid of 1e-6 degrees without repeated points, of 2 to 10,000 points, once for each geometry."""
    return lines.distinct_lines(lines.usable(lines.snapped(lines.from_vertices(view(spark, sf_dir, "way_vertices")), 10)))


@query(f"{_SNAPPED}, d AS (SELECT way_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM k WHERE way_id IN (SELECT way_id FROM l) WINDOW w AS (PARTITION BY way_id ORDER BY seq)), g AS (SELECT way_id, sqrt(CAST((nx - x) * (nx - x) + (ny - y) * (ny - y) AS DOUBLE)) AS d, (x + nx) / 2.0 AS mx, (y + ny) / 2.0 AS my FROM d WHERE nx IS NOT NULL) SELECT way_id, round(sum(d), 3) AS length, round(sum(d * (mx - 466000000)) / sum(d), 2) AS cx, round(sum(d * (my - 246000000)) / sum(d), 2) AS cy FROM g GROUP BY way_id")
def line_measures(spark, sf_dir):
    """Planar length and length-weighted centroid (from the corner of the data) of each usable line."""
    usable = lines.usable(lines.snapped(lines.from_vertices(view(spark, sf_dir, "way_vertices")), 10))
    return usable.select("way_id", F.round(lines.length("line"), 3).alias("length"), *(F.round(lines.centroid("line", c, origin), 2).alias(f"c{c}") for c, origin in (("x", 466_000_000), ("y", 246_000_000))))


_OVERLAP = f"""WITH v AS {V}, segs AS ({_SEGS}), m AS (SELECT a.way_id AS piece_way, a.seq_a AS piece_seq, b.way_id AS src, a.ax - b.ax AS p0x, a.ay - b.ay AS p0y, a.bx - b.ax AS p1x, a.by - b.ay AS p1y, b.bx - b.ax AS sx, b.by - b.ay AS sy
 FROM (SELECT *, unnest(range(CAST(floor(least(ay, by) / 20000.0) AS BIGINT), CAST(floor(greatest(ay, by) / 20000.0) AS BIGINT) + 1)) AS band FROM segs) a JOIN (SELECT *, unnest(range(CAST(floor(least(ay, by) / 20000.0) AS BIGINT), CAST(floor(greatest(ay, by) / 20000.0) AS BIGINT) + 1)) AS band FROM segs) b
 ON a.band = b.band AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) AND least(b.ax, b.bx) <= greatest(a.ax, a.bx) AND least(a.ay, a.by) <= greatest(b.ay, b.by) AND least(b.ay, b.by) <= greatest(a.ay, a.by)),
 d AS (SELECT DISTINCT * FROM m WHERE p0x * sy - p0y * sx = 0 AND p1x * sy - p1y * sx = 0 AND sx * sx + sy * sy > 0),
 o AS (SELECT piece_way, piece_seq, src, greatest(0, least(greatest(p0x * sx + p0y * sy, p1x * sx + p1y * sy), sx * sx + sy * sy) - greatest(least(p0x * sx + p0y * sy, p1x * sx + p1y * sy), 0)) / sqrt(CAST(sx * sx + sy * sy AS DOUBLE)) AS overlap FROM d)"""


@query(f"{_OVERLAP} SELECT piece_way, piece_seq, src, overlap FROM (SELECT piece_way, piece_seq, src, round(overlap, 3) AS overlap, row_number() OVER (PARTITION BY piece_way, piece_seq ORDER BY round(overlap, 3) DESC, src) AS rn FROM o WHERE overlap > 0) q WHERE rn = 1")
def reattach_by_overlap(spark, sf_dir):
    """For each piece the way whose segment it overlaps longest (ties: the smallest)."""
    segs = topo.segments(view(spark, sf_dir, "way_vertices"))
    return lines.best_overlap(segs, segs)


# --- shards ----------------------------------------------------------------------------------------------------------


@query(f"{_BOX}, g AS (SELECT x0, y0, CAST(floor((x1 - x0) / 5.0) + 1 AS BIGINT) AS w, CAST(floor((y1 - y0) / 4.0) + 1 AS BIGINT) AS h FROM b) SELECT CAST(r.i AS BIGINT) AS shard_row, CAST(k.i AS BIGINT) AS shard_col, x0 + k.i * w AS core_x0, y0 + r.i * h AS core_y0, x0 + (k.i + 1) * w AS core_x1, y0 + (r.i + 1) * h AS core_y1 FROM g, range(4) r(i), range(5) k(i)")
def shard_bounds(spark, sf_dir):
    """The core box of each shard: the small table that lets a stopped run go on."""
    return shards.shard_bounds(view(spark, sf_dir, "way_vertices"), 4, 5)


@query(f"WITH v AS {V}, n AS (SELECT min(-rn) AS node_id, x_e7, y_e7 FROM (SELECT *, row_number() OVER (ORDER BY x_e7, y_e7) AS rn FROM (SELECT DISTINCT x_e7, y_e7 FROM v) d) e GROUP BY x_e7, y_e7) SELECT way_id, seq, node_id FROM v JOIN n USING (x_e7, y_e7)")
def sharded_graph(spark, sf_dir):
    """Way references built shard by shard with ids of their own, merged: nodes at one place are one, references follow."""
    return shards.merged(shards.by_shard(view(spark, sf_dir, "way_vertices"), 4, 5))[0]


def _written(spark, nodes, ways, tags=None) -> str:
    path = f"{shared_dir(spark)}/wayloom/{uuid.uuid4().hex}-map"
    map_binary.write(nodes, ways, path, tags)
    return path


@query(f"WITH v AS {V} {_NODES}")
def map_binary_nodes(spark, sf_dir):
    """The nodes of a map written as binary files and read back."""
    _, nodes, ways = _graph(spark, sf_dir)
    return map_binary.read_nodes(spark, _written(spark, nodes, ways))


@query(f"{_WN} SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY seq) AS seq, node_id FROM wn")
def map_binary_ways(spark, sf_dir):
    """The references of the ways of shards, each written as binary files with ids of its own, read back as one, merged, and written and read again."""
    parts = shards.by_shard(staged(view(spark, sf_dir, "way_vertices"), "vertices"), 4, 5)
    apart = _written(spark, parts[1], parts[0])
    ways, nodes = shards.merged((map_binary.read_ways(spark, apart), staged(map_binary.read_nodes(spark, apart), "shard_nodes")))
    return map_binary.read_ways(spark, _written(spark, nodes, ways))


@query(f"WITH t AS ({_INGEST}), w AS (SELECT DISTINCT l_orderkey AS orig_id FROM lineitem) SELECT orig_id AS way_id, k AS key, v AS value FROM (SELECT orig_id, unnest(['highway', 'name', 'oneway', 'lanes', 'maxspeed']) AS k, unnest([highway, name, oneway, lanes, maxspeed]) AS v FROM t JOIN w USING (orig_id)) z WHERE v IS NOT NULL")
def map_binary_tags(spark, sf_dir):
    """The tags of ways in binary files; those that are null are not there."""
    _, nodes, ways = _graph(spark, sf_dir)
    t = streets.ingest(view(spark, sf_dir, "streets"))
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k in osm.TAGS)), F.array(*(F.col(k).cast("string") for k in osm.TAGS)))
    tags = t.select(F.col("orig_id").alias("way_id"), pairs.alias("tags"))
    return map_binary.read_tags(spark, _written(spark, nodes, ways, tags))


_CELLS = f"WITH v AS {V}, c0 AS (SELECT 0 AS depth, CAST(floor(x_e7 / 80000.0) AS BIGINT) AS cx, CAST(floor(y_e7 / 80000.0) AS BIGINT) AS cy, 80000 AS size, count(*) AS n FROM v GROUP BY ALL), f0 AS (SELECT * FROM c0 WHERE n <= 200), c1 AS (SELECT 1 AS depth, CAST(floor(x_e7 / 20000.0) AS BIGINT) AS cx, CAST(floor(y_e7 / 20000.0) AS BIGINT) AS cy, 20000 AS size, count(*) AS n FROM v JOIN c0 ON c0.n > 200 AND c0.cx = floor(x_e7 / 80000.0) AND c0.cy = floor(y_e7 / 80000.0) GROUP BY ALL), f1 AS (SELECT * FROM c1 WHERE n <= 200), c2 AS (SELECT 2 AS depth, CAST(floor(x_e7 / 5000.0) AS BIGINT) AS cx, CAST(floor(y_e7 / 5000.0) AS BIGINT) AS cy, 5000 AS size, count(*) AS n FROM v JOIN c1 ON c1.n > 200 AND c1.cx = floor(x_e7 / 20000.0) AND c1.cy = floor(y_e7 / 20000.0) GROUP BY ALL)"


@query(f"{_CELLS} SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM c2")
def adaptive_tiles(spark, sf_dir):
    """Tiles cut in 4 x 4 where they hold more than 200 vertices, twice at most; dense ones stay whole then, none is left out."""
    return shards.adaptive_tiles(view(spark, sf_dir, "way_vertices"), 80_000, 200, 2)
