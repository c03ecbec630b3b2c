"""Every query by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geo
from ..operators import areas, routing, search, streets as tags, topology as topo
from ..operators.components import connected_components
from ..sources import osm
from .staging import staged
from .views import sql, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if text:
            SQL[name or f.__name__] = re.sub(r"\bby\b", '"by"', text)  # the column; the keyword is in capitals
        return f

    return add


def base(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


V, STREETS, PLACES, ROADS = sql("way_vertices"), sql("streets"), sql("places"), sql("road_edges")

# --- street attributes ----------------------------------------------------------------------------------------------

_SHORT = "CASE WHEN FOW IN (3, 4) THEN CASE Subtype WHEN 1 THEN 'trunk_link' WHEN 2 THEN 'primary_link' WHEN 3 THEN 'secondary_link' ELSE 'tertiary_link' END ELSE CASE Subtype WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' ELSE 'road' END END"
_FULL = "CASE WHEN FOW IN (3, 4) THEN CASE Subtype WHEN 1 THEN 'trunk_link' WHEN 2 THEN 'primary_link' WHEN 3 THEN 'secondary_link' ELSE 'tertiary_link' END ELSE CASE WHEN Subtype = 1 THEN 'trunk' WHEN Subtype = 2 THEN 'primary' WHEN Subtype = 3 THEN CASE WHEN NoOfLane > 3 THEN 'primary' ELSE 'secondary' END WHEN Subtype = 4 THEN CASE WHEN NoOfLane > 3 THEN 'secondary' ELSE 'tertiary' END WHEN Subtype = 5 THEN 'tertiary' WHEN Subtype = 6 THEN 'residential' WHEN Subtype = 7 THEN 'footway' ELSE 'road' END END"
_INGEST = f"SELECT pkStreetID AS orig_id, EnglishName AS name, CASE WHEN Direction = 1 THEN 'yes' ELSE 'no' END AS oneway, CASE WHEN NoOfLane IS NULL OR NoOfLane <= 0 THEN '1' ELSE CAST(NoOfLane AS VARCHAR) END AS lanes, CASE WHEN CAST(round(SpeedLimit) AS INT) > 0 THEN CAST(SpeedLimit AS VARCHAR) END AS maxspeed, {_SHORT} AS highway FROM {STREETS} s"


@query(f"{_INGEST} WHERE fkEmirateID = 4")
def ingest_streets(spark, sf_dir):
    return tags.ingest(view(spark, sf_dir, "streets"), region=4)


_NAMES = 'pkStreetID AS id, ArabicName AS "name:ar", EnglishName AS name, Strar AS "name:ar1", Stren AS "name:en1", Width AS width'
_STATUS = "CASE WHEN FOW = 1 THEN 'roundabout' END AS junction, CASE WHEN StreetStat = 3 THEN 'no' ELSE 'yes' END AS access, CASE StreetStat WHEN 2 THEN 'gravel' WHEN 3 THEN 'dirt' ELSE 'asphalt' END AS surface"


@query(f"SELECT {_NAMES}, CAST(coalesce(NoOfLane, 1) AS VARCHAR) AS lanes, CAST(SpeedLimit AS VARCHAR) AS maxspeed, CASE WHEN Direction = 1 THEN 'yes' ELSE 'no' END AS oneway, {_STATUS}, {_FULL} AS highway FROM {STREETS} s")
def street_tags_full(spark, sf_dir):
    return tags.full_tags(view(spark, sf_dir, "streets"))


_TEXTS = f"SELECT pkStreetID, ArabicName, EnglishName, Strar, Stren, Width, CAST(Direction AS VARCHAR) AS Direction, CASE WHEN pkStreetID % 11 = 0 THEN 'n/a' WHEN pkStreetID % 11 = 1 THEN '-0.5' WHEN pkStreetID % 11 = 2 THEN ' 4.9 ' ELSE CAST(NoOfLane AS VARCHAR) END AS NoOfLane, CASE WHEN pkStreetID % 17 = 0 THEN '-0.5' ELSE CAST(SpeedLimit AS VARCHAR) END AS SpeedLimit, CAST(FOW AS VARCHAR) AS FOW, CAST(Subtype AS VARCHAR) AS Subtype, CAST(StreetStat AS VARCHAR) AS StreetStat FROM {STREETS} s"
_INTS = "SELECT pkStreetID, ArabicName, EnglishName, Strar, Stren, Width, " + ", ".join(f"TRY_CAST(trunc(TRY_CAST(trim({c}) AS DOUBLE)) AS BIGINT) AS {c}" for c in ("Direction", "NoOfLane", "SpeedLimit", "FOW", "Subtype", "StreetStat"))


@query(f"SELECT {_NAMES}, CASE WHEN Direction = 1 THEN 'yes' ELSE 'no' END AS oneway, CASE WHEN NoOfLane IS NULL OR NoOfLane <= 0 THEN '1' ELSE CAST(NoOfLane AS VARCHAR) END AS lanes, CASE WHEN coalesce(SpeedLimit, 0) <> 0 THEN CAST(SpeedLimit AS VARCHAR) END AS maxspeed, {_STATUS}, {_FULL} AS highway FROM ({_INTS} FROM ({_TEXTS}) t) s")
def street_tags_safe_parse(spark, sf_dir):
    s = view(spark, sf_dir, "streets")
    for c in ("Direction", "NoOfLane", "SpeedLimit", "FOW", "Subtype", "StreetStat"):
        s = s.withColumn(c, F.col(c).cast("string"))
    odd = F.col("pkStreetID") % 11
    s = s.withColumn("NoOfLane", F.when(odd == 0, "n/a").when(odd == 1, "-0.5").when(odd == 2, " 4.9 ").otherwise(F.col("NoOfLane")))
    return tags.safe_tags(s.withColumn("SpeedLimit", F.when(F.col("pkStreetID") % 17 == 0, "-0.5").otherwise(F.col("SpeedLimit"))))


@query(f"SELECT orig_id, coalesce(name, 'unknown') AS name, coalesce(highway, 'road') AS highway, coalesce(oneway, 'no') AS oneway, coalesce(lanes, '1') AS lanes, maxspeed FROM (SELECT orig_id, CASE WHEN orig_id % 7 = 0 THEN NULL ELSE name END AS name, CASE WHEN orig_id % 5 = 0 THEN NULL ELSE highway END AS highway, oneway, lanes, maxspeed FROM ({_INGEST}) i) d")
def tag_defaults(spark, sf_dir):
    t = tags.ingest(view(spark, sf_dir, "streets"))
    holes = t.select("orig_id", F.when(F.col("orig_id") % 7 != 0, F.col("name")).alias("name"), F.when(F.col("orig_id") % 5 != 0, F.col("highway")).alias("highway"), "oneway", "lanes", "maxspeed")
    return tags.with_defaults(holes)


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_repeated FROM lineitem")
def duplicate_key_audit(spark, sf_dir):
    keys = base(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("n_repeated", F.col("n_rows") - F.col("n_keys"))


@query(f"SELECT count(*) AS n_ways, count(*) FILTER (WHERE n < 2) AS too_few, count(*) FILTER (WHERE n > 10000) AS too_many, count(*) FILTER (WHERE n BETWEEN 2 AND 10000) AS kept FROM (SELECT way_id, count(*) AS n FROM {V} v GROUP BY way_id) w")
def drop_counters(spark, sf_dir):
    w = view(spark, sf_dir, "way_vertices").groupBy("way_id").agg(F.count("*").alias("n"))
    return w.agg(F.count("*").alias("n_ways"), F.count_if(F.col("n") < 2).alias("too_few"), F.count_if(F.col("n") > 10_000).alias("too_many"), F.count_if(F.col("n").between(2, 10_000)).alias("kept"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_histogram(spark, sf_dir):
    return base(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, CAST(i - 1 AS BIGINT) AS part, keys[i] AS o_orderkey FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey) t, LATERAL (SELECT unnest(range(1, len(keys) + 1)) AS i) u")
def explode_multiparts(spark, sf_dir):
    # Numbered in sorted order, so that no list is as long as a customer's orders.
    part = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return base(spark, sf_dir, "orders").select("o_custkey", part.cast("long").alias("part"), "o_orderkey")


# --- graph -----------------------------------------------------------------------------------------------------------

_NODES = "SELECT -row_number() OVER (ORDER BY x_e7, y_e7) AS node_id, x_e7, y_e7 FROM (SELECT DISTINCT x_e7, y_e7 FROM v) d"
_WN = f"WITH RECURSIVE v AS {V}, nodes AS ({_NODES}), wn AS (SELECT way_id, seq, node_id FROM v JOIN nodes USING (x_e7, y_e7))"
_ENDS = ", ends AS (SELECT way_id, node_id FROM (SELECT *, min(seq) OVER (PARTITION BY way_id) AS mn, max(seq) OVER (PARTITION BY way_id) AS mx FROM wn) e WHERE seq = mn OR seq = mx), pos AS (SELECT DISTINCT node_id, x_e7, y_e7 FROM ends JOIN nodes USING (node_id))"
_DANGLES = ", dangles AS (SELECT node_id, min(way_id) AS way_id FROM ends GROUP BY node_id HAVING count(*) = 1)"
_D2 = "(a.x_e7 - b.x_e7) * (a.x_e7 - b.x_e7) + (a.y_e7 - b.y_e7) * (a.y_e7 - b.y_e7)"


def _pairs(tol: int, points: str = "pos") -> str:
    return f"SELECT a.node_id AS node_a, b.node_id AS node_b, {_D2} AS d2 FROM {points} a JOIN {points} b ON a.node_id < b.node_id AND b.x_e7 BETWEEN a.x_e7 - {tol} AND a.x_e7 + {tol} AND b.y_e7 BETWEEN a.y_e7 - {tol} AND a.y_e7 + {tol} WHERE {_D2} <= {tol * tol}"


_COMP = f", pairs AS ({_pairs(200)}), sym AS (SELECT node_a AS u, node_b AS w FROM pairs UNION SELECT node_b, node_a FROM pairs), reach AS (SELECT u AS node, u AS root FROM sym UNION SELECT sym.w, reach.root FROM reach JOIN sym ON sym.u = reach.node), comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"
_CLEAN = "SELECT r.way_id, r.seq, r.node_id FROM (SELECT * FROM (SELECT *, lag(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS pv FROM {src}) l WHERE pv IS NULL OR pv <> node_id) r WHERE way_id NOT IN (SELECT way_id FROM (SELECT * FROM (SELECT *, lag(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS pv FROM {src}) l WHERE pv IS NULL OR pv <> node_id) q GROUP BY way_id HAVING count(*) < 2 OR count(DISTINCT node_id) < 2 OR (arg_min(node_id, seq) = arg_max(node_id, seq) AND count(*) = 2))"


def _graph(spark, sf_dir):
    """Vertices, nodes and references, written out: most steps read them more than once."""
    v = staged(view(spark, sf_dir, "way_vertices"), "vertices")
    nodes = staged(topo.extract_nodes(v), "nodes")
    return v, nodes, staged(topo.way_nodes(v, nodes), "refs")


@query(f"WITH v AS {V} {_NODES}")
def extract_nodes(spark, sf_dir):
    return topo.extract_nodes(view(spark, sf_dir, "way_vertices"))


@query(f"{_WN} SELECT * FROM wn")
def way_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[2]


@query(f"{_WN} SELECT count(*) AS n_refs, count(DISTINCT node_id) AS n_nodes, round(100.0 * (count(*) - count(DISTINCT node_id)) / count(*), 4) AS shared_percent FROM wn")
def shared_vertex_pct(spark, sf_dir):
    v = view(spark, sf_dir, "way_vertices").groupBy("x_e7", "y_e7").agg(F.count("*").alias("n"))
    return v.agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_nodes")).withColumn("shared_percent", F.round(100.0 * (F.col("n_refs") - F.col("n_nodes")) / F.col("n_refs"), 4))


@query(f"{_WN} SELECT way_id, count(*) AS n, count(DISTINCT node_id) AS nd, arg_min(node_id, seq) AS first_node, arg_max(node_id, seq) AS last_node FROM wn GROUP BY way_id")
def way_endpoints(spark, sf_dir):
    return topo.way_stats(_graph(spark, sf_dir)[2])


def _coarse(spark, sf_dir):
    """References of orders to suppliers: they repeat, so there is something to clean."""
    v = view(spark, sf_dir, "way_vertices")
    return v.select("way_id", "seq", F.floor(F.col("x_e7") / 2000).cast("long").alias("node_id"))


_CW = f"WITH v AS {V}, cw AS (SELECT way_id, seq, CAST(floor(x_e7 / 2000) AS BIGINT) AS node_id FROM v)"


@query(f"{_CW} SELECT way_id, seq, node_id FROM (SELECT *, lag(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS pv FROM cw) l WHERE pv IS NULL OR pv <> node_id")
def dedup_consecutive(spark, sf_dir):
    return topo.dedup_consecutive(_coarse(spark, sf_dir))


@query(f"{_CW} SELECT way_id FROM cw GROUP BY way_id HAVING count(*) < 2 OR count(DISTINCT node_id) < 2 OR (arg_min(node_id, seq) = arg_max(node_id, seq) AND count(*) = 2)")
def degenerate_ways(spark, sf_dir):
    return topo.degenerate_ways(_coarse(spark, sf_dir))


@query(f"{_CW} SELECT way_id FROM cw GROUP BY way_id HAVING count(*) < 2 OR count(DISTINCT node_id) < 2 OR arg_min(node_id, seq) = arg_max(node_id, seq)")
def degenerate_ways_closed(spark, sf_dir):
    return topo.degenerate_ways(_coarse(spark, sf_dir), drop_closed=True)


@query(f"{_CW} " + _CLEAN.format(src="cw"))
def clean_way_nodes(spark, sf_dir):
    return topo.clean_way_nodes(_coarse(spark, sf_dir))


@query(f"{_WN}{_ENDS}{_DANGLES} SELECT node_id, way_id FROM dangles")
def dangling_endpoints(spark, sf_dir):
    return topo.dangling(_graph(spark, sf_dir)[2])


def _ends(spark, sf_dir):
    _, nodes, wn = _graph(spark, sf_dir)
    return topo.endpoints(wn).join(nodes, "node_id"), nodes, wn


@query(f"{_WN}{_ENDS} {_pairs(200)}")
def endpoint_pairs_tight(spark, sf_dir):
    return topo.near_pairs(_ends(spark, sf_dir)[0], 200)


@query(f"{_WN}{_ENDS}{_DANGLES}, dpos AS (SELECT * FROM pos WHERE node_id IN (SELECT node_id FROM dangles)) {_pairs(500, 'dpos')}")
def endpoint_pairs_wide(spark, sf_dir):
    ends, _, wn = _ends(spark, sf_dir)
    return topo.near_pairs(ends.join(topo.dangling(wn).select("node_id"), "node_id", "left_semi"), 500)


@query(f"{_WN}{_ENDS}{_COMP} SELECT node, component FROM comp")
def components(spark, sf_dir):
    return connected_components(topo.near_pairs(_ends(spark, sf_dir)[0], 200), "node_a", "node_b")


@query(f"{_WN}{_ENDS}{_COMP} SELECT way_id, seq, coalesce(component, node_id) AS node_id FROM wn LEFT JOIN comp ON node_id = node")
def apply_labels(spark, sf_dir):
    ends, _, wn = _ends(spark, sf_dir)
    return topo.relabel(wn, connected_components(topo.near_pairs(ends, 200), "node_a", "node_b"))


@query(f"{_WN}{_ENDS}{_COMP}, lw AS (SELECT way_id, seq, coalesce(component, node_id) AS node_id FROM wn LEFT JOIN comp ON node_id = node) " + _CLEAN.format(src="lw"))
def snap_tight(spark, sf_dir):
    ends, _, wn = _ends(spark, sf_dir)
    return topo.clean_way_nodes(topo.relabel(wn, connected_components(topo.near_pairs(ends, 200), "node_a", "node_b")))


@query()
def snap_node_to_node(spark, sf_dir):
    _, nodes, wn = _graph(spark, sf_dir)
    return topo.snap_node_to_node(wn, nodes)


@query(f"{_WN}{_ENDS}{_DANGLES} SELECT node_a, node_b, d2 FROM (SELECT node_a, node_b, d2, row_number() OVER (PARTITION BY node_a ORDER BY d2, node_b) AS rn FROM (SELECT a.node_id AS node_a, b.node_id AS node_b, {_D2} AS d2 FROM (SELECT * FROM pos WHERE node_id IN (SELECT node_id FROM dangles)) a JOIN pos b ON a.node_id <> b.node_id AND b.x_e7 BETWEEN a.x_e7 - 200 AND a.x_e7 + 200 AND b.y_e7 BETWEEN a.y_e7 - 200 AND a.y_e7 + 200) p WHERE d2 <= 40000) r WHERE rn = 1")
def nearest_endpoint(spark, sf_dir):
    ends, nodes, wn = _ends(spark, sf_dir)
    return topo.nearest_endpoint(topo.dangling(wn).join(nodes, "node_id"), ends, 200)


_SEGS = "SELECT way_id, seq AS seq_a, x_e7 AS ax, y_e7 AS ay, bx, by FROM (SELECT *, lead(x_e7) OVER (PARTITION BY way_id ORDER BY seq) AS bx, lead(y_e7) OVER (PARTITION BY way_id ORDER BY seq) AS by FROM v) s WHERE bx IS NOT NULL"


@query(f"WITH v AS {V} {_SEGS}")
def segments_index(spark, sf_dir):
    return topo.segments(view(spark, sf_dir, "way_vertices"))


_FEET = f"""{_WN}{_ENDS}{_DANGLES}, segs AS ({_SEGS}), dp AS (SELECT d.node_id, d.way_id AS own_way, x_e7 AS px, y_e7 AS py FROM dangles d JOIN nodes USING (node_id)),
 t1 AS (SELECT node_id, way_id, seq_a, px, py, ax, ay, bx - ax AS dx, by - ay AS dy, CAST((px - ax) * (bx - ax) + (py - ay) * (by - ay) AS DOUBLE) / nullif(CAST((bx - ax) * (bx - ax) + (by - ay) * (by - ay) AS DOUBLE), 0) AS t
   FROM dp JOIN segs ON own_way <> way_id AND px BETWEEN least(ax, bx) - 500 AND greatest(ax, bx) + 500 AND py BETWEEN least(ay, by) - 500 AND greatest(ay, by) + 500),
 t2 AS (SELECT *, ax + t * dx AS qx, ay + t * dy AS qy FROM t1 WHERE t BETWEEN 0.001 AND 0.999),
 t3 AS (SELECT *, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) AS dist FROM t2),
 feet AS (SELECT node_id, way_id, seq_a, round(t, 6) AS t, round(dist, 6) AS dist, CAST(floor(qx + 0.5) AS BIGINT) AS x_e7, CAST(floor(qy + 0.5) AS BIGINT) AS y_e7 FROM t3 WHERE dist <= 500),
 best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY dist, way_id, seq_a) AS rn FROM feet) b WHERE rn = 1)"""


def _feet(spark, sf_dir):
    v, nodes, wn = _graph(spark, sf_dir)
    return v, topo.project(topo.dangling(wn).join(nodes, "node_id"), topo.segments(v))


@query(f"{_FEET} SELECT * FROM feet")
def project_to_segments(spark, sf_dir):
    return _feet(spark, sf_dir)[1]


@query(f"{_FEET} SELECT * FROM best")
def best_projection(spark, sf_dir):
    return topo.best_projection(_feet(spark, sf_dir)[1])


@query(f"{_FEET} SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY s, t, x_e7, y_e7) AS seq, x_e7, y_e7 FROM (SELECT way_id, seq AS s, 0.0::DOUBLE AS t, x_e7, y_e7 FROM v UNION ALL SELECT way_id, seq_a, min(t), x_e7, y_e7 FROM best GROUP BY way_id, seq_a, x_e7, y_e7) u")
def inject_vertices(spark, sf_dir):
    v, feet = _feet(spark, sf_dir)
    return topo.inject(v, topo.best_projection(feet))


_GAPS = f"{_WN}{_ENDS}, ep AS (SELECT way_id, node_id, x_e7, y_e7 FROM ends JOIN nodes USING (node_id)), gaps AS (SELECT a.way_id AS way_a, b.way_id AS way_b, a.node_id AS node_a, b.node_id AS node_b, {_D2} AS d2 FROM ep a JOIN ep b ON a.way_id <> b.way_id AND a.node_id <> b.node_id AND b.x_e7 BETWEEN a.x_e7 - 499 AND a.x_e7 + 499 AND b.y_e7 BETWEEN a.y_e7 - 499 AND a.y_e7 + 499)"


@query(f"{_GAPS} SELECT * FROM gaps")
def gap_pairs(spark, sf_dir):
    return topo.gap_pairs(_ends(spark, sf_dir)[0])


@query(f"{_GAPS} SELECT count(*) AS n, round(min(sqrt(d2)), 6) AS min_dist, round(avg(sqrt(d2)), 6) AS avg_dist, round(quantile_cont(sqrt(d2), 0.5), 6) AS p50, round(quantile_cont(sqrt(d2), 0.95), 6) AS p95, round(max(sqrt(d2)), 6) AS max_dist FROM gaps")
def gap_stats(spark, sf_dir):
    d = topo.gap_pairs(_ends(spark, sf_dir)[0]).select(F.sqrt("d2").alias("d"))
    r = lambda c: F.round(c, 6)
    return d.agg(F.count("*").alias("n"), r(F.min("d")).alias("min_dist"), r(F.avg("d")).alias("avg_dist"), r(F.percentile("d", 0.5)).alias("p50"), r(F.percentile("d", 0.95)).alias("p95"), r(F.max("d")).alias("max_dist"))


@query(f"{_GAPS} SELECT * FROM gaps ORDER BY d2 DESC, way_a, way_b, node_a, node_b LIMIT 100")
def gap_top(spark, sf_dir):
    return topo.gap_pairs(_ends(spark, sf_dir)[0]).orderBy(F.desc("d2"), "way_a", "way_b", "node_a", "node_b").limit(100)


@query(f"{_GAPS} SELECT node_a AS node_id FROM gaps UNION SELECT node_b FROM gaps")
def gap_points(spark, sf_dir):
    g = topo.gap_pairs(_ends(spark, sf_dir)[0])
    return g.select(F.col("node_a").alias("node_id")).union(g.select("node_b")).distinct()


@query(f"{_GAPS}, reach AS (SELECT node_a AS node, node_a AS root FROM gaps UNION SELECT g.node_b, r.root FROM reach r JOIN gaps g ON g.node_a = r.node), lab AS (SELECT node, min(root) AS component FROM reach GROUP BY node), lw AS (SELECT way_id, seq, coalesce(component, node_id) AS node_id FROM wn LEFT JOIN lab ON node_id = node) " + _CLEAN.format(src="lw"))
def boundary_fix(spark, sf_dir):
    _, nodes, wn = _graph(spark, sf_dir)
    return topo.boundary_fix(wn, nodes)[0]


# --- areas -----------------------------------------------------------------------------------------------------------

_BOX = f"WITH v AS {V}, b AS (SELECT min(x_e7) AS x0, min(y_e7) AS y0, max(x_e7) AS x1, max(y_e7) AS y1 FROM v), bx AS (SELECT way_id, min(x_e7) AS bx0, min(y_e7) AS by0, max(x_e7) AS bx1, max(y_e7) AS by1 FROM v GROUP BY way_id)"


@query(f"{_BOX}, g AS (SELECT *, CAST(floor((x1 - x0) / 5.0) + 1 AS BIGINT) AS w, CAST(floor((y1 - y0) / 4.0) + 1 AS BIGINT) AS h FROM b), o AS (SELECT *, CAST(floor(w * 15 / 100.0) AS BIGINT) AS ow, CAST(floor(h * 15 / 100.0) AS BIGINT) AS oh FROM g), c AS (SELECT r.i AS shard_row, k.i AS shard_col FROM range(4) r(i), range(5) k(i)) SELECT way_id, shard_row, shard_col, shard_row = greatest(0, least(3, CAST(floor((floor((by0 + by1) / 2.0) - y0) / h) AS BIGINT))) AND shard_col = greatest(0, least(4, CAST(floor((floor((bx0 + bx1) / 2.0) - x0) / w) AS BIGINT))) AS is_core FROM bx, o, c WHERE shard_row BETWEEN greatest(0, least(3, floor((by0 - oh - y0) / (h * 1.0)))) AND greatest(0, least(3, floor((by1 + oh - y0) / (h * 1.0)))) AND shard_col BETWEEN greatest(0, least(4, floor((bx0 - ow - x0) / (w * 1.0)))) AND greatest(0, least(4, floor((bx1 + ow - x0) / (w * 1.0))))")
def shard_assign(spark, sf_dir):
    return areas.shard_assign(view(spark, sf_dir, "way_vertices"), 4, 5)


@query(f"SELECT DISTINCT CAST(floor(x_e7 / 20000.0) AS BIGINT) AS cx, CAST(floor(y_e7 / 20000.0) AS BIGINT) AS cy FROM {V} v")
def occupied_tiles(spark, sf_dir):
    return areas.occupied(view(spark, sf_dir, "way_vertices"), 20_000)


_CROSS = f"""WITH v AS {V}, segs AS ({_SEGS}), m AS (SELECT a.way_id AS way_a, a.seq_a AS seq_a, b.way_id AS way_b, b.seq_a AS seq_b, a.ax AS px, a.ay AS py, a.bx - a.ax AS rx, a.by - a.ay AS ry, b.ax AS qx, b.ay AS qy, b.bx - b.ax AS sx, b.by - b.ay AS sy
 FROM (SELECT *, unnest(range(CAST(floor(least(ay, by) / 20000.0) AS BIGINT), CAST(floor(greatest(ay, by) / 20000.0) AS BIGINT) + 1)) AS band FROM segs) a JOIN (SELECT *, unnest(range(CAST(floor(least(ay, by) / 20000.0) AS BIGINT), CAST(floor(greatest(ay, by) / 20000.0) AS BIGINT) + 1)) AS band FROM segs) b
 ON a.band = b.band AND a.way_id < b.way_id AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) AND least(b.ax, b.bx) <= greatest(a.ax, a.bx) AND least(a.ay, a.by) <= greatest(b.ay, b.by) AND least(b.ay, b.by) <= greatest(a.ay, a.by)),
 d AS (SELECT DISTINCT * FROM (SELECT *, rx * sy - ry * sx AS den FROM m) z WHERE den <> 0), h AS (SELECT *, CAST((qx - px) * sy - (qy - py) * sx AS DOUBLE) / den AS t, CAST((qx - px) * ry - (qy - py) * rx AS DOUBLE) / den AS u FROM d),
 x AS (SELECT way_a, seq_a, way_b, seq_b, CAST(floor(px + t * rx + 0.5) AS BIGINT) AS x, CAST(floor(py + t * ry + 0.5) AS BIGINT) AS y FROM h WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


@query(f"{_CROSS} SELECT * FROM x")
def tile_noding(spark, sf_dir):
    return areas.crossings(topo.segments(view(spark, sf_dir, "way_vertices")))


@query(f"{_CROSS}, cuts AS (SELECT DISTINCT * FROM (SELECT way_a AS way_id, seq_a, x, y FROM x UNION ALL SELECT way_b, seq_b, x, y FROM x) c), pts AS (SELECT way_id, seq_a, ax AS x, ay AS y, 0 AS k, 0 AS d FROM segs UNION ALL SELECT way_id, seq_a, bx, by, 2, 0 FROM segs UNION ALL SELECT c.way_id, c.seq_a, c.x, c.y, 1, (c.x - ax) * (c.x - ax) + (c.y - ay) * (c.y - ay) FROM cuts c JOIN segs s USING (way_id, seq_a) WHERE NOT (c.x = ax AND c.y = ay) AND NOT (c.x = bx AND c.y = by)) SELECT way_id, seq_a, piece, ax, ay, bx, by FROM (SELECT way_id, seq_a, row_number() OVER w - 1 AS piece, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM pts WINDOW w AS (PARTITION BY way_id, seq_a ORDER BY k, d, x, y)) p WHERE bx IS NOT NULL")
def noded_pieces(spark, sf_dir):
    return areas.node_segments(topo.segments(view(spark, sf_dir, "way_vertices")))


@query(f"WITH v AS {V}, k AS (SELECT way_id * 100 + seq AS node_id, x_e7, y_e7 FROM v) SELECT node_id, min(node_id) OVER (PARTITION BY x_e7, y_e7) AS kept_id FROM k")
def border_dedup(spark, sf_dir):
    k = view(spark, sf_dir, "way_vertices").select((F.col("way_id") * 100 + F.col("seq")).alias("node_id"), "x_e7", "y_e7")
    first = k.groupBy("x_e7", "y_e7").agg(F.min("node_id").alias("kept_id"))
    return k.join(first, ["x_e7", "y_e7"]).select("node_id", "kept_id")


_CELL = f"{_BOX}, cells AS (SELECT CAST(floor((floor((bx0 + bx1) / 2.0) - x0) / 10000.0) AS BIGINT) AS gc, CAST(floor((floor((by0 + by1) / 2.0) - y0) / 10000.0) AS BIGINT) AS gr, count(*) AS n_ways FROM bx, b GROUP BY 1, 2)"


@query(f"{_CELL} SELECT * FROM cells")
def coverage_grid(spark, sf_dir):
    return areas.coverage(view(spark, sf_dir, "way_vertices"), 10_000)


@query(f"{_CELL} SELECT n_cells, n_ways, n_all, round(100.0 * n_cells / n_all, 4) AS percent FROM (SELECT count(*) AS n_cells, CAST(sum(n_ways) AS BIGINT) AS n_ways, (SELECT CAST(greatest(ceil((x1 - x0) / 10000.0), 1) * greatest(ceil((y1 - y0) / 10000.0), 1) AS BIGINT) FROM b) AS n_all FROM cells) c")
def coverage_ratio(spark, sf_dir):
    return areas.coverage_ratio(view(spark, sf_dir, "way_vertices"), 10_000)


@query()
def hull(spark, sf_dir):
    return areas.hull(view(spark, sf_dir, "way_vertices"))


_PI_TILE = "SELECT id, CAST(floor((lon + 180.0) / 360.0 * 4096) AS BIGINT) AS x, CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096) AS BIGINT) AS y, CASE WHEN type IN ('hospital', 'clinic') THEN 'health_11' WHEN type = 'other' THEN 'dot_11' ELSE concat(type, '_11') END AS icon FROM (SELECT id, type, lon_e7 / 1e7 AS lon, lat_e7 / 1e7 AS lat"


@query(f"{_PI_TILE} FROM {PLACES} p) q")
def tile_keys(spark, sf_dir):
    p = view(spark, sf_dir, "places")
    x, y = areas.tile(F.col("lon_e7") / 1e7, F.col("lat_e7") / 1e7, 12)
    icon = F.when(F.col("type").isin("hospital", "clinic"), "health_11").when(F.col("type") == "other", "dot_11").otherwise(F.concat("type", F.lit("_11")))
    return p.select("id", x.alias("x"), y.alias("y"), icon.alias("icon"))


# --- places, travel, search ------------------------------------------------------------------------------------------

_KM = "2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h))"
_NEAR = f"SELECT id, name, type, address, distance_m FROM (SELECT id, name, type, address, round({_KM} * 1000, 2) AS distance_m FROM (SELECT *, pow(sin(radians(lat - 24.7) / 2), 2) + cos(radians(24.7)) * cos(radians(lat)) * pow(sin(radians(lon - 46.7) / 2), 2) AS h FROM (SELECT *, lon_e7 / 1e7 AS lon, lat_e7 / 1e7 AS lat FROM {PLACES} p WHERE lower(type) = 'hospital') a) b) c WHERE distance_m <= 20000 ORDER BY distance_m, id LIMIT 15"


@query(_NEAR)
def nearest_places(spark, sf_dir):
    return search.nearest_places(view(spark, sf_dir, "places"), 46.7, 24.7, "Hospital ", 5, 20)


@query(f"WITH n AS ({_NEAR}) SELECT id, name, distance_m, id * 37 % 900 AS seconds, round(id * 37 % 900 / 60.0, 1) AS minutes FROM n WHERE id % 4 <> 0 ORDER BY seconds, distance_m, id LIMIT 5")
def facility_rank(spark, sf_dir):
    near = nearest_places(spark, sf_dir)
    times = near.select("id", F.when(F.col("id") % 4 != 0, F.col("id") * 37 % 900).alias("seconds"))
    return search.rank_facilities(near, times, 5)


_REACH = f"WITH RECURSIVE e AS {ROADS}, r AS (SELECT s AS source, s AS node, 0::BIGINT AS seconds FROM (VALUES (1::BIGINT), (121::BIGINT)) z(s) UNION SELECT r.source, e.dst, r.seconds + e.seconds FROM r JOIN e ON e.src = r.node WHERE r.seconds + e.seconds <= 30), best AS (SELECT source, node, min(seconds) AS seconds FROM r GROUP BY source, node)"


def _sources(spark):
    return spark.createDataFrame([(1,), (121,)], "node long")


@query(f"{_REACH} SELECT s AS source, t AS target, seconds FROM (VALUES (1::BIGINT), (121::BIGINT)) z(s) CROSS JOIN (SELECT unnest(range(1, 200, 9)) AS t) y LEFT JOIN best ON source = s AND node = t")
def travel_matrix_within(spark, sf_dir):
    """The travel times of at most 30 seconds: a limit that is asked for, and that lets the SQL end."""
    targets = spark.range(1, 200, 9).select(F.col("id").alias("node"))
    return routing.matrix(view(spark, sf_dir, "road_edges"), _sources(spark), targets, limit=30)


@query()
def travel_matrix(spark, sf_dir):
    """Every travel time; without SQL, as a recursive query does not end in time. Tested against Dijkstra."""
    targets = spark.range(1, 200, 9).select(F.col("id").alias("node"))
    return routing.matrix(view(spark, sf_dir, "road_edges"), _sources(spark), targets, nodes=view(spark, sf_dir, "road_nodes"))


@query(f"{_REACH} SELECT source, node, seconds, greatest(1, CAST(ceil(seconds / 10.0) AS BIGINT)) AS contour FROM best")
def isochrone_nodes(spark, sf_dir):
    return routing.contours(view(spark, sf_dir, "road_edges"), _sources(spark), 10, 3)


@query()
def route_paths(spark, sf_dir):
    asked = spark.createDataFrame([(1, 1, 100), (2, 121, 190)], "request long, source long, target long")
    return routing.routes(view(spark, sf_dir, "road_edges"), asked, view(spark, sf_dir, "road_nodes"))


@query()
def stop_order(spark, sf_dir):
    # Every place is a stop: seven neighbours by id are one request, and the first is ids 1 to 7.
    p = view(spark, sf_dir, "places").select(F.floor((F.col("id") + 6) / 7).alias("request"), "id", F.col("lon_e7").alias("x"), F.col("lat_e7").alias("y"))
    a, b = p.select("request", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), p.select("request", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    costs = a.join(b, "request").where(F.col("a") != F.col("b")).select("request", "a", "b", F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)).alias("cost"))
    return routing.stop_orders(costs)


_DIGITS = "array_to_string(list_transform(list_filter(range(0, 60, 5), lambda k: k = 0 OR ({u} >> CAST(k AS INT)) > 0), lambda k: chr(CAST(63 + (({u} >> CAST(k AS INT)) & 31) + CASE WHEN ({u} >> CAST(k AS INT)) >= 32 THEN 32 ELSE 0 END AS INT))), '')"


@query(f"WITH d AS (SELECT way_id, seq, lat - lag(lat, 1, 0::BIGINT) OVER w AS dlat, lon - lag(lon, 1, 0::BIGINT) OVER w AS dlon FROM (SELECT way_id, seq, CAST(round(x_e7 / 1e7 * 1e6) AS BIGINT) AS lon, CAST(round(y_e7 / 1e7 * 1e6) AS BIGINT) AS lat FROM {V} v) p WINDOW w AS (PARTITION BY way_id ORDER BY seq)), u AS (SELECT way_id, seq, CASE WHEN dlat < 0 THEN -2 * dlat - 1 ELSE 2 * dlat END AS ulat, CASE WHEN dlon < 0 THEN -2 * dlon - 1 ELSE 2 * dlon END AS ulon FROM d) SELECT way_id, string_agg({_DIGITS.format(u='ulat')} || {_DIGITS.format(u='ulon')}, '' ORDER BY seq) AS polyline, true AS same_size FROM u GROUP BY way_id")
def polyline_roundtrip(spark, sf_dir):
    """Ways as encoded polylines, and whether decoding gives as many points."""
    lines = _lines(spark, sf_dir)
    return lines.withColumn("polyline", geo.line_to_polyline("line")).select("way_id", "polyline", (F.size(geo.polyline_to_line("polyline")) == F.size("line")).alias("same_size"))


def _lines(spark, sf_dir):
    v = view(spark, sf_dir, "way_vertices")
    pts = F.array_sort(F.collect_list(F.struct("seq", (F.col("x_e7") / 1e7).alias("lon"), (F.col("y_e7") / 1e7).alias("lat"))))
    return v.groupBy("way_id").agg(F.transform(pts, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


_TERMS = {"name": 3.0, "type": 1.0}
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^\\pL\\pN]+'), lambda w: w <> '')"
_GAIN = "CASE WHEN list_min(list_transform({w}, lambda x: levenshtein(x, '{t}'))) <= {k} THEN 1.0 - list_min(list_transform({w}, lambda x: levenshtein(x, '{t}'))) / {n} ELSE 0 END"


def _search_sql() -> str:
    terms = [("blu", 1, 4.0), ("widgit", 2, 7.0)]
    gain = " + ".join(_GAIN.format(w=_WORDS.format(f="p_name"), t=t, k=k, n=n) for t, k, n in terms)
    kind = " + ".join(_GAIN.format(w=_WORDS.format(f="p_type"), t=t, k=k, n=n) for t, k, n in terms)
    return f"SELECT p_partkey, score FROM (SELECT p_partkey, round(greatest(({gain}) * 1.5, ({kind}) * 0.5), 6) AS score FROM part) q WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20"


@query(_search_sql())
def fuzzy_search(spark, sf_dir):
    return search.fuzzy_search(base(spark, sf_dir, "part"), "p_partkey", {"p_name": 3.0, "p_type": 1.0}, "Blu widgit")


# --- extracts, sinks -------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, o_orderkey, c_name, o_orderstatus FROM customer FULL JOIN orders ON c_custkey = o_custkey")
def building_floors(spark, sf_dir):
    c, o = base(spark, sf_dir, "customer"), base(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "full").select("c_custkey", "o_orderkey", "c_name", "o_orderstatus")


@query("SELECT event_id, concat('{', CAST(user_id AS VARCHAR), '}') AS user_ref, epoch_ms(ts) AS datestamp, CAST(value AS DOUBLE) AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def typed_extract(spark, sf_dir):
    e = base(spark, sf_dir, "events")
    millis = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + 500) / 1000).cast("long")  # to the nearest
    return e.select("event_id", F.concat(F.lit("{"), F.col("user_id").cast("string"), F.lit("}")).alias("user_ref"), millis.alias("datestamp"), F.col("value").cast("double").alias("value"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query()
def ring_fit(spark, sf_dir):
    from ..operators.rings import regular_ring

    v = view(spark, sf_dir, "way_vertices").select("way_id", F.col("x_e7").alias("x"), F.col("y_e7").alias("y"))
    return regular_ring(v, "way_id")


@query(f"{_WN} SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY seq) AS refs, count(*) AS n FROM wn GROUP BY way_id HAVING count(*) >= 2")
def osm_way_rows(spark, sf_dir):
    return osm.way_refs(_graph(spark, sf_dir)[2])


def _xml_sql() -> str:
    def tag(k: str) -> str:
        text = k
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = f"replace({text}, '{a}', '{b}')"
        return f"""CASE WHEN trim({k}) <> '' THEN '<tag k="{k}" v="' || {text} || '"/>' ELSE '' END"""

    at = lambda c: f"printf('%.7f', {c} / 1e7)"
    streets = f"SELECT orig_id, coalesce(name, 'unknown') AS name, coalesce(highway, 'road') AS highway, oneway, coalesce(lanes, '1') AS lanes, maxspeed FROM ({_INGEST}) i"
    return f"""{_WN}, w AS (SELECT way_id, string_agg('<nd ref="' || node_id || '"/>', '' ORDER BY seq) AS nds FROM wn GROUP BY way_id HAVING count(*) >= 2), t AS ({streets})
 SELECT 0 AS kind, node_id AS id, '<node id="' || node_id || '" lat="' || {at('y_e7')} || '" lon="' || {at('x_e7')} || '" version="1"/>' AS line FROM nodes
 UNION ALL SELECT 1, way_id, '<way id="' || way_id || '" version="1">' || nds || {' || '.join(map(tag, osm.TAGS))} || '</way>' FROM w LEFT JOIN t ON way_id = orig_id"""


@query(_xml_sql())
def osm_xml(spark, sf_dir):
    """Nodes and ways with the tags of their streets as map XML."""
    _, nodes, wn = _graph(spark, sf_dir)
    t = tags.with_defaults(tags.ingest(view(spark, sf_dir, "streets"))).withColumnRenamed("orig_id", "way_id")
    return osm.xml_lines(nodes, wn, t)


@query("SELECT '{\"type\":\"Feature\",\"properties\":{\"id\":' || id || ',\"name\":' || to_json(name) || ',\"type\":' || to_json(type) || ',\"address\":' || to_json(address) || '},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || CAST(lon_e7 / 1e7 AS VARCHAR) || ',' || CAST(lat_e7 / 1e7 AS VARCHAR) || ']}}' AS feature FROM " + f"{PLACES} p")
def geojson_rows(spark, sf_dir):
    """Places as GeoJSON points."""
    return osm.point_features(view(spark, sf_dir, "places"), "lon_e7", "lat_e7", ["id", "name", "type", "address"])


from . import fleet_queries, geometry_queries, graph_queries, map_queries, net_queries, style_queries  # noqa: E402, F401  they register their queries here
