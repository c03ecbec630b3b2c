"""Queries on binary geometries: decoding, repair, what is lost, types; noded pieces with the street they lie on longest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wkb
from ..operators import geometries, lines, noding, streets as tags, topology as topo
from .net_queries import _LINES, _NODED, _TAGS, GRID, _segments, _spread
from .registry import V, query
from .views import view

#: Ways as features of three points a part: every eleventh point is not a number, every fifth stands twice.
_BAD, _TWICE = "(way_id + seq) % 11 = 0", "(way_id * seq) % 5 = 0"
#: No geometry, bytes that end too early, a point in place of lines.
_NONE, _SHORT, _POINT = "way_id % 13 = 0", "way_id % 17 = 0", "way_id % 19 = 0"


def _features(spark, sf_dir):
    v = view(spark, sf_dir, "way_vertices").withColumn("part", F.floor((F.col("seq") - 1) / 3))
    twice = v.withColumn("copy", F.explode(F.expr(f"sequence(1, if({_TWICE}, 2, 1))")))
    lon = F.when(F.expr(_BAD), F.lit(float("nan"))).otherwise(F.col("x_e7") / 1e7)
    order = F.array_sort(F.collect_list(F.struct("seq", "copy", lon.alias("lon"), (F.col("y_e7") / 1e7).alias("lat"))))
    one = twice.groupBy("way_id", "part").agg(F.transform(order, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))
    parts = one.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda p: p["line"]).alias("parts"))
    whole = parts.select("way_id", wkb.from_parts("parts").alias("geometry"))
    point = F.unhex(F.lit("0101000000" + "00" * 16))
    geometry = F.when(F.expr(_NONE), F.lit(None)).when(F.expr(_SHORT), F.expr("substring(geometry, 1, octet_length(geometry) - 3)")).when(F.expr(_POINT), point).otherwise(F.col("geometry"))
    return whole.select("way_id", geometry.alias("geometry"))


_FEATURES = f"""WITH v AS (SELECT *, CAST(floor((seq - 1) / 3.0) AS BIGINT) AS part FROM {V} w), whole AS (SELECT * FROM v WHERE NOT ({_NONE} OR {_SHORT} OR {_POINT})),
 p AS (SELECT way_id, part, seq, x_e7, y_e7, lag(x_e7) OVER w AS px, lag(y_e7) OVER w AS py FROM whole WHERE NOT {_BAD} WINDOW w AS (PARTITION BY way_id, part ORDER BY seq)),
 k AS (SELECT way_id, part, x_e7, y_e7, row_number() OVER w - 1 AS no, count(*) OVER (PARTITION BY way_id, part) AS n FROM p WHERE px IS NULL OR px <> x_e7 OR py <> y_e7 WINDOW w AS (PARTITION BY way_id, part ORDER BY seq))"""


@query(f"{_FEATURES} SELECT way_id, CAST(part AS INT) AS part, CAST(no AS INT) AS no, x_e7, y_e7 FROM k WHERE n >= 2")
def geometry_parts(spark, sf_dir):
    """Binary geometries read, taken apart, repaired; parts with fewer than two points left, broken, null and others are gone."""
    at = F.posexplode("line").alias("no", "p")
    points = geometries.clean_parts(_features(spark, sf_dir), "geometry").select("way_id", "part", at)
    whole = lambda c: F.round(F.col(f"p.{c}") * 1e7).cast("long")
    return points.select("way_id", "part", "no", whole("lon").alias("x_e7"), whole("lat").alias("y_e7"))


@query(f"""{_FEATURES}, r AS (SELECT way_id FROM v GROUP BY way_id), n AS (SELECT count(DISTINCT (way_id, part)) AS parts FROM whole), g AS (SELECT count(DISTINCT (way_id, part)) AS kept FROM k WHERE n >= 2)
 SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_NONE}) AS n_null, count(*) FILTER (WHERE NOT {_NONE} AND ({_SHORT} OR {_POINT})) AS n_unread, any_value(parts) AS n_parts, any_value(parts - kept) AS n_short, any_value(kept) AS n_kept FROM r, n, g""")
def geometry_losses(spark, sf_dir):
    """What is lost on the way from binary geometries to usable lines."""
    return geometries.losses(_features(spark, sf_dir), "geometry")


@query(f"WITH r AS (SELECT way_id, max(seq) AS points FROM {V} w GROUP BY way_id) SELECT CASE WHEN {_NONE} THEN NULL WHEN {_POINT} AND NOT {_SHORT} THEN 'point' WHEN points <= 3 THEN 'line' ELSE 'multiline' END AS geometry_type, count(*) AS n FROM r GROUP BY 1")
def geometry_types(spark, sf_dir):
    """Geometries by the type in their headers."""
    return geometries.type_counts(_features(spark, sf_dir), "geometry")


_SX, _SY = "(s.bx - s.ax)", "(s.by - s.ay)"
_P = {k: (f"(p.{k}x - s.ax)", f"(p.{k}y - s.ay)") for k in "ab"}
_ALONG = [f"({x} * {_SX} + {y} * {_SY})" for x, y in _P.values()]
_FULL = f"({_SX} * {_SX} + {_SY} * {_SY})"
_BOXES = " AND ".join(f"least(p.a{c}, p.b{c}) <= greatest(s.a{c}, s.b{c}) AND least(s.a{c}, s.b{c}) <= greatest(p.a{c}, p.b{c})" for c in "xy")
_HELD = f"""{_NODED}{_LINES}, pc AS MATERIALIZED {_spread('lines')},
 o AS (SELECT DISTINCT p.ax, p.ay, p.bx, p.by, s.way_id AS src, round(greatest(0, least(greatest({_ALONG[0]}, {_ALONG[1]}), {_FULL}) - greatest(least({_ALONG[0]}, {_ALONG[1]}), 0)) / sqrt(CAST({_FULL} AS DOUBLE)), 3) AS overlap
  FROM pc p JOIN cells s ON p.tx = s.tx AND p.ty = s.ty AND {_BOXES} WHERE {' AND '.join(f'{x} * {_SY} - {y} * {_SX} = 0' for x, y in _P.values())}),
 held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ax, ay, bx, by ORDER BY overlap DESC, src) AS rn FROM o WHERE overlap > 0) q WHERE rn = 1)"""


@query(f"{_HELD} SELECT l.ax, l.ay, l.bx, l.by, src, overlap, name, highway, oneway, maxspeed FROM lines l LEFT JOIN held h ON l.ax = h.ax AND l.ay = h.ay AND l.bx = h.bx AND l.by = h.by LEFT JOIN ({_TAGS}) s ON src = orig_id")
def reattached_streets(spark, sf_dir):
    """Each noded piece with the attributes of the street that it lies on longest; a piece that rounding moved off all streets has none."""
    segs, tree = _segments(spark, sf_dir)
    pieces = noding.unique_pieces(noding.noded(segs, GRID, tree, again=False)).select("ax", "ay", "bx", "by")
    keyed = pieces.select(F.struct("ax", "ay", "bx", "by").alias("way_id"), F.lit(0).alias("seq_a"), "ax", "ay", "bx", "by")
    best = lines.best_overlap(keyed, noding.on_grid(segs, GRID)).select("piece_way.*", "src", "overlap")
    streets = tags.with_defaults(tags.ingest(view(spark, sf_dir, "streets"))).select(F.col("orig_id").alias("src"), "name", "highway", "oneway", "maxspeed")
    return pieces.join(best, ["ax", "ay", "bx", "by"], "left").join(streets, "src", "left").select("ax", "ay", "bx", "by", "src", "overlap", "name", "highway", "oneway", "maxspeed")
