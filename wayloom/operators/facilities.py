"""Nearest facilities by travel time, tours as features, and travel by profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import routing, search
from .nearest import nearest_join
from .overlay import Overlay

# Metres a second by profile; a factor for what a profile's road class allows, 0 where it may not go.
SPEEDS = {"auto": 13.9, "bicycle": 4.2, "pedestrian": 1.4}
CLASSES = {
    "auto": {"trunk": 2.0, "primary": 1.5, "secondary": 1.2, "footway": 0.0},
    "bicycle": {"trunk": 0.0, "primary": 0.8, "footway": 0.5},
    "pedestrian": {"trunk": 0.0},
}


def speed(profile: str, highway: Column) -> Column:
    """Metres a second on a class of road; null where the profile may not go."""
    if profile not in SPEEDS:
        raise ValueError(f"profile must be one of {sorted(SPEEDS)}")
    factor = F.lit(1.0)
    for name, f in CLASSES[profile].items():
        factor = F.when(highway == name, f).otherwise(factor)
    return F.when(factor > 0, factor * SPEEDS[profile])


def nearest_node(points: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, node): the node (node, x_e7, y_e7) nearest each of points (key, x_e7, y_e7); ties: the smallest."""
    return nearest_join(points, nodes, 1, key).select(key, "node")


def nearest_facilities(places: DataFrame, nodes: DataFrame, edges: DataFrame, lon: float, lat: float, kind: str, limit: int = 5, radius_km: float = 5.0, overlay: Overlay | None = None) -> DataFrame:
    """(id, name, distance_m, seconds, minutes, node, rank): the `limit` places of a type soonest reached from (lon, lat).

    Candidates are the nearest within the radius by metres, more than asked for; each is reached over the road network
    from its nearest node; those that cannot be reached go. An overlay of the edges serves any number of calls.
    """
    near = search.nearest_places(places, lon, lat, kind, limit, radius_km)
    at = near.select("id").join(places.select("id", F.col("lon_e7").alias("x_e7"), F.col("lat_e7").alias("y_e7")), "id")
    start = edges.sparkSession.createDataFrame([(0, round(lon * 1e7), round(lat * 1e7))], "id long, x_e7 long, y_e7 long")
    stops = nearest_node(at, nodes, "id")
    source = nearest_node(start, nodes, "id").select("node")
    times = (overlay or Overlay.build(edges, nodes)).times(source, stops.select("node")).select(F.col("target").alias("node"), "seconds")
    ranked = search.rank_facilities(near, stops.join(times, "node").select("id", "seconds"), limit)
    out = ranked.join(stops, "id").orderBy("seconds", "distance_m", "id")
    rank = F.row_number().over(routing.W.orderBy("seconds", "distance_m", "id"))  # `limit` rows
    return out.withColumn("rank", rank.cast("long"))


def facility_routes(found: DataFrame, nodes: DataFrame, edges: DataFrame, lon: float, lat: float, overlay: Overlay | None = None) -> DataFrame:
    """(request, step, node, seconds): the way to each found facility; request is its id."""
    start = edges.sparkSession.createDataFrame([(0, round(lon * 1e7), round(lat * 1e7))], "id long, x_e7 long, y_e7 long")
    source = nearest_node(start, nodes, "id").select(F.col("node").alias("source"))
    asked = found.select(F.col("id").alias("request"), F.col("node").alias("target")).crossJoin(F.broadcast(source))  # one row
    return (overlay or Overlay.build(edges, nodes)).routes(asked.select("request", "source", "target"))


def legs(visits: DataFrame) -> DataFrame:
    """(request, leg, a, b, colour): the legs between the stops of tours (request, visit, stop), coloured in turn."""
    after = F.lead("stop").over(routing.W.partitionBy("request").orderBy("visit"))
    each = visits.select("request", F.col("visit").alias("leg"), F.col("stop").alias("a"), after.alias("b")).where("b IS NOT NULL")
    return each.withColumn("colour", (F.col("leg") % 8).cast("long"))
