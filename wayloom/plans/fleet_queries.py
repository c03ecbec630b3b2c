"""Queries on tours of several vehicles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import facilities, fleet, search
from ..operators.overlay import Overlay
from .registry import PLACES, query
from .staging import staged
from .views import view

#: Vehicles of every request: number, capacity, longest duration (null: none).
SMALL = [(1, 6.0, None), (2, 9.0, 3_000_000.0)]
LARGE = [(1, 30.0, None), (2, 25.0, 9_000_000.0), (3, 20.0, 9_000_000.0)]


def _requests(spark, sf_dir, stops: int, vehicles: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every place is a stop: `stops` neighbours by id are one request, the first its depot. A way costs the steps east and north."""
    p = view(spark, sf_dir, "places").select(F.floor((F.col("id") - 1) / stops).alias("request"), ((F.col("id") - 1) % stops).alias("stop"), (F.col("id") % 5 + 1).alias("amount"), "lon_e7", "lat_e7")
    p = p.repartition("request")  # the table can be one file, read by one task, and each stop gives `stops` rows
    jobs = p.where("stop > 0").select("request", F.col("stop").alias("job"), "amount", (F.col("amount") * 30).alias("service"))
    fleets = p.select("request").distinct().crossJoin(F.broadcast(spark.createDataFrame(vehicles, "vehicle long, capacity double, longest double")))  # a fixed few
    a, b = (p.select("request", F.col("stop").alias(s), F.col("lon_e7").alias(f"{s}x"), F.col("lat_e7").alias(f"{s}y")) for s in "ab")
    costs = a.join(b, "request").where("a <> b").select("request", "a", "b", (F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by"))).cast("double").alias("cost"))
    return jobs, fleets, costs


def _least_sql() -> str:
    """The least over all pairs of disjoint orders of up to three jobs, one for each vehicle, that the vehicles can take."""
    way = "(abs({a}.x - {b}.x) + abs({a}.y - {b}.y))"
    orders, stops = ["SELECT request, 0 AS mask, 0 AS load, 0 AS way, 0 AS service, 0 AS n FROM d"], ["s", "t", "u"]
    for n in range(1, 4):
        own = stops[:n]
        joins = "".join(f" JOIN j {b} ON {b}.request = d.request" + "".join(f" AND {b}.stop <> {a}.stop" for a in own[:i]) for i, b in enumerate(own))
        legs = " + ".join(way.format(a=a, b=b) for a, b in zip(["d", *own], [*own, "d"], strict=True))
        total = lambda c, own=own: " + ".join(c.format(s=s) for s in own)
        orders.append(f"SELECT d.request, {total('(1 << ({s}.stop - 1))')}, {total('{s}.amount')}, {legs}, {total('{s}.amount * 30')}, {n} FROM d{joins}")
    can = " AND ".join(f"o{v}.load <= {most}" + (f" AND (o{v}.n = 0 OR o{v}.way + o{v}.service <= {longest})" if longest else "") for v, most, longest in SMALL)
    return f"""WITH p AS (SELECT CAST(floor((id - 1) / 4.0) AS BIGINT) AS request, CAST((id - 1) % 4 AS INT) AS stop, id % 5 + 1 AS amount, lon_e7 AS x, lat_e7 AS y FROM {PLACES} z),
 d AS (SELECT * FROM p WHERE stop = 0), j AS (SELECT * FROM p WHERE stop > 0), o AS ({' UNION ALL '.join(orders)}), k AS (SELECT request, count(*) AS jobs FROM j GROUP BY request),
 m AS (SELECT request, min((jobs - o1.n - o2.n, o1.way + o2.way)) AS least FROM k JOIN o o1 USING (request) JOIN o o2 USING (request) WHERE (o1.mask & o2.mask) = 0 AND {can} GROUP BY request)
 SELECT request, CAST(least[1] AS BIGINT) AS n_left, CAST(least[2] AS DOUBLE) AS way FROM m"""


@query(_least_sql())
def fleet_least_cost(spark, sf_dir):
    """For every request of a depot and three jobs: how many jobs its two vehicles leave, and what their tours cost."""
    jobs, vehicles, costs = _requests(spark, sf_dir, 4, SMALL)
    steps = staged(fleet.tours(jobs, vehicles, costs), "tours")
    left = steps.groupBy("request").agg(F.count_if(F.col("vehicle").isNull()).alias("n_left"))
    way = fleet.summaries(steps, costs).groupBy("request").agg(F.sum("way").alias("way"))
    return left.join(way, "request", "left").select("request", "n_left", F.coalesce("way", F.lit(0.0)).alias("way"))


@query()
def vehicle_tours(spark, sf_dir):
    """Tours of three vehicles for every request of a depot and 24 jobs; no SQL, as so many jobs cannot be enumerated."""
    return fleet.tours(*_requests(spark, sf_dir, 25, LARGE))


@query()
def vehicle_tours_geojson(spark, sf_dir):
    """Two people on foot, for whom every road goes both ways, call at the nearest twelve hospitals: their tours as lines along the roads."""
    nodes, roads = view(spark, sf_dir, "road_nodes"), view(spark, sf_dir, "road_edges")
    edges = roads.union(roads.select("dst", "src", "seconds"))
    lon, lat = 46.7, 24.7
    near = search.nearest_places(view(spark, sf_dir, "places"), lon, lat, "hospital", 4, 20.0).select("id")  # three times as many as asked for
    spots = near.join(view(spark, sf_dir, "places"), "id").select("id", F.col("lon_e7").alias("x_e7"), F.col("lat_e7").alias("y_e7"))
    depot = spark.createDataFrame([(0, round(lon * 1e7), round(lat * 1e7))], "id long, x_e7 long, y_e7 long")
    stops = staged(facilities.nearest_node(spots.union(depot), nodes, "id"), "stops").withColumn("request", F.lit(1).cast("long"))
    jobs = stops.where("id <> 0").select("request", F.col("id").alias("job"), F.lit(1).alias("amount"), F.lit(30).alias("service"))
    vehicles = spark.createDataFrame([(1, 1, 7.0, None), (1, 2, 7.0, None)], "request long, vehicle long, capacity double, longest double")
    overlay = Overlay.build(edges, nodes)
    steps, costs = tours_on_roads(overlay, stops, jobs, vehicles)
    return road_features(overlay, steps, costs, stops, nodes)


def tours_on_roads(overlay: Overlay, stops: DataFrame, jobs: DataFrame, vehicles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps and costs of the tours between stops (request, id, node), id 0 the depot; seconds on the roads are the costs."""
    a, b = (stops.select("request", F.col("id").alias(s), F.col("node").alias(n)) for s, n in (("a", "source"), ("b", "target")))
    pairs = staged(a.join(b, "request").where("a <> b"), "pairs")
    costs = staged(pairs.join(overlay.times_of(pairs), ["source", "target"]).select("request", "a", "b", F.col("seconds").cast("double").alias("cost")), "costs")
    return staged(fleet.tours(jobs, vehicles, costs), "tours"), costs


def road_features(overlay: Overlay, steps: DataFrame, costs: DataFrame, stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request, vehicle, feature): each tour as a line through the road's nodes (node, x_e7, y_e7)."""
    at = lambda c, n: stops.select("request", F.col("id").alias(c), F.col("node").alias(n))
    legs = fleet.legs(steps).join(at("a", "source"), ["request", "a"]).join(at("b", "target"), ["request", "b"])
    # Routes are asked for by number; written out, the numbers stay.
    asked = staged(legs.select("request", "vehicle", "leg", "source", "target", F.monotonically_increasing_id().alias("no")), "legs")
    ways = overlay.routes(asked.select(F.col("no").alias("request"), "source", "target")).withColumnRenamed("request", "no")
    # The first node of a leg is the last of the one before.
    points = ways.join(asked.select("no", "request", "vehicle", "leg"), "no").where("step > 0 OR leg = 1").join(nodes, "node")
    return fleet.features(fleet.summaries(steps, costs), points.select("request", "vehicle", F.struct("leg", "step").alias("place"), "x_e7", "y_e7"))
