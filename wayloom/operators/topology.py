"""Street centre-lines to a connected graph: nodes, ways, cleaning, dangling ends, snapping, gaps.

Ways are rows (way_id, seq, x_e7, y_e7) or (way_id, seq, node_id); nodes are (node_id, x_e7, y_e7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.staging import staged, with_offsets
from .components import connected_components
from .gridjoin import point_segments, within


def extract_nodes(vertices: DataFrame) -> DataFrame:
    """One node for each position, numbered -1, -2, .. by position without a window over all rows."""
    return with_offsets(vertices.select("x_e7", "y_e7").distinct(), ["x_e7", "y_e7"], "nodes").select((-F.col("row_no") - 1).alias("node_id"), "x_e7", "y_e7")


def way_nodes(vertices: DataFrame, nodes: DataFrame) -> DataFrame:
    return vertices.join(nodes, ["x_e7", "y_e7"]).select("way_id", "seq", "node_id")


def dedup_consecutive(ways: DataFrame) -> DataFrame:
    """Without references that repeat the one before; sequence numbers stay."""
    before = F.lag("node_id").over(W.partitionBy("way_id").orderBy("seq"))
    return ways.withColumn("_before", before).where("_before IS NULL OR _before <> node_id").drop("_before")


def way_stats(ways: DataFrame) -> DataFrame:
    return ways.groupBy("way_id").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("nd"), F.min_by("node_id", "seq").alias("first_node"), F.max_by("node_id", "seq").alias("last_node"))


def degenerate_ways(ways: DataFrame, *, drop_closed: bool = False) -> DataFrame:
    """Ways of fewer than two references or nodes, or out and back between two; with drop_closed all closed ways."""
    closed = F.col("first_node") == F.col("last_node")
    return way_stats(ways).where((F.col("n") < 2) | (F.col("nd") < 2) | (closed if drop_closed else closed & (F.col("n") == 2))).select("way_id")


def clean_way_nodes(ways: DataFrame, *, drop_closed: bool = False) -> DataFrame:
    """Ways without repeats and without degenerate_ways, in one pass over each way."""
    w = W.partitionBy("way_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kept = dedup_consecutive(ways)
    told = kept.select("*", *(f.over(w).alias(n) for n, f in (("_n", F.count(F.lit(1))), ("_lo", F.min("node_id")), ("_hi", F.max("node_id")), ("_first", F.first("node_id")), ("_last", F.last("node_id")))))
    closed = F.coalesce(F.col("_first") == F.col("_last"), F.lit(False))
    bad = (F.col("_n") < 2) | ~F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False)) | (closed if drop_closed else closed & (F.col("_n") == 2))
    return told.where(~bad | F.col("way_id").isNull()).select(*kept.columns)


def endpoints(ways: DataFrame) -> DataFrame:
    """The first and last reference of each way (a single reference once)."""
    w = W.partitionBy("way_id")
    return ways.withColumn("_lo", F.min("seq").over(w)).withColumn("_hi", F.max("seq").over(w)).where("seq = _lo OR seq = _hi").select("way_id", "node_id")


def dangling(ways: DataFrame) -> DataFrame:
    """Nodes that end exactly one way once: (node_id, way_id)."""
    return endpoints(ways).groupBy("node_id").agg(F.count("*").alias("n"), F.min("way_id").alias("way_id")).where("n = 1").select("node_id", "way_id")


def near_pairs(points: DataFrame, tol: int) -> DataFrame:
    """(node_a, node_b, d2) of different nodes within tol, a < b. points: node_id, x_e7, y_e7."""
    p = points.select("node_id", "x_e7", "y_e7").distinct()
    a = p.select(F.col("node_id").alias("node_a"), F.col("x_e7").alias("ax"), F.col("y_e7").alias("ay"))
    b = p.select(F.col("node_id").alias("node_b"), F.col("x_e7").alias("bx"), F.col("y_e7").alias("by"))
    return within(a, b, tol).where("node_a < node_b").select("node_a", "node_b", "d2")


def relabel(ways: DataFrame, labels: DataFrame) -> DataFrame:
    """ways with each node replaced by its component, where it has one."""
    return ways.join(labels, ways["node_id"] == labels["node"], "left").select("way_id", "seq", F.coalesce("component", "node_id").alias("node_id"))


def snap_node_to_node(ways: DataFrame, nodes: DataFrame, tight: int = 200, wide: int = 500) -> DataFrame:
    """All ends within `tight`, then the dangling ones within `wide`, become one node; the ways are cleaned."""
    for tol, only_dangling in ((tight, False), (wide, True)):
        ends = (dangling(ways) if only_dangling else endpoints(ways)).select("node_id").distinct()
        pairs = near_pairs(ends.join(nodes, "node_id"), tol)
        ways = staged(relabel(ways, connected_components(pairs, "node_a", "node_b")), "snapped")
    return clean_way_nodes(ways)


def nearest_endpoint(dangles: DataFrame, ends: DataFrame, tol: int) -> DataFrame:
    """For each dangling node the nearest other end within tol (ties: the smallest node)."""
    a = dangles.select(F.col("node_id").alias("node_a"), F.col("x_e7").alias("ax"), F.col("y_e7").alias("ay"))
    b = ends.select(F.col("node_id").alias("node_b"), F.col("x_e7").alias("bx"), F.col("y_e7").alias("by")).distinct()
    near = within(a, b, tol).where("node_a <> node_b")
    return near.groupBy("node_a").agg(F.min(F.struct("d2", "node_b")).alias("m")).select("node_a", F.col("m.node_b").alias("node_b"), F.col("m.d2").alias("d2"))


def segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices of each way: (way_id, seq_a, ax, ay, bx, by); gaps in seq are passed over."""
    w = W.partitionBy("way_id").orderBy("seq")
    nxt = vertices.select("way_id", F.col("seq").alias("seq_a"), F.col("x_e7").alias("ax"), F.col("y_e7").alias("ay"), F.lead("x_e7").over(w).alias("bx"), F.lead("y_e7").over(w).alias("by"))
    return nxt.where("bx IS NOT NULL")


def project(dangles: DataFrame, segs: DataFrame, tol: int = 500, cell: int = 2000) -> DataFrame:
    """Feet of dangling nodes (node_id, way_id, x_e7, y_e7) on segments of other ways within tol, strictly inside:
    (node_id, way_id, seq_a, t, dist, x_e7, y_e7) with dist and t rounded to 6 digits and the foot on the grid."""
    p = dangles.select("node_id", F.col("way_id").alias("own_way"), F.col("x_e7").alias("px"), F.col("y_e7").alias("py"))
    met = point_segments(p, segs, tol, cell).where("own_way <> way_id")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.try_divide(((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy).cast("double"), (dx * dx + dy * dy).cast("double"))
    foot = met.withColumn("t", t).where(F.col("t").between(0.001, 0.999)).withColumn("qx", F.col("ax") + F.col("t") * dx).withColumn("qy", F.col("ay") + F.col("t") * dy)
    foot = foot.withColumn("dist", F.sqrt((F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy")))).where(F.col("dist") <= tol)
    return foot.select("node_id", "way_id", "seq_a", F.round("t", 6).alias("t"), F.round("dist", 6).alias("dist"), F.floor(F.col("qx") + 0.5).cast("long").alias("x_e7"), F.floor(F.col("qy") + 0.5).cast("long").alias("y_e7"))


def best_projection(feet: DataFrame) -> DataFrame:
    """The nearest foot of each node (ties: way_id, seq_a)."""
    m = feet.groupBy("node_id").agg(F.min(F.struct("dist", "way_id", "seq_a", "t", "x_e7", "y_e7")).alias("m"))
    return m.select("node_id", "m.way_id", "m.seq_a", "m.t", "m.dist", "m.x_e7", "m.y_e7")


def inject(vertices: DataFrame, feet: DataFrame) -> DataFrame:
    """Ways with the feet as new vertices: after seq_a, in the order of t, one for each position; seq is numbered anew."""
    new = feet.select("way_id", "seq_a", "t", "x_e7", "y_e7").groupBy("way_id", "seq_a", "x_e7", "y_e7").agg(F.min("t").alias("t"))
    all_ = vertices.select("way_id", F.col("seq").alias("s"), F.lit(0.0).alias("t"), "x_e7", "y_e7").union(new.select("way_id", F.col("seq_a").alias("s"), "t", "x_e7", "y_e7"))
    seq = F.row_number().over(W.partitionBy("way_id").orderBy("s", "t", "x_e7", "y_e7"))
    return all_.select("way_id", seq.cast("long").alias("seq"), "x_e7", "y_e7")


def merge_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes that are left when each takes its component's smallest id: that node's own row stands for all."""
    met = nodes.join(labels, nodes["node_id"] == labels["node"], "left")
    return met.where("component IS NULL OR component = node_id").select("node_id", "x_e7", "y_e7")


def snap_ends(ways: DataFrame, nodes: DataFrame, tol: int = 200) -> tuple[DataFrame, DataFrame]:
    """Dangling ends become one node with the nearest other end within tol; (ways, nodes), the ways cleaned."""
    ends = endpoints(ways).join(nodes, "node_id")
    pairs = nearest_endpoint(dangling(ways).join(nodes, "node_id"), ends, tol)
    labels = connected_components(pairs, "node_a", "node_b")
    return clean_way_nodes(relabel(ways, labels)), merge_nodes(nodes, labels)


def feet_of(ways: DataFrame, nodes: DataFrame, tol: int = 500) -> DataFrame:
    """The nearest foot of each dangling end on a segment of another way."""
    vertices = ways.join(nodes, "node_id").select("way_id", "seq", "x_e7", "y_e7")
    return best_projection(project(dangling(ways).join(nodes, "node_id"), segments(vertices), tol))


def new_nodes(feet: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node for each position of feet that has none: ids below the smallest one, by the smallest dangling end there."""
    at = feet.groupBy("x_e7", "y_e7").agg(F.min("node_id").alias("dangle"))
    at = at.join(nodes.select("x_e7", "y_e7"), ["x_e7", "y_e7"], "left_anti")
    low = nodes.agg(F.min("node_id").alias("low"))  # one row
    return with_offsets(at, ["dangle"], "new_nodes").crossJoin(F.broadcast(low)).select((F.col("low") - 1 - F.col("row_no")).alias("node_id"), "x_e7", "y_e7")


def snap_to_segments(ways: DataFrame, nodes: DataFrame, tol: int = 500) -> tuple[DataFrame, DataFrame]:
    """Dangling ends move to their foot on another way within tol, which gets a vertex there; (ways, nodes), the ways cleaned.

    Ends with one foot share its node; a node that stands there already is taken. Feet on one segment come in its order.
    """
    feet = staged(feet_of(ways, nodes, tol), "feet")
    all_nodes = staged(nodes.unionByName(new_nodes(feet, nodes)), "nodes")
    shared = feet.join(all_nodes.withColumnRenamed("node_id", "shared"), ["x_e7", "y_e7"]).select(F.col("node_id").alias("dangle"), "way_id", "seq_a", "t", "shared")
    shared = staged(shared, "shared")
    cut = shared.select("way_id").distinct()
    inner = shared.select("way_id", F.col("seq_a").alias("s"), "t", F.col("shared").alias("node_id")).distinct()
    whole = ways.join(cut, "way_id", "left_semi").select("way_id", F.col("seq").alias("s"), F.lit(0.0).alias("t"), "node_id").unionByName(inner)
    seq = F.row_number().over(W.partitionBy("way_id").orderBy("s", "t", "node_id")).cast("long")
    rebuilt = whole.select("way_id", seq.alias("seq"), "node_id").unionByName(ways.join(cut, "way_id", "left_anti").select("way_id", "seq", "node_id"))
    moved = rebuilt.join(shared.select("dangle", "shared").distinct(), rebuilt["node_id"] == F.col("dangle"), "left")
    return clean_way_nodes(moved.select("way_id", "seq", F.coalesce("shared", "node_id").alias("node_id"))), all_nodes


def build_graph(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) of street vertices: numbered, cleaned, ends snapped to ends, to the nearest end and to segments."""
    nodes = staged(extract_nodes(vertices), "nodes")
    ways = staged(clean_way_nodes(way_nodes(vertices, nodes)), "ways")
    ways = staged(snap_node_to_node(ways, nodes), "ways")
    ways, nodes = snap_ends(ways, nodes)
    ways, nodes = staged(ways, "ways"), staged(nodes, "nodes")
    ways, nodes = snap_to_segments(ways, nodes)
    used = ways.select("node_id").distinct()
    return ways, nodes.join(used, "node_id", "left_semi")


def gap_pairs(ends: DataFrame, tol: int = 500) -> DataFrame:
    """Ends of different ways and nodes within a box of tol, in both directions: way_a, way_b, node_a, node_b, d2."""
    side = lambda s: ends.select(F.col("way_id").alias(f"way_{s}"), F.col("node_id").alias(f"node_{s}"), F.col("x_e7").alias(f"{s}x"), F.col("y_e7").alias(f"{s}y"))
    return within(side("a"), side("b"), tol, circle=False).where("way_a <> way_b AND node_a <> node_b").select("way_a", "way_b", "node_a", "node_b", "d2")


def gap_labels(ways: DataFrame, nodes: DataFrame, tol: int = 500) -> DataFrame:
    """(node, component) of the nodes in gap pairs, of which one direction links as much as both."""
    return connected_components(gap_pairs(endpoints(ways).join(nodes, "node_id"), tol).where("node_a < node_b"), "node_a", "node_b")


def at_mean(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node_id, x_e7, y_e7, n_merged): the nodes of each component as its smallest id at their mean position; others stay."""
    met = nodes.join(labels, nodes["node_id"] == labels["node"], "left")
    mean = lambda c: F.floor(F.sum(c) / F.count("*") + 0.5).cast("long").alias(c)
    merged = met.where("component IS NOT NULL").groupBy(F.col("component").alias("node_id")).agg(mean("x_e7"), mean("y_e7"), F.count("*").alias("n_merged"))
    return met.where("component IS NULL").select("node_id", "x_e7", "y_e7", F.lit(1).cast("long").alias("n_merged")).unionByName(merged)


def boundary_fix(ways: DataFrame, nodes: DataFrame, tol: int = 500) -> tuple[DataFrame, DataFrame]:
    """Gaps closed: the nodes of a component of gap pairs become its smallest id at their mean position; (ways, nodes)."""
    labels = gap_labels(ways, nodes, tol)
    return clean_way_nodes(relabel(ways, labels)), at_mean(nodes, labels).drop("n_merged")
