"""Connected components of an undirected graph by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.staging import staged

#: Contraction shrinks the graph by a constant factor a round in expectation; a graph that still has edges then is an error.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every end of an edge; the component is its smallest node.

    Each round every node follows the neighbour (or itself) of least salted hash, the graph is relabelled by what its
    nodes follow, and edges inside a label go. Nothing is gathered by node but a minimum, so a node with any number of
    edges is summed on the map side; each round's tables are written to the shared folder, which cuts the lineage.
    The nodes as a whole are not carried through the rounds: a round keeps only who follows whom in it, and what each ends
    at is found from the last round back, which reads a round and the later, smaller ones.
    Edges with a null end or between a node and itself link nothing; only the latter's node is returned.
    """
    ends = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = staged(ends.distinct(), "ends")  # what makes the edges is read twice below and would run twice
    left, steps = ends.where("u <> v"), []
    for salt in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        both = left.union(left.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("id"))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        step = staged(best.select("u", F.least("m", rank("u"))["id"].alias("to")).where("to <> u"), "step")
        steps.append(step)
        for c in ("u", "v"):
            s = step.select(F.col("u").alias("_from"), F.col("to").alias("_to"))
            other = "v" if c == "u" else "u"
            left = left.join(s, left[c] == s["_from"], "left").select(F.coalesce("_to", c).alias(c), other)
        left = staged(left.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"the graph still has edges after {MAX_ROUNDS} rounds")
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    roots = _roots(steps)
    follow = nodes.select("node", F.col("node").alias("root")) if roots is None else nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))
    follow = staged(follow, "follow")
    least = follow.groupBy("root").agg(F.min("node").alias("component"))
    return follow.join(least, "root").select("node", "component")


def _roots(steps: list[DataFrame]) -> DataFrame | None:
    """(u, root): where those that followed another in some round end.

    The name of a node that followed another can stay on in those that followed it in the same round, so what a later
    round says of a name counts only for those that did not move before.
    """
    known = None
    for step in reversed(steps):
        if known is None:
            known = step.select("u", F.col("to").alias("root"))
            continue
        later = known.select(F.col("u").alias("_u"), F.col("root").alias("_root"))
        now = step.join(later, step["to"] == later["_u"], "left").select("u", F.coalesce("_root", "to").alias("root"))
        known = staged(now.union(known.join(step.select("u"), "u", "left_anti").select("u", "root")), "roots")
    return known
