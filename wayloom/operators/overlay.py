"""Shortest times over a road graph cut into cells: a few joins over cells in place of one for each edge of a way.

Level 1 deals the nodes out to squares of at most `most` nodes each, by their positions. A node with an edge to another
cell is a border node; shortcuts are the least times between border nodes of a cell inside it. Border nodes, the edges
between cells and the shortcuts are the graph of the next level, until all is one cell. Times between nodes of a level
are the same in the next one, so a search climbs from its ends, a cell a level, and the two searches meet in a cell
that they share: two joins a level, however long the way is. Each task holds one cell and a bounded share of the ends.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.staging import staged

#: Nodes of a cell, and ends of ways that one task searches from.
CELL_NODES = 2000
TASK_ENDS = 128
FANOUT = 4
DEPTH = 12
ROOT = "0/0/0"


def square(points: DataFrame) -> tuple[int, int, int] | None:
    """(x, y, size): a square that holds all points (node, x, y); its size is a power of FANOUT. None without points."""
    b = points.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if b["x"] is None:
        return None
    size = FANOUT**3
    while size < max(b["x1"] - b["x"], b["y1"] - b["y"]) + 1:
        size *= FANOUT
    return b["x"], b["y"], size


def cells_of(points: DataFrame, most: int, within: tuple[int, int, int]) -> DataFrame:
    """(node, cell) of points (node, x, y): leaves of a tree of squares that hold at most `most` of them; squares of the
    smallest size hold whatever is in them. Trees over fewer of the same points cut the same square less, so their cells
    hold whole cells."""
    x0, y0, size = within
    sizes = [size // FANOUT**d for d in range(DEPTH) if size >= FANOUT**d]
    at = lambda c, o, s: F.floor((F.col(c) - o) / s).cast("long")
    fine = points.groupBy(at("x", x0, F.lit(sizes[-1])).alias("fx"), at("y", y0, F.lit(sizes[-1])).alias("fy")).agg(F.count("*").alias("n"))
    up = fine.select("fx", "fy", "n", F.explode(F.array(*map(F.lit, sizes)).cast("array<long>")).alias("size"))
    up = up.select("size", *(F.floor(F.col(f) * sizes[-1] / F.col("size")).cast("long").alias(t) for f, t in (("fx", "tx"), ("fy", "ty"))), "n")
    tiles = staged(up.groupBy("size", "tx", "ty").agg(F.sum("n").alias("n")), "tiles")
    fullest = {r["size"]: r["n"] for r in tiles.groupBy("size").agg(F.max("n").alias("n")).collect()}  # a row for each depth
    sizes = sizes[: next((i + 1 for i, s in enumerate(sizes) if fullest[s] <= most), len(sizes))]
    over = tiles.where(F.col("n") > most).select((F.col("size") / FANOUT).cast("long").alias("size"), F.col("tx").alias("ux"), F.col("ty").alias("uy"))
    half = lambda t: F.floor(F.col(t) / FANOUT).cast("long")
    leaf = tiles.where(((F.col("n") <= most) & (F.col("size") >= sizes[-1])) | (F.col("size") == sizes[-1])).withColumn("ux", half("tx")).withColumn("uy", half("ty"))
    below = leaf.where(F.col("size") < sizes[0]).join(over, ["size", "ux", "uy"], "left_semi")
    leaf = leaf.where(F.col("size") == sizes[0]).select("size", "tx", "ty").union(below.select("size", "tx", "ty"))
    spread = points.select("node", "x", "y", F.explode(F.array(*map(F.lit, sizes)).cast("array<long>")).alias("size"))
    keyed = spread.select("node", "size", at("x", x0, F.col("size")).alias("tx"), at("y", y0, F.col("size")).alias("ty"))
    return keyed.join(leaf, ["size", "tx", "ty"]).select("node", F.concat_ws("/", "size", "tx", "ty").alias("cell"))


def _search(out: dict, seeds: dict) -> tuple[dict, dict]:
    """Least times from the seeds (node: time so far) along out (node: [(node, seconds, ..)]), and the edge into each node."""
    best, into, done = dict(seeds), {}, set()
    heap = [(t, n) for n, t in seeds.items()]
    heapq.heapify(heap)
    while heap:
        t, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        for edge in out.get(n, ()):
            m, s = t + edge[1], edge[0]
            if s not in best or m < best[s]:
                best[s], into[s] = m, (n, edge)
                heapq.heappush(heap, (m, s))
    return best, into


def _adjacent(pdf: pd.DataFrame, back: bool = False) -> dict:
    out = defaultdict(list)
    a, b = ("dst", "src") if back else ("src", "dst")
    for s, d, t, level in zip(pdf[a].tolist(), pdf[b].tolist(), pdf["seconds"].tolist(), pdf["level"].tolist(), strict=True):
        out[s].append((d, t, level))
    return out


def _shortcuts(pdf: pd.DataFrame) -> pd.DataFrame:
    """(src, dst, seconds) between a cell's border nodes, without those that two shorter ones make up."""
    out, rows = _adjacent(pdf), []
    border = set(pdf["src"][pdf["src_border"]]) | set(pdf["dst"][pdf["dst_border"]])
    for u in border:
        best, into = _search(out, {u: 0})
        passed: dict = {u: None}  # the time at which the way to a node first passes a border node, after time 0
        for v in sorted(best, key=best.get):
            chain = []
            while v not in passed:
                chain.append(v)
                v = into[v][0]
            for w in reversed(chain):
                p = into[w][0]
                passed[w] = passed[p] if passed[p] is not None else (best[p] if p in border and best[p] > 0 else None)
        rows += [(u, v, t) for v, t in best.items() if v != u and v in border and (passed[v] is None or passed[v] >= t)]
    return pd.DataFrame(rows, columns=["src", "dst", "seconds"]).astype("int64")


@dataclass
class Level:
    cells: DataFrame  # node, cell: the nodes of the graph that this level deals out
    inner: DataFrame  # cell, src, dst, seconds, level: its edges inside cells; level 0: an edge of the roads, else a shortcut


def _positions(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(node, x, y) for each end of an edge. Without nodes (node, x_e7, y_e7) ids stand for positions; a node that has none there is put by a neighbour."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    if nodes is None:
        return ends.select("node", F.col("node").alias("x"), F.lit(0).cast("long").alias("y"))
    known = nodes.where("x_e7 IS NOT NULL AND y_e7 IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("x_e7").cast("long").alias("x"), F.col("y_e7").cast("long").alias("y"))).alias("p"))
    own = ends.join(known, "node", "left")
    beside = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    lost = own.where("p IS NULL").select("node").join(beside, "node").join(known.select(F.col("node").alias("other"), F.col("p").alias("q")), "other").groupBy("node").agg(F.min("q").alias("q"))
    at = F.coalesce("p", "q")
    return own.join(lost, "node", "left").select("node", *(F.coalesce(at[c], F.lit(0)).cast("long").alias(c) for c in ("x", "y")))


class Overlay:
    """The levels over edges (src, dst, seconds); they serve any number of searches."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, edges: DataFrame, nodes: DataFrame | None = None, most: int = CELL_NODES) -> Overlay:
        """Rows with nulls link nothing; of parallel edges the least counts. Seconds are whole and must not be negative."""
        least = edges.where("src IS NOT NULL AND dst IS NOT NULL AND seconds IS NOT NULL").groupBy("src", "dst").agg(F.min("seconds").cast("long").alias("seconds"))
        graph = staged(least.withColumn("level", F.lit(0)), "edges")
        if not graph.where("seconds < 0").isEmpty():
            raise ValueError("seconds must not be negative")
        points = staged(_positions(graph, nodes), "points")
        levels: list[Level] = []
        n, within = points.count(), square(points)
        while True:
            one = n <= most
            cells = points.select("node", F.lit(ROOT).alias("cell")) if one else staged(cells_of(points, most, within), "cells")
            if one:
                levels.append(Level(cells, graph.select(F.lit(ROOT).alias("cell"), "src", "dst", "seconds", "level")))
                return cls(levels)
            of = lambda end: cells.select(F.col("node").alias(end), F.col("cell").alias(f"{end}_cell"))
            placed = staged(graph.join(of("src"), "src").join(of("dst"), "dst"), "placed")
            between = placed.where("src_cell <> dst_cell").select("src", "dst", "seconds", "level")
            border = staged(between.select(F.col("src").alias("node")).union(between.select("dst")).distinct(), "border")
            inner = placed.where("src_cell = dst_cell").select(F.col("src_cell").alias("cell"), "src", "dst", "seconds", "level")
            mark = lambda end: border.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_border"))
            marked = inner.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").na.fill(False, ["src_border", "dst_border"])
            short = marked.groupBy("cell").applyInPandas(_shortcuts, "src long, dst long, seconds long")
            levels.append(Level(cells, inner))
            graph = staged(between.union(short.withColumn("level", F.lit(len(levels)))), "overlay")
            points = staged(points.join(border, "node", "left_semi"), "points")
            left = points.count()
            most = most if left <= n / 2 else most * FANOUT  # a graph with hardly an inner node: larger cells
            n = left

    def climb(self, ends: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        """For each level (seeds, labels) of (end, back, node, seconds, cell): times inside the end's cell from ends (node,
        back), or to them where back is set. Seeds are the times that the level begins with, labels those of all nodes
        of the cell."""
        first = ends.select(F.col("node").alias("end"), "back", "node", F.lit(0).cast("long").alias("seconds")).distinct()
        seeds = staged(first.join(self.levels[0].cells, "node"), "seeds")
        n = max(1, -(-seeds.count() // TASK_ENDS))
        out = []

        def reach(edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
            rows = []
            near = {back: _adjacent(edges, back) for back in set(seeds["back"])}
            for (end, back), own in seeds.groupby(["end", "back"]):
                best, _ = _search(near[back], dict(zip(own["node"].tolist(), own["seconds"].tolist(), strict=True)))
                rows += [(end, back, v, t) for v, t in best.items()]
            found = pd.DataFrame(rows, columns=["end", "back", "node", "seconds"]).astype({"end": "int64", "back": bool, "node": "int64", "seconds": "int64"})
            return found.assign(cell=seeds["cell"].iloc[0] if len(seeds) else "")

        for k, level in enumerate(self.levels):
            if k:
                seeds = out[-1][1].drop("cell").join(level.cells, "node")
            dealt = seeds.withColumn("share", F.pmod(F.xxhash64("end"), F.lit(n)))
            edges = _dealt(level.inner, dealt)
            found = edges.groupBy("at", "part").cogroup(dealt.groupBy("cell", "share")).applyInPandas(reach, "end long, back boolean, node long, seconds long, cell string")
            out.append((seeds, staged(found, "labels")))
        return out

    def _met(self, sources: DataFrame, targets: DataFrame, pairs: DataFrame | None) -> tuple[DataFrame, list]:
        """(source, target, m: seconds, level, node, cell) of each pair with a way: its best meeting; and the climb."""
        climb = self.climb(sources.select("node", F.lit(False).alias("back")).union(targets.select("node", F.lit(True).alias("back"))))
        meets = []
        for k, (seeds, labels) in enumerate(climb, 1):
            a = labels.where("NOT back").select(F.col("end").alias("source"), "node", F.col("seconds").alias("s1"), "cell")
            b = seeds.where("back").select(F.col("end").alias("target"), F.col("node").alias("at"), F.col("seconds").alias("s2"))
            on = a["node"] == b["at"]
            if pairs is not None:
                a = a.join(pairs.select("source", F.col("target").alias("to")), "source")
                on = (a["node"] == b["at"]) & (a["to"] == b["target"])
            meets.append(a.join(b, on).select("source", "target", F.struct((F.col("s1") + F.col("s2")).alias("seconds"), F.lit(k).alias("level"), "node", "cell").alias("m")))
        return staged(reduce(DataFrame.union, meets).groupBy("source", "target").agg(F.min("m").alias("m")), "met"), climb

    def times(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """(source, target, seconds) of all pairs of sources (node) and targets (node) with a way."""
        return self._met(sources, targets, None)[0].select("source", "target", "m.seconds")

    def times_of(self, pairs: DataFrame) -> DataFrame:
        """(source, target, seconds) of those of pairs (source, target) that have a way."""
        asked = pairs.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
        ends = [asked.select(F.col(c).alias("node")) for c in ("source", "target")]
        return self._met(*ends, asked)[0].select("source", "target", "m.seconds")

    def routes(self, requests: DataFrame) -> DataFrame:
        """(request, step, node, seconds) along one shortest route of each request (request, source, target); no row where there is no way.

        The halves of each best meeting are ways inside a cell: a level at a time, the edges of such a way that are
        shortcuts become ways inside a cell of the level below.
        """
        asked = requests.select("source", "target").distinct()
        met, climb = self._met(asked.select(F.col("source").alias("node")), asked.select(F.col("target").alias("node")), asked)
        met = requests.join(met, ["source", "target"])
        half = lambda no, a, b, level: met.select("request", F.lit(no).alias("order"), F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(None).cast("long").alias("seconds"), level.alias("level"))
        left = half("0", "source", "m.node", F.col("m.level")).union(half("1", "m.node", "target", F.col("m.level") - 1)).where("src <> dst")
        left = staged(left, "halves")
        done = []
        for k in range(len(self.levels), 0, -1):
            done.append(left.where("level = 0"))
            now, later = left.where(F.col("level") == k), left.where(F.col("level").between(1, k - 1))
            level = self.levels[k - 1]
            cells = level.cells
            edges = level.inner.select("cell", "src", "dst", "seconds", "level")
            seeds = climb[k - 1][0]
            cells = cells.union(seeds.select(F.col("end").alias("node"), "cell"))
            ends = [F.when(F.col("back"), F.col(b)).otherwise(F.col(a)) for a, b in (("end", "node"), ("node", "end"))]
            edges = edges.union(seeds.where("end <> node").select("cell", ends[0].alias("src"), ends[1].alias("dst"), "seconds", F.lit(k - 1).alias("level")))
            n = max(1, -(-now.count() // TASK_ENDS))
            dealt = now.join(cells.distinct().withColumnRenamed("node", "src"), "src").withColumn("share", F.pmod(F.xxhash64("request"), F.lit(n)))
            opened = _dealt(edges, dealt).groupBy("at", "part").cogroup(dealt.groupBy("cell", "share")).applyInPandas(_opened, "request long, order string, src long, dst long, seconds long, level int")
            left = staged(opened.union(later), "opened")
        steps = staged(reduce(DataFrame.union, [*done, left.where("level = 0")]), "steps")
        first = met.select("request", F.lit("").alias("order"), F.col("source").alias("node"), F.lit(0).cast("long").alias("seconds"))
        w = W.partitionBy("request").orderBy("order")
        rows = first.union(steps.select("request", "order", F.col("dst").alias("node"), "seconds"))
        return rows.select("request", (F.row_number().over(w) - 1).cast("long").alias("step"), "node", F.sum("seconds").over(w).alias("seconds"))


def _dealt(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges (cell, ..) with at and part, once for each cell and share of asked (cell, share, ..)."""
    tasks = asked.select(F.col("cell").alias("at"), F.col("share").alias("part")).distinct()
    return edges.join(tasks, edges["cell"] == tasks["at"]).select("at", "part", "src", "dst", "seconds", "level")


def _opened(edges: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """The edges of each way (request, order, src, dst) inside a cell; order goes on from the way's own."""
    out, rows = _adjacent(edges), []
    for src, own in ways.groupby("src"):
        _, into = _search(out, {src: 0})
        for request, order, dst in zip(own["request"], own["order"], own["dst"], strict=True):
            chain, v = [], dst
            while v != src:
                u, edge = into[v]
                chain.append((u, v, edge[1], edge[2]))
                v = u
            rows += [(request, f"{order}.{i:09d}", *e) for i, e in enumerate(reversed(chain))]
    return pd.DataFrame(rows, columns=["request", "order", "src", "dst", "seconds", "level"])
