"""Tours of several vehicles from a depot: capacity, service time and longest duration; savings, then exchanges between vehicles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .maps import feature

#: Requests of at most so many jobs are solved exactly, by the sets of jobs that each vehicle may take.
EXACT_JOBS = 7
LITTLE = 1e-9
#: Jobs of all requests that one task solves, on average.
TASK_JOBS = 2000

STEPS = "request long, vehicle long, visit long, job long, arrival double, service double, load double"


class Plan:
    """Tours over jobs 1..n from depot 0: cost (n+1, n+1), amount and service by job, most load and longest duration by vehicle.

    An open tour is one whose ways back cost nothing.
    """

    def __init__(self, cost: np.ndarray, amount: np.ndarray, service: np.ndarray, most: np.ndarray, longest: np.ndarray, tours: list[list[int]] | None = None):
        self.cost, self.amount, self.service, self.most, self.longest = cost, amount, service, most, longest
        self.tours = tours or [[] for _ in most]

    def copy(self, tours: list[list[int]] | None = None) -> Plan:
        return Plan(self.cost, self.amount, self.service, self.most, self.longest, [list(t) for t in (self.tours if tours is None else tours)])

    def way(self, tour: list[int]) -> float:
        return float(sum(self.cost[a, b] for a, b in pairwise([0, *tour, 0]))) if tour else 0.0

    def duration(self, tour: list[int]) -> float:
        return self.way(tour) + float(self.service[tour].sum())

    def fits(self, tour: list[int], vehicle: int) -> bool:
        return not tour or (self.amount[tour].sum() <= self.most[vehicle] + LITTLE and self.duration(tour) <= self.longest[vehicle] + LITTLE)

    def left(self) -> list[int]:
        return sorted(set(range(1, len(self.cost))) - {j for t in self.tours for j in t})

    def worth(self) -> tuple[int, float]:
        """Smaller is better: jobs that no vehicle takes, then the ways' cost."""
        return len(self.left()), sum(map(self.way, self.tours))


def _links(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, vehicle, place) of each link of all tours; an idle vehicle has one from the depot to itself."""
    rows = [(a, b, v, i) for v, t in enumerate(plan.tours) for i, (a, b) in enumerate(pairwise([0, *t, 0]))]
    return tuple(np.array(c) for c in zip(*rows, strict=True))


def _room(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """What each vehicle could still load, and how much longer it could be under way."""
    load = np.array([plan.amount[t].sum() for t in plan.tours])
    return plan.most - load, plan.longest - np.array([plan.duration(t) for t in plan.tours])


def inserted(plan: Plan) -> bool:
    """Puts jobs that no vehicle takes where they cost least, the largest first; whether any was."""
    some = False
    for job in sorted(plan.left(), key=lambda j: (-plan.amount[j], j)):
        a, b, v, place = _links(plan)
        more = plan.cost[a, job] + plan.cost[job, b] - np.where((a == 0) & (b == 0), 0.0, plan.cost[a, b])
        load, time = _room(plan)
        more = np.where((plan.amount[job] <= load[v] + LITTLE) & (more + plan.service[job] <= time[v] + LITTLE), more, np.inf)
        k = int(np.argmin(more))
        if np.isfinite(more[k]):
            plan.tours[v[k]].insert(int(place[k]), job)
            some = True
    return some


def moved(plan: Plan) -> bool:
    """Moves each job to the link where that saves most, of its own or of another vehicle; whether any moved."""
    some = False
    for v in range(len(plan.tours)):
        for job in list(plan.tours[v]):
            tour = plan.tours[v]
            i = tour.index(job)
            before, after = tour[i - 1] if i else 0, tour[i + 1] if i + 1 < len(tour) else 0
            bridge = plan.cost[before, after] if before or after else 0.0
            less = plan.cost[before, job] + plan.cost[job, after] - bridge
            if plan.duration(tour) - less - plan.service[job] > plan.longest[v] + LITTLE:
                continue  # the way past the job is longer than through it
            a, b, w, place = _links(plan)
            more = plan.cost[a, job] + plan.cost[job, b] - np.where((a == 0) & (b == 0), 0.0, plan.cost[a, b])
            load, time = _room(plan)
            ok = (w == v) | ((plan.amount[job] <= load[w] + LITTLE) & (more + plan.service[job] <= time[w] + LITTLE))
            more = np.where(ok & (a != job) & (b != job), more, np.inf)
            k = int(np.argmin(more))
            if more[k] < less - LITTLE:
                to, at = int(w[k]), int(place[k])
                tour.pop(i)
                plan.tours[to].insert(at - (to == v and at > i), job)
                some = True
    return some


def swapped(plan: Plan) -> bool:
    """Exchanges a job with one of another vehicle where that saves most; whether any pair was."""
    some = False
    for v in range(len(plan.tours)):
        for i in range(len(plan.tours[v])):
            tour = plan.tours[v]
            job = tour[i]
            others = [(j, w, k, t[k - 1] if k else 0, t[k + 1] if k + 1 < len(t) else 0) for w, t in enumerate(plan.tours) if w != v for k, j in enumerate(t)]
            if not others:
                return some
            j, w, k, a, b = (np.array(c) for c in zip(*others, strict=True))
            before, after = tour[i - 1] if i else 0, tour[i + 1] if i + 1 < len(tour) else 0
            here = plan.cost[before, j] + plan.cost[j, after] - plan.cost[before, job] - plan.cost[job, after]
            there = plan.cost[a, job] + plan.cost[job, b] - plan.cost[a, j] - plan.cost[j, b]
            load, time = _room(plan)
            more, longer = plan.amount[j] - plan.amount[job], plan.service[j] - plan.service[job]
            ok = (more <= load[v] + LITTLE) & (-more <= load[w] + LITTLE) & (here + longer <= time[v] + LITTLE) & (there - longer <= time[w] + LITTLE)
            gain = np.where(ok, here + there, np.inf)
            best = int(np.argmin(gain))
            if gain[best] < -LITTLE:
                tour[i], plan.tours[w[best]][k[best]] = int(j[best]), job
                some = True
    return some


def turned(plan: Plan) -> bool:
    """Reverses the stretch of each tour where that saves most, until none does; costs may differ by direction. Whether any was."""
    some = False
    for v, tour in enumerate(plan.tours):
        while len(tour) > 1:
            r = np.array([0, *tour, 0])
            ahead = np.concatenate([[0.0], np.cumsum(plan.cost[r[:-1], r[1:]])])
            back = np.concatenate([[0.0], np.cumsum(plan.cost[r[1:], r[:-1]])])
            i, j = np.triu_indices(len(tour), 1)
            i, j = i + 1, j + 1
            gain = plan.cost[r[i - 1], r[j]] + plan.cost[r[i], r[j + 1]] + back[j] - back[i] - (ahead[j + 1] - ahead[i - 1])
            k = int(np.argmin(gain))
            if gain[k] >= -LITTLE:
                break
            tour[i[k] - 1 : j[k]] = tour[i[k] - 1 : j[k]][::-1]
            some = True
    return some


def improved(plan: Plan) -> Plan:
    """The plan after insertions, moves, exchanges and reversals, until none helps."""
    while any([inserted(plan), moved(plan), swapped(plan), turned(plan)]):
        pass
    return plan


def merged(plan: Plan) -> Plan:
    """By savings: from a tour for each job, the end of one and the start of another that save most are joined while a vehicle can take both."""
    n, most, longest = len(plan.cost), plan.most.max(), plan.longest.max()
    tour = {j: [j] for j in range(1, n) if any(plan.fits([j], v) for v in range(len(plan.most)))}
    whose = {j: j for j in tour}
    saved = plan.cost[1:, :1] + plan.cost[:1, 1:] - plan.cost[1:, 1:]
    for flat in np.argsort(-saved, axis=None, kind="stable"):
        a, b = divmod(int(flat), n - 1)
        if saved[a, b] <= LITTLE:
            break
        a, b = a + 1, b + 1
        if a not in whose or b not in whose or whose[a] == whose[b] or tour[whose[a]][-1] != a or tour[whose[b]][0] != b:
            continue
        both = tour[whose[a]] + tour[whose[b]]
        if plan.amount[both].sum() <= most + LITTLE and plan.duration(both) <= longest + LITTLE:
            gone = whose[b]
            tour[whose[a]] = both
            for j in tour.pop(gone):
                whose[j] = whose[a]
    out = plan.copy([[] for _ in plan.most])
    for t in sorted(tour.values(), key=lambda t: (-len(t), t)):
        free = [v for v in range(len(plan.most)) if not out.tours[v] and plan.fits(t, v)]
        if free:
            out.tours[min(free, key=lambda v: (plan.most[v], plan.longest[v], v))] = t
    return out


def split_in_order(plan: Plan) -> Plan:
    """The tour of one vehicle without limits, cut in its order: each vehicle in turn takes what fits."""
    alone = Plan(plan.cost, plan.amount, plan.service, np.array([np.inf]), np.array([np.inf]))
    order = improved(merged(alone)).tours[0]
    out, v = plan.copy([[] for _ in plan.most]), 0
    for job in order:
        at = v
        while at < len(plan.most) and not plan.fits([*out.tours[at], job], at):
            at += 1
        if at < len(plan.most):  # a job that no vehicle from here on can take holds none of them up
            out.tours[at].append(job)
            v = at
    return out


def exact(plan: Plan) -> Plan:
    """The best plan, by the cheapest tour of every set of jobs and the sets that each vehicle in turn may take."""
    n, cost = len(plan.cost) - 1, plan.cost.tolist()
    best: dict[tuple[int, int], tuple[float, list[int]]] = {(1 << j, j + 1): (cost[0][j + 1], [j + 1]) for j in range(n)}
    for _ in range(n - 1):
        for (seen, last), (c, t) in list(best.items()):
            for j in range(n):
                if not seen >> j & 1:
                    key, new = (seen | 1 << j, j + 1), (c + cost[last][j + 1], [*t, j + 1])
                    if key not in best or new < best[key]:
                        best[key] = new
    tour: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for (seen, last), (c, t) in best.items():
        tour[seen] = min(tour.get(seen, (np.inf, [])), (c + cost[last][0], t))
    plans: dict[int, tuple[float, list[list[int]]]] = {0: (0.0, [])}
    for v in range(len(plan.most)):
        can = [s for s, (_, t) in tour.items() if plan.fits(t, v)]
        after: dict[int, tuple[float, list[list[int]]]] = {}
        for taken, (c, tours) in plans.items():
            for s in can:
                if not s & taken:
                    new = (c + tour[s][0], [*tours, tour[s][1]])
                    if s | taken not in after or new < after[s | taken]:
                        after[s | taken] = new
        plans = after
    _, (_, tours) = min(plans.items(), key=lambda p: (n - p[0].bit_count(), p[1]))
    return plan.copy(tours)


def solved(plan: Plan) -> Plan:
    """Exact for few jobs; else the better of two plans that exchanges have improved: by savings, and one tour split in order."""
    if len(plan.cost) - 1 <= EXACT_JOBS:
        return exact(plan)
    return min((improved(p(plan)) for p in (merged, split_in_order)), key=Plan.worth)


def tours(jobs: DataFrame, vehicles: DataFrame, costs: DataFrame, closed: bool = True) -> DataFrame:
    """(request, vehicle, visit, job, arrival, service, load): the jobs that each vehicle visits, in order, from visit 1.

    jobs (request, job, amount, service), vehicles (request, vehicle, capacity, longest) and costs (request, a, b, cost),
    where the depot is stop 0 and a job's stop is its number. As many jobs as can be are served, then the ways cost
    least. arrival counts seconds from the depot; load is what the vehicle has for this job and those before. A job that
    no vehicle can take, or that has no way from the depot and back, has a null vehicle, visit, arrival and load.
    Nulls: an amount or service is 0, a capacity or longest without limit; rows without a request or number go, as do
    costs without a value. Of repeated jobs or vehicles one with the largest amount or capacity counts, of repeated
    costs the least; job 0 is the depot and is none. Missing costs are ways that do not exist. A request without
    vehicles leaves all its jobs. Open tours (closed=False) end at their last job.

    A request is one group and is solved in one task, with a matrix of its stops; requests are bounded by whoever asks
    (a service takes about a thousand stops), and any number of them is dealt out.
    """
    number = lambda c, otherwise: F.coalesce(F.col(c).cast("double"), F.lit(otherwise))
    whole = lambda c: F.col(c).cast("long")
    none, no = F.lit(0).cast("long"), float("inf")
    rows = jobs.where("request IS NOT NULL AND job IS NOT NULL AND job <> 0").select(whole("request").alias("request"), F.lit(0).alias("kind"), whole("job").alias("a"), none.alias("b"), number("amount", 0.0).alias("x"), number("service", 0.0).alias("y"))
    rows = rows.union(vehicles.where("request IS NOT NULL AND vehicle IS NOT NULL").select(whole("request"), F.lit(1), whole("vehicle"), none, number("capacity", no), number("longest", no)))
    rows = rows.union(costs.where("request IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND cost IS NOT NULL AND a <> b").select(whole("request"), F.lit(2), whole("a"), whole("b"), F.col("cost").cast("double"), F.lit(0.0)))
    # Repeated rows go in the solver, where a request is together anyhow: nothing is summed before the one shuffle.
    # Requests take far longer than their bytes tell, so tasks are dealt out by the number of jobs.
    return rows.repartition(1 + jobs.count() // TASK_JOBS, "request").sortWithinPartitions("request", "kind", "a", "b", "x", "y").mapInPandas(_solver(closed), STEPS)


def _solver(closed: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        join = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        for pdf in batches:
            if not len(pdf):
                continue
            held.append({c: pdf[c].to_numpy() for c in pdf.columns})
            last = held[-1]["request"][-1]
            if last != held[0]["request"][0]:  # rows are by request: all but the last are whole
                rows = join()
                cut = np.searchsorted(rows["request"], last)
                yield _planned({c: v[:cut] for c, v in rows.items()}, closed)
                held = [{c: v[cut:] for c, v in rows.items()}]
        if held:
            yield _planned(join(), closed)

    return run


def _planned(rows: dict[str, np.ndarray], closed: bool) -> pd.DataFrame:
    """The steps of whole requests, by request, kind, a, b, x, y."""
    new = lambda *keys: np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    first = new(rows["request"], rows["kind"], rows["a"], rows["b"])
    # Of repeated jobs and vehicles the last and largest counts, of costs the first and least.
    kept = np.where(rows["kind"] == 2, first, np.append(first[1:], True))
    rows = {c: v[kept] for c, v in rows.items()}
    starts = np.flatnonzero(new(rows["request"]))
    out: list[tuple] = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows["request"])], strict=True):
        v, w = (s + np.searchsorted(rows["kind"][s:e], [1, 2])).tolist()
        names = rows["a"][s:v]
        cost = np.full((len(names) + 1, len(names) + 1), np.inf)
        if w < e:
            stops = np.concatenate([[0], names])
            order = np.argsort(stops)
            at = [order[np.minimum(np.searchsorted(stops, rows[c][w:e], sorter=order), len(stops) - 1)] for c in "ab"]
            known = (stops[at[0]] == rows["a"][w:e]) & (stops[at[1]] == rows["b"][w:e])
            cost[at[0][known], at[1][known]] = rows["x"][w:e][known]
        np.fill_diagonal(cost, 0.0)
        if not closed:
            cost[:, 0] = 0.0
        # A way that does not exist costs more than all others together and cannot be part of a tour that is kept.
        gone = ~np.isfinite(cost)
        none = 1e6 + 10 * float(cost[~gone].sum())
        cost[gone] = none
        amount, service = (np.concatenate([[0.0], rows[c][s:v]]) for c in "xy")
        plan = Plan(cost, amount, service, rows["x"][v:w], np.minimum(rows["y"][v:w], none / 2 + service.sum()))
        if len(names) and w > v:
            plan = solved(plan)
        request, names = int(rows["request"][s]), names.tolist()
        for vehicle, tour in zip(rows["a"][v:w].tolist(), plan.tours, strict=True):
            time, load, last = 0.0, 0.0, 0
            for i, j in enumerate(tour, 1):
                time += cost[last, j]
                load += amount[j]
                out.append((request, vehicle, i, names[j - 1], time, service[j], load))
                time, last = time + service[j], j
        out += [(request, None, None, names[j - 1], None, service[j], None) for j in plan.left()]
    made = pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])
    return made.astype({"request": "int64", "vehicle": "Int64", "visit": "Int64", "job": "int64", "arrival": "Float64", "service": "float64", "load": "Float64"})


def summaries(steps: DataFrame, costs: DataFrame, closed: bool = True) -> DataFrame:
    """(request, vehicle, n_jobs, way, service, duration, load) of each vehicle with a job: way is the cost from the depot and, if closed, back to it."""
    end = F.max(F.struct("visit", "job", (F.col("arrival") + F.col("service")).alias("done"), "load")).alias("e")
    used = steps.where("vehicle IS NOT NULL").groupBy("request", "vehicle").agg(F.count("*").alias("n_jobs"), F.sum("service").alias("service"), end)
    back = costs.where("b = 0").groupBy("request", F.col("a").alias("job")).agg(F.min("cost").alias("back"))
    whole = used.select("request", "vehicle", "n_jobs", "service", "e.job", "e.done", "e.load").join(back, ["request", "job"], "left")
    duration = F.col("done") + F.col("back") if closed else F.col("done")
    return whole.select("request", "vehicle", "n_jobs", (duration - F.col("service")).alias("way"), "service", duration.alias("duration"), "load")


def legs(steps: DataFrame, closed: bool = True) -> DataFrame:
    """(request, vehicle, leg, a, b): the legs of each tour from stop 0 and, if closed, back to it; legs count from 1."""
    w = W.partitionBy("request", "vehicle").orderBy("visit")
    own = steps.where("vehicle IS NOT NULL").select("request", "vehicle", "visit", "job", F.coalesce(F.lag("job").over(w), F.lit(0)).alias("a"), F.lead("job").over(w).isNull().alias("ends"))
    there = own.select("request", "vehicle", F.col("visit").alias("leg"), "a", F.col("job").alias("b"))
    home = own.where("ends").select("request", "vehicle", F.col("visit") + 1, "job", F.lit(0).cast("long"))
    return there.union(home) if closed else there


def features(summary: DataFrame, points: DataFrame) -> DataFrame:
    """(request, vehicle, feature): each tour as a GeoJSON line through points (request, vehicle, place, x_e7, y_e7), with vehicle_id, duration and distance.

    distance is the line's length in metres on the sphere. Tours of fewer than two points have no line and go.
    """
    rad = lambda c: F.radians(c / 1e7)
    w = W.partitionBy("request", "vehicle").orderBy("place")
    px, py = F.lag("x_e7").over(w), F.lag("y_e7").over(w)
    half = F.pow(F.sin((rad(F.col("y_e7")) - rad(py)) / 2), 2) + F.cos(rad(py)) * F.cos(rad(F.col("y_e7"))) * F.pow(F.sin((rad(F.col("x_e7")) - rad(px)) / 2), 2)
    step = points.withColumn("metres", F.coalesce(2 * 6371000.0 * F.atan2(F.sqrt(half), F.sqrt(1 - half)), F.lit(0.0)))
    spot = F.format_string("[%.7f,%.7f]", F.col("x_e7") / 1e7, F.col("y_e7") / 1e7).alias("spot")
    line = step.groupBy("request", "vehicle").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", spot))), lambda p: p["spot"]).alias("spots"), F.round(F.sum("metres")).cast("long").alias("distance"))
    told = summary.join(line.where(F.size("spots") >= 2), ["request", "vehicle"])
    text = F.concat(F.lit("["), F.array_join("spots", ","), F.lit("]"))
    return told.select("request", "vehicle", feature("LineString", text, {"vehicle_id": F.col("vehicle"), "duration": F.round("duration").cast("long"), "distance": F.col("distance")}).alias("feature"))
