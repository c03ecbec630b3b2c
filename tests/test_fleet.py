"""Tours of several vehicles: against enumeration where there are few jobs, against one tour split in order, and cases without a way."""

from itertools import permutations, product

import numpy as np
import pytest

from wayloom.operators import fleet

JOBS, VEHICLES, COSTS = "request long, job long, amount double, service double", "request long, vehicle long, capacity double, longest double", "request long, a long, b long, cost double"


def made(n, v, seed, one_way=True):
    g = np.random.default_rng(seed)
    at = g.integers(0, 100, (n + 1, 2))
    cost = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) + (g.integers(0, 9, (n + 1, n + 1)) if one_way else 0)
    np.fill_diagonal(cost, 0)
    amount, service = np.append(0, g.integers(1, 9, n)).astype(float), np.append(0, g.integers(0, 30, n)).astype(float)
    most = g.integers(6, 6 + 2 * max(1, int(amount.sum()) // v), v).astype(float)
    longest = g.integers(150, 600, v).astype(float)
    return fleet.Plan(cost, amount, service, most, longest)


def enumerated(plan):
    """The least worth over all ways to deal the jobs out and to order them."""
    n, v = len(plan.cost) - 1, len(plan.most)
    best = (n, 0.0)
    for dealt in product(range(v + 1), repeat=n):
        own = [[j for j in range(1, n + 1) if dealt[j - 1] == k] for k in range(v)]
        if any(plan.amount[t].sum() > plan.most[k] for k, t in enumerate(own) if t):
            continue
        tours = [min((plan.way(list(o)) for o in permutations(t)), default=0.0) if t else 0.0 for t in own]
        if all(not t or c + plan.service[t].sum() <= plan.longest[k] for k, (t, c) in enumerate(zip(own, tours, strict=True))):
            best = min(best, (sum(d == v for d in dealt), sum(tours)))
    return best


def sound(plan):
    assert all(plan.fits(t, v) for v, t in enumerate(plan.tours))
    seen = [j for t in plan.tours for j in t]
    assert len(seen) == len(set(seen))


@pytest.mark.parametrize("seed", range(8))
def test_few_jobs_against_enumeration(seed):
    plan = made(5, 1 + seed % 3, seed)
    got, want = fleet.exact(plan), enumerated(plan)
    sound(got)
    assert got.worth()[0] == want[0] and got.worth()[1] == pytest.approx(want[1])
    search = min((fleet.improved(p(plan)) for p in (fleet.merged, fleet.split_in_order)), key=fleet.Plan.worth)
    sound(search)
    assert search.worth() >= (want[0], want[1] - 1e-6)


@pytest.mark.parametrize("seed", range(6))
def test_never_worse_than_one_tour_split_in_order(seed):
    plan = made(40, 4, 100 + seed, one_way=seed % 2 == 0)
    got, split = fleet.solved(plan), fleet.split_in_order(plan)
    sound(got)
    sound(split)
    assert got.worth()[0] <= split.worth()[0]
    assert got.worth() <= (split.worth()[0], split.worth()[1] + 1e-6)


def test_exchanges_never_make_a_plan_worse():
    for seed in range(6):
        plan = fleet.split_in_order(made(25, 3, 200 + seed))
        for step in (fleet.inserted, fleet.moved, fleet.swapped, fleet.turned):
            before = plan.worth()
            step(plan)
            sound(plan)
            assert plan.worth()[0] <= before[0] and (plan.worth()[0] < before[0] or plan.worth()[1] <= before[1] + 1e-6)


def test_a_request_of_many_stops_ends():
    plan = made(300, 12, 7)
    got = fleet.solved(plan)
    sound(got)
    assert got.worth() <= fleet.split_in_order(plan).worth()


def line(request, n):
    """Stops 0..n a step of 10 apart on a line."""
    return [(request, a, b, 10.0 * abs(a - b)) for a in range(n + 1) for b in range(n + 1) if a != b]


def test_requests_in_a_table(spark):
    jobs = [(1, 1, 1.0, 30.0), (1, 2, 1.0, 30.0), (1, 3, 5.0, None), (2, 1, None, None), (3, 4, 1.0, 0.0), (None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (1, 0, 1.0, 1.0), (4, 1, 1.0, 5.0), (1, 1, 1.0, 30.0)]
    vehicles = [(1, 7, 2.0, None), (1, 8, 2.0, None), (2, 1, None, None), (4, 1, 1.0, None), (9, 1, 1.0, 1.0)]
    costs = [*line(1, 3), (2, 0, 1, 4.0), (2, 1, 0, 6.0), (2, 0, 1, 9.0), (2, 0, 1, None), (4, 0, 1, 5.0)]
    steps = fleet.tours(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(vehicles, VEHICLES), spark.createDataFrame(costs, COSTS))
    rows = sorted((tuple(r) for r in steps.collect()), key=str)
    # Both jobs of request 1 fit one vehicle; job 3 fits none; request 3 has no vehicle; in request 4 there is no way back.
    by = {(r[0], r[3]): r for r in rows}
    assert len(rows) == 6
    assert {by[1, 1][1], by[1, 2][1]} in ({7}, {8}) and by[1, 3][1] is None
    assert sorted((by[1, j][2], by[1, j][6]) for j in (1, 2)) == [(1, 1.0), (2, 2.0)]
    assert by[2, 1] == (2, 1, 1, 1, 4.0, 0.0, 0.0)
    assert by[3, 4][1:5] == (None, None, 4, None) and by[4, 1][1] is None
    summary = {(r["request"], r["vehicle"]): (r["n_jobs"], r["way"], r["duration"]) for r in fleet.summaries(steps, spark.createDataFrame(costs, COSTS)).collect()}
    assert summary == {(1, by[1, 1][1]): (2, 40.0, 100.0), (2, 1): (1, 10.0, 10.0)}
    assert sorted((r["leg"], r["a"], r["b"]) for r in fleet.legs(steps).where("request = 2").collect()) == [(1, 0, 1), (2, 1, 0)]


def test_open_tours_end_at_their_last_job(spark):
    jobs, vehicles = [(1, j, 1.0, 0.0) for j in (1, 2, 3)], [(1, 1, None, None)]
    one_way = [(1, a, b, 10.0 * (b - a)) for a in range(4) for b in range(a + 1, 4)]
    args = (spark.createDataFrame(jobs, JOBS), spark.createDataFrame(vehicles, VEHICLES), spark.createDataFrame(one_way, COSTS))
    assert [(r["visit"], r["job"], r["arrival"]) for r in fleet.tours(*args, closed=False).orderBy("visit").collect()] == [(1, 1, 10.0), (2, 2, 20.0), (3, 3, 30.0)]
    assert {r["vehicle"] for r in fleet.tours(*args).collect()} == {None}


def test_no_rows_at_all(spark):
    none = [spark.createDataFrame([], s) for s in (JOBS, VEHICLES, COSTS)]
    steps = fleet.tours(*none)
    assert steps.count() == 0 and fleet.summaries(steps, none[2]).count() == 0 and fleet.legs(steps).count() == 0


def test_requests_are_dealt_out_and_summed_nowhere_before(spark, monkeypatch):
    """Repeated rows and requests cut by batches give the same tours; a task has few requests, and nothing is summed in the one that reads."""
    monkeypatch.setattr(fleet, "TASK_JOBS", 10)
    jobs = [(r, j, 1 + j % 2, 5) for r in range(20) for j in (1, 2, 3)]
    costs = [(r, a, b, float(10 + (a * 7 + b * 3 + r) % 11)) for r in range(20) for a in range(4) for b in range(4) if a != b]
    job = spark.createDataFrame(jobs + [(0, 1, 0, 0), (3, 2, None, None)], "request long, job long, amount long, service long")
    cost = spark.createDataFrame(costs + [(r, a, b, c + 1) for r, a, b, c in costs] + [(1, 0, 1, float("nan"))], "request long, a long, b long, cost double")
    vehicle = spark.createDataFrame([(r, v, 3.0, None) for r in range(20) for v in (1, 2)] + [(2, 1, 1.0, None)], "request long, vehicle long, capacity double, longest double")
    made = fleet.tours(job, vehicle, cost)
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.rdd.getNumPartitions() == 7
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.request, r.job) for r in got) == sorted((r, j) for r, j, _, _ in jobs)
    plain = fleet.tours(spark.createDataFrame(jobs, job.schema), vehicle.where("capacity > 1"), spark.createDataFrame(costs, cost.schema))
    assert sorted(map(str, got)) == sorted(map(str, plain.collect()))
