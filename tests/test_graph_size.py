"""Steps of the street graph at size: nothing that is costly to make is made twice, and results are those of plain Python."""

import random

from wayloom.operators import components, gridjoin, topology as topo
from wayloom.operators.components import connected_components
from wayloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    pairs = [(1, 3), (2, 3), (7, 7), (8, None), (5, 4)]
    edges = spark.createDataFrame(pairs, "a long, b long").mapInPandas(counted, "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7} and made.value == len(pairs)


def test_graph_is_read_from_written_tables(spark):
    for df in registry._graph(spark, SF):
        assert df.inputFiles() and not any("lineitem" in f for f in df.inputFiles())


def test_near_points_meet_once_and_go_to_few_cells(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(-3000, 3000), rng.randint(-3000, 3000)) for i in range(400)]
    df = spark.createDataFrame(rows, "node_id long, x_e7 long, y_e7 long")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 200**2)
    assert sorted((r.node_a, r.node_b) for r in topo.near_pairs(df, 200).collect()) == want
    # one b in every cell of an a: as many pairs as cells that the a goes to
    a = df.selectExpr("node_id AS node_a", "x_e7 AS ax", "y_e7 AS ay")
    size = gridjoin.WIDE * 200
    assert sum((1 + (x + 200) // size - (x - 200) // size) * (1 + (y + 200) // size - (y - 200) // size) for _, x, y in rows) < 3 * a.count()


def test_ways_are_cleaned_in_one_pass(spark):
    rng = random.Random(9)
    rows = [(w, s, rng.choice([1, 2, 3])) for w in range(300) for s in range(rng.randint(1, 5))] + [(None, 1, 4)]
    ways = spark.createDataFrame(rows, "way_id long, seq long, node_id long")
    for closed in (False, True):
        kept = topo.dedup_consecutive(ways)
        want = kept.join(topo.degenerate_ways(kept, drop_closed=closed), "way_id", "left_anti").select("way_id", "seq", "node_id")
        got = topo.clean_way_nodes(ways, drop_closed=closed)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and 0 < got.count() < kept.count()


def test_merged_nodes_are_counted(spark):
    nodes = spark.createDataFrame([(-1, 0, 0), (-2, 11, 20), (-3, 500, 500)], "node_id long, x_e7 long, y_e7 long")
    labels = spark.createDataFrame([(-1, -2), (-2, -2)], "node long, component long")
    assert sorted(map(tuple, topo.at_mean(nodes, labels).collect())) == [(-3, 500, 500, 1), (-2, 6, 10, 2)]


def test_components_carry_only_what_moves(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    pairs = [(rng.randint(1, 400), rng.randint(1, 400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 760)]
    least = {n: n for p in pairs for n in p}
    for _ in range(len(least)):
        moved = False
        for a, b in pairs:
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
        if not moved:
            break
    written = []
    monkeypatch.setattr(components, "staged", lambda df, name, write=components.staged: written.append((name, write(df, name))) or written[-1][1])
    got = sorted(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == sorted(least.items())
    rounds = [df.count() for name, df in written if name == "step"]
    assert len(rounds) > 2 and [name for name, _ in written].count("follow") == 1 and sum(rounds) < 2 * len(least)
