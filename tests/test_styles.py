"""Style rules on rows with missing values, against plain Python."""

import pytest
from pyspark.sql import functions as F

from wayloom.operators import styles


def passes(rule, row) -> bool:
    kind, *rest = rule
    if kind in ("all", "any", "none"):
        held = [passes(r, row) for r in rest]
        return {"all": all(held), "any": any(held), "none": not any(held)}[kind]
    if kind == "has":
        return row[rest[0]] is not None
    return (row[rest[0]] in rest[1:]) != kind.startswith("!")


def test_rules_are_never_null(spark):
    rows = [{"id": i, "a": a, "b": b} for i, (a, b) in enumerate([(1, "x"), (2, None), (None, "y"), (None, None), (1, "x")])]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, a long, b string")
    leaves = [("==", "a", 1), ("!=", "a", 1), ("==", "a", None), ("in", "b", "x", "y"), ("!in", "b", "x"), ("in", "b"), ("has", "b")]
    rules = [*leaves, ("all",), ("any",), ("none",), ("any", *leaves[:2]), ("none", leaves[0], leaves[3]), ("all", ("none", leaves[4]), leaves[6])]
    got = df.select("id", *(styles.condition(r).alias(f"r{i}") for i, r in enumerate(rules))).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(passes(r, rows[g.id]) for r in rules) for g in got]
    with pytest.raises(ValueError):
        styles.condition(("like", "a", 1))


def test_layers_colours_and_heights(spark):
    df = spark.createDataFrame([(1, 5, "tree", 5001, 3), (2, 5, None, 1, None), (3, 12, "gone", None, 2), (4, None, "lake", 1, 0)], "id long, zoom int, kind string, land int, floors int")
    layers = {"low": (0, 10, ("has", "kind")), "all": (5, 12, ("all",))}
    assert sorted((r.id, r.layer) for r in styles.in_layers(df, layers, F.col("zoom")).collect()) == [(1, "all"), (1, "low"), (2, "all")]
    got = df.orderBy("id").select(styles.matched(F.col("kind"), styles.LAND_COLOURS, styles.LAND_DEFAULT), styles.height(F.col("land"), F.col("floors"))).collect()
    assert [tuple(r) for r in got] == [("#add19e", 0), ("#f1eee8", 4), ("#f1eee8", 6), ("#aad3df", 0)]
    assert styles.in_layers(df.limit(0), layers, F.col("zoom")).count() == 0
