"""Style rules as columns: filters of layers, matches by value, extrusion heights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Colours of land by its subtype, of places by their class, and the heights of buildings.
LAND_COLOURS = [
    (["forest", "tree"], "#add19e"),
    (["grass", "shrub"], "#d8e8c8"),
    (["sand", "beach"], "#e9ddbe"),
    (["rock", "crater", "physical"], "#e0dedb"),
    (["wetland"], "#dbe4e1"),
    (["reef"], "#cadbe3"),
    (["ocean", "lake", "water"], "#aad3df"),
    (["river", "stream", "canal"], "#a0cfdf"),
    (["pond", "reservoir", "spring"], "#b7dae3"),
    (["human_made", "wastewater"], "#adbcc1"),
]
LAND_DEFAULT = "#f1eee8"
CLASS_COLOURS = [(["food_and_drink_stores", "food_and_drink"], "#b64f1b"), (["education"], "#5c4923"), (["store_like"], "#8e5a57")]
CLASS_DEFAULT = "#78553a"
FLAT_LAND, UNKNOWN_HEIGHT, FLOOR_HEIGHT = [5001, 8001, 7002], 4, 3

#: ("==" or "!=", field, value), ("in" or "!in", field, *values), ("has", field), ("all", "any" or "none", *rules).
Rule = tuple


def condition(rule: Rule) -> Column:
    """Whether a row passes a rule, never null: a missing value equals only None; no rule at all lets all pass for all and none, and none for any."""
    kind, *rest = rule
    if kind in ("all", "any", "none"):
        inner = [condition(r) for r in rest]
        if kind == "all":
            return reduce(Column.__and__, inner, F.lit(True))
        some = reduce(Column.__or__, inner, F.lit(False))
        return some if kind == "any" else ~some
    field = F.col(rest[0])
    if kind == "has":
        return field.isNotNull()
    if kind not in ("==", "!=", "in", "!in"):
        raise ValueError(f"no such rule: {kind}")
    found = reduce(Column.__or__, [field.eqNullSafe(F.lit(v)) for v in rest[1:]], F.lit(False))
    return ~found if kind.startswith("!") else found


def matched(value: Column, branches: list[tuple[list, str]], default: str) -> Column:
    """The first branch that lists the value; the default for others and null."""
    return reduce(lambda out, b: F.when(value.isin(b[0]), b[1]).otherwise(out), reversed(branches), F.lit(default))


def height(land: Column, floors: Column) -> Column:
    """Metres by land type and number of floors."""
    return F.when(land.isin(FLAT_LAND), 0).when(floors.isNull(), UNKNOWN_HEIGHT).otherwise(floors * FLOOR_HEIGHT)


def in_layers(df: DataFrame, layers: dict[str, tuple[float, float, Rule]], zoom: Column) -> DataFrame:
    """df with a row for each layer (lowest zoom, first zoom beyond, rule) that shows it at the zoom; rows of none are gone."""
    shown = [F.when((zoom >= low) & (zoom < high) & condition(rule), F.lit(name)) for name, (low, high, rule) in layers.items()]
    return df.withColumn("layer", F.explode(F.array_compact(F.array(*shown))))
