"""Queries of style rules over streets, land and buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import styles
from .registry import STREETS, base, query
from .views import view

LAYERS = {
    "main": (6, 24, ("any", ("==", "Subtype", 1), ("==", "Subtype", 2))),
    "secondary": (10, 24, ("any", ("==", "Subtype", 3), ("==", "Subtype", 4))),
    "other": (13, 24, ("none", ("==", "Subtype", 1), ("==", "Subtype", 2), ("in", "Subtype", 3, 4))),
    "numbered": (15, 20, ("all", ("has", "SpeedLimit"), ("!=", "NoOfLane", None), ("!in", "FOW", 0, 5))),
}


@query(f"""WITH s AS (SELECT *, pkStreetID % 23 AS z FROM {STREETS} q) SELECT pkStreetID AS id, 'main' AS layer FROM s WHERE z >= 6 AND Subtype IN (1, 2)
 UNION ALL SELECT pkStreetID, 'secondary' FROM s WHERE z >= 10 AND Subtype IN (3, 4) UNION ALL SELECT pkStreetID, 'other' FROM s WHERE z >= 13 AND Subtype NOT IN (1, 2, 3, 4)
 UNION ALL SELECT pkStreetID, 'numbered' FROM s WHERE z >= 15 AND z < 20 AND SpeedLimit IS NOT NULL AND NoOfLane IS NOT NULL AND FOW NOT IN (0, 5)""")
def street_layers(spark, sf_dir):
    """The layers that show each street at one zoom."""
    s = view(spark, sf_dir, "streets")
    return styles.in_layers(s, LAYERS, F.col("pkStreetID") % 23).select(F.col("pkStreetID").alias("id"), "layer")


_KINDS = ["tree", "beach", "reef", "canal", "desert", "lake", "spring"]
_COLOURS = " ".join(f"WHEN kind IN ({', '.join(repr(v) for v in labels)}) THEN '{colour}'" for labels, colour in styles.LAND_COLOURS)
_LANDS = [*styles.FLAT_LAND, 6001, 9001]


@query(f"SELECT id, CASE {_COLOURS} ELSE '{styles.LAND_DEFAULT}' END AS colour, CASE WHEN land IN ({', '.join(map(str, styles.FLAT_LAND))}) THEN 0 WHEN floors IS NULL THEN {styles.UNKNOWN_HEIGHT} ELSE floors * {styles.FLOOR_HEIGHT} END AS height FROM (SELECT p_partkey AS id, {_KINDS}[1 + p_partkey % {len(_KINDS)}] AS kind, {_LANDS}[1 + p_partkey % {len(_LANDS)}] AS land, CAST(nullif(p_size % 9, 0) AS BIGINT) AS floors FROM part) b")
def land_styles(spark, sf_dir):
    """Colour by kind of land and height by land type and floors."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (1 + F.col("p_partkey") % len(values)).cast("int"))
    floors = F.nullif(F.col("p_size") % 9, F.lit(0)).cast("long")
    p = base(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick(_KINDS).alias("kind"), pick(_LANDS).alias("land"), floors.alias("floors"))
    return p.select("id", styles.matched(F.col("kind"), styles.LAND_COLOURS, styles.LAND_DEFAULT).alias("colour"), styles.height(F.col("land"), F.col("floors")).alias("height"))
