"""Street attributes to map tags, on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Road classes by subtype, for links (form of way 3 and 4) and for other roads.
LINK_FORMS = [3, 4]
LINKS = {1: "trunk_link", 2: "primary_link", 3: "secondary_link"}
SHORT = {1: "trunk", 2: "primary"}
FULL = {1: ("trunk", "trunk"), 2: ("primary", "primary"), 3: ("secondary", "primary"), 4: ("tertiary", "secondary"), 5: ("tertiary", "tertiary"), 6: ("residential", "residential"), 7: ("footway", "footway")}
WIDE_LANES = 3
DEFAULTS = {"name": "unknown", "highway": "road", "oneway": "no", "lanes": "1"}
# Surfaces and the closed one by street status, the form of a roundabout, and the tags of names.
SURFACES = {2: "gravel", 3: "dirt"}
CLOSED = 3
ROUNDABOUT = 1
NAMES = {"ArabicName": "name:ar", "EnglishName": "name", "Strar": "name:ar1", "Stren": "name:en1"}


def _coded(col: Column, names: dict, other: Column) -> Column:
    out = other
    for k, v in reversed(names.items()):
        out = F.when(col == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def oneway(direction: Column) -> Column:
    return F.when(direction == 1, "yes").otherwise("no")


def lanes(n: Column) -> Column:
    return F.when(n.isNull() | (n <= 0), "1").otherwise(n.cast("string"))


def maxspeed(speed: Column) -> Column:
    """Kept where it rounds to a positive number."""
    return F.when(F.round(speed).cast("int") > 0, speed.cast("string"))


def highway_short(form: Column, subtype: Column) -> Column:
    return F.when(form.isin(LINK_FORMS), _coded(subtype, LINKS, F.lit("tertiary_link"))).otherwise(_coded(subtype, SHORT, F.lit("road")))


def highway_full(form: Column, subtype: Column, n_lanes: Column) -> Column:
    """Classes where a road of more than WIDE_LANES lanes ranks one higher."""
    full = {k: F.when(n_lanes > WIDE_LANES, wide).otherwise(narrow) for k, (narrow, wide) in FULL.items()}
    return F.when(form.isin(LINK_FORMS), _coded(subtype, LINKS, F.lit("tertiary_link"))).otherwise(_coded(subtype, full, F.lit("road")))


def ingest(streets: DataFrame, region: int | None = None) -> DataFrame:
    df = streets if region is None else streets.where(F.col("fkEmirateID") == region)
    c = F.col
    return df.select(c("pkStreetID").alias("orig_id"), c("EnglishName").alias("name"), oneway(c("Direction")).alias("oneway"), lanes(c("NoOfLane")).alias("lanes"), maxspeed(c("SpeedLimit")).alias("maxspeed"), highway_short(c("FOW"), c("Subtype")).alias("highway"))


def access(status: Column) -> Column:
    return F.when(status == CLOSED, "no").otherwise("yes")


def _names() -> list[Column]:
    return [F.col(c).alias(tag) for c, tag in NAMES.items()]


def _complete(streets: DataFrame) -> DataFrame:
    """streets with the columns that tags come from; those that a table lacks are null."""
    lacking = {c: F.lit(None).cast("string" if c in NAMES else "int") for c in (*NAMES, "Width", "StreetStat") if c not in streets.columns}
    return streets.withColumns(lacking) if lacking else streets


def full_tags(streets: DataFrame) -> DataFrame:
    """Tags of every street; access and surface come from its status. Columns that the table lacks count as null."""
    c, streets = F.col, _complete(streets)
    return streets.select(
        c("pkStreetID").alias("id"), *_names(), c("Width").alias("width"), F.coalesce(c("NoOfLane"), F.lit(1)).cast("string").alias("lanes"), c("SpeedLimit").cast("string").alias("maxspeed"), oneway(c("Direction")).alias("oneway"),
        F.when(c("FOW") == ROUNDABOUT, "roundabout").alias("junction"), access(c("StreetStat")).alias("access"), _coded(c("StreetStat"), SURFACES, F.lit("asphalt")).alias("surface"),
        highway_full(c("FOW"), c("Subtype"), c("NoOfLane")).alias("highway"))


def safe_int(text: Column) -> Column:
    """The whole part of a number in text, towards zero; null where there is none."""
    return F.trim(text).try_cast("double").try_cast("long")


def safe_tags(streets: DataFrame) -> DataFrame:
    """Tags from text columns; what cannot be read counts as missing, and a speed of zero too."""
    streets = _complete(streets)
    n, speed, form, sub, status = (safe_int(F.col(k).cast("string")) for k in ("NoOfLane", "SpeedLimit", "FOW", "Subtype", "StreetStat"))
    return streets.select(
        F.col("pkStreetID").alias("id"), *_names(), F.col("Width").alias("width"), oneway(safe_int(F.col("Direction"))).alias("oneway"), lanes(n).alias("lanes"), F.when(F.coalesce(speed, F.lit(0)) != 0, speed.cast("string")).alias("maxspeed"),
        F.when(form == ROUNDABOUT, "roundabout").alias("junction"), access(status).alias("access"), _coded(status, SURFACES, F.lit("asphalt")).alias("surface"), highway_full(form, sub, n).alias("highway"))


def with_defaults(tags: DataFrame) -> DataFrame:
    return tags.na.fill(DEFAULTS)
