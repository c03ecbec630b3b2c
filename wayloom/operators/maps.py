"""What a map shows: tiles with clipped and quantised points, styles by zoom, labels, and features as GeoJSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A vector tile's grid and the margin around it.
EXTENT, BUFFER = 4096, 64
MAX_LATITUDE = 85.05112877980659


def degrees(e7: Column) -> Column:
    return F.format_string("%.7f", e7 / 1e7)


def feature(geometry: str, coordinates: Column, properties: dict[str, Column]) -> Column:
    """A GeoJSON feature as text; coordinates and property values are JSON text already."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in properties.items()]
    return F.concat(F.lit('{"type":"Feature","properties":{'), F.concat_ws(",", *parts), F.lit(f'}},"geometry":{{"type":"{geometry}","coordinates":'), coordinates, F.lit("}}"))


def position(x: Column, y: Column) -> Column:
    return F.concat(F.lit("["), degrees(x), F.lit(","), degrees(y), F.lit("]"))


def path(positions: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *positions), F.lit("]"))


def tile_points(points: DataFrame, zoom: int, keep: list[str], lon: str = "lon_e7", lat: str = "lat_e7") -> DataFrame:
    """(keep.., x, y, px, py): each point in every tile whose box, widened by the buffer, holds it; px, py count from the tile's corner."""
    n = float(1 << zoom)
    r = F.radians(F.col(lat) / 1e7)
    gx = F.floor((F.col(lon) / 1e7 + 180.0) / 360.0 * n * EXTENT).cast("long")
    gy = F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * n * EXTENT).cast("long")
    placed = points.where(F.abs(F.col(lat)) <= MAX_LATITUDE * 1e7).select(*keep, gx.alias("gx"), gy.alias("gy"))
    span = lambda g: F.sequence(F.greatest(F.floor((F.col(g) - BUFFER) / F.lit(EXTENT)), F.lit(0)), F.least(F.floor((F.col(g) + BUFFER) / F.lit(EXTENT)), F.lit((1 << zoom) - 1)))
    spread = placed.withColumn("x", F.explode(span("gx"))).withColumn("y", F.explode(span("gy")))
    return spread.select(*keep, "x", "y", (F.col("gx") - F.col("x") * EXTENT).alias("px"), (F.col("gy") - F.col("y") * EXTENT).alias("py"))


def interpolated(zoom: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between the stops (zoom, value), constant beyond the outer ones."""
    out = F.lit(float(stops[-1][1]))
    for (z0, v0), (z1, v1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(zoom < z1, v0 + (zoom - z0) / (z1 - z0) * (v1 - v0)).otherwise(out)
    return F.when(zoom <= stops[0][0], float(stops[0][1])).otherwise(out)


def stepped(zoom: Column, first: float, stops: list[tuple[float, float]]) -> Column:
    """first below the first stop, then each stop's value from its zoom on."""
    out = F.lit(float(first))
    for z, v in stops:
        out = F.when(zoom >= z, float(v)).otherwise(out)
    return out


def label(name: Column) -> Column:
    """A property's name for people: parts of snake_case and camelCase as words with a capital."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\s]+", " ")
    return F.initcap(F.trim(spaced))


def properties(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, rank, label, value): the columns that are not null, in the order of their names."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in sorted(columns)))
    shown = F.filter(pairs, lambda p: p["value"].isNotNull())
    each = df.select(key, F.posexplode(shown).alias("rank", "p"))
    return each.select(key, (F.col("rank") + 1).cast("long").alias("rank"), label(F.col("p.name")).alias("label"), F.col("p.value").alias("value"))


def floor_extrusion(height: Column, floors: Column, floor: Column) -> tuple[Column, Column]:
    """Base and top of a floor of a building: its share of the height; null where the building has no floors."""
    each = F.try_divide(height, floors)
    return each * floor, each * (floor + 1)


def location(df: DataFrame, column: str = "location") -> tuple[Column, Column]:
    """Longitude and latitude of a location: a struct of lon and lat, or text "lat,lon"; null where it is neither."""
    if df.schema[column].dataType.typeName() == "struct":
        return F.col(f"{column}.lon").cast("double"), F.col(f"{column}.lat").cast("double")
    parts = F.split(F.col(column).cast("string"), ",")
    two = F.size(parts) == 2
    number = lambda i: F.when(two, F.trim(F.get(parts, F.lit(i))).try_cast("double"))
    return number(1), number(0)
