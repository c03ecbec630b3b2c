"""Fuzzy search over several text fields, and nearest facilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import haversine_km

TYPES = ["fire station", "hospital", "clinic", "police"]
OVERFETCH = 3


def edits(term: Column) -> Column:
    """Edits allowed by the length of a term: none to 2 letters, one to 5, two beyond."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def fuzzy_search(df: DataFrame, key: str, fields: dict[str, float], query: str, size: int = 20) -> DataFrame:
    """(key, score): the best field's boosted share of query terms matched, an edit costing part of a term; top `size`.

    Every word of a row's fields is compared with the few terms of the query, in one pass without a shuffle before the
    top rows; rows without a match do not come.
    """
    terms = list(dict.fromkeys(query.lower().split()))
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    per_field = []
    for field, boost in fields.items():
        words = F.filter(F.split(F.lower(F.coalesce(F.col(field).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        gained = []
        for t in terms:
            allowed = edits(F.lit(t))
            gained.append(_term_score(words, t, allowed))
        per_field.append(sum(gained[1:], gained[0]) * F.lit(boost / len(terms)))
    score = F.greatest(*per_field) if len(per_field) > 1 else per_field[0]
    return df.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(size)


def _term_score(words: Column, term: str, allowed: Column) -> Column:
    d = F.array_min(F.transform(words, lambda w: F.levenshtein(w, F.lit(term))))
    return F.when(d <= allowed, 1.0 - d / F.lit(float(len(term) + 1))).otherwise(0.0)


def nearest_places(places: DataFrame, lon: float, lat: float, kind: str, limit: int = 5, radius_km: float = 5.0) -> DataFrame:
    """The OVERFETCH * limit places of a type nearest by metres within the radius: id, name, type, address, distance_m."""
    kind = kind.strip().lower()
    if kind not in TYPES:
        raise ValueError(f"type must be one of {TYPES}")
    if not (-180 <= lon <= 180 and -90 <= lat <= 90 and 1 <= limit <= 10 and 1 <= radius_km <= 20):
        raise ValueError("a parameter is out of range")
    km = haversine_km(F.lit(lon), F.lit(lat), F.col("lon_e7") / 1e7, F.col("lat_e7") / 1e7)
    near = places.where(F.lower("type") == kind).select("id", "name", "type", "address", F.round(km * 1000, 2).alias("distance_m"))
    return near.where(F.col("distance_m") <= radius_km * 1000).orderBy("distance_m", "id").limit(OVERFETCH * limit)


def rank_facilities(near: DataFrame, seconds: DataFrame, limit: int) -> DataFrame:
    """Candidates with a travel time (id, seconds), nearest in time first; those that cannot be reached go."""
    met = near.join(seconds.where("seconds IS NOT NULL"), "id")
    return met.select("id", "name", "distance_m", "seconds", F.round(F.col("seconds") / 60, 1).alias("minutes")).orderBy("seconds", "distance_m", "id").limit(limit)
