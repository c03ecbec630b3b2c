"""Binary geometries of a table: their types, their lines part by part, repaired, and what is lost on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, wkb


def type_counts(df: DataFrame, geometry: str) -> DataFrame:
    """(geometry_type, n) by the headers alone; null, unknown and too short ones are one null type."""
    return df.groupBy(wkb.geometry_type(F.col(geometry)).alias("geometry_type")).agg(F.count("*").alias("n"))


def _parts(df: DataFrame, geometry: str) -> DataFrame:
    made = {"part", "line"} & set(df.columns)
    if made:
        raise ValueError(f"rename {sorted(made)}: these columns are made")
    parts = df.withColumn(geometry, wkb.to_parts(geometry))
    return parts.select(*(c for c in df.columns if c != geometry), F.posexplode(geometry).alias("part", "line")).withColumn("line", geo.repaired(F.col("line")))


def clean_parts(df: DataFrame, geometry: str) -> DataFrame:
    """df with a row for each part of its lines: part (from 0 in the geometry) and line in place of the binary.

    Points that are missing or not finite and repeats are taken out; parts with fewer than two points left, geometries
    that are null, empty, broken or no lines have no row. Other columns stay; one named part or line is an error.
    """
    return _parts(df, geometry).where("line IS NOT NULL")


def losses(df: DataFrame, geometry: str) -> DataFrame:
    """One row: rows, those that are null, those not null that could not be read as lines, parts, parts too short, parts kept."""
    c = F.col(geometry)
    read = df.select(c.isNull().alias("missing"), wkb.to_parts(c).alias("parts"))
    fixed = read.select("missing", F.col("parts").isNull().alias("unread"), F.size(F.coalesce("parts", F.array().cast(wkb.PARTS))).alias("n"), F.transform("parts", lambda p: geo.repaired(p)).alias("fixed"))
    kept = F.size(F.filter(F.coalesce("fixed", F.array().cast(wkb.PARTS)), lambda p: p.isNotNull()))
    total = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    count = lambda e: F.count_if(e)
    return fixed.agg(F.count("*").alias("n_rows"), count(F.col("missing")).alias("n_null"), count(F.col("unread") & ~F.col("missing")).alias("n_unread"), total(F.col("n")).alias("n_parts"), total(F.col("n") - kept).alias("n_short"), total(kept).alias("n_kept"))
