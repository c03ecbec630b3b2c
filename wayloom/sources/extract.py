"""Extracts from database tables, cast by their schema; readers by format; tables and views that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .osm import read_geojson

# How columns are named that hold ids of another system.
LEGACY, GUID = "legacyfk", "guid"


def typed(df: DataFrame) -> DataFrame:
    """Decimals become doubles, timestamps epoch milliseconds, legacy keys whole numbers, GUIDs text in braces; others stay."""

    def cast(f: T.StructField):
        c, name = F.col(f"`{f.name}`"), f.name.lower()
        if name.startswith(LEGACY):
            return c.try_cast("long")
        if name.endswith(GUID):
            return F.concat(F.lit("{"), c.cast("string"), F.lit("}"))
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.floor((F.unix_micros(c.cast("timestamp")) + 500) / 1000).cast("long")
        return c

    return df.select(*(cast(f).alias(f.name) for f in df.schema.fields))


def read_table(spark: SparkSession, table: str, options: dict[str, str]) -> DataFrame:
    """A table or a query in brackets of a database, by JDBC; url, user and password come from the caller's options."""
    if "url" not in options:
        raise ValueError("options must name the url")
    return spark.read.format("jdbc").options(**options).option("dbtable", table).load()


def read_streets(spark: SparkSession, path: str, **options) -> DataFrame:
    """Streets from Parquet (a file, a folder or a pattern) or GeoJSON, by the path's ending."""
    bare = path.rstrip("/")
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    if bare.endswith((".geojson", ".json")):
        return read_geojson(spark, path, **options)
    raise ValueError(f"no reader for {path}")


def geometry_kind(df: DataFrame, column: str = "geometry") -> str:
    """"wkb" for bytes, "text" for text, "line" for an array of points, "parts" for an array of those."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BinaryType):
        return "wkb"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.ArrayType):
        return "parts" if isinstance(kind.elementType, T.ArrayType) else "line"
    raise ValueError(f"{column} is no geometry: {kind.simpleString()}")


def require_tables(spark: SparkSession, names: list[str]) -> None:
    """An error that names the tables and views that are missing."""
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")


def swap_view(df: DataFrame, name: str, path: str) -> DataFrame:
    """Writes df to a new folder and lets the view `name` read it: readers see the old rows or the new ones, never both."""
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.createOrReplaceTempView(name)
    return out


def response(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The few rows of an answer as one row (body): {"key": [..]} in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row"))))
    return df.agg(F.to_json(F.struct(F.transform(rows, lambda r: r["row"]).alias(key))).alias("body"))
