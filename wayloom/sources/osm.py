"""Map XML and GeoJSON, read and written through Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The order in which a way's tags are written.
TAGS = ["highway", "name", "oneway", "lanes", "maxspeed"]


def way_refs(ways: DataFrame) -> DataFrame:
    """(way_id, refs, n): each way's references in order, comma-joined; ways of one reference go."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda p: p["node_id"].cast("string"))
    return ways.groupBy("way_id").agg(F.array_join(refs, ",").alias("refs"), F.count("*").alias("n")).where("n >= 2")


def _escaped(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _degrees(c: Column) -> Column:
    return F.format_string("%.7f", c / 1e7)


def xml_lines(nodes: DataFrame, ways: DataFrame, tags: DataFrame) -> DataFrame:
    """(kind, id, line): one XML element for each node (kind 0) and way (kind 1); sorted by kind and id they are a document's body.

    A way without tags gets none; blank values are left out; tags has one row for each way_id.
    """
    node = F.concat(F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('" lat="'), _degrees(F.col("y_e7")), F.lit('" lon="'), _degrees(F.col("x_e7")), F.lit('" version="1"/>'))
    n = nodes.select(F.lit(0).alias("kind"), F.col("node_id").alias("id"), node.alias("line"))
    nds = F.array_join(F.transform(F.split("refs", ","), lambda r: F.concat(F.lit('<nd ref="'), r, F.lit('"/>'))), "")
    tag = lambda k: F.when(F.trim(F.col(k)) != "", F.concat(F.lit(f'<tag k="{k}" v="'), _escaped(F.col(k)), F.lit('"/>'))).otherwise("")
    joined = way_refs(ways).join(tags.select("way_id", *TAGS), "way_id", "left")
    way = F.concat(F.lit('<way id="'), F.col("way_id").cast("string"), F.lit('" version="1">'), nds, *(F.coalesce(tag(k), F.lit("")) for k in TAGS), F.lit("</way>"))
    return n.union(joined.select(F.lit(1), "way_id", way))


def write_xml(lines: DataFrame, path: str) -> None:
    """The elements in order as text parts under path, between a head and a foot of their own."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(-1, 0, '<?xml version="1.0" encoding="UTF-8"?><osm version="0.6" generator="wayloom">'), (2, 0, "</osm>")], "kind int, id long, line string")
    lines.union(head).repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").select("line").write.text(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    schema = "_id long, _lat double, _lon double"
    return spark.read.format("xml").option("rowTag", "node").schema(schema).load(path).select(F.col("_id").alias("node_id"), F.floor(F.col("_lon") * 1e7 + 0.5).cast("long").alias("x_e7"), F.floor(F.col("_lat") * 1e7 + 0.5).cast("long").alias("y_e7"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """(way_id, seq, node_id)."""
    schema = "_id long, nd array<struct<_ref:long>>"
    ways = spark.read.format("xml").option("rowTag", "way").schema(schema).load(path)
    return ways.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("seq", "n")).select("way_id", (F.col("seq") + 1).cast("long").alias("seq"), F.col("n._ref").alias("node_id"))


def point_features(df: DataFrame, lon_e7: str, lat_e7: str, properties: list[str]) -> DataFrame:
    """(feature): one GeoJSON point for each row."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon_e7) / 1e7, F.col(lat_e7) / 1e7).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), point.alias("geometry"))).alias("feature"))


def read_geojson(spark: SparkSession, path: str, properties: str, geometry: str = "type string, coordinates array<array<double>>") -> DataFrame:
    """The features of a GeoJSON collection: properties and geometry with the given schemas."""
    schema = f"features array<struct<type:string, properties:struct<{properties}>, geometry:struct<{geometry}>>>"
    schema = schema if ":" in properties else f"features array<struct<type:string, properties:struct<{', '.join(p.strip().replace(' ', ':', 1) for p in properties.split(','))}>, geometry:struct<{', '.join(p.strip().replace(' ', ':', 1) for p in geometry.split(', '))}>>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
