"""Road and place views over the base tables: positions are whole numbers of 1e-7 degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# {name} stands for a base table: a DataFrame in Spark, the view of that name in the SQL beside a query.
VIEWS = {
    "way_vertices": """SELECT way_id, seq,
        466000000 + (way_id % 120) * 2000 + CASE WHEN way_id % 7 < 4 THEN (seq - 1) * 1000 ELSE 0 END + (l_suppkey % 4) * 60 AS x_e7,
        246000000 + CAST(floor(way_id / 120.0) AS BIGINT) * 2000 + CASE WHEN way_id % 7 < 4 THEN 0 ELSE (seq - 1) * 1000 END + (l_partkey % 4) * 60 AS y_e7
      FROM (SELECT l_orderkey AS way_id, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS BIGINT) AS seq FROM {lineitem}) t""",
    "streets": """SELECT p_partkey AS pkStreetID, p_name AS EnglishName, p_size % 3 AS Direction, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 7 - 1 END AS NoOfLane,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 13 * 10 AS DOUBLE) END AS SpeedLimit, CAST(p_partkey % 6 AS INT) AS FOW, 1 + p_size % 8 AS Subtype, CAST(1 + p_partkey % 13 AS INT) AS fkEmirateID,
        concat('ar ', p_name) AS ArabicName, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('sa ', p_brand) END AS Strar, concat('st ', p_brand) AS Stren, p_size * 0.5 AS Width, CAST(p_partkey % 4 AS INT) AS StreetStat
      FROM {part}""",
    "places": """SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'fire station' WHEN 'BUILDING' THEN 'hospital' WHEN 'FURNITURE' THEN 'clinic' WHEN 'HOUSEHOLD' THEN 'police' ELSE 'other' END AS type,
        concat('Nation ', CAST(c_nationkey AS VARCHAR(9))) AS address, 466000000 + c_custkey * 7919 % 2000000 AS lon_e7, 246000000 + c_custkey * 104729 % 2000000 AS lat_e7
      FROM {customer}""",
    "road_nodes": """SELECT p_partkey AS node, 466000000 + p_partkey % 40 * 50000 AS x_e7, 246000000 + CAST(floor(p_partkey / 40.0) AS BIGINT) * 40000 AS y_e7 FROM {part}""",
    "road_edges": """SELECT p_partkey AS src, p_partkey + 1 AS dst, CAST(1 + p_size % 9 AS BIGINT) AS seconds FROM {part} WHERE p_partkey % 40 < 39
      UNION ALL SELECT p_partkey, p_partkey + 40, CAST(1 + p_size % 11 AS BIGINT) FROM {part}
      UNION ALL SELECT p_partkey + 1, p_partkey, CAST(1 + p_size % 9 AS BIGINT) FROM {part} WHERE p_partkey % 40 < 39 AND p_size % 3 <> 1""",
}
TABLES = ["lineitem", "part", "customer", "orders", "events", "documents", "pages"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql(name: str) -> str:
    """The view as SQL over base views, in brackets."""
    return "(" + VIEWS[name].format(**{t: t for t in TABLES}) + ")"
