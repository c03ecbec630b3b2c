"""Tables written to the folder that all machines share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines share.

    Only where one machine runs everything may it be unset; a folder of our own is set then. On a cluster that would be
    another folder on each machine, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="wayloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Seconds between two releases on one machine, where steps are short and shuffle files small.
RELEASE_SECONDS = 10.0
_released = 0.0


def _release(spark: SparkSession) -> None:
    """Shuffle files go once nothing on the JVM refers to their plan; a step that is written is done with its own."""
    global _released
    if spark.sparkContext.master.startswith("local[") and time.monotonic() - _released < RELEASE_SECONDS:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read back with df's schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayloom/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing still to run reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_offsets(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds `row_no`: the 0-based place of each row in the order of `keys`, without a window over all rows.

    Rows are range-partitioned and sorted; a partition's offset is the number of rows in the partitions before it,
    and only one row per partition meets in the window that sums them.
    """
    from pyspark.sql import Window as W

    low = (1 << 33) - 1
    placed = staged(
        df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()), name
    ).withColumn("_pid", F.shiftright("_mid", 33))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_pid")) - F.col("_n")).select("_pid", "_before")
    return placed.join(offsets, "_pid").withColumn("row_no", F.col("_before") + F.col("_mid").bitwiseAND(F.lit(low))).drop("_pid", "_mid", "_before")
