"""Written tables that cut the lineage of iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where spark.checkpoint.dir is unset, as in tests.
LOCAL = "/tmp/checkpoints/graphloom"


def folder(spark: SparkSession) -> str:
    """The path of a new folder that all executors share.

    It is below is spark.checkpoint.dir, or else the context's checkpoint folder. Without either, a local folder serves
    where the executors run in this process; elsewhere that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL
    return f"{base.rstrip('/')}/graph-{sc.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a folder that all executors share; a lost executor costs no recomputation of df."""
    spark: SparkSession = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df dealt to a number of tasks that does not depend on its bytes: small rows of which much is made are not put together in one.
    With the number of rows, a task gets some million of them at most."""
    spark: SparkSession = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-rows // 1_000_000)), *keys)
