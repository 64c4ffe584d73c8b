"""Table access and scratch space for the analytics operators."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant dimension of a few rows, planned as a local relation."""
    return spark.createDataFrame(rows, schema)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir, removed when the driver ends. In local mode an unset folder is one of our own;
    on a cluster it has to be set, as executors share no other."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/tarnlens-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file to any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; its folder is the cluster's to clean
        pass


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
