"""Tables kept in the folder that all executors share (spark.checkpoint.dir): read many times, computed once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many tasks as the session has cores at least: a file of one row group would keep a kernel on one core."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written as Parquet and read again; its lineage ends there, and readers take only the columns they need."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:  # a folder of this machine only in local mode, as in tests
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quirefold-tables")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
