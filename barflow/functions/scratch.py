"""Tables written on the way: they cut lineage, are read as often as wanted, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or set on the context); without one only a local master goes on, in a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barflow-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written for them."""
    path = f"{scratch_root(df.sparkSession)}/barflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
