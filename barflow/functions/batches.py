"""How many rows Spark hands Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Whole texts can be long: hand them to Python in batches of so many rows, and about so many bytes, at most."""
    now = int(spark.conf.get(ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(ROWS, str(rows))
    spark.conf.set(BYTES, str(size))
