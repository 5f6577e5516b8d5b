"""Tables: scans, incremental appends, upserts, schema evolution; landing candles of four exchanges; demo adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions.scratch import settle
from barflow.operators.bars import OHLCV, cast_numbers

# The landing columns of each exchange's candles; the time column comes first.
LANDING = {
    "binance": "timestamp long, open string, high string, low string, close string, volume string, close_time long, quote_asset_volume string, number_of_trades long, taker_buy_base_volume string, taker_buy_quote_volume string, ignore string",
    "bybit": "timestamp long, open string, high string, low string, close string, volume string, turnover string",
    "kraken": "time long, open string, high string, low string, close string, volume string",
    "mt5": "time long, open double, high double, low double, close double, tick_volume double",
}
SECONDS = ("kraken", "mt5")


def landing_rows(raw: DataFrame, exchange: str, symbol: Column) -> DataFrame:
    """An exchange's landing rows as (exchange, symbol, datetime, OHLCV); bad numbers are null."""
    time = LANDING[exchange].split()[0]
    stamp = F.timestamp_seconds(F.col(time)) if exchange in SECONDS else F.timestamp_millis(F.col(time))
    df = raw.withColumnRenamed("tick_volume", "volume") if exchange == "mt5" else raw
    return cast_numbers(df.select(F.lit(exchange).alias("exchange"), symbol.alias("symbol"), stamp.cast("timestamp_ntz").alias("datetime"), *OHLCV))


def landing(raw: DataFrame, exchange: str, symbol: Column) -> DataFrame:
    """``landing_rows`` where of a repeated stamp the smallest row stays."""
    rows = landing_rows(raw, exchange, symbol)
    return rows.groupBy("exchange", "symbol", "datetime").agg(F.min(F.struct(*OHLCV)).alias("r")).select("exchange", "symbol", "datetime", "r.*")


def read_landing(spark: SparkSession, path: str, exchange: str, symbol: str, kind: str = "json", **options) -> DataFrame:
    return landing(spark.read.format(kind).schema(LANDING[exchange]).options(**options).load(path), exchange, F.lit(symbol))


def mt5_symbol(name: str) -> str:
    return "NETH25" if name.lower() == "neth" else f"{name.upper()}USD"


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def last_time(spark: SparkSession, path: str, time: str = "datetime"):
    """The largest stamp of a table, None where there is no table: from one column only."""
    return spark.read.parquet(path).agg(F.max(time)).first()[0] if exists(spark, path) else None


def append(df: DataFrame, path: str, time: str | None = "datetime", keys: tuple[str, ...] = (), partition_by: tuple[str, ...] = ()) -> int:
    """Append what is later than the table's last stamp (time), or whose keys it lacks (keys); returns the rows written, counted while they are.

    Lists are kept as arrays; columns may be added (read with mergeSchema).
    """
    spark = df.sparkSession
    if exists(spark, path):
        old = spark.read.option("mergeSchema", "true").parquet(path)
        if keys:
            df = new_rows(df, old, keys)
        elif time and (last := old.agg(F.max(time)).first()[0]) is not None:
            df = df.filter(F.col(time) > F.lit(last))
    if keys:  # of repeated keys the smallest row by the other columns
        rest = [c for c, t in df.dtypes if c not in keys and not t.startswith("map")]
        w = Window.partitionBy(*keys).orderBy(*(rest or keys))
        df = df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    seen = Observation()
    if df.isEmpty():
        return 0
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*partition_by).parquet(path)
    return seen.get["n"]


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...], keys: tuple[str, ...] = (), latest: str | None = None) -> DataFrame:
    """Rows into a table that is partitioned ``by``: with keys, a key is there once, and what is new replaces what was (of new rows the largest ``latest``).

    Only partitions that df has rows of are read and written again; they are known only to the join, never to the driver. The new
    partitions are written beside the table first, so nothing is read from what is being replaced, and then swapped in one job by
    dynamic overwrite. What the table lacks in columns, or df, is null. Returns the rows that were written.
    """
    spark = df.sparkSession
    own = df
    if keys:
        order = [F.col(latest).desc_nulls_last()] if latest else []
        rest = [F.col(c) for c, t in df.dtypes if c not in keys and not t.startswith("map")]
        own = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by, *[k for k in keys if k not in by]).orderBy(*order, *rest))).filter("__n = 1").drop("__n")
    if exists(spark, path):
        old = spark.read.option("mergeSchema", "true").parquet(path)
        touched = own.select(*by).distinct()
        there = old.join(touched, list(by), "left_semi")
        if keys:
            names = list(dict.fromkeys([*by, *keys]))
            there = there.join(own.select(*names), names, "left_anti")
            own = there.unionByName(own, allowMissingColumns=True)
    settled = settle(own)
    settled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return settled


def unique_append(df: DataFrame, path: str, keys: tuple[str, ...] = ("datetime",), by: tuple[str, ...] = ()) -> int:
    """Append rows whose keys the table lacks, and refuse a batch that holds a key twice with different rows; returns the rows written.

    A table without a uniqueness rule of its own keeps one this way: equal rows count once, a key with two different rows is an
    error that names how many there are, and no row is written then.
    """
    twice = df.distinct().groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").count()
    if twice:
        raise ValueError(f"{twice} keys of {', '.join(keys)} have different rows")
    return append(df.distinct(), path, None, keys, by)


def new_rows(df: DataFrame, old: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Insert if absent: rows whose keys are not in old."""
    return df.join(old.select(*keys), list(keys), "left_anti")


def upsert_ignore(df: DataFrame, old: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old and, of df, what it lacks."""
    return old.unionByName(new_rows(df, old, keys), allowMissingColumns=True)


def lists_to_json(df: DataFrame) -> DataFrame:
    lists = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() == "array"}
    return df.withColumns(lists) if lists else df


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def drop_schema(spark: SparkSession, name: str) -> None:
    """With all its tables."""
    spark.sql(f"DROP SCHEMA IF EXISTS `{name}` CASCADE")


def with_columns_of(df: DataFrame, old: DataFrame) -> DataFrame:
    """df in the columns of a table it is to be appended to: what it lacks is null, what it adds comes after them."""
    kinds = dict(old.dtypes)
    lacks = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns}
    return (df.withColumns(lacks) if lacks else df).select(*old.columns, *[c for c in df.columns if c not in kinds])


def write_csv(df: DataFrame, path: str, **options) -> None:
    """Comma-separated with a header, in as many files as there are partitions."""
    df.write.mode("overwrite").options(header=True, **options).csv(path)


def drop_table(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as ticks: (symbol, datetime, event_id, OHLCV of one trade with volume 1)."""
    p = F.col("value").cast("double")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("datetime"), "event_id", p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.lit(1.0).alias("volume")
    )


def config(path: str) -> dict:
    """A YAML file as a dict."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
