"""Candles: casting, cleaning, minute grids, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")
# Minutes of the timeframes.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440}
GRID = ("1m", "5m", "15m", "1h")
LARGEST_GRID = 10_000_000


def minutes_of(timeframe: str) -> int:
    """Any <n>m, <n>h or <n>d."""
    try:
        return int(timeframe[:-1]) * {"m": 1, "h": 60, "d": 1440}[timeframe[-1]]
    except (KeyError, ValueError, IndexError):
        raise ValueError(f"timeframe {timeframe!r} is not <n>m, <n>h or <n>d") from None


def cast_numbers(df: DataFrame, columns: tuple[str, ...] = OHLCV) -> DataFrame:
    """Columns as doubles; what is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def to_datetime(df: DataFrame, column: str) -> Column:
    """Timestamps as they are, numbers as epoch milliseconds, text parsed or null; always without a time zone, in UTC."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind.startswith("timestamp"):
        return c.cast("timestamp_ntz")
    if kind in ("bigint", "int", "double", "float", "smallint") or kind.startswith("decimal"):
        return F.timestamp_millis(c.cast("long")).cast("timestamp_ntz")
    return c.try_cast("timestamp_ntz")


def parse_date(c: Column) -> Column:
    """Two formats, the longer first."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def first_of(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row a key: the first in the given order (name all ties)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def fill(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("symbol",), time: str = "datetime", backward: bool = True) -> DataFrame:
    """The last known value, else (backward) the next."""
    # once the last known value is taken only a series' head is open, and there the next one is the series' first: same order, no second sort
    order = Window.partitionBy(*keys).orderBy(time)
    past, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = lambda c: F.last(c, ignorenulls=True).over(past)
    one = lambda c: F.coalesce(known(c), F.first(c, ignorenulls=True).over(whole)) if backward else known(c)
    return df.withColumns({c: one(c) for c in columns})


def clean(raw: DataFrame, interval: str = "1m", keys: tuple[str, ...] = ("symbol",), time: str = "datetime", ties: tuple[str, ...] = ()) -> DataFrame:
    """Regular, gap-filled candles: numbers cast, one row a stamp, a grid from first to last stamp, filled forward then backward.

    Rows off the grid vanish. A series whose grid would be larger than LARGEST_GRID keeps its own stamps.
    """
    if interval not in GRID:
        raise ValueError(f"interval {interval!r} is not one of {', '.join(GRID)}")
    rows = cast_numbers(raw.withColumn(time, to_datetime(raw, time))).filter(F.col(time).isNotNull())
    rows = first_of(rows, (*keys, time), ties or OHLCV).select(*keys, time, *OHLCV)
    step = F.make_dt_interval(mins=F.lit(MINUTES[interval]))
    span = rows.groupBy(*keys).agg(F.min(time).alias("__first"), F.max(time).alias("__last"))
    steps = F.timestamp_diff("MINUTE", F.col("__first"), F.col("__last")) / MINUTES[interval]
    grid = span.filter(steps <= LARGEST_GRID).select(*keys, F.explode(F.sequence("__first", "__last", step)).alias(time))
    large = rows.join(span.filter(steps > LARGEST_GRID).select(*keys), list(keys), "left_semi").select(*keys, time)
    return fill(grid.unionByName(large).join(rows, [*keys, time], "left"), OHLCV, keys, time)


def floor_to(time: str, timeframe: str) -> Column:
    """The start of a timestamp's bucket, aligned to the epoch; stays without time zone."""
    return F.window(time, f"{minutes_of(timeframe)} minutes")["start"]


def resample(rows: DataFrame, timeframe: str, keys: tuple[str, ...] = ("symbol",), time: str = "datetime", ties: tuple[str, ...] = ()) -> DataFrame:
    """OHLCV buckets, closed and labelled left; a partial bucket at a series' start goes, one at its end stays; empty ones don't exist.

    Nulls count neither as first nor as last. Map-side aggregation: one small row a bucket is exchanged.
    """
    at = F.struct(time, *ties)
    picked = lambda f, c: f(c, F.when(F.col(c).isNotNull(), at))
    rows = rows.withColumn("__bucket", floor_to(time, timeframe))
    out = rows.groupBy(*keys, "__bucket").agg(
        picked(F.min_by, "open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), picked(F.max_by, "close").alias("close"), F.sum("volume").alias("volume"), F.min(time).alias("__from")
    )
    first = Window.partitionBy(*keys)
    out = out.withColumn("__first", F.min("__from").over(first)).filter(F.col("__bucket") >= F.col("__first"))
    return out.select(*keys, F.col("__bucket").alias(time), *OHLCV)


def resample_last(rows: DataFrame, timeframe: str, column: str = "close", keys: tuple[str, ...] = ("symbol",), time: str = "datetime", ties: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*keys, floor_to(time, timeframe).alias(f"__{time}")).agg(F.max_by(column, F.struct(time, *ties)).alias(column)).withColumnRenamed(f"__{time}", time)


def range_scan(rows: DataFrame, start=None, end=None, limit: int | None = None, time: str = "datetime", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows from start to end, both inclusive; of these the last ``limit``, in order."""
    if start is not None:
        rows = rows.filter(F.col(time) >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col(time) <= F.lit(end))
    if limit is not None:
        rows = rows.orderBy(F.desc(time), *[F.desc(t) for t in ties]).limit(limit)
    return rows.orderBy(time, *ties)


def needed_history(window: int, target: str, base: str = "1m", factor: int = 3) -> int:
    """Base bars that a window of target bars needs."""
    return factor * window * minutes_of(target) // minutes_of(base)
