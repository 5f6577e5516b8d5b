"""Look-up joins, ranges, the final selection of features, and small rules on strategies, orders and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.scratch import settle
from barflow.operators.bars import resample


def price_lookup(rows: DataFrame, minutes: DataFrame, timeframe: str = "1h", price: str = "close", out: str = "actual_price", keys: tuple[str, ...] = ("symbol",), time: str = "datetime", ties: tuple[str, ...] = ()) -> DataFrame:
    """Each row with the raw price of its bar; null where there is none. One exchange by key and time, whatever the number of rows."""
    bars = resample(minutes, timeframe, keys, time, ties).select(*keys, time, F.col(price).alias(out))
    return rows.join(bars, [*keys, time], "left")


def value_lookup(rows: DataFrame, values: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Each row with the value that another series has at its stamp, null where it has none; of repeated stamps the smallest value."""
    one = values.groupBy(*keys, time).agg(F.min(value).alias(out))
    return rows.join(one, [*keys, time], "left")


def join_indicators(features: DataFrame, indicators: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Features with indicator columns by key and time; what is missing is 0."""
    met = features.join(indicators.select(*keys, time, *columns), [*keys, time], "left")
    return met.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def date_range(first: DataFrame, second: DataFrame, time: str = "time_window") -> DataFrame:
    """One row (start_date, end_date) over two tables; an empty one does not count."""
    both = first.select(time).unionByName(second.select(time))
    return both.agg(F.min(time).alias("start_date"), F.max(time).alias("end_date"))


def final_selection(df: DataFrame, features: list[str], targets: list[str], keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Keys, time, features, targets: columns that do not exist are 0, null features are 0, a key and time is there once (its smallest row)."""
    given = df.withColumns({c: F.lit(0) for c in (*features, *targets) if c not in df.columns})
    rows = given.select(*keys, time, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in features], *targets)
    w = Window.partitionBy(*keys, time).orderBy(*features, *targets)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def close_only(df: DataFrame) -> DataFrame:
    """Without open, high and low, which say nothing a close does not once it is a return."""
    return df.drop("open", "high", "low")


def floor_to_step(quantity: Column, step: float) -> Column:
    """A quantity cut to whole lot steps, towards 0."""
    whole = F.when(quantity < 0, F.ceil(quantity / step)).otherwise(F.floor(quantity / step))
    return whole * F.lit(float(step))


def numbered(df: DataFrame, by: str, order: tuple[str, ...], out: str) -> DataFrame:
    """Add ``out``: a row's place in its group by ``order``, from 1 on, without a group in one task.

    Rows are dealt by ranges of (by, order) and written with the number of their range; places within a range are counted
    there, and what comes before a range is the sum of the counts of those before it, a row a group and range.
    """
    rows = settle(df.repartitionByRange(F.col(by), *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()))
    counts = rows.groupBy(by, "__part").agg(F.count("*").alias("__rows"))
    along = Window.partitionBy(by).orderBy("__part")
    before = counts.select(F.col(by).alias("__by"), F.col("__part").alias("__at"), (F.sum("__rows").over(along) - F.col("__rows")).alias("__before"))
    inside = Window.partitionBy(by, "__part").orderBy(*order)
    met = rows.withColumn("__n", F.row_number().over(inside)).join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__at")))
    return met.withColumn(out, F.col("__n") + F.col("__before")).drop("__part", "__by", "__at", "__before", "__n")


def strategy_ids(strategies: DataFrame, order: tuple[str, ...], timeframe: str = "timeframe", symbol: str = "symbol", last: dict[str, int] | None = None) -> DataFrame:
    """Add ``strategy``: sig_<timeframe>_<symbol>_<n>, n counting on by timeframe from ``last``."""
    start = F.coalesce(*([F.try_element_at(F.create_map(*[F.lit(x) for kv in last.items() for x in kv]), F.col(timeframe))] if last else []), F.lit(0))
    placed = numbered(strategies, timeframe, order, "__place")
    return placed.withColumn("strategy", F.concat_ws("_", F.lit("sig"), F.col(timeframe), F.lower(symbol), (start + F.col("__place")).cast("string"))).drop("__place")


#: How the names of parameters end that are lengths of windows.
WINDOW_ENDS = ("_period", "_fastperiod", "_slowperiod", "_signalperiod", "_slowd_period", "_slowk_period", "_fastk_period")


def strategy_analysis(strategies: DataFrame, flags: str = "flags", params: str = "params") -> DataFrame:
    """(strategy, active_flags sorted, max_window: the largest parameter that is a window's length, null without any)."""
    windows = F.map_values(F.map_filter(params, lambda k, v: F.coalesce(k.rlike(f"({'|'.join(WINDOW_ENDS)})$"), F.lit(False)) & v.isNotNull()))
    active = F.sort_array(F.map_keys(F.map_filter(flags, lambda k, v: F.coalesce(v, F.lit(False)))))
    return strategies.select("strategy", active.alias("active_flags"), F.array_max(windows).alias("max_window"))


def softmax(scores: Column) -> Column:
    """An array of scores as probabilities."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def class_of(scores: Column, first: int = -1) -> Column:
    """The class with the highest score, counted from ``first``; the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1 + first).cast("int")
