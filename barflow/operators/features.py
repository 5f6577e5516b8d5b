"""Training features: transforms, sentiment and market features, alignment, targets, splits, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.windows import Series, correlation
from barflow.operators.bars import fill, resample
from barflow.operators.quantiles import exact_quantiles

ORDER = "datetime"


def finite(x: Column) -> Column:
    """null instead of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def drop_unsound(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns}).na.drop(subset=columns)


def log_diff(df: DataFrame, prices: list[str], volumes: list[str] = (), keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """Prices as differences of logarithms, volumes of log1p; what is not finite goes."""
    s = Series(keys, time)
    made = {c: F.ln(F.col(c)) - s.lag(F.ln(F.col(c))) for c in prices} | {c: F.log1p(F.col(c)) - s.lag(F.log1p(F.col(c))) for c in volumes}
    return drop_unsound(df.withColumns(made), [*prices, *volumes])


def signed_log_diff(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """Differences of logarithms, of sign(x) ln(|x| + 1) for a column that has values of 0 or less; close also gives log_return."""
    s = Series(keys, time)
    made = {}
    for c in columns:
        x = F.col(c)
        y = F.when(F.min(x).over(s.whole) <= 0, F.signum(x) * F.log1p(F.abs(x))).otherwise(F.ln(x))
        made[f"__{c}"] = y
    df = df.withColumns(made)
    df = df.withColumns({c: F.col(f"__{c}") - s.lag(F.col(f"__{c}")) for c in columns}).drop(*made)
    df = df.withColumn("log_return", F.col("close")) if "close" in columns else df
    return df.na.drop(subset=list(columns))


def z_target(df: DataFrame, target: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The target's z-score over its whole series if its mean size is above 1."""
    w = Window.partitionBy(*keys)
    x = F.col(target)
    scaled = F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))
    return df.withColumn(target, F.when(F.avg(F.abs(x)).over(w) > 1, scaled).otherwise(x))


def robust_scale(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """(x - median) / interquartile range, both exact and of the training rows only; a range of 0 counts as 1."""
    q = exact_quantiles(df.filter(train), {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    scaled = {}
    for c, (low, mid, high) in q.items():
        span = None if low is None else (high - low) or 1.0
        scaled[c] = (F.col(c) - F.lit(mid).cast("double")) / F.lit(span).cast("double")
    return df.withColumns(scaled)


def sentiment_features(hourly: DataFrame, prefix: str, count: str, keys: tuple[str, ...] = (), time: str = "time_window", lags: int = 5) -> DataFrame:
    """One source's hourly features: mean, volatility, volume, momentum, ema, confidence-weighted mean and lags; gaps are 0."""
    from barflow.operators.kernels import ewm

    s = Series(keys or ("__all",), time)
    df = hourly if keys else hourly.withColumn("__all", F.lit(0))
    mean = F.col("mean_sentiment")
    made = {
        f"{prefix}_sentiment_mean": mean,
        f"{prefix}_sentiment_volatility": F.col("std_sentiment"),
        f"{prefix}_volume": F.col(count).cast("double"),
        f"{prefix}_sentiment_momentum": F.coalesce(mean - s.lag(mean), F.lit(0.0)),
        f"{prefix}_confidence_weighted": mean * F.col("sentiment_confidence_mean"),
        f"{prefix}_confidence": F.col("sentiment_confidence_mean"),
    } | {f"{prefix}_lag_{k}": F.coalesce(s.lag(mean, k), F.lit(0.0)) for k in range(1, lags + 1)}
    out = df.withColumns(made).select(*s.keys, time, *made)
    schema = T.StructType([*out.schema.fields, T.StructField(f"{prefix}_sentiment_ema", T.DoubleType())])

    def one(rows):
        rows = rows.sort_values(time)
        return rows.assign(**{f"{prefix}_sentiment_ema": ewm(rows[f"{prefix}_sentiment_mean"].to_numpy(float), 5)})

    out = out.groupBy(*s.keys).applyInPandas(one, schema)
    return out if keys else out.drop("__all")


def combine_sources(posts: DataFrame, comments: DataFrame, time: str = "time_window", weight: float = 0.4) -> DataFrame:
    """Full outer join of both sources, gaps 0; weighted sentiment, total volume, disagreement, volume-weighted confidence."""
    met = posts.join(comments, time, "full_outer").na.fill(0.0)
    p, c = F.col("post_sentiment_mean"), F.col("comment_sentiment_mean")
    pv, cv = F.col("post_volume"), F.col("comment_volume")
    return met.withColumns(
        {
            "sentiment_combined": weight * p + (1 - weight) * c,
            "volume_total": pv + cv,
            "sentiment_disagreement": F.abs(p - c),
            "confidence_combined": F.coalesce(F.try_divide(F.col("post_confidence") * pv + F.col("comment_confidence") * cv, pv + cv), F.lit(0.0)),
        }
    )


def market_features(minute_bars: DataFrame, timeframe: str = "1h", keys: tuple[str, ...] = ("symbol",), time: str = ORDER, ties: tuple[str, ...] = ()) -> DataFrame:
    """Hourly bars labelled with their close time: returns, 10-bar volatility, volume change, 5-bar momentum; undefined is 0."""
    s = Series(keys, time)
    df = resample(minute_bars, timeframe, keys, time, ties)
    c, v = F.col("close"), F.col("volume")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    df = df.withColumns({"returns": zero(F.try_divide(c, s.lag(c)) - 1), "volume_change": zero(F.try_divide(v, s.lag(v)) - 1), "price_momentum": zero(c - s.lag(c, 5))})
    df = df.withColumn("volatility", zero(F.stddev_samp("returns").over(s.last(10))))
    return df.withColumn(time, F.col(time) + F.expr(f"INTERVAL '{timeframe[:-1]}' {'HOUR' if timeframe[-1] == 'h' else 'MINUTE' if timeframe[-1] == 'm' else 'DAY'}"))


def merge_sentiment(bars: DataFrame, sentiment: DataFrame, time: str = ORDER, sentiment_time: str = "time_window", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Each bar with the sentiment of the hour before it, filled forward, then 0; sentiment after the last bar does not count."""
    columns = [c for c in sentiment.columns if c != sentiment_time]
    moved = sentiment.withColumn(time, F.col(sentiment_time) + F.expr("INTERVAL '1' HOUR")).drop(sentiment_time)
    met = fill(bars.join(moved, time, "left"), tuple(columns), keys, time, backward=False)
    return met.na.fill(0.0, subset=columns)


def alpha_features(df: DataFrame, keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """Divergence of sentiment and return, volume spikes, fear/greed and the product of sentiment and volatility."""
    s = Series(keys, time)
    mood = F.col("sentiment_combined")
    before = F.coalesce(F.avg("volume_total").over(s.order.rowsBetween(-10, -1)), F.lit(0.0))
    return df.withColumns(
        {
            "divergence": mood - F.col("returns"),
            "volume_spike": (F.col("volume_total") > 2 * before).cast("int"),
            "fear_greed": mood * F.log1p("volume_total"),
            "sentiment_volatility": mood * F.col("volatility"),
        }
    )


def next_bar_targets(df: DataFrame, close: str = "close", keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """target (1 if the next close is higher) and target_return; the last row of a series goes."""
    s = Series(keys, time)
    after = s.lead(F.col(close))
    made = df.withColumn("__after", after).filter("__after IS NOT NULL")
    return made.withColumns({"target": (F.col("__after") > F.col(close)).cast("int"), "target_return": F.try_divide(F.col("__after"), F.col(close)) - 1}).drop("__after")


def classification_target(df: DataFrame, window: int = 15, threshold: float = 0.003, rare: float = 0.05, keys: tuple[str, ...] = ("symbol",), time: str = ORDER, drop_tail: bool = False) -> DataFrame:
    """1, -1 or 0 by the return ``window`` bars ahead; if under ``rare`` of a series is 0, zeros follow the return's sign. The last rows are 0."""
    s = Series(keys, time)
    change = F.try_divide(s.lead(F.col("close"), window) - F.col("close"), F.col("close"))
    df = df.withColumn("__r", change)
    df = df.withColumn("__t", F.when(F.col("__r") > threshold, 1).when(F.col("__r") < -threshold, -1).otherwise(0))
    few = F.avg((F.col("__t") == 0).cast("double")).over(s.whole) < rare
    df = df.withColumn("target", F.when((F.col("__t") == 0) & few & F.col("__r").isNotNull(), F.when(F.col("__r") >= 0, 1).otherwise(-1)).otherwise(F.col("__t")))
    return (df.filter("__r IS NOT NULL") if drop_tail else df).drop("__r", "__t")


def regression_target(df: DataFrame, window: int = 15, keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """The highest close of this and the next window - 1 bars; null where they are fewer."""
    s = Series(keys, time)
    frame = s.order.rowsBetween(0, window - 1)
    return df.withColumn("target", F.when(F.count("close").over(frame) == window, F.max("close").over(frame)))


def split_by_position(df: DataFrame, shares: tuple[float, ...] = (0.7, 0.15, 0.15), keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """Add ``part`` (0, 1, ..): consecutive shares of each series, never at random."""
    s = Series(keys, time)
    n, at = F.count("*").over(s.whole), F.row_number().over(s.order)
    part, upto = F.lit(len(shares) - 1), 0.0
    cuts = []
    for share in shares[:-1]:
        upto += share
        cuts.append(F.floor(n * F.lit(round(upto, 12))))
    for k in range(len(cuts) - 1, -1, -1):
        part = F.when(at <= cuts[k], k).otherwise(part)
    return df.withColumn("part", part)


def split_date(df: DataFrame, ratio: float, keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """(keys, split): the stamp at position floor(n * ratio)."""
    s = Series(keys, time)
    placed = df.select(*keys, time, F.row_number().over(s.order).alias("__n"), F.floor(F.count("*").over(s.whole) * F.lit(ratio)).alias("__at"))
    return placed.filter("__n = __at + 1").select(*keys, F.col(time).alias("split"))


def train_window(df: DataFrame, split: str, rows: int, keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """The last ``rows`` rows of each series before the split stamp."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    return df.filter(F.col(time) < F.lit(split).cast("timestamp_ntz")).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= rows).drop("__n")


def concat_keep_last(first: DataFrame, second: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Both tables' rows, one a key: the second's before the first's, and of a table's own repeated keys the largest row by its other columns."""
    both = first.withColumn("__o", F.lit(0)).unionByName(second.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.desc("__o"), *[F.desc(c) for c in both.columns if c not in (*by, "__o")])
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__o")


def sequences(df: DataFrame, features: list[str], label: str, length: int, keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """(keys, time, window array of ``length`` feature arrays, label of the last step), full windows only."""
    s = Series(keys, time)
    row = F.array(*[F.col(c).cast("double") for c in features])
    out = df.select(*keys, time, F.collect_list(row).over(s.last(length)).alias("window"), F.col(label).alias("label"))
    return out.filter(F.size("window") == length)


def frequency(df: DataFrame, keys: tuple[str, ...] = ("symbol",), time: str = ORDER) -> DataFrame:
    """(keys, seconds) between the last two stamps."""
    s = Series(keys, time)
    gaps = df.select(*keys, time, F.timestamp_diff("SECOND", s.lag(F.col(time)), F.col(time)).alias("seconds"))
    return gaps.groupBy(*keys).agg(F.max_by("seconds", time).alias("seconds"))


def correlations(df: DataFrame, features: list[str], target: str, most: int = 10) -> DataFrame:
    """(feature, r) of the strongest Pearson correlations with the target; one pass over the rows."""
    one = df.agg(*[correlation(F.col(f), F.col(target)).alias(f) for f in features])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("r")) for f in features])).alias("x")).select("x.*")
    return long.filter("r IS NOT NULL AND NOT isnan(r)").orderBy(F.desc(F.abs("r")), "feature").limit(most)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    total = df.groupBy(target).agg(F.count("*").alias("n"))
    return total.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def class_weights(df: DataFrame, target: str, classes: int = 3) -> DataFrame:
    """1 / count (at least 1), scaled to add up to the number of classes."""
    n = df.groupBy(target).agg((1.0 / F.greatest(F.count("*"), F.lit(1))).alias("w"))
    return n.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))) * classes).drop("w")
