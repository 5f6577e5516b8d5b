"""From indicator columns to buy (1), sell (-1) and neutral (0), the look-ahead shift and the majority vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.windows import Series
from barflow.operators.candles import NAMES, add_patterns
from barflow.operators.indicators import INDICATORS, Indicator, add_indicators

SIGNAL = "tinyint"


def price(kind: str) -> Column:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    kinds = {"close": c, "hl2": (h + lo) / 2, "hlc3": (h + lo + c) / 3, "ohlc4": (o + h + lo + c) / 4, "wclprice": (h + lo + 2 * c) / 4}
    return kinds[kind]


def _sign(x: Column) -> Column:
    return F.signum(x).cast(SIGNAL)


def price_cross(x: Column, of: Column) -> Column:
    """Both sides rounded to nine digits, so that sums in another order are no signal."""
    return _sign(F.round(of, 9) - F.round(x, 9))


def zero_cross(x: Column) -> Column:
    return _sign(F.round(x, 9))


def threshold(x: Column, low: float, high: float) -> Column:
    """Buy below low, sell above high; equal levels are a pivot; low above high reverses it."""
    y = F.round(x, 9)
    if low == high:
        out = F.when(y > low, 1).when(y < low, -1).otherwise(0)
    elif low < high:
        out = F.when(y < low, 1).when(y > high, -1).otherwise(0)
    else:
        out = F.when(y > low, 1).when(y < high, -1).otherwise(0)
    return F.when(x.isNotNull(), out).cast(SIGNAL)


def mean_cross(x: Column, s: Series, expanding: bool = False) -> Column:
    """Above the mean of the whole series (or, expanding, of what has been seen) is a buy, else a sell."""
    mean = F.avg(x).over(s.running if expanding else s.whole)
    return F.when(x.isNotNull(), F.when(F.round(x, 9) > F.round(mean, 9), 1).otherwise(-1)).cast(SIGNAL)


def crossing(a: Column, b: Column, s: Series) -> tuple[Column, Column]:
    """(a crosses above b, a crosses below b) at this bar; never at the first one."""
    d = F.round(a - b, 9)
    before = s.lag(d)
    return F.coalesce((d > 0) & (before <= 0), F.lit(False)), F.coalesce((d < 0) & (before >= 0), F.lit(False))


def line_cross(a: Column, b: Column, s: Series) -> Column:
    over, under = crossing(a, b, s)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(over, 1).when(under, -1).otherwise(0)).cast(SIGNAL)


def prev_cross(x: Column, s: Series) -> Column:
    return _sign(F.round(x - s.lag(x), 9))


def bands(upper: Column, lower: Column, close: Column, s: Series) -> Column:
    """The lower band crossing above the price is a buy, the upper one crossing below it a sell."""
    buy, _ = crossing(lower, close, s)
    _, sell = crossing(upper, close, s)
    return F.when(upper.isNotNull() & lower.isNotNull(), F.when(buy, 1).when(sell, -1).otherwise(0)).cast(SIGNAL)


def trend_mode(x: Column) -> Column:
    return F.when(x.isNotNull(), F.when(x == 1, 1).otherwise(-1)).cast(SIGNAL)


def pattern(x: Column) -> Column:
    return F.coalesce(_sign(x), F.lit(0).cast(SIGNAL))


def signal_of(i: Indicator, s: Series) -> Column:
    x = [F.col(c) for c in i.outputs]
    if i.rule == "price_cross":
        return price_cross(x[0], price(i.price))
    if i.rule == "zero_cross":
        return zero_cross(x[0])
    if i.rule == "threshold":
        return threshold(x[0], i.low, i.high)
    if i.rule == "mean_cross":
        return mean_cross(x[0], s)
    if i.rule == "line_cross":
        return line_cross(x[0], x[1], s)
    if i.rule == "prev_cross":
        return prev_cross(x[0], s)
    if i.rule == "bbands":
        return bands(x[0], x[2], F.col("close"), s)
    if i.rule == "trend_mode":
        return trend_mode(x[0])
    raise ValueError(f"{i.name} has no signal rule")


def signals(bars: DataFrame, names: list[str], params: dict | None = None, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """keys, time and a column sig_<name> for each indicator or pattern."""
    names = [n.upper() for n in names]
    indicators, patterns = [n for n in names if n in INDICATORS], [n for n in names if n in NAMES]
    if unknown := set(names) - set(indicators) - set(patterns):
        raise ValueError(f"unknown names: {', '.join(sorted(unknown))}")
    s = Series(keys, time)
    out = add_indicators(bars, {n: {n: v} if (v := (params or {}).get(n)) else {k: x for k, x in (params or {}).items() if not isinstance(x, dict)} for n in indicators}, keys, time)
    out = add_patterns(out, patterns, keys, time) if patterns else out
    made = {f"sig_{n}": signal_of(INDICATORS[n], s) for n in indicators} | {f"sig_{n}": pattern(F.col(n)) for n in patterns}
    return out.withColumns(made).select(*keys, time, *[f"sig_{n}" for n in names])


def working(bars: DataFrame, names: list[str], params: dict | None = None, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> tuple[list[str], dict[str, str]]:
    """(names whose signals can be planned over these bars, name -> why not): unknown ones, bad parameters, missing columns.

    Each name is planned by itself, on the driver and without a job, so one that fails takes no other with it.
    """
    good, bad = [], {}
    for n in names:
        try:
            assert signals(bars, [n], params, keys, time).schema
            good.append(n)
        except Exception as e:  # whatever keeps it from being planned is told
            bad[n] = str(e).strip().split("\n")[0]
    return good, bad


def run_vote_reporting(bars: DataFrame, names: list[str], params: dict | None = None, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> tuple[DataFrame, dict[str, str]]:
    """The vote of those that work, and why the others do not; raises only if none does."""
    good, bad = working(bars, names, params, keys, time)
    if not good:
        raise ValueError(f"no signal works: {bad}")
    return vote(signals(bars, good, params, keys, time), keys, time), bad


def vote(signal_rows: DataFrame, keys: tuple[str, ...] = ("symbol",), time: str = "datetime", model: DataFrame | None = None) -> DataFrame:
    """(keys, time, signals): rows with any null go, every vote is taken from the row before, the first and last row go, the larger camp wins.

    model: (keys, time, signal), one more equal vote, joined on keys and time. A series of fewer than three rows gives none.
    """
    rows = signal_rows
    if model is not None:
        rows = rows.join(model.select(*keys, time, F.col("signal").alias("sig_ML_MODEL")), [*keys, time], "left")
    columns = [c for c in rows.columns if c not in (*keys, time)]
    w = Window.partitionBy(*keys).orderBy(time)
    total = F.signum(sum((F.signum(F.col(c)).cast("int") for c in columns), F.lit(0))).cast("int")
    whole = rows.na.drop(subset=columns).select(*keys, time, total.alias("__now"))
    shifted = whole.withColumns({"signals": F.lag("__now").over(w), "__n": F.row_number().over(w), "__all": F.count("*").over(Window.partitionBy(*keys))})
    return shifted.filter("__all >= 3 AND __n > 1 AND __n < __all").select(*keys, time, "signals")


def run_vote(bars: DataFrame, names: list[str], params: dict | None = None, model: DataFrame | None = None, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    return vote(signals(bars, names, params, keys, time), keys, time, model)


def vote_strategies(bars: DataFrame, strategies: DataFrame, names: list[str], params: dict | None = None, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """(strategy, keys, time, signals) for many strategies in one plan.

    strategies: (strategy, flags map<string, boolean>); names: all that may be flagged. All signals are
    computed once; a strategy sums those it has flagged, so it costs a projection and no pass over the bars.
    """
    wide = signals(bars, names, params, keys, time)
    flags = strategies.select("strategy", F.map_from_entries(F.transform(F.map_entries("flags"), lambda e: F.struct(F.upper(e["key"]), e["value"]))).alias("__flags"))
    met = wide.join(flags, F.lit(True))  # every bar for every strategy is what is asked for
    on = lambda n: F.coalesce(F.try_element_at("__flags", F.lit(n.upper())), F.lit(False))
    missing = F.lit(False)
    total = F.lit(0)
    for n in names:
        x = F.col(f"sig_{n.upper()}")
        missing = missing | (on(n) & x.isNull())
        total = total + F.when(on(n), F.coalesce(x, F.lit(0)).cast("int")).otherwise(0)
    rows = met.filter(~missing).select("strategy", *keys, time, F.signum(total).cast("int").alias("sig_sum"))
    return vote(rows, ("strategy", *keys), time)


def latest(voted: DataFrame, keys: tuple[str, ...] = ("strategy", "symbol"), time: str = "datetime") -> DataFrame:
    return voted.groupBy(*keys).agg(F.max_by("signals", time).alias("signals"), F.max(time).alias(time))


def random_flags(names: list[str], seed: int) -> dict[str, bool]:
    """Each name on or off with equal chance."""
    import random

    r = random.Random(seed)
    return {n: r.random() < 0.5 for n in names}


def normalize_frame(df: DataFrame) -> DataFrame:
    """Lower-case names; timestamp, date or time becomes datetime; raises where a column of a candle is missing."""
    out = df.toDF(*[c.lower() for c in df.columns])
    if "datetime" not in out.columns:
        found = next((c for c in ("timestamp", "date", "time") if c in out.columns), None)
        if found:
            out = out.withColumnRenamed(found, "datetime")
    if missing := [c for c in ("datetime", "open", "high", "low", "close", "volume") if c not in out.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out
