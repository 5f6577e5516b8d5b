"""Tumbling bars, late data, duplicates and the live position machine on streams.

Sliding windows of indicators are windows over rows, which streams do not have: live
signals are made in foreachBatch over a bounded history of bars (``latest_signals``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators.bars import minutes_of, needed_history
from barflow.operators.indicators import INDICATORS, window_of


def stream_bars(ticks: DataFrame, timeframe: str, delay: str = "0 seconds", keys: tuple[str, ...] = ("symbol",), time: str = "datetime", ties: tuple[str, ...] = ()) -> DataFrame:
    """Bars of a stream: a bucket is emitted once the watermark has passed it; later ticks are dropped."""
    at = F.struct(time, *ties)
    w = F.window(time, f"{minutes_of(timeframe)} minutes")
    out = ticks.withWatermark(time, delay).groupBy(*keys, w.alias("w")).agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"))
    return out.select(*keys, F.col("w.start").alias(time), "open", "high", "low", "close", "volume")


def stream_once(rows: DataFrame, by: tuple[str, ...], time: str = "datetime", delay: str = "1 hour") -> DataFrame:
    """The first of rows with equal keys within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(by))


def wanted_position(position: int, signal: int) -> tuple[int, str]:
    """(position after, action): open, hold, reverse or nothing; a neutral signal changes nothing."""
    if not signal or signal == position:
        return position, "hold" if position else "none"
    return signal, "reverse" if position else "open"


ACTIONS = "symbol string, datetime timestamp, signal int, position int, action string, entry_price double, pnl double, pnl_sum double"
_STATE = "position int, entry double, pnl_sum double"


def positions(signals: DataFrame, take: float = 3.0, stop: float = 1.0) -> DataFrame:
    """A stream of (symbol, datetime, signal, price, closed) as actions; state: one position a symbol.

    closed: the exchange has closed the position (its take-profit or stop-loss order was filled).
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position, entry, total = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(batches)).sort_values("datetime").itertuples(index=False):
            pnl = None
            if r.closed and position:
                pnl = (r.price - entry) / entry * 100 * position
                total, position = total + pnl, 0
                out.append((key[0], r.datetime, int(r.signal), 0, "closed", entry, pnl, total))
            after, action = wanted_position(position, int(r.signal))
            pnl = None
            if action == "reverse":
                pnl = (r.price - entry) / entry * 100 * position
                total += pnl
            if action in ("open", "reverse"):
                entry = float(r.price)
            position = after
            if action != "none":
                out.append((key[0], r.datetime, int(r.signal), position, action, entry, pnl, total))
        state.update((position, entry, total))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ACTIONS.split(", ")])

    return signals.groupBy("symbol").applyInPandasWithState(step, ACTIONS, _STATE, "append", GroupStateTimeout.NoTimeout)


def order_prices(entry, side, take: float = 3.0, stop: float = 1.0):
    """(take-profit, stop-loss) prices of columns entry and side."""
    return entry * (1 + side * take / 100), entry * (1 - side * stop / 100)


def fills(trades: DataFrame, by: tuple[str, ...] = ("order_id",)) -> DataFrame:
    """A row an order: volume-weighted price, quantity, fee, first and last fill."""
    return trades.groupBy(*by).agg((F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("price"), F.sum("qty").alias("qty"), F.sum("commission").alias("commission"), F.min("time").alias("first_fill"), F.max("time").alias("last_fill"))


def latest_signals(bars: DataFrame, names: list[str], timeframe: str, params: dict | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The newest voted signal of each series, from as much history as the longest window needs."""
    from barflow.operators.bars import resample
    from barflow.operators.signals import latest, run_vote

    longest = max([window_of(n, params) for n in names if n in INDICATORS] or [1])
    minutes = needed_history(longest, timeframe)
    recent = bars.join(bars.groupBy(*keys).agg(F.max("datetime").alias("__last")), list(keys)).filter(F.col("datetime") >= F.col("__last") - F.make_dt_interval(mins=F.lit(minutes))).drop("__last")
    return latest(run_vote(resample(recent, timeframe, keys), names, params, keys=keys), keys)
