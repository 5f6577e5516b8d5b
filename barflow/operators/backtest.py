"""Event-driven backtest of signals on bars, for all strategies and symbols in one job, and its statistics.

A signal rules the bars from its own time to the next signal's.  The state (position,
entry price, last signal, balance) depends on every earlier exit, so a series is one
ordered pass; series run in parallel, and a symbol's bars are read once for all its
strategies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Percentages but for balance, leverage and the delay in bars."""

    balance: float = 1000.0
    take_profit: float = 1.0
    stop_loss: float = 1.0
    delay: int = 0
    fee: float = 0.05
    leverage: float = 1.0
    slippage: float = 0.0

    @property
    def cost(self) -> float:
        return self.fee * self.leverage + self.slippage


EVENTS = "datetime timestamp_ntz, predicted_direction string, action string, buy_price double, sell_price double, balance double, pnl double, pnl_sum double"


def _pass(when: np.ndarray, signal: np.ndarray, time: np.ndarray, o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray, r: Rules) -> list[tuple]:
    first = np.searchsorted(time, when)
    some = np.flatnonzero(signal)
    events: list[tuple] = []
    if not len(some):
        return events
    balance, side, entry, last = r.balance, 0, 0.0, 0

    def close(at, price: float, why: str) -> None:
        nonlocal balance, side, last
        pnl = (price - entry) / entry * 100 * side * r.leverage - r.cost
        balance += balance * pnl / 100
        events.append((at, "long" if side > 0 else "short", f"sell - {why}", entry, price, balance, pnl))
        side, last = 0, 0 if why in ("take_profit", "stop_loss") else last

    for i in range(max(0, some[0] - 1), len(when) - 1):
        a, b = first[i], first[i + 1]
        if b - a <= r.delay:
            continue
        want = int(signal[i]) or last
        if not want:
            continue
        if side and want != side:
            close(when[i], o[a], "direction_change")
        if not side:
            side, entry, last = want, o[min(a + r.delay, b - 1)], want
            balance -= balance * r.cost / 100
            events.append((when[i], "long" if side > 0 else "short", "buy", entry, 0.0, balance, -r.cost))
        take, stop = entry * (1 + side * r.take_profit / 100), entry * (1 - side * r.stop_loss / 100)
        won, lost = (h[a:b] >= take, lo[a:b] <= stop) if side > 0 else (lo[a:b] <= take, h[a:b] >= stop)
        hit = won | lost
        if hit.any():
            k = int(hit.argmax())
            close(time[a + k], take if won[k] else stop, "take_profit" if won[k] else "stop_loss")
        if balance < r.balance / 2:
            break
    if side and len(time):
        close(time[-1], c[-1], "end_of_backtest")
    return events


LEAST_BARS = 11  # version 1 leaves out intervals of fewer bars


def _pass_v1(when: np.ndarray, signal: np.ndarray, time: np.ndarray, o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray, r: Rules) -> list[tuple]:
    """The first version's rules: an exit takes the high or low of the bar that reaches a level (the low if both are reached at once), its
    gain is signed by the direction of the interval before, events are named by the present one, and what is open at the end stays open."""
    first = np.searchsorted(time, when)
    balance, held, entry, events = r.balance, False, 0.0, []
    before = int(signal[0]) if len(signal) else 0

    def told(at, now: int, what: str, price: float, pnl: float) -> None:
        nonlocal balance
        balance += balance * pnl / 100
        events.append((at, "long" if now > 0 else "short", what, entry, price, balance, pnl))

    def gain(price: float) -> float:
        return (price - entry) / entry * 100 * (1 if before > 0 else -1) * r.leverage - r.cost

    for i in range(len(when) - 1):
        now = int(signal[i]) or before
        a, b = first[i], first[i + 1]
        if not now or b - a < LEAST_BARS:
            continue
        at, price = time[a + r.delay], o[a + r.delay]
        if not held:
            held, entry, before = True, price, now
            told(at, now, "buy", 0.0, -r.cost)
        if now != before:
            told(at, now, "sell - direction change", price, gain(price))
            entry = price
            told(at, now, "buy", 0.0, -r.cost)
        side = 1 if now > 0 else -1
        take, stop = entry * (1 + side * r.take_profit / 100), entry * (1 - side * r.stop_loss / 100)
        high, low = h[a:b] >= max(take, stop), lo[a:b] <= min(take, stop)
        if (high | low).any():
            k = int((high | low).argmax())
            price = lo[a + k] if low[k] else h[a + k]
            pnl = gain(price)
            held = False
            told(time[a + k], now, f"sell - {'take_profit' if pnl > 0 else 'stop_loss'}", price, pnl)
        before = now
        if balance < r.balance / 2:
            break
    return events


def backtest(signals: DataFrame, bars: DataFrame, rules: Rules = Rules(), signal: str = "signals", version: int = 2, buckets: int = 1) -> DataFrame:
    """Ledger rows (strategy, symbol, event from 0, EVENTS) for signals (strategy, symbol, datetime, signal).

    version: 2, or 1 for the rules of ``_pass_v1``. buckets: a symbol's strategies are dealt to so many tasks, each with a copy of its bars.
    """
    one_pass = {1: _pass_v1, 2: _pass}[version]

    def run(s: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("datetime")
        time, price = b["datetime"].to_numpy(), [b[k].to_numpy(float) for k in ("open", "high", "low", "close")]
        out = []
        for (strategy, symbol), own in s.groupby(["strategy", "symbol"], sort=True):
            own = own.sort_values("datetime")
            rows = pd.DataFrame(one_pass(own["datetime"].to_numpy(), own[signal].to_numpy(), time, *price, rules), columns=["datetime", "predicted_direction", "action", "buy_price", "sell_price", "balance", "pnl"])
            if len(rows):
                rows["pnl_sum"] = rows["pnl"].cumsum().round(2)
                rows[["balance", "pnl"]] = rows[["balance", "pnl"]].astype(float).round(2)
                rows.insert(0, "event", np.arange(len(rows)))
                rows.insert(0, "symbol", symbol)
                rows.insert(0, "strategy", strategy)
                out.append(rows)
        return pd.concat(out) if out else pd.DataFrame(columns=["strategy", "symbol", "event", "datetime", "predicted_direction", "action", "buy_price", "sell_price", "balance", "pnl", "pnl_sum"])

    narrow, keys = bars.select(*[F.col(c).alias(c) for c in ("symbol", "datetime", "open", "high", "low", "close")]), ["symbol"]  # columns of its own: signals may come from the same table
    if buckets > 1:
        signals = signals.withColumn("__bucket", F.pmod(F.xxhash64("strategy"), F.lit(buckets)).cast("int"))
        narrow, keys = narrow.withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))), ["symbol", "__bucket"]
    return signals.groupBy(*keys).cogroup(narrow.groupBy(*keys)).applyInPandas(run, f"strategy string, symbol string, event long, {EVENTS}")


def _if(c: Column, x: Column) -> Column:
    return F.when(c, x)


def _runs(rows: DataFrame, w, value: str) -> DataFrame:
    """Add __wins and __losses: how many winning (losing) rows end at this one without a break; both use the window's own order, so no exchange is added."""
    at = F.row_number().over(w)
    rows = rows.withColumns({"__at": at, "__is_win": F.coalesce(F.col(value) > 0, F.lit(False)), "__is_loss": F.coalesce(F.col(value) < 0, F.lit(False))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    since = lambda side: F.col("__at") - F.coalesce(F.max(F.when(~F.col(side), F.col("__at"))).over(upto), F.lit(0))
    return rows.withColumns({"__wins": since("__is_win").cast("long"), "__losses": since("__is_loss").cast("long")})


def streaks(ledger: DataFrame, keys: tuple[str, ...], order: str = "event", value: str = "pnl") -> DataFrame:
    """keys with the longest runs of winning and of losing rows."""
    rows = _runs(ledger, Window.partitionBy(*keys).orderBy(order), value)
    return rows.groupBy(*keys).agg(F.max("__wins").alias("max_consecutive_wins"), F.max("__losses").alias("max_consecutive_losses"))


def trade_statistics(ledger: DataFrame, keys: tuple[str, ...] = ("strategy", "symbol"), order: str = "event") -> DataFrame:
    """The 22 figures of a ledger; its buy rows count as events, with the fee as their loss. Undefined ratios are null, Sharpe and Sortino 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _runs(ledger, Window.partitionBy(*keys).orderBy(order), "pnl")
    rows = rows.withColumn("__peak", F.max("balance").over(w)).withColumn("__down", F.col("balance") - F.col("__peak"))
    p = F.col("pnl")
    count = lambda c: F.count_if(c)
    total = F.count("*")
    win, loss = F.avg(_if(p > 0, p)), F.avg(_if(p < 0, p))
    gain, pain = F.coalesce(F.sum(_if(p > 0, p)), F.lit(0.0)), F.coalesce(F.sum(_if(p < 0, p)), F.lit(0.0))
    guard = lambda x: F.coalesce(F.try_divide(F.avg(p), F.nullif(x, F.lit(0.0))), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        total.alias("total_trades"),
        count(F.col("predicted_direction") == "long").alias("long_trades"),
        count(F.col("predicted_direction") == "short").alias("short_trades"),
        count(p > 0).alias("win_trades"),
        count(p < 0).alias("loss_trades"),
        count(p == 0).alias("breakeven_trades"),
        (count(p > 0) / total).alias("win_rate"),
        (count(p < 0) / total).alias("loss_rate"),
        gain.alias("gross_profit"),
        pain.alias("gross_loss"),
        F.sum(p).alias("net_profit"),
        F.avg(p).alias("avg_trade_pnl"),
        win.alias("avg_win"),
        loss.alias("avg_loss"),
        F.abs(F.try_divide(win, loss)).alias("risk_reward_ratio"),
        F.try_divide(gain, F.abs(pain)).alias("profit_factor"),
        F.min("__down").alias("max_drawdown"),
        F.min(F.try_divide(F.col("__down"), F.col("__peak"))).alias("max_drawdown_pct"),
        guard(F.stddev_samp(p)).alias("sharpe_ratio"),
        guard(F.stddev_samp(_if(p < 0, p))).alias("sortino_ratio"),
        F.max("__wins").alias("max_consecutive_wins"),
        F.max("__losses").alias("max_consecutive_losses"),
    )


def summary(ledger: DataFrame, start: float = 1000.0, keys: tuple[str, ...] = ("strategy", "symbol"), order: str = "event") -> DataFrame:
    """Sell rows only: trades, win rate (%), mean pnl, final balance, maximum drawdown (%) and exits by reason."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sells = ledger.filter(F.col("action").startswith("sell"))
    sells = sells.withColumn("__peak", F.greatest(F.max("balance").over(w), F.lit(float(start))))
    reason = lambda r: F.count_if(F.col("action").contains(r)).alias(r)
    return sells.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        (100 * F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"),
        F.avg("pnl").alias("avg_pnl"),
        F.max_by("balance", order).alias("final_balance"),
        F.max((F.col("__peak") - F.col("balance")) / F.col("__peak") * 100).alias("max_drawdown_pct"),
        *[reason(r) for r in ("take_profit", "stop_loss", "direction_change", "end_of_backtest")],
    )


def max_drawdown(rows: DataFrame, value: str, keys: tuple[str, ...], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__peak", F.max(value).over(w)).groupBy(*keys).agg(F.min(F.col(value) - F.col("__peak")).alias("max_drawdown"))


def best_model(stats: DataFrame, pnl: str = "pnl", sharpe: str = "sharpe_ratio", drawdown: str = "max_drawdown", name: str = "model_name") -> DataFrame:
    """The row with the largest pnl * sharpe / |drawdown|; without drawdown or with an unsound score a row takes no part."""
    score = F.try_divide(F.col(pnl) * F.col(sharpe), F.abs(F.col(drawdown)))
    sound = stats.withColumn("score", score).filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    return sound.orderBy(F.desc("score"), name).limit(1)


def top(rows: DataFrame, n: int, by: str = "pnl_sum", ascending: bool = False, ties: tuple[str, ...] = ("strategy",)) -> DataFrame:
    return rows.orderBy(F.asc(by) if ascending else F.desc(by), *ties).limit(n)


def active_entries(row_map: Column) -> Column:
    """A record's map without nulls, zeros and false ones."""
    return F.map_filter(row_map, lambda k, v: F.coalesce(v.cast("string"), F.lit("0")).isin("0", "0.0", "false", "") == F.lit(False))


def shuffled(rows: DataFrame, features: list[str], repeats: int = 3, seed: int = 7, order: tuple[str, ...] = ("symbol", "datetime")) -> DataFrame:
    """rows for every (feature, repeat) with that feature's values dealt anew: ranks by a seeded hash meet ranks by ``order``, which names a row.

    Rows are ranked within 64 hash groups, so no task orders the whole table; all variants share one exchange for either side.
    """
    variants = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("repeat")) for f in features for k in range(repeats)]))
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in order])
    keyed = rows.withColumn("__id", F.md5(name)).withColumn("__all", F.pmod(F.xxhash64("__id"), F.lit(64))).withColumn("__v", variants)
    keyed = keyed.select("*", F.col("__v.feature").alias("feature"), F.col("__v.repeat").alias("repeat")).drop("__v")
    own = ("feature", "repeat", "__all")
    a = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(*own).orderBy("__id")))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "feature", F.col("repeat").cast("string"), "__id"))
    new = F.lit(None)
    for f in features:
        new = F.when(F.col("feature") == f, F.col(f).cast("double")).otherwise(new)
    b = keyed.select(*own, F.row_number().over(Window.partitionBy(*own).orderBy(draw)).alias("__n"), new.alias("__new"))
    met = a.join(b, [*own, "__n"])
    return met.select("feature", "repeat", *[F.when(F.col("feature") == c, F.col("__new").cast(t)).otherwise(F.col(c)).alias(c) if c in features else F.col(c) for c, t in rows.dtypes])
