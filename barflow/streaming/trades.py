"""The live position machine with orders that fill in parts.

Events of a symbol, in the order of their times (ties: fills, then signals):

signal  flat: an entry order of the wanted quantity goes out; same side: ``ignored``; other
        side: an exit order goes out, and once it is filled an entry on the signal's side
        (``reverse``); neutral: ``neutral``. While an order is open only an opposite signal
        counts, and only for what follows it: it replaces the side wanted next.
fill    of the entry: quantity, cost and fee add up; the order is done when the quantity is
        reached (``opened``, with take-profit and stop-loss prices), else ``part``.
        Of the exit, or of a take-profit or stop-loss order at the exchange (``why``): the same;
        done (``closed``) with the pnl of what was filled, both fees taken off.
        A fill that answers nothing (of an entry when none is open, of an exit before a position is) is ``stray``.
time    an order not filled ``patience`` seconds after it went out is given up: an entry
        keeps what was filled as its position (``kept``), or is flat again (``dropped``); an exit goes
        out again (``again``). The event-time timer fires when the watermark passes, an event of
        the symbol after that time sees to it at once.

State is typed (``STATE``), one value a symbol; sums of money are kept, never lists of fills.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "side int, wanted double, qty double, cost double, fee double, out_qty double, out_cost double, out_fee double, waits string, since timestamp, turn int, turn_qty double, pnl_sum double"
FIELDS = [c.split()[0] for c in STATE.split(", ")]
OUT = "symbol string, datetime timestamp, action string, side int, quantity double, price double, take_profit double, stop_loss double, fee double, pnl double, pnl_sum double"
FLAT = dict(zip(FIELDS, (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "", None, 0, 0.0, 0.0), strict=True))
LEFT = 1e-9  # of a quantity, below which an order is filled


class Trades(StatefulProcessor):
    def __init__(self, patience: float, take: float, stop: float) -> None:
        self.patience, self.take, self.stop = dt.timedelta(seconds=patience), take, stop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trade", STATE)

    def _load(self) -> dict:
        return dict(zip(FIELDS, self.state.get(), strict=True)) if self.state.exists() else dict(FLAT)

    def _save(self, s: dict) -> None:
        self.state.update(tuple(s[f] for f in FIELDS))

    def _order(self, s: dict, t: dt.datetime, waits: str) -> None:
        s["waits"], s["since"] = waits, t

    def _overdue(self, s: dict, t: dt.datetime) -> list[tuple]:
        if not s["waits"] or t < s["since"] + self.patience:
            return []
        at = s["since"] + self.patience
        if s["waits"] == "exit":
            self._order(s, at, "exit")
            return [(at, "again", s["side"], s["qty"] - s["out_qty"]), *self._overdue(s, t)]
        s["waits"], s["since"] = "", None
        if s["qty"] > LEFT:
            s["wanted"] = s["qty"]
            out = [(at, "kept", s["side"], s["qty"], s["cost"] / s["qty"], *self._levels(s))]
            if s["turn"]:
                self._order(s, at, "exit")
                out += [(at, "reverse", s["side"], s["qty"]), *self._overdue(s, t)]
            return out
        out, turn, qty = [(at, "dropped", s["side"], 0.0)], s["turn"], s["turn_qty"]
        s.update({k: FLAT[k] for k in FIELDS if k != "pnl_sum"})
        return out + (self._enter(s, at, turn, qty) + self._overdue(s, t) if turn else [])

    def _levels(self, s: dict) -> tuple[float, float]:
        price = s["cost"] / s["qty"]
        return price * (1 + s["side"] * self.take / 100), price * (1 - s["side"] * self.stop / 100)

    def _enter(self, s: dict, t: dt.datetime, side: int, qty: float) -> list[tuple]:
        s.update(side=side, wanted=qty, turn=0, turn_qty=0.0)
        self._order(s, t, "entry")
        return [(t, "enter", side, qty)]

    def _signal(self, s: dict, t: dt.datetime, signal: int, qty: float) -> list[tuple]:
        if not signal:
            return [(t, "neutral", s["side"], 0.0)]
        if not s["side"]:
            return self._enter(s, t, signal, qty)
        if s["waits"] == "exit" or s["turn"]:
            s.update(turn=signal, turn_qty=qty) if signal != s["side"] else s.update(turn=0, turn_qty=0.0)
            return [(t, "next" if s["turn"] else "ignored", signal, s["turn_qty"])]
        if signal == s["side"]:
            return [(t, "ignored", signal, 0.0)]
        s.update(turn=signal, turn_qty=qty)
        if s["waits"]:
            return [(t, "next", signal, qty)]
        self._order(s, t, "exit")
        return [(t, "reverse", s["side"], s["qty"])]

    def _fill(self, s: dict, t: dt.datetime, is_entry: bool, qty: float, price: float, fee: float, why: str) -> list[tuple]:
        if not s["side"] or is_entry != (s["waits"] == "entry"):
            return [(t, "stray", s["side"], qty, price)]
        if is_entry:
            s.update(qty=s["qty"] + qty, cost=s["cost"] + qty * price, fee=s["fee"] + fee)
            if s["qty"] < s["wanted"] - LEFT:
                return [(t, "part", s["side"], s["qty"], s["cost"] / s["qty"])]
            s["waits"], s["since"] = "", None
            out = [(t, "opened", s["side"], s["qty"], s["cost"] / s["qty"], *self._levels(s))]
            if s["turn"]:
                self._order(s, t, "exit")
                out.append((t, "reverse", s["side"], s["qty"]))
            return out
        s.update(out_qty=s["out_qty"] + qty, out_cost=s["out_cost"] + qty * price, out_fee=s["out_fee"] + fee)
        if s["out_qty"] < s["qty"] - LEFT:
            return [(t, "part", -s["side"], s["out_qty"], s["out_cost"] / s["out_qty"])]
        entry, exit_, fees = s["cost"] / s["qty"], s["out_cost"] / s["out_qty"], s["fee"] + s["out_fee"]
        pnl = (exit_ - entry) * s["out_qty"] * s["side"] - fees
        total, turn, wanted = s["pnl_sum"] + pnl, s["turn"], s["turn_qty"]
        out = [(t, f"closed: {why}", s["side"], s["out_qty"], exit_, None, None, fees, pnl, total)]
        s.update(FLAT | {"pnl_sum": total})
        return out + (self._enter(s, t, turn, wanted) if turn else [])

    def handle_one(self, s: dict, r) -> list[tuple]:
        t = pd.Timestamp(r.datetime).to_pydatetime()
        out = self._overdue(s, t)
        if r.kind == "signal":
            return out + self._signal(s, t, int(r.signal), float(r.quantity))
        return out + self._fill(s, t, r.kind == "entry", float(r.quantity), float(r.price), float(r.fee), r.why or "market")

    def _told(self, key, out: list[tuple], s: dict) -> pd.DataFrame:
        width = len(OUT.split(", ")) - 1
        rows = [(key[0], *x, *[None] * (width - len(x))) for x in out]
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        return frame.astype(dict.fromkeys(("quantity", "price", "take_profit", "stop_loss", "fee", "pnl", "pnl_sum"), "float64"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        events = pd.concat(list(rows))
        events = events.assign(__late=events["kind"] == "signal").sort_values(["datetime", "__late"], kind="stable")
        for r in events.itertuples(index=False):
            out += self.handle_one(s, r)
        self._save(s)
        self._set_timer(s)
        yield self._told(key, out, s)

    def _set_timer(self, s: dict) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if s["waits"]:
            self.handle.registerTimer(int((s["since"] + self.patience - dt.datetime(1970, 1, 1)).total_seconds() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        t = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        out = self._overdue(s, t)
        self._save(s)
        if s["waits"] and out:
            self.handle.registerTimer(int((s["since"] + self.patience - dt.datetime(1970, 1, 1)).total_seconds() * 1000))
        if out:
            yield self._told(key, out, s)

    def close(self) -> None:
        pass


def trades(events: DataFrame, patience: float = 15.0, take: float = 3.0, stop: float = 1.0, delay: str = "0 seconds") -> DataFrame:
    """Actions (``OUT``) of a stream of events (symbol, datetime, kind, signal, quantity, price, fee, why).

    kind: signal (signal -1, 0 or 1, with the quantity to trade), entry or exit (a fill: quantity, price, fee; why: what filled it).
    """
    rows = events.withWatermark("datetime", delay)
    return rows.groupBy("symbol").transformWithStateInPandas(Trades(patience, take, stop), OUT, "Append", "EventTime")
