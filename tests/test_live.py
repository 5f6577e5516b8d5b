"""Streams: row windows against the batch's kernels, the position machine against a plain twin, candles over restarts, a plugged model."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import kernels as K

START = dt.datetime(2024, 1, 1)


def feed(spark, rows, schema, path):
    """Rows as one more file of a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(out, root):
    out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").trigger(availableNow=True).start().awaitTermination()


def test_row_windows(spark, tmp_path):
    """Four batches, a restart between the second and the third, a late bar and a repeated one."""
    from barflow.streaming.windows import needs_rocksdb, row_windows

    needs_rocksdb(spark)
    root, schema, rng = str(tmp_path), "symbol string, datetime timestamp_ntz, close double", random.Random(1)
    rows = {s: [(s, START + dt.timedelta(hours=k), 100 + rng.gauss(0, 5)) for k in range(n)] for s, n in (("a", 60), ("b", 9))}
    live = lambda: row_windows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), {"sma": ("sma", 5), "dev": ("std", 4), "top": ("max", 3), "low": ("min", 3), "mom": ("mom", 6), "ema": ("ema", 5)})
    for k in range(2):
        feed(spark, [r for x in rows.values() for r in x if k * 15 <= (r[1] - START).total_seconds() / 3600 < (k + 1) * 15][::-1], schema, f"{root}/in")
    drain(live(), root)
    late = [("a", START + dt.timedelta(hours=3), 1.0), ("a", START + dt.timedelta(hours=29), 2.0)]
    for k in range(2, 4):
        feed(spark, [r for r in rows["a"] if k * 15 <= (r[1] - START).total_seconds() / 3600 < (k + 1) * 15] + late * (k == 2), schema, f"{root}/in")
    drain(live(), root)
    got = spark.read.parquet(f"{root}/rows")
    assert [(r.close, r.sma) for r in got.filter("late").orderBy("close").collect()] == [(1.0, None), (2.0, None)]
    for s, own in rows.items():
        mine = got.filter((F.col("symbol") == s) & ~F.col("late")).orderBy("datetime").collect()
        x = np.array([r[2] for r in own])
        want = {"sma": K.rolling(x, 5, np.mean), "dev": K.rolling(x, 4, np.std), "top": K.rolling(x, 3, np.max), "low": K.rolling(x, 3, np.min), "mom": K.rolling(x, 7, lambda v: v[-1] - v[0]), "ema": K.ema(x, 5)}
        assert [r.datetime for r in mine] == [r[1] for r in own]
        for c, v in want.items():
            np.testing.assert_allclose([np.nan if r[c] is None else r[c] for r in mine], v, rtol=1e-12, equal_nan=True)


class Twin:
    """The rules of the position machine, kept as an order and a position that know themselves."""

    def __init__(self, patience):
        self.patience, self.position, self.order, self.next, self.total, self.out = dt.timedelta(seconds=patience), None, None, None, 0.0, []

    def say(self, t, action, side, qty, price=None, fee=None, pnl=None, total=None):
        self.out.append((t, action, side, qty, price, fee, pnl, total))

    def enter(self, t, side, qty):
        self.order = {"kind": "entry", "side": side, "wanted": qty, "qty": 0.0, "cost": 0.0, "fee": 0.0, "since": t}
        self.say(t, "enter", side, qty)

    def leave(self, t):
        self.order = {"kind": "exit", "since": t}
        self.say(t, "reverse", self.position["side"], self.position["qty"])

    def time(self, t):
        while self.order and t >= self.order["since"] + self.patience:
            at = self.order["since"] + self.patience
            if self.order["kind"] == "exit":
                self.order["since"] = at
                self.say(at, "again", self.position["side"], self.position["qty"] - self.position["out"])
            elif self.order["qty"] > 0:
                self.hold(self.order)
                self.order = None
                self.say(at, "kept", self.position["side"], self.position["qty"], self.position["cost"] / self.position["qty"])
                if self.next:
                    self.leave(at)
            else:
                side, self.order = self.order["side"], None
                self.say(at, "dropped", side, 0.0)
                if self.next:
                    follow, self.next = self.next, None
                    self.enter(at, *follow)

    def hold(self, order):
        self.position = {"side": order["side"], "qty": order["qty"], "cost": order["cost"], "fee": order["fee"], "out": 0.0, "got": 0.0, "out_fee": 0.0}

    def signal(self, t, signal, qty):
        side = self.position["side"] if self.position else self.order["side"] if self.order else 0
        if signal == 0:
            self.say(t, "neutral", side, 0.0)
        elif not side:
            self.enter(t, signal, qty)
        elif (self.order and self.order["kind"] == "exit") or self.next:
            self.next = (signal, qty) if signal != side else None
            self.say(t, "next" if self.next else "ignored", signal, qty if self.next else 0.0)
        elif signal == side:
            self.say(t, "ignored", signal, 0.0)
        else:
            self.next = (signal, qty)
            if self.order:
                self.say(t, "next", signal, qty)
            else:
                self.leave(t)

    def fill(self, t, kind, qty, price, fee, why):
        o, p = self.order, self.position
        if kind == "entry" and o and o["kind"] == "entry":
            o["qty"], o["cost"], o["fee"] = o["qty"] + qty, o["cost"] + qty * price, o["fee"] + fee
            if o["qty"] < o["wanted"] - 1e-9:
                return self.say(t, "part", o["side"], o["qty"], o["cost"] / o["qty"])
            self.hold(o)
            self.order = None
            self.say(t, "opened", o["side"], o["qty"], o["cost"] / o["qty"])
            return self.leave(t) if self.next else None
        if kind == "exit" and p:
            p["out"], p["got"], p["out_fee"] = p["out"] + qty, p["got"] + qty * price, p["out_fee"] + fee
            if p["out"] < p["qty"] - 1e-9:
                return self.say(t, "part", -p["side"], p["out"], p["got"] / p["out"])
            fees = p["fee"] + p["out_fee"]
            pnl = (p["got"] / p["out"] - p["cost"] / p["qty"]) * p["out"] * p["side"] - fees
            self.total += pnl
            self.say(t, f"closed: {why}", p["side"], p["out"], p["got"] / p["out"], fees, pnl, self.total)
            self.position, self.order, follow, self.next = None, None, self.next, None
            return self.enter(t, *follow) if follow else None
        side = o["side"] if o and o["kind"] == "entry" else p["side"] if p else 0
        return self.say(t, "stray", side, qty, price)


def market(seed, symbol, n=120):
    """Signals and fills that mostly answer the machine: the twin is asked what is open."""
    rng, twin, t, events = random.Random(seed), Twin(15), START, []
    for _ in range(n):
        t += dt.timedelta(seconds=rng.choice([1, 2, 5, 20]))
        twin.time(t)
        o, p = twin.order, twin.position
        if o and o["kind"] == "entry" and rng.random() < 0.6:
            e = (symbol, t, "entry", 0, round(min(o["wanted"] - o["qty"], rng.choice([0.5, 1.0, 9.0])), 6), rng.uniform(90, 110), 0.01, "")
        elif p and rng.random() < (0.6 if o else 0.25):
            e = (symbol, t, "exit", 0, round(min(p["qty"] - p["out"], rng.choice([0.5, 9.0])), 6), rng.uniform(90, 110), 0.02, rng.choice(["take_profit", "stop_loss", "direction_change"]))
        elif rng.random() < 0.05:
            e = (symbol, t, rng.choice(["entry", "exit"]), 0, 1.0, 100.0, 0.0, "x")
        else:
            e = (symbol, t, "signal", rng.choice([-1, 0, 1, 1]), rng.choice([1.0, 2.5]), None, None, "")
        events.append(e)
        if e[2] == "signal":
            twin.signal(t, e[3], e[4])
        else:
            twin.fill(t, e[2], e[4], e[5], e[6], e[7])
    return events, twin, t


def test_trades(spark, tmp_path):
    """All cases in three batches with a restart; timers fire when another symbol's event moves the watermark."""
    from barflow.streaming.trades import trades
    from barflow.streaming.windows import needs_rocksdb

    needs_rocksdb(spark)
    root = str(tmp_path)
    schema = "symbol string, datetime timestamp, kind string, signal int, quantity double, price double, fee double, why string"
    made = {s: market(k, s) for k, s in enumerate("abcd")}
    end = max(t for _, _, t in made.values()) + dt.timedelta(hours=1)
    every = sorted((e for x in made.values() for e in x[0]), key=lambda e: e[1])
    live = lambda: trades(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    cut = len(every) // 3
    feed(spark, every[:cut], schema, f"{root}/in")
    feed(spark, every[cut : 2 * cut], schema, f"{root}/in")
    drain(live(), root)
    feed(spark, every[2 * cut :] + [("z", end, "signal", 0, 0.0, None, None, "")], schema, f"{root}/in")
    drain(live(), root)
    got = spark.read.parquet(f"{root}/rows").collect()
    seen = set()
    for s, (_, twin, last) in made.items():
        own = [r for r in got if r.symbol == s]
        mine = sorted(((r.datetime, r.action, r.side, r.quantity, r.price, r.fee, r.pnl, r.pnl_sum) for r in own if r.datetime <= last), key=str)
        want = sorted((x for x in twin.out if x[0] <= last), key=str)
        assert [x[:3] for x in mine] == [x[:3] for x in want]
        for a, b in zip(mine, want, strict=True):
            assert [x is None for x in a[3:]] == [x is None for x in b[3:]]
            assert [x or 0.0 for x in a[3:]] == pytest.approx([x or 0.0 for x in b[3:]], rel=1e-9)
        for r in own:
            if r.action == "opened":
                assert r.take_profit == pytest.approx(r.price * (1 + 0.03 * r.side)) and r.stop_loss == pytest.approx(r.price * (1 - 0.01 * r.side))
        if twin.order:  # what was still open was given up by the timer, or went out again
            assert any(r.datetime > last and r.action in ("kept", "dropped", "again") for r in own)
        seen |= {x[1].split(":")[0] for x in want}
    assert seen >= {"enter", "part", "opened", "closed", "reverse", "ignored", "neutral", "next", "kept", "dropped", "stray"}


def test_stream_candles_go_on(spark, tmp_path):
    """Three starts on one checkpoint over a stored table: nothing is missing and nothing is there twice; an unknown symbol holds nothing up."""
    from barflow.sources import exchanges as E

    bars = spark.createDataFrame([(s, START + dt.timedelta(minutes=5 * k), float(k), k + 1.0, k - 1.0, k + 0.5, 2.0) for s in ("a", "b") for k in range(600)], "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
    root = str(tmp_path)
    E.store_candles(bars, f"{root}/store", "5m")
    client = f"barflow.sources.exchanges:table_client?file://{root}/store"
    for end in ("2024-01-01 10:00:00", "2024-01-01 10:02:00", "2024-01-03"):
        drain(E.stream_candles(spark, "binance", client, ["a", "b", "none"], "2024-01-01", end, "5m", limit=7, hours=6), root)
    got = spark.read.parquet(f"{root}/rows").orderBy("symbol", "datetime").collect()
    want = bars.filter("datetime <= '2024-01-03'").withColumn("symbol", F.upper("symbol")).orderBy("symbol", "datetime").collect()
    assert [(r.symbol, r.datetime, r.open, r.close) for r in got] == [(r.symbol, r.datetime, r.open, r.close) for r in want]
    paged = E.read_candles(spark, "binance", client, ["a", "b", "none"], "2024-01-01", "2024-01-03", "5m", limit=7, hours=6)
    assert paged.count() == len(want)


def test_newest_candle_is_left(monkeypatch):
    """A stream without an end stops before the candle that is still open and one that had no time to show."""
    from barflow.sources import exchanges as E

    stream = E.CandleStream({"exchange": "binance", "client": "x:y", "symbols": "a", "start": "2024-01-01", "interval": "1m"})
    now = E.to_millis("now")
    assert now - 121_000 <= stream.latestOffset()["at"] <= now - 119_000 and stream.initialOffset() == {"at": E.to_millis("2024-01-01") - 1}
    parts = stream.partitions({"at": 10}, {"at": 10 + 3_600_000 * 24 * 31})
    assert [(p.start, p.end) for p in parts] == [(11, 10 + 3_600_000 * 24 * 30), (11 + 3_600_000 * 24 * 30, 10 + 3_600_000 * 24 * 31)]
    assert stream.partitions({"at": 10}, {"at": 10}) == []


def toy_model():
    def told(texts):
        assert all(texts) and len(texts) <= 3
        if any("broken" in t for t in texts):
            raise ValueError("cannot read this")
        return [(1.0 if "up" in t else -1.0, 0.5 + min(len(t), 50) / 100) for t in texts]

    return told


def test_plugged_model(spark):
    from barflow.operators.posts import plugged, score

    rows = [(0, "up"), (1, None), (2, ""), (3, "down it goes"), (4, "up and away"), (5, "x")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r.id: (r.sentiment, r.sentiment_confidence) for r in score(df, "text", plugged(toy_model, batch=3)).collect()}
    assert got == {0: (1.0, 0.52), 1: (0.0, 0.5), 2: (0.0, 0.5), 3: (-1.0, 0.62), 4: (1.0, 0.61), 5: (-1.0, 0.51)}
    odd = spark.createDataFrame([(0, "broken"), (1, "up")], "id int, text string").coalesce(1)
    assert {(r.sentiment, r.sentiment_confidence) for r in score(odd, "text", plugged(toy_model, batch=1)).collect()} == {(0.0, 0.5), (1.0, 0.52)}
