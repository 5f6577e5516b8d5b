"""The backtest as a plan against the ordered pass of the kernel."""

import datetime as dt
import random

import pytest

from barflow.operators.backtest import Rules, backtest
from barflow.operators.backtest_fold import backtest_fold

START = dt.datetime(2024, 1, 1)


def series(seed, n=400, gaps=0.2, every=7):
    rng = random.Random(seed)
    bars, signals, price = [], [], 100.0
    for k in range(n):
        if rng.random() < gaps:
            continue
        o = price
        c = max(1.0, o * (1 + rng.gauss(0, 0.01)))
        bars.append((f"s{seed % 2}", START + dt.timedelta(minutes=17 * k), o, max(o, c) * (1 + abs(rng.gauss(0, 0.004))), min(o, c) * (1 - abs(rng.gauss(0, 0.004))), c))
        price = c
    for name in "abc":
        for k in range(0, n, every):
            if rng.random() < 0.9:
                signals.append((name, f"s{seed % 2}", START + dt.timedelta(minutes=17 * k + rng.choice([0, 0, 5])), rng.choice([-1, 0, 0, 1, 1])))
    return signals, bars


CASES = [
    Rules(take_profit=2.0, stop_loss=1.5),
    Rules(take_profit=1.0, stop_loss=50.0, fee=0.0),
    Rules(take_profit=90.0, stop_loss=90.0, leverage=3.0, slippage=0.1),
    Rules(take_profit=3.0, stop_loss=2.0, delay=2),
    Rules(take_profit=2.0, stop_loss=2.0, delay=5, leverage=2.0),
    Rules(take_profit=5.0, stop_loss=4.0, leverage=20.0, fee=0.3),  # breaks at half the balance
]


@pytest.mark.parametrize("rules", CASES, ids=range(len(CASES)))
def test_equals_the_kernel(spark, rules):
    signals, bars = [], []
    for seed in (1, 2):
        s, b = series(seed)
        signals += s
        bars += b
    s = spark.createDataFrame(signals, "strategy string, symbol string, datetime timestamp_ntz, signals int")
    b = spark.createDataFrame(bars, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double")
    want = sorted(map(tuple, backtest(s, b, rules).collect()))
    folded = backtest_fold(s, b, rules, width=3600)
    assert "Python" not in folded._jdf.queryExecution().toString() and "Pandas" not in folded._jdf.queryExecution().toString()
    got = sorted(map(tuple, folded.collect()))
    assert [r[:6] for r in got] == [r[:6] for r in want]
    for x, y in zip(got, want, strict=True):
        assert x[6:] == pytest.approx(y[6:], abs=0.0101)
    assert len(got) > 6 and len({r[5] for r in got}) >= 3


def test_edges(spark):
    s = spark.createDataFrame([("a", "x", START, 1), ("a", "x", START + dt.timedelta(hours=1), 0), ("b", "x", START, None), ("b", "x", START + dt.timedelta(hours=1), 1), ("c", "y", START, 1)], "strategy string, symbol string, datetime timestamp_ntz, signals int")
    b = spark.createDataFrame([("x", START + dt.timedelta(minutes=k), 10.0, 10.0, 10.0, 10.0) for k in range(30)], "symbol string, datetime timestamp_ntz, open double, high double, low double, close double")
    got = sorted(map(tuple, backtest_fold(s, b).collect()))
    assert [(r[0], r[2], r[5]) for r in got] == [("a", 0, "buy"), ("a", 1, "sell - end_of_backtest")]
    assert backtest_fold(s.limit(0), b).count() == 0 and backtest_fold(s, b.limit(0)).count() == 0
