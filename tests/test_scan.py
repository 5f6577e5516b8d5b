"""Smoothings over split series against the one-pass kernels."""

import datetime as dt
import random

import numpy as np
import pytest

from barflow.operators import kernels as K
from barflow.operators import scan as S

START = dt.datetime(2023, 12, 30)


@pytest.fixture(scope="module")
def series():
    rng, rows = random.Random(3), {}
    for name, n in (("a", 900), ("b", 40), ("c", 5), ("d", 1)):
        t, x, rows[name] = START, 100.0, []
        for _ in range(n):
            t += dt.timedelta(minutes=rng.choice([1, 7, 60, 60, 900 if rng.random() < 0.05 else 60]))
            x += rng.gauss(0, 1)
            rows[name].append((name, t, x + abs(rng.gauss(0, 1)), x - abs(rng.gauss(0, 1)), x))
    return rows


@pytest.fixture(scope="module")
def bars(spark, series):
    every = [r for x in series.values() for r in x]
    random.Random(1).shuffle(every)
    return spark.createDataFrame(every, "symbol string, datetime timestamp_ntz, high double, low double, close double").repartition(5)


def same(got, column, series, f):
    by = {}
    for r in got.collect():
        by.setdefault(r.symbol, []).append((r.datetime, r[column]))
    for name, rows in series.items():
        mine = np.array([np.nan if v is None else v for _, v in sorted(by[name])])
        h, lo, c = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
        np.testing.assert_allclose(mine, f(h, lo, c), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("width", [3600, 86400, 86400 * 7])
def test_ema_of_any_chunks(bars, series, width):
    same(S.emas(bars, 10, width=width), "ema", series, lambda h, lo, c: K.ema(c, 10))


def test_chains(bars, series):
    got = S.emas(bars, 7, times=3)
    assert got.columns == [*bars.columns, "ema", "dema", "tema"]
    same(got, "dema", series, lambda h, lo, c: K.dema(c, 7))
    same(got, "tema", series, lambda h, lo, c: K.tema(c, 7))


def test_macd(bars, series):
    got = S.macd(bars)
    for k, column in enumerate(("macd", "macd_signal", "macd_hist")):
        same(got, column, series, lambda h, lo, c, k=k: K.macd(c, 12, 26, 9)[k])


def test_wilder(bars, series):
    same(S.rsi(bars, 5), "rsi", series, lambda h, lo, c: K.rsi(c, 5))
    same(S.atr(bars, 5), "atr", series, lambda h, lo, c: K.atr(h, lo, c, 5))


def test_recur_keeps_its_digits():
    x = np.random.default_rng(0).normal(size=5000) * 1e6
    want, y = [], 3.0
    for v in x:
        y += 0.9 * (v - y)
        want.append(y)
    np.testing.assert_allclose(S.recur(x, 0.9, 3.0), want, rtol=1e-9, atol=1e-6)


def test_empty(bars):
    assert S.emas(bars.limit(0), 3).count() == 0
