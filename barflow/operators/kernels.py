"""Recursive indicators: one ordered pass a series over NumPy arrays, NaN during warm-up.

Seeds follow the public conventions: an EMA starts from the mean of its first N values,
Wilder's smoothing from the mean (or sum) of its first ones.  Every function takes and
returns float arrays of the series' length; ``run`` applies many of them in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAN = float("nan")


def _from(x: np.ndarray) -> int:
    ok = np.flatnonzero(~np.isnan(x))
    return int(ok[0]) if len(ok) else len(x)


def smooth(x: np.ndarray, n: int, k: float, seed_at: int | None = None) -> np.ndarray:
    """y = y' + k (x - y'), seeded with the mean of n values that end at ``seed_at`` (default: as early as can be)."""
    out = np.full(len(x), NAN)
    at = _from(x) + n - 1 if seed_at is None else seed_at
    if at >= len(x):
        return out
    y = out[at] = x[at - n + 1 : at + 1].mean()
    for i in range(at + 1, len(x)):
        y = out[i] = y + k * (x[i] - y)
    return out


def ema(x: np.ndarray, n: int, seed_at: int | None = None) -> np.ndarray:
    return smooth(x, n, 2.0 / (n + 1), seed_at)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 1.0 / n)


def chain(x: np.ndarray, n: int, times: int) -> list[np.ndarray]:
    out = []
    for _ in range(times):
        x = ema(x, n)
        out.append(x)
    return out


def dema(x: np.ndarray, n: int) -> np.ndarray:
    a, b = chain(x, n, 2)
    return 2 * a - b


def tema(x: np.ndarray, n: int) -> np.ndarray:
    a, b, c = chain(x, n, 3)
    return 3 * a - 3 * b + c


def t3(x: np.ndarray, n: int, v: float = 0.7) -> np.ndarray:
    *_, c, d, e, f = chain(x, n, 6)
    return -(v**3) * f + 3 * v * v * (1 + v) * e - 3 * v * (1 + v) ** 2 * d + (1 + v) ** 3 * c


def trix(x: np.ndarray, n: int) -> np.ndarray:
    e = chain(x, n, 3)[-1]
    out = np.full(len(x), NAN)
    out[1:] = 100 * (e[1:] / e[:-1] - 1)
    return out


def macd(x: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both averages are seeded where the slow one is; all three lines start with the signal line."""
    line = ema(x, fast, slow - 1) - ema(x, slow)
    s = ema(line, signal)
    line = np.where(np.isnan(s), NAN, line)
    return line, s, line - s


def kama(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), NAN)
    if len(x) <= n:
        return out
    step, y = np.abs(np.diff(x)), x[n - 1]
    for i in range(n, len(x)):
        path = step[i - n : i].sum()
        ratio = abs(x[i] - x[i - n]) / path if path > 0 else 1.0
        k = (min(ratio, 1.0) * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        y = out[i] = y + k * (x[i] - y)
    return out


def _changes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.append(NAN, np.diff(x))
    return np.where(np.isnan(d), NAN, np.maximum(d, 0)), np.where(np.isnan(d), NAN, np.maximum(-d, 0))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    with np.errstate(all="ignore"):
        return np.where(np.isnan(a) | np.isnan(b), NAN, np.where(b == 0, 0.0, a / np.where(b == 0, 1, b)))


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    up, down = (wilder(c, n) for c in _changes(x))
    return 100 * _ratio(up, up + down)


def cmo(x: np.ndarray, n: int) -> np.ndarray:
    up, down = (wilder(c, n) for c in _changes(x))
    return 100 * _ratio(up - down, up + down)


def rolling(x: np.ndarray, n: int, f: Callable[[np.ndarray], float]) -> np.ndarray:
    out = np.full(len(x), NAN)
    for i in range(_from(x) + n - 1, len(x)):
        out[i] = f(x[i - n + 1 : i + 1])
    return out


def stochrsi(x: np.ndarray, n: int, fastk: int, fastd: int) -> tuple[np.ndarray, np.ndarray]:
    r = rsi(x, n)
    low, high = rolling(r, fastk, np.min), rolling(r, fastk, np.max)
    k = 100 * _ratio(r - low, high - low)
    d = rolling(k, fastd, np.mean)
    return np.where(np.isnan(d), NAN, k), d


def true_range(h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.full(len(h), NAN)
    out[1:] = np.maximum(h[1:], c[:-1]) - np.minimum(lo[1:], c[:-1])
    return out


def atr(h: np.ndarray, lo: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    return wilder(true_range(h, lo, c), n)


def _moves(h: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.append(NAN, np.diff(h)), np.append(NAN, -np.diff(lo))
    return np.where(np.isnan(up), NAN, np.where((up > down) & (up > 0), up, 0)), np.where(np.isnan(up), NAN, np.where((down > up) & (down > 0), down, 0))


def wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    """s = s' - s'/n + x, seeded with the sum of the first n - 1 values."""
    out = np.full(len(x), NAN)
    at = _from(x) + n - 2
    if at >= len(x):
        return out
    s = out[at] = x[at - n + 2 : at + 1].sum()
    for i in range(at + 1, len(x)):
        s = out[i] = s - s / n + x[i]
    return out


def directional(h: np.ndarray, lo: np.ndarray, c: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """PLUS_DM, MINUS_DM, PLUS_DI, MINUS_DI, DX, ADX, ADXR."""
    plus, minus = (wilder_sum(x, n) for x in _moves(h, lo))
    tr = wilder_sum(true_range(h, lo, c), n)
    late = np.arange(len(h)) < n  # the first sum is not shown as an index
    pdi, mdi = (np.where(late, NAN, 100 * _ratio(x, tr)) for x in (plus, minus))
    total = pdi + mdi
    dx = np.full(len(h), NAN)
    last = 0.0
    for i in range(n, len(h)):
        if total[i] > 0:
            last = 100 * abs(pdi[i] - mdi[i]) / total[i]
        dx[i] = last
    adx = wilder(dx, n)
    adxr = np.full(len(h), NAN)
    adxr[n - 1 :] = (adx[n - 1 :] + adx[: len(adx) - n + 1]) / 2
    return {"plus_dm": plus, "minus_dm": minus, "plus_di": pdi, "minus_di": mdi, "dx": dx, "adx": adx, "adxr": adxr}


def adosc(h: np.ndarray, lo: np.ndarray, c: np.ndarray, v: np.ndarray, fast: int, slow: int) -> np.ndarray:
    ad = np.cumsum(_ratio((c - lo) - (h - c), h - lo) * v)
    a = b = ad[0] if len(ad) else 0.0
    out = np.full(len(h), NAN)
    for i in range(1, len(ad)):
        a += 2 / (fast + 1) * (ad[i] - a)
        b += 2 / (slow + 1) * (ad[i] - b)
        if i >= max(fast, slow) - 1:
            out[i] = a - b
    return out


def sar(h: np.ndarray, lo: np.ndarray, step: float, most: float, signed: bool = False) -> np.ndarray:
    """Parabolic stop and reverse; the first direction follows the larger directional move. signed: negative while short."""
    out = np.full(len(h), NAN)
    if len(h) < 2:
        return out
    down = lo[0] - lo[1]
    up = h[1] - h[0]
    long = not (down > up and down > 0)
    extreme, stop, rate = (h[1], lo[0], step) if long else (lo[1], h[0], step)
    hi, low = h[1], lo[1]
    for i in range(1, len(h)):
        before_h, before_l, hi, low = hi, low, h[i], lo[i]
        shown_long = long
        if long and low <= stop or not long and hi >= stop:
            long = not long
            stop = max(extreme, before_h, hi) if not long else min(extreme, before_l, low)
            shown = stop
            shown_long = long
            rate, extreme = step, (low if not long else hi)
            stop = stop + rate * (extreme - stop)
            stop = max(stop, before_h, hi) if not long else min(stop, before_l, low)
        else:
            shown = stop
            if long and hi > extreme or not long and low < extreme:
                extreme, rate = (hi if long else low), min(rate + step, most)
            stop = stop + rate * (extreme - stop)
            stop = min(stop, before_l, low) if long else max(stop, before_h, hi)
        out[i] = shown if shown_long or not signed else -shown
    return out


def hilbert(x: np.ndarray, fast: float = 0.5, slow: float = 0.05, first: int = 12) -> dict[str, np.ndarray]:
    """Ehlers' homodyne discriminator: dominant cycle, phasor, phase, sine, trend line and mode, MAMA and FAMA.

    first: the bar the state starts from (all 0 before it): 12 for what shows after 32 bars, 37 for what shows after 63.
    """
    n = len(x)
    names = ("dcperiod", "inphase", "quadrature", "dcphase", "sine", "leadsine", "trendline", "trendmode", "mama", "fama")
    out = {k: np.full(n, NAN) for k in names}
    weights = np.array([4, 3, 2, 1]) / 10
    price, detrend, q1, i1, ji, jq = (np.zeros(n) for _ in range(6))
    smooth_period, trend = np.zeros(n), np.zeros(n)
    i2 = q2 = re = im = period = mama_ = fama_ = phase_ = 0.0
    days, last_phase, last_lead, last_sine = 0, 0.0, 0.0, 0.0

    def quad(s: np.ndarray, i: int, adjust: float) -> float:
        return (0.0962 * s[i] + 0.5769 * s[i - 2] - 0.5769 * s[i - 4] - 0.0962 * s[i - 6]) * adjust

    for i in range(first, n):
        price[i] = weights @ x[i - np.arange(4)]
        adjust = 0.075 * period + 0.54
        detrend[i] = quad(price, i, adjust)
        q1[i], i1[i] = quad(detrend, i, adjust), detrend[i - 3]
        ji[i], jq[i] = quad(i1, i, adjust), quad(q1, i, adjust)
        i2, q2, before_i, before_q = 0.2 * (i1[i] - jq[i]) + 0.8 * i2, 0.2 * (q1[i] + ji[i]) + 0.8 * q2, i2, q2
        re, im = 0.2 * (i2 * before_i + q2 * before_q) + 0.8 * re, 0.2 * (i2 * before_q - q2 * before_i) + 0.8 * im
        before = period
        if im and re:
            period = 360 / math.degrees(math.atan(im / re))
        period = min(max(period, 0.67 * before, 6.0), 1.5 * before if 1.5 * before > 6 else 6.0, 50.0) if before else min(max(period, 6.0), 50.0)
        period = 0.2 * period + 0.8 * before
        smooth_period[i] = 0.33 * period + 0.67 * smooth_period[i - 1]
        # adaptive averages
        phase = math.degrees(math.atan(q1[i] / i1[i])) if i1[i] else 0.0
        alpha = max(min(fast / max(phase_ - phase, 1.0), fast), slow)
        phase_ = phase
        mama_ = alpha * x[i] + (1 - alpha) * mama_
        fama_ = 0.5 * alpha * mama_ + (1 - 0.5 * alpha) * fama_
        if i >= 32:
            out["dcperiod"][i], out["inphase"][i], out["quadrature"][i], out["mama"][i], out["fama"][i] = smooth_period[i], i1[i], q1[i], mama_, fama_
        # phase of the dominant cycle over one whole period
        size = int(smooth_period[i] + 0.5)
        angle = 2 * math.pi * np.arange(size) / size if size else np.zeros(0)
        part = price[i - np.arange(size)] if i >= size else np.zeros(size)
        real, imag = float((np.sin(angle) * part).sum()), float((np.cos(angle) * part).sum())
        dc = math.degrees(math.atan(real / imag)) if abs(imag) > 0 else (90.0 if real > 0 else -90.0 if real < 0 else 0.0)
        dc += 90 + (360 / smooth_period[i] if smooth_period[i] else 0)
        dc = dc + 180 if imag < 0 else dc
        dc = dc - 360 if dc > 315 else dc
        sine, lead = math.sin(math.radians(dc)), math.sin(math.radians(dc + 45))
        trend[i] = x[max(0, i - size + 1) : i + 1].mean() if size else 0.0
        line = (4 * trend[i] + 3 * trend[i - 1] + 2 * trend[i - 2] + trend[i - 3]) / 10
        crossed = sine > lead and last_sine <= last_lead or sine < lead and last_sine >= last_lead
        days = 1 if crossed else days + 1
        mode = 0 if crossed or days < 0.5 * smooth_period[i] else 1
        turn = dc - last_phase
        if smooth_period[i] and 0.67 * 360 / smooth_period[i] < turn < 1.5 * 360 / smooth_period[i]:
            mode = 0
        if line and abs((price[i] - line) / line) >= 0.015:
            mode = 1
        last_phase, last_sine, last_lead = dc, sine, lead
        if i >= 63:
            out["dcphase"][i], out["sine"][i], out["leadsine"][i], out["trendline"][i], out["trendmode"][i] = dc, sine, lead, line, mode
    return out


def ewm(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean seeded with the first value."""
    out, k = np.full(len(x), NAN), 2.0 / (span + 1)
    y = NAN
    for i, v in enumerate(x):
        y = out[i] = v if np.isnan(y) else y + k * (v - y)
    return out


#: name: (input columns, parameters with defaults, output names, function)
RECURSIVE: dict[str, tuple[tuple[str, ...], dict[str, float], tuple[str, ...], Callable]] = {
    "EMA": (("close",), {"timeperiod": 30}, ("ema",), lambda c, timeperiod: (ema(c, timeperiod),)),
    "DEMA": (("close",), {"timeperiod": 30}, ("dema",), lambda c, timeperiod: (dema(c, timeperiod),)),
    "TEMA": (("close",), {"timeperiod": 30}, ("tema",), lambda c, timeperiod: (tema(c, timeperiod),)),
    "T3": (("close",), {"timeperiod": 5, "vfactor": 0.7}, ("t3",), lambda c, timeperiod, vfactor: (t3(c, timeperiod, vfactor),)),
    "KAMA": (("close",), {"timeperiod": 10}, ("kama",), lambda c, timeperiod: (kama(c, timeperiod),)),
    "MACD": (("close",), {"fastperiod": 12, "slowperiod": 26, "signalperiod": 9}, ("macd", "macd_signal", "macd_hist"), lambda c, fastperiod, slowperiod, signalperiod: macd(c, fastperiod, slowperiod, signalperiod)),
    "MACDFIX": (("close",), {"signalperiod": 9}, ("macdfix", "macdfix_signal", "macdfix_hist"), lambda c, signalperiod: macd(c, 12, 26, signalperiod)),
    "TRIX": (("close",), {"timeperiod": 30}, ("trix",), lambda c, timeperiod: (trix(c, timeperiod),)),
    "RSI": (("close",), {"timeperiod": 14}, ("rsi",), lambda c, timeperiod: (rsi(c, timeperiod),)),
    "CMO": (("close",), {"timeperiod": 14}, ("cmo",), lambda c, timeperiod: (cmo(c, timeperiod),)),
    "STOCHRSI": (("close",), {"timeperiod": 14, "fastk_period": 3, "fastd_period": 3}, ("stochrsi_k", "stochrsi_d"), lambda c, timeperiod, fastk_period, fastd_period: stochrsi(c, timeperiod, fastk_period, fastd_period)),
    "ATR": (("high", "low", "close"), {"timeperiod": 14}, ("atr",), lambda h, lo, c, timeperiod: (atr(h, lo, c, timeperiod),)),
    "NATR": (("high", "low", "close"), {"timeperiod": 14}, ("natr",), lambda h, lo, c, timeperiod: (100 * _ratio(atr(h, lo, c, timeperiod), c),)),
    **{
        name: (("high", "low", "close"), {"timeperiod": 14}, (name.lower(),), lambda h, lo, c, timeperiod, k=name.lower(): (directional(h, lo, c, timeperiod)[k],))
        for name in ("PLUS_DM", "MINUS_DM", "PLUS_DI", "MINUS_DI", "DX", "ADX", "ADXR")
    },
    "ADOSC": (("high", "low", "close", "volume"), {"fastperiod": 3, "slowperiod": 10}, ("adosc",), lambda h, lo, c, v, fastperiod, slowperiod: (adosc(h, lo, c, v, fastperiod, slowperiod),)),
    "SAR": (("high", "low"), {"acceleration": 0.02, "maximum": 0.2}, ("sar",), lambda h, lo, acceleration, maximum: (sar(h, lo, acceleration, maximum),)),
    "SAREXT": (("high", "low"), {}, ("sarext",), lambda h, lo: (sar(h, lo, 0.02, 0.2, signed=True),)),
    "MAMA": (("close",), {"fastlimit": 0.5, "slowlimit": 0.05}, ("mama", "fama"), lambda c, fastlimit, slowlimit: tuple(hilbert(c, fastlimit, slowlimit)[k] for k in ("mama", "fama"))),
    **{
        name: (("close",), {}, outs, lambda c, keys=keys, first=first: tuple(hilbert(c, first=first)[k] for k in keys))
        for name, outs, keys, first in (
            ("HT_TRENDLINE", ("ht_trendline",), ("trendline",), 37),
            ("HT_DCPERIOD", ("ht_dcperiod",), ("dcperiod",), 12),
            ("HT_DCPHASE", ("ht_dcphase",), ("dcphase",), 37),
            ("HT_PHASOR", ("ht_inphase", "ht_quadrature"), ("inphase", "quadrature"), 12),
            ("HT_SINE", ("ht_sine", "ht_leadsine"), ("sine", "leadsine"), 37),
            ("HT_TRENDMODE", ("ht_trendmode",), ("trendmode",), 37),
        )
    },
}


def run(bars: DataFrame, wanted: dict[str, tuple[str, dict[str, float]]], keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Add recursive indicators, all in one pass a series. wanted: prefix -> (indicator, parameters)."""
    made, tasks = [], []
    for prefix, (name, given) in wanted.items():
        inputs, defaults, outputs, f = RECURSIVE[name]
        outs = [f"{prefix}{o}" for o in outputs]
        made += outs
        tasks.append((inputs, defaults | given, outs, f))
    schema = T.StructType([*bars.schema.fields, *[T.StructField(o, T.DoubleType()) for o in made]])

    def series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable").reset_index(drop=True)
        new = {}
        for inputs, params, outs, f in tasks:
            arrays = f(*(rows[i].to_numpy(float) for i in inputs), **{k: int(v) if float(v).is_integer() and k.endswith("period") else v for k, v in params.items()})
            new |= dict(zip(outs, arrays, strict=True))
        new = pd.DataFrame(new, index=rows.index)
        return pd.concat([rows, new.where(np.isfinite(new), None).astype("Float64") if len(new) else new], axis=1)

    return bars.groupBy(*keys).applyInPandas(series, schema)
