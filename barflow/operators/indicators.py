"""All indicators by name: inputs, parameters and signal rule, and one call that adds many."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from barflow.functions.windows import Series
from barflow.operators import kernels
from barflow.operators.fir import FINITE


@dataclass(frozen=True)
class Indicator:
    """rule: how the indicator's columns become a signal; price: the reference price of price_cross; low, high: of threshold."""

    name: str
    rule: str
    price: str = "close"
    low: float | None = None
    high: float | None = None
    params: dict[str, float] = field(default_factory=dict)

    @property
    def recursive(self) -> bool:
        return self.name in kernels.RECURSIVE

    @property
    def defaults(self) -> dict[str, float]:
        return kernels.RECURSIVE[self.name][1] if self.recursive else FINITE[self.name][0]

    @property
    def outputs(self) -> tuple[str, ...]:
        return kernels.RECURSIVE[self.name][2] if self.recursive else FINITE[self.name][1]


# The rule of each indicator.
_RULES = {
    "price_cross": "SMA EMA DEMA TEMA TRIMA WMA KAMA MA T3 HT_TRENDLINE MIDPOINT LINEARREG TSF MIDPRICE SAR SAREXT AVGPRICE MEDPRICE TYPPRICE WCLPRICE",
    "line_cross": "MAMA MACD MACDEXT STOCH STOCHF STOCHRSI AROON HT_PHASOR HT_SINE",
    "zero_cross": "PPO APO ADOSC CCI CMO MOM ROC ROCP TRIX BOP ADXR AROONOSC MINUS_DI MINUS_DM PLUS_DI PLUS_DM LINEARREG_ANGLE LINEARREG_INTERCEPT LINEARREG_SLOPE",
    "threshold": "RSI WILLR MFI ROCR ROCR100",
    "mean_cross": "ADX DX ATR NATR TRANGE STDDEV VAR",
    "prev_cross": "OBV AD HT_DCPERIOD HT_DCPHASE",
    "bbands": "BBANDS",
    "trend_mode": "HT_TRENDMODE",
    "none": "MACDFIX ULTOSC CORREL",
}
_PRICES = {"MIDPRICE": "hl2", "AVGPRICE": "ohlc4", "MEDPRICE": "hl2", "TYPPRICE": "hlc3", "WCLPRICE": "wclprice"}
_LEVELS = {"RSI": (30.0, 70.0), "WILLR": (-80.0, -20.0), "MFI": (20.0, 80.0), "ROCR": (1.0, 1.0), "ROCR100": (100.0, 100.0)}

INDICATORS: dict[str, Indicator] = {n: Indicator(n, rule, _PRICES.get(n, "close"), *_LEVELS.get(n, (None, None))) for rule, names in _RULES.items() for n in names.split()}


def resolve(name: str, given: dict | None) -> dict[str, float]:
    """An indicator's parameters: defaults, then ``period`` or own names, flat or under the indicator's name; 0, None and unknown names are ignored."""
    known = INDICATORS[name].defaults
    given = dict(given or {})
    nested = next((v for k, v in given.items() if isinstance(v, dict) and k.upper() == name), None)
    flat = {k: v for k, v in (nested if nested is not None else given).items() if not isinstance(v, dict)}
    out = dict(known)
    for k, v in flat.items():
        own = "timeperiod" if k == "period" else k
        if own in known and v:
            out[own] = int(v) if float(v).is_integer() else float(v)
    return out


def window_of(name: str, given: dict | None = None) -> int:
    """The longest of an indicator's periods (1 without any)."""
    return max([int(v) for k, v in resolve(name, given).items() if "period" in k] or [1])


def add_indicators(bars: DataFrame, wanted: dict[str, dict] | list[str], keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Bars with the columns of each wanted indicator; names that do not exist raise at once.

    All window indicators share one exchange by ``keys``; all recursive ones are one ordered pass a series.
    """
    wanted = {n: {} for n in wanted} if not isinstance(wanted, dict) else wanted
    if unknown := [n for n in wanted if n not in INDICATORS]:
        raise ValueError(f"unknown indicators: {', '.join(unknown)}")
    series, out = Series(keys, time), bars
    recursive = {f"__{n}_": (n, resolve(n, p)) for n, p in wanted.items() if INDICATORS[n].recursive}
    if recursive:
        out = kernels.run(out, recursive, keys, time)
        out = out.withColumnsRenamed({f"__{n}_{o}": o for n in wanted if INDICATORS[n].recursive for o in INDICATORS[n].outputs})
    for n, p in wanted.items():
        if not INDICATORS[n].recursive:
            _, outputs, build = FINITE[n]
            out = build(out, series, list(outputs), **resolve(n, p))
    return out
