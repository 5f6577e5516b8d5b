"""Indicators with a finite or cumulative memory, as window expressions.

Each builder takes a DataFrame of bars and returns it with its columns added; those
that are windows of windows add the inner one first and drop it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.windows import Series, correlation, ratio



def _c(name: str) -> Column:
    return F.col(name)


def triangle(n: int) -> list[float]:
    """The weights of a mean of means: (n + 1) / 2 twice for odd n, n / 2 and n / 2 + 1 else."""
    a, b = ((n + 1) // 2,) * 2 if n % 2 else (n // 2, n // 2 + 1)
    return [sum(1 for i in range(a) if 0 <= k - i < b) / (a * b) for k in range(n)]


def point(expression: Callable[[], Column]) -> Callable:
    return lambda df, s, out: df.withColumn(out[0], expression())


def of_close(f: Callable[[Series, Column, int], Column]) -> Callable:
    return lambda df, s, out, timeperiod: df.withColumn(out[0], f(s, _c("close"), int(timeperiod)))


def _moving(df: DataFrame, s: Series, x: str, n: int, out: str) -> DataFrame:
    return df.withColumn(out, s.mean(_c(x), n))


def bbands(df, s, out, timeperiod, nbdevup, nbdevdn):
    n, c = int(timeperiod), _c("close")
    mid, dev = s.mean(c, n), s.stddev(c, n)
    return df.withColumns({out[0]: mid + nbdevup * dev, out[1]: mid, out[2]: mid - nbdevdn * dev})


def midprice(df, s, out, timeperiod):
    n = int(timeperiod)
    return df.withColumn(out[0], (s.max(_c("high"), n) + s.min(_c("low"), n)) / 2)


def apo(df, s, out, fastperiod, slowperiod):
    c = _c("close")
    return df.withColumn(out[0], F.when(s.mean(c, int(slowperiod)).isNotNull(), s.mean(c, int(fastperiod)) - s.mean(c, int(slowperiod))))


def ppo(df, s, out, fastperiod, slowperiod):
    c = _c("close")
    slow = s.mean(c, int(slowperiod))
    return df.withColumn(out[0], 100 * ratio(s.mean(c, int(fastperiod)) - slow, slow))


def macdext(df, s, out, fastperiod, slowperiod, signalperiod):
    df = apo(df, s, ["__line"], fastperiod, slowperiod)
    df = df.withColumn(out[1], s.mean(_c("__line"), int(signalperiod)))
    return df.withColumns({out[0]: F.when(_c(out[1]).isNotNull(), _c("__line")), out[2]: _c("__line") - _c(out[1])}).drop("__line")


def aroon_lines(s: Series, n: int) -> tuple[Column, Column]:
    """(down, up): the latest extreme counts among equals."""
    frame = s.last(n + 1)
    row = F.row_number().over(s.order)
    since = lambda pick: row - pick.over(frame)
    low = F.max_by(F.col("__row"), F.struct(-_c("low"), F.col("__row")))
    high = F.max_by(F.col("__row"), F.struct(_c("high"), F.col("__row")))
    full = lambda x: F.when(row > n, 100.0 * (n - since(x)) / n)
    return full(low), full(high)


def aroon(df, s, out, timeperiod):
    down, up = aroon_lines(s, int(timeperiod))
    return df.withColumn("__row", F.row_number().over(s.order)).withColumns({out[0]: down, out[1]: up}).drop("__row")


def aroonosc(df, s, out, timeperiod):
    return aroon(df, s, ["__down", "__up"], timeperiod).withColumn(out[0], _c("__up") - _c("__down")).drop("__down", "__up")


def cci(df, s, out, timeperiod):
    n = int(timeperiod)
    typical = (_c("high") + _c("low") + _c("close")) / 3
    df = df.withColumn("__tp", typical)
    df = df.withColumns({"__mean": s.mean(_c("__tp"), n), "__list": s.values(_c("__tp"), n)})
    away = F.aggregate("__list", F.lit(0.0), lambda a, x: a + F.abs(x - _c("__mean"))) / n
    top = _c("__tp") - _c("__mean")
    return df.withColumn(out[0], F.when((top != 0) & (away != 0), ratio(top, 0.015 * away)).when(_c("__mean").isNotNull(), 0.0)).drop("__tp", "__mean", "__list")


def willr(df, s, out, timeperiod):
    high, low = s.max(_c("high"), int(timeperiod)), s.min(_c("low"), int(timeperiod))
    return df.withColumn(out[0], F.when(high == low, 0.0).otherwise(-100 * ratio(high - _c("close"), high - low)))


def mfi(df, s, out, timeperiod):
    n = int(timeperiod)
    tp = (_c("high") + _c("low") + _c("close")) / 3
    df = df.withColumn("__tp", tp).withColumn("__before", s.lag(_c("__tp")))
    flow = _c("__tp") * _c("volume")
    df = df.withColumns({"__up": F.when(_c("__before").isNotNull(), F.when(_c("__tp") > _c("__before"), flow).otherwise(0.0)), "__down": F.when(_c("__before").isNotNull(), F.when(_c("__tp") < _c("__before"), flow).otherwise(0.0))})
    up, down = s.sum(_c("__up"), n), s.sum(_c("__down"), n)
    return df.withColumn(out[0], F.when(up + down < 1, 0.0).otherwise(100 * ratio(up, up + down))).drop("__tp", "__before", "__up", "__down")


def obv(df, s, out):
    df = df.withColumn("__step", F.when(s.lag(_c("close")).isNull(), _c("volume")).otherwise(F.signum(_c("close") - s.lag(_c("close"))) * _c("volume")))
    return df.withColumn(out[0], F.sum("__step").over(s.running)).drop("__step")


def ad(df, s, out):
    span = _c("high") - _c("low")
    step = F.when(span > 0, ((_c("close") - _c("low")) - (_c("high") - _c("close"))) / span * _c("volume")).otherwise(0.0)
    return df.withColumn("__step", step).withColumn(out[0], F.sum("__step").over(s.running)).drop("__step")


def trange(df, s, out):
    before = s.lag(_c("close"))
    return df.withColumn(out[0], F.when(before.isNotNull(), F.greatest(_c("high"), before) - F.least(_c("low"), before)))


def regression(s: Series, n: int) -> tuple[Column, Column]:
    """(slope, value at the first of the last n points); sums against fixed x keep it one frame."""
    c = _c("close")
    xs = [k - (n - 1) / 2 for k in range(n)]
    slope = s.dot(c, xs) / sum(x * x for x in xs)
    return slope, s.mean(c, n) - slope * (n - 1) / 2


def linear(kind: str) -> Callable:
    def build(df, s, out, timeperiod):
        n = int(timeperiod)
        slope, first = regression(s, n)
        df = df.withColumns({"__slope": slope, "__first": first})
        made = {"value": _c("__first") + _c("__slope") * (n - 1), "angle": F.degrees(F.atan("__slope")), "intercept": _c("__first"), "slope": _c("__slope"), "next": _c("__first") + _c("__slope") * n}
        return df.withColumn(out[0], made[kind]).drop("__slope", "__first")

    return build


def stochf(df, s, out, fastk_period, fastd_period):
    high, low = s.max(_c("high"), int(fastk_period)), s.min(_c("low"), int(fastk_period))
    df = df.withColumn("__k", F.when(high == low, 0.0).otherwise(100 * ratio(_c("close") - low, high - low)))
    df = df.withColumn(out[1], s.mean(_c("__k"), int(fastd_period)))
    return df.withColumn(out[0], F.when(_c(out[1]).isNotNull(), _c("__k"))).drop("__k")


def stoch(df, s, out, fastk_period, slowk_period, slowd_period):
    df = stochf(df, s, ["__f", "__slow"], fastk_period, slowk_period)
    df = df.withColumn(out[1], s.mean(_c("__slow"), int(slowd_period)))
    return df.withColumn(out[0], F.when(_c(out[1]).isNotNull(), _c("__slow"))).drop("__f", "__slow")


def ultosc(df, s, out, timeperiod1, timeperiod2, timeperiod3):
    before = s.lag(_c("close"))
    df = df.withColumns({"__bp": F.when(before.isNotNull(), _c("close") - F.least(_c("low"), before)), "__tr": F.when(before.isNotNull(), F.greatest(_c("high"), before) - F.least(_c("low"), before))})
    part = lambda n: ratio(s.sum(_c("__bp"), int(n)), s.sum(_c("__tr"), int(n)))
    return df.withColumn(out[0], 100 * (4 * part(timeperiod1) + 2 * part(timeperiod2) + part(timeperiod3)) / 7).drop("__bp", "__tr")


def correl(df, s, out, timeperiod):
    n = int(timeperiod)
    return df.withColumn(out[0], s.full(_c("high"), correlation(_c("high"), _c("low"), s.last(n)), n))


def _past(f: Callable[[Column, Column], Column]) -> Callable:
    return of_close(lambda s, c, n: f(c, s.lag(c, n)))


N14, N10, N30, N5 = ({"timeperiod": n} for n in (14, 10, 30, 5))

#: name: (parameters with defaults, output names, builder)
FINITE: dict[str, tuple[dict[str, float], tuple[str, ...], Callable]] = {
    "SMA": (N30, ("sma",), of_close(lambda s, c, n: s.mean(c, n))),
    "MA": (N30, ("ma",), of_close(lambda s, c, n: s.mean(c, n))),
    "WMA": (N30, ("wma",), of_close(lambda s, c, n: s.dot(c, [2 * (k + 1) / (n * (n + 1)) for k in range(n)]))),
    "TRIMA": (N30, ("trima",), of_close(lambda s, c, n: s.dot(c, triangle(n)))),
    "BBANDS": ({"timeperiod": 5, "nbdevup": 2, "nbdevdn": 2}, ("bb_upper", "bb_middle", "bb_lower"), bbands),
    "MIDPOINT": (N14, ("midpoint",), of_close(lambda s, c, n: (s.max(c, n) + s.min(c, n)) / 2)),
    "MIDPRICE": (N14, ("midprice",), midprice),
    "WCLPRICE": ({}, ("wclprice",), point(lambda: (_c("high") + _c("low") + 2 * _c("close")) / 4)),
    "AVGPRICE": ({}, ("avgprice",), point(lambda: (_c("open") + _c("high") + _c("low") + _c("close")) / 4)),
    "MEDPRICE": ({}, ("medprice",), point(lambda: (_c("high") + _c("low")) / 2)),
    "TYPPRICE": ({}, ("typprice",), point(lambda: (_c("high") + _c("low") + _c("close")) / 3)),
    "APO": ({"fastperiod": 12, "slowperiod": 26}, ("apo",), apo),
    "PPO": ({"fastperiod": 12, "slowperiod": 26}, ("ppo",), ppo),
    "MACDEXT": ({"fastperiod": 12, "slowperiod": 26, "signalperiod": 9}, ("macdext", "macdext_signal", "macdext_hist"), macdext),
    "MOM": (N10, ("mom",), _past(lambda c, p: c - p)),
    "ROC": (N10, ("roc",), _past(lambda c, p: 100 * (ratio(c, p) - 1))),
    "ROCP": (N10, ("rocp",), _past(lambda c, p: ratio(c - p, p))),
    "ROCR": (N10, ("rocr",), _past(lambda c, p: ratio(c, p))),
    "ROCR100": (N10, ("rocr100",), _past(lambda c, p: 100 * ratio(c, p))),
    "AROON": (N14, ("aroon_down", "aroon_up"), aroon),
    "AROONOSC": (N14, ("aroonosc",), aroonosc),
    "BOP": ({}, ("bop",), point(lambda: F.when(_c("high") - _c("low") > 0, (_c("close") - _c("open")) / (_c("high") - _c("low"))).otherwise(0.0))),
    "CCI": (N14, ("cci",), cci),
    "WILLR": (N14, ("willr",), willr),
    "MFI": (N14, ("mfi",), mfi),
    "OBV": ({}, ("obv",), obv),
    "AD": ({}, ("ad",), ad),
    "TRANGE": ({}, ("trange",), trange),
    "LINEARREG": (N14, ("linearreg",), linear("value")),
    "LINEARREG_ANGLE": (N14, ("linearreg_angle",), linear("angle")),
    "LINEARREG_INTERCEPT": (N14, ("linearreg_intercept",), linear("intercept")),
    "LINEARREG_SLOPE": (N14, ("linearreg_slope",), linear("slope")),
    "TSF": (N14, ("tsf",), linear("next")),
    "STDDEV": (N5, ("stddev",), of_close(lambda s, c, n: s.stddev(c, n))),
    "VAR": (N5, ("var",), of_close(lambda s, c, n: s.variance(c, n))),
    "STOCHF": ({"fastk_period": 14, "fastd_period": 3}, ("stochf_k", "stochf_d"), stochf),
    "STOCH": ({"fastk_period": 14, "slowk_period": 3, "slowd_period": 3}, ("stoch_k", "stoch_d"), stoch),
    "ULTOSC": ({"timeperiod1": 7, "timeperiod2": 14, "timeperiod3": 28}, ("ultosc",), ultosc),
    "CORREL": (N30, ("correl",), correl),
}
