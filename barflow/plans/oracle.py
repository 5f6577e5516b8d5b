"""DuckDB SQL with the rows of the registered queries, written from the definitions."""

from __future__ import annotations

from barflow.plans import candle_sql, more_sql, text_sql
from barflow.plans.queries import CANDLES, TRAPS

TICKS = "ticks AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS datetime, event_id, CAST(value AS DOUBLE) AS price FROM events)"


def bucketed(name: str, width: str, source: str = "ticks", tie: str = "event_id", volume: str = "count(*)") -> str:
    return f"""{name} AS (SELECT symbol, bucket AS datetime, open, high, low, close, volume FROM (
        SELECT symbol, time_bucket(INTERVAL '{width}', datetime) AS bucket, arg_min(price, (datetime, {tie})) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, (datetime, {tie})) AS close, CAST({volume} AS DOUBLE) AS volume, min(min(datetime)) OVER (PARTITION BY symbol) AS first_time
        FROM {source} GROUP BY symbol, bucket) WHERE bucket >= first_time)"""


BARS = f"{TICKS}, {bucketed('bars', '1 hour')}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS rn FROM bars)"


def w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY datetime ROWS {n - 1} PRECEDING)"


def guard(x: str, n: int) -> str:
    return f"CASE WHEN rn >= {n} THEN {x} END"


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def over(select: dict[str, str], source: str = "b", ctes: str = "") -> str:
    cols = ", ".join(f"{r(x)} AS {n}" for n, x in select.items())
    return f"WITH RECURSIVE {BARS}{', ' + ctes if ctes else ''} SELECT symbol, datetime, {cols} FROM {source}"


def mean(x: str, n: int) -> str:
    return guard(f"avg({x}) OVER {w(n)}", n)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY datetime)"


def averaged(name: str, source: str, x: str, n: int, late: int = 0) -> str:
    """A CTE with the mean of n values of a column that is null at first."""
    return f"{name} AS (SELECT *, CASE WHEN count({x}) OVER {w(n)} = {n} THEN avg({x}) OVER {w(n)} END AS {name}_v FROM {source})"


SLOPE14 = "regr_slope(close, rn) OVER " + w(14)
FIRST14 = "(avg(close) OVER " + w(14) + " - 6.5 * " + SLOPE14 + ")"
_C = "close"
_K14 = f"CASE WHEN rn >= 14 THEN CASE WHEN max(high) OVER {w(14)} = min(low) OVER {w(14)} THEN 0 ELSE 100 * (close - min(low) OVER {w(14)}) / nullif(max(high) OVER {w(14)} - min(low) OVER {w(14)}, 0) END END"
_BEFORE = f"before AS (SELECT *, {lag('close')} AS c1, (high + low + close) / 3 AS tp FROM b)"
_TR = "CASE WHEN c1 IS NOT NULL THEN greatest(high, c1) - least(low, c1) END"


def _trima(n: int) -> str:
    from barflow.operators.fir import triangle

    return guard(" + ".join(f"{weight!r} * coalesce({lag('close', n - 1 - k) if n - 1 - k else 'close'}, 0)" for k, weight in enumerate(triangle(n))), n)


def _wma(n: int) -> str:
    return guard(" + ".join(f"{2 * (k + 1) / (n * (n + 1))!r} * coalesce({lag('close', n - 1 - k) if n - 1 - k else 'close'}, 0)" for k in range(n)), n)


FINITE_SQL = {
    "SMA": over({"sma": mean(_C, 30)}),
    "MA": over({"ma": mean(_C, 30)}),
    "WMA": over({"wma": _wma(30)}),
    "TRIMA": over({"trima": _trima(30)}),
    "BBANDS": over({"bb_upper": f"{mean(_C, 5)} + 2 * stddev_pop(close) OVER {w(5)}", "bb_middle": mean(_C, 5), "bb_lower": f"{mean(_C, 5)} - 2 * stddev_pop(close) OVER {w(5)}"}),
    "MIDPOINT": over({"midpoint": guard(f"(max(close) OVER {w(14)} + min(close) OVER {w(14)}) / 2", 14)}),
    "MIDPRICE": over({"midprice": guard(f"(max(high) OVER {w(14)} + min(low) OVER {w(14)}) / 2", 14)}),
    "WCLPRICE": over({"wclprice": "(high + low + 2 * close) / 4"}),
    "AVGPRICE": over({"avgprice": "(open + high + low + close) / 4"}),
    "MEDPRICE": over({"medprice": "(high + low) / 2"}),
    "TYPPRICE": over({"typprice": "(high + low + close) / 3"}),
    "APO": over({"apo": guard(f"avg(close) OVER {w(12)} - avg(close) OVER {w(26)}", 26)}),
    "PPO": over({"ppo": guard(f"100 * (avg(close) OVER {w(12)} - avg(close) OVER {w(26)}) / nullif(avg(close) OVER {w(26)}, 0)", 26)}),
    "MACDEXT": over(
        {"macdext": "CASE WHEN sig_v IS NOT NULL THEN line END", "macdext_signal": "sig_v", "macdext_hist": "line - sig_v"}, "sig", f"l AS (SELECT *, {guard(f'avg(close) OVER {w(12)} - avg(close) OVER {w(26)}', 26)} AS line FROM b), {averaged('sig', 'l', 'line', 9)}"
    ),
    "MOM": over({"mom": f"close - {lag('close', 10)}"}),
    "ROC": over({"roc": f"100 * (close / nullif({lag('close', 10)}, 0) - 1)"}),
    "ROCP": over({"rocp": f"(close - {lag('close', 10)}) / nullif({lag('close', 10)}, 0)"}),
    "ROCR": over({"rocr": f"close / nullif({lag('close', 10)}, 0)"}),
    "ROCR100": over({"rocr100": f"100 * close / nullif({lag('close', 10)}, 0)"}),
    "AROON": over({"aroon_down": guard(f"100.0 * (14 - (rn - arg_max(rn, (-low, rn)) OVER {w(15)})) / 14", 15), "aroon_up": guard(f"100.0 * (14 - (rn - arg_max(rn, (high, rn)) OVER {w(15)})) / 14", 15)}),
    "AROONOSC": over({"aroonosc": guard(f"100.0 * (arg_max(rn, (high, rn)) OVER {w(15)} - arg_max(rn, (-low, rn)) OVER {w(15)}) / 14", 15)}),
    "BOP": over({"bop": "CASE WHEN high - low > 0 THEN (close - open) / (high - low) ELSE 0 END"}),
    "CCI": over(
        {"cci": "CASE WHEN rn >= 14 THEN CASE WHEN tp - m <> 0 AND away <> 0 THEN (tp - m) / (0.015 * away) ELSE 0 END END"},
        "away",
        f"{_BEFORE}, m AS (SELECT *, avg(tp) OVER {w(14)} AS m, list(tp) OVER {w(14)} AS tps FROM before), away AS (SELECT *, list_avg(list_transform(tps, lambda x: abs(x - m))) AS away FROM m)",
    ),
    "WILLR": over({"willr": guard(f"CASE WHEN max(high) OVER {w(14)} = min(low) OVER {w(14)} THEN 0 ELSE -100 * (max(high) OVER {w(14)} - close) / nullif(max(high) OVER {w(14)} - min(low) OVER {w(14)}, 0) END", 14)}),
    "MFI": over(
        {"mfi": "CASE WHEN rn > 14 THEN CASE WHEN up + down < 1 THEN 0 ELSE 100 * up / (up + down) END END"},
        "s",
        f"{_BEFORE}, f AS (SELECT *, tp - {lag('tp')} AS step FROM before), s AS (SELECT *, sum(CASE WHEN step > 0 THEN tp * volume ELSE 0 END) OVER {w(14)} AS up, sum(CASE WHEN step < 0 THEN tp * volume ELSE 0 END) OVER {w(14)} AS down FROM f)",
    ),
    "OBV": over({"obv": "sum(CASE WHEN c1 IS NULL THEN volume ELSE sign(close - c1) * volume END) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING)"}, "before", _BEFORE),
    "AD": over({"ad": "sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING)"}),
    "TRANGE": over({"trange": _TR}, "before", _BEFORE),
    "LINEARREG": over({"linearreg": guard(f"{FIRST14} + 13 * {SLOPE14}", 14)}),
    "LINEARREG_ANGLE": over({"linearreg_angle": guard(f"degrees(atan({SLOPE14}))", 14)}),
    "LINEARREG_INTERCEPT": over({"linearreg_intercept": guard(FIRST14, 14)}),
    "LINEARREG_SLOPE": over({"linearreg_slope": guard(SLOPE14, 14)}),
    "TSF": over({"tsf": guard(f"{FIRST14} + 14 * {SLOPE14}", 14)}),
    "STDDEV": over({"stddev": guard(f"stddev_pop(close) OVER {w(5)}", 5)}),
    "VAR": over({"var": guard(f"var_pop(close) OVER {w(5)}", 5)}),
    "STOCHF": over({"stochf_k": "CASE WHEN d_v IS NOT NULL THEN k END", "stochf_d": "d_v"}, "d", f"k AS (SELECT *, {_K14} AS k FROM b), {averaged('d', 'k', 'k', 3)}"),
    "STOCH": over({"stoch_k": "CASE WHEN d_v IS NOT NULL THEN slow_v END", "stoch_d": "d_v"}, "d", f"k AS (SELECT *, {_K14} AS k FROM b), {averaged('slow', 'k', 'k', 3)}, {averaged('d', 'slow', 'slow_v', 3)}"),
    "CORREL": over({"correl": guard(f"corr(high, low) OVER {w(30)}", 30)}),
    "ULTOSC": over(
        {"ultosc": "CASE WHEN rn > 28 THEN 100 * (4 * a7 + 2 * a14 + a28) / 7 END"},
        "u",
        f"{_BEFORE}, t AS (SELECT *, close - least(low, c1) AS bp, {_TR} AS tr FROM before), u AS (SELECT *, " + ", ".join(f"sum(bp) OVER {w(n)} / nullif(sum(tr) OVER {w(n)}, 0) AS a{n}" for n in (7, 14, 28)) + " FROM t)",
    ),
}


def smoothed(name: str, source: str, x: str, n: int, k: str, seed: str = "avg(v)", first: int | None = None) -> str:
    """CTEs with y = y' + k (x - y') seeded with the mean of the first n values; columns symbol, rn, v."""
    first = n if first is None else first
    return f"""{name}_s AS (SELECT symbol, rn, {x} AS v, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS i FROM {source} WHERE {x} IS NOT NULL),
        {name} AS (SELECT symbol, max(rn) AS rn, max(i) AS i, {seed} AS v FROM {name}_s WHERE i <= {first} GROUP BY symbol HAVING count(*) = {first}
        UNION ALL SELECT s.symbol, s.rn, s.i, {k.format(x='s.v', y='e.v')} FROM {name} e JOIN {name}_s s ON s.symbol = e.symbol AND s.i = e.i + 1)"""


def _ema(n: int) -> str:
    return f"{{y}} + {2 / (n + 1)!r} * ({{x}} - {{y}})"


def _wilder(n: int) -> str:
    return f"{{y}} + {1 / n!r} * ({{x}} - {{y}})"


def shown(cols: dict[str, str], tables: list[str], ctes: str) -> str:
    """Values of CTEs (symbol, rn, v) beside all bars."""
    joins = " ".join(f"LEFT JOIN {t} ON {t}.symbol = b.symbol AND {t}.rn = b.rn" for t in tables)
    return f"WITH RECURSIVE {BARS}, {ctes} SELECT b.symbol, b.datetime, {', '.join(f'{r(x)} AS {c}' for c, x in cols.items())} FROM b {joins}"


def _chain(n: int, times: int) -> str:
    return ", ".join(smoothed(f"e{k}", "b" if k == 1 else f"e{k - 1}", "close" if k == 1 else "v", n, _ema(n)) for k in range(1, times + 1))


_UPDOWN = "ch AS (SELECT symbol, rn, close - " + lag("close") + " AS d FROM b)"
_GAINS = _UPDOWN + ", " + smoothed("up", "ch", "greatest(d, 0)", 14, _wilder(14)).replace("WHERE greatest(d, 0) IS NOT NULL", "WHERE d IS NOT NULL") + ", " + smoothed("down", "ch", "greatest(-d, 0)", 14, _wilder(14)).replace("WHERE greatest(-d, 0) IS NOT NULL", "WHERE d IS NOT NULL")
_ATR = _BEFORE + ", " + smoothed("atr", f"(SELECT *, {_TR} AS tr FROM before)", "tr", 14, _wilder(14))
_MOVES = f"""mv AS (SELECT symbol, rn, high - {lag('high')} AS u, {lag('low')} - low AS d, greatest(high, {lag('close')}) - least(low, {lag('close')}) AS tr FROM b),
    dm AS (SELECT symbol, rn, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS m, tr FROM mv WHERE rn > 1)"""
_SUM = f"{{y}} - {{y}} / 14 + {{x}}"
_DM = _MOVES + ", " + ", ".join(smoothed(name, "dm", x, 14, _SUM, "sum(v)", 13) for name, x in (("pdm", "p"), ("mdm", "m"), ("trs", "tr")))
_DI = _DM + """, di AS (SELECT p.symbol, p.rn, CASE WHEN t.v = 0 THEN 0 ELSE 100 * p.v / t.v END AS pdi, CASE WHEN t.v = 0 THEN 0 ELSE 100 * m.v / t.v END AS mdi
    FROM pdm p JOIN mdm m USING (symbol, rn) JOIN trs t USING (symbol, rn) WHERE p.rn > 14)"""
_DX = _DI + """, dx0 AS (SELECT symbol, rn, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) END AS x FROM di),
    dx AS (SELECT symbol, rn, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS v FROM dx0)"""
_ADX = _DX + ", " + smoothed("adx", "dx", "v", 14, _wilder(14))
_LINE = """f12 AS (SELECT symbol, rn, v FROM fast), line AS (SELECT s.symbol, s.rn, f.v - s.v AS v FROM slow s JOIN fast f USING (symbol, rn))"""
_FAST = """fast AS (SELECT symbol, 26 AS rn, avg(close) AS v FROM b WHERE rn BETWEEN 15 AND 26 GROUP BY symbol HAVING count(*) = 12
    UNION ALL SELECT b.symbol, b.rn, e.v + {k} * (b.close - e.v) FROM fast e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1)""".format(k=repr(2 / 13))
_MACD = _FAST + ", " + smoothed("slow", "b", "close", 26, _ema(26)) + ", " + _LINE + ", " + smoothed("sig", "line", "v", 9, _ema(9))


def _macd(p: str) -> str:
    return shown({p: "CASE WHEN sig.v IS NOT NULL THEN line.v END", f"{p}_signal": "sig.v", f"{p}_hist": "line.v - sig.v"}, ["line", "sig"], _MACD)


_KAMA = f"""st AS (SELECT symbol, rn, close, abs(close - {lag('close')}) AS s, {lag('close', 10)} AS c10 FROM b),
    er AS (SELECT symbol, rn, close, power(least(CASE WHEN p > 0 THEN abs(close - c10) / p ELSE 1 END, 1) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS k FROM (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY rn ROWS 9 PRECEDING) AS p FROM st) WHERE rn > 10),
    kama AS (SELECT symbol, rn, close AS v FROM b WHERE rn = 10 UNION ALL SELECT er.symbol, er.rn, e.v + er.k * (er.close - e.v) FROM kama e JOIN er ON er.symbol = e.symbol AND er.rn = e.rn + 1)"""
_ADOSC = """adl AS (SELECT symbol, rn, sum(CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS a FROM b),
    osc AS (SELECT symbol, rn, a AS f, a AS s FROM adl WHERE rn = 1 UNION ALL SELECT x.symbol, x.rn, e.f + 0.5 * (x.a - e.f), e.s + {k} * (x.a - e.s) FROM osc e JOIN adl x ON x.symbol = e.symbol AND x.rn = e.rn + 1)""".format(k=repr(2 / 11))
_RSI = "rsi AS (SELECT u.symbol, u.rn, CASE WHEN u.v + d.v = 0 THEN 0 ELSE 100 * u.v / (u.v + d.v) END AS v FROM up u JOIN down d USING (symbol, rn))"
_STOCHRSI = _GAINS + ", " + _RSI + """, sk AS (SELECT symbol, rn, CASE WHEN count(*) OVER x = 3 THEN CASE WHEN max(v) OVER x = min(v) OVER x THEN 0 ELSE 100 * (v - min(v) OVER x) / nullif(max(v) OVER x - min(v) OVER x, 0) END END AS v FROM rsi WINDOW x AS (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING)),
    sd AS (SELECT symbol, rn, v AS k, CASE WHEN count(v) OVER x = 3 THEN avg(v) OVER x END AS v FROM sk WINDOW x AS (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING))"""

RECURSIVE_SQL = {
    "EMA": shown({"ema": "e1.v"}, ["e1"], _chain(30, 1)),
    "DEMA": shown({"dema": "2 * e1.v - e2.v"}, ["e1", "e2"], _chain(30, 2)),
    "TEMA": shown({"tema": "3 * e1.v - 3 * e2.v + e3.v"}, ["e1", "e2", "e3"], _chain(30, 3)),
    "T3": shown({"t3": f"-({0.7**3!r}) * e6.v + {3 * 0.7 * 0.7 * 1.7!r} * e5.v - {3 * 0.7 * 1.7**2!r} * e4.v + {1.7**3!r} * e3.v"}, ["e3", "e4", "e5", "e6"], _chain(5, 6)),
    "TRIX": shown({"trix": "100 * (e3.v / p.v - 1)"}, ["e3"], _chain(30, 3)).replace("LEFT JOIN e3 ON e3.symbol = b.symbol AND e3.rn = b.rn", "LEFT JOIN e3 ON e3.symbol = b.symbol AND e3.rn = b.rn LEFT JOIN e3 p ON p.symbol = b.symbol AND p.rn = b.rn - 1"),
    "KAMA": shown({"kama": "CASE WHEN b.rn > 10 THEN kama.v END"}, ["kama"], _KAMA),
    "MACD": _macd("macd"),
    "MACDFIX": _macd("macdfix"),
    "RSI": shown({"rsi": "rsi.v"}, ["rsi"], f"{_GAINS}, {_RSI}"),
    "CMO": shown({"cmo": "CASE WHEN up.v + down.v = 0 THEN 0 ELSE 100 * (up.v - down.v) / (up.v + down.v) END"}, ["up", "down"], _GAINS),
    "STOCHRSI": shown({"stochrsi_k": "CASE WHEN sd.v IS NOT NULL THEN sd.k END", "stochrsi_d": "sd.v"}, ["sd"], _STOCHRSI),
    "ATR": shown({"atr": "atr.v"}, ["atr"], _ATR),
    "NATR": shown({"natr": "CASE WHEN b.close = 0 THEN CASE WHEN atr.v IS NOT NULL THEN 0 END ELSE 100 * atr.v / b.close END"}, ["atr"], _ATR),
    "PLUS_DM": shown({"plus_dm": "pdm.v"}, ["pdm"], _DM),
    "MINUS_DM": shown({"minus_dm": "mdm.v"}, ["mdm"], _DM),
    "PLUS_DI": shown({"plus_di": "di.pdi"}, ["di"], _DI),
    "MINUS_DI": shown({"minus_di": "di.mdi"}, ["di"], _DI),
    "DX": shown({"dx": "dx.v"}, ["dx"], _DX),
    "ADX": shown({"adx": "adx.v"}, ["adx"], _ADX),
    "ADXR": shown({"adxr": "(adx.v + a13.v) / 2"}, ["adx"], _ADX) + " LEFT JOIN adx a13 ON a13.symbol = b.symbol AND a13.rn = b.rn - 13",
    "ADOSC": shown({"adosc": "CASE WHEN b.rn >= 10 THEN osc.f - osc.s END"}, ["osc"], _ADOSC),
}

def rule_sql(expression: str, ctes: str = "", source: str = "b") -> str:
    return f"WITH {BARS}{', ' + ctes if ctes else ''} SELECT symbol, datetime, CAST({expression} AS INTEGER) AS signal FROM {source}"


def cross_sql(a: str, b: str, source: str) -> tuple[str, str]:
    return (f"dd AS (SELECT *, round({a} - {b}, 9) AS dd FROM {source}), xx AS (SELECT *, lag(dd) OVER (PARTITION BY symbol ORDER BY datetime) AS pp FROM dd)", "CASE WHEN dd > 0 AND pp <= 0 THEN 1 WHEN dd < 0 AND pp >= 0 THEN -1 ELSE 0 END")


_STOCH = f"k AS (SELECT *, {_K14} AS k FROM b), {averaged('slow', 'k', 'k', 3)}, {averaged('d', 'slow', 'slow_v', 3)}"
_SX, _SE = cross_sql("slow_v", "d_v", "d")
_OBV = _BEFORE + ", obv AS (SELECT *, sum(CASE WHEN c1 IS NULL THEN volume ELSE sign(close - c1) * volume END) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS v FROM before)"
_BB = f"bb AS (SELECT *, {mean(_C, 5)} + 2 * stddev_pop(close) OVER {w(5)} AS hi, {mean(_C, 5)} - 2 * stddev_pop(close) OVER {w(5)} AS lo FROM b), bd AS (SELECT *, round(lo - close, 9) AS dl, round(hi - close, 9) AS du FROM bb), bx AS (SELECT *, {lag('dl')} AS pl, {lag('du')} AS pu FROM bd)"
RULES_SQL = {
    "rule_price_cross": rule_sql(f"sign(round(close, 9) - round({mean(_C, 30)}, 9))"),
    "rule_zero_cross": rule_sql(f"sign(round(close - {lag('close', 10)}, 9))"),
    "rule_threshold": rule_sql("CASE WHEN x < -80 THEN 1 WHEN x > -20 THEN -1 WHEN x IS NOT NULL THEN 0 END", f"t AS (SELECT *, round({guard(f'CASE WHEN max(high) OVER {w(14)} = min(low) OVER {w(14)} THEN 0 ELSE -100 * (max(high) OVER {w(14)} - close) / nullif(max(high) OVER {w(14)} - min(low) OVER {w(14)}, 0) END', 14)}, 9) AS x FROM b)", "t"),
    "rule_pivot": rule_sql("CASE WHEN x > 1 THEN 1 WHEN x < 1 THEN -1 WHEN x IS NOT NULL THEN 0 END", f"t AS (SELECT *, round(close / nullif({lag('close', 10)}, 0), 9) AS x FROM b)", "t"),
    "rule_mean_cross": rule_sql("CASE WHEN x IS NOT NULL THEN CASE WHEN round(x, 9) > round(avg(x) OVER (PARTITION BY symbol), 9) THEN 1 ELSE -1 END END", f"{_BEFORE}, t AS (SELECT *, {_TR} AS x FROM before)", "t"),
    "rule_line_cross": rule_sql(f"CASE WHEN d_v IS NOT NULL THEN {_SE} END", f"{_STOCH}, {_SX.replace('FROM d)', 'FROM (SELECT * REPLACE (CASE WHEN d_v IS NOT NULL THEN slow_v END AS slow_v) FROM d))')}", "xx"),
    "rule_prev_cross": rule_sql(f"sign(round(v - {lag('v')}, 9))", _OBV, "obv"),
    "rule_bbands": rule_sql("CASE WHEN hi IS NOT NULL THEN CASE WHEN dl > 0 AND pl <= 0 THEN 1 WHEN du < 0 AND pu >= 0 THEN -1 ELSE 0 END END", _BB, "bx"),
    "rule_pattern": f"SELECT symbol, datetime, CAST(sign(CDLENGULFING) AS INTEGER) AS signal FROM ({candle_sql.select(['CDLENGULFING'], BARS)})",
}

_SIG3 = f"""s3 AS (SELECT symbol, datetime, rn, sign(round(close, 9) - round({mean(_C, 5)}, 9)) AS a, sign(round(100 * (close / nullif({lag('close', 3)}, 0) - 1), 9)) AS c,
    round({guard(f'CASE WHEN max(high) OVER {w(14)} = min(low) OVER {w(14)} THEN 0 ELSE -100 * (max(high) OVER {w(14)} - close) / nullif(max(high) OVER {w(14)} - min(low) OVER {w(14)}, 0) END', 14)}, 9) AS x, CASE WHEN close > open THEN 1 ELSE -1 END AS m FROM b),
    sig AS (SELECT symbol, datetime, a, c, CASE WHEN x < -80 THEN 1 WHEN x > -20 THEN -1 WHEN x IS NOT NULL THEN 0 END AS wr, m FROM s3)"""


def vote_sql(total: str, keep: str, key: str = "symbol", source: str = "sig") -> str:
    """CTE voted(key.., datetime, signals)."""
    return f"""surv AS (SELECT {key}, datetime, CAST(sign({total}) AS INTEGER) AS now FROM {source} WHERE {keep}),
    voted AS (SELECT {key}, datetime, signals FROM (SELECT *, lag(now) OVER v AS signals, row_number() OVER v AS n, count(*) OVER (PARTITION BY {key}) AS total FROM surv WINDOW v AS (PARTITION BY {key} ORDER BY datetime)) WHERE total >= 3 AND n > 1 AND n < total)"""


_ALL3 = "a IS NOT NULL AND c IS NOT NULL AND wr IS NOT NULL"
VOTE = f"WITH RECURSIVE {BARS}, {_SIG3}, {vote_sql('a + c + wr', _ALL3)}"

_BACKTEST = VOTE + f""", {bucketed('mins', '1 minute')},
    pred AS (SELECT symbol, datetime, signals, lead(datetime) OVER (PARTITION BY symbol ORDER BY datetime) AS till, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS i FROM voted),
    iv AS (SELECT p.symbol, p.i, p.datetime, p.signals, list(m.datetime ORDER BY m.datetime) AS ts, list(m.open ORDER BY m.datetime) AS os, list(m.high ORDER BY m.datetime) AS hs, list(m.low ORDER BY m.datetime) AS ls
        FROM pred p JOIN mins m ON m.symbol = p.symbol AND m.datetime >= p.datetime AND m.datetime < p.till WHERE p.i >= (SELECT greatest(1, min(q.i) - 1) FROM pred q WHERE q.symbol = p.symbol AND q.signals <> 0) GROUP BY ALL),
    nv AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM iv),
    st AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS k, 0 AS side, CAST(0 AS DOUBLE) AS entry, 0 AS last, CAST(1000 AS DOUBLE) AS balance, false AS broke,
        CAST([] AS STRUCT(t TIMESTAMP, side INTEGER, act VARCHAR, bp DOUBLE, sp DOUBLE, bal DOUBLE, pnl DOUBLE)[]) AS ev FROM nv
      UNION ALL
      SELECT symbol, k, CASE WHEN hit THEN 0 ELSE side END, entry, CASE WHEN hit THEN 0 ELSE last END, bal2, bal2 < 500, CASE WHEN hit THEN list_append(ev2, {{'t': ts[h], 'side': side, 'act': CASE WHEN won THEN 'sell - take_profit' ELSE 'sell - stop_loss' END, 'bp': entry, 'sp': px, 'bal': bal2, 'pnl': pnl}}) ELSE ev2 END
      FROM (SELECT *, CASE WHEN hit THEN bal1 + bal1 * pnl / 100 ELSE bal1 END AS bal2 FROM
       (SELECT *, CASE WHEN hit THEN (px - entry) / entry * 100 * side - 0.05 END AS pnl FROM
        (SELECT *, CASE WHEN won THEN tp ELSE sl END AS px FROM
         (SELECT *, h IS NOT NULL AS hit, CASE WHEN side > 0 THEN hs[h] >= tp ELSE ls[h] <= tp END AS won FROM
          (SELECT *, CASE WHEN side = 0 THEN NULL ELSE list_position(list_transform(range(1, len(ts) + 1), lambda j: CASE WHEN side > 0 THEN hs[j] >= tp OR ls[j] <= sl ELSE ls[j] <= tp OR hs[j] >= sl END), true) END AS h FROM
           (SELECT *, entry * (1 + side * 30.0 / 100) AS tp, entry * (1 - side * 20.0 / 100) AS sl FROM
            (SELECT symbol, k, ts, hs, ls, CASE WHEN want <> 0 AND want <> side0 THEN want ELSE side0 END AS side, CASE WHEN want <> 0 AND want <> side0 THEN os[1] ELSE entry0 END AS entry,
                    CASE WHEN want <> 0 AND want <> side0 THEN want ELSE last0 END AS last,
                    CASE WHEN want <> 0 AND want <> side0 THEN balr - balr * 0.05 / 100 ELSE bal0 END AS bal1,
                    CASE WHEN want = 0 OR want = side0 THEN ev WHEN side0 <> 0 THEN list_concat(ev, [{{'t': datetime, 'side': side0, 'act': 'sell - direction_change', 'bp': entry0, 'sp': os[1], 'bal': balr, 'pnl': pnlr}}, {{'t': datetime, 'side': want, 'act': 'buy', 'bp': os[1], 'sp': 0.0, 'bal': balr - balr * 0.05 / 100, 'pnl': -0.05}}])
                         ELSE list_append(ev, {{'t': datetime, 'side': want, 'act': 'buy', 'bp': os[1], 'sp': 0.0, 'bal': balr - balr * 0.05 / 100, 'pnl': -0.05}}) END AS ev2, want
             FROM (SELECT *, CASE WHEN side0 <> 0 THEN bal0 + bal0 * pnlr / 100 ELSE bal0 END AS balr FROM
              (SELECT s.symbol, n.k, n.datetime, n.ts, n.os, n.hs, n.ls, s.side AS side0, s.entry AS entry0, s.last AS last0, s.balance AS bal0, s.ev, CASE WHEN n.signals <> 0 THEN n.signals ELSE s.last END AS want,
                      CASE WHEN s.side <> 0 THEN (n.os[1] - s.entry) / s.entry * 100 * s.side - 0.05 END AS pnlr
               FROM st s JOIN nv n ON n.symbol = s.symbol AND n.k = s.k + 1 WHERE NOT s.broke)))))))))),
    fin AS (SELECT symbol, arg_max(side, k) AS side, arg_max(entry, k) AS entry, arg_max(balance, k) AS balance, arg_max(ev, k) AS ev FROM st GROUP BY symbol),
    lastbar AS (SELECT symbol, max(datetime) AS t, arg_max(close, datetime) AS c FROM mins GROUP BY symbol),
    alle AS (SELECT symbol, unnest(CASE WHEN side = 0 THEN ev ELSE list_append(ev, {{'t': t, 'side': side, 'act': 'sell - end_of_backtest', 'bp': entry, 'sp': c, 'bal': balance + balance * ((c - entry) / entry * 100 * side - 0.05) / 100, 'pnl': (c - entry) / entry * 100 * side - 0.05}}) END) AS e,
             generate_subscripts(CASE WHEN side = 0 THEN ev ELSE list_append(ev, ev[1]) END, 1) - 1 AS event FROM fin JOIN lastbar USING (symbol)),
    ledger AS (SELECT 's3' AS strategy, symbol, CAST(event AS BIGINT) AS event, e.t AS datetime, CASE WHEN e.side > 0 THEN 'long' ELSE 'short' END AS predicted_direction, e.act AS action, round(e.bp, 6) AS buy_price, round(e.sp, 6) AS sell_price,
             round(e.bal, 2) AS balance, round(e.pnl, 2) AS pnl, round(sum(e.pnl) OVER (PARTITION BY symbol ORDER BY event), 2) AS pnl_sum FROM alle)"""

_PRED = BARS + ", pr AS (SELECT *, ln(close / open) AS pred FROM b)"
_COMPARE = "CASE WHEN round(pred, 9) > round({hi}, 9) THEN 1 WHEN round(pred, 9) < round({lo}, 9) THEN -1 ELSE 0 END"
_POSTS = "posts AS (SELECT doc_id AS post_id, source AS subreddit, text, CAST(ts AS TIMESTAMP) AS post_time FROM documents JOIN events ON event_id = doc_id)"


def _hourly(name: str, source: str, key: str, time: str) -> str:
    from barflow.operators.posts import NEGATIVE, POSITIVE

    words = lambda ws: "[" + ", ".join(f"'{x}'" for x in ws) + "]"
    return f"""{name}_f AS (SELECT {key}, {time} AS t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token_count,
        coalesce(round_even(len(regexp_extract_all(text, '[A-Z]')) / nullif(len(regexp_extract_all(text, '[A-Za-z]')), 0)::DOUBLE, 4), 0) AS caps_ratio, len(regexp_extract_all(text, '[!?]{{2,}}')) AS punct,
        len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: list_contains({words(POSITIVE)}, x))) AS up, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: list_contains({words(NEGATIVE)}, x))) AS down FROM {source}),
        {name}_s AS (SELECT *, CAST(sign(up - down) AS DOUBLE) AS sentiment, 0.5 + 0.5 * coalesce(abs(up - down) / nullif(up + down, 0)::DOUBLE, 0) AS sure FROM {name}_f),
        {name} AS (SELECT date_trunc('hour', t) AS time_window, avg(sentiment) AS mean_sentiment, stddev_pop(sentiment) AS std_sentiment, avg(sure) AS sentiment_confidence_mean, CAST(0 AS DOUBLE) AS emoji_count_mean, avg(caps_ratio) AS caps_ratio_mean, avg(punct) AS punct_intensity_mean, CAST(0 AS DOUBLE) AS spam_score_mean, avg(token_count) AS token_count_mean, count({key}) AS {key}_count FROM {name}_s GROUP BY 1)"""


_COMMENTS = "comments AS (SELECT conv_id * 100 + turn AS comment_id, conv_id, text, CAST(ts AS TIMESTAMP) AS comment_time FROM conversations JOIN events ON event_id = conv_id)"
_HP, _HC = _hourly("hp", "posts", "post_id", "post_time"), _hourly("hc", "comments", "comment_id", "comment_time")
_COMBINED = f"""{_POSTS}, {_COMMENTS}, {_HP}, {_HC}, comb AS (SELECT time_window, 0.4 * coalesce(hp.mean_sentiment, 0) + 0.6 * coalesce(hc.mean_sentiment, 0) AS sentiment_combined, coalesce(post_id_count, 0) + coalesce(comment_id_count, 0)::DOUBLE AS volume_total,
    abs(coalesce(hp.mean_sentiment, 0) - coalesce(hc.mean_sentiment, 0)) AS sentiment_disagreement,
    coalesce((coalesce(hp.sentiment_confidence_mean, 0) * coalesce(post_id_count, 0) + coalesce(hc.sentiment_confidence_mean, 0) * coalesce(comment_id_count, 0)) / nullif(coalesce(post_id_count, 0) + coalesce(comment_id_count, 0), 0), 0) AS confidence_combined
    FROM hp FULL JOIN hc USING (time_window))"""
_MARKET = f"""mk0 AS (SELECT symbol, datetime, open, high, low, close, volume, coalesce(close / nullif({lag('close')}, 0) - 1, 0) AS returns, coalesce(volume / nullif({lag('volume')}, 0) - 1, 0) AS volume_change, coalesce(close - {lag('close', 5)}, 0) AS price_momentum FROM b),
    mk AS (SELECT symbol, datetime + INTERVAL 1 HOUR AS datetime, open, high, low, close, volume, returns, volume_change, price_momentum, coalesce(stddev_samp(returns) OVER {w(10)}, 0) AS volatility FROM mk0)"""
_MERGED = BARS + ", " + _MARKET + ", " + _COMBINED + ", mg AS (SELECT m.*, " + ", ".join(f"coalesce(last_value(c.{x} IGNORE NULLS) OVER (PARTITION BY m.symbol ORDER BY m.datetime ROWS UNBOUNDED PRECEDING), 0) AS {x}" for x in ("sentiment_combined", "volume_total", "confidence_combined")) + " FROM mk m LEFT JOIN comb c ON c.time_window + INTERVAL 1 HOUR = m.datetime)"
_ALPHA = _MERGED + """, al AS (SELECT *, sentiment_combined - returns AS divergence, CAST(volume_total > 2 * coalesce(avg(volume_total) OVER (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS volume_spike,
    sentiment_combined * ln(1 + volume_total) AS fear_greed, sentiment_combined * volatility AS sentiment_volatility FROM mg)"""
_TARGETS = _ALPHA + ", nb AS (SELECT * FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY datetime) AS nxt FROM al) WHERE nxt IS NOT NULL), tg AS (SELECT *, CAST(nxt > close AS INTEGER) AS target, nxt / nullif(close, 0) - 1 AS target_return FROM nb)"
_OHLCV = ", ".join(f"{r(c)} AS {c}" for c in ("open", "high", "low", "close", "volume"))
_DAILY = "rows_ AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS TIMESTAMP) AS datetime, l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)"

ORACLE_SQL: dict[str, str] = {
    "resample_1h": f"WITH {BARS} SELECT symbol, datetime, {_OHLCV} FROM bars",
    "resample_15m": f"WITH {TICKS}, {bucketed('bars', '15 minutes')} SELECT symbol, datetime, {_OHLCV} FROM bars",
    "resample_1d_lineitem": f"WITH {_DAILY}, {bucketed('bars', '1 day', 'rows_', 'l_orderkey, l_linenumber', 'sum(q)')} SELECT symbol, datetime, {_OHLCV} FROM bars",
    "grid_ffill_minute": f"""WITH {TICKS}, {bucketed('bars', '1 minute')}, g AS (SELECT symbol, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 MINUTE)) AS datetime FROM bars GROUP BY symbol)
        SELECT symbol, datetime, {', '.join(f'round(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM g LEFT JOIN bars USING (symbol, datetime)""",
    "dedup_first": f"WITH {TICKS} SELECT symbol, date_trunc('minute', datetime) AS minute, arg_min(event_id, (datetime, event_id)) AS event_id, round(arg_min(price, (datetime, event_id)), 6) AS close FROM ticks GROUP BY 1, 2",
    "range_scan_tail": f"WITH {TICKS} SELECT event_id, datetime, round(price, 6) AS close FROM ticks WHERE datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY datetime DESC, event_id DESC LIMIT 500",
    "last_only_resample": f"WITH {TICKS} SELECT symbol, time_bucket(INTERVAL '4 hours', datetime) AS datetime, round(arg_max(price, (datetime, event_id)), 6) AS close FROM ticks GROUP BY 1, 2",
    "upsert_ignore": f"WITH {TICKS} SELECT symbol, count(*) AS n, round(sum(CASE WHEN event_id % 3 <> 0 THEN price ELSE 0 END), 6) AS total FROM ticks GROUP BY symbol",
    "append_anti": f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks WHERE event_id % 3 = 0 GROUP BY symbol",
    **{f"ind_{n.lower()}": q for n, q in (FINITE_SQL | RECURSIVE_SQL).items()},
    **RULES_SQL,
    "vote": f"{VOTE} SELECT symbol, datetime, signals FROM voted",
    "vote_with_model": f"WITH {BARS}, {_SIG3}, {vote_sql('a + c + wr + m', _ALL3)} SELECT symbol, datetime, signals FROM voted",
    "strategies_latest": f"""WITH {BARS}, {_SIG3}, many AS (SELECT 's1' AS strategy, symbol, datetime, a + c AS t FROM sig UNION ALL SELECT 's2', symbol, datetime, wr FROM sig UNION ALL SELECT 's3', symbol, datetime, a + c + wr FROM sig),
        {vote_sql('t', 't IS NOT NULL', 'strategy, symbol', 'many')} SELECT strategy, symbol, arg_max(signals, datetime) AS signals, max(datetime) AS datetime FROM voted GROUP BY 1, 2""",
    "backtest_ledger": f"{_BACKTEST} SELECT * FROM ledger",
    "backtest_summary": f"""{_BACKTEST}, sells AS (SELECT *, greatest(max(balance) OVER (PARTITION BY symbol ORDER BY event), 1000) AS peak FROM ledger WHERE starts_with(action, 'sell'))
        SELECT strategy, symbol, count(*) AS trades, round(100 * avg((pnl > 0)::INT), 6) AS win_rate, round(avg(pnl), 6) + 0.0 AS avg_pnl, arg_max(balance, event) AS final_balance, round(max((peak - balance) / peak * 100), 6) AS max_drawdown_pct,
        {', '.join(f"count(*) FILTER (contains(action, '{x}')) AS {x}" for x in ('take_profit', 'stop_loss', 'direction_change', 'end_of_backtest'))} FROM sells GROUP BY 1, 2""",
    "trade_stats": f"""{_BACKTEST}, d AS (SELECT *, max(balance) OVER v AS peak, CASE WHEN (pnl > 0) <> lag(pnl > 0) OVER v THEN 1 ELSE 0 END AS nw, CASE WHEN (pnl < 0) <> lag(pnl < 0) OVER v THEN 1 ELSE 0 END AS nl FROM ledger WINDOW v AS (PARTITION BY symbol ORDER BY event)),
        i AS (SELECT *, sum(nw) OVER v AS iw, sum(nl) OVER v AS il FROM d WINDOW v AS (PARTITION BY symbol ORDER BY event)), sw AS (SELECT symbol, max(n) AS n FROM (SELECT symbol, iw, CAST(sum((pnl > 0)::INT) AS BIGINT) AS n FROM i GROUP BY 1, 2) GROUP BY 1), sl AS (SELECT symbol, max(n) AS n FROM (SELECT symbol, il, CAST(sum((pnl < 0)::INT) AS BIGINT) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
        g AS (SELECT strategy, symbol, count(*) AS total_trades, count(*) FILTER (predicted_direction = 'long') AS long_trades, count(*) FILTER (predicted_direction = 'short') AS short_trades, count(*) FILTER (pnl > 0) AS win_trades, count(*) FILTER (pnl < 0) AS loss_trades, count(*) FILTER (pnl = 0) AS breakeven_trades,
        round(avg((pnl > 0)::INT), 6) AS win_rate, round(avg((pnl < 0)::INT), 6) AS loss_rate, round(coalesce(sum(pnl) FILTER (pnl > 0), 0), 6) AS gross_profit, round(coalesce(sum(pnl) FILTER (pnl < 0), 0), 6) AS gross_loss, round(sum(pnl), 6) AS net_profit, round(avg(pnl), 6) AS avg_trade_pnl,
        round(avg(pnl) FILTER (pnl > 0), 6) AS avg_win, round(avg(pnl) FILTER (pnl < 0), 6) AS avg_loss, round(abs(avg(pnl) FILTER (pnl > 0) / nullif(avg(pnl) FILTER (pnl < 0), 0)), 6) AS risk_reward_ratio, round(coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(abs(coalesce(sum(pnl) FILTER (pnl < 0), 0)), 0), 6) AS profit_factor,
        round(min(balance - peak), 6) AS max_drawdown, round(min((balance - peak) / nullif(peak, 0)), 6) AS max_drawdown_pct, round(coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0), 6) AS sharpe_ratio, round(coalesce(avg(pnl) / nullif(stddev_samp(pnl) FILTER (pnl < 0), 0), 0), 6) AS sortino_ratio FROM d GROUP BY 1, 2)
        SELECT g.*, sw.n AS max_consecutive_wins, sl.n AS max_consecutive_losses FROM g JOIN sw USING (symbol) JOIN sl USING (symbol)""",
    "max_drawdown": f"WITH {BARS} SELECT symbol, round(min(d), 6) + 0.0 AS max_drawdown FROM (SELECT symbol, close - max(close) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS d FROM b) GROUP BY symbol",
    "streaks": f"""WITH {BARS}, s AS (SELECT symbol, datetime, round(close - open, 9) > 0 AS win, round(close - open, 9) < 0 AS loss FROM b), c AS (SELECT *, CASE WHEN win <> lag(win) OVER v THEN 1 ELSE 0 END AS nw, CASE WHEN loss <> lag(loss) OVER v THEN 1 ELSE 0 END AS nl FROM s WINDOW v AS (PARTITION BY symbol ORDER BY datetime)),
        i AS (SELECT *, sum(nw) OVER v AS iw, sum(nl) OVER v AS il FROM c WINDOW v AS (PARTITION BY symbol ORDER BY datetime))
        SELECT symbol, max_consecutive_wins, max_consecutive_losses FROM (SELECT symbol, max(n) AS max_consecutive_wins FROM (SELECT symbol, iw, CAST(sum(win::INT) AS BIGINT) AS n FROM i GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT symbol, max(n) AS max_consecutive_losses FROM (SELECT symbol, il, CAST(sum(loss::INT) AS BIGINT) AS n FROM i GROUP BY 1, 2) GROUP BY 1) USING (symbol)""",
    "top_strategies": f"WITH {BARS} SELECT symbol AS strategy, round(sum(close - open), 6) AS pnl_sum FROM b GROUP BY 1 ORDER BY 2 DESC LIMIT 3",
    "best_model": f"""WITH {BARS}, m AS (SELECT symbol AS model_name, sum(close - open) AS pnl, avg(close) / nullif(stddev_samp(close), 0) AS sharpe_ratio, min(low) - max(high) AS max_drawdown FROM b GROUP BY 1)
        SELECT model_name, round(pnl, 6) AS pnl, round(sharpe_ratio, 6) AS sharpe_ratio, round(max_drawdown, 6) AS max_drawdown, round(pnl * sharpe_ratio / nullif(abs(max_drawdown), 0), 6) AS score FROM m ORDER BY pnl * sharpe_ratio / nullif(abs(max_drawdown), 0) DESC NULLS LAST LIMIT 1""",
    "cls_target": f"""WITH {BARS}, t AS (SELECT *, (lead(close, 15) OVER (PARTITION BY symbol ORDER BY datetime) - close) / nullif(close, 0) AS r FROM b), u AS (SELECT *, CASE WHEN r > 0.003 THEN 1 WHEN r < -0.003 THEN -1 ELSE 0 END AS t FROM t),
        v AS (SELECT *, avg((t = 0)::INT) OVER (PARTITION BY symbol) < 0.05 AS few FROM u) SELECT symbol, datetime, CAST(CASE WHEN t = 0 AND few AND r IS NOT NULL THEN CASE WHEN r >= 0 THEN 1 ELSE -1 END ELSE t END AS INTEGER) AS target FROM v""",
    "reg_target": f"WITH {BARS} SELECT symbol, datetime, round(CASE WHEN count(*) OVER f = 15 THEN max(close) OVER f END, 6) AS target FROM b WINDOW f AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)",
    "log_diff": f"WITH {BARS}, t AS (SELECT symbol, datetime, ln(close) - ln({lag('close')}) AS close, ln(1 + volume) - ln(1 + {lag('volume')}) AS volume FROM b) SELECT symbol, datetime, {r('close')} AS close, {r('volume')} AS volume FROM t WHERE close IS NOT NULL AND volume IS NOT NULL",
    "zscore_target": f"WITH {BARS} SELECT symbol, datetime, {r('CASE WHEN avg(abs(close)) OVER s > 1 THEN (close - avg(close) OVER s) / nullif(stddev_samp(close) OVER s, 0) ELSE close END')} AS close FROM b WINDOW s AS (PARTITION BY symbol)",
    "robust_scale": f"""WITH {BARS}, q AS (SELECT quantile_cont(close, [0.25, 0.5, 0.75]) AS c, quantile_cont(volume, [0.25, 0.5, 0.75]) AS v FROM b WHERE datetime < TIMESTAMP '2024-01-20')
        SELECT symbol, datetime, round((close - c[2]) / coalesce(nullif(c[3] - c[1], 0), 1), 6) + 0.0 AS close, round((volume - v[2]) / coalesce(nullif(v[3] - v[1], 0), 1), 6) + 0.0 AS volume FROM b, q""",
    "split_70_15_15": f"""WITH {BARS}, t AS (SELECT symbol, datetime, CASE WHEN rn <= floor(count(*) OVER (PARTITION BY symbol) * CAST(0.7 AS DOUBLE)) THEN 0 WHEN rn <= floor(count(*) OVER (PARTITION BY symbol) * CAST(0.85 AS DOUBLE)) THEN 1 ELSE 2 END AS part FROM b)
        SELECT symbol, part, count(*) AS n, min(datetime) AS first_time FROM t GROUP BY 1, 2""",
    "split_by_ratio": f"WITH {BARS}, t AS (SELECT *, floor(count(*) OVER (PARTITION BY symbol) * CAST(0.8 AS DOUBLE)) AS pos FROM b) SELECT symbol, datetime AS split FROM t WHERE rn = pos + 1",
    "rolling_train_window": f"WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS k FROM b WHERE datetime < TIMESTAMP '2024-01-20') SELECT symbol, datetime, round(close, 6) AS close FROM t WHERE k <= 100",
    "sequences": f"WITH {BARS} SELECT symbol, datetime, round({lag('close', 4)}, 6) AS first_close, round(volume, 6) AS last_volume, round(close, 6) AS label, CAST(5 AS BIGINT) AS steps FROM b QUALIFY rn >= 5",
    "frequency": f"WITH {BARS}, t AS (SELECT symbol, datetime, epoch(datetime) - epoch({lag('datetime')}) AS s FROM b) SELECT symbol, CAST(arg_max(s, datetime) AS BIGINT) AS seconds FROM t WHERE s IS NOT NULL GROUP BY symbol",
    "union_concat": f"WITH {BARS} SELECT symbol, datetime, {_OHLCV.replace('round(close, 6) + 0.0 AS close', chr(82) + 'EPL')} FROM bars".replace("REPL", "CASE WHEN symbol = 'click' THEN 0.0 ELSE round(close, 6) END AS close"),
    "pred_classifier": f"WITH {_PRED} SELECT symbol, datetime, {_COMPARE.format(hi='avg(pred) OVER s + 0.25 * stddev_pop(pred) OVER s', lo='avg(pred) OVER s - 0.25 * stddev_pop(pred) OVER s')} AS signal FROM pr WINDOW s AS (PARTITION BY symbol)",
    "pred_regressor": f"WITH {_PRED} SELECT symbol, datetime, {_COMPARE.format(hi='avg(pred) OVER s + coalesce(nullif(coalesce(stddev_samp(pred) OVER s, 0), 0), 1e-8)', lo='avg(pred) OVER s - coalesce(nullif(coalesce(stddev_samp(pred) OVER s, 0), 0), 1e-8)')} AS signal FROM pr WINDOW s AS (PARTITION BY symbol ORDER BY datetime ROWS 19 PRECEDING)",
    "pred_deadband": f"WITH {_PRED}, l AS (SELECT *, CASE WHEN avg((abs(pred) <= 0.01)::INT) OVER s > 0.9 THEN 0.25 * stddev_pop(pred) OVER s ELSE 0.01 END AS lim FROM pr WINDOW s AS (PARTITION BY symbol)) SELECT symbol, datetime, {_COMPARE.format(hi='lim', lo='-lim')} AS signal FROM l",
    "pred_price": f"WITH {_PRED}, e AS (SELECT symbol, datetime, open - close AS pred FROM b), l AS (SELECT *, 0.25 * stddev_pop(pred) OVER (PARTITION BY symbol) AS lim FROM e) SELECT symbol, datetime, {_COMPARE.format(hi='lim', lo='-lim')} AS signal FROM l",
    "pred_probability": f"WITH {_PRED} SELECT symbol, datetime, CASE WHEN 1 / (1 + exp(-pred)) > 0.55 THEN 1 WHEN 1 / (1 + exp(-pred)) < 0.45 THEN -1 ELSE 0 END AS signal FROM pr",
    "pred_consensus": f"""WITH {_PRED}, q AS (SELECT quantile_cont(abs(pred), 0.85) AS lim FROM pr) SELECT symbol, datetime, CASE WHEN pred > 0 AND round(pred, 9) > round(lim, 9) AND 1 / (1 + exp(-pred)) >= 0.55 THEN 1
        WHEN pred <= 0 AND round(pred, 9) < -round(lim, 9) AND round(1 - 1 / (1 + exp(-pred)), 9) >= 0.55 THEN -1 ELSE 0 END AS signal FROM pr, q""",
    "is_log_return": f"WITH {_PRED} SELECT median(abs(pred)) < 0.05 AS is_log_return FROM pr",
    "regression_metrics": f"WITH {BARS} SELECT symbol, round(avg(power(open - close, 2)), 6) AS mse, round(avg(abs(open - close)), 6) AS mae, round(sqrt(avg(power(open - close, 2))), 6) AS rmse, round(avg((sign(open) = sign(close))::INT), 6) AS directional_accuracy FROM b GROUP BY symbol",
    "return_summary": f"""WITH {_PRED}, t AS (SELECT *, CASE WHEN volume % 2 = 0 THEN 1 ELSE -1 END * pred AS r FROM pr), c AS (SELECT *, sum(r) OVER (PARTITION BY symbol ORDER BY datetime) AS cum FROM t), k AS (SELECT *, cum - max(cum) OVER (PARTITION BY symbol ORDER BY datetime) AS dd FROM c)
        SELECT symbol, round(sum(r), 6) AS total, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r), 6) AS std, round(avg(r) / stddev_samp(r), 6) AS sharpe, round(min(dd), 6) AS max_drawdown FROM k GROUP BY symbol""",
    "dedup_exact": f"WITH {_POSTS} SELECT arg_min(post_id, (post_time, post_id)) AS post_id, md5(text) AS content_hash FROM posts GROUP BY 2",
    "coin_filter": f"""WITH {_POSTS}, p AS (SELECT post_id, concat_ws(' ', substr(text, 1, 20), (['$BTC now', 'Ethereum', 'binance  coin', 'she sat down', 'SOL!', 'ripples', '(ada)', 'doge', 'dots', '$dot', 'Avalanche', 'chainlink', 'linked', 'bnbs', 'solana-beach', 'BTC'])[post_id % 16 + 1]) AS title,
            lower((['Bitcoin', 'SatoshiStreetBets', 'EthTrader', 'news', 'Solana', 'XRP', 'Avax', 'Polkadot', 'memes', 'CARDANO', 'dogecoin'])[(post_id * 7 + 3) % 11 + 1]) AS forum FROM posts),
        k(coin, names, dollar, forums) AS (VALUES ('btc', 'btc|bitcoin', 'btc', ['bitcoin', 'bitcoinmarkets', 'satoshistreetbets']), ('eth', 'eth|ethereum', 'eth', ['ethereum', 'ethtrader']), ('bnb', 'bnb|binance\\s*coin', 'bnb', []), ('sol', 'sol|solana', 'sol', ['solana']),
            ('xrp', 'xrp|ripple', 'xrp', ['ripple', 'xrp']), ('ada', 'ada|cardano', 'ada', ['cardano']), ('doge', 'doge|dogecoin', 'doge', ['dogecoin']), ('dot', 'dot|polkadot', 'dot', ['polkadot']), ('avax', 'avax|avalanche', 'avax', ['avax']), ('link', 'link|chainlink', 'link', []))
        SELECT coin, post_id FROM p, k WHERE forum <> 'memes' AND (list_contains(forums, forum) OR regexp_matches(lower(title), '\\b(' || names || ')\\b') OR contains(lower(title), '$' || dollar))""",
    "hourly_sentiment": f"WITH {_POSTS}, {_HP} SELECT time_window, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('mean_sentiment', 'std_sentiment', 'sentiment_confidence_mean', 'emoji_count_mean', 'caps_ratio_mean', 'punct_intensity_mean', 'spam_score_mean', 'token_count_mean'))}, post_id_count FROM hp",
    "combine_outer": f"WITH {_COMBINED} SELECT time_window, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('sentiment_combined', 'volume_total', 'sentiment_disagreement', 'confidence_combined'))} FROM comb",
    "market_features": f"WITH {BARS}, {_MARKET} SELECT symbol, datetime, {_OHLCV}, {', '.join(f'{r(c)} AS {c}' for c in ('returns', 'volume_change', 'price_momentum', 'volatility'))} FROM mk",
    "merge_ffill": f"WITH {_MERGED} SELECT symbol, datetime, {', '.join(f'{r(c)} AS {c}' for c in ('sentiment_combined', 'volume_total', 'confidence_combined'))} FROM mg",
    "alpha_features": f"WITH {_ALPHA} SELECT symbol, datetime, {r('divergence')} AS divergence, volume_spike, {r('fear_greed')} AS fear_greed, {r('sentiment_volatility')} AS sentiment_volatility FROM al",
    "next_bar_targets": f"WITH {_TARGETS} SELECT symbol, datetime, target, {r('target_return')} AS target_return FROM tg",
    "corr_with_target": f"WITH {_TARGETS}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, target_return) AS r FROM tg" for c in ("returns", "volatility", "volume_change", "price_momentum", "sentiment_combined", "divergence")) + ") SELECT feature, round(r, 6) AS r FROM f WHERE r IS NOT NULL AND NOT isnan(r)",
    "class_balance": f"WITH {_TARGETS} SELECT target, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tg GROUP BY target",
    "class_weights": f"WITH {_TARGETS}, n AS (SELECT target, 1.0 / count(*)::DOUBLE AS v FROM tg GROUP BY target) SELECT target, round(v / sum(v) OVER () * 2, 6) AS weight FROM n",
}


ORACLE_SQL |= {k: candle_sql.select(v, BARS) for k, v in CANDLES.items()}
ORACLE_SQL["candles_traps"] = candle_sql.traps(TRAPS, BARS)
ORACLE_SQL |= {
    "ind_sar": more_sql.sar(BARS, "sar", False),
    "ind_sarext": more_sql.sar(BARS, "sarext", True),
    "ind_mama": more_sql.hilbert(BARS, {"mama": "h.mama", "fama": "h.fama"}, 13, 32),
    "ind_ht_dcperiod": more_sql.hilbert(BARS, {"ht_dcperiod": "h.sp"}, 13, 32),
    "ind_ht_phasor": more_sql.hilbert(BARS, {"ht_inphase": "h.i[1]", "ht_quadrature": "h.q[1]"}, 13, 32),
    "ind_ht_dcphase": more_sql.phase(BARS, {"ht_dcphase": "n.dc"}),
    "ind_ht_sine": more_sql.phase(BARS, {"ht_sine": "n.sine", "ht_leadsine": "n.lead"}),
    "ind_ht_trendline": more_sql.phase(BARS, {"ht_trendline": "n.line"}),
    "ind_ht_trendmode": more_sql.phase(BARS, {"ht_trendmode": "CAST(n.mode AS DOUBLE)"}),
    "rule_trend_mode": more_sql.phase(BARS, {"signal": "n.mode"}, "CAST(CASE WHEN {x} = 1 THEN 1 ELSE -1 END AS INTEGER)"),
    "simhash": f"WITH {_POSTS}, {more_sql.SIMHASH} SELECT post_id, simhash FROM sh",
    "text_clean": f"WITH {_POSTS}, {text_sql.cleaned('posts', 'post_id', 'text')} SELECT post_id, clean FROM tc",
    "text_features": f"WITH {_POSTS}, {text_sql.cleaned('posts', 'post_id', 'text')}, {text_sql.featured('post_id')}, {text_sql.simhashed('tf', 'post_id', 'clean')} SELECT tf.* EXCLUDE (raw, clean), simhash FROM tf JOIN sh USING (post_id)",
    "cleaned_comments": f"WITH {_COMMENTS}, {text_sql.cleaned('comments', 'comment_id', 'text')}, {text_sql.featured('comment_id')} SELECT comment_id, clean AS cleaned_text, spam_score, token_count FROM tf WHERE is_valid",
    "hamming_pairs": f"WITH {_POSTS}, {more_sql.SIMHASH} SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM fh a JOIN fh b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 3",
    "dedup_near": f"""WITH RECURSIVE {_POSTS}, {more_sql.SIMHASH}, o AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM fh),
        g AS (SELECT n, id, [h] AS kept, true AS stays FROM o WHERE n = 1 UNION ALL SELECT n, id, CASE WHEN near THEN kept ELSE list_append(kept, h) END, NOT near
            FROM (SELECT o.n, o.id, o.h, g.kept, len(list_filter(g.kept, lambda x: bit_count(xor(x, o.h)) <= 3)) > 0 AS near FROM g JOIN o ON o.n = g.n + 1)) SELECT id AS post_id FROM g WHERE stays""",
    "landing_candles": f"""WITH {TICKS}, ms AS (SELECT symbol, date_trunc('millisecond', datetime) AS datetime, min(price) AS close FROM ticks GROUP BY 1, 2)
        SELECT symbol, count(*) AS n, min(datetime) AS first_time, max(datetime) AS last_time, round(sum(close), 6) AS total FROM ms GROUP BY symbol""",
    "signed_log_diff": f"""WITH {BARS}, g AS (SELECT *, close - open AS change, min(close) OVER s AS lc, min(close - open) OVER s AS lo FROM b WINDOW s AS (PARTITION BY symbol)),
        y AS (SELECT symbol, datetime, CASE WHEN lc <= 0 THEN sign(close) * ln(1 + abs(close)) ELSE ln(close) END AS a, CASE WHEN lo <= 0 THEN sign(change) * ln(1 + abs(change)) ELSE ln(change) END AS c FROM g),
        e AS (SELECT symbol, datetime, a - {lag('a')} AS a, c - {lag('c')} AS c FROM y) SELECT symbol, datetime, {r('a')} AS close, {r('c')} AS change, {r('a')} AS log_return FROM e WHERE a IS NOT NULL AND c IS NOT NULL""",
    "sentiment_features": f"""WITH RECURSIVE {_POSTS}, {_HP}, o AS (SELECT *, row_number() OVER (ORDER BY time_window) AS n FROM hp),
        em AS (SELECT n, mean_sentiment AS v FROM o WHERE n = 1 UNION ALL SELECT o.n, e.v + (o.mean_sentiment - e.v) / 3 FROM em e JOIN o ON o.n = e.n + 1)
        SELECT time_window, {r('mean_sentiment')} AS post_sentiment_mean, {r('std_sentiment')} AS post_sentiment_volatility, CAST(post_id_count AS DOUBLE) AS post_volume, {r('coalesce(mean_sentiment - lag(mean_sentiment) OVER w, 0)')} AS post_sentiment_momentum,
            {r('mean_sentiment * sentiment_confidence_mean')} AS post_confidence_weighted, {r('sentiment_confidence_mean')} AS post_confidence, {', '.join(f'{r(f"coalesce(lag(mean_sentiment, {k}) OVER w, 0)")} AS post_lag_{k}' for k in range(1, 6))}, {r('v')} AS post_sentiment_ema
        FROM o JOIN em USING (n) WINDOW w AS (ORDER BY time_window)""",
}

_CHUNK = lambda c: _BACKTEST.replace("FROM voted),", f"FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS k_, count(*) OVER (PARTITION BY symbol) AS n_ FROM voted) WHERE k_ <= ({c} + 1) * n_ // 2)),", 1) + f" SELECT {c} AS chunk, 's3' AS strategy, symbol, arg_max(pnl_sum, event) AS pnl FROM ledger GROUP BY symbol"
_V1 = f"""WITH RECURSIVE {TICKS}, {bucketed('half', '12 hours')}, voted AS (SELECT symbol, datetime, CASE WHEN close - open > 10 THEN 1 WHEN close - open < -10 THEN -1 ELSE 0 END AS signals FROM half), {bucketed('mins', '1 minute')},
    pred AS (SELECT symbol, datetime, signals, lead(datetime) OVER (PARTITION BY symbol ORDER BY datetime) AS till, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS i FROM voted),
    iv AS (SELECT p.symbol, p.i, p.signals, list(m.datetime ORDER BY m.datetime) AS ts, list(m.open ORDER BY m.datetime) AS os, list(m.high ORDER BY m.datetime) AS hs, list(m.low ORDER BY m.datetime) AS ls
        FROM pred p JOIN mins m ON m.symbol = p.symbol AND m.datetime >= p.datetime AND m.datetime < p.till GROUP BY ALL),
    nv AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM iv WHERE len(ts) > 10),
    st AS (SELECT symbol, CAST(0 AS BIGINT) AS k, false AS held, CAST(0 AS DOUBLE) AS entry, CAST(arg_min(signals, i) AS INTEGER) AS prev, CAST(1000 AS DOUBLE) AS balance, false AS broke,
        CAST([] AS STRUCT(t TIMESTAMP, side INTEGER, act VARCHAR, bp DOUBLE, sp DOUBLE, bal DOUBLE, pnl DOUBLE)[]) AS ev FROM pred GROUP BY symbol
      UNION ALL
      SELECT symbol, k, CASE WHEN now = 0 THEN held ELSE h IS NULL END, CASE WHEN now = 0 THEN entry0 ELSE entry END, CASE WHEN now = 0 THEN prev0 ELSE now END, CASE WHEN h IS NULL THEN bal3 ELSE bal3 + bal3 * pnl / 100 END, CASE WHEN h IS NULL THEN bal3 ELSE bal3 + bal3 * pnl / 100 END < 500,
        CASE WHEN h IS NULL THEN ev3 ELSE list_append(ev3, {{'t': ts[h], 'side': now, 'act': CASE WHEN pnl > 0 THEN 'sell - take_profit' ELSE 'sell - stop_loss' END, 'bp': entry, 'sp': px, 'bal': bal3 + bal3 * pnl / 100, 'pnl': pnl}}) END
      FROM (SELECT *, (px - entry) / entry * 100 * (CASE WHEN prev > 0 THEN 1 ELSE -1 END) - 0.05 AS pnl FROM
       (SELECT *, CASE WHEN ls[h] <= least(up, dn) THEN ls[h] ELSE hs[h] END AS px FROM
        (SELECT *, CASE WHEN now <> 0 THEN list_position(list_transform(range(1, len(ts) + 1), lambda j: hs[j] >= greatest(up, dn) OR ls[j] <= least(up, dn)), true) END AS h FROM
         (SELECT *, entry * (1 + now * 30.0 / 100) AS up, entry * (1 - now * 20.0 / 100) AS dn FROM
          (SELECT *, CASE WHEN fresh OR turn THEN bal2 - bal2 * 0.05 / 100 ELSE bal2 END AS bal3,
             CASE WHEN fresh OR turn THEN list_append(ev2, {{'t': ts[1], 'side': now, 'act': 'buy', 'bp': os[1], 'sp': 0.0, 'bal': bal2 - bal2 * 0.05 / 100, 'pnl': -0.05}}) ELSE ev2 END AS ev3, CASE WHEN fresh OR turn THEN os[1] ELSE entry0 END AS entry, CASE WHEN fresh THEN now ELSE prev0 END AS prev FROM
           (SELECT *, CASE WHEN turn THEN bal0 + bal0 * out / 100 ELSE bal0 END AS bal2, CASE WHEN turn THEN list_append(ev, {{'t': ts[1], 'side': now, 'act': 'sell - direction change', 'bp': entry0, 'sp': os[1], 'bal': bal0 + bal0 * out / 100, 'pnl': out}}) ELSE ev END AS ev2 FROM
            (SELECT *, now <> 0 AND NOT held AS fresh, now <> 0 AND held AND now <> prev0 AS turn, CASE WHEN held THEN (os[1] - entry0) / entry0 * 100 * (CASE WHEN prev0 > 0 THEN 1 ELSE -1 END) - 0.05 END AS out FROM
             (SELECT s.symbol, n.k, n.ts, n.os, n.hs, n.ls, s.held, s.entry AS entry0, s.prev AS prev0, s.balance AS bal0, s.ev, CASE WHEN n.signals <> 0 THEN CAST(n.signals AS INTEGER) ELSE s.prev END AS now
              FROM st s JOIN nv n ON n.symbol = s.symbol AND n.k = s.k + 1 WHERE NOT s.broke))))))))),
    fin AS (SELECT symbol, arg_max(ev, k) AS ev FROM st GROUP BY symbol), alle AS (SELECT symbol, unnest(ev) AS e, generate_subscripts(ev, 1) - 1 AS event FROM fin)
    SELECT 's3' AS strategy, symbol, CAST(event AS BIGINT) AS event, e.t AS datetime, CASE WHEN e.side > 0 THEN 'long' ELSE 'short' END AS predicted_direction, e.act AS action, round(e.bp, 6) AS buy_price, round(e.sp, 6) AS sell_price,
        round(e.bal, 2) AS balance, round(e.pnl, 2) AS pnl, round(sum(e.pnl) OVER (PARTITION BY symbol ORDER BY event), 2) AS pnl_sum FROM alle"""
_SOFT = "SELECT symbol, datetime, [(open - close) / 10, (high - close) / 10, (close - low) / 10] AS s FROM bars"
ORACLE_SQL |= {
    "chunked_evaluation": f"SELECT * FROM ({_CHUNK(0)}) UNION ALL SELECT * FROM ({_CHUNK(1)})",
    "backtest_v1": _V1,
    "paged_candles": f"""WITH {TICKS}, {bucketed('fives', '5 minutes')} SELECT 'binance' AS exchange, upper(symbol) AS symbol, datetime, {', '.join(f'{r(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, CAST(volume AS DOUBLE) AS volume
        FROM fives WHERE datetime BETWEEN '2024-01-02' AND '2024-01-20 12:30:00'""",
    "price_lookup": f"WITH {BARS}, m AS (SELECT symbol, datetime + INTERVAL 1 HOUR AS datetime, CASE WHEN close > open THEN 1 ELSE -1 END AS signal FROM b) SELECT symbol, datetime, signal, round(c.close, 6) AS actual_price FROM m LEFT JOIN (SELECT symbol, datetime, close FROM bars) c USING (symbol, datetime)",
    "target_lookup": f"WITH {BARS}, t AS (SELECT symbol, datetime, rn, CASE WHEN count(*) OVER f = 15 THEN max(close) OVER f END AS target FROM b WINDOW f AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)) SELECT symbol, datetime, round(target, 6) AS original_target FROM t WHERE rn > 1",
    "join_indicators": f"WITH {BARS} SELECT symbol, datetime, round(close, 6) AS close, coalesce({r(mean(_C, 30))}, 0) AS sma, coalesce({r('100 * (close / nullif(' + lag('close', 10) + ', 0) - 1)')}, 0) AS roc FROM b",
    "date_range": f"WITH {_POSTS}, {_COMMENTS}, w AS (SELECT date_trunc('hour', post_time) AS t FROM posts UNION ALL SELECT date_trunc('hour', comment_time) FROM comments) SELECT min(t) AS start_date, max(t) AS end_date FROM w",
    "final_selection": f"WITH {_TARGETS} SELECT symbol, datetime, {', '.join(f'{r(c)} AS {c}' for c in ('sentiment_combined', 'returns', 'volatility', 'volume_change', 'price_momentum', 'divergence', 'fear_greed'))}, 0 AS not_there, target, {r('target_return')} AS target_return FROM tg",
    "lot_steps": f"WITH {TICKS} SELECT event_id, round(trunc((price - 50) / 0.25) * 0.25, 6) + 0.0 AS lots FROM ticks",
    "strategy_ids": """WITH t AS (SELECT o_orderkey, (['1h', '4h', '1d'])[o_orderkey % 3 + 1] AS tf, o_orderstatus AS s FROM orders)
        SELECT o_orderkey, 'sig_' || tf || '_' || lower(s) || '_' || (row_number() OVER (PARTITION BY tf ORDER BY o_orderkey) + CASE WHEN tf = '4h' THEN 10 ELSE 0 END) AS strategy FROM t""",
    "strategy_analysis": """SELECT CAST(o_orderkey AS VARCHAR) AS strategy, concat_ws(',', CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 'CDLDOJI' END, CASE WHEN o_orderkey % 3 = 0 THEN 'ROC' END, CASE WHEN o_orderkey % 2 = 0 THEN 'SMA' END) AS active_flags,
        CAST(greatest(o_orderkey % 50, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 60 END) AS DOUBLE) AS max_window FROM orders""",
    "class_scores": f"""WITH {BARS}, s AS ({_SOFT}), e AS (SELECT *, exp(s[1]) + exp(s[2]) + exp(s[3]) AS z FROM s) SELECT symbol, datetime, CAST(CASE WHEN s[1] >= s[2] AND s[1] >= s[3] THEN -1 WHEN s[2] >= s[3] THEN 0 ELSE 1 END AS INTEGER) AS class,
        {', '.join(f'round(exp(s[{k + 1}]) / z, 6) AS p{k}' for k in range(3))} FROM e""",
    "votes_estimate": "SELECT event_id, CASE WHEN event_id % 11 > 0 THEN CAST(floor((event_id % 1000) / ((event_id % 11) / 10.0::DOUBLE)) AS INTEGER) ELSE 0 END AS estimated_upvotes, CASE WHEN event_id % 11 > 0 THEN CAST(floor((event_id % 1000) / ((event_id % 11) / 10.0::DOUBLE)) AS INTEGER) ELSE 0 END - CAST(event_id % 1000 AS INTEGER) AS estimated_downvotes FROM events",
}

# the same rows by other means
ORACLE_SQL |= {f"split_{x}": ORACLE_SQL[f"ind_{x}"] for x in ("ema", "tema", "macd", "rsi", "atr")} | {"backtest_folded": ORACLE_SQL["backtest_ledger"]}
ORACLE_SQL["stream_candles"] = ORACLE_SQL["paged_candles"]
ORACLE_SQL["stream_windows"] = f"SELECT symbol, datetime, sma, ema, mom FROM ({ORACLE_SQL['ind_sma']}) JOIN ({ORACLE_SQL['ind_ema']}) USING (symbol, datetime) JOIN ({ORACLE_SQL['ind_mom']}) USING (symbol, datetime)"
