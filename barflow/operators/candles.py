"""Candlestick patterns: one boolean expression each over the last five bars.

Bar 0 is the newest. Its parts are columns: o h l c (prices), b (body), r (range), u d
(upper, lower shadow), top bot (of the body), w (white), and averages over the bars
before it: avb (body, 10), avr (range, 10), avs (half of both shadows, 10), av5 (range,
5). Expressions are plain SQL text, so that any SQL engine can check them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.windows import Series

PARTS = ("o", "h", "l", "c", "b", "r", "u", "d", "top", "bot", "w", "avb", "avr", "avs", "av5")
BARS = 5


def _long(*k):
    return " AND ".join(f"b{i} > avb{i}" for i in k)


def _short(*k):
    return " AND ".join(f"b{i} <= avb{i}" for i in k)


def _shorter(*k):
    return " AND ".join(f"b{i} < avb{i}" for i in k)


def _doji(*k):
    return " AND ".join(f"b{i} <= 0.1 * avr{i}" for i in k)


def _no_up(*k):
    return " AND ".join(f"u{i} < 0.1 * avr{i}" for i in k)


def _no_down(*k):
    return " AND ".join(f"d{i} < 0.1 * avr{i}" for i in k)


def _white(*k):
    return " AND ".join(f"w{i}" for i in k)


def _black(*k):
    return " AND ".join(f"NOT w{i}" for i in k)


def _near(k, x=0.2):
    return f"{x} * av5{k}"


def _about(a, b, k, x=0.05):
    return f"{a} <= {b} + {_near(k, x)} AND {a} >= {b} - {_near(k, x)}"


def _gap_up(a, b):
    return f"bot{a} > top{b}"


def _gap_down(a, b):
    return f"top{a} < bot{b}"


def _inside(a, b):
    return f"top{a} < top{b} AND bot{a} > bot{b}"


def _sign(k):
    return f"(CASE WHEN w{k} THEN 100 ELSE -100 END)"


def _case(*pairs):
    """(condition, value) pairs, else 0; a condition over missing bars is no match."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " ELSE 0 END"


def _all(*conditions):
    return " AND ".join(f"({c})" for c in conditions)


def _either(*conditions):
    return " OR ".join(f"({c})" for c in conditions)


def _methods(s, white):
    """Rising or falling three: s is '<' or '>'."""
    t = ">" if s == "<" else "<"
    return _all(_long(4), _shorter(3, 2, 1), _long(0), f"{'' if white else 'NOT '}w4", f"w3 <> w4 AND w2 = w3 AND w1 = w2 AND w0 = w4", *[f"bot{k} < h4 AND top{k} > l4" for k in (3, 2, 1)], f"c2 {s} c3 AND c1 {s} c2", f"o0 {t} c1 AND c0 {t} c4")


_MARUBOZU_KICK = _all("w1 <> w0", _long(1), _no_up(1), _no_down(1), _long(0), _no_up(0), _no_down(0), _either(_all("NOT w1", "l0 > h1"), _all("w1", "h0 < l1")))

PATTERNS: dict[str, str] = {
    "CDL2CROWS": _case((_all("w2", _long(2), _black(1, 0), _gap_up(1, 2), "o0 < o1 AND o0 > c1", "c0 > o2 AND c0 < c2"), -100)),
    "CDL3BLACKCROWS": _case((_all("w3", _black(2, 1, 0), _no_down(2, 1, 0), "o1 < o2 AND o1 > c2", "o0 < o1 AND o0 > c1", "h3 > c2 AND c2 > c1 AND c1 > c0"), -100)),
    "CDL3INSIDE": _case((_all(_long(2), _short(1), _inside(1, 2), "w2 AND NOT w0 AND c0 < o2"), -100), (_all(_long(2), _short(1), _inside(1, 2), "NOT w2 AND w0 AND c0 > o2"), 100)),
    "CDL3LINESTRIKE": _case(
        (_all("w3 AND w2 AND w1 AND NOT w0", f"o2 >= bot3 - {_near(3)} AND o2 <= top3 + {_near(3)}", f"o1 >= bot2 - {_near(2)} AND o1 <= top2 + {_near(2)}", "c1 > c2 AND c2 > c3", "o0 > c1 AND c0 < o3"), 100),
        (_all(_black(3, 2, 1), "w0", f"o2 >= bot3 - {_near(3)} AND o2 <= top3 + {_near(3)}", f"o1 >= bot2 - {_near(2)} AND o1 <= top2 + {_near(2)}", "c1 < c2 AND c2 < c3", "o0 < c1 AND c0 > o3"), -100),
    ),
    "CDL3OUTSIDE": _case((_all("w1 AND NOT w2", "c1 > o2 AND o1 < c2", "c0 > c1"), 100), (_all("NOT w1 AND w2", "o1 > c2 AND c1 < o2", "c0 < c1"), -100)),
    "CDL3STARSINSOUTH": _case((_all(_black(2, 1, 0), _long(2), "d2 > b2", "b1 < b2", "o1 > c2 AND o1 <= h2", "l1 < c2 AND l1 >= l2", "d1 > 0.1 * avr1", _shorter(0), _no_up(0), _no_down(0), "l0 > l1 AND h0 < h1"), 100)),
    "CDL3WHITESOLDIERS": _case((_all(_white(2, 1, 0), _no_up(2, 1, 0), "c0 > c1 AND c1 > c2", f"o1 > o2 AND o1 <= c2 + {_near(2)}", f"o0 > o1 AND o0 <= c1 + {_near(1)}", f"b1 > b2 - {_near(2, 0.6)}", f"b0 > b1 - {_near(1, 0.6)}", "b0 > avb0"), 100)),
    "CDLABANDONEDBABY": _case((_all(_long(2), _doji(1), "b0 > avb0", "w2 AND NOT w0", "c0 < c2 - b2 * 0.3", "l1 > h2 AND h0 < l1"), -100), (_all(_long(2), _doji(1), "b0 > avb0", "NOT w2 AND w0", "c0 > c2 + b2 * 0.3", "h1 < l2 AND l0 > h1"), 100)),
    "CDLADVANCEBLOCK": _case((_all(_white(2, 1, 0), "c0 > c1 AND c1 > c2", f"o1 > o2 AND o1 <= c2 + {_near(2)}", f"o0 > o1 AND o0 <= c1 + {_near(1)}", _long(2), "u2 < avs2", _either(_all(f"b1 < b2 - {_near(2, 0.6)}", f"b0 < b1 + {_near(1)}"), f"b0 < b1 - {_near(1, 0.6)}", _all("b0 < b1 AND b1 < b2", "u0 > avs0 OR u1 > avs1"), "b0 < b1 AND u0 > b0")), -100)),
    "CDLBELTHOLD": _case((_all(_long(0), _either(_all("w0", _no_down(0)), _all("NOT w0", _no_up(0)))), _sign(0))),
    "CDLBREAKAWAY": _case((_all(_long(4), _black(4, 3, 1), "w0", _gap_down(3, 4), "h2 < h3 AND l2 < l3 AND h1 < h2 AND l1 < l2", "c0 > o3 AND c0 < c4"), 100), (_all(_long(4), _white(4, 3, 1), "NOT w0", _gap_up(3, 4), "h2 > h3 AND l2 > l3 AND h1 > h2 AND l1 > l2", "c0 < o3 AND c0 > c4"), -100)),
    "CDLCLOSINGMARUBOZU": _case((_all(_long(0), _either(_all("w0", _no_up(0)), _all("NOT w0", _no_down(0)))), _sign(0))),
    "CDLCONCEALBABYSWALL": _case((_all(_black(3, 2, 1, 0), _no_up(3, 2), _no_down(3, 2), _gap_down(1, 2), "u1 > 0.1 * avr1", "h1 > c2", "h0 > h1 AND l0 < l1"), 100)),
    "CDLCOUNTERATTACK": _case((_all("w1 <> w0", _long(1, 0), _about("c0", "c1", 1)), _sign(0))),
    "CDLDARKCLOUDCOVER": _case((_all("w1", _long(1), "NOT w0", "o0 > h1", "c0 > o1 AND c0 < c1 - b1 * 0.5"), -100)),
    "CDLDOJI": _case((_doji(0), 100)),
    "CDLDOJISTAR": _case((_all(_long(1), _doji(0), "w1", _gap_up(0, 1)), -100), (_all(_long(1), _doji(0), "NOT w1", _gap_down(0, 1)), 100)),
    "CDLDRAGONFLYDOJI": _case((_all(_doji(0), _no_up(0), "d0 > 0.1 * avr0"), 100)),
    "CDLENGULFING": _case((_all("w0 AND NOT w1", "(c0 >= o1 AND o0 < c1) OR (c0 > o1 AND o0 <= c1)"), 100), (_all("NOT w0 AND w1", "(o0 >= c1 AND c0 < o1) OR (o0 > c1 AND c0 <= o1)"), -100)),
    "CDLEVENINGDOJISTAR": _case((_all(_long(2), "w2", _doji(1), _gap_up(1, 2), "NOT w0", "c0 < c2 - b2 * 0.3"), -100)),
    "CDLEVENINGSTAR": _case((_all(_long(2), "w2", _short(1), _gap_up(1, 2), "b0 > avb0", "NOT w0", "c0 < c2 - b2 * 0.3"), -100)),
    "CDLGAPSIDESIDEWHITE": _case((_all(_gap_up(1, 2), _gap_up(0, 2), _white(1, 0), _about("b0", "b1", 1, 0.2), _about("o0", "o1", 1)), 100), (_all(_gap_down(1, 2), _gap_down(0, 2), _white(1, 0), _about("b0", "b1", 1, 0.2), _about("o0", "o1", 1)), -100)),
    "CDLGRAVESTONEDOJI": _case((_all(_doji(0), _no_down(0), "u0 > 0.1 * avr0"), 100)),
    "CDLHAMMER": _case((_all(_shorter(0), "d0 > b0", _no_up(0), f"bot0 <= l1 + {_near(1)}"), 100)),
    "CDLHANGINGMAN": _case((_all(_shorter(0), "d0 > b0", _no_up(0), f"bot0 >= h1 - {_near(1)}"), -100)),
    "CDLHARAMI": _case((_all(_long(1), _short(0), _inside(0, 1)), f"-{_sign(1)}")),
    "CDLHARAMICROSS": _case((_all(_long(1), _doji(0), _inside(0, 1)), f"-{_sign(1)}")),
    "CDLHIGHWAVE": _case((_all(_shorter(0), "u0 > 2 * b0 AND d0 > 2 * b0"), _sign(0))),
    "CDLHOMINGPIGEON": _case((_all(_black(1, 0), _long(1), _short(0), "o0 < o1 AND c0 > c1"), 100)),
    "CDLIDENTICAL3CROWS": _case((_all(_black(2, 1, 0), _no_down(2, 1, 0), "c2 > c1 AND c1 > c0", _about("o1", "c2", 2), _about("o0", "c1", 1)), -100)),
    "CDLINNECK": _case((_all("NOT w1", _long(1), "w0", "o0 < l1", f"c0 <= c1 + {_near(1, 0.05)} AND c0 >= c1"), -100)),
    "CDLINVERTEDHAMMER": _case((_all(_shorter(0), "u0 > b0", _no_down(0), _gap_down(0, 1)), 100)),
    "CDLKICKING": _case((_MARUBOZU_KICK, _sign(0))),
    "CDLKICKINGBYLENGTH": _case((_MARUBOZU_KICK, f"(CASE WHEN b0 > b1 THEN {_sign(0)} ELSE {_sign(1)} END)")),
    "CDLLADDERBOTTOM": _case((_all(_black(4, 3, 2, 1), "o4 > o3 AND o3 > o2", "c4 > c3 AND c3 > c2", "u1 > 0.1 * avr1", "w0", "o0 > o1 AND c0 > h1"), 100)),
    "CDLLONGLEGGEDDOJI": _case((_all(_doji(0), "d0 > b0 OR u0 > b0"), 100)),
    "CDLLONGLINE": _case((_all(_long(0), "u0 < avs0 AND d0 < avs0"), _sign(0))),
    "CDLMARUBOZU": _case((_all(_long(0), _no_up(0), _no_down(0)), _sign(0))),
    "CDLMATCHINGLOW": _case((_all(_black(1, 0), _about("c0", "c1", 1)), 100)),
    "CDLMATHOLD": _case((_all(_long(4), _shorter(3, 2, 1), "w4 AND NOT w3 AND w0", _gap_up(3, 4), "bot2 < c4 AND bot1 < c4", "bot2 > c4 - b4 * 0.5 AND bot1 > c4 - b4 * 0.5", "top2 < o3 AND top1 < top2", "o0 > c1", "c0 > h3 AND c0 > h2 AND c0 > h1"), 100)),
    "CDLMORNINGDOJISTAR": _case((_all(_long(2), "NOT w2", _doji(1), _gap_down(1, 2), "w0", "c0 > c2 + b2 * 0.3"), 100)),
    "CDLMORNINGSTAR": _case((_all(_long(2), "NOT w2", _short(1), _gap_down(1, 2), "b0 > avb0", "w0", "c0 > c2 + b2 * 0.3"), 100)),
    "CDLONNECK": _case((_all("NOT w1", _long(1), "w0", "o0 < l1", _about("c0", "l1", 1)), -100)),
    "CDLPIERCING": _case((_all("NOT w1", _long(1), "w0", _long(0), "o0 < l1", "c0 < o1 AND c0 > c1 + b1 * 0.5"), 100)),
    "CDLRICKSHAWMAN": _case((_all(_doji(0), "d0 > b0 AND u0 > b0", f"bot0 <= l0 + r0 / 2 + {_near(0)} AND top0 >= l0 + r0 / 2 - {_near(0)}"), 100)),
    "CDLRISEFALL3METHODS": _case((_methods("<", True), 100), (_methods(">", False), -100)),
    "CDLSEPARATINGLINES": _case((_all("w1 <> w0", _about("o0", "o1", 1), _long(0), _either(_all("w0", _no_down(0)), _all("NOT w0", _no_up(0)))), _sign(0))),
    "CDLSHOOTINGSTAR": _case((_all(_shorter(0), "u0 > b0", _no_down(0), _gap_up(0, 1)), -100)),
    "CDLSHORTLINE": _case((_all(_shorter(0), "u0 < avs0 AND d0 < avs0"), _sign(0))),
    "CDLSPINNINGTOP": _case((_all(_shorter(0), "u0 > b0 AND d0 > b0"), _sign(0))),
    "CDLSTALLEDPATTERN": _case((_all(_white(2, 1, 0), "c0 > c1 AND c1 > c2", _long(2, 1), _no_up(1), f"o1 > o2 AND o1 <= c2 + {_near(2)}", "b0 < avb0", f"o0 >= c1 - b0 - {_near(1)}"), -100)),
    "CDLSTICKSANDWICH": _case((_all("NOT w2 AND w1 AND NOT w0", "l1 > c2", _about("c0", "c2", 2)), 100)),
    "CDLTAKURI": _case((_all(_doji(0), _no_up(0), "d0 > 2 * b0"), 100)),
    "CDLTASUKIGAP": _case((_all(_gap_up(1, 2), "w1 AND NOT w0", "o0 < c1 AND o0 > o1", "c0 < o1 AND c0 > top2", f"abs(b1 - b0) < {_near(1)}"), 100), (_all(_gap_down(1, 2), "NOT w1 AND w0", "o0 < o1 AND o0 > c1", "c0 > o1 AND c0 < bot2", f"abs(b1 - b0) < {_near(1)}"), -100)),
    "CDLTHRUSTING": _case((_all("NOT w1", _long(1), "w0", "o0 < l1", f"c0 > c1 + {_near(1, 0.05)} AND c0 <= c1 + b1 * 0.5"), -100)),
    "CDLTRISTAR": _case((_all("b2 <= 0.1 * avr2 AND b1 <= 0.1 * avr2 AND b0 <= 0.1 * avr2", _gap_up(1, 2), "top0 < top1"), -100), (_all("b2 <= 0.1 * avr2 AND b1 <= 0.1 * avr2 AND b0 <= 0.1 * avr2", _gap_down(1, 2), "bot0 > bot1"), 100)),
    "CDLUNIQUE3RIVER": _case((_all(_long(2), _black(2, 1), "c1 > c2 AND o1 <= o2 AND l1 < l2", _shorter(0), "w0", "o0 > l1"), 100)),
    "CDLUPSIDEGAP2CROWS": _case((_all("w2", _long(2), "NOT w1", _short(1), _gap_up(1, 2), "NOT w0", "o0 > o1 AND c0 < c1 AND c0 > c2"), -100)),
    "CDLXSIDEGAP3METHODS": _case((_all("w2 = w1 AND w1 <> w0", "o0 < top1 AND o0 > bot1", "c0 < top2 AND c0 > bot2", _either(_all("w2", _gap_up(1, 2)), _all("NOT w2", _gap_down(1, 2)))), _sign(2))),
}

_TRAP = "h1 < h2 AND l1 > l2"
#: A false break out of an inside bar; confirmed (200) if one of the next three closes leaves the inside bar the other way.
TRAPS: dict[str, str] = {
    "CDLHIKKAKE": _case((_all(_TRAP, "h0 < h1 AND l0 < l1"), 100), (_all(_TRAP, "h0 > h1 AND l0 > l1"), -100)),
    "CDLHIKKAKEMOD": _case(
        (_all("h2 < h3 AND l2 > l3", "h1 < h2 AND l1 > l2", "h0 < h1 AND l0 < l1", f"c2 <= l2 + {_near(2)}"), 100),
        (_all("h2 < h3 AND l2 > l3", "h1 < h2 AND l1 > l2", "h0 > h1 AND l0 > l1", f"c2 >= h2 - {_near(2)}"), -100),
    ),
}
NAMES = sorted([*PATTERNS, *TRAPS])
# Bars before a pattern's first result, by number; the others have 10 and one for every bar they look back.
_FIRST = {2: "CDLENGULFING CDLXSIDEGAP3METHODS", 3: "CDL3OUTSIDE", 5: "CDLHIKKAKE", 6: "CDLMATCHINGLOW", 7: "CDLGAPSIDESIDEWHITE CDLSTICKSANDWICH CDLTASUKIGAP", 8: "CDL3LINESTRIKE", 10: "CDLHIKKAKEMOD"}


def first_result(name: str) -> int:
    """How many bars a series has before a pattern's first result."""
    given = next((n for n, names in _FIRST.items() if name in names.split()), None)
    return given if given is not None else 10 + max(int(k) for k in re.findall(r"[a-z]([0-4])\b", PATTERNS[name]))


_CONFIRM = "CASE WHEN {x} <> 0 THEN {x} " + " ".join(
    f"WHEN {' AND '.join(['{x}_' + str(m) + ' = 0' for m in range(1, k)] + ['{x}_' + str(k) + s + '0', f'c0 {g} {p}{k + 1}'] + [f'c{m} {n} {p}{k + 1}' for m in range(1, k)])} THEN {v}"
    for k in (1, 2, 3)
    for s, g, n, p, v in ((" > ", ">", "<=", "h", 200), (" < ", "<", ">=", "l", -200))
) + " ELSE 0 END"


def confirmation(x: str) -> str:
    """SQL over a raw trap column x and x_1..x_3 before it: the trap itself, or its confirmation within three bars."""
    return _CONFIRM.replace("{x}", x)


def add_patterns(bars: DataFrame, names: list[str] | None = None, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Bars with an integer column (-200..200) for each pattern; unknown names raise."""
    names = NAMES if names is None else [n.upper() for n in names]
    if unknown := [n for n in names if n not in PATTERNS and n not in TRAPS]:
        raise ValueError(f"unknown patterns: {', '.join(unknown)}")
    s = Series(keys, time)
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    base = {"o": o, "h": h, "l": lo, "c": c, "b": F.abs(c - o), "r": h - lo, "u": h - F.greatest(o, c), "d": F.least(o, c) - lo, "top": F.greatest(o, c), "bot": F.least(o, c), "w": c >= o}
    out = bars.withColumns({f"{k}0": v for k, v in base.items()})
    before = lambda x, n: F.when(F.count(x).over(s.order.rowsBetween(-n, -1)) == n, F.avg(x).over(s.order.rowsBetween(-n, -1)))
    out = out.withColumns({"avb0": before(F.col("b0"), 10), "avr0": before(F.col("r0"), 10), "avs0": before((F.col("u0") + F.col("d0")) / 2, 10), "av50": before(F.col("r0"), 5)})
    out = out.withColumns({f"{p}{k}": s.lag(F.col(f"{p}0"), k) for k in range(1, BARS) for p in PARTS})
    late = lambda n, x: F.when(F.col("__rn") > first_result(n), x).otherwise(0)
    out = out.withColumn("__rn", F.row_number().over(s.order))
    out = out.withColumns({n: late(n, F.expr(PATTERNS[n])) for n in names if n in PATTERNS} | {f"{n}_raw": F.expr(TRAPS[n]) for n in names if n in TRAPS})
    traps = [n for n in names if n in TRAPS]
    if traps:
        out = out.withColumns({f"{n}_raw_{k}": F.coalesce(s.lag(F.col(f"{n}_raw"), k), F.lit(0)) for n in traps for k in (1, 2, 3)})
        out = out.withColumns({n: late(n, F.expr(confirmation(f"{n}_raw"))) for n in traps})
    return out.select(*bars.columns, *names)
