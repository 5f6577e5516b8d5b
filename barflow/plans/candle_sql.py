"""SQL of the candlestick patterns, written from their public definitions for DuckDB.

Every bar carries lists of itself and the bars before it, newest first; ``prices(k)`` and
the averages are read from these.  Nothing here comes from the engine's own expressions.
"""

from __future__ import annotations

import re

#: Public settings: what is averaged over how many earlier bars, and the factor.
_SETTINGS = {"Long": ("bo", 10, 1.0), "Short": ("bo", 10, 1.0), "Doji": ("ra", 10, 0.1), "Shadow": ("sh", 10, 0.5), "Tiny": ("ra", 10, 0.1), "Near": ("ra", 5, 0.2), "Far": ("ra", 5, 0.6), "Equal": ("ra", 5, 0.05)}

#: name: (bars before the first result, condition, value). Words of a condition: O H L C prices, B body, R range, U D upper
#: and lower shadow, T M top and bottom of the body, W white; then settings; each with the bars back in brackets.
_P: dict[str, tuple[int, str, str]] = {}


def _add(name: str, first: int, when: str, value: str) -> None:
    _P[name] = (first, when, value)


SIGN0, SIGN1, SIGN2 = (f"(CASE WHEN W[{k}] THEN 100 ELSE -100 END)" for k in (0, 1, 2))
_GAP = "(M[{a}] > T[{b}])"
_DOWN = "(T[{a}] < M[{b}])"
UP10, DOWN10, UP21, DOWN21 = _GAP.format(a=0, b=1), _DOWN.format(a=0, b=1), _GAP.format(a=1, b=2), _DOWN.format(a=1, b=2)

_add("CDLDOJI", 10, "B[0] <= Doji[0]", "100")
_add("CDLDRAGONFLYDOJI", 10, "B[0] <= Doji[0] AND U[0] < Tiny[0] AND D[0] > Tiny[0]", "100")
_add("CDLGRAVESTONEDOJI", 10, "B[0] <= Doji[0] AND D[0] < Tiny[0] AND U[0] > Tiny[0]", "100")
_add("CDLLONGLEGGEDDOJI", 10, "B[0] <= Doji[0] AND (D[0] > B[0] OR U[0] > B[0])", "100")
_add("CDLRICKSHAWMAN", 10, "B[0] <= Doji[0] AND D[0] > B[0] AND U[0] > B[0] AND M[0] <= L[0] + R[0] / 2 + Near[0] AND T[0] >= L[0] + R[0] / 2 - Near[0]", "100")
_add("CDLTAKURI", 10, "B[0] <= Doji[0] AND U[0] < Tiny[0] AND D[0] > 2 * B[0]", "100")
_add("CDLBELTHOLD", 10, "B[0] > Long[0] AND CASE WHEN W[0] THEN D[0] < Tiny[0] ELSE U[0] < Tiny[0] END", SIGN0)
_add("CDLCLOSINGMARUBOZU", 10, "B[0] > Long[0] AND CASE WHEN W[0] THEN U[0] < Tiny[0] ELSE D[0] < Tiny[0] END", SIGN0)
_add("CDLMARUBOZU", 10, "B[0] > Long[0] AND greatest(U[0], D[0]) < Tiny[0]", SIGN0)
_add("CDLLONGLINE", 10, "B[0] > Long[0] AND greatest(U[0], D[0]) < Shadow[0]", SIGN0)
_add("CDLSHORTLINE", 10, "B[0] < Short[0] AND greatest(U[0], D[0]) < Shadow[0]", SIGN0)
_add("CDLSPINNINGTOP", 10, "B[0] < Short[0] AND least(U[0], D[0]) > B[0]", SIGN0)
_add("CDLHIGHWAVE", 10, "B[0] < Short[0] AND least(U[0], D[0]) > 2 * B[0]", SIGN0)
_add("CDLHAMMER", 11, "B[0] < Short[0] AND D[0] > B[0] AND U[0] < Tiny[0] AND M[0] <= L[1] + Near[1]", "100")
_add("CDLHANGINGMAN", 11, "B[0] < Short[0] AND D[0] > B[0] AND U[0] < Tiny[0] AND M[0] >= H[1] - Near[1]", "-100")
_add("CDLINVERTEDHAMMER", 11, f"B[0] < Short[0] AND U[0] > B[0] AND D[0] < Tiny[0] AND {DOWN10}", "100")
_add("CDLSHOOTINGSTAR", 11, f"B[0] < Short[0] AND U[0] > B[0] AND D[0] < Tiny[0] AND {UP10}", "-100")
_add("CDLCOUNTERATTACK", 11, "W[0] <> W[1] AND B[1] > Long[1] AND B[0] > Long[0] AND abs(C[0] - C[1]) <= Equal[1]", SIGN0)
_add("CDLDARKCLOUDCOVER", 11, "W[1] AND B[1] > Long[1] AND NOT W[0] AND O[0] > H[1] AND C[0] > O[1] AND C[0] < C[1] - B[1] * 0.5", "-100")
_add("CDLDOJISTAR", 11, f"B[1] > Long[1] AND B[0] <= Doji[0] AND CASE WHEN W[1] THEN {UP10} ELSE {DOWN10} END", f"-{SIGN1}")
_add("CDLENGULFING", 2, "W[0] <> W[1] AND T[0] >= T[1] AND M[0] <= M[1] AND (T[0] > T[1] OR M[0] < M[1])", SIGN0)
_add("CDLHARAMI", 11, "B[1] > Long[1] AND B[0] <= Short[0] AND T[0] < T[1] AND M[0] > M[1]", f"-{SIGN1}")
_add("CDLHARAMICROSS", 11, "B[1] > Long[1] AND B[0] <= Doji[0] AND T[0] < T[1] AND M[0] > M[1]", f"-{SIGN1}")
_add("CDLHOMINGPIGEON", 11, "NOT W[1] AND NOT W[0] AND B[1] > Long[1] AND B[0] <= Short[0] AND O[0] < O[1] AND C[0] > C[1]", "100")
_add("CDLINNECK", 11, "NOT W[1] AND B[1] > Long[1] AND W[0] AND O[0] < L[1] AND C[0] BETWEEN C[1] AND C[1] + Equal[1]", "-100")
_add("CDLONNECK", 11, "NOT W[1] AND B[1] > Long[1] AND W[0] AND O[0] < L[1] AND C[0] BETWEEN L[1] - Equal[1] AND L[1] + Equal[1]", "-100")
_add("CDLTHRUSTING", 11, "NOT W[1] AND B[1] > Long[1] AND W[0] AND O[0] < L[1] AND C[0] > C[1] + Equal[1] AND C[0] <= C[1] + B[1] * 0.5", "-100")
_add("CDLPIERCING", 11, "NOT W[1] AND B[1] > Long[1] AND W[0] AND B[0] > Long[0] AND O[0] < L[1] AND C[0] < O[1] AND C[0] > C[1] + B[1] * 0.5", "100")
_KICK = "W[0] <> W[1] AND B[1] > Long[1] AND greatest(U[1], D[1]) < Tiny[1] AND B[0] > Long[0] AND greatest(U[0], D[0]) < Tiny[0] AND CASE WHEN W[0] THEN L[0] > H[1] ELSE H[0] < L[1] END"
_add("CDLKICKING", 11, _KICK, SIGN0)
_add("CDLKICKINGBYLENGTH", 11, _KICK, f"CASE WHEN B[0] > B[1] THEN {SIGN0} ELSE {SIGN1} END")
_add("CDLMATCHINGLOW", 6, "NOT W[1] AND NOT W[0] AND C[0] BETWEEN C[1] - Equal[1] AND C[1] + Equal[1]", "100")
_add("CDLSEPARATINGLINES", 11, "W[0] <> W[1] AND O[0] BETWEEN O[1] - Equal[1] AND O[1] + Equal[1] AND B[0] > Long[0] AND CASE WHEN W[0] THEN D[0] < Tiny[0] ELSE U[0] < Tiny[0] END", SIGN0)
_add("CDL2CROWS", 12, f"W[2] AND B[2] > Long[2] AND NOT W[1] AND {UP21} AND NOT W[0] AND O[0] < O[1] AND O[0] > C[1] AND C[0] > O[2] AND C[0] < C[2]", "-100")
_add("CDL3INSIDE", 12, "B[2] > Long[2] AND B[1] <= Short[1] AND T[1] < T[2] AND M[1] > M[2] AND W[0] <> W[2] AND CASE WHEN W[2] THEN C[0] < O[2] ELSE C[0] > O[2] END", f"-{SIGN2}")
_add("CDL3OUTSIDE", 3, "W[1] <> W[2] AND T[1] > T[2] AND M[1] < M[2] AND CASE WHEN W[1] THEN C[0] > C[1] ELSE C[0] < C[1] END", SIGN1)
_add("CDL3STARSINSOUTH", 12, "NOT W[2] AND NOT W[1] AND NOT W[0] AND B[2] > Long[2] AND D[2] > B[2] AND B[1] < B[2] AND O[1] > C[2] AND O[1] <= H[2] AND L[1] < C[2] AND L[1] >= L[2] AND D[1] > Tiny[1] AND B[0] < Short[0] AND U[0] < Tiny[0] AND D[0] < Tiny[0] AND L[0] > L[1] AND H[0] < H[1]", "100")
_add("CDL3WHITESOLDIERS", 12, "W[2] AND W[1] AND W[0] AND U[2] < Tiny[2] AND U[1] < Tiny[1] AND U[0] < Tiny[0] AND C[0] > C[1] AND C[1] > C[2] AND O[1] > O[2] AND O[1] <= C[2] + Near[2] AND O[0] > O[1] AND O[0] <= C[1] + Near[1] AND B[1] > B[2] - Far[2] AND B[0] > B[1] - Far[1] AND B[0] > Short[0]", "100")
_add("CDLABANDONEDBABY", 12, "B[2] > Long[2] AND B[1] <= Doji[1] AND B[0] > Short[0] AND W[0] <> W[2] AND CASE WHEN W[2] THEN C[0] < C[2] - B[2] * 0.3 AND L[1] > H[2] AND H[0] < L[1] ELSE C[0] > C[2] + B[2] * 0.3 AND H[1] < L[2] AND L[0] > H[1] END", SIGN0)
_add(
    "CDLADVANCEBLOCK",
    12,
    "W[2] AND W[1] AND W[0] AND C[0] > C[1] AND C[1] > C[2] AND O[1] > O[2] AND O[1] <= C[2] + Near[2] AND O[0] > O[1] AND O[0] <= C[1] + Near[1] AND B[2] > Long[2] AND U[2] < Shadow[2] AND "
    "((B[1] < B[2] - Far[2] AND B[0] < B[1] + Near[1]) OR B[0] < B[1] - Far[1] OR (B[0] < B[1] AND B[1] < B[2] AND (U[0] > Shadow[0] OR U[1] > Shadow[1])) OR (B[0] < B[1] AND U[0] > B[0]))",
    "-100",
)
_EVENING = f"B[2] > Long[2] AND W[2] AND {{mid}} AND {UP21} AND NOT W[0] AND C[0] < C[2] - B[2] * 0.3"
_MORNING = f"B[2] > Long[2] AND NOT W[2] AND {{mid}} AND {DOWN21} AND W[0] AND C[0] > C[2] + B[2] * 0.3"
_add("CDLEVENINGDOJISTAR", 12, _EVENING.format(mid="B[1] <= Doji[1]"), "-100")
_add("CDLEVENINGSTAR", 12, _EVENING.format(mid="B[1] <= Short[1] AND B[0] > Short[0]"), "-100")
_add("CDLMORNINGDOJISTAR", 12, _MORNING.format(mid="B[1] <= Doji[1]"), "100")
_add("CDLMORNINGSTAR", 12, _MORNING.format(mid="B[1] <= Short[1] AND B[0] > Short[0]"), "100")
_add("CDLGAPSIDESIDEWHITE", 7, f"W[1] AND W[0] AND (({UP21} AND M[0] > T[2]) OR ({DOWN21} AND T[0] < M[2])) AND B[0] BETWEEN B[1] - Near[1] AND B[1] + Near[1] AND O[0] BETWEEN O[1] - Equal[1] AND O[1] + Equal[1]", f"CASE WHEN {UP21} THEN 100 ELSE -100 END")
_add("CDLIDENTICAL3CROWS", 12, "NOT W[2] AND NOT W[1] AND NOT W[0] AND D[2] < Tiny[2] AND D[1] < Tiny[1] AND D[0] < Tiny[0] AND C[2] > C[1] AND C[1] > C[0] AND O[1] BETWEEN C[2] - Equal[2] AND C[2] + Equal[2] AND O[0] BETWEEN C[1] - Equal[1] AND C[1] + Equal[1]", "-100")
_add("CDLSTALLEDPATTERN", 12, "W[2] AND W[1] AND W[0] AND C[0] > C[1] AND C[1] > C[2] AND B[2] > Long[2] AND B[1] > Long[1] AND U[1] < Tiny[1] AND O[1] > O[2] AND O[1] <= C[2] + Near[2] AND B[0] < Short[0] AND O[0] >= C[1] - B[0] - Near[1]", "-100")
_add("CDLSTICKSANDWICH", 7, "NOT W[2] AND W[1] AND NOT W[0] AND L[1] > C[2] AND C[0] BETWEEN C[2] - Equal[2] AND C[2] + Equal[2]", "100")
_add("CDLTASUKIGAP", 7, f"W[0] <> W[1] AND O[0] < T[1] AND O[0] > M[1] AND abs(B[1] - B[0]) < Near[1] AND CASE WHEN W[1] THEN {UP21} AND C[0] < O[1] AND C[0] > T[2] ELSE {DOWN21} AND C[0] > O[1] AND C[0] < M[2] END", SIGN1)
_add("CDLTRISTAR", 12, f"greatest(B[0], B[1], B[2]) <= Doji[2] AND (({UP21} AND T[0] < T[1]) OR ({DOWN21} AND M[0] > M[1]))", f"CASE WHEN {UP21} THEN -100 ELSE 100 END")
_add("CDLUNIQUE3RIVER", 12, "B[2] > Long[2] AND NOT W[2] AND NOT W[1] AND C[1] > C[2] AND O[1] <= O[2] AND L[1] < L[2] AND B[0] < Short[0] AND W[0] AND O[0] > L[1]", "100")
_add("CDLUPSIDEGAP2CROWS", 12, f"W[2] AND B[2] > Long[2] AND NOT W[1] AND B[1] <= Short[1] AND {UP21} AND NOT W[0] AND O[0] > O[1] AND C[0] < C[1] AND C[0] > C[2]", "-100")
_add("CDLXSIDEGAP3METHODS", 2, f"W[2] = W[1] AND W[1] <> W[0] AND O[0] < T[1] AND O[0] > M[1] AND C[0] < T[2] AND C[0] > M[2] AND CASE WHEN W[2] THEN {UP21} ELSE {DOWN21} END", SIGN2)
_add("CDL3BLACKCROWS", 13, "W[3] AND NOT W[2] AND NOT W[1] AND NOT W[0] AND D[2] < Tiny[2] AND D[1] < Tiny[1] AND D[0] < Tiny[0] AND O[1] < O[2] AND O[1] > C[2] AND O[0] < O[1] AND O[0] > C[1] AND H[3] > C[2] AND C[2] > C[1] AND C[1] > C[0]", "-100")
_add(
    "CDL3LINESTRIKE",
    8,
    "W[3] = W[2] AND W[2] = W[1] AND W[0] <> W[1] AND O[2] BETWEEN M[3] - Near[3] AND T[3] + Near[3] AND O[1] BETWEEN M[2] - Near[2] AND T[2] + Near[2] AND "
    "CASE WHEN W[1] THEN C[1] > C[2] AND C[2] > C[3] AND O[0] > C[1] AND C[0] < O[3] ELSE C[1] < C[2] AND C[2] < C[3] AND O[0] < C[1] AND C[0] > O[3] END",
    SIGN1,
)
_add("CDLCONCEALBABYSWALL", 13, f"NOT W[3] AND NOT W[2] AND NOT W[1] AND NOT W[0] AND greatest(U[3], D[3]) < Tiny[3] AND greatest(U[2], D[2]) < Tiny[2] AND {DOWN21} AND U[1] > Tiny[1] AND H[1] > C[2] AND H[0] > H[1] AND L[0] < L[1]", "100")
_add(
    "CDLBREAKAWAY",
    14,
    "B[4] > Long[4] AND W[4] = W[3] AND W[3] = W[1] AND W[1] <> W[0] AND "
    "CASE WHEN W[4] THEN M[3] > T[4] AND H[2] > H[3] AND L[2] > L[3] AND H[1] > H[2] AND L[1] > L[2] AND C[0] < O[3] AND C[0] > C[4] ELSE T[3] < M[4] AND H[2] < H[3] AND L[2] < L[3] AND H[1] < H[2] AND L[1] < L[2] AND C[0] > O[3] AND C[0] < C[4] END",
    SIGN0,
)
_add("CDLLADDERBOTTOM", 14, "NOT W[4] AND NOT W[3] AND NOT W[2] AND NOT W[1] AND O[4] > O[3] AND O[3] > O[2] AND C[4] > C[3] AND C[3] > C[2] AND U[1] > Tiny[1] AND W[0] AND O[0] > O[1] AND C[0] > H[1]", "100")
_add("CDLMATHOLD", 14, "B[4] > Long[4] AND B[3] < Short[3] AND B[2] < Short[2] AND B[1] < Short[1] AND W[4] AND NOT W[3] AND W[0] AND M[3] > T[4] AND greatest(M[2], M[1]) < C[4] AND least(M[2], M[1]) > C[4] - B[4] * 0.5 AND T[2] < O[3] AND T[1] < T[2] AND O[0] > C[1] AND C[0] > greatest(H[1], H[2], H[3])", "100")
_IN = " AND ".join(f"M[{k}] < H[4] AND T[{k}] > L[4] AND B[{k}] < Short[{k}] AND W[{k}] <> W[4]" for k in (1, 2, 3))
_add("CDLRISEFALL3METHODS", 14, f"B[4] > Long[4] AND B[0] > Long[0] AND W[0] = W[4] AND {_IN} AND CASE WHEN W[4] THEN C[2] < C[3] AND C[1] < C[2] AND O[0] > C[1] AND C[0] > C[4] ELSE C[2] > C[3] AND C[1] > C[2] AND O[0] < C[1] AND C[0] < C[4] END", SIGN0)

_PARTS = {"O": "o", "H": "h", "L": "l", "C": "c", "B": "bo", "R": "ra", "U": "us", "D": "lw", "T": "tp", "M": "bt", "W": "wh"}


def _spelled(text: str) -> str:
    def one(m: re.Match) -> str:
        word, back = m[1], int(m[2])
        if word in _PARTS:
            return f"{_PARTS[word]}s[{back + 1}]"
        what, bars, factor = _SETTINGS[word]
        return f"({factor} * list_avg({what}s[{back + 2}:{back + 1 + bars}]))"

    return re.sub(r"\b([A-Z][a-z]*)\[(\d)\]", one, text)


def with_lists(source: str = "b") -> str:
    """CTEs: each bar's own parts, then lists of them over it and the 14 bars before, newest first."""
    columns = ", ".join(f"list({c}) OVER v AS {c}s" for c in (*_PARTS.values(), "sh"))
    return f"""parts AS (SELECT symbol, datetime, rn, open AS o, high AS h, low AS l, close AS c, abs(close - open) AS bo, high - low AS ra, high - greatest(open, close) AS us, least(open, close) - low AS lw,
        greatest(open, close) AS tp, least(open, close) AS bt, close >= open AS wh, high - low - abs(close - open) AS sh FROM {source}),
        turned AS (SELECT symbol, datetime, rn, {columns} FROM parts WINDOW v AS (PARTITION BY symbol ORDER BY datetime ROWS 14 PRECEDING)),
        newest AS (SELECT symbol, datetime, rn, {', '.join(f'list_reverse({c}s) AS {c}s' for c in (*_PARTS.values(), 'sh'))} FROM turned)"""


def pattern(name: str) -> str:
    first, when, value = _P[name]
    return f"CASE WHEN rn > {first} AND {_spelled(when)} THEN {_spelled(value)} ELSE 0 END"


def select(names: list[str], bars: str) -> str:
    return f"WITH {bars}, {with_lists()} SELECT symbol, datetime, {', '.join(f'CAST({pattern(n)} AS INTEGER) AS {n}' for n in names)} FROM newest"


#: The two traps: (bars before the first result, first bar where one can be, bullish, bearish).
_TRAPS = {
    "CDLHIKKAKE": (5, 2, "H[1] < H[2] AND L[1] > L[2] AND H[0] < H[1] AND L[0] < L[1]", "H[1] < H[2] AND L[1] > L[2] AND H[0] > H[1] AND L[0] > L[1]"),
    "CDLHIKKAKEMOD": (
        10,
        7,
        "H[2] < H[3] AND L[2] > L[3] AND H[1] < H[2] AND L[1] > L[2] AND H[0] < H[1] AND L[0] < L[1] AND C[2] <= L[2] + Near[2]",
        "H[2] < H[3] AND L[2] > L[3] AND H[1] < H[2] AND L[1] > L[2] AND H[0] > H[1] AND L[0] > L[1] AND C[2] >= H[2] - Near[2]",
    ),
}


def traps(names: list[str], bars: str) -> str:
    """A state is carried from bar to bar: the open trap, its age and the inside bar's high and low."""
    ctes, joins, shown = [], [], []
    for n in names:
        first, start, bull, bear = _TRAPS[n]
        raw, run = f"raw_{n}", f"run_{n}"
        ctes.append(f"{raw} AS (SELECT symbol, rn, cs[1] AS c, hs[2] AS ih, ls[2] AS il, CASE WHEN rn <= {start} THEN 0 WHEN {_spelled(bull)} THEN 100 WHEN {_spelled(bear)} THEN -100 ELSE 0 END AS x FROM newest)")
        ctes.append(
            f"""{run} AS (SELECT symbol, rn, x AS out, x AS trap, 0 AS age, ih, il FROM {raw} WHERE rn = 1
            UNION ALL SELECT n.symbol, n.rn, CASE WHEN n.x <> 0 THEN n.x WHEN e.trap <> 0 AND e.age < 3 AND (e.trap > 0 AND n.c > e.ih OR e.trap < 0 AND n.c < e.il) THEN 2 * e.trap ELSE 0 END,
                CASE WHEN n.x <> 0 THEN n.x WHEN e.trap <> 0 AND e.age < 3 AND (e.trap > 0 AND n.c > e.ih OR e.trap < 0 AND n.c < e.il) THEN 0 ELSE e.trap END,
                CASE WHEN n.x <> 0 THEN 0 ELSE e.age + 1 END, CASE WHEN n.x <> 0 THEN n.ih ELSE e.ih END, CASE WHEN n.x <> 0 THEN n.il ELSE e.il END
            FROM {run} e JOIN {raw} n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""
        )
        joins.append(f"JOIN {run} ON {run}.symbol = newest.symbol AND {run}.rn = newest.rn")
        shown.append(f"CAST(CASE WHEN newest.rn > {first} THEN {run}.out ELSE 0 END AS INTEGER) AS {n}")
    return f"WITH RECURSIVE {bars}, {with_lists()}, {', '.join(ctes)} SELECT newest.symbol, newest.datetime, {', '.join(shown)} FROM newest {' '.join(joins)}"
