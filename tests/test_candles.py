"""Hand-made bars for every candlestick pattern, told by the engine and by the independent SQL."""

import datetime as dt

import duckdb
import pytest

# (open, high, low, close) after 15 equal white bars of body 1 and shadows of a half, and what the last bar gives.
BARS = {
    "CDLDOJI": (100, [(100, 101, 99, 100.05)]),
    "CDLDRAGONFLYDOJI": (100, [(100, 100.1, 98, 100.05)]),
    "CDLGRAVESTONEDOJI": (100, [(100, 102, 99.95, 100.05)]),
    "CDLLONGLEGGEDDOJI": (100, [(100, 101, 99, 100.05)]),
    "CDLRICKSHAWMAN": (100, [(100, 101, 99, 100.05)]),
    "CDLTAKURI": (100, [(100, 100.1, 98, 100.05)]),
    "CDLBELTHOLD": (100, [(100, 102.5, 99.9, 102)]),
    "CDLCLOSINGMARUBOZU": (100, [(100, 102.1, 99, 102)]),
    "CDLMARUBOZU": (100, [(100, 102.1, 99.9, 102)]),
    "CDLLONGLINE": (100, [(100, 102.3, 99.7, 102)]),
    "CDLSHORTLINE": (100, [(100, 100.8, 99.7, 100.5)]),
    "CDLSPINNINGTOP": (100, [(100, 101.5, 99, 100.5)]),
    "CDLHIGHWAVE": (100, [(100, 102, 98.5, 100.5)]),
    "CDLHAMMER": (100, [(99.5, 99.85, 98.5, 99.8)]),
    "CDLHANGINGMAN": (-100, [(101.2, 101.55, 100, 101.5)]),
    "CDLINVERTEDHAMMER": (100, [(99.5, 101, 99.45, 99.8)]),
    "CDLSHOOTINGSTAR": (-100, [(101.3, 102.5, 101.25, 101.6)]),
    "CDLCOUNTERATTACK": (100, [(103, 103.2, 99.8, 100), (97, 100.3, 96.8, 100.02)]),
    "CDLDARKCLOUDCOVER": (-100, [(100, 102.1, 99.9, 102), (102.5, 102.6, 100.4, 100.7)]),
    "CDLDOJISTAR": (-100, [(100, 102.1, 99.9, 102), (102.5, 103, 102, 102.55)]),
    "CDLENGULFING": (100, [(101, 101.5, 99.9, 100), (99.8, 101.8, 99.7, 101.5)]),
    "CDLHARAMI": (100, [(103, 103.2, 99.8, 100), (101, 102, 100.8, 101.5)]),
    "CDLHARAMICROSS": (100, [(103, 103.2, 99.8, 100), (101, 102, 100.5, 101.05)]),
    "CDLHOMINGPIGEON": (100, [(103, 103.2, 99.8, 100), (102, 102.2, 100.5, 101)]),
    "CDLINNECK": (-100, [(103, 103.2, 99.8, 100), (99.5, 100.2, 99, 100.05)]),
    "CDLONNECK": (-100, [(103, 103.2, 99.8, 100), (99.5, 99.9, 99, 99.85)]),
    "CDLTHRUSTING": (-100, [(103, 103.2, 99.8, 100), (99.5, 101.2, 99, 101)]),
    "CDLPIERCING": (100, [(103, 103.2, 99.8, 100), (99.5, 102.2, 99.3, 102)]),
    "CDLKICKING": (100, [(103, 103.1, 99.9, 100), (104, 107.1, 103.95, 107)]),
    "CDLKICKINGBYLENGTH": (-100, [(103, 103.1, 99.9, 100), (104, 106.05, 103.95, 106)]),
    "CDLMATCHINGLOW": (100, [(102, 102.2, 99.8, 100), (101, 101.3, 99.7, 100.05)]),
    "CDLSEPARATINGLINES": (100, [(102, 102.2, 99.8, 100), (102.05, 105.2, 102, 105)]),
    "CDL2CROWS": (-100, [(100, 102.2, 99.8, 102), (103.5, 103.7, 102.8, 103), (103.2, 103.3, 100.8, 101)]),
    "CDL3INSIDE": (100, [(103, 103.2, 99.8, 100), (101, 101.7, 100.8, 101.5), (101.5, 103.7, 101.3, 103.5)]),
    "CDL3OUTSIDE": (100, [(101, 101.2, 99.9, 100), (99.8, 101.7, 99.6, 101.5), (101.5, 102.5, 101.3, 102.2)]),
    "CDL3STARSINSOUTH": (100, [(105, 105.2, 98.5, 102), (103, 103.2, 99.5, 101), (100.5, 100.55, 99.95, 100)]),
    "CDL3WHITESOLDIERS": (100, [(100, 102.05, 99.8, 102), (101, 103.55, 100.8, 103.5), (102, 105.05, 101.8, 105)]),
    "CDLABANDONEDBABY": (100, [(105, 105.2, 101.8, 102), (101, 101.3, 100.8, 101.05), (102, 105.2, 101.6, 105)]),
    "CDLADVANCEBLOCK": (-100, [(100, 103.2, 99.8, 103), (102, 104, 101.8, 103.5), (103, 104.2, 102.8, 103.8)]),
    "CDLEVENINGDOJISTAR": (-100, [(100, 103.2, 99.8, 103), (104, 104.3, 103.7, 104.05), (103.5, 103.7, 100.8, 101)]),
    "CDLEVENINGSTAR": (-100, [(100, 103.2, 99.8, 103), (104, 104.7, 103.7, 104.4), (103.5, 103.7, 100.8, 101)]),
    "CDLMORNINGDOJISTAR": (100, [(105, 105.2, 101.8, 102), (101, 101.3, 100.7, 101.05), (101.5, 104.2, 101.3, 104)]),
    "CDLMORNINGSTAR": (100, [(105, 105.2, 101.8, 102), (101, 101.7, 100.5, 101.4), (101.5, 104.2, 101.3, 104)]),
    "CDLGAPSIDESIDEWHITE": (100, [(100, 101.5, 99.5, 101), (102, 103.5, 101.8, 103), (102.05, 103.4, 101.9, 103.1)]),
    "CDLIDENTICAL3CROWS": (-100, [(110, 110.2, 107.95, 108), (108.05, 108.2, 105.95, 106), (106.02, 106.2, 103.95, 104)]),
    "CDLSTALLEDPATTERN": (-100, [(100, 102.2, 99.8, 102), (101.5, 104.55, 101.3, 104.5), (104.5, 105, 104.3, 104.9)]),
    "CDLSTICKSANDWICH": (100, [(102, 102.2, 99.8, 100), (101, 103.2, 100.5, 103), (103, 103.2, 99.9, 100.05)]),
    "CDLTASUKIGAP": (100, [(100, 101.2, 99.8, 101), (102, 103.2, 101.8, 103), (102.5, 102.7, 101.3, 101.5)]),
    "CDLTRISTAR": (-100, [(100, 100.5, 99.5, 100.05), (101, 101.5, 100.5, 101.05), (100.5, 101, 100, 100.55)]),
    "CDLUNIQUE3RIVER": (100, [(105, 105.2, 101.8, 102), (104, 104.2, 101, 103), (101.5, 102.3, 101.3, 102)]),
    "CDLUPSIDEGAP2CROWS": (-100, [(100, 102.2, 99.8, 102), (103.5, 103.7, 102.8, 103), (104, 104.2, 102.3, 102.5)]),
    "CDLXSIDEGAP3METHODS": (100, [(100, 101.2, 99.8, 101), (102, 103.2, 101.8, 103), (102.5, 102.7, 100.3, 100.5)]),
    "CDL3BLACKCROWS": (-100, [(108, 110.5, 107.8, 110), (110, 110.1, 107.95, 108), (109, 109.1, 105.95, 106), (107, 107.1, 103.95, 104)]),
    "CDL3LINESTRIKE": (100, [(100, 102.2, 99.8, 102), (101, 103.2, 100.8, 103), (102, 104.2, 101.8, 104), (104.5, 104.7, 98.8, 99)]),
    "CDLCONCEALBABYSWALL": (100, [(110, 110.05, 106.95, 107), (107, 107.05, 103.95, 104), (103, 104.5, 101.9, 102), (104.6, 104.7, 101.5, 101.8)]),
    "CDLBREAKAWAY": (100, [(110, 110.2, 106.8, 107), (106, 106.2, 104.8, 105), (105, 105.5, 103.8, 104.5), (104, 104.2, 102.5, 103), (103, 106.8, 102.8, 106.5)]),
    "CDLLADDERBOTTOM": (100, [(110, 110.2, 108.8, 109), (109, 109.2, 107.3, 107.5), (108, 108.2, 105.8, 106), (106, 107, 104.8, 105), (106.5, 108.2, 106.3, 108)]),
    "CDLMATHOLD": (100, [(100, 104.2, 99.8, 104), (105, 105.2, 104.3, 104.5), (104.3, 104.5, 103.4, 103.6), (103.8, 104, 102.8, 103), (103.5, 106.2, 103.3, 106)]),
    "CDLRISEFALL3METHODS": (100, [(100, 105.2, 99.8, 105), (104.5, 104.7, 103.7, 103.9), (103.8, 104, 103.1, 103.3), (103.2, 103.4, 102.5, 102.7), (103, 106.2, 102.8, 106)]),
    "CDLHIKKAKE": (200, [(100.2, 101, 99.8, 100.8), (100, 100.5, 99.3, 99.6), (100, 101.6, 99.9, 101.4)]),
    "CDLHIKKAKEMOD": (100, [(100.5, 101.2, 99.8, 99.9), (100.2, 101, 99.9, 100.5), (100.2, 100.8, 99.5, 99.7)]),
}
#: Those that hold upside down as well, with the other sign.
BOTH = """CDLBELTHOLD CDLCLOSINGMARUBOZU CDLMARUBOZU CDLLONGLINE CDLSHORTLINE CDLSPINNINGTOP CDLHIGHWAVE CDLCOUNTERATTACK CDLDOJISTAR CDLENGULFING CDLHARAMI CDLHARAMICROSS CDLKICKING
    CDLKICKINGBYLENGTH CDLSEPARATINGLINES CDL3INSIDE CDL3OUTSIDE CDLABANDONEDBABY CDLBREAKAWAY CDLTASUKIGAP CDLTRISTAR CDLXSIDEGAP3METHODS CDL3LINESTRIKE CDLRISEFALL3METHODS CDLHIKKAKE CDLHIKKAKEMOD""".split()


@pytest.fixture(scope="module")
def told(spark):
    """(engine, SQL): by series and bar, all patterns' values."""
    from barflow.operators.candles import NAMES, add_patterns
    from barflow.plans import candle_sql

    start = dt.datetime(2024, 1, 1)
    rows = []
    for name, (_, own) in BARS.items():
        for side in ("up", "down") if name in BOTH else ("up",):
            series = [(100, 101.5, 99.5, 101)] * 15 + own
            for k, (o, h, lo, c) in enumerate(series):
                if side == "down":
                    o, h, lo, c = 200 - o, 200 - lo, 200 - h, 200 - c
                rows.append((f"{name}/{side}", start + dt.timedelta(hours=k), *map(float, (o, h, lo, c)), 1.0))
    df = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
    one = {(r.symbol, r.datetime): r.asDict() for r in add_patterns(df).collect()}
    hand = df.toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("hand", hand)
    b = "b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS rn FROM hand)"
    plain = [n for n in NAMES if n in candle_sql._P]
    two: dict = {}
    for sql in (candle_sql.select(plain, b), candle_sql.traps([n for n in NAMES if n not in plain], b)):
        found = con.sql(sql)
        for r in found.fetchall():
            two.setdefault(r[:2], {}).update(zip(found.columns[2:], r[2:], strict=True))
    return one, two, {name: start + dt.timedelta(hours=14 + len(own)) for name, (_, own) in BARS.items()}


def test_all_patterns_have_bars():
    from barflow.operators.candles import NAMES

    assert set(BARS) == set(NAMES)


@pytest.mark.parametrize("name", sorted(BARS))
def test_pattern(told, name):
    one, two, last = told
    want, _ = BARS[name]
    for rows in (one, two):
        assert rows[f"{name}/up", last[name]][name] == want
        if name in BOTH:
            assert rows[f"{name}/down", last[name]][name] == -want


def test_engine_equals_sql_on_every_bar(told):
    one, two, _ = told
    assert {k: {n: v[n] for n in BARS} for k, v in one.items()} == two
