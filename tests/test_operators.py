"""Small fixtures and invariants of bars, indicators, signals, backtest, text and streams."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(42)
    close = 100 + np.cumsum(r.normal(0, 0.5, 300))
    rows = [("a", START + dt.timedelta(hours=k), float(c + r.normal(0, 0.1)), float(c + abs(r.normal(0, 0.3))), float(c - abs(r.normal(0, 0.3))), float(c), float(r.integers(1000, 9999))) for k, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double").persist()


def test_resample_composes(spark):
    from barflow.operators.bars import resample

    rows = [("a", START + dt.timedelta(minutes=k), *[float(k % 17)] * 4, 1.0) for k in range(7, 400)]
    minutes = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
    hours = resample(minutes, "1h").orderBy("datetime").collect()
    assert hours[0].datetime == START + dt.timedelta(hours=1) and hours[0].volume == 60
    assert resample(resample(minutes, "15m"), "1h").orderBy("datetime").collect() == hours


def test_clean_fills(spark):
    from barflow.operators.bars import clean

    rows = [("a", START, "1", "1", "1", "1", "x"), ("a", START + dt.timedelta(minutes=3), "2", "2", "2", "2", "5"), ("a", START + dt.timedelta(minutes=3), "2", "2", "2", "2", "5")]
    got = clean(spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open string, high string, low string, close string, volume string")).orderBy("datetime").collect()
    assert [r.close for r in got] == [1, 1, 1, 2] and [r.volume for r in got] == [5, 5, 5, 5]
    with pytest.raises(ValueError):
        clean(spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open string, high string, low string, close string, volume string"), "7m")


def test_indicator_ranges(bars):
    from barflow.operators.indicators import INDICATORS, add_indicators

    df = add_indicators(bars, list(INDICATORS)).toPandas()
    for name, low, high in (("rsi", 0, 100), ("willr", -100, 0), ("aroon_up", 0, 100), ("mfi", 0, 100), ("stoch_k", 0, 100), ("adx", 0, 100)):
        x = df[name].dropna().astype(float)
        assert len(x) > 200 and x.min() >= low - 1e-9 and x.max() <= high + 1e-9
    assert (df["atr"].dropna() >= 0).all() and (df["bb_lower"].dropna() <= df["bb_upper"].dropna()).all()
    assert df["sma"].notna().sum() == 271 and df["macd"].notna().sum() == 267 and df["t3"].notna().sum() == 300 - 24


def test_no_look_ahead(bars):
    from barflow.operators.indicators import INDICATORS
    from barflow.operators.signals import signals

    names = [n for n, i in INDICATORS.items() if i.rule not in ("mean_cross", "none")]
    cut = START + dt.timedelta(hours=200)
    whole = signals(bars, names).filter(F.col("datetime") < cut).orderBy("datetime").collect()
    assert signals(bars.filter(F.col("datetime") < cut), names).orderBy("datetime").collect() == whole


def test_unknown_names(bars):
    from barflow.operators.candles import NAMES, add_patterns
    from barflow.operators.indicators import add_indicators, resolve

    assert len(NAMES) == 61
    with pytest.raises(ValueError):
        add_indicators(bars, ["NOPE"])
    with pytest.raises(ValueError):
        add_patterns(bars, ["CDLNOPE"])
    assert resolve("SMA", {"SMA": {"period": 7.0}}) == {"timeperiod": 7} and resolve("SMA", {"x": 3}) == {"timeperiod": 30}


def test_vote_is_antisymmetric(spark):
    from barflow.operators.signals import vote

    rows = [("a", START + dt.timedelta(hours=k), *s) for k, s in enumerate([(None, 1), (1, 1), (1, -1), (-1, -1), (0, 1), (1, 1)])]
    df = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, sig_x tinyint, sig_y tinyint")
    flip = df.withColumns({c: (-F.col(c)).cast("tinyint") for c in ("sig_x", "sig_y")})
    a, b = ([r.signals for r in vote(x).orderBy("datetime").collect()] for x in (df, flip))
    assert a == [1, 0, -1] and b == [-1, 0, 1]


def test_backtest_cases(spark):
    from barflow.operators.backtest import Rules, backtest

    bars = [("a", START + dt.timedelta(minutes=k), o, h, lo, c) for k, (o, h, lo, c) in enumerate([(100, 100.5, 99.5, 100), (100, 103, 97, 100), (100, 100.2, 99.8, 100), (100, 100.2, 99.8, 101.0)])]
    b = spark.createDataFrame([(s, t, *map(float, x)) for s, t, *x in bars], "symbol string, datetime timestamp_ntz, open double, high double, low double, close double")
    s = spark.createDataFrame([("s", "a", START, 1), ("s", "a", START + dt.timedelta(minutes=2), -1), ("s", "a", START + dt.timedelta(minutes=3), 0)], "strategy string, symbol string, datetime timestamp_ntz, signals int")
    got = backtest(s, b, Rules(take_profit=2, stop_loss=2, fee=0)).orderBy("event").collect()
    assert [r.action for r in got] == ["buy", "sell - take_profit", "buy", "sell - end_of_backtest"]
    assert math.isclose(got[1].sell_price, 102) and got[3].predicted_direction == "short" and got[3].pnl == -1.0
    assert backtest(s.withColumn("signals", F.lit(0)), b).count() == 0


def test_text_rules(spark):
    from barflow.functions.text import expand_prices
    from barflow.operators.posts import clean_text, near_dedup, simhash

    rows = [("[deleted]", ""), (None, ""), ("I am a bot, please contact the moderators", ""), ("go &lt;b&gt; &amp;lt; &zzz; x", "go &lt; x"), ("see https://a.b/c now", "see [URL] now"), ("**bold** and ~~gone~~", "bold and gone"), ("$BTC to the moooooooon", "BTC to the moooon"), ("lol", ""), ("LOL", "LOL"), ("lol!!!", "lol!!!")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "id int, text string")
    assert [r.clean for r in clean_text(df, "text").orderBy("id").collect()] == [c for _, c in rows]
    prices = spark.createDataFrame([("pay 50k or 2.5M now",)], "text string")
    assert prices.select(expand_prices(F.col("text")).alias("x")).first().x == "pay 50000 or 2500000 now"
    assert clean_text(prices, "text", prices=True).first().clean == "pay 50000 or 250000 now"  # runs of one character shrink to four after it
    same = spark.createDataFrame([(1, "one two three four"), (2, "one two three four"), (3, "nothing like it at all here")], "id long, text string")
    assert sorted(r.id for r in near_dedup(simhash(same, "text"), "id").collect()) == [1, 3]


def test_near_dedup_is_greedy(spark):
    from barflow.operators.posts import near_dedup

    df = spark.createDataFrame([(1, 0b0), (2, 0b111), (3, 0b111111), (4, 0b1111111111)], "id long, simhash long")
    assert sorted(r.id for r in near_dedup(df, "id").collect()) == [1, 3, 4]


def test_stream_equals_batch(spark, tmp_path):
    from barflow.operators.bars import resample
    from barflow.streaming.live import stream_bars

    rows = [("a", START + dt.timedelta(minutes=k), k, *[float(k)] * 4, 1.0) for k in range(0, 300)]
    shape = "symbol string, datetime timestamp_ntz, n long, open double, high double, low double, close double, volume double"
    ticks = spark.createDataFrame(rows, shape)
    ticks.withColumn("datetime", F.col("datetime").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = stream_bars(live, "1h", ties=("n",)).writeStream.format("memory").queryName("live_bars").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.datetime: (r.open, r.high, r.close, r.volume) for r in spark.table("live_bars").collect()}
    want = {r.datetime: (r.open, r.high, r.close, r.volume) for r in resample(ticks, "1h", ties=("n",)).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_position_machine():
    from barflow.streaming.live import wanted_position

    assert wanted_position(0, 1) == (1, "open") and wanted_position(1, 1) == (1, "hold") and wanted_position(1, -1) == (-1, "reverse") and wanted_position(1, 0) == (1, "hold")


def test_append(spark, tmp_path):
    from barflow.sources.tables import append, last_time

    df = spark.createDataFrame([(1, START), (2, START + dt.timedelta(hours=1))], "id long, datetime timestamp_ntz")
    path = str(tmp_path / "t")
    assert append(df.limit(1), path) == 1 and append(df, path) == 1 and append(df, path) == 0
    assert last_time(spark, path) == START + dt.timedelta(hours=1) and last_time(spark, str(tmp_path / "none")) is None


def test_near_dedup_long_chain(spark):
    """A chain that takes more than 50 rounds is decided to its end."""
    from barflow.operators.posts import near_dedup

    r, chain = random.Random(2), [0]
    while len(chain) < 106:
        new = chain[-1]
        for bit in r.sample(range(63), 3):
            new ^= 1 << bit
        if all((new ^ x).bit_count() > 3 for x in chain[:-1]):
            chain.append(new)
    df = spark.createDataFrame(list(enumerate(chain)), "id long, simhash long").coalesce(1)
    assert sorted(x.id for x in near_dedup(df, "id").collect()) == list(range(0, 106, 2))


def test_exact_rounding(spark):
    """As Python rounds: 17 of 800 letters are 0.02125, whose double lies above that half."""
    from barflow.functions.rounding import round_exact

    rows = [(a, b) for b in (3, 16, 32, 800, 1600, 20000, 4096, 10000) for a in range(0, min(b, 900) + 1)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = df.select("a", "b", round_exact(F.col("a") / F.col("b"), 4).alias("x")).collect()
    assert [(r.a, r.b) for r in got if r.x != round(r.a / r.b, 4)] == []


def test_coins(spark):
    from barflow.operators.posts import COINS, coin_filter, coin_mentions

    assert len(COINS) == 10
    rows = [(1, "she sat down", "news"), (2, "binance  coin", "x"), (3, None, "SatoshiStreetBets"), (4, "AVALANCHE", "y"), (5, "$btc", "Memes"), (6, "linked", None), (7, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, subreddit string")
    assert {(r.coin, r.id) for r in coin_mentions(df, "title", blocked=("memes",)).collect()} == {("bnb", 2), ("btc", 3), ("avax", 4)}
    assert [r.id for r in coin_filter(df, "BTC", "title").orderBy("id").collect()] == [3, 5]


def test_vector_autoregression(bars):
    from barflow.operators.predict import vector_autoregression

    x = np.array([(r.close, r.volume) for r in bars.orderBy("datetime").collect()])
    a = np.column_stack([np.ones(len(x) - 2), x[1:-1], x[:-2]])
    beta = np.linalg.lstsq(a, x[2:], rcond=None)[0]
    one = np.concatenate([[1.0], x[-1], x[-2]]) @ beta
    two = np.concatenate([[1.0], one, x[-1]]) @ beta
    got = vector_autoregression(bars, ["close", "volume"], 2, 2).orderBy("step").collect()
    assert np.allclose([(r.close, r.volume) for r in got], [one, two])


def test_profit_of_variants(bars):
    """Shuffling what the signals come from costs profit, what they do not come from costs none; the search finds the side that wins."""
    from barflow.operators.backtest import Rules, shuffled
    from barflow.operators.features import next_bar_targets
    from barflow.operators.tuning import grid, pnl_importance, search

    rows = next_bar_targets(bars).select("symbol", "datetime", F.col("target_return").alias("x"), F.col("volume").alias("noise"))
    rules = Rules(take_profit=50.0, stop_loss=50.0, fee=0.0)
    predict = lambda df: df.withColumn("signals", F.when(F.col("x") > 0, 1).otherwise(-1))
    got = pnl_importance(rows, ["x", "noise"], predict, bars, rules=rules).collect()
    assert [r.feature for r in got] == ["x"] and got[0].pnl_drop > 10
    again = shuffled(rows, ["x"], 1).toPandas()
    assert sorted(again["x"]) == sorted(rows.toPandas()["x"]) and not np.array_equal(again.sort_values("datetime")["x"], rows.toPandas().sort_values("datetime")["x"])
    trials = grid(bars.sparkSession, side=[-1.0, 1.0])
    made = lambda t: rows.join(F.broadcast(t), F.lit(True)).select("trial", "symbol", "datetime", F.when(F.col("x") * F.col("side") > 0, 1).otherwise(-1).alias("signals"))
    found = {r.trial: r for r in search(trials, made, bars, rules=rules).collect()}
    assert found[1]["rank"] == 1 and found[0].pruned and found[1].pnl > 0 > found[0].pnl


def test_models_are_kept(spark, bars, tmp_path):
    """A booster learns what a line tells, and is the same after it was saved."""
    from barflow.operators.predict import load_model, save_model, trainer

    rows = bars.select("datetime", "close", (F.col("close") * 2 + 1).alias("y"))
    model = trainer("gbt_regressor", ["close"], "y", maxIter=10, maxDepth=4).fit(rows)
    save_model(model, str(tmp_path / "m"))
    a, b = (m.transform(rows).select("datetime", "y", "prediction").orderBy("datetime").collect() for m in (model, load_model(str(tmp_path / "m"))))
    assert a == b and np.mean([abs(r.y - r.prediction) for r in a]) < 0.2 * np.std([r.y for r in a])


def test_pages_stop():
    """Pages meet without a gap or a repeat; an empty page and one without progress end the paging."""
    from barflow.sources.exchanges import pages, rule_client, to_millis

    whole = list(pages(rule_client, "binance", "AB", "1m", 30_000, 600_000, 10_000))
    assert whole == list(pages(rule_client, "binance", "AB", "1m", 30_000, 600_000, 3)) and len(whole) == 10
    assert list(pages(lambda *a: [], "binance", "AB", "1m", 0, 10**9, 5)) == []
    seconds = lambda s, i, a, e, n: [(t, "1") for t in range(-(-a // 60_000) * 60, e // 1000 + 1, 60)][:n]
    assert [r[0] for r in pages(seconds, "kraken", "AB", "1m", 0, 300_000, 2)] == [0, 60, 120, 180, 240, 300]
    assert to_millis("1970-01-02") == 86_400_000 == to_millis("1970-01-02 00:00:00") and to_millis("now", START.replace(tzinfo=dt.timezone.utc)) == int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_tables(spark, tmp_path):
    from barflow.sources import tables as D

    D.create_schema(spark, "shelf")
    spark.range(3).write.mode("overwrite").saveAsTable("shelf.t")
    assert spark.table("shelf.t").count() == 3
    D.drop_schema(spark, "shelf")
    assert "shelf" not in [r.namespace for r in spark.sql("SHOW SCHEMAS").collect()]
    df = spark.createDataFrame([(1, "a,b", None), (2, 'say "x"', 2.5)], "id int, s string, x double")
    D.write_csv(df, str(tmp_path / "c"))
    assert sorted(D.read(spark, str(tmp_path / "c"), "csv", "id int, s string, x double", header=True).collect()) == sorted(df.collect())
    old = spark.createDataFrame([(1, "a")], "id int, gone string")
    assert D.with_columns_of(df, old).columns == ["id", "gone", "s", "x"]
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id int, v string")
    assert D.append(twice, str(tmp_path / "k"), keys=("id",)) == 2 and sorted(r.v for r in spark.read.parquet(str(tmp_path / "k")).collect()) == ["a", "c"]


def test_replaced_partitions(spark, tmp_path):
    """Keys stay unique over writes, untouched partitions are not written again, columns may come."""
    import os

    from barflow.sources import tables as D

    path, files = str(tmp_path / "t"), lambda day: sorted(os.listdir(tmp_path / "t" / f"day={day}"))
    D.replace_partitions(spark.createDataFrame([(1, 10, "a", 1), (1, 10, "b", 2), (2, 20, "c", 1), (3, 30, "d", 1)], "day int, id int, v string, at int"), path, ("day",), ("id",), "at")
    read = lambda: sorted((r.day, r.id, r.v) for r in spark.read.option("mergeSchema", "true").parquet(path).collect())
    assert read() == [(1, 10, "b"), (2, 20, "c"), (3, 30, "d")]
    before = files(2)
    D.replace_partitions(spark.createDataFrame([(1, 10, "new", 9, 1.5), (1, 11, "e", 1, 2.5), (4, 40, "f", 1, 3.5)], "day int, id int, v string, at int, more double"), path, ("day",), ("id",), "at")
    assert read() == [(1, 10, "new"), (1, 11, "e"), (2, 20, "c"), (3, 30, "d"), (4, 40, "f")] and files(2) == before
    D.replace_partitions(spark.createDataFrame([(3, 31, "g", 1)], "day int, id int, v string, at int"), path, ("day",))
    assert (3, 30, "d") not in read() and (3, 31, "g") in read()


def test_unique_append(spark, tmp_path):
    from barflow.sources import tables as D

    path, rows = str(tmp_path / "u"), lambda x: spark.createDataFrame(x, "id int, v string")
    assert D.unique_append(rows([(1, "a"), (1, "a"), (2, "b")]), path, ("id",)) == 2
    with pytest.raises(ValueError, match="1 keys"):
        D.unique_append(rows([(3, "a"), (3, "b"), (4, "c")]), path, ("id",))
    assert D.unique_append(rows([(2, "z"), (5, "e")]), path, ("id",)) == 1
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (5, "e")]


def test_failing_signals_are_told(spark):
    from barflow.operators.signals import run_vote, run_vote_reporting, working

    rows = [("s", START + dt.timedelta(hours=k), float(k % 7)) for k in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, close double")
    good, bad = working(bars, ["ROC", "NOPE", "WILLR", "CDLDOJI"])
    assert good == ["ROC"] and set(bad) == {"NOPE", "WILLR", "CDLDOJI"} and all(bad.values())
    voted, why = run_vote_reporting(bars, ["ROC", "WILLR"])
    assert set(why) == {"WILLR"} and sorted(voted.collect()) == sorted(run_vote(bars, ["ROC"]).collect())
    with pytest.raises(ValueError, match="no signal works"):
        run_vote_reporting(bars, ["NOPE"])


def test_what_is_never_differenced(spark):
    from barflow.operators.predict import make_stationary, may_wander

    assert may_wander(["close", "RSI_14", "rsi", "CDLDOJI", "cdlharami", "target", "ema_30", "BOP"]) == ["close", "ema_30"]
    walk = np.cumsum(np.random.default_rng(1).normal(size=300)).tolist()
    rows = [("s", START + dt.timedelta(hours=k), x, x) for k, x in enumerate(walk)]
    got = make_stationary(spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, x double, rsi double"), ["x", "rsi"]).orderBy("datetime").collect()
    assert [r.rsi for r in got] == walk[1:] and [r.x for r in got] == pytest.approx(np.diff(walk).tolist())


def test_places_without_a_large_task(spark):
    from barflow.operators.lookups import numbered

    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k) for k in rng.sample(range(10_000), 3000)]
    got = numbered(spark.createDataFrame(rows, "g string, k long").repartition(7), "g", ("k",), "place")
    assert got.columns == ["g", "k", "place"]
    by = {}
    for g, k in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append(k)
    assert {(r.g, r.k, r.place) for r in got.collect()} == {(g, k, n) for g, own in by.items() for n, k in enumerate(own, 1)}
    assert numbered(got.limit(0).drop("place"), "g", ("k",), "place").count() == 0
