"""One query an operator: each applies it to whole tables and rounds doubles to six digits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.rounding import round_exact
from barflow.functions.scratch import scratch_root, settle
from barflow.operators import backtest as B
from barflow.operators import bars as R
from barflow.operators import features as X
from barflow.operators import lookups as K
from barflow.operators import posts as T
from barflow.operators import predict as M
from barflow.operators import scan as SC
from barflow.operators import signals as S
from barflow.operators import tuning as U
from barflow.operators.backtest_fold import backtest_fold
from barflow.operators.candles import add_patterns
from barflow.operators.indicators import INDICATORS, add_indicators
from barflow.sources import exchanges as E
from barflow.sources import tables as D
from barflow.streaming import windows as W

TIES = ("event_id",)
Query = Callable[[SparkSession, str], DataFrame]


def r6(df: DataFrame) -> DataFrame:
    """Doubles at six digits, never a negative zero."""
    return df.select(*[(F.round(F.col(f"`{n}`"), 6) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return R.resample(D.ticks(spark, d), "1h", ties=TIES)


def daily(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as daily candles by return flag."""
    p = F.col("l_extendedprice").cast("double")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("datetime"), "l_orderkey", "l_linenumber", *[p.alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").cast("double").alias("volume")
    )
    return R.resample(rows, "1d", ties=("l_orderkey", "l_linenumber"))


def indicator(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return r6(add_indicators(hourly(spark, d), [name]).select("symbol", "datetime", *INDICATORS[name].outputs))

    return run


def candle(names: list[str]) -> Query:
    return lambda spark, d: add_patterns(hourly(spark, d), names).select("symbol", "datetime", *names)


def rule(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return S.signals(hourly(spark, d), [name]).select("symbol", "datetime", F.col(f"sig_{name}").cast("int").alias("signal"))

    return run


VOTED = {"SMA": {"timeperiod": 5}, "ROC": {"timeperiod": 3}, "WILLR": {"timeperiod": 14}}


def voted(spark: SparkSession, d: str) -> DataFrame:
    return S.run_vote(hourly(spark, d), list(VOTED), VOTED)


def model_signal(spark: SparkSession, d: str) -> DataFrame:
    """A model's signal for every bar: 1 where the bar rose, else -1."""
    return hourly(spark, d).select("symbol", "datetime", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("signal"))


def strategies(spark: SparkSession) -> DataFrame:
    flags = {"s1": ["SMA", "ROC"], "s2": ["WILLR"], "s3": ["SMA", "ROC", "WILLR"]}
    return spark.createDataFrame([(k, {n: n in v for n in VOTED}) for k, v in flags.items()], "strategy string, flags map<string,boolean>")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    minutes = R.resample(D.ticks(spark, d), "1m", ties=TIES)
    s = voted(spark, d).withColumn("strategy", F.lit("s3"))
    return B.backtest(s, minutes, B.Rules(take_profit=30.0, stop_loss=20.0, fee=0.05))


def folded_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The same ledger as a plan without Python."""
    minutes = R.resample(D.ticks(spark, d), "1m", ties=TIES)
    s = voted(spark, d).withColumn("strategy", F.lit("s3"))
    return backtest_fold(s, minutes, B.Rules(take_profit=30.0, stop_loss=20.0, fee=0.05))


def q_strategies(spark, d):
    return S.latest(S.vote_strategies(hourly(spark, d), strategies(spark), list(VOTED), VOTED))


def prediction(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model's output: the bar's own log return and a probability made of it."""
    df = hourly(spark, d).withColumn("pred", F.ln(F.col("close") / F.col("open")))
    return df.withColumns({"p": 1 / (1 + F.exp(-F.col("pred"))), "cls": (F.col("pred") > 0).cast("int"), "reg": F.col("pred")})


def posts(spark: SparkSession, d: str, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Documents as posts, with the time of the event of the same id. ``made`` is applied before they meet: what it drops, a text, is not exchanged."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("post_id"), F.col("source").alias("subreddit"), "text")
    times = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("post_id"), F.col("ts").cast("timestamp_ntz").alias("post_time"))
    return made(docs).join(times, "post_id")


def comments(spark: SparkSession, d: str, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Turns of conversations as comments, as ``posts`` are made."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 100 + F.col("turn")).alias("comment_id"), F.col("conv_id").alias("post_id"), "text")
    times = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("post_id"), F.col("ts").cast("timestamp_ntz").alias("comment_time"))
    return made(turns).join(times, "post_id")


def plain_features(df: DataFrame, text: str) -> DataFrame:
    """Sentiment inputs without the back-reference rule: every figure has an SQL twin."""
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    df = df.withColumns(
        {
            "token_count": F.regexp_count(text, F.lit(r"\S++")),
            "caps_ratio": F.coalesce(round_exact(F.try_divide(F.regexp_count(text, F.lit("[A-Z]")), letters), 4), F.lit(0.0)),
            "punct_intensity": F.regexp_count(text, F.lit("[!?]{2,}")),
            "emoji_count": F.lit(0),
            "spam_score": F.lit(0.0),
        }
    )
    return T.score(df, text)


def hourly_posts(spark, d):
    return T.hourly_sentiment(posts(spark, d, lambda df: plain_features(df, "text").drop("text")))


def hourly_comments(spark, d):
    return T.hourly_sentiment(comments(spark, d, lambda df: plain_features(df, "text").drop("text")), "comment_time", "comment_id")


def source_features(spark, d):
    return X.sentiment_features(hourly_posts(spark, d), "post", "post_id_count")


def combined(spark, d):
    return X.combine_sources(source_features(spark, d), X.sentiment_features(hourly_comments(spark, d), "comment", "comment_id_count"))


def market(spark, d):
    return X.market_features(D.ticks(spark, d), "1h", ties=TIES)


def merged(spark, d):
    return X.merge_sentiment(market(spark, d), combined(spark, d).select("time_window", "sentiment_combined", "volume_total", "confidence_combined"))


def alpha(spark, d):
    return X.alpha_features(merged(spark, d))


def model_table(spark, d):
    return X.next_bar_targets(alpha(spark, d))


def _of(f: Callable[[SparkSession, str], DataFrame], *columns) -> Query:
    return lambda spark, d: r6(f(spark, d).select(*columns) if columns else f(spark, d))


def q_near_dedup(spark, d):
    return T.near_dedup(posts(spark, d, lambda df: T.simhash(df.filter("text IS NOT NULL"), "text").drop("text")), "post_id").select("post_id")


def q_coins(spark, d):
    """Titles that end in a name, or nearly one, and forums in mixed case; all ten coins."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    forums = ("Bitcoin", "SatoshiStreetBets", "EthTrader", "news", "Solana", "XRP", "Avax", "Polkadot", "memes", "CARDANO", "dogecoin")
    named = ("$BTC now", "Ethereum", "binance  coin", "she sat down", "SOL!", "ripples", "(ada)", "doge", "dots", "$dot", "Avalanche", "chainlink", "linked", "bnbs", "solana-beach", "BTC")
    rows = posts(spark, d).select("post_id", F.concat_ws(" ", F.substring("text", 1, 20), pick(named, F.col("post_id"))).alias("title"), pick(forums, F.col("post_id").cast("long") * 7 + 3).alias("subreddit"))
    return T.coin_mentions(rows, "title", blocked=("MEMES",)).select("coin", "post_id")


def q_random_forest(spark, d):
    features = ["returns", "volatility", "volume_change", "sentiment_combined", "divergence"]
    parts = settle(X.split_by_position(model_table(spark, d), (0.7, 0.3)))  # a fit reads its rows many times
    model = M.trainer("rf_classifier", features, "target", numTrees=20, maxDepth=4).fit(parts.filter("part = 0"))
    return model.transform(parts.filter("part = 1")).select("symbol", "datetime", F.col("target"), F.col("prediction").cast("int").alias("prediction"))


def q_boosted(spark, d):
    """Which way the next bar goes, by more than a tenth of its price or neither: three classes with their chances."""
    features = ["returns", "volatility", "volume_change", "sentiment_combined", "divergence"]
    rows = settle(X.split_by_position(model_table(spark, d), (0.6, 0.2, 0.2)).withColumn("way", F.when(F.col("target_return") > 0.1, 1).when(F.col("target_return") < -0.1, -1).otherwise(0)))
    model = M.boosted_classes(rows.filter("part < 2"), features, "way", F.col("part") == 1, maxIter=5, maxDepth=3)
    return r6(model.transform(rows.filter("part = 2")).select("symbol", "datetime", "way", "prediction", "`p_-1`", "p_0", "p_1"))


def minutes(spark: SparkSession, d: str) -> DataFrame:
    return R.resample(D.ticks(spark, d), "1m", ties=TIES)


def linear_signals(df: DataFrame) -> DataFrame:
    """A linear score of two inputs as signals."""
    return df.withColumn("signals", U.sign_beyond(F.col("returns") * -0.5 + F.col("divergence") * 0.1, F.lit(0.2)))


def q_importance(spark, d):
    """How much profit shuffling an input of a linear score costs."""
    df = model_table(spark, d).select("symbol", "datetime", "returns", "divergence")
    return r6(U.pnl_importance(df, ["returns", "divergence"], linear_signals, minutes(spark, d), rules=B.Rules(take_profit=30.0, stop_loss=20.0)))


def q_chunked(spark, d):
    return r6(U.chunked(voted(spark, d).withColumn("strategy", F.lit("s3")), minutes(spark, d), 2, B.Rules(take_profit=30.0, stop_loss=20.0, fee=0.05)))


def q_search(spark, d):
    """Limits and weights of a linear score, searched by profit."""
    rows = hourly(spark, d).select("symbol", "datetime", (F.col("close") / F.col("open") - 1).alias("x"))
    trials = U.grid(spark, limit=[0.05, 0.2, 0.5], weight=[1.0, -1.0])
    predict = lambda t: rows.join(F.broadcast(t), F.lit(True)).select("trial", "symbol", "datetime", U.sign_beyond(F.col("x") * F.col("weight"), F.col("limit")).alias("signals"))  # noqa: E731 (the grid's few rows)
    return r6(U.search(trials, predict, minutes(spark, d)))


def q_halving(spark, d):
    """The same grid, halved: six backtests of a third, three of two thirds, two of all."""
    rows = hourly(spark, d).select("symbol", "datetime", (F.col("close") / F.col("open") - 1).alias("x"))
    trials = U.grid(spark, limit=[0.05, 0.2, 0.5], weight=[1.0, -1.0])
    predict = lambda t: rows.join(F.broadcast(t), F.lit(True)).select("trial", "symbol", "datetime", U.sign_beyond(F.col("x") * F.col("weight"), F.col("limit")).alias("signals"))  # noqa: E731 (the grid's few rows)
    return r6(U.halving(trials, predict, minutes(spark, d), buckets=6))


def q_backtest_v1(spark, d):
    """Half-day bars, as the first version leaves out intervals of ten bars or fewer."""
    half = R.resample(D.ticks(spark, d), "12h", ties=TIES)
    change = F.col("close") - F.col("open")
    s = half.select("symbol", "datetime", F.lit("s3").alias("strategy"), F.when(change > 10, 1).when(change < -10, -1).otherwise(0).alias("signals"))
    return r6(B.backtest(s, minutes(spark, d), B.Rules(take_profit=30.0, stop_loss=20.0, fee=0.05), version=1))


def _candle_store(spark: SparkSession, d: str) -> str:
    """Five-minute bars of the ticks as the table that a candle service answers from."""
    place = f"{scratch_root(spark)}/candles-{uuid.uuid4().hex}"
    E.store_candles(R.resample(D.ticks(spark, d), "5m", ties=TIES), place, "5m")
    return f"barflow.sources.exchanges:table_client?{place if ':' in place else 'file://' + place}"


SYMBOLS = ["click", "purchase", "view", "signup", "error", "nothing"]


def q_paged(spark, d):
    """All candles of a time, in pages of a hundred, a day a task."""
    c = E.read_candles(spark, "binance", _candle_store(spark, d), SYMBOLS, "2024-01-02", "2024-01-20 12:30:00", "5m", limit=100, hours=24)
    return r6(c.select("exchange", "symbol", "datetime", *R.OHLCV))


def _drain(out: DataFrame, root: str) -> None:
    """What there is now, appended to root/rows."""
    out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").trigger(availableNow=True).start().awaitTermination()


def q_stream_candles(spark, d):
    """The same as a stream, stopped after half of the time and started again on its checkpoint."""
    client, root = _candle_store(spark, d), f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    for end in ("2024-01-11", "2024-01-20 12:30:00"):
        _drain(E.stream_candles(spark, "binance", client, SYMBOLS, "2024-01-02", end, "5m", limit=100, hours=24), root)
    return r6(spark.read.parquet(f"{root}/rows").select("exchange", "symbol", "datetime", *R.OHLCV))


def q_stream_windows(spark, d):
    """Indicators over a stream of hourly bars, in four batches of a stretch of time each."""
    root = f"{scratch_root(spark)}/windows-{uuid.uuid4().hex}"
    bars = settle(hourly(spark, d).select("symbol", "datetime", "close"))
    first, last = bars.agg(F.min("datetime"), F.max("datetime")).first()
    for k in range(4):  # a file each, in the order of time
        own = bars.filter((F.col("datetime") >= first + (last - first) * k / 4) & (F.lit(k == 3) | (F.col("datetime") < first + (last - first) * (k + 1) / 4)))
        own.coalesce(1).write.mode("append").parquet(f"{root}/bars")
    live = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/bars")
    with W.rocksdb(spark):
        _drain(W.row_windows(live, {"sma": ("sma", 30), "ema": ("ema", 30), "mom": ("mom", 10)}), root)
    return r6(spark.read.parquet(f"{root}/rows").filter("NOT late").select("symbol", "datetime", "sma", "ema", "mom"))


def q_price_lookup(spark, d):
    rows = model_signal(spark, d).withColumn("datetime", F.col("datetime") + F.expr("INTERVAL 1 HOUR"))
    return r6(K.price_lookup(rows, D.ticks(spark, d), "1h", ties=TIES))


def q_target_lookup(spark, d):
    every = hourly(spark, d).select("symbol", "datetime", "close")
    return r6(K.value_lookup(X.log_diff(every.withColumn("volume", F.lit(1.0)), ["close"]).select("symbol", "datetime"), X.regression_target(every), "target", "original_target"))


def q_join_indicators(spark, d):
    bars = hourly(spark, d)
    return r6(K.join_indicators(bars.select("symbol", "datetime", "close"), add_indicators(bars, ["SMA", "ROC"]), ["sma", "roc"]))


FINAL = ["sentiment_combined", "returns", "volatility", "volume_change", "price_momentum", "divergence", "fear_greed", "not_there"]


def q_final(spark, d):
    return r6(K.final_selection(model_table(spark, d), FINAL, ["target", "target_return"]))


def q_lots(spark, d):
    rows = D.ticks(spark, d).select("event_id", (F.col("close") - 50).alias("qty"))
    return r6(rows.select("event_id", K.floor_to_step(F.col("qty"), 0.25).alias("lots")))


def q_ids(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.element_at(F.array(F.lit("1h"), F.lit("4h"), F.lit("1d")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("timeframe"), F.col("o_orderstatus").alias("symbol"))
    return K.strategy_ids(rows, ("o_orderkey",), last={"4h": 10}).select("o_orderkey", "strategy")


def q_analysis(spark, d):
    key = F.col("o_orderkey")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        key.cast("string").alias("strategy"),
        F.create_map(F.lit("SMA"), key % 2 == 0, F.lit("ROC"), key % 3 == 0, F.lit("CDLDOJI"), F.when(key % 5 == 0, F.lit(None)).otherwise(key % 7 == 0)).alias("flags"),
        F.create_map(F.lit("sma_period"), (key % 50).cast("double"), F.lit("macd_slowperiod"), F.when(key % 4 > 0, (key % 60).cast("double")), F.lit("bb_nbdevup"), F.lit(1000.0)).alias("params"),
    )
    return K.strategy_analysis(rows).select("strategy", F.array_join("active_flags", ",").alias("active_flags"), "max_window")


def q_classes(spark, d):
    x = F.array(F.col("open") - F.col("close"), F.col("high") - F.col("close"), F.col("close") - F.col("low"))
    rows = hourly(spark, d).withColumn("scores", F.transform(x, lambda v: v / 10))
    rows = rows.withColumn("p", K.softmax(F.col("scores")))
    return r6(rows.select("symbol", "datetime", K.class_of(F.col("scores")).alias("class"), *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)]))


def q_gbt(spark, d):
    features = ["returns", "volatility", "volume_change", "sentiment_combined", "divergence"]
    parts = settle(X.split_by_position(model_table(spark, d), (0.7, 0.3)))  # a fit reads its rows many times
    model = M.trainer("gbt_regressor", features, "target_return", maxIter=5, maxDepth=3).fit(parts.filter("part = 0"))
    return r6(model.transform(parts.filter("part = 1")).select("symbol", "datetime", "target_return", "prediction"))


def q_seq(spark, d):
    s = X.sequences(hourly(spark, d), ["close", "volume"], "close", 5)
    return r6(s.select("symbol", "datetime", F.element_at(F.element_at("window", 1), 1).alias("first_close"), F.element_at(F.element_at("window", -1), 2).alias("last_volume"), "label", F.size("window").cast("long").alias("steps")))


def q_landing(spark, d):
    t = D.ticks(spark, d)
    raw = t.select((F.unix_micros(F.col("datetime").cast("timestamp")) / 1000).cast("long").alias("timestamp"), *[F.col(c).cast("string").alias(c) for c in R.OHLCV], F.lit("0").alias("turnover"), "symbol")
    return r6(D.landing(raw, "bybit", F.col("symbol")).groupBy("symbol").agg(F.count("*").alias("n"), F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"), F.sum("close").alias("total")))


def q_upsert(spark, d):
    t = D.ticks(spark, d).select("event_id", "symbol", "close")
    old = t.filter("event_id % 3 <> 0")
    return r6(D.upsert_ignore(t.withColumn("close", F.lit(0.0)), old, ("event_id",)).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close").alias("total")))


def q_append(spark, d):
    t = D.ticks(spark, d).select("event_id", "symbol")
    return D.new_rows(t, t.filter("event_id % 3 <> 0"), ("event_id",)).groupBy("symbol").agg(F.count("*").alias("n"))


def signed(c: str) -> Column:
    return F.col(c).cast("int").alias(c)


PREDICTED = ("symbol", "datetime", "signal")

#: Patterns by the number of bars they look at.
CANDLES = {
    "candles_single": "CDLBELTHOLD CDLCLOSINGMARUBOZU CDLDOJI CDLDRAGONFLYDOJI CDLGRAVESTONEDOJI CDLHAMMER CDLHANGINGMAN CDLHIGHWAVE CDLINVERTEDHAMMER CDLLONGLEGGEDDOJI CDLLONGLINE CDLMARUBOZU CDLRICKSHAWMAN CDLSHOOTINGSTAR CDLSHORTLINE CDLSPINNINGTOP CDLTAKURI".split(),
    "candles_double": "CDLCOUNTERATTACK CDLDARKCLOUDCOVER CDLDOJISTAR CDLENGULFING CDLHARAMI CDLHARAMICROSS CDLHOMINGPIGEON CDLINNECK CDLKICKING CDLKICKINGBYLENGTH CDLMATCHINGLOW CDLONNECK CDLPIERCING CDLSEPARATINGLINES CDLTHRUSTING".split(),
    "candles_triple": "CDL2CROWS CDL3INSIDE CDL3OUTSIDE CDL3STARSINSOUTH CDL3WHITESOLDIERS CDLABANDONEDBABY CDLADVANCEBLOCK CDLEVENINGDOJISTAR CDLEVENINGSTAR CDLGAPSIDESIDEWHITE CDLIDENTICAL3CROWS CDLMORNINGDOJISTAR CDLMORNINGSTAR CDLSTALLEDPATTERN CDLSTICKSANDWICH CDLTASUKIGAP CDLTRISTAR CDLUNIQUE3RIVER CDLUPSIDEGAP2CROWS CDLXSIDEGAP3METHODS".split(),
    "candles_multi": "CDL3BLACKCROWS CDL3LINESTRIKE CDLBREAKAWAY CDLCONCEALBABYSWALL CDLLADDERBOTTOM CDLMATHOLD CDLRISEFALL3METHODS".split(),
}

TRAPS = ["CDLHIKKAKE", "CDLHIKKAKEMOD"]

QUERIES: dict[str, Query] = {
    "resample_1h": _of(hourly),
    "resample_15m": _of(lambda s, d: R.resample(D.ticks(s, d), "15m", ties=TIES)),
    "resample_1d_lineitem": _of(daily),
    "grid_ffill_minute": _of(lambda s, d: R.clean(R.resample(D.ticks(s, d), "1m", ties=TIES), "1m")),
    "dedup_first": _of(lambda s, d: R.first_of(D.ticks(s, d).withColumn("minute", R.floor_to("datetime", "1m")), ("symbol", "minute"), ("datetime", "event_id")).select("symbol", "minute", "event_id", "close")),
    "range_scan_tail": _of(lambda s, d: R.range_scan(D.ticks(s, d), "2024-01-05", "2024-01-20", 500, ties=TIES).select("event_id", "datetime", "close")),
    "last_only_resample": _of(lambda s, d: R.resample_last(D.ticks(s, d), "4h", ties=TIES)),
    "landing_candles": q_landing,
    "upsert_ignore": q_upsert,
    "append_anti": q_append,
    **{f"ind_{n.lower()}": indicator(n) for n in INDICATORS},
    **{k: candle(v) for k, v in CANDLES.items()},
    "candles_traps": candle(TRAPS),
    **{f"rule_{r}": rule(n) for r, n in {"price_cross": "SMA", "zero_cross": "MOM", "threshold": "WILLR", "pivot": "ROCR", "mean_cross": "TRANGE", "line_cross": "STOCH", "prev_cross": "OBV", "bbands": "BBANDS", "pattern": "CDLENGULFING"}.items()},
    "rule_trend_mode": rule("HT_TRENDMODE"),
    "split_ema": _of(lambda s, d: SC.emas(hourly(s, d)), "symbol", "datetime", "ema"),
    "split_tema": _of(lambda s, d: SC.emas(hourly(s, d), times=3), "symbol", "datetime", "tema"),
    "split_macd": _of(lambda s, d: SC.macd(hourly(s, d)), "symbol", "datetime", "macd", "macd_signal", "macd_hist"),
    "split_rsi": _of(lambda s, d: SC.rsi(hourly(s, d)), "symbol", "datetime", "rsi"),
    "split_atr": _of(lambda s, d: SC.atr(hourly(s, d)), "symbol", "datetime", "atr"),
    "vote": voted,
    "vote_with_model": lambda s, d: S.vote(S.signals(hourly(s, d), list(VOTED), VOTED), model=model_signal(s, d)),
    "strategies_latest": q_strategies,
    "backtest_ledger": _of(ledger),
    "backtest_folded": _of(folded_ledger),
    "backtest_summary": _of(lambda s, d: B.summary(ledger(s, d))),
    "trade_stats": _of(lambda s, d: B.trade_statistics(ledger(s, d))),
    "max_drawdown": _of(lambda s, d: B.max_drawdown(hourly(s, d), "close", ("symbol",), "datetime")),
    "streaks": lambda s, d: B.streaks(hourly(s, d).withColumn("pnl", F.round(F.col("close") - F.col("open"), 9)), ("symbol",), "datetime"),
    "top_strategies": _of(lambda s, d: B.top(hourly(s, d).groupBy(F.col("symbol").alias("strategy")).agg(F.sum(F.col("close") - F.col("open")).alias("pnl_sum")), 3)),
    "best_model": _of(lambda s, d: B.best_model(hourly(s, d).groupBy(F.col("symbol").alias("model_name")).agg(F.sum(F.col("close") - F.col("open")).alias("pnl"), F.try_divide(F.avg("close"), F.stddev_samp("close")).alias("sharpe_ratio"), (F.min("low") - F.max("high")).alias("max_drawdown")))),
    "cls_target": lambda s, d: X.classification_target(hourly(s, d)).select("symbol", "datetime", signed("target")),
    "reg_target": _of(lambda s, d: X.regression_target(hourly(s, d)), "symbol", "datetime", "target"),
    "log_diff": _of(lambda s, d: X.log_diff(hourly(s, d), ["close"], ["volume"]), "symbol", "datetime", "close", "volume"),
    "signed_log_diff": _of(lambda s, d: X.signed_log_diff(hourly(s, d).withColumn("change", F.col("close") - F.col("open")), ["close", "change"]), "symbol", "datetime", "close", "change", "log_return"),
    "zscore_target": _of(lambda s, d: X.z_target(hourly(s, d), "close"), "symbol", "datetime", "close"),
    "robust_scale": _of(lambda s, d: X.robust_scale(hourly(s, d), ["close", "volume"], F.col("datetime") < F.lit("2024-01-20").cast("timestamp_ntz")), "symbol", "datetime", "close", "volume"),
    "split_70_15_15": lambda s, d: X.split_by_position(hourly(s, d)).groupBy("symbol", "part").agg(F.count("*").alias("n"), F.min("datetime").alias("first_time")),
    "split_by_ratio": lambda s, d: X.split_date(hourly(s, d), 0.8),
    "rolling_train_window": _of(lambda s, d: X.train_window(hourly(s, d), "2024-01-20 00:00:00", 100), "symbol", "datetime", "close"),
    "sequences": q_seq,
    "frequency": lambda s, d: X.frequency(hourly(s, d)),
    "union_concat": _of(lambda s, d: X.concat_keep_last(hourly(s, d), hourly(s, d).filter("symbol = 'click'").withColumn("close", F.lit(0.0)), ("symbol", "datetime"))),
    "pred_classifier": lambda s, d: M.from_classifier(prediction(s, d)).select(*PREDICTED),
    "pred_regressor": lambda s, d: M.from_regressor(prediction(s, d)).select(*PREDICTED),
    "pred_deadband": lambda s, d: M.from_log_return(prediction(s, d), band=0.01).select(*PREDICTED),
    "pred_price": lambda s, d: M.from_price(prediction(s, d), "open").select(*PREDICTED),
    "pred_probability": lambda s, d: M.from_probability(prediction(s, d)).select(*PREDICTED),
    "pred_consensus": lambda s, d: M.consensus(prediction(s, d)).select(*PREDICTED),
    "is_log_return": lambda s, d: M.is_log_return(prediction(s, d)),
    "regression_metrics": _of(lambda s, d: M.regression_metrics(hourly(s, d), "open", "close", ("symbol",))),
    "return_summary": _of(lambda s, d: M.return_summary(prediction(s, d).withColumn("side", F.when(F.col("volume") % 2 == 0, 1).otherwise(-1)), "side", "pred")),
    "autoregression": _of(lambda s, d: M.autoregression(hourly(s, d), "close", 2, 3)),
    "make_stationary": _of(lambda s, d: M.make_stationary(hourly(s, d), ["close"]), "symbol", "datetime", "close"),
    "text_clean": lambda s, d: posts(s, d, lambda df: T.clean_text(df, "text").drop("text")).select("post_id", "clean"),
    "text_features": _of(lambda s, d: posts(s, d, lambda df: T.apply_cleaning(df, "text", features=True, drop_invalid=False).drop("text", "cleaned_text")).drop("subreddit", "post_time")),
    "cleaned_comments": lambda s, d: comments(s, d, lambda df: T.apply_cleaning(df, "text", features=True).drop("text")).select("comment_id", "cleaned_text", "spam_score", "token_count"),
    "simhash": lambda s, d: posts(s, d, lambda df: T.simhash(df, "text").drop("text")).select("post_id", "simhash"),
    "hamming_pairs": lambda s, d: T.hamming_pairs(posts(s, d, lambda df: T.simhash(df, "text").drop("text")), "post_id"),
    "dedup_exact": lambda s, d: T.exact_dedup(posts(s, d, lambda df: df.withColumn("content_hash", F.md5(F.col("text").cast("binary"))).drop("text"))).select("post_id", "content_hash"),
    "dedup_near": q_near_dedup,
    "coin_filter": q_coins,
    "hourly_sentiment": _of(hourly_posts),
    "sentiment_features": _of(source_features),
    "combine_outer": _of(combined, "time_window", "sentiment_combined", "volume_total", "sentiment_disagreement", "confidence_combined"),
    "market_features": _of(market),
    "merge_ffill": _of(merged, "symbol", "datetime", "sentiment_combined", "volume_total", "confidence_combined"),
    "alpha_features": _of(alpha, "symbol", "datetime", "divergence", "volume_spike", "fear_greed", "sentiment_volatility"),
    "next_bar_targets": _of(model_table, "symbol", "datetime", "target", "target_return"),
    "corr_with_target": _of(lambda s, d: X.correlations(model_table(s, d), ["returns", "volatility", "volume_change", "price_momentum", "sentiment_combined", "divergence"], "target_return")),
    "class_balance": _of(lambda s, d: X.class_balance(model_table(s, d), "target")),
    "class_weights": _of(lambda s, d: X.class_weights(model_table(s, d), "target", 2)),
    "random_forest": q_random_forest,
    "gradient_boosting": q_gbt,
    "boosted_classes": q_boosted,
    "arima": _of(lambda s, d: M.arima(hourly(s, d), ["close"], 2, 1, 1, 3)),
    "varima": _of(lambda s, d: M.arima(hourly(s, d), ["close", "volume"], 1, 1, 1, 2)),
    "permutation_importance": q_importance,
    "chunked_evaluation": q_chunked,
    "parameter_search": q_search,
    "halving_search": q_halving,
    "backtest_v1": q_backtest_v1,
    "paged_candles": q_paged,
    "stream_candles": q_stream_candles,
    "stream_windows": q_stream_windows,
    "price_lookup": q_price_lookup,
    "target_lookup": q_target_lookup,
    "join_indicators": q_join_indicators,
    "date_range": lambda s, d: K.date_range(hourly_posts(s, d), hourly_comments(s, d)),
    "final_selection": q_final,
    "lot_steps": q_lots,
    "strategy_ids": q_ids,
    "strategy_analysis": q_analysis,
    "class_scores": q_classes,
    "vector_autoregression": _of(lambda s, d: M.vector_autoregression(hourly(s, d), ["close", "volume"], 1, 2)),
    "votes_estimate": lambda s, d: T.estimated_votes(D.ticks(s, d).select("event_id", (F.col("event_id") % 1000).cast("int").alias("score"), (F.col("event_id") % 11 / 10).alias("upvote_ratio"))).select("event_id", "estimated_upvotes", "estimated_downvotes"),
}
