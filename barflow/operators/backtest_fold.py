"""The second backtest version as a DataFrame plan: no Python worker, and bars are split within a symbol.

A position can only be opened by a non-zero signal whose interval has bars, and how it would
end does not depend on how it came about: by the first bar that reaches a level, at the next
opposite signal, or not at all.  So every signal gets its end, whether it is traded or not:

1. the bar at or after each signal, by time buckets of a symbol and a carry between buckets;
2. the first bar that reaches a level, in two steps: buckets whose highest high or lowest low
   can reach one (a range join by symbol and bucket, up to the next opposite signal), then only
   the bars of the first such bucket (and of the signal's own, which has begun already);
3. a fold over a series' signals (``aggregate``) that chains ends to entries and carries the
   balance; only here a series is in one row, as a list of its non-zero signals.

Signals, bars and entries are written on the way, since each is read several times.  With a delay an interval of too few bars is skipped, so bars in such intervals do not count:
then every bucket that can reach a level is searched, and a symbol's bars are numbered in one
window.  Defined cases are those of ``backtest``; both give the same ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.scratch import settle
from barflow.operators.backtest import Rules

BUCKET = 6 * 3600  # seconds
SERIES = ("strategy", "symbol")


def _bucket(t: Column, width: int) -> Column:
    return F.floor(F.datediff(t, F.lit("1970-01-01").cast("date")) * F.lit(86400 // width) + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / width).cast("long")


def _bars(bars: DataFrame, delay: int, width: int) -> DataFrame:
    own = bars.select("symbol", F.col("datetime").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]).withColumn("bucket", _bucket(F.col("t"), width))
    if not delay:
        return own.withColumns({"t_in": F.col("t"), "price_in": F.col("open")})
    w = Window.partitionBy("symbol").orderBy("t")
    return own.withColumns({"t_in": F.lead("t", delay).over(w), "price_in": F.lead("open", delay).over(w)})


def next_bars(times: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, at, bar): for each (symbol, at, bucket) the first bar at or after it; windows are by symbol and bucket, only the buckets' firsts by symbol."""
    bar = F.struct(*[F.col(c).alias(c) for c in ("t", "open", "t_in", "price_in")])
    firsts = bars.groupBy("symbol", "bucket").agg(F.min(bar).alias("first"))
    asked = times.groupBy("symbol", "bucket").agg(F.lit(1).alias("__asked"))
    along = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    later = firsts.join(asked, ["symbol", "bucket"], "full_outer").select("symbol", "bucket", F.first("first", ignorenulls=True).over(along).alias("later"))
    both = times.select("symbol", "bucket", F.col("at").alias("t"), F.lit(1).alias("asks"), F.lit(None).cast(bars.select(bar.alias("b")).schema["b"].dataType).alias("bar"))
    both = both.unionByName(bars.select("symbol", "bucket", "t", F.lit(0).alias("asks"), bar.alias("bar")))
    ahead = Window.partitionBy("symbol", "bucket").orderBy(F.col("t"), F.desc("asks")).rowsBetween(0, Window.unboundedFollowing)
    met = both.withColumn("bar", F.first("bar", ignorenulls=True).over(ahead)).filter("asks = 1")
    return met.join(later, ["symbol", "bucket"], "left").select("symbol", F.col("t").alias("at"), F.coalesce("bar", "later").alias("bar"))


def _ends(entries: DataFrame, bars: DataFrame, rules: Rules, width: int) -> DataFrame:
    """(strategy, symbol, at, hit): the first bar (t, price, won) of each entry's reach that hits a level."""
    buckets = bars.groupBy("symbol", "bucket").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    can = (F.col("top") >= F.greatest("take", "stop")) | (F.col("bottom") <= F.least("take", "stop"))
    reach = F.sequence(F.col("own"), F.col("last_bucket"))
    narrow = entries.select(*SERIES, "at", "side", "take", "stop", "begin", "until", _bucket(F.col("begin"), width).alias("own"), F.greatest(_bucket(F.col("begin"), width), _bucket(F.col("until"), width)).alias("last_bucket"))
    met = narrow.withColumn("bucket", F.explode(reach)).join(buckets, ["symbol", "bucket"]).filter(can)
    if not rules.delay:
        # the own bucket has begun before the entry, so it may turn out empty: it is searched beside the first later one
        first = met.groupBy(*SERIES, "at").agg(F.min(F.when(F.col("bucket") > F.col("own"), F.col("bucket"))).alias("later"), F.min(F.when(F.col("bucket") == F.col("own"), F.col("bucket"))).alias("now"))
        chosen = first.select(*SERIES, "at", F.explode(F.array_compact(F.array("now", "later"))).alias("bucket"))
        met = narrow.join(chosen, [*SERIES, "at"])
    long = F.col("side") > 0
    won = F.when(long, F.col("high") >= F.col("take")).otherwise(F.col("low") <= F.col("take"))
    lost = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    hits = met.select(*SERIES, "at", "side", "take", "stop", "begin", "until", "bucket").join(bars.select("symbol", "bucket", "t", "high", "low"), ["symbol", "bucket"])
    hits = hits.filter((F.col("t") >= F.col("begin")) & (F.col("t") < F.col("until")) & (won | lost))
    return hits.select(*SERIES, "at", F.struct("t", F.when(won, F.col("take")).otherwise(F.col("stop")).alias("price"), won.alias("won")).alias("hit"))


def _alive(hits: DataFrame, intervals: DataFrame) -> DataFrame:
    """Hits in intervals that are not skipped: the last signal at or before a bar tells."""
    both = intervals.select(*SERIES, F.col("at").alias("t"), F.lit(0).alias("kind"), F.col("live"), F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), F.lit(None).cast(hits.schema["at"].dataType).alias("entry"))
    both = both.unionByName(hits.select(*SERIES, F.col("hit.t").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("live"), "hit", F.col("at").alias("entry")))
    before = Window.partitionBy(*SERIES).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("live", F.last("live", ignorenulls=True).over(before)).filter("kind = 1 AND live").select(*SERIES, F.col("entry").alias("at"), "hit")


EVENT = "array<struct<t:timestamp_ntz,side:int,action:string,buy:double,sell:double,balance:double,pnl:double>>"


def _fold(c: Column, rules: Rules, end: Column) -> Column:
    """The events of a series: c is the sorted list of its possible entries, end its last bar."""
    cost, half = rules.cost, rules.balance / 2
    empty = F.array().cast(EVENT)
    nothing = F.lit(None).cast("struct<side:int,entry:double>")
    start = F.struct(F.lit(float(rules.balance)).alias("balance"), F.lit(None).cast("timestamp_ntz").alias("free"), F.lit(False).alias("after"), F.lit(False).alias("stopped"), nothing.alias("held"), empty.alias("events"))

    def gain(price: Column, entry: Column, side: Column) -> Column:
        return (price - entry) / entry * 100 * side * rules.leverage - cost

    def event(t: Column, side: Column, action, buy: Column, sell: Column, balance: Column, pnl: Column) -> Column:
        action = F.lit(action) if isinstance(action, str) else action
        return F.struct(t.alias("t"), side.cast("int").alias("side"), action.alias("action"), buy.alias("buy"), sell.alias("sell"), balance.alias("balance"), pnl.alias("pnl"))

    def one(s: Column, x: Column) -> Column:
        free = s["free"].isNull() | F.when(s["after"], x["at"] > s["free"]).otherwise(x["at"] >= s["free"])
        turned = s["held"].isNotNull()
        lost = gain(x["open"], s["held"]["entry"], s["held"]["side"])
        b0 = F.when(turned, s["balance"] + s["balance"] * lost / 100).otherwise(s["balance"])
        b1 = b0 - b0 * cost / 100
        pnl = gain(x["hit"]["price"], x["entry"], x["side"])
        b2 = b1 + b1 * pnl / 100
        # a hit in a later interval comes after the check at the end of this one
        broke = (b1 < half) & F.coalesce(x["hit"]["t"] >= x["next_at"], F.lit(True))
        exits = x["hit"].isNotNull() & ~broke
        balance = F.when(exits, b2).otherwise(b1)
        close = F.when(turned, F.array(event(x["at"], s["held"]["side"], "sell - direction_change", s["held"]["entry"], x["open"], b0, lost))).otherwise(empty)
        buy = F.array(event(x["at"], x["side"], "buy", x["entry"], F.lit(0.0), b1, F.lit(-cost)))
        leave = F.array(event(x["hit"]["t"], x["side"], F.when(x["hit"]["won"], "sell - take_profit").otherwise("sell - stop_loss"), x["entry"], x["hit"]["price"], b2, pnl))
        taken = F.struct(
            balance.alias("balance"),
            F.when(exits, x["hit"]["t"]).otherwise(F.coalesce(x["turn"], F.lit("9999-12-31").cast("timestamp_ntz"))).alias("free"),
            exits.alias("after"),
            (broke | (exits & (b2 < half))).alias("stopped"),
            F.when(exits, nothing).otherwise(F.struct(x["side"].cast("int").alias("side"), x["entry"].alias("entry"))).alias("held"),
            F.concat(s["events"], close, buy, F.when(exits, leave).otherwise(empty)).alias("events"),
        )
        return F.when(s["stopped"] | ~free, s).otherwise(taken)

    def finish(s: Column) -> Column:
        pnl = gain(end["close"], s["held"]["entry"], s["held"]["side"])
        last = event(end["t"], s["held"]["side"], "sell - end_of_backtest", s["held"]["entry"], end["close"], s["balance"] + s["balance"] * pnl / 100, pnl)
        return F.when(s["held"].isNotNull(), F.concat(s["events"], F.array(last))).otherwise(s["events"])

    return F.aggregate(c, start, one, finish)


def backtest_fold(signals: DataFrame, bars: DataFrame, rules: Rules = Rules(), signal: str = "signals", width: int = BUCKET) -> DataFrame:
    """The ledger of ``backtest`` (version 2). width: seconds of a bucket, a divisor of a day."""
    own = signals.select(*SERIES, F.col("datetime").alias("at"), F.coalesce(F.col(signal), F.lit(0)).cast("int").alias("side"))
    own, prices = settle(own), settle(_bars(bars, rules.delay, width))
    times = own.select("symbol", "at").distinct().withColumn("bucket", _bucket(F.col("at"), width))
    along = Window.partitionBy(*SERIES).orderBy("at")
    rows = own.withColumns({"next_at": F.lead("at").over(along), "last_at": F.max("at").over(Window.partitionBy(*SERIES))}).join(next_bars(times, prices), ["symbol", "at"], "left")
    # the last signal has no interval; one of no more bars than the delay is skipped
    intervals = rows.withColumn("live", F.coalesce(F.col("bar.t_in") < F.col("next_at"), F.lit(False)))
    ahead = along.rowsBetween(1, Window.unboundedFollowing)
    opposite = F.when(F.col("side") > 0, F.min(F.when(F.col("side") < 0, F.col("at"))).over(ahead)).otherwise(F.min(F.when(F.col("side") > 0, F.col("at"))).over(ahead))
    entries = intervals.filter("live AND side <> 0").withColumn("side", F.signum("side").cast("int")).withColumns({"turn": opposite, "entry": F.col("bar.price_in"), "begin": F.col("bar.t"), "open": F.col("bar.open")})
    level = lambda percent: F.col("entry") * (1 + F.col("side") * percent / 100)
    entries = entries.withColumns({"take": level(F.lit(rules.take_profit)), "stop": F.col("entry") * (1 - F.col("side") * F.lit(rules.stop_loss) / 100), "until": F.least(F.coalesce("turn", "last_at"), "last_at")})
    entries = settle(entries.drop("bar"))
    hits = _ends(entries, prices, rules, width)
    if rules.delay:
        hits = _alive(hits, intervals)
    first = hits.groupBy(*SERIES, "at").agg(F.min("hit").alias("hit"))
    ends = prices.groupBy("symbol").agg(F.max(F.struct("t", "close")).alias("end"))
    listed = entries.join(first, [*SERIES, "at"], "left").groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("at", "side", "entry", "open", "hit", "turn", "next_at"))).alias("entries"))
    told = listed.join(ends, "symbol").select(*SERIES, F.posexplode(_fold(F.col("entries"), rules, F.col("end"))).alias("event", "e"))
    total = F.sum("e.pnl").over(Window.partitionBy(*SERIES).orderBy("event"))
    cents = lambda x: F.rint(x * 100) / 100
    return told.select(
        *SERIES, F.col("event").cast("long").alias("event"), F.col("e.t").alias("datetime"), F.when(F.col("e.side") > 0, "long").otherwise("short").alias("predicted_direction"), F.col("e.action").alias("action"),
        F.col("e.buy").alias("buy_price"), F.col("e.sell").alias("sell_price"), cents(F.col("e.balance")).alias("balance"), cents(F.col("e.pnl")).alias("pnl"), cents(total).alias("pnl_sum"),
    )
