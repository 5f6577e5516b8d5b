"""Posts and comments: cleaning, features, deduplication, sentiment and its hourly aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions import text as X
from barflow.functions.batches import small_batches
from barflow.functions.rounding import round_exact
from barflow.functions.scratch import settle

# The pattern that names a coin (in either case) and the forums where every post is about it.
COINS = {
    "btc": (r"\b(btc|bitcoin)\b|\$btc", ("bitcoin", "bitcoinmarkets", "satoshistreetbets")),
    "eth": (r"\b(eth|ethereum)\b|\$eth", ("ethereum", "ethtrader")),
    "bnb": (r"\b(bnb|binance\s*coin)\b|\$bnb", ()),
    "sol": (r"\b(sol|solana)\b|\$sol", ("solana",)),
    "xrp": (r"\b(xrp|ripple)\b|\$xrp", ("ripple", "xrp")),
    "ada": (r"\b(ada|cardano)\b|\$ada", ("cardano",)),
    "doge": (r"\b(doge|dogecoin)\b|\$doge", ("dogecoin",)),
    "dot": (r"\b(dot|polkadot)\b|\$dot", ("polkadot",)),
    "avax": (r"\b(avax|avalanche)\b|\$avax", ("avax",)),
    "link": (r"\b(link|chainlink)\b|\$link", ()),
}
POSITIVE = ("up", "bull", "bullish", "moon", "gain", "gains", "good", "great", "buy", "long", "profit", "win", "pump", "strong")
NEGATIVE = ("down", "bear", "bearish", "dump", "loss", "losses", "bad", "sell", "short", "scam", "crash", "weak", "rekt", "fear")


def clean_text(df: DataFrame, text: str, out: str = "clean", tickers: bool = True, prices: bool = False, most: int = 512) -> DataFrame:
    """Add the cleaned text; a stage a projection, so no expression is evaluated twice."""
    first, *rest = X.clean_steps(F.col(text), tickers, prices)
    df = df.withColumn("__clean", first)
    for step in rest:
        df = df.withColumn("__clean", step)
    return df.withColumn(out, X.shorten(F.col("__clean"), most)).drop("__clean")


def text_features(df: DataFrame, raw: str, clean: str) -> DataFrame:
    """Add the features of a cleaned text (and of its raw form); a text that cleaning has emptied has those of its raw form only, else zeros."""
    c, r = F.col(clean), F.coalesce(F.col(raw), F.lit(""))
    n = lambda x, p: F.regexp_count(x, F.lit(p))
    df = df.withColumns({"__letters": n(c, r"\p{L}"), "__capitals": n(c, r"\p{Lu}"), "__points": n(c, X.PUNCTUATION), "char_repeats": n(r, X.REPEAT), "token_count": F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))})
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    tokens, caps = F.col("token_count"), F.col("__caps")
    df = df.withColumn("__caps", ratio("__capitals", F.col("__letters")))
    spam = (
        F.when(tokens < 3, 0.2).otherwise(0.0)
        + F.least(ratio("char_repeats", tokens) * 0.3, F.lit(0.3))
        + F.when((caps > 0.8) & (tokens > 5), 0.2).otherwise(0.0)
        + F.when(ratio("__points", F.length(c)) > 0.4, 0.3).otherwise(0.0)
    )
    df = df.withColumn("__spam", F.least(spam, F.lit(1.0)))
    made = {
        "emoji_count": n(c, X.EMOJI),
        "caps_ratio": round_exact(caps, 4),
        "punct_intensity": n(c, X.INTENSE),
        "exclamations": n(c, "!"),
        "questions": n(c, r"\?"),
        "had_url": X.has_url(r),
        "had_bot": X.is_noise(r),
        "had_markdown": r.rlike(X.BOLD) | r.rlike(X.HEADER) | r.rlike(X.CODE),
        "content_hash": F.when(c == "", "").otherwise(F.md5(c.cast("binary"))),
        "is_valid": c != "",
        "spam_score": F.when(c == "", 0.0).otherwise(round_exact(F.col("__spam"), 4)),
    }
    return df.withColumns(made).drop("__letters", "__capitals", "__points", "__caps", "__spam")


def apply_cleaning(df: DataFrame, text: str, features: bool = False, tickers: bool = True, prices: bool = False, drop_invalid: bool = True) -> DataFrame:
    """Add ``cleaned_text`` and ``is_valid`` (and all features with the SimHash of the cleaned text); rows that cleaning empties go unless kept."""
    done = clean_text(df, text, "cleaned_text", tickers, prices)
    done = simhash(text_features(done, text, "cleaned_text"), "cleaned_text") if features else done.withColumn("is_valid", F.col("cleaned_text") != "")
    return done.filter("is_valid") if drop_invalid else done


def simhash(df: DataFrame, text: str, out: str = "simhash") -> DataFrame:
    """Add the SimHash of a text's words; a text without any has 0."""
    small_batches(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(X.simhash64, "long")(F.col(text)))


def exact_dedup(df: DataFrame, by: str = "content_hash", order: tuple[str, ...] = ("post_time", "post_id")) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _blocks_for(n: int, most: int, aim: int) -> int:
    """As few blocks as leave about ``aim`` chance members a key, or fewer: keys have the bits of all blocks but ``most``."""
    m = most + 1
    while n >> (64 * (m - most) // m) > aim and m < 4 * (most + 1):
        m += 1
    return m


def hamming_keys(h: Column, blocks: int, most: int) -> list[Column]:
    """The bits of every choice of blocks - most blocks: hashes within ``most`` bits agree in at least one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [h.bitwiseAND(F.lit(signed(sum(chosen)))) for chosen in combinations(masks, blocks - most)]


def hamming_pairs(df: DataFrame, key: str, bits: str = "simhash", most: int = 3, aim: int = 64) -> DataFrame:
    """(a, b, distance) between the first rows of different hashes within ``most`` bits, a < b.

    The 64 bits are cut into blocks, and a hash is posted under every choice of all but ``most`` of them; the more hashes there are,
    the more blocks, so that a key has no more than about ``aim`` members by chance (for 3 bits: keys of 16 bits up to four million
    hashes, of 25 up to two billion, then of 32). A pair is told under the first choice in which it agrees, so nothing is told twice. Rows of equal hashes are one
    class, so a hash that many rows share is one entry: ``hamming_classes`` tells the members.
    """
    firsts = settle(df.groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("id")))
    blocks = _blocks_for(firsts.count(), most, aim)
    posted = firsts.select("id", "h", F.posexplode(F.array(*hamming_keys(F.col("h"), blocks, most))).alias("choice", "part"))
    # most keys have one member: they are left out before the join
    shared = posted.groupBy("choice", "part").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    posted = settle(posted.join(shared, ["choice", "part"]))
    a, b = (posted.select(*[F.col(c).alias(f"{c}_{s}") if c in ("id", "h") else F.col(c) for c in posted.columns]) for s in "ab")
    near = a.join(b, ["choice", "part"]).filter("id_a < id_b").withColumn("distance", X.hamming(F.col("h_a"), F.col("h_b"))).filter(F.col("distance") <= most)
    agree = hamming_keys(F.col("h_a").bitwiseXOR(F.col("h_b")), blocks, most)
    first = F.coalesce(*[F.when(x == 0, F.lit(k)) for k, x in enumerate(agree)])
    return near.filter(F.col("choice") == first).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "distance")


def hamming_classes(df: DataFrame, key: str, bits: str = "simhash") -> DataFrame:
    """(key, first): each row with the first row of its hash."""
    firsts = df.groupBy(bits).agg(F.min(key).alias("first"))
    return df.join(firsts, bits).select(key, "first")


def near_dedup(df: DataFrame, key: str, bits: str = "simhash", most: int = 3) -> DataFrame:
    """Greedy: in key order a row goes if it is within ``most`` bits of an earlier row that stays.

    Equal hashes fold into their first row; then in every round a row whose earlier neighbours have all
    gone stays, and one with an earlier neighbour that stays goes, until all are decided. A round decides the
    first open row at least, so this ends; what a round has decided is written, so the next does not plan it again.
    """
    cut = settle
    hashed = settle(df.select(key, bits))
    firsts = hashed.groupBy(bits).agg(F.min(key).alias(key))
    pairs = cut(hamming_pairs(firsts, key, bits, most).select("a", "b"))
    open_ = cut(pairs.select(F.col("b").alias("id")).distinct())
    stays = cut(pairs.select(F.col("a").alias("id")).distinct().join(open_, "id", "left_anti"))
    gone = None
    while not open_.isEmpty():
        lost = pairs.join(stays.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(open_, "id", "left_semi")
        gone = lost if gone is None else gone.unionByName(lost).distinct()
        gone = cut(gone)
        left = open_.join(gone, "id", "left_anti")
        waiting = pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(stays.withColumnRenamed("id", "a"), "a", "left_anti").select(F.col("b").alias("id")).distinct()
        free = left.join(waiting, "id", "left_anti")
        stays = cut(stays.unionByName(free).distinct())
        open_ = cut(left.join(free, "id", "left_anti"))
    kept = firsts.select(key) if gone is None else firsts.select(key).join(gone.withColumnRenamed("id", key), key, "left_anti")
    return df.join(kept, key, "left_semi")


def estimated_votes(df: DataFrame) -> DataFrame:
    """Up- and downvotes from score and ratio."""
    up = F.when(F.col("upvote_ratio") > 0, F.floor(F.col("score") / F.col("upvote_ratio")).cast("int")).otherwise(0)
    return df.withColumn("estimated_upvotes", up).withColumn("estimated_downvotes", F.col("estimated_upvotes") - F.col("score"))


def about(coin: str, text: Column, subreddit: Column) -> Column:
    """Whether a text names the coin or comes from its own forums; forums are compared in lower case, null is neither."""
    pattern, own = COINS[coin.lower()]
    named = F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))
    return named | F.coalesce(F.lower(subreddit).isin(*own), F.lit(False)) if own else named


def coin_filter(df: DataFrame, coin: str, text: str, subreddit: str = "subreddit", blocked: tuple[str, ...] = ()) -> DataFrame:
    """Rows about the coin, less those of blocked forums."""
    rows = df.filter(~F.coalesce(F.lower(subreddit).isin(*[b.lower() for b in blocked]), F.lit(False))) if blocked else df
    return rows.filter(about(coin, F.col(text), F.col(subreddit)))


def coin_mentions(df: DataFrame, text: str, subreddit: str = "subreddit", blocked: tuple[str, ...] = ()) -> DataFrame:
    """A row for every coin that a row is about, named in ``coin``: all coins in one pass."""
    rows = df.filter(~F.coalesce(F.lower(subreddit).isin(*[b.lower() for b in blocked]), F.lit(False))) if blocked else df
    coins = F.array(*[F.when(about(c, F.col(text), F.col(subreddit)), F.lit(c)) for c in COINS])
    return rows.withColumn("coin", F.explode(F.array_compact(coins)))


_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def _listed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """How many words of either list a text holds; words are runs of a to z of the lower-cased text."""
    up, down = frozenset(w.encode() for w in POSITIVE), frozenset(w.encode() for w in NEGATIVE)
    for part in texts:
        found = np.zeros((len(part), 2), np.int64)
        for k, t in enumerate(part):
            words = (t or "").lower().encode().translate(_LETTERS).split()  # of one text at a time
            found[k] = len([*filter(up.__contains__, words)]), len([*filter(down.__contains__, words)])
        yield pd.DataFrame(found, columns=["up", "down"])


def lexicon(text: Column) -> tuple[Column, Column]:
    """(sentiment -1..1, confidence 0.5..1) by counted words: the built-in scorer where no model is plugged in; empty is neutral at 0.5."""
    both = F.pandas_udf(_listed, "up long, down long")(text)
    up, down = both["up"], both["down"]
    return F.signum(up - down), 0.5 + 0.5 * F.coalesce(F.try_divide(F.abs(up - down), up + down), F.lit(0.0))


def score(df: DataFrame, text: str, scorer: Callable[[Column], tuple[Column, Column]] = lexicon) -> DataFrame:
    """Add sentiment and sentiment_confidence. scorer: Column -> two Columns; ``plugged`` makes one of a model."""
    small_batches(df.sparkSession)
    value, sure = scorer(F.coalesce(F.col(text), F.lit("")))
    return df.withColumns({"sentiment": value.cast("double"), "sentiment_confidence": sure})


def plugged(load: Callable[[], Callable[[list[str]], list[tuple[float, float]]]], batch: int = 32) -> Callable[[Column], tuple[Column, Column]]:
    """A scorer for ``score`` around a model: ``load`` runs once a task, what it returns scores up to ``batch`` texts at a time.

    The model gives (sentiment, confidence) a text, in order. It never sees null or empty texts: those are neutral at 0.5, and
    so is a text of a batch for which it raises ValueError; a model that gives another number of results is an error.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for part in texts:
            out = np.tile([0.0, 0.5], (len(part), 1))
            some = [k for k, t in enumerate(part) if t]
            for at in range(0, len(some), batch):
                model = model or load()
                own = some[at : at + batch]
                try:
                    told = model([part.iloc[k] for k in own])
                except ValueError:
                    continue
                if len(told) != len(own):
                    raise RuntimeError(f"{len(own)} texts, {len(told)} scores")
                out[own] = told
            yield pd.DataFrame(out, columns=["sentiment", "confidence"])

    def scorer(text: Column) -> tuple[Column, Column]:
        both = F.pandas_udf(run, "sentiment double, confidence double")(text)
        return both["sentiment"], both["confidence"]

    return scorer


HOURLY = ("sentiment_confidence", "emoji_count", "caps_ratio", "punct_intensity", "spam_score", "token_count")


def hourly_sentiment(df: DataFrame, time: str = "post_time", key: str = "post_id", by: tuple[str, ...] = ()) -> DataFrame:
    """A row an hour: mean and population deviation of sentiment, means of the features, count."""
    return df.groupBy(*by, F.window(time, "1 hour")["start"].alias("time_window")).agg(
        F.avg("sentiment").alias("mean_sentiment"), F.stddev_pop("sentiment").alias("std_sentiment"), *[F.avg(c).alias(f"{c}_mean") for c in HOURLY], F.count(key).alias(f"{key}_count")
    )
