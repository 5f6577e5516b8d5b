"""Smoothings that remember everything, over series that are split among tasks.

y' = (1 - k) y + k x is an affine step, and steps compose: a chunk of a series is one step
y' = p y + q whatever came before it.  So a series is cut at fixed times, each chunk gives
its (p, q) as an ordinary aggregate, a scan over the chunks of a series (one row each) gives
what every chunk begins with, and in a second pass each chunk fills in its rows on its own.
A single series spreads over as many tasks as it has chunks.

Row numbers are found the same way: rows of a chunk are counted, counts are added up over
the chunks.  Seeds are as for the one-pass kernels: the mean of the first n values that are
not null (a later null makes what follows null, as there).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.scratch import settle

DAY = 86_400
STEP = 64  # rows that one matrix product fills in


@dataclass(frozen=True)
class Smoothing:
    """y' = y + k (x - y) from the mean of n values on; ``late``: the seed ends so many rows later than it could."""

    x: str
    n: int
    k: float
    late: int = 0


def chunk_of(time: str, width: int) -> Column:
    """The number of a time's stretch of ``width`` seconds (a divisor or multiple of a day) since 1970."""
    t = F.col(time).cast("timestamp_ntz")
    seconds = F.datediff(t, F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.floor(seconds / width).cast("long")


def number(df: DataFrame, keys: tuple[str, ...] = ("symbol",), time: str = "datetime", width: int = DAY) -> DataFrame:
    """Add __chunk and __n, the row's place in its series from 0 on; the rows are written, since each smoothing reads them several times."""
    rows = df.withColumn("__chunk", chunk_of(time, width))
    counts = rows.groupBy(*keys, "__chunk").agg(F.count("*").alias("__rows"))
    along = Window.partitionBy(*keys).orderBy("__chunk")  # a row a chunk
    before = counts.select(*keys, "__chunk", (F.sum("__rows").over(along) - F.col("__rows")).alias("__before"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(time)
    numbered = rows.withColumn("__n", F.row_number().over(inside) - 1).join(before, [*keys, "__chunk"])
    return settle(numbered.withColumn("__n", F.col("__n") + F.col("__before")).drop("__before"))


def lag(numbered: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add each column's value of the row before: out -> column."""
    own = Window.partitionBy(*keys, "__chunk").orderBy("__n")
    last = numbered.groupBy(*keys, "__chunk").agg(F.max_by(F.struct(*columns.values()), "__n").alias("__end"))
    along = Window.partitionBy(*keys).orderBy("__chunk")
    before = last.select(*keys, "__chunk", F.lag("__end").over(along).alias("__end"))
    first = F.row_number().over(own) == 1
    met = numbered.join(before, [*keys, "__chunk"])
    return met.withColumns({out: F.when(first, F.col(f"__end.{c}")).otherwise(F.lag(c).over(own)) for out, c in columns.items()}).drop("__end")


def recur(x: np.ndarray, k: float, y: float) -> np.ndarray:
    """y' = (1 - k) y + k x from y on, a block of rows a product: powers stay within a block, so nothing overflows."""
    a, out = 1.0 - k, np.empty(len(x))
    place = np.arange(STEP)
    power = np.where(place[:, None] >= place, a ** np.maximum(place[:, None] - place, 0), 0.0) * k
    carry = a ** (place + 1)
    for s in range(0, len(x), STEP):
        part = x[s : s + STEP]
        m = len(part)
        out[s : s + m] = power[:m, :m] @ part + carry[:m] * y
        y = out[s + m - 1]
    return out


def smooth(numbered: DataFrame, wanted: dict[str, Smoothing], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add the smoothings (out -> Smoothing) to rows of ``number``, and write them; all share two passes over the chunks."""
    keys = tuple(keys)
    names = list(wanted)
    seen = numbered.groupBy(*keys).agg(*[F.min(F.when(F.col(w.x).isNotNull(), F.col("__n"))).alias(f"__f{j}") for j, w in enumerate(wanted.values())])
    at = lambda j, w: F.col(f"__f{j}") + (w.n - 1 + w.late)
    rows = numbered.join(seen, list(keys))
    mean = lambda j, w: F.avg(F.when((F.col("__n") <= at(j, w)) & (F.col("__n") > at(j, w) - w.n), F.col(w.x)))
    seeds = rows.groupBy(*keys).agg(*[F.max(at(j, w)).alias(f"__at{j}") for j, w in enumerate(wanted.values())], *[mean(j, w).alias(f"__seed{j}") for j, w in enumerate(wanted.values())])
    rows = numbered.join(seeds, list(keys))
    # a chunk as one step: each row's share of the chunk's last value
    ends = numbered.groupBy(*keys, "__chunk").agg(F.max("__n").alias("__last"), F.min("__n").alias("__begin"))
    parts = rows.join(ends, [*keys, "__chunk"])
    made = []
    for j, w in enumerate(wanted.values()):
        a, place = 1.0 - w.k, F.col("__last") - F.col("__n")
        share = F.when(F.col("__n") == F.col(f"__at{j}"), F.col(f"__seed{j}")).when(F.col("__n") > F.col(f"__at{j}"), w.k * F.col(w.x))
        made.append(F.sum(share * F.pow(F.lit(a), place)).alias(f"__q{j}"))
        made.append(F.first(F.when(F.col("__begin") > F.col(f"__at{j}"), F.pow(F.lit(a), F.col("__last") - F.col("__begin") + 1)).otherwise(0.0)).alias(f"__p{j}"))
        made.append(F.max((F.col(w.x).isNull() & (F.col("__n") > F.col(f"__at{j}"))).cast("int")).alias(f"__gap{j}"))
    steps = parts.groupBy(*keys, "__chunk").agg(*made)
    carried = T.StructType([*[numbered.schema[k] for k in keys], T.StructField("__chunk", T.LongType()), *[T.StructField(f"__y{j}", T.DoubleType()) for j in range(len(names))]])

    def scan(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("__chunk")
        out = {**{k: chunks[k] for k in keys}, "__chunk": chunks["__chunk"]}
        for j in range(len(names)):
            y, begun, ys = float("nan"), False, []
            for p, q, gap in zip(chunks[f"__p{j}"], chunks[f"__q{j}"], chunks[f"__gap{j}"], strict=True):
                ys.append(y)
                if pd.notna(q):
                    y, begun = (p * y if begun else 0.0) + q, True
                if gap:
                    y, begun = float("nan"), True
            out[f"__y{j}"] = ys
        return pd.DataFrame(out)

    carry = steps.groupBy(*keys).applyInPandas(scan, carried)
    smoothings = list(wanted.values())
    schema = T.StructType([*numbered.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__n").reset_index(drop=True)
        n = part["__n"].to_numpy()
        for j, (name, w) in enumerate(zip(names, smoothings, strict=True)):
            y, at_, x = np.full(len(n), np.nan), part[f"__at{j}"].iloc[0], part[w.x].to_numpy(float)
            if pd.notna(at_):
                start = int(np.searchsorted(n, at_))
                if start < len(n) and n[start] == at_:
                    y[start] = part[f"__seed{j}"].iloc[0]
                    y[start + 1 :] = recur(x[start + 1 :], w.k, y[start])
                elif start == 0:
                    y = recur(x, w.k, part[f"__y{j}"].iloc[0])
            part[name] = pd.Series(y).where(np.isfinite(y), None).astype("Float64")
        return part[[f.name for f in schema.fields]]

    return settle(rows.join(carry, [*keys, "__chunk"]).groupBy(*keys, "__chunk").applyInPandas(fill, schema))


def done(df: DataFrame) -> DataFrame:
    return df.drop("__chunk", "__n")


def ema(n: int, x: str = "close", late: int = 0) -> Smoothing:
    return Smoothing(x, n, 2.0 / (n + 1), late)


def wilder(n: int, x: str) -> Smoothing:
    return Smoothing(x, n, 1.0 / n)


def emas(bars: DataFrame, n: int = 30, times: int = 1, x: str = "close", keys: tuple[str, ...] = ("symbol",), time: str = "datetime", width: int = DAY) -> DataFrame:
    """Add ema, and dema and tema for ``times`` 2 and 3: each is a scan over the one before."""
    rows = number(bars, keys, time, width)
    for k in range(1, times + 1):
        rows = smooth(rows, {f"__e{k}": ema(n, x if k == 1 else f"__e{k - 1}")}, keys)
    e = [F.col(f"__e{k}") for k in range(1, times + 1)]
    made = {"ema": e[0]} | ({"dema": 2 * e[0] - e[1]} if times > 1 else {}) | ({"tema": 3 * e[0] - 3 * e[1] + e[2]} if times > 2 else {})
    return done(rows.withColumns(made).drop(*[f"__e{k}" for k in range(1, times + 1)]))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close", keys: tuple[str, ...] = ("symbol",), time: str = "datetime", width: int = DAY) -> DataFrame:
    """Add macd, macd_signal and macd_hist; both averages are seeded where the slow one is, all lines start with the signal."""
    rows = smooth(number(bars, keys, time, width), {"__fast": ema(fast, x, slow - fast), "__slow": ema(slow, x)}, keys).withColumn("__line", F.col("__fast") - F.col("__slow"))
    rows = smooth(rows, {"macd_signal": ema(signal, "__line")}, keys)
    line = F.when(F.col("macd_signal").isNotNull(), F.col("__line"))
    return done(rows.withColumn("macd", line).withColumn("macd_hist", line - F.col("macd_signal")).drop("__fast", "__slow", "__line"))


def rsi(bars: DataFrame, n: int = 14, x: str = "close", keys: tuple[str, ...] = ("symbol",), time: str = "datetime", width: int = DAY) -> DataFrame:
    """Add rsi: Wilder's means of rises and falls."""
    rows = lag(number(bars, keys, time, width), {"__x": x}, keys).withColumn("__d", F.col(x) - F.col("__x"))
    rows = rows.withColumns({"__up": F.greatest("__d", F.lit(0.0)), "__down": F.greatest(-F.col("__d"), F.lit(0.0))}).withColumns({c: F.when(F.col("__d").isNotNull(), F.col(c)) for c in ("__up", "__down")})
    rows = smooth(rows, {"__u": wilder(n, "__up"), "__w": wilder(n, "__down")}, keys)
    both = F.col("__u") + F.col("__w")
    return done(rows.withColumn("rsi", F.when(both.isNotNull(), F.when(both == 0, 0.0).otherwise(100 * F.try_divide(F.col("__u"), both)))).drop("__x", "__d", "__up", "__down", "__u", "__w"))


def atr(bars: DataFrame, n: int = 14, keys: tuple[str, ...] = ("symbol",), time: str = "datetime", width: int = DAY) -> DataFrame:
    """Add atr: Wilder's mean of the true range."""
    rows = lag(number(bars, keys, time, width), {"__c": "close"}, keys)
    rows = rows.withColumn("__tr", F.when(F.col("__c").isNotNull(), F.greatest("high", "__c") - F.least("low", "__c")))
    return done(smooth(rows, {"atr": wilder(n, "__tr")}, keys).drop("__c", "__tr"))
