"""Exact quantiles by histogram refinement: no task holds more than a histogram.

A quantile is a value of a known rank (or lies between two).  Values are counted in ranges
between the least and the largest; the range that holds the rank is counted again in ranges
between its own least and largest value, and so on until one value is left.  Counts, least
and largest are ordinary aggregates, combined before they are exchanged; what comes to the
driver is at most RANGES rows a wanted rank and column.  The least and the largest value of a
range never share a range in the next round, so every round gets ahead, however the values lie.

As Spark's ``percentile``: nulls do not count, NaN is the largest value, a position between two
ranks is interpolated; without a value the quantile is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.scratch import settle

RANGES = 1024


def _range_of(x: Column, low: float, high: float) -> Column:
    part = (x - F.lit(low)) / (F.lit(high) - F.lit(low)) * (RANGES - 2)
    inner = F.when(F.isnan(part), F.lit(RANGES // 2)).otherwise(F.least(F.greatest(F.floor(part) + 1, F.lit(1)), F.lit(RANGES - 2)))
    return F.when(x == low, 0).when(x == high, RANGES - 1).otherwise(inner).cast("int")


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column (name -> expression), in the order of ``probabilities``."""
    rows = settle(df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns.values())]))
    ns = range(len(columns))
    real = lambda k: F.when(~F.isnan(f"c{k}"), F.col(f"c{k}"))
    first = rows.agg(*[F.count(f"c{k}").alias(f"n{k}") for k in ns], *[F.count(real(k)).alias(f"m{k}") for k in ns], *[F.min(real(k)).alias(f"a{k}") for k in ns], *[F.max(real(k)).alias(f"b{k}") for k in ns]).first()
    ranks, value, open_ = {}, {}, []
    for k in ns:
        n, m = first[f"n{k}"], first[f"m{k}"]
        ranks[k] = [(p * (n - 1), math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in probabilities] if n else []
        wanted = sorted({r for _, lo, hi in ranks[k] for r in (lo, hi)})
        value |= {(k, r): math.nan for r in wanted if r >= m}
        if inside := [r for r in wanted if r < m]:
            open_.append((k, first[f"a{k}"], first[f"b{k}"], 0, inside))
    while open_:
        for k, low, high, _, inside in open_:
            if low == high:
                value |= {(k, r): low for r in inside}
        open_ = [w for w in open_ if w[1] != w[2]]
        if not open_:
            break
        cells = []
        for j, (k, low, high, _, _) in enumerate(open_):
            x = F.col(f"c{k}")
            cells.append(F.when((x >= low) & (x <= high) & ~F.isnan(x), F.struct(F.lit(j).alias("w"), _range_of(x, low, high).alias("r"), x.alias("x"))))
        told = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).groupBy("s.w", "s.r").agg(F.count("*").alias("n"), F.min("s.x").alias("low"), F.max("s.x").alias("high"))
        by: dict[int, list] = {}
        for t in told.collect():  # at most RANGES a window
            by.setdefault(t.w, []).append((t.r, t.n, t.low, t.high))
        new = []
        for j, (k, _, _, below, inside) in enumerate(open_):
            for _, n, low, high in sorted(by[j]):
                if here := [r for r in inside if below <= r < below + n]:
                    new.append((k, low, high, below, here))
                below += n
        open_ = new
    between = lambda k, at, lo, hi: value[k, lo] if lo == hi or value[k, lo] == value[k, hi] else (hi - at) * value[k, lo] + (at - lo) * value[k, hi]
    return {name: [between(k, *x) for x in ranks[k]] or [None] * len(probabilities) for k, name in enumerate(columns)}
