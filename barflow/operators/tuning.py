"""Evaluation by profit: prefixes of a series, searched parameters, permuted features; many variants are one backtest job."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.backtest import Rules, backtest, shuffled

SEPARATOR = "\x1f"


def profits(signals: DataFrame, bars: DataFrame, variant: list[str], rules: Rules = Rules(), signal: str = "signals", version: int = 2, buckets: int = 1) -> DataFrame:
    """(variant columns as text, strategy, symbol, pnl): the sum of a ledger for every variant of every strategy; no trade is 0."""
    name = F.concat_ws(SEPARATOR, "strategy", *[F.col(v).cast("string") for v in variant])
    named = signals.select(name.alias("strategy"), "symbol", "datetime", signal)
    ledger = backtest(named, bars, rules, signal, version, buckets)
    last = ledger.groupBy("strategy", "symbol").agg(F.max_by("pnl_sum", "event").alias("pnl"))
    whole = named.select("strategy", "symbol").distinct().join(last, ["strategy", "symbol"], "left")
    parts = F.split("strategy", SEPARATOR)
    return whole.select(*[F.get(parts, F.lit(k + 1)).alias(v) for k, v in enumerate(variant)], F.get(parts, F.lit(0)).alias("strategy"), "symbol", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


def chunked(signals: DataFrame, bars: DataFrame, chunks: int = 2, rules: Rules = Rules(take_profit=3.0, stop_loss=1.0), signal: str = "signals") -> DataFrame:
    """(chunk from 0, strategy, symbol, pnl): the profit of the first (chunk + 1) / chunks of each series' signals."""
    own = Window.partitionBy("strategy", "symbol")
    placed = signals.withColumns({"__n": F.row_number().over(own.orderBy("datetime")), "__all": F.count("*").over(own)})
    every = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    prefix = every.filter(F.expr(f"__n <= (chunk + 1) * __all div {int(chunks)}"))
    return profits(prefix, bars, ["chunk"], rules, signal, buckets=chunks).withColumn("chunk", F.col("chunk").cast("int"))


def prefix_profits(signals: DataFrame, bars: DataFrame, step: int, chunks: int, rules: Rules, signal: str = "signals", buckets: int = 1) -> DataFrame:
    """(strategy, symbol, pnl) of the first (step + 1) / chunks of each series' signals, and of nothing else."""
    own = Window.partitionBy("strategy", "symbol")
    placed = signals.withColumns({"__n": F.row_number().over(own.orderBy("datetime")), "__all": F.count("*").over(own)})
    return profits(placed.filter(F.expr(f"__n <= ({int(step)} + 1) * __all div {int(chunks)}")), bars, [], rules, signal, buckets=buckets)


def halving(trials: DataFrame, predict: Callable[[DataFrame], DataFrame], bars: DataFrame, chunks: int = 3, keep: float = 0.5, rules: Rules = Rules(take_profit=3.0, stop_loss=1.0), buckets: int = 1) -> DataFrame:
    """(trial, pnl, steps, pruned, rank): successive halving by profit.

    Step by step the trials that are left are backtested on a longer prefix of their signals, one job a step; the better ``keep`` of
    them go on, the others stop: they are neither predicted nor backtested again.  pnl is that of a trial's last step; trials that
    came further rank first, then by profit, ties to the smaller trial.  What comes to the driver is a row a trial.
    """
    left, told = trials, {}
    for step in range(chunks):
        made = predict(left).withColumn("strategy", F.col("trial").cast("string"))
        found = prefix_profits(made, bars, step, chunks, rules, buckets=buckets).groupBy(F.col("strategy").cast("long").alias("trial")).agg(F.sum("pnl").alias("pnl"))
        rows = sorted(left.select("trial").join(found, "trial", "left").na.fill(0.0, ["pnl"]).collect(), key=lambda r: (-r.pnl, r.trial))
        told |= {r.trial: (float(r.pnl), step + 1) for r in rows}
        best = [r.trial for r in rows[: max(1, math.ceil(len(rows) * keep))]]
        left = left.filter(F.col("trial").isin(best))
        if not best:
            break
    order = sorted(told, key=lambda t: (-told[t][1], -told[t][0], t))
    rows = [(t, told[t][0], told[t][1], told[t][1] < chunks, k) for k, t in enumerate(order, 1)]
    return trials.sparkSession.createDataFrame(rows, "trial long, pnl double, steps int, pruned boolean, rank int")


@dataclass
class Sampler:
    """Draws parameters where good trials lie denser than bad ones (tree-structured Parzen estimates, each parameter by itself).

    space: name -> (low, high), or a list of choices.  The first draws are even; later ones come from a mixture of normals around
    the best tenth of what was told so far, the candidate with the best ratio of that density to the others' is taken.
    """

    space: dict[str, tuple[float, float] | list]
    seed: int = 7
    first: int = 8
    candidates: int = 4
    seen: list[tuple[dict, float]] = field(default_factory=list)

    def tell(self, params: dict, value: float) -> None:
        self.seen.append((params, value))

    def draw(self, n: int) -> list[dict]:
        rng = np.random.default_rng((self.seed, len(self.seen)))
        ranked = [p for p, _ in sorted(self.seen, key=lambda x: -x[1])]
        cut = max(2, math.ceil(len(ranked) / 10))
        return [{name: self._one(rng, name, [p[name] for p in ranked[:cut]], [p[name] for p in ranked[cut:]]) for name in self.space} for _ in range(n)]

    def _one(self, rng, name: str, good: list, bad: list):
        among = self.space[name]
        even = len(self.seen) < self.first or not bad
        if isinstance(among, list):
            if even:
                return among[rng.integers(len(among))]
            weight = np.array([(1 + good.count(c)) / (len(good) + len(among)) for c in among])
            other = np.array([(1 + bad.count(c)) / (len(bad) + len(among)) for c in among])
            drawn = rng.choice(len(among), self.candidates, p=weight / weight.sum())
            return among[max(drawn.tolist(), key=lambda c: weight[c] / other[c])]
        low, high = among
        if even:
            return float(rng.uniform(low, high))
        width = (high - low) / (1 + len(self.seen)) ** 0.5 / 2
        density = lambda x, xs: (np.exp(-0.5 * ((x[:, None] - np.array(xs)) / width) ** 2).sum(axis=1) / width / 2.5 + 1 / (high - low)) / (len(xs) + 1)
        x = rng.normal(rng.choice(good, self.candidates), width)
        x = np.where((x < low) | (x > high), rng.uniform(low, high, self.candidates), x)
        return float(x[np.argmax(density(x, good) / density(x, bad))])


def tune(spark, sampler: Sampler, predict: Callable[[DataFrame], DataFrame], bars: DataFrame, rounds: int = 4, batch: int = 8, chunks: int = 2, keep: float = 0.5, rules: Rules = Rules(take_profit=3.0, stop_loss=1.0), buckets: int = 1) -> DataFrame:
    """(trial, parameters, pnl, steps, rank): rounds of drawn trials, each round halved in one job a step, then told to the sampler.

    Only trials that ran to the end are told with their profit; those that were given up count as worse than all of these.
    """
    names, done = list(sampler.space), []
    for k in range(rounds):
        drawn = sampler.draw(batch)
        rows = [(k * batch + j, *[p[n] for n in names]) for j, p in enumerate(drawn)]
        trials = spark.createDataFrame(rows, ["trial", *names])
        got = {r.trial: r for r in halving(trials, predict, bars, chunks, keep, rules, buckets).collect()}
        floor = min(r.pnl for r in got.values()) - 1.0
        for t, *values in rows:
            sampler.tell(dict(zip(names, values, strict=True)), floor if got[t].pruned else got[t].pnl)
            done.append((t, *values, got[t].pnl, got[t].steps))
    order = sorted(done, key=lambda r: (-r[-1], -r[-2], r[0]))
    return spark.createDataFrame([(*r, n) for n, r in enumerate(order, 1)], ["trial", *names, "pnl", "steps", "rank"])


def median_pruned(reports: DataFrame, trial: str = "trial", step: str = "chunk", value: str = "pnl", warm: int = 1) -> DataFrame:
    """reports with ``pruned``: from step ``warm`` on, once the best value of a trial so far is below the median of the values reported at that step."""
    best = F.max(value).over(Window.partitionBy(trial).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    medians = reports.groupBy(step).agg(F.median(value).alias("__median"))
    met = reports.withColumn("__best", best).join(medians, step)
    bad = (F.col(step) >= warm) & (F.col("__best") < F.col("__median"))
    return met.withColumn("pruned", F.max(bad).over(Window.partitionBy(trial).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))).drop("__best", "__median")


def search(trials: DataFrame, predict: Callable[[DataFrame], DataFrame], bars: DataFrame, chunks: int = 2, rules: Rules = Rules(take_profit=3.0, stop_loss=1.0)) -> DataFrame:
    """(trial, pnl, pruned, rank): hyper-parameter search by profit.

    trials: one row a trial with its parameters; predict: trials -> (trial, symbol, datetime, signals).  All trials are
    evaluated in one job, so pruning tells what would have been given up and orders those last; ties go to the smaller trial.
    ``halving`` and ``tune`` stop trials between jobs instead.
    """
    made = predict(trials).withColumn("strategy", F.col("trial").cast("string"))
    steps = chunked(made, bars, chunks, rules).groupBy(F.col("strategy").cast("long").alias("trial"), "chunk").agg(F.sum("pnl").alias("pnl"))
    told = median_pruned(steps).filter(F.col("chunk") == chunks - 1)
    return told.select("trial", "pnl", "pruned", F.row_number().over(Window.orderBy("pruned", F.desc("pnl"), "trial")).alias("rank"))  # a row a trial


def pnl_importance(rows: DataFrame, features: list[str], predict: Callable[[DataFrame], DataFrame], bars: DataFrame, repeats: int = 3, seed: int = 7, rules: Rules = Rules(take_profit=3.0, stop_loss=1.0), order: tuple[str, ...] = ("symbol", "datetime")) -> DataFrame:
    """(feature, pnl_drop): how much profit shuffling a feature costs on average, those that hurt only, largest first.

    predict: rows -> rows with ``signals``; it is applied to the rows as they are and to each (feature, repeat) with that
    feature dealt anew, and all of these are backtested in one job.
    """
    base = rows.select(F.lit("").alias("feature"), F.lit(0).alias("repeat"), *rows.columns)
    every = base.unionByName(shuffled(rows, features, repeats, seed, order))
    made = predict(every).withColumn("strategy", F.lit("model"))
    total = profits(made, bars, ["feature", "repeat"], rules, buckets=min(32, len(features) * repeats + 1)).groupBy("feature", "repeat").agg(F.sum("pnl").alias("pnl"))
    means = total.groupBy("feature").agg(F.avg("pnl").alias("pnl"))
    one = means.filter("feature = ''").select(F.col("pnl").alias("base"))
    drop = means.filter("feature <> ''").join(F.broadcast(one), F.lit(True)).select("feature", F.round(F.col("base") - F.col("pnl"), 9).alias("pnl_drop"))  # one row
    return drop.filter("pnl_drop > 0").orderBy(F.desc("pnl_drop"), "feature")


def grid(spark, **values: list) -> DataFrame:
    """All combinations of parameter values as trials, numbered in order."""
    import itertools

    names = list(values)
    rows = [(k, *map(float, combo)) for k, combo in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, ", ".join(["trial long", *[f"{n} double" for n in names]]))


def sign_beyond(x: Column, limit: Column) -> Column:
    return F.when(x > limit, 1).when(x < -limit, -1).otherwise(0)
