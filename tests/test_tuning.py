"""Search that stops trials: fewer backtests, the same winner; a sampler that closes in."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barflow.operators import tuning as U
from barflow.operators.backtest import Rules

START = dt.datetime(2024, 1, 1)
RULES = Rules(take_profit=2.0, stop_loss=2.0, fee=0.01)


@pytest.fixture(scope="module")
def market(spark):
    """A price that follows the score two bars earlier: the larger the share of trusted scores, the more profit."""
    rng, price, bars, scores = random.Random(2), 100.0, [], []
    for k in range(400):
        x = rng.gauss(0, 1)
        scores.append(("s", START + dt.timedelta(hours=k), x))
        for m in range(3):
            o = price
            price *= 1 + 0.002 * x + rng.gauss(0, 0.0003)
            bars.append(("s", START + dt.timedelta(hours=k, minutes=20 * m), o, max(o, price), min(o, price), price))
    return spark.createDataFrame(scores, "symbol string, datetime timestamp_ntz, x double"), spark.createDataFrame(bars, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double")


def predictor(scores, seen):
    def predict(trials):
        seen.append(trials.count())
        score = F.col("x") * F.col("weight")
        return scores.join(F.broadcast(trials), F.lit(True)).select("trial", "symbol", "datetime", U.sign_beyond(score, F.col("limit")).alias("signals"))

    return predict


def test_halving(spark, market):
    scores, bars = market
    trials = U.grid(spark, limit=[0.1, 0.5, 1.0, 2.5], weight=[1.0, -1.0])
    seen, every = [], []
    full = {r.trial: r.pnl for r in U.search(trials, predictor(scores, every), bars, 3, RULES).collect()}
    got = U.halving(trials, predictor(scores, seen), bars, 3, 0.5, RULES).collect()
    assert seen == [8, 4, 2] and sum(seen) < 3 * 8
    assert [r.rank for r in got] == list(range(1, 9)) and [r.steps for r in got] == [3, 3, 2, 2, 1, 1, 1, 1]
    assert all(r.pruned == (r.steps < 3) for r in got)
    assert got[0].trial == max(full, key=lambda t: (full[t], -t))
    assert all(r.pnl == pytest.approx(full[r.trial], abs=1e-6) for r in got if not r.pruned)
    assert U.halving(trials.limit(0), predictor(scores, []), bars, 3, 0.5, RULES).count() == 0


def test_sampler():
    goal = {"a": 0.2, "b": 7.0}
    value = lambda p: -((p["a"] - goal["a"]) ** 2) - ((p["b"] - goal["b"]) / 10) ** 2 - (p["c"] != "y")
    sampler = U.Sampler({"a": (0.0, 1.0), "b": (0.0, 10.0), "c": ["x", "y", "z"]})
    early = None
    for _ in range(12):
        for p in sampler.draw(8):
            assert 0 <= p["a"] <= 1 and 0 <= p["b"] <= 10 and p["c"] in "xyz"
            sampler.tell(p, value(p))
        early = early or sum(v for _, v in sampler.seen) / 8
    late = [v for _, v in sampler.seen[-32:]]
    assert sum(late) / len(late) > early / 2 and max(v for _, v in sampler.seen) > -0.01
    again = U.Sampler({"a": (0.0, 1.0), "b": (0.0, 10.0), "c": ["x", "y", "z"]})
    assert again.draw(3) == U.Sampler(again.space).draw(3)


def test_tune(spark, market):
    scores, bars = market
    seen = []
    got = U.tune(spark, U.Sampler({"limit": (0.0, 3.0), "weight": (-1.0, 1.0)}, first=4), predictor(scores, seen), bars, rounds=2, batch=4, chunks=2, rules=RULES).collect()
    assert seen == [4, 2, 4, 2] and [r["rank"] for r in got] == list(range(1, 9))
    assert got[0].weight > 0 and got[0].steps == 2 and {r.trial for r in got} == set(range(8))
