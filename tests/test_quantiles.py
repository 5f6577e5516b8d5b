"""Quantiles by refinement against Spark's own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barflow.operators.quantiles import exact_quantiles

P = [0.0, 0.05, 0.25, 0.5, 0.85, 0.999, 1.0]


def values(kind, n=3000):
    rng = random.Random(kind)
    draw = {
        "normal": lambda: rng.gauss(0, 1),
        "ties": lambda: float(rng.choice([1, 1, 1, 2, 3])),
        "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300),
        "near": lambda: 1.0 + rng.randrange(50) * 2.0**-52,
        "infinite": lambda: rng.choice([math.inf, -math.inf, 0.0, 1.5, -2.5]),
        "nan": lambda: rng.choice([math.nan, 1.0, 2.0, None]),
        "one": lambda: 7.25,
    }[kind]
    return [draw() for _ in range(n)]


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "near", "infinite", "nan", "one"])
def test_equals_percentile(spark, kind):
    df = spark.createDataFrame([(x, None if k % 3 else x) for k, x in enumerate(values(kind))], "x double, y double").repartition(4)
    got = exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, P)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, P))).alias(c) for c in "xy"]).first()
    for c in "xy":
        assert [repr(v) for v in got[c]] == [repr(v) for v in want[c]] or got[c] == pytest.approx(list(want[c]), nan_ok=True, rel=1e-15)


def test_few(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 4.0)], "x double, y double")
    assert exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, [0.5, 1.0]) == {"x": [None, None], "y": [3.5, 4.0]}
    assert exact_quantiles(df.limit(0), {"y": F.col("y")}, [0.5]) == {"y": [None]}
