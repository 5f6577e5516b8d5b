"""Fitted models on data whose answer is known."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import predict as M

START = dt.datetime(2024, 1, 1)


def frame(spark, columns, names="xy"):
    rows = [("s", START + dt.timedelta(hours=k), *map(float, v)) for k, v in enumerate(zip(*columns, strict=True))]
    return spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, " + ", ".join(f"{c} double" for c in names[: len(columns)]))


def arma(n, ar, ma, seed=0, constant=0.5):
    rng, x, e = np.random.default_rng(seed), [0.0] * 5, [0.0] * 5
    for _ in range(n):
        e.append(rng.normal())
        x.append(constant + sum(a * x[-k] for k, a in enumerate(ar, 1)) + e[-1] + sum(b * e[-1 - k] for k, b in enumerate(ma, 1)))
    return np.array(x[200:]), np.array(e[200:])


def test_arma_is_found():
    x, e = arma(20_000, [0.5, -0.3], [0.4])
    beta, shocks = M.hannan_rissanen(x[:, None], 2, 1)
    assert beta.ravel() == pytest.approx([0.5, 0.5, -0.3, 0.4], abs=0.05)
    assert np.corrcoef(shocks[100:, 0], e[100:])[0, 1] > 0.995


def test_vector_arma_is_found():
    rng, a, b = np.random.default_rng(1), np.array([[0.5, 0.2], [-0.1, 0.3]]), np.array([[0.3, 0.0], [0.2, 0.1]])
    x, e = [np.zeros(2)], [np.zeros(2)]
    for _ in range(20_000):
        e.append(rng.normal(size=2))
        x.append(a @ x[-1] + e[-1] + b @ e[-2])
    beta, _ = M.hannan_rissanen(np.array(x), 1, 1)
    assert beta[1:3].T == pytest.approx(a, abs=0.05) and beta[3:].T == pytest.approx(b, abs=0.06)


def test_forecasts(spark):
    """Against the recursion written out, integrated twice; a line and a parabola go on exactly."""
    x, _ = arma(600, [0.6], [0.3], seed=4)
    level = np.cumsum(np.cumsum(x))
    got = [r.x for r in M.arima(frame(spark, [level]), ["x"], 1, 2, 1, 4).orderBy("step").collect()]
    beta, shocks = M.hannan_rissanen(np.diff(level, n=2)[:, None], 1, 1)
    c, a, b = beta.ravel()
    v, e, d1, x1, want = np.diff(level, n=2)[-1], shocks[-1, 0], np.diff(level)[-1], level[-1], []
    for _ in range(4):
        v, e = c + a * v + b * e, 0.0
        d1 += v
        x1 += d1
        want.append(x1)
    assert got == pytest.approx(want, rel=1e-9)
    k = np.arange(60.0)
    both = M.arima(frame(spark, [3 + 2 * k, k * k]), ["x", "y"], 1, 2, 0, 2).orderBy("step").collect()
    assert [(round(r.x, 6), round(r.y, 6)) for r in both] == [(123.0, 3600.0), (125.0, 3721.0)]
    short = M.arima(frame(spark, [k[:3]]), ["x"], 1, 1, 1, 2).collect()
    assert [r.x for r in short] == [2.0, 2.0]


def test_three_classes(spark):
    """Separable rows, a label of three signs; one input is noise, one row has a null."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(1500):
        a, b = rng.uniform(-3, 3), rng.normal()
        rows.append((k, float(a), float(b), -1 if a < -1 else 1 if a > 1 else 0))
    rows.append((9999, None, 0.0, 1))
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = M.boosted_classes(df.filter("id % 4 <> 3"), ["a", "b"], "y", F.col("id") % 4 == 2, maxIter=10, maxDepth=3)
    got = model.transform(df).collect()
    tested = [r for r in got if r.id % 4 == 3 and r.a is not None]
    assert model.classes == [-1, 0, 1] and len(got) == len(rows)
    assert sum(r.prediction == r.y for r in tested) / len(tested) > 0.97
    assert all(r["p_-1"] + r.p_0 + r.p_1 == pytest.approx(1.0) for r in tested)
    assert [r.prediction for r in got if r.a is None] == [None]


def test_chances_are_calibrated(spark):
    """Labels drawn with a known chance: what is told for them is about that chance."""
    rng = np.random.default_rng(3)
    rows = [(k, float(a), int(rng.random() < (0.2 if a < 0 else 0.7))) for k, a in enumerate(rng.uniform(-1, 1, 4000))]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    model = M.boosted_classes(df.filter("id % 4 <> 3"), ["a"], "y", F.col("id") % 4 == 2, maxIter=10, maxDepth=2)
    low, high = (model.transform(df.filter("id % 4 = 3").filter(c)).agg(F.avg("p_1")).first()[0] for c in ("a < 0", "a >= 0"))
    assert low == pytest.approx(0.2, abs=0.06) and high == pytest.approx(0.7, abs=0.06)


def test_trees_on_separable_rows(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), float(a + b > 0)) for a, b in rng.uniform(-1, 1, (800, 2))], "a double, b double, y double")
    for kind in ("rf_classifier", "gbt_classifier", "logistic"):
        model = M.trainer(kind, ["a", "b"], "y").fit(df)
        assert model.transform(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.9


def test_autoregression_is_found(spark):
    x, _ = arma(5000, [0.7, -0.2], [], seed=8, constant=1.0)
    got = M.autoregression(frame(spark, [x]), "x", 2, 50).orderBy("step").collect()
    assert got[-1].forecast == pytest.approx(1.0 / 0.5, abs=0.15)
    assert got[0].forecast == pytest.approx(1.0 + 0.7 * x[-1] - 0.2 * x[-2], abs=0.1)


def test_stationarity(spark):
    rng = np.random.default_rng(6)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    got = M.make_stationary(frame(spark, [noise, walk]), ["x", "y"]).orderBy("datetime").collect()
    assert len(got) == 399 and [r.x for r in got] == pytest.approx(noise[1:].tolist()) and [r.y for r in got] == pytest.approx(np.diff(walk).tolist())
