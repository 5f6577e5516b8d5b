"""From model predictions to signals, evaluation, and the small models trained here."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.scratch import settle
from barflow.functions.windows import Series
from barflow.operators.quantiles import exact_quantiles


def _three(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def from_classifier(df: DataFrame, pred: str = "pred", k: float = 0.25, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Beyond mean ± k population deviations."""
    w = Window.partitionBy(*keys)
    m, d = F.avg(pred).over(w), F.stddev_pop(pred).over(w)
    return df.withColumn("signal", _three(F.round(F.col(pred), 9) > F.round(m + k * d, 9), F.round(F.col(pred), 9) < F.round(m - k * d, 9)))


def from_regressor(df: DataFrame, pred: str = "pred", k: float = 1.0, window: int = 20, threshold: float | None = None, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Beyond rolling mean ± k sample deviations (0 counts as 1e-8); with a threshold: beyond ± that."""
    x = F.col(pred)
    if threshold is not None:
        return df.withColumn("signal", _three(x > threshold, x < -threshold))
    w = Series(keys, time).last(window)
    d = F.coalesce(F.nullif(F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(0.0)), F.lit(1e-8))
    m = F.avg(x).over(w)
    return df.withColumn("signal", _three(F.round(x, 9) > F.round(m + k * d, 9), F.round(x, 9) < F.round(m - k * d, 9)))


def from_log_return(df: DataFrame, pred: str = "pred", band: float = 0.0005, k: float = 0.25, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Beyond a dead band; if that silences over 90 % of a series, beyond k population deviations."""
    w = Window.partitionBy(*keys)
    x = F.col(pred)
    silent = F.avg((F.abs(x) <= band).cast("double")).over(w)
    limit = F.when(silent > 0.9, k * F.stddev_pop(x).over(w)).otherwise(F.lit(band))
    return df.withColumn("signal", _three(F.round(x, 9) > F.round(limit, 9), F.round(x, 9) < F.round(-limit, 9)))


def from_price(df: DataFrame, pred: str = "pred", close: str = "close", k: float = 0.25, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Prediction above or below the close by k deviations of that difference."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__e", F.col(pred) - F.col(close))
    d = k * F.stddev_pop("__e").over(w)
    return df.withColumn("signal", _three(F.round("__e", 9) > F.round(d, 9), F.round("__e", 9) < F.round(-d, 9))).drop("__e")


def is_log_return(df: DataFrame, pred: str = "pred") -> DataFrame:
    """One row: whether the median size of the predictions is below 0.05."""
    (median,) = exact_quantiles(df, {"size": F.abs(pred)}, [0.5])["size"]
    return df.sparkSession.range(1).select((F.lit(median).cast("double") < 0.05).alias("is_log_return"))


def from_probability(df: DataFrame, p: str = "p", high: float = 0.55, low: float = 0.45) -> DataFrame:
    return df.withColumn("signal", _three(F.col(p) > high, F.col(p) < low))


def consensus(df: DataFrame, cls: str = "cls", p: str = "p", reg: str = "reg", least: float = 0.55, threshold: float | None = None) -> DataFrame:
    """Long if the class is 1, the regression above the threshold (default: 85th percentile of its size) and p at least 0.55; short mirrored."""
    if threshold is None:
        (threshold,) = exact_quantiles(df, {"size": F.abs(reg)}, [0.85])["size"]
    df = df.withColumn("__limit", F.lit(threshold).cast("double"))
    r = F.round(F.col(reg), 9)
    up = (F.col(cls) == 1) & (r > F.round("__limit", 9)) & (F.col(p) >= least)
    down = (F.col(cls) == 0) & (r < -F.round("__limit", 9)) & (F.round(1 - F.col(p), 9) >= least)
    return df.withColumn("signal", _three(up, down)).drop("__limit")


def regression_metrics(df: DataFrame, pred: str, actual: str, keys: tuple[str, ...] = ()) -> DataFrame:
    e = F.col(pred) - F.col(actual)
    return df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.signum(pred) == F.signum(actual)).cast("double")).alias("directional_accuracy")
    )


def accuracy(df: DataFrame, pred: str, actual: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(pred) == F.col(actual)).cast("double")).alias("accuracy"))


def return_summary(df: DataFrame, signal: str, log_return: str, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Total, mean, deviation, Sharpe and maximum drawdown of signal times return."""
    s = Series(keys, time)
    df = df.withColumn("__r", F.col(signal) * F.col(log_return)).withColumn("__cum", F.sum("__r").over(s.running)).withColumn("__peak", F.max("__cum").over(s.running))
    return df.groupBy(*keys).agg(F.sum("__r").alias("total"), F.avg("__r").alias("mean"), F.stddev_samp("__r").alias("std"), F.try_divide(F.avg("__r"), F.stddev_samp("__r")).alias("sharpe"), F.min(F.col("__cum") - F.col("__peak")).alias("max_drawdown"))


# MacKinnon's 5 % surface for a constant, no trend: c + c1 / n + c2 / n^2.
_ADF_5 = (-2.86154, -2.8903, -4.234)


def adf_statistic(x: np.ndarray, lags: int | None = None) -> tuple[float, bool]:
    """(t of the level in the Dickey-Fuller regression with a constant, stationary at 5 %); under 20 values count as stationary."""
    x = x[np.isfinite(x)]
    if len(x) < 20 or np.ptp(x) == 0:
        return float("nan"), True
    most = lags if lags is not None else min(int(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 3)
    d, best = np.diff(x), None
    for p in range(most + 1) if lags is None else (lags,):
        y = d[most:]
        a = np.column_stack([x[most:-1], np.ones(len(y)), *[d[most - k : len(d) - k] for k in range(1, p + 1)]])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rss = float(((y - a @ beta) ** 2).sum())
        aic = len(y) * np.log(max(rss / len(y), 1e-300)) + 2 * a.shape[1]
        if best is None or aic < best[0]:
            cov = rss / max(len(y) - a.shape[1], 1) * np.linalg.pinv(a.T @ a)
            best = (aic, float(beta[0] / np.sqrt(max(cov[0, 0], 1e-300))), len(y))
    c, c1, c2 = _ADF_5
    return best[1], best[1] < c + c1 / best[2] + c2 / best[2] ** 2


# Inputs that are bounded or whole by their making, and are never differenced; so is every pattern (CDL...).
BOUNDED = (
    "datetime target future_close rsi_14 mfi_14 cci_14 willr_14 stoch_k stoch_d stochf_k stochf_d stochrsi_k stochrsi_d aroon_up aroon_down aroonosc adx_14 adxr_14 dx_14 bop "
    "rsi mfi cci willr stoch stochf stochrsi aroon adx adxr dx"
).split()


def may_wander(columns: list[str]) -> list[str]:
    """The columns that a test of stationarity is for: no bounded oscillators, patterns, stamps or targets."""
    return [c for c in columns if c.lower() not in BOUNDED and not c.upper().startswith("CDL")]


def make_stationary(df: DataFrame, columns: list[str], most: int = 2, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """Difference each column of a series up to ``most`` times until the test holds, but for those that cannot wander (``may_wander``); rows with gaps go."""
    wander = may_wander(columns)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time)
        for c in wander:
            for _ in range(most):
                if adf_statistic(rows[c].to_numpy(float))[1]:
                    break
                rows[c] = rows[c].diff()
        return rows.dropna(subset=columns)

    return df.withColumns({c: F.col(c).cast("double") for c in columns}).groupBy(*keys).applyInPandas(run, df.withColumns({c: F.col(c).cast("double") for c in columns}).schema)


def autoregression(df: DataFrame, column: str, order: int = 2, ahead: int = 1, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """(keys, step, forecast) of an AR(order) with a constant, fitted by least squares a series."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(time)[column].to_numpy(float)
        out = list(x)
        if len(x) > 2 * order + 1:
            a = np.column_stack([np.ones(len(x) - order), *[x[order - k : len(x) - k] for k in range(1, order + 1)]])
            beta, *_ = np.linalg.lstsq(a, x[order:], rcond=None)
            for _ in range(ahead):
                out.append(float(beta @ np.array([1.0, *out[: -order - 1 : -1]])))
        else:
            out += [out[-1] if out else float("nan")] * ahead
        first = rows[list(keys)].iloc[0].to_dict()
        return pd.DataFrame([first | {"step": k + 1, "forecast": v} for k, v in enumerate(out[len(x) :])])

    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + ", step long, forecast double"
    return df.groupBy(*keys).applyInPandas(run, schema)


def _lagged(x: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """The rows from ``start`` on of x, 1 to ``order`` steps earlier."""
    return [x[start - k : len(x) - k] for k in range(1, order + 1)]


def hannan_rissanen(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(coefficients, residuals) of a vector ARMA(p, q) with a constant, by two regressions; None for a series too short.

    A long autoregression gives the shocks; then every column is regressed on a constant, the last p values and the last q shocks.
    Rows of the coefficients: the constant, the values by lag, the shocks by lag.
    """
    n, d = x.shape
    long = max(p, q) + max(1, int(np.log(max(n, 2)) ** 1.2)) if q else 0
    start = long + max(p, q)
    if n - start <= 1 + (p + q) * d:
        return None
    shocks = np.zeros_like(x)
    if q:
        a = np.column_stack([np.ones(n - long), *_lagged(x, long, long)])
        shocks[long:] = x[long:] - a @ np.linalg.lstsq(a, x[long:], rcond=None)[0]
    a = np.column_stack([np.ones(n - start), *_lagged(x, p, start), *_lagged(shocks, q, start)])
    beta = np.linalg.lstsq(a, x[start:], rcond=None)[0]
    told = np.zeros_like(x)
    for t in range(max(p, q), n):  # the shocks that the fitted model itself sees
        told[t] = x[t] - np.concatenate([[1.0], *[x[t - k] for k in range(1, p + 1)], *[told[t - k] for k in range(1, q + 1)]]) @ beta
    return beta, told


def arima(df: DataFrame, columns: list[str], p: int = 1, d: int = 1, q: int = 1, ahead: int = 1, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """(keys, step, a forecast of every column): ARIMA(p, d, q) of one column, or the vector form of several, fitted a series.

    Values are differenced d times, fitted by ``hannan_rissanen``, forecast with shocks of 0, and summed back up d times.
    A series too short for its orders repeats its last values; rows with a null go.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(time)[columns].dropna().to_numpy(float)
        levels, fit = [x], None
        for _ in range(d):
            levels.append(np.diff(levels[-1], axis=0))
        if len(levels[-1]) > max(p, q):
            fit = hannan_rissanen(levels[-1], p, q)
        out = [x[-1] if len(x) else np.full(len(columns), np.nan)] * ahead
        if fit is not None:
            beta, shocks = fit
            past, noise, made = list(levels[-1]), list(shocks), []
            for _ in range(ahead):
                row = np.concatenate([[1.0], *[past[-k] for k in range(1, p + 1)], *[noise[-k] for k in range(1, q + 1)]])
                past.append(row @ beta)
                noise.append(np.zeros(len(columns)))
                made.append(past[-1])
            out = np.array(made)
            for level in levels[-2::-1]:
                out = level[-1] + np.cumsum(out, axis=0)
        first = rows[list(keys)].iloc[0].to_dict()
        return pd.DataFrame([first | {"step": k + 1} | dict(zip(columns, v, strict=True)) for k, v in enumerate(out)])

    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + ", step long, " + ", ".join(f"{c} double" for c in columns)
    return df.groupBy(*keys).applyInPandas(run, schema)


@dataclass
class Boosted:
    """Boosted trees for labels of any number of classes, with calibrated chances.

    Spark's booster knows two classes, so each class is boosted against the rest; the margins of the rows held back from fitting
    give each class a logistic calibration, and the calibrated chances are brought to a sum of one.
    """

    classes: list
    features: list[str]
    models: list
    calibrations: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Add p_<class> and prediction (the likeliest class, ties to the first); rows with a null feature have nulls."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        out = VectorAssembler(inputCols=self.features, outputCol="__x", handleInvalid="keep").transform(df)
        for k, (model, (slope, shift)) in enumerate(zip(self.models, self.calibrations, strict=True)):
            out = model.transform(out).withColumn(f"__s{k}", 1 / (1 + F.exp(-(F.lit(slope) * F.get(vector_to_array("__raw"), F.lit(1)) + F.lit(shift))))).drop("__raw", "__p", "__y")
        sound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in self.features])
        names = [f"p_{c}" for c in self.classes]
        total = reduce(lambda a, b: a + b, [F.col(f"__s{k}") for k in range(len(names))])
        out = out.withColumns({n: F.when(sound, F.col(f"__s{k}") / total) for k, n in enumerate(names)})
        best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        return out.withColumn("prediction", F.coalesce(*[F.when(F.col(n) == best, F.lit(c)) for n, c in zip(names, self.classes, strict=True)])).drop("__x", *[f"__s{k}" for k in range(len(names))])


def boosted_classes(df: DataFrame, features: list[str], label: str, held: Column, seed: int = 7, **params) -> Boosted:
    """Fit ``Boosted`` on the rows where ``held`` is false, calibrate on the others. The classes (few) come to the driver; null labels and rows with a null feature take no part."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.filter(F.col(label).isNotNull()).withColumn("__held", F.coalesce(held, F.lit(False)))
    rows = settle(VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(rows).select("__x", "__held", F.col(label).alias("__label")))
    classes = [r[0] for r in rows.select("__label").distinct().orderBy("__label").collect()]
    models, calibrations = [], []
    for c in classes:
        own = rows.withColumn("__own", (F.col("__label") == F.lit(c)).cast("double"))
        booster = GBTClassifier(featuresCol="__x", labelCol="__own", predictionCol="__y", seed=seed, **params)
        model = booster.setRawPredictionCol("__raw").setProbabilityCol("__p").fit(own.filter("NOT __held"))
        margin = model.transform(own.filter("__held")).select("__own", array_to_vector(F.array(F.get(vector_to_array("__raw"), F.lit(1)))).alias("__m"))
        line = LogisticRegression(featuresCol="__m", labelCol="__own", regParam=1e-3).fit(margin) if margin.select("__own").distinct().count() == 2 else None
        calibrations.append((float(line.coefficients[0]), float(line.intercept)) if line else (2.0, 0.0))
        models.append(model)
    return Boosted(classes, features, models, calibrations)


def trainer(kind: str, features: list[str], label: str, seed: int = 7, **params):
    """A pyspark.ml pipeline by name: rf_classifier, rf_regressor, gbt_regressor, gbt_classifier, logistic, linear."""
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as K
    from pyspark.ml import regression as R
    from pyspark.ml.feature import VectorAssembler

    kinds = {"rf_classifier": K.RandomForestClassifier, "rf_regressor": R.RandomForestRegressor, "gbt_regressor": R.GBTRegressor, "gbt_classifier": K.GBTClassifier, "logistic": K.LogisticRegression, "linear": R.LinearRegression}
    if kind not in kinds:
        raise ValueError(f"unknown model {kind!r}: one of {', '.join(kinds)}")
    seeded = {"seed": seed} if kind.startswith(("rf", "gbt")) else {}
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), kinds[kind](labelCol=label, featuresCol="features", **seeded, **params)])


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by the impurity they remove, largest first."""
    v = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, v.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def save_model(model, path: str) -> None:
    """A fitted pipeline to a folder that Spark can reach; what is there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def vector_autoregression(df: DataFrame, columns: list[str], order: int = 1, ahead: int = 1, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> DataFrame:
    """(keys, step, a forecast of every column): each column on a constant and the last ``order`` values of all, by least squares a series; a series too short repeats its last values."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(time)[columns].to_numpy(float)
        past = list(x)
        beta = None
        if len(x) > order * (len(columns) + 1) + 1:
            a = np.column_stack([np.ones(len(x) - order), *[x[order - k : len(x) - k] for k in range(1, order + 1)]])
            beta, *_ = np.linalg.lstsq(a, x[order:], rcond=None)
        for _ in range(ahead):
            past.append(np.concatenate([[1.0], *past[: -order - 1 : -1]]) @ beta if beta is not None else past[-1])
        first = rows[list(keys)].iloc[0].to_dict()
        return pd.DataFrame([first | {"step": k + 1} | dict(zip(columns, v, strict=True)) for k, v in enumerate(past[len(x) :])])

    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + ", step long, " + ", ".join(f"{c} double" for c in columns)
    return df.groupBy(*keys).applyInPandas(run, schema)
