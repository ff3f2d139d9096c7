"""Regression by sums of normal equations, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincourse.operators import regression as R


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(rng.normal()), float(rng.normal(3, 2)), float(rng.normal())) for i in range(500)]
    rows = [(i, a, b, 2 * a - b + 0.5 * e) for i, a, b, e in rows] + [(40, None, 1.0, 1.0), (41, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "s long, a double, b double, y double").withColumn("at", F.timestamp_seconds(F.col("s") * 60))


def test_folds_are_refitted_without_their_own_rows(readings):
    got = {r.fold: r for r in R.linear_folds(readings, ["a", "b"], "y", "at", 5).collect()}
    rows = np.array([(r.s, r.a, r.b, r.y) for r in readings.dropna().collect()])
    fold = ((rows[:, 0] * 60) * 5 // (499 * 60 + 1)).astype(int)
    x = np.column_stack([np.ones(len(rows)), rows[:, 1:3]])
    for k in range(5):
        beta = np.linalg.lstsq(x[fold != k], rows[fold != k, 3], rcond=None)[0]
        err = x[fold == k] @ beta - rows[fold == k, 3]
        assert got[k].n == len(err)
        assert got[k].mae == pytest.approx(np.abs(err).mean(), rel=1e-9)
        assert got[k].rmse == pytest.approx(np.sqrt((err ** 2).mean()), rel=1e-9)


@pytest.fixture(scope="module")
def seasons(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, i / 12.0, float(50 + k * i + 20 * np.sin(i / 2) + rng.normal(0, 3))) for k, n in ((0, 72), (1, 60), (2, 2)) for i in range(n)]
    return spark.createDataFrame([*rows, (0, 80, 80 / 12.0, None)], "k int, month int, t double, y double")


def _fit(t, y):
    x = lambda t: np.column_stack([np.ones(len(t)), t, np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)])
    beta = np.linalg.lstsq(x(t), y, rcond=None)[0]
    return lambda t: x(np.asarray(t)) @ beta


def test_forecast_and_interval_from_earlier_misses(seasons):
    got = {(r.k, r.step): r for r in R.seasonal_forecast(seasons, ["k"], "month", "t", "y", 6, 36, 6).collect()}
    for k in (0, 1):
        t, y = np.array([(r.t, r.y) for r in seasons.filter(f"k = {k}").dropna().orderBy("month").collect()]).T
        ahead = _fit(t, y)(t[-1] + np.arange(1, 7) / 12)
        misses = [y[c:c + 6] - _fit(t[:c], y[:c])(t[c:c + 6]) for c in range(36, len(t) - 5, 6)]
        low, high = np.quantile(misses, [0.1, 0.9], axis=0)
        for s in range(6):
            row = got[k, s + 1]
            assert (row.yhat, row.lower, row.upper) == pytest.approx((ahead[s], ahead[s] + low[s], ahead[s] + high[s]), rel=1e-7)
    assert len(got) == 18 and got[2, 1].yhat is not None and got[2, 1].lower is None


def test_no_python_worker_and_no_rows_is_no_crash(seasons):
    out = R.seasonal_forecast(seasons.limit(0), ["k"], "month", "t", "y", 6, 36, 6)
    assert out.count() == 0
    plan = R.rolling_origin(seasons, ["k"], "month", "t", "y", 36, 6, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_dense_times_are_numbered_in_short_stretches(readings, monkeypatch):
    widths, number = [], R.number_rows
    monkeypatch.setattr(R, "number_rows", lambda df, keys, order, width: widths.append(width) or number(df, keys, order, width))
    monkeypatch.setattr(R, "CHUNK_ROWS", 50)
    rows = readings.dropna()
    got = R.boosted_folds(rows, ["a", "b"], "y", ["at", "s"], 5, 7 * 86400.0).orderBy("fold").collect()
    assert [(r.fold, r.n) for r in got] == [(k, 100) for k in range(5)]
    assert rows.groupBy(F.floor(F.col("at").cast("double") / widths[0])).count().agg(F.max("count")).first()[0] <= 60
