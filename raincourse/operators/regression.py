"""Regression jobs on Spark: library models for rows, normal equations for many small series."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raincourse.operators.ordered import number_rows
from raincourse.session import sized


CHUNK_ROWS = 100_000  # rows of one stretch of time that are sorted together


def boosted_folds(df: DataFrame, inputs: list[str], label: str, order: list[str], folds: int, width: float) -> DataFrame:
    """Boosted trees trained on all folds but one and tested on it; folds are contiguous in time.

    Rows are numbered in stretches of at most ``width`` seconds, shorter where more rows than ``CHUNK_ROWS`` are to be
    expected in one, so a task sorts a bounded number of them however dense the readings are.
    """
    rows = sized(df.withColumn("_k", F.lit(0)), "rows")
    at = F.col(order[0]).cast("double")
    n, span = rows.agg(F.count("*"), F.max(at) - F.min(at)).first()
    width = min(width, max((span or 0.0) * CHUNK_ROWS / max(n, 1), 1.0))
    numbered = number_rows(rows, ["_k"], order, width).withColumn("fold", F.floor((F.col("_rn") - 1) * folds / n).cast("int"))
    rows = sized(numbered.select("fold", *inputs, F.col(label).alias("label")), "folds")
    data = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select("fold", "features", "label")
    model = GBTRegressor(maxIter=8, maxDepth=4, seed=42)
    err = F.col("prediction") - F.col("label")
    scored = [model.fit(data.filter(F.col("fold") != k)).transform(data.filter(F.col("fold") == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, scored).groupBy("fold").agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))


def score_linear(train: DataFrame, rows: DataFrame, inputs: list[str]) -> DataFrame:
    a = VectorAssembler(inputCols=inputs, outputCol="features")
    return LinearRegression(solver="normal").fit(a.transform(train)).transform(a.transform(rows)).drop("features")


def _design(t: Column) -> list[Column]:
    return [F.lit(1.0), t, F.sin(2 * math.pi * t), F.cos(2 * math.pi * t)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, [x * y for x, y in zip(a, b, strict=True)])


def _products(x: list[Column], y: Column) -> dict[str, Column]:
    """What a row adds to the sums behind the normal equations: upper triangle of X'X, X'y, y'y and the count."""
    pairs = {f"_a{i}_{j}": x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))}
    return pairs | {f"_b{i}": a * y for i, a in enumerate(x)} | {"_yy": y * y, "_n": F.lit(1.0)}


def _solved(sums: DataFrame, size: int) -> DataFrame:
    """Coefficients ``beta`` and residual deviation ``sigma`` from the sums, by elimination in columns.

    A term that the earlier ones already span (a series too short for it) gets coefficient 0.
    """
    c = F.col
    given = sums.columns
    df = sums.withColumns({f"_d{k}": c(f"_a{k}_{k}") for k in range(size)})
    for k in range(size):
        df = df.withColumn(f"_i{k}", F.when(c(f"_a{k}_{k}") > 1e-10 * c(f"_d{k}"), 1 / c(f"_a{k}_{k}")).otherwise(0.0))
        step = {}
        for i in range(k + 1, size):
            factor = c(f"_a{k}_{i}") * c(f"_i{k}")
            step |= {f"_a{i}_{j}": c(f"_a{i}_{j}") - factor * c(f"_a{k}_{j}") for j in range(i, size)}
            step[f"_b{i}"] = c(f"_b{i}") - factor * c(f"_b{k}")
        df = df.withColumns(step | {"_yy": c("_yy") - c(f"_b{k}") * c(f"_b{k}") * c(f"_i{k}")})
    for k in reversed(range(size)):
        rest = reduce(lambda a, j: a - c(f"_a{k}_{j}") * c(f"_x{j}"), range(k + 1, size), c(f"_b{k}"))
        df = df.withColumn(f"_x{k}", rest * c(f"_i{k}"))
    sigma = F.sqrt(F.greatest(c("_yy"), F.lit(0.0)) / F.greatest(c("_n") - size, F.lit(1.0)))
    return df.select(*[n for n in given if not n.startswith("_")], F.array(*[c(f"_x{k}") for k in range(size)]).alias("beta"), sigma.alias("sigma"))


def _value(x: list[Column]) -> Column:
    return _dot([F.element_at("beta", i + 1) for i in range(len(x))], x)


def linear_folds(df: DataFrame, inputs: list[str], label: str, time: str, folds: int) -> DataFrame:
    """Least squares on all folds but one, tested on it; folds are stretches of time of equal length.

    The sums of every fold are taken once; those of the other folds are the total less its own, so
    no row is read again for a refit and none is numbered. A fold without rows has no result.
    """
    at = F.unix_timestamp(time)
    first = F.unix_timestamp(df.agg(F.min(time)).scalar())
    length = F.unix_timestamp(df.agg(F.max(time)).scalar()) - first + 1
    x = [F.lit(1.0), *[F.col(i).cast("double") for i in inputs]]
    rows = df.dropna(subset=[*inputs, label, time]).withColumn("fold", F.floor((at - first) * folds / length).cast("int"))
    products = _products(x, F.col(label).cast("double"))
    own = sized(rows.groupBy("fold").agg(*[F.sum(p).alias(name) for name, p in products.items()]), "sums")
    every = Window.partitionBy()  # one row per fold
    others = own.select("fold", *[(F.sum(name).over(every) - F.col(name)).alias(name) for name in products])
    fits = sized(_solved(others, len(x)), "fits")
    err = _value(x) - F.col(label)
    return rows.join(fits, "fold").groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))


def seasonal_fit(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """Least squares of trend and one yearly harmonic per key: coefficients, deviation, last t."""
    x = _design(F.col(t))
    sums = df.dropna(subset=[t, y]).groupBy(*keys).agg(F.max(t).alias("last_t"), *[F.sum(p).alias(name) for name, p in _products(x, F.col(y)).items()])
    return _solved(sums, len(x))


def seasonal_forecast(df: DataFrame, keys: list[str], order: str, t: str, y: str, months: int, initial: int, period: int,
                      tails: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """The next months; the interval adds the quantiles of what the fit missed so far by, at the same lead time.

    Misses come from ``origin_errors``. A key too short for any cut-off has a forecast and null bounds.
    """
    misses = origin_errors(df, keys, order, t, y, initial, period, months).groupBy(*keys, F.col("lead").alias("step")).agg(
        *[F.percentile("error", F.lit(p)).alias(f"_q{i}") for i, p in enumerate(tails)])
    f = seasonal_fit(df, keys, t, y).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(months))))
    f = f.withColumn("yhat", _value(_design(F.col("last_t") + F.col("step") / 12.0)))
    return f.join(misses, [*keys, "step"], "left").select(*keys, "step", "yhat", (F.col("yhat") + F.col("_q0")).alias("lower"), (F.col("yhat") + F.col("_q1")).alias("upper"))


def origin_errors(df: DataFrame, keys: list[str], order: str, t: str, y: str, initial: int, period: int, horizon: int) -> DataFrame:
    """Observed less forecast (``error``) and observed (``actual``) for each cut-off and lead time.

    Cut-offs come every ``period`` rows after ``initial``, as long as ``horizon`` rows follow. The sums
    of the normal equations accumulate along each series, so a refit reads no row again; a series has
    one row per month.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = _design(F.col(t))
    ahead = F.collect_list(F.struct(F.col(t).alias("t"), F.col(y).cast("double").alias("y"))).over(w.rowsBetween(1, horizon))
    r = df.dropna(subset=[t, y]).select(*keys, F.row_number().over(w).alias("cutoff"), ahead.alias("ahead"), *[F.sum(p).over(upto).alias(name) for name, p in _products(x, F.col(y)).items()])
    cut = r.filter((F.col("cutoff") >= initial) & ((F.col("cutoff") - initial) % period == 0) & (F.size("ahead") == horizon))
    rows = _solved(cut, len(x)).select(*keys, "cutoff", "beta", F.posexplode("ahead").alias("lead", "a"))
    return rows.select(*keys, "cutoff", (F.col("lead") + 1).alias("lead"), (F.col("a.y") - _value(_design(F.col("a.t")))).alias("error"), F.col("a.y").alias("actual"))


def rolling_origin(df: DataFrame, keys: list[str], order: str, t: str, y: str, initial: int, period: int, horizon: int) -> DataFrame:
    """Validation with growing training data: errors over all cut-offs and lead times of ``origin_errors``."""
    e = F.col("error")
    return origin_errors(df, keys, order, t, y, initial, period, horizon).groupBy(*keys).agg(
        (F.count("*") / horizon).cast("long").alias("cutoffs"), F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / (F.abs("actual") + 1e-8)).alias("mape"))
