"""Learning jobs: boosted trees by contiguous folds, seasonal regression, rolling origin, batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.operators import regression as R
from raincourse.registry import query
from raincourse.views import SQL_VIEWS, Views

c = F.col


def lag_table(v: Views) -> DataFrame:
    """Hourly rain with three lagged inputs; one row per hour bounds each window."""
    w = Window.partitionBy("station_id").orderBy("ts")
    return v.hourly.select("station_id", "ts", "precip_mm", F.lag("precip_mm", 1).over(w).alias("lag_1"), F.lag("precip_mm", 3).over(w).alias("lag_3"),
                           c("humidity").cast("double").alias("humidity"), F.hour("ts").cast("double").alias("hour")).dropna()


@query("g07_rain_regression_folds")
def g07(v):
    """Boosted trees over five contiguous folds of time; MAE and RMSE per fold (no SQL form)."""
    return R.boosted_folds(lag_table(v), ["lag_1", "lag_3", "humidity", "hour"], "precip_mm", ["ts", "station_id"], 5, 7 * 86400.0).select(
        "fold", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


def sql_residuals(rows: str, key: str, inputs: list[str], y: str) -> str:
    """SQL for residual ``e`` of every row: inputs and ``y`` are made orthogonal one after the other (means, then
    each input) with slopes from the rows marked ``train``. Another way to least squares than the operators take."""
    on = f"FILTER (WHERE train) OVER (PARTITION BY {key})"
    names = [*inputs, y]
    sql = f"SELECT *, {', '.join(f'{n} - avg({n}) {on} AS q{i}_0' for i, n in enumerate(names))} FROM ({rows})"
    for k in range(len(inputs)):
        left = ", ".join(f"q{i}_{k} - q{k}_{k} * coalesce(sum(q{k}_{k} * q{i}_{k}) {on} / nullif(sum(q{k}_{k} * q{k}_{k}) {on}, 0), 0) AS q{i}_{k + 1}" for i in range(k + 1, len(names)))
        sql = f"SELECT *, {left} FROM ({sql})"
    return f"SELECT *, q{len(inputs)}_{len(inputs)} AS e FROM ({sql})"


SQL_VIEWS["lagged"] = """SELECT * FROM (SELECT station_id, ts, precip_mm, lag(precip_mm, 1) OVER w AS lag_1, lag(precip_mm, 3) OVER w AS lag_3, CAST(humidity AS DOUBLE) AS humidity, CAST(hour(ts) AS DOUBLE) AS hour
    FROM hourly WINDOW w AS (PARTITION BY station_id ORDER BY ts)) WHERE lag_1 IS NOT NULL AND lag_3 IS NOT NULL AND humidity IS NOT NULL AND precip_mm IS NOT NULL"""
SQL_VIEWS["folded"] = "SELECT *, CAST(floor((epoch(ts) - (SELECT min(epoch(ts)) FROM lagged)) * 5 / ((SELECT max(epoch(ts)) - min(epoch(ts)) + 1 FROM lagged))) AS INTEGER) AS fold FROM lagged"
FOLD_ROWS = "SELECT r.*, k AS tested, r.fold <> k AS train FROM folded r CROSS JOIN (SELECT unnest(range(5)) AS k)"


@query("g07_rain_linear_folds", f"SELECT fold, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM ({sql_residuals(FOLD_ROWS, 'tested', ['lag_1', 'lag_3', 'humidity', 'hour'], 'precip_mm')}) WHERE NOT train GROUP BY 1")
def g07_linear(v):
    """Linear form of the same regression, refitted per fold from one pass of sums."""
    return R.linear_folds(lag_table(v), ["lag_1", "lag_3", "humidity", "hour"], "precip_mm", "ts", 5).select(
        "fold", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


SQL_VIEWS["season"] = """SELECT watershed_id, t, sin(2 * pi() * t) AS s, cos(2 * pi() * t) AS c, y, row_number() OVER (PARTITION BY watershed_id ORDER BY month) AS i, count(*) OVER (PARTITION BY watershed_id) AS n
    FROM (SELECT watershed_id, month, (year(month) - 1992) + (month(month) - 1) / 12.0::DOUBLE AS t, CAST(p_mm AS DOUBLE) AS y FROM monthly)"""
SEASON_INPUTS = ["t", "s", "c"]


def sql_origins(period: int, horizon: int, initial: int = 36) -> str:
    """Rows of the season view once per cut-off that uses them, and what the fit before the cut-off misses."""
    rows = f"""SELECT r.*, cut, watershed_id * 10000 + cut AS fit, i <= cut AS train, i - cut AS lead FROM season r JOIN (SELECT unnest(range({initial}, 5000, {period})) AS cut) o ON i <= cut + {horizon} AND n >= cut + {horizon}"""
    return f"SELECT * FROM ({sql_residuals(rows, 'fit', SEASON_INPUTS, 'y')}) WHERE NOT train"


FUTURE = """SELECT watershed_id, t, s, c, y, true AS train, 0 AS step FROM season UNION ALL
    SELECT watershed_id, next_t, sin(2 * pi() * next_t), cos(2 * pi() * next_t), 0.0, false, step FROM (SELECT watershed_id, max(t) + step / 12.0::DOUBLE AS next_t, step FROM season CROSS JOIN (SELECT unnest(range(1, 7)) AS step) GROUP BY watershed_id, step)"""


def season_rows(v: Views) -> DataFrame:
    m = v.monthly
    t = (F.year("month") - 1992) + (F.month("month") - 1) / 12.0
    return m.select("watershed_id", "month", t.alias("t"), c("p_mm").cast("double").alias("y"))


@query("g08_seasonal_forecast", f"""SELECT watershed_id, step, round(-e, 4) AS yhat, round(q10 - e, 4) AS lower, round(q90 - e, 4) AS upper FROM ({sql_residuals(FUTURE, 'watershed_id', SEASON_INPUTS, 'y')})
    LEFT JOIN (SELECT watershed_id, lead AS step, quantile_cont(e, 0.1) AS q10, quantile_cont(e, 0.9) AS q90 FROM ({sql_origins(6, 6)}) GROUP BY 1, 2) USING (watershed_id, step) WHERE NOT train""")
def g08(v):
    """Trend plus one yearly harmonic per basin by normal equations, with an interval from earlier misses.

    Not the fitter of the usual seasonal library: a plain least-squares fit.
    """
    f = R.seasonal_forecast(season_rows(v), ["watershed_id"], "month", "t", "y", months=6, initial=36, period=6)
    return f.select("watershed_id", "step", *[F.round(x, 4).alias(x) for x in ("yhat", "lower", "upper")])


@query("g09_rolling_origin", f"SELECT watershed_id, count(DISTINCT cut) AS cutoffs, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(avg(abs(e) / (abs(y) + 1e-8)), 4) AS mape FROM ({sql_origins(6, 3)}) GROUP BY 1")
def g09(v):
    """Refit at each cut-off from cumulative sums; error on the months after it."""
    return R.rolling_origin(season_rows(v), ["watershed_id"], "month", "t", "y", initial=36, period=6, horizon=3).select(
        "watershed_id", "cutoffs", "n", *[F.round(x, 4).alias(x) for x in ("rmse", "mae", "mape")])


@query("g10_batch_scoring", """SELECT cell_id, h AS horizon_h, round((SELECT regr_intercept(precip_mm, humidity) FROM hourly) + (SELECT regr_slope(precip_mm, humidity) FROM hourly) * (p_size + h / 24.0), 5) AS prediction FROM cell CROSS JOIN (SELECT unnest([24, 48, 72]) AS h)""")
def g10(v):
    """A fitted linear model applied to every cell and horizon by ``transform``."""
    train = v.hourly.select(c("precip_mm").alias("label"), c("humidity").cast("double").alias("x"))
    cells = v.cell.select("cell_id", "p_size", F.explode(F.array(*map(F.lit, [24, 48, 72]))).alias("horizon_h")).withColumn("x", c("p_size") + c("horizon_h") / 24.0)
    return R.score_linear(train, cells, ["x"]).select("cell_id", "horizon_h", F.round("prediction", 5).alias("prediction"))
