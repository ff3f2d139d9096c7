"""Series features: lags, rolling frames, indices, splits, sequences; set and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.functions import calendar, series, spectral, text, water
from raincourse.operators import learning as L
from raincourse.operators.ordered import last_known, number_rows, rolling_rows
from raincourse.operators.ranking import quantiles
from raincourse.registry import query
from raincourse.views import SQL_VIEWS, Views

c = F.col
DAY = 86400.0


def ts_text() -> F.Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")


SQL_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
SQL_W = "WINDOW w AS (PARTITION BY station_id ORDER BY ts)"


def hour_window() -> Window:
    """Hourly rows: one per hour and station, so a partition is bounded by the clock."""
    return Window.partitionBy("station_id").orderBy("ts")


LAGS = [1, 3, 6, 12, 18, 24, 48, 72, 168]


@query("w01_series_lags", f"SELECT station_id, {SQL_TS}, " + ", ".join(f"round(lag(precip_mm, {n}) OVER w, 6) AS lag_{n}" for n in LAGS) + f" FROM hourly {SQL_W}")
def w01(v):
    return v.hourly.select("station_id", ts_text(), *[F.round(e, 6).alias(f"lag_{n}") for n, e in series.lags(c("precip_mm"), LAGS, hour_window()).items()])


@query("w01_event_lags", "SELECT event_id, lag(value, 1) OVER w AS lag_1, lag(value, 3) OVER w AS lag_3 FROM obs WINDOW w AS (PARTITION BY variable ORDER BY ts, event_id)")
def w01b(v):
    """Lags over raw readings of a few variables: each variable is cut into row blocks."""
    r = rolling_rows(v.obs.select("event_id", "ts", "variable", "value"), ["variable"], ["ts", "event_id"], 3, DAY,
                     lambda w: {f"lag_{n}": F.lag("value", n).over(w) for n in (1, 3)})
    return r.select("event_id", "lag_1", "lag_3")


ROLL = [3, 6, 12, 24]


@query("w02_rolling_full_window", f"SELECT station_id, {SQL_TS}, " + ", ".join(
    f"CASE WHEN count(*) OVER r{n} = {n} THEN round(avg(precip_mm) OVER r{n}, 6) END AS mean_{n}, CASE WHEN count(*) OVER r{n} = {n} THEN round(max(precip_mm) OVER r{n}, 6) END AS max_{n}, CASE WHEN count(*) OVER r{n} = {n} THEN round(stddev_samp(precip_mm) OVER r{n}, 5) END AS std_{n}" for n in (3, 12))
    + " FROM hourly WINDOW " + ", ".join(f"r{n} AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 12)))
def w02(v):
    cols = []
    for n in (3, 12):
        r = series.rolling(c("precip_mm"), n, hour_window(), full=True)
        cols += [F.round(r["mean"], 6).alias(f"mean_{n}"), F.round(r["max"], 6).alias(f"max_{n}"), F.round(r["std"], 5).alias(f"std_{n}")]
    return v.hourly.select("station_id", ts_text(), *cols)


@query("w03_rolling_partial_window", f"SELECT station_id, {SQL_TS}, " + ", ".join(f"round(avg(precip_mm) OVER r{n}, 6) AS mean_{n}, round(stddev_samp(precip_mm) OVER r{n}, 5) AS std_{n}, round(max(precip_mm) OVER r{n}, 6) AS max_{n}" for n in ROLL)
       + ", round(sum(precip_mm) OVER r24, 6) AS momentum_24, round(sum(precip_mm) OVER r48, 6) AS cumulative_48 FROM hourly WINDOW "
       + ", ".join(f"r{n} AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ROLL + [48]))
def w03(v):
    return series_features(v.hourly)


def series_features(hourly: DataFrame) -> DataFrame:
    cols = []
    for n in ROLL:
        r = series.rolling(c("precip_mm"), n, hour_window(), full=False)
        cols += [F.round(r["mean"], 6).alias(f"mean_{n}"), F.round(r["std"], 5).alias(f"std_{n}"), F.round(r["max"], 6).alias(f"max_{n}")]
    sums = {n: F.sum("precip_mm").over(hour_window().rowsBetween(1 - k, 0)) for n, k in (("momentum_24", 24), ("cumulative_48", 48))}
    return hourly.select("station_id", ts_text(), *cols, *[F.round(e, 6).alias(n) for n, e in sums.items()])


@query("w04_flow_antecedents", """SELECT river_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN count(*) OVER r3 = 3 THEN CAST(round(sum(n * 1.5) OVER r3, 9) AS DOUBLE) END AS rain_3d, CASE WHEN count(*) OVER r7 = 7 THEN CAST(round(sum(n * 1.5) OVER r7, 9) AS DOUBLE) END AS rain_7d, round(lag(discharge_cms, 1) OVER w, 9) AS q_1, round(lag(discharge_cms, 3) OVER w, 9) AS q_3, round(lag(discharge_cms, 7) OVER w, 9) AS q_7, round(discharge_cms - lag(discharge_cms) OVER w, 9) AS rate
    FROM daily_flow WINDOW w AS (PARTITION BY river_id ORDER BY day), r3 AS (PARTITION BY river_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), r7 AS (PARTITION BY river_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def w04(v):
    w = Window.partitionBy("river_id").orderBy("day")
    rain = c("n") * 1.5
    full = {n: F.when(F.count("*").over(w.rowsBetween(1 - n, 0)) == n, F.sum(rain).over(w.rowsBetween(1 - n, 0))) for n in (3, 7)}
    q = c("discharge_cms")
    return v.daily_flow.select("river_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(e, 9).alias(f"rain_{n}d") for n, e in full.items()],
                               *[F.round(F.lag(q, n).over(w), 9).alias(f"q_{n}") for n in (1, 3, 7)], F.round(q - F.lag(q).over(w), 9).alias("rate"))


AMI = [0.4, 0.25, 0.15, 0.1, 0.1]


@query("w05_antecedent_moisture", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, round((" + " + ".join(f"coalesce({x} * lag(theta, {i}) OVER w, 0)" for i, x in enumerate(AMI)) + ") / (" + " + ".join(f"CASE WHEN row_number() OVER w > {i} THEN {x} ELSE 0 END" for i, x in enumerate(AMI)) + "), 8) AS ami FROM monthly WINDOW w AS (PARTITION BY watershed_id ORDER BY month)")
def w05(v):
    w = Window.partitionBy("watershed_id").orderBy("month")
    return v.monthly.select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round(series.weighted_lags(c("theta"), AMI, w), 8).alias("ami"))


@query("w06_standardised_index", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, " + ", ".join(f"round((r{n} - avg(r{n}) OVER p) / (stddev_samp(r{n}) OVER p + 1e-8), 6) AS spi_{n}" for n in (1, 3, 6)) + " FROM (SELECT watershed_id, month, " + ", ".join(f"avg(p_mm) OVER (PARTITION BY watershed_id ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS r{n}" for n in (1, 3, 6)) + " FROM monthly) WINDOW p AS (PARTITION BY watershed_id)")
def w06(v):
    w, p = Window.partitionBy("watershed_id").orderBy("month"), Window.partitionBy("watershed_id")
    r = v.monthly.select("watershed_id", "month", *[F.avg("p_mm").over(w.rowsBetween(1 - n, 0)).alias(f"r{n}") for n in (1, 3, 6)])
    return r.select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"),
                    *[F.round((c(f"r{n}") - F.avg(f"r{n}").over(p)) / (F.stddev_samp(f"r{n}").over(p) + 1e-8), 6).alias(f"spi_{n}") for n in (1, 3, 6)])


@query("w07_grid_cell_features", f"""SELECT station_id, {SQL_TS}, round(max(temp_c) OVER r - min(temp_c) OVER r, 6) AS diurnal_range, round(lag(temp_c, 24) OVER w, 6) AS temp_lag_24, lag(humidity, 8) OVER w AS ndvi_lag_8, humidity - lag(humidity, 8) OVER w AS ndvi_change FROM hourly {SQL_W}, r AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def w07(v):
    w = hour_window()
    r = w.rowsBetween(-23, 0)
    return v.hourly.select("station_id", ts_text(), F.round(F.max("temp_c").over(r) - F.min("temp_c").over(r), 6).alias("diurnal_range"), F.round(F.lag("temp_c", 24).over(w), 6).alias("temp_lag_24"),
                           F.lag("humidity", 8).over(w).alias("ndvi_lag_8"), (c("humidity") - F.lag("humidity", 8).over(w)).alias("ndvi_change"))


SQL_VIEWS["climate_index"] = "SELECT watershed_id, month, (p_mm - 620) / 100 AS oni, (theta - 0.30) * 60 AS dmi FROM monthly"
SQL_VIEWS["regime"] = """SELECT *, CASE WHEN nino AND dmi >= 0.4 THEN 'SEVERE_DRY' WHEN nina AND dmi <= -0.4 THEN 'SEVERE_WET' WHEN nino THEN 'EL_NINO' WHEN nina THEN 'LA_NINA' WHEN dmi >= 0.4 THEN 'POSITIVE_IOD' WHEN dmi <= -0.4 THEN 'NEGATIVE_IOD' ELSE 'NEUTRAL' END AS regime FROM (
    SELECT *, count(*) OVER w = 3 AND min(oni) OVER w >= 0.5 AS nino, count(*) OVER w = 3 AND max(oni) OVER w <= -0.5 AS nina FROM climate_index WINDOW w AS (PARTITION BY watershed_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


def regime(v: Views) -> DataFrame:
    """Regime per month: three months in a row beyond a limit, with the dipole taking part."""
    i = v.monthly.select("watershed_id", "month", ((c("p_mm") - 620) / 100).alias("oni"), ((c("theta") - 0.30) * 60).alias("dmi"))
    w = Window.partitionBy("watershed_id").orderBy("month").rowsBetween(-2, 0)
    three = F.count("*").over(w) == 3
    i = i.withColumns({"nino": three & (F.min("oni").over(w) >= 0.5), "nina": three & (F.max("oni").over(w) <= -0.5)})
    return i.withColumn("regime", series.regime(c("nino"), c("nina"), c("dmi")))


@query("w10_climate_regime", """SELECT watershed_id, strftime(month, '%Y-%m') AS month, regime, row_number() OVER (PARTITION BY watershed_id, regime, g ORDER BY month) AS months_active FROM (SELECT *, row_number() OVER (PARTITION BY watershed_id ORDER BY month) - row_number() OVER (PARTITION BY watershed_id, regime ORDER BY month) AS g FROM regime)""")
def w10(v):
    return series.run_length(regime(v), ["watershed_id"], "regime", "month", "months_active").select(
        "watershed_id", F.date_format("month", "yyyy-MM").alias("month"), "regime", c("months_active").cast("long").alias("months_active"))


SQL_FACTORS = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in series.REGIME_FACTORS.items())


@query("m39_regime_bias_factors", f"SELECT r.watershed_id, strftime(r.month, '%Y-%m') AS month, regime, round(p_mm * f.rain, 5) AS rain_mm, round(26 + theta + f.temp, 6) AS temp_c FROM regime r JOIN monthly m ON r.watershed_id = m.watershed_id AND r.month = m.month JOIN (VALUES {SQL_FACTORS}) f(name, rain, temp) ON f.name = regime")
def m39(v):
    x = regime(v).join(v.monthly.select("watershed_id", "month", "p_mm", "theta"), ["watershed_id", "month"])
    rain, temp = series.regime_factors(c("regime"))
    return x.select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), "regime", F.round(c("p_mm") * rain, 5).alias("rain_mm"), F.round(26 + c("theta") + temp, 6).alias("temp_c"))


@query("w12_forward_fill", """SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY variable ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), (SELECT quantile_cont(x, 0.5) FROM (SELECT CASE WHEN value >= 40 THEN value END AS x FROM obs))) AS filled FROM (SELECT *, CASE WHEN value >= 40 THEN value END AS x FROM obs)""")
def w12(v):
    """Last known value of the variable, else the median of the column; chunks carry the value across."""
    o = v.obs.select("event_id", "variable", "ts", F.when(c("value") >= 40, c("value")).alias("x"))
    med = quantiles(o, [], "x", {"m": 0.5}).scalar()
    return last_known(o, ["variable"], ["ts", "event_id"], "x", "f", DAY).select("event_id", F.coalesce("f", med).alias("filled"))


@query("w13_time_index", "SELECT event_id, row_number() OVER (PARTITION BY variable ORDER BY ts, event_id) - 1 AS time_idx, CAST(ts AS DATE) - CAST(min(ts) OVER (PARTITION BY variable) AS DATE) AS days_since FROM obs")
def w13(v):
    o = v.obs.select("event_id", "variable", "ts")
    first = o.groupBy("variable").agg(F.min("ts").alias("t0"))
    n = number_rows(o, ["variable"], ["ts", "event_id"], DAY)
    return n.join(first, "variable").select("event_id", (c("_rn") - 1).alias("time_idx"), F.datediff("ts", "t0").cast("long").alias("days_since"))


@query("w14_chronological_split", """SELECT split, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM (SELECT h.ts, CASE WHEN r <= floor(t * CAST(0.70 AS DOUBLE)) THEN 'train' WHEN r <= floor(t * (CAST(0.70 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM hourly h JOIN (SELECT ts, row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS t FROM (SELECT DISTINCT ts FROM hourly)) USING (ts)) GROUP BY 1""")
def w14(v):
    """70/15/15 over distinct time steps; steps are numbered in time chunks."""
    h = v.hourly
    s = series.chronological_split(h, "ts", 0.70, 0.15, 7 * DAY)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@query("w14_group_split", "SELECT station_id, count(*) FILTER (WHERE r <= floor(n * CAST(0.85 AS DOUBLE))) AS train, count(*) FILTER (WHERE r > floor(n * CAST(0.85 AS DOUBLE))) AS val FROM (SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY station_id) AS n FROM hourly) GROUP BY 1")
def w14b(v):
    w = Window.partitionBy("station_id")
    x = v.hourly.select("station_id", F.row_number().over(w.orderBy("ts")).alias("r"), F.count("*").over(w).alias("n"))
    train = c("r") <= F.floor(c("n") * 0.85)
    return x.groupBy("station_id").agg(F.count_if(train).alias("train"), F.count_if(~train).alias("val"))


@query("w15_sliding_sequences", """SELECT river_id, strftime(day, '%Y-%m-%d') AS day, round(sum(discharge_cms) OVER w, 9) AS sequence_sum, round(first_value(discharge_cms) OVER w, 9) AS oldest, round(discharge_cms, 9) AS target FROM daily_flow WINDOW w AS (PARTITION BY river_id ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = 30""")
def w15(v):
    """The 30 rows before each row as an array, with the row itself as target; only full arrays."""
    s = series.sequences(v.daily_flow, ["river_id"], "day", "discharge_cms", 30)
    return s.select("river_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x), 9).alias("sequence_sum"),
                    F.round(F.element_at("sequence", 1), 9).alias("oldest"), F.round("discharge_cms", 9).alias("target"))


@query("w21_keep_last_n", "SELECT gauge_id, flow_id FROM flow QUALIFY row_number() OVER (PARTITION BY gauge_id ORDER BY day DESC, flow_id DESC) <= 3")
def w21(v):
    """Newest three records per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy("gauge_id").orderBy(c("day").desc(), c("flow_id").desc())
    return v.flow.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("gauge_id", "flow_id")


# --- expressions -----------------------------------------------------------
SQL_VIEWS["bands"] = "SELECT p_partkey AS cell_id, " + ", ".join(f"0.02 + ((p_partkey * {7 + 2 * i}) % 97) / 100.0 AS b{i}" for i in range(2, 8)) + " FROM part"


@query("m37_spectral_indices", """SELECT cell_id, round((b5 - b4) / (b5 + b4 + 1e-6), 6) AS ndvi, round(2.5 * (b5 - b4) / (b5 + 6 * b4 - 7.5 * b2 + 1 + 1e-6), 4) AS evi, round((b3 - b5) / (b3 + b5 + 1e-6), 6) AS ndwi, round((b3 - b6) / (b3 + b6 + 1e-6), 6) AS mndwi, round((b5 - b7) / (b5 + b7 + 1e-6), 6) AS nbr, round((b6 - b5) / (b6 + b5 + 1e-6), 6) AS ndbi FROM bands""")
def m37(v):
    k = c("p_partkey")
    b = v.table("part").select(k.alias("cell_id"), *[(0.02 + ((k * (7 + 2 * i)) % 97) / 100.0).alias(f"b{i}") for i in range(2, 8)])
    return b.select("cell_id", *[F.round(e, 4 if n == "evi" else 6).alias(n) for n, e in spectral.indices().items()])


@query("m38_interactions", f"""SELECT station_id, {SQL_TS}, round(temp_c * humidity, 5) AS temp_x_humidity, round(greatest(es - es * humidity / 100.0, 0), 5) AS humidity_deficit, round(((station_id * 13) % 1500) * precip_mm, 4) AS orographic FROM (SELECT *, 6.112 * exp(17.67 * (temp_c / 10) / (temp_c / 10 + 243.5)) AS es FROM hourly)""")
def m38(v):
    return v.hourly.select("station_id", ts_text(), F.round(c("temp_c") * c("humidity"), 5).alias("temp_x_humidity"),
                           F.round(spectral.humidity_deficit(c("temp_c") / 10, c("humidity")), 5).alias("humidity_deficit"),
                           F.round(((c("station_id") * 13) % 1500) * c("precip_mm"), 4).alias("orographic"))


@query("g05_station_features", f"""SELECT station_id, {SQL_TS}, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(lag(precip_mm, 1) OVER w, 6) AS lag_1, round(avg(precip_mm) OVER r, 6) AS mean_6, round(greatest(es - es * humidity / 100.0, 0), 5) AS humidity_deficit FROM (SELECT *, 6.112 * exp(17.67 * (temp_c / 10) / (temp_c / 10 + 243.5)) AS es FROM hourly) {SQL_W}, r AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def g05(v):
    """Feature build of the station entity; columns with under 70 % values are dropped (the 48-hour lag is one)."""
    w = hour_window()
    f = v.hourly.select("station_id", ts_text(), F.round(calendar.cyclic(c("ts"))["hour_sin"], 6).alias("hour_sin"), F.round(F.lag("precip_mm", 1).over(w), 6).alias("lag_1"),
                        F.round(F.lag("precip_mm", 48).over(w), 6).alias("lag_48"), F.round(F.avg("precip_mm").over(w.rowsBetween(-5, 0)), 6).alias("mean_6"),
                        F.round(spectral.humidity_deficit(c("temp_c") / 10, c("humidity")), 5).alias("humidity_deficit"))
    from raincourse.operators.quality import dense_columns

    return dense_columns(f, 0.7)


# --- sets, text, structures ------------------------------------------------
@query("u01_concatenate_parts", "SELECT event_id, value, NULL AS precip_mm FROM obs WHERE variable IS DISTINCT FROM 'view' UNION ALL SELECT event_id, value, precip_mm FROM obs WHERE variable = 'view'")
def u01(v):
    a = v.obs.filter("variable IS DISTINCT FROM 'view'").select("event_id", "value")
    b = v.obs.filter("variable = 'view'").select("event_id", "value", "precip_mm")
    return series.stack([a, b])


@query("u02_common_rows", "SELECT station_id, aux FROM obs WHERE variable = 'click' INTERSECT SELECT station_id, aux FROM obs WHERE variable IS DISTINCT FROM 'click'")
def u02(v):
    a, b = (v.obs.filter(f"variable IS {n}DISTINCT FROM 'click'") for n in ("NOT ", ""))
    cols = [n for n in a.columns if n in b.columns and n in ("station_id", "aux")]
    return a.select(*cols).intersect(b.select(*cols))


@query("u03_required_minus_present", "SELECT event_id, array_to_string(list_filter(['k', 'unit', 'qc'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing FROM events")
def u03(v):
    missing = F.array_except(F.array(*map(F.lit, ["k", "unit", "qc"])), F.json_object_keys("props"))
    return v.events.select("event_id", F.array_join(missing, ",").alias("missing"))


@query("u05_recent_cells", "SELECT DISTINCT station_id FROM obs WHERE ts >= (SELECT max(ts) FROM obs) - INTERVAL 7 DAY")
def u05(v, limit: int | None = None):
    """Cells seen in the last seven days; with ``limit`` the first of them by id."""
    o = v.obs
    last = o.agg(F.max("ts")).scalar()
    cells = o.filter(c("ts") >= last - F.expr("interval 7 days")).select("station_id").dropDuplicates()
    return cells if limit is None else cells.orderBy("station_id").limit(limit)


@query("x02_name_matching", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS key, contains(lower(p_name), 'ring') AS is_ring, regexp_matches(lower(p_type), 'eco|std') AS is_cheap FROM part")
def x02(v):
    return v.table("part").select("p_partkey", text.normal_name(c("p_name")).alias("key"), F.lower("p_name").contains("ring").alias("is_ring"), F.lower("p_type").rlike("eco|std").alias("is_cheap"))


@query("x03_content_key", """SELECT event_id, sha256('{"station":' || user_id || ',"type":"' || event_type || '"}') AS key FROM events""")
def x03(v):
    return v.events.select("event_id", text.content_key({"type": c("event_type"), "station": c("user_id")}).alias("key"))


@query("y03_truncated_list", "SELECT station_id, array_to_string(l[1:5], ', ') || CASE WHEN len(l) > 5 THEN ' (+' || (len(l) - 5) || ' more)' ELSE '' END AS days FROM (SELECT station_id, list(day ORDER BY day) AS l FROM (SELECT DISTINCT station_id, strftime(day, '%m-%d') AS day FROM daily) GROUP BY 1)")
def y03(v):
    """One entry per day bounds the list."""
    d = v.daily.select("station_id", F.date_format("day", "MM-dd").alias("d")).groupBy("station_id").agg(F.array_sort(F.collect_set("d")).alias("l"))
    return d.select("station_id", text.shortened(c("l"), 5).alias("days"))


@query("y05_nested_state", """SELECT event_id, '{' || array_to_string(list_transform(list_sort(list_distinct(list_append(coalesce(json_keys(props), []), 'level'))),
    lambda x: '"' || x || '":"' || CASE WHEN x = 'level' THEN CASE WHEN value > 100 THEN 'high' ELSE 'low' END ELSE json_extract_string(props, '$.' || x) END || '"'), ',') || '}' AS state FROM events""")
def y05(v):
    """JSON state parsed to a map of texts, merged with new entries and written back in key order."""
    old = F.coalesce(F.from_json("props", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    level = F.create_map(F.lit("level"), F.when(c("value") > 100, "high").otherwise("low"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: k != "level"), level)
    return v.events.select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("state"))
